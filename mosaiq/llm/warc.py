"""WARC archives: writing with revisits, segments and chunked framing; reading with segment reassembly.

Archives are written by Spark's text writer, as records end with CR LF CR LF: the writer's line end is a record's
last byte. Reading parses each archive by content lengths; continuation records are grouped by the identifier of
their origin, ordered by segment number, checked against the total length, joined, and then decoded.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
READ = "page_id bigint, record_id string, record_type string, target_uri string, refers_to bigint, digest string, payload_bytes bigint, payload binary, error string"
PART = "origin string, segment int, total bigint, head binary, block binary"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def chunked(data: bytes, size: int) -> bytes:
    """Chunked transfer framing: length in hex, data, and a last chunk of length 0."""
    parts = [b"%x\r\n%b\r\n" % (len(data[i : i + size]), data[i : i + size]) for i in range(0, len(data), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(data: bytes) -> bytes:
    """Inverse of chunked; extensions and trailers are passed over. ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        end = data.index(b"\r\n", at)
        n = int(data[at:end].split(b";")[0], 16)
        if not n:
            return b"".join(out)
        if data[end + 2 + n : end + 4 + n] != b"\r\n":
            raise ValueError("chunk of another length than given")
        out.append(data[end + 2 : end + 2 + n])
        at = end + 4 + n


def record(kind: str, headers: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *headers, ("Content-Length", len(block))] if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def one_line(text: str | None) -> str | None:
    return None if text is None else text.replace("\r", "%0D").replace("\n", "%0A")


def records(page_id, url, payload: bytes, digest: str, refers_to, uid: str, segment: int, chunk: int) -> Iterator[bytes]:
    """The records of a page: a revisit, a response, or a response's first segment and its continuations.

    A record is named by its page and payload, so that a revisit can name the response; ``uid`` tells rows apart that
    repeat both.
    """
    name = f"<urn:mosaiq:page:{'' if page_id is None else page_id}:{digest}{uid}>"
    about = [("WARC-Record-ID", name), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", one_line(url)), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers_to is not None:
        more = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:mosaiq:page:{refers_to}:{digest}>"), ("Content-Type", "application/http;msgtype=response")]
        yield record("revisit", about + more, HTTP + b"Content-Length: %d\r\n\r\n" % len(payload))
        return
    block = HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk)
    kind = [("Content-Type", "application/http;msgtype=response")]
    if len(block) <= segment:
        yield record("response", about + kind, block)
        return
    yield record("response", about + kind + [("WARC-Segment-Number", 1)], block[:segment])
    for k, i in enumerate(range(segment, len(block), segment), 2):
        last = [("WARC-Segment-Total-Length", len(block))] if i + segment >= len(block) else []
        yield record("continuation", [("WARC-Record-ID", f"{name[:-1]}:{k}>"), about[1], about[2], ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", k), *last], block[i : i + segment])


def write_warc(pages: DataFrame, path: str, segment: int = 32768, chunk: int = 8192, least: int = 0, records_a_file: int = 4096) -> None:
    """Write (page_id, url, payload binary) to gzipped archives under ``path``; a null payload is empty.

    Of records whose payloads are equal and of at least ``least`` bytes, those of the smallest page_id are
    responses, the others revisit it, naming its record. Rows with a null page_id are responses always. Repeated
    rows give a record each, with names that differ in their ends (a revisit of such a response names the page and
    payload, without an end); an empty table gives no record; other columns are ignored.
    """
    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("payload", F.lit(b"")).alias("payload"))
    keyed = pages.select("page_id", F.sha1("payload").alias("sha"), F.length("payload").alias("n")).groupBy("page_id", "sha", "n").agg(F.count("*").alias("times"))
    first = keyed.where(F.col("n") >= least).groupBy("sha", "n").agg(F.min("page_id").alias("first"), F.count("page_id").alias("pages")).where("pages > 1")
    facts = keyed.join(first, ["sha", "n"], "left").select("page_id", "sha", F.when(F.col("page_id") != F.col("first"), F.col("first")).alias("first"), (F.col("times") > 1).alias("again")).where("first is not null or again")
    joined = pages.withColumn("sha", F.sha1("payload")).join(facts, ["page_id", "sha"], "left")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        for b in batches:
            for i in range(0, b.num_rows, 256):
                out = []
                for r in b.slice(i, 256).to_pylist():
                    k += 1
                    digest = base64.b32encode(bytes.fromhex(r["sha"])).decode()
                    out += [x[:-1] for x in records(r["page_id"], r["url"], r["payload"], digest, r["first"], f"-{part}-{k}" if r["again"] or r["page_id"] is None else "", segment, chunk)]
                yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.binary())})

    lines = joined.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    lines.write.option("compression", "gzip").option("lineSep", "\n").option("maxRecordsPerFile", records_a_file).text(path)


def unzipped(data: bytes) -> bytes:
    """The content of all gzip members of a file; a file that isn't gzipped is returned as it is."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data:
        d = zlib.decompressobj(31)
        out.append(d.decompress(data))
        data = d.unused_data.lstrip(b"\0")
    return b"".join(out)


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record; a damaged record is passed over to the next."""
    at = data.find(b"WARC/1.")
    while at >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        head = {}
        for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            k, _, v = line.partition(":")
            head[k.strip().lower()] = v.strip()
        size = head.get("content-length", "")
        if size.isdigit() and data[end + 4 + int(size) : end + 8 + int(size)] == b"\r\n\r\n":
            yield head, data[end + 4 : end + 4 + int(size)]
            end += 4 + int(size)
        at = data.find(b"WARC/1.", end)


def number(text: str | None) -> int | None:
    part = (text or "").split(":")
    return int(part[3]) if len(part) > 3 and part[3].lstrip("-").isdigit() else None


def decoded(head: dict[str, str], block: bytes) -> dict:
    """The row of a whole record."""
    out = {"page_id": number(head.get("warc-record-id")), "record_id": head.get("warc-record-id"), "record_type": head.get("warc-type"), "target_uri": head.get("warc-target-uri"), "digest": head.get("warc-payload-digest", "").removeprefix("sha1:") or None, "refers_to": number(head.get("warc-refers-to")), "payload": None, "payload_bytes": None, "error": None}
    http, _, body = block.partition(b"\r\n\r\n")
    fields = dict(x.lower().split(b": ", 1) for x in http.split(b"\r\n")[1:] if b": " in x)
    try:
        if out["record_type"] == "revisit":
            out["payload_bytes"] = int(fields[b"content-length"]) if b"content-length" in fields else None
            return out
        out["payload"] = unchunked(body) if fields.get(b"transfer-encoding") == b"chunked" else body
        out["payload_bytes"] = len(out["payload"])
        if out["digest"] not in (None, base32_sha1(out["payload"])):
            out["error"] = "digest differs"
    except ValueError as e:
        out["error"] = str(e)
    return out


def assembled(segments: list[tuple[int, int | None, bytes]]) -> tuple[bytes | None, str | None]:
    """The block of ordered segments (number, total length or None, data), or what is wrong with them."""
    block = b"".join(x[2] for x in segments)
    total = next((x[1] for x in reversed(segments) if x[1] is not None), None)
    if [x[0] for x in segments] != list(range(1, len(segments) + 1)):
        return None, "segments are missing or repeated"
    if total is None or total != len(block):
        return None, f"total length is {total}, segments have {len(block)}"
    return block, None


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """A row for each response and revisit of the archives under ``path``.

    page_id, record_id, record_type, target_uri, refers_to, digest, payload_bytes, payload (null for revisits)
    and error: null, or why a record could not be put together; such a row has no payload. Segments may lie in
    any archive. A path with empty archives gives an empty table.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("content")
    whole_schema = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.int64()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("error", pa.string())])
    part_schema = pa.schema([("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("head", pa.binary()), ("block", pa.binary())])

    def in_batches(rows: Iterator[dict], schema: pa.Schema, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
        some, size = [], 0
        for r in rows:
            some.append(r)
            size += len(r.get("payload") or r.get("block") or b"")
            if size >= most or len(some) >= 2000:
                yield pa.RecordBatch.from_pylist(some, schema)
                some, size = [], 0
        if some:
            yield pa.RecordBatch.from_pylist(some, schema)

    def contents(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[dict[str, str], bytes]]:
        for b in batches:
            for x in b.column("content"):
                yield from parsed(unzipped(x.as_py()))

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from in_batches((decoded(h, x) for h, x in contents(batches) if h.get("warc-type") in ("response", "resource", "revisit") and "warc-segment-number" not in h), whole_schema)

    def part(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for h, x in contents(batches):
                if (k := h.get("warc-segment-number", "")).isdigit():
                    total = h.get("warc-segment-total-length", "")
                    first = "\n".join(f"{k}: {v}" for k, v in h.items()).encode() if k == "1" else None
                    yield {"origin": h.get("warc-segment-origin-id") or h.get("warc-record-id"), "segment": int(k), "total": int(total) if total.isdigit() else None, "head": first, "block": x}

        yield from in_batches(rows(), part_schema)

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for b in batches:
                for i in range(b.num_rows):
                    r = b.slice(i, 1).to_pylist()[0]
                    head = dict(x.split(": ", 1) for x in (r["head"] or b"").decode().split("\n") if ": " in x)
                    block, wrong = assembled([(s["segment"], s["total"], s["block"]) for s in r["segments"]])
                    if block is None:
                        yield decoded(head | {"warc-record-id": r["origin"], "warc-type": "response"}, b"") | {"payload": None, "payload_bytes": None, "error": wrong}
                    else:
                        yield decoded(head, block)

        yield from in_batches(rows(), whole_schema)

    grouped = files.mapInArrow(part, PART).groupBy("origin").agg(F.max("head").alias("head"), F.array_sort(F.collect_list(F.struct("segment", "total", "block"))).alias("segments"))
    return files.mapInArrow(whole, READ).unionByName(grouped.mapInArrow(join, READ))
