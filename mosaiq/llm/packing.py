"""Best-fit packing of tokenized documents into sequences, by matching of large items.

Pieces above a third of the capacity share a bin with one other such piece at most; they are matched greedily,
the longest first, each with the longest that still fits, which makes the most pairs. Smaller pieces then go,
the longest first, where they leave the smallest gap. Lengths are whole numbers up to the capacity, so this is
planned over the counts of each length: equal bins are one group (a range of bin numbers), and the plan maps
ranges of ranks among the pieces of a length to bins. Its size depends on the capacity alone, not on the corpus.
"""

from __future__ import annotations

import bisect
import json
import unicodedata
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import Scratch, batch, text_blocks
from .tokencount import tokenizer
from .words import U, Words, as_bytes, ranges, word_hashes


#: The pre-tokenizer's pattern for which texts may be cut as units() does.
CUTTABLE = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_KIND = np.full(256, 3, np.uint8)  # 0 white space, 1 ASCII punctuation but the apostrophe, 2 ASCII letter or digit, 3 other
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[c for c in range(33, 127) if not chr(c).isalnum() and c != 39]] = 1
_KIND[[c for c in range(128) if chr(c).isalnum()]] = 2


def units(texts: list[bytes], whole: bool) -> Words:
    """Parts of texts whose ids, one after the other, are the texts' ids.

    Cuts lie at white space and, unless ``whole``, between ASCII punctuation and ASCII letters or digits: no
    piece of the pattern, no contraction and no composed character runs over these. ASCII capitals become
    small where an ASCII character follows (else a combining mark might).
    """
    data = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
    kind = _KIND[data]
    left, right = kind[:-1], kind[1:]
    change = (left == 0) != (right == 0)
    if not whole:
        change |= ((left == 1) & (right == 2)) | ((left == 2) & (right == 1))
        capital = np.flatnonzero((data[:-1] - 65 < 26) & (data[1:] < 128))
        data = data.copy()
        data[capital] += 32
    cut = np.flatnonzero(change)
    start, end = cut[right[cut] != 0] + 1, cut[left[cut] != 0] + 1
    at = np.cumsum([1, *(len(t) + 1 for t in texts)])
    return Words(data, start, end, np.searchsorted(start, at), at)


class WordIds:
    """Ids of units, each encoded by the library and kept in a table with one place for each low part of a hash."""

    def __init__(self, path: str, bits: int = 20, most: int = 6_000_000):
        self.tok, self.most, self.mask = tokenizer(path), most, U(2**bits - 1)
        made = json.loads(self.tok.to_str())
        steps = (made["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.cuttable = [x.get("pattern", {}).get("Regex") for x in steps][:1] == [CUTTABLE]
        vocabulary = self.tok.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # whether an id ends a word
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.special = [x["content"].encode() for x in made["added_tokens"]]
        self.keys, self.rows = np.zeros(2**bits, U), np.zeros(2**bits, np.int64)
        self.clear()

    def clear(self) -> None:
        self.keys[:] = 0
        self.ids, self.used = np.empty(1 << 16, np.uint32), 0
        self.at, self.n, self.many = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64), 0

    def encode(self, texts: list[bytes], last: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, each followed by ``last``; the texts' starts and the end."""
        if not self.cuttable:
            each = [e.ids for e in self.tok.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
            return np.array([i for ids in each for i in [*ids, last]], np.uint32), np.cumsum([0, *(len(x) + 1 for x in each)])
        if self.used > self.most:
            self.clear()
        w = units(texts, any(x in t for t in texts for x in self.special))
        keys, sample, which = np.unique(word_hashes(w), return_index=True, return_inverse=True)
        place = (keys & self.mask).astype(np.int64)
        rows = np.where(self.keys[place] == keys, self.rows[place], -1)
        new = np.flatnonzero(rows < 0)
        rows[new] = self.add([w.bytes_of(k) for k in sample[new].tolist()])
        self.keys[place[new]], self.rows[place[new]] = keys[new], rows[new]
        rows = rows[which]
        n = self.n[rows]
        total = np.concatenate([[0], np.cumsum(n)])[w.first] + np.arange(len(w.first))
        out = np.full(total[-1], last, np.uint32)
        keep = np.ones(len(out), bool)
        keep[total[1:] - 1] = False
        out[keep] = self.ids[ranges(self.at[rows], n)]
        return out, total

    def add(self, parts: list[bytes]) -> np.ndarray:
        """Encode units and keep their ids; their rows. Units of letters alone are encoded many in one text."""
        text = [p.decode() for p in parts]
        plain = [k for k, t in enumerate(text) if t.isalpha() and unicodedata.is_normalized("NFC", t)]
        rest = sorted(set(range(len(text))).difference(plain))
        order, ids, count = [], [], []
        lots = [plain[i : i + 2000] for i in range(0, len(plain), 2000)]
        for lot in lots:
            e = self.tok.encode_batch_fast([" ".join(text[k] for k in lot)], add_special_tokens=False)[0]
            got = np.array(e.ids, np.int64)
            stop = np.flatnonzero(self.ends[got])
            if len(stop) != len(lot) or stop[-1] != len(got) - 1:
                rest += lot  # a letter that the library holds for none: each by itself
                continue
            order += lot
            ids.append(got)
            count.append(np.diff(stop, prepend=-1))
        if rest:
            each = [e.ids for e in self.tok.encode_batch_fast([text[k] for k in rest], add_special_tokens=False)]
            order += rest
            ids.append(np.array([i for x in each for i in x], np.int64))
            count.append(np.array([len(x) for x in each]))
        if not order:
            return np.empty(0, np.int64)
        flat, n = np.concatenate(ids), np.concatenate(count)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while self.many + len(n) > len(self.n):
            self.at, self.n = (np.concatenate([x, np.empty_like(x)]) for x in (self.at, self.n))
        rows = np.empty(len(n), np.int64)
        rows[order] = self.many + np.arange(len(n))
        self.ids[self.used : self.used + len(flat)] = flat
        self.n[self.many : self.many + len(n)] = n
        self.at[self.many : self.many + len(n)] = self.used + np.cumsum(n) - n
        self.used, self.many = self.used + len(flat), self.many + len(n)
        return rows


_encoders: dict[str, WordIds] = {}


def tokenized_pieces(docs: DataFrame, path: str, capacity: int, last: int = 1, with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, and ids if asked for.

    part and rank_in_part place a piece among those of its length that its task made.
    """
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("rank_in_part", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int64()))] * with_ids)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = WordIds(path)
        enc = _encoders[path]
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in text_blocks(batches):
            ids, at = enc.encode(as_bytes(b.column("text")), last)
            n = np.diff(at)
            pieces = -(-n // capacity)
            k = ranges(np.zeros(len(n), np.int64), pieces)
            start = k * capacity
            length = np.minimum(np.repeat(n, pieces) - start, capacity)
            begin = np.repeat(at[:-1], pieces) + start
            data = memoryview(ids.astype("<u4")).cast("B")
            crc = [zlib.crc32(data[4 * a : 4 * (a + m)]) for a, m in zip(begin.tolist(), length.tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            ls = length[order]
            head = np.searchsorted(ls, ls)
            rank = np.empty(len(ls), np.int64)
            rank[order] = seen[ls] + np.arange(len(ls)) - head
            np.add.at(seen, length, 1)
            more = {"ids": [ids[a : a + m].astype(np.int64) for a, m in zip(begin, length, strict=True)]} if with_ids else {}
            yield batch(schema, doc_id=b.column("doc_id").take(pa.array(np.repeat(np.arange(len(n)), pieces))), piece=k.astype(np.int32), start=start, length=length, ids_crc32=crc, part=np.full(len(k), part, np.int32), rank_in_part=rank, **more)

    ddl = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, rank_in_part bigint" + ", ids array<bigint>" * with_ids
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, ddl)


def plan(count: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, first bin, pieces in a bin, offset in the bin) in order, and the number of bins."""
    left = {n: c for n, c in count.items() if c > 0}
    given: dict[int, int] = {}
    rows: list[tuple[int, int, int, int, int]] = []
    groups: dict[int, list[tuple[int, int]]] = {}  # gap -> ranges of bins: first, how many
    gaps: list[int] = []
    bins = 0

    def put(length: int, first_bin: int, many: int, each: int, offset: int) -> None:
        rank = given.get(length, 0)
        rows.append((length, rank, first_bin, each, offset))
        given[length] = rank + many * each
        left[length] -= many * each

    def free(gap: int, first_bin: int, many: int) -> None:
        if gap and many:
            if gap not in groups:
                bisect.insort(gaps, gap)
                groups[gap] = []
            groups[gap].append((first_bin, many))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        if not left[n]:
            large.pop()
            continue
        k = bisect.bisect_right(large, capacity - n) - 1
        while k >= 0 and left[large[k]] < 1 + (large[k] == n):
            k -= 1
        many = left[n]
        if k < 0:
            put(n, bins, many, 1, 0)
            free(capacity - n, bins, many)
        elif large[k] == n:
            many = left[n] // 2
            put(n, bins, many, 2, 0)
            free(capacity - 2 * n, bins, many)
        else:
            many = min(many, left[other := large[k]])
            put(n, bins, many, 1, 0)
            put(other, bins, many, 1, n)
            free(capacity - n - other, bins, many)
        bins += many
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            k = bisect.bisect_left(gaps, n)
            if k == len(gaps):
                each = capacity // n
                many = max(1, left[n] // each)
                free(capacity, bins, many)
                bins += many
                continue
            gap = gaps[k]
            first, many = groups[gap].pop()
            if not groups[gap]:
                del groups[gap]
                gaps.pop(k)
            each = gap // n
            full = min(many, left[n] // each)
            if full:
                put(n, first, full, each, capacity - gap)
                free(gap - each * n, first, full)
            rest = many - full
            if rest and left[n]:  # fewer than each are left: they go into one bin
                some = left[n] if left[n] < each else 0
                if some:
                    put(n, first + full, 1, some, capacity - gap)
                    free(gap - some * n, first + full, 1)
                    full, rest = full + 1, rest - 1
            free(gap, first + full, rest)
    rows.sort()
    return np.array(rows, np.int64).reshape(-1, 5), bins


def pack(pieces: DataFrame, capacity: int, scratch: Scratch) -> DataFrame:
    """Pieces with sequence_id and offset. ``pieces`` must be a written table: its ranks are read twice."""
    here = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = {r.length: r.n for r in here.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    rows, _ = plan(counts, capacity)
    before = here.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    key = (rows[:, 0] << 40) + rows[:, 1]
    ranked = pieces.join(before, ["part", "length"]).withColumn("rank", F.col("before") + F.col("rank_in_part")).drop("before", "part", "rank_in_part")
    names = [c for c in ranked.columns if c != "rank"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(c).to_numpy() for c in ("length", "rank"))
            row = rows[np.searchsorted(key, (length << 40) + rank, "right") - 1]
            k = rank - row[:, 1]
            place = [pa.array(row[:, 2] + k // row[:, 3]), pa.array(row[:, 4] + k % row[:, 3] * length)]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + place, [*names, "sequence_id", "offset"])

    schema = T.StructType([ranked.schema[c] for c in names] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, last: int = 1, with_ids: bool = False) -> DataFrame:
    """All documents in sequences of at most ``capacity`` tokens; a row for each piece.

    A document is its ids and then ``last``; a null or empty text is ``last`` alone. Only longer documents
    are cut. Rows are independent: repeated rows and null ids are packed each; an empty table gives none.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    return pack(scratch.save(tokenized_pieces(docs, path, capacity, last, with_ids), "pieces"), capacity, scratch)
