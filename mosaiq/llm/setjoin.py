"""N-gram Jaccard join: links of documents by their sets of 5-word shingles, and the components of these links.

The plan, in the order of its steps:

1. One pass over the texts gives each document's set size and a 128-bit fingerprint of its set, and, for the
   hashes below a fixed threshold (the zone), packed blocks by hash bucket. A hash that two documents of a task
   hold is noted as shared there and sent once, so a hash that a third of all documents hold costs a few bytes
   a task. A document with more than 20 % of its shingles found in no other document is settled: it links with
   none. The others go on.
2. Documents of equal sets are one class, represented by their smallest id.
3. Answers of similar sets: representatives that share a min-hash are compared with a few of them, the
   pivots (the smallest, and the first by hashed ids). Who links with pivots joins their family, and the star of the
   smallest of them; it keeps only its difference from that pivot's set, and needs no other links inside the family.
4. Prefixes are taken with common hashes last: a bitmap of fixed size notes hashes that many families hold. Any
   order that depends on the hash alone gives whole results, so bits shared by chance do no harm.
   Inverted lists over prefixes, sorted by size and position, are read in blocks; a block of the list is skipped
   where its sizes or positions rule out the overlap, or where it lies in the family at hand. Pairs whose parity
   bitmaps differ in more bits than their sets may differ in elements are left out. What a list gives is pairs of
   stars, each once, so a group of near copies adds no pair for each two of its members. Lists of over LONG entries
   are cut into lots that meet in tasks of their own.
5. The pivots of two stars are compared. They link, or their distance, less the distances of the members from them,
   rules out every link between the stars, or the pair is undecided; a star of one document leaves nothing undecided.
6. Undecided pairs whose stars links have joined in the meantime need no more work. For the others, answers are
   derived from the pivot's: all members are seen as differences from one pivot, and meet where prefixes of their
   differences do.
7. Components of the links.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, batch, bitmap, in_bitmap, shuffle_partitions, text_blocks
from .graph import components
from .words import U, as_bytes, mix, segment, shingles

ZONE = 0.3  # share of the hashes looked at in the first step
LOT = 1_500_000  # hashes that a task of the first step holds
KEEP = 5  # bytes of a zone hash that are sent; equal cuts of unequal hashes only send more documents on


def sets_of(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    h, first = shingles(segment(texts), n)
    return [np.unique(h[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]


def fingerprint(h: np.ndarray) -> tuple[int, int]:
    """Two sums of mixed hashes, as signed 64-bit numbers."""
    return int(mix(h).sum(dtype=U).astype(np.int64)), int(mix(h ^ U(0x5851F42D4C957F2D)).sum(dtype=U).astype(np.int64))


def least_overlap(a: np.ndarray | int, b: np.ndarray | int, percent: int):
    """The least intersection with which sets of these sizes have 100 * intersection >= percent * union."""
    return -(-(percent * (a + b)) // (100 + percent))


COMMON_BITS, CLASS_BITS, PARITY_BITS, FOLD = 24, 24, 1024, 4


def parity(h: np.ndarray) -> bytes:
    """For each of PARITY_BITS slots whether an odd number of the hashes falls there.

    Sets that differ in d elements have parities that differ in d bits at most.
    """
    n = np.bincount(((h >> U(20)) % U(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS)
    return np.packbits((n & 1).astype(np.uint8)).tobytes()


def folded(column: pa.Array) -> np.ndarray:
    """Parities of FOLD * 64 slots, as FOLD rows of signed numbers: slots fall together, so their parities add up."""
    words = np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1, FOLD)
    return np.bitwise_xor.reduce(words, axis=1).view(np.int64).T


def near_enough(pairs: DataFrame, facts: DataFrame, percent: int, x: str, y: str) -> DataFrame:
    """The pairs that may be near, with ``most``: the largest (100 + percent) * difference that is still of use.

    ``facts`` has doc_id, size, reach and parity; most is the sum of both reaches. With reach = (100 - percent) * size a
    pair links exactly if its sets differ in most / (100 + percent) elements or fewer. Sizes and parities give a
    lower bound of the difference.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                p, q = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint64).reshape(b.num_rows, -1) for k in ("px", "py"))
                ok = (100 + percent) * np.bitwise_count(p ^ q).sum(1).astype(np.int64) <= b.column("most").to_numpy()
                yield b.select([x, y, "most"]).filter(pa.array(ok))

    small = facts.select("doc_id", "size", "reach", "parity")
    both = pairs.select(x, y).join(small.toDF(x, "nx", "rx", "px"), x).join(small.toDF(y, "ny", "ry", "py"), y).withColumn("most", (F.col("rx") + F.col("ry")).cast("bigint"))
    both = both.where((100 + percent) * F.abs(F.col("nx") - F.col("ny")) <= F.col("most"))
    return both.select(x, y, "most", "px", "py").mapInArrow(run, f"{x} bigint, {y} bigint, most bigint")


def differences(pairs: DataFrame, sets: DataFrame, percent: int, split: int = 512) -> DataFrame:
    """a, b, apart, plus, minus (what a's set has more and less than b's) for pairs a, b, most that are near enough.

    A task reads the set of b, then those of its partners a, one after the other. The partners of one b are dealt to
    as many tasks as they need, ``split`` to each.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("apart", pa.int64()), ("plus", pa.binary()), ("minus", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, base = None, None
        for t in batches:
            rows = []
            for b, a, most, data in zip(*(t.column(k) for k in ("b", "a", "most", "hashes")), strict=True):
                b, a, x = b.as_py(), a.as_py(), to_set(data.as_py())
                if a is None:
                    own, base = b, x
                    continue
                if b != own:
                    raise ValueError(f"the set of {b} is missing")
                apart = len(x) + len(base) - 2 * overlap(x, base)
                if (100 + percent) * apart <= most.as_py():
                    rows.append((a, b, apart, np.setdiff1d(x, base, True).tobytes(), np.setdiff1d(base, x, True).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    hashes = sets.select("doc_id", "hashes")
    tasks = pairs.groupBy("b").agg(F.ceil(F.count("*") / split).cast("int").alias("tasks"))
    left = pairs.join(tasks, "b").select("b", F.pmod(F.xxhash64("a"), "tasks").cast("int").alias("task"), "a", "most").join(hashes.withColumnRenamed("doc_id", "a"), "a")
    right = tasks.join(hashes.withColumnRenamed("doc_id", "b"), "b").select("b", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), F.lit(None).cast("bigint").alias("a"), F.lit(None).cast("bigint").alias("most"), "hashes")
    both = left.select("b", "task", "a", "most", "hashes").unionByName(right).repartition(shuffle_partitions(sets.sparkSession), "b", "task")
    return both.sortWithinPartitions("b", "task", F.col("a").asc_nulls_first()).mapInArrow(run, "a bigint, b bigint, apart bigint, plus binary, minus binary")


def prefix(h: np.ndarray, common: np.ndarray, percent: int) -> np.ndarray:
    """The hashes in which a set must meet every set it links with: the first ones, the common ones last."""
    k = len(h) - -(-percent * len(h) // 100) + 1
    late = in_bitmap(h, common, COMMON_BITS)
    if not late.any():
        return h[:k]
    light = h[~late]
    return light[:k] if len(light) >= k else np.concatenate([light, h[late][: k - len(light)]])


def common_hashes(sets: DataFrame, percent: int, scratch: Scratch, most: int = 8, rounds: int = 2) -> np.ndarray:
    """A bitmap of hashes that stand in more than ``most`` prefixes, and of several families; prefixes move on as it fills."""
    common = np.zeros(2 ** (COMMON_BITS - 3), np.uint8)
    for _ in range(rounds):
        lists = in_prefixes(sets, percent, common, False)
        lists = lists.groupBy("h").agg(F.count("*").alias("n"), (F.min("family") != F.max("family")).alias("mixed")).where((F.col("n") > most) & F.col("mixed"))
        before = common
        many = scratch.save(lists.select("h"), "common")  # so that the shuffle files of all prefixes go
        common = common | bitmap(many, COMMON_BITS)
        scratch.drop(many)
        if (before == common).all():
            break
    return common


def in_prefixes(sets: DataFrame, percent: int, common: np.ndarray, only_common: bool) -> DataFrame:
    """h, family: the hashes of all prefixes, or the common ones among them."""
    sent = sets.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = [prefix(to_set(x.as_py()), sent.value, percent) for x in b.column("hashes")]
            if only_common:
                h = [x[in_bitmap(x, sent.value, COMMON_BITS)] for x in h]
            yield pa.RecordBatch.from_pydict({"h": np.concatenate(h or [np.empty(0, U)]).astype(np.int64), "family": pa.array(np.repeat(b.column("family").to_numpy(), [len(x) for x in h]), pa.int64())})

    return sets.select("family", "hashes").mapInArrow(run, "h bigint, family bigint")


ZONED = "bucket int, block bigint, doc_id bigint, size int, in_zone int, shared int, f1 bigint, f2 bigint, hashes binary, docs binary, many binary"


def zoned(docs: DataFrame, n: int, buckets: int, zone: float) -> DataFrame:
    """Step 1: rows for documents (bucket null) and packed hashes (bucket given)."""
    schema = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("doc_id", pa.int64()), ("size", pa.int32()), ("in_zone", pa.int32()), ("shared", pa.int32()), ("f1", pa.int64()), ("f2", pa.int64()), ("hashes", pa.binary()), ("docs", pa.binary()), ("many", pa.binary())])
    top = U(int(zone * 2**64))

    def flush(ids, sets, block: int) -> Iterator[pa.RecordBatch]:
        count = np.array([len(s) for s in sets])
        part = [s[: np.searchsorted(s, top)] for s in sets]
        per = np.array([len(p) for p in part])
        h, doc = np.concatenate(part) if part else np.empty(0, U), np.repeat(np.arange(len(sets)), per)
        order = np.argsort(h, kind="stable")
        h, doc = h[order], doc[order]
        head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
        times = np.diff(np.append(head, len(h)))
        shared = np.bincount(doc, np.repeat(times > 1, times), len(sets)).astype(np.int32)
        prints = [fingerprint(s) for s in sets]
        none = [None] * len(sets)
        yield batch(schema, bucket=none, block=none, doc_id=ids, size=count.astype(np.int32), in_zone=per.astype(np.int32), shared=shared, f1=[p[0] for p in prints], f2=[p[1] for p in prints], hashes=none, docs=none, many=none)
        h, doc, many = h[head], doc[head], times > 1
        bucket = (h >> U(8)) % U(buckets)
        order = np.lexsort((doc, bucket))
        h, doc, many, bucket = h[order], np.array(ids, np.int64)[doc[order]], many[order], bucket[order].astype(np.int64)
        edge = np.searchsorted(bucket, np.arange(buckets + 1))
        cut = h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - KEEP :]
        full = np.flatnonzero(np.diff(edge))
        rows = {f.name: [None] * len(full) for f in schema} | {"bucket": full.astype(np.int32), "block": np.full(len(full), block)}
        rows["hashes"] = [cut[edge[k] : edge[k + 1]].tobytes() for k in full]
        rows["docs"] = [doc[edge[k] : edge[k + 1]].tobytes() for k in full]
        rows["many"] = [np.packbits(many[edge[k] : edge[k + 1]]).tobytes() for k in full]
        for i in range(0, len(full), 512):
            yield batch(schema, **{k: v[i : i + 512] for k, v in rows.items()})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sets, held, block = [], [], 0, TaskContext.get().partitionId() << 32
        for b in text_blocks(batches):
            ids += b.column("doc_id").to_pylist()
            sets += sets_of(as_bytes(b.column("text")), n)
            held += sum(len(s) for s in sets[-b.num_rows :])
            if held > LOT:
                yield from flush(ids, sets, block)
                ids, sets, held, block = [], [], 0, block + 1
        if ids:
            yield from flush(ids, sets, block)

    return docs.mapInArrow(run, ZONED)


def found_shared(blobs: DataFrame) -> DataFrame:
    """doc_id, n: how many of a document's hashes that its own task thought single are held elsewhere.

    A bucket answers each block with one row: the documents of its hashes that are shared.
    """

    def run(table: pa.Table) -> pa.Table:
        h, doc, many, block = ([x.as_py() for x in table.column(name)] for name in ("hashes", "docs", "many", "block"))
        size = np.array([len(x) // KEEP for x in h])
        cut = np.frombuffer(b"".join(h), np.uint8).reshape(-1, KEEP)
        value = np.zeros((len(cut), 8), np.uint8)
        value[:, :KEEP] = cut
        value, doc = value.view("<u8").ravel(), np.frombuffer(b"".join(doc), np.int64)
        many = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=s) for m, s in zip(many, size, strict=True)]).astype(bool)
        order = np.argsort(value, kind="stable")
        v = value[order]
        again = np.concatenate([[False], v[1:] == v[:-1]])
        shared = np.empty(len(v), bool)
        shared[order] = again | np.append(again[1:], False)
        shared &= ~many
        edge = np.concatenate([[0], np.cumsum(size)])
        found = [doc[i:j][shared[i:j]].tobytes() for i, j in zip(edge[:-1], edge[1:], strict=True)]
        return pa.table({"block": pa.array(block, pa.int64()), "docs": pa.array(found, pa.binary())}).filter(pa.array([bool(x) for x in found]))

    def count(table: pa.Table) -> pa.Table:
        ids, n = np.unique(np.frombuffer(b"".join(x.as_py() for x in table.column("docs")), np.int64), return_counts=True)
        return pa.table({"doc_id": ids, "n": n.astype(np.int64)})

    found = blobs.select("bucket", "block", "hashes", "docs", "many").groupBy("bucket").applyInArrow(run, "block bigint, docs binary")
    return found.groupBy("block").applyInArrow(count, "doc_id bigint, n bigint").groupBy("doc_id").agg(F.sum("n").alias("n"))


def to_set(data: bytes) -> np.ndarray:
    return np.frombuffer(data, U)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def families(sets: DataFrame, percent: int, sketches: int = 3, pivots: int = 3) -> DataFrame:
    """Step 3: a, b, apart, plus, minus: documents a and pivots b < a that link; a's set is b's, without minus and with plus."""
    key_schema = pa.schema([("a", pa.int64()), ("k", pa.int64())])

    def keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, k = [], []
            for i, s in zip(b.column("doc_id").to_pylist(), b.column("hashes"), strict=True):
                h = to_set(s.as_py())
                for j in range(sketches):
                    m = h[0] if not j else mix(h ^ U(j * 0x632BE59BD9B4E019)).min()
                    a.append(i)
                    k.append(int((m ^ U(j)).astype(np.int64)))
            yield batch(key_schema, a=a, k=k)

    each = sets.select("doc_id", "hashes").mapInArrow(keys, "a bigint, k bigint")
    orders = [F.min("a"), *(F.min_by("a", F.xxhash64("a", F.lit(j))) for j in range(1, pivots))]
    chosen = each.groupBy("k").agg(F.array_distinct(F.array(*orders)).alias("pivots"), F.count("a").alias("n")).where("n > 1")
    pairs = each.join(chosen, "k").select("a", F.explode("pivots").alias("b")).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    return differences(near_enough(pairs, sets.withColumn("reach", (100 - percent) * F.col("size")), percent, "a", "b"), sets, percent)


LONG = 2048  # entries of a list that one task compares


def candidates(sets: DataFrame, percent: int, scratch: Scratch, block: int = 256) -> DataFrame:
    """Step 4: pairs a < b of pivots (``star``) of different families that may have members that link.

    ``sets`` has doc_id, family, star, size, parity and hashes. A list of more than LONG entries is cut into lots by
    document, and each two of its lots are a list of their own; side is 0 in a whole list or lot, 1 and 2 where two meet.
    """
    common = common_hashes(sets, percent, scratch)
    sent = sets.sparkSession.sparkContext.broadcast(common)
    entry_schema = pa.schema([("h", pa.int64()), ("size", pa.int32()), ("at", pa.int32()), ("doc_id", pa.int64()), ("star", pa.int64()), ("family", pa.int64()), *((f"p{k}", pa.int64()) for k in range(FOLD))])

    def entries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                b = whole.slice(i, 1000)
                h = [to_set(x.as_py()) for x in b.column("hashes")]
                size = np.array([len(x) for x in h], np.int64)
                many = size - -(-percent * size // 100) + 1
                yield batch(entry_schema, h=np.concatenate([prefix(x, sent.value, percent) for x in h] or [np.empty(0, U)]).astype(np.int64), size=np.repeat(size, many).astype(np.int32), at=np.concatenate([np.arange(k) for k in many] or [[]]).astype(np.int32), **{k: np.repeat(b.column(k).to_numpy(), many) for k in ("doc_id", "star", "family")}, **{f"p{k}": np.repeat(f, many) for k, f in enumerate(folded(b.column("parity")))})

    def pairs(size, at, star, family, side, bits) -> Iterator[np.ndarray]:
        """Pairs of stars from a list that is sorted by size; blocks of it are skipped by size, position and family."""
        cut = list(range(0, len(size), block))
        low_at = [at[i : i + block].min() for i in cut]
        for i in cut:
            x = slice(i, i + block)
            for j, first in zip(cut[: i // block + 1], low_at, strict=False):
                y = slice(j, j + block)
                top = size[y].max()
                if 100 * top < percent * size[x].min():
                    continue  # all of that block are too small for all of this one
                need = least_overlap(int(size[x].min()), int(size[y].min()), percent)
                if 1 + min(size[x].max() - at[x].min(), top - first) - 1 < need:
                    continue  # too few elements follow the positions
                if family[y].min() == family[x].max() and family[y].max() == family[x].min():
                    continue
                need = least_overlap(size[x, None].astype(np.int64), size[None, y], percent)
                ok = (np.minimum(size[x, None] - at[x, None], size[None, y] - at[None, y]) >= need) & (family[x, None] != family[None, y]) & ((side[x, None] + side[None, y]) % 3 == 0)
                if i == j:
                    ok &= np.tri(ok.shape[0], k=-1, dtype=bool)
                p, q = np.nonzero(ok)
                apart = sum(np.bitwise_count(f[i + p] ^ f[j + q]).astype(np.int64) for f in bits)
                near = apart <= size[i + p].astype(np.int64) + size[j + q] - 2 * need[p, q]
                if near.any():
                    a, b = star[i + p[near]], star[j + q[near]]
                    yield np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.Table] = []  # of a list that may go on
        seen: list[np.ndarray] = []
        held = 0

        def out() -> pa.RecordBatch:
            nonlocal seen, held
            p = np.unique(np.concatenate(seen), axis=0)
            seen, held = [], 0
            return pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], ["a", "b"])

        def lists(table: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal held
            h, size, at, star, family, side, *bits = (table.column(c).to_numpy() for c in ("h", "size", "at", "star", "family", "side", *entry_schema.names[6:]))
            head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            end = np.append(head[1:], len(h))
            for i, j in zip(head[end - head > 1], end[end - head > 1], strict=True):
                if j - i > 2 or family[i] != family[i + 1]:
                    for found in pairs(size[i:j], at[i:j], star[i:j], family[i:j], side[i:j], [f[i:j].view(U) for f in bits]):
                        seen.append(found)
                        held += len(found)
                        if held > 500_000:
                            yield out()

        for b in batches:
            if not b.num_rows:
                continue
            h = b.column("h").to_numpy()
            last = int(np.searchsorted(h, h[-1])) if not rest or rest[-1].column("h")[-1].as_py() != h[-1] else 0
            table = pa.Table.from_batches([b])
            if last:
                yield from lists(pa.concat_tables([*rest, table.slice(0, last)]))
                rest = []
            elif rest and rest[-1].column("h")[-1].as_py() != h[0]:
                yield from lists(pa.concat_tables(rest))
                rest = []
            rest.append(table.slice(last))
        if rest:
            yield from lists(pa.concat_tables(rest))
        if held:
            yield out()

    ddl = "h bigint, size int, at int, doc_id bigint, star bigint, family bigint" + "".join(f", p{k} bigint" for k in range(FOLD))
    each = sets.select("doc_id", "star", "family", "parity", "hashes").mapInArrow(entries, ddl)
    counts = in_prefixes(sets, percent, common, True).groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > LONG)
    long_lists = sets.sparkSession.createDataFrame([], "h bigint, lots int")
    held_long = bitmap(counts.select("h"), COMMON_BITS)
    if held_long.any():
        long_lists = counts.select("h", F.ceil(F.col("n") / LONG).cast("int").alias("lots"))
        marks = sets.sparkSession.sparkContext.broadcast(held_long)

        def routed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.append_column("long", pa.array(in_bitmap(b.column("h").to_numpy(), marks.value, COMMON_BITS)))

        each = each.mapInArrow(routed, ddl + ", long boolean")
        short = each.where("not long").drop("long").withColumn("side", F.lit(0))
        cut = each.where("long").drop("long").join(long_lists, "h", "left").withColumn("lots", F.coalesce("lots", F.lit(1))).withColumn("lot", F.pmod(F.xxhash64("doc_id"), F.col("lots")).cast("int"))
        met = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)))
        side = F.when(F.col("lot") == F.col("other"), 0).when(F.col("lot") < F.col("other"), 1).otherwise(2)
        key = F.when(F.col("lots") == 1, F.col("h")).otherwise(F.xxhash64("h", F.least("lot", "other"), F.greatest("lot", "other")))
        each = short.unionByName(met.select(*[key.alias("h") if c == "h" else F.col(c) for c in entry_schema.names], side.alias("side")))
    else:
        each = each.withColumn("side", F.lit(0))
    parts = shuffle_partitions(sets.sparkSession)
    ordered = each.drop("doc_id").repartition(parts, "h").sortWithinPartitions("h", "size", "at")
    return ordered.mapInArrow(run, "a bigint, b bigint").distinct()


def member_links(pairs: DataFrame, members: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Step 6: a, b: the links between the stars in ``pairs`` (p, q, p_only, q_only), whose pivots p and q don't link.

    ``members`` has doc_id, star, size, plus and minus. All sets are seen as differences from p, the pivot of the larger
    star: two sets differ in |A| + |B| - 2 |A and B| elements if these are their differences from p. A set b of the
    other star that doesn't link with p links with a only if the differences share so many elements that they
    meet in prefixes of them, elements that p lacks first: for independent changes these are seldom equal.
    """
    whole, part = 100 + percent, 100 - percent
    far_schema = pa.schema([("p", pa.int64()), ("q", pa.int64()), ("doc_id", pa.int64()), ("plus", pa.binary()), ("minus", pa.binary()), ("u", pa.int64())])

    def from_p(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            rows = []
            for p, q, doc, size, *parts in zip(*(t.column(k) for k in ("p", "q", "doc_id", "size", "p_only", "q_only", "plus", "minus")), strict=True):
                p_only, q_only, plus, minus = (to_set(x.as_py()) for x in parts)
                more = np.union1d(np.setdiff1d(q_only, minus, True), np.setdiff1d(plus, p_only, True))
                less = np.union1d(np.setdiff1d(p_only, plus, True), np.setdiff1d(minus, q_only, True))
                rows.append((p.as_py(), q.as_py(), doc.as_py(), more.tobytes(), less.tobytes(), whole * (len(more) + len(less)) - part * size.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(far_schema)], schema=far_schema)

    entry_schema = pa.schema([("p", pa.int64()), ("h", pa.int64()), ("doc_id", pa.int64())])

    def entries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            p, h, doc = [], [np.empty(0, U)], []
            for star, i, plus, minus, u, other in zip(*(t.column(k) for k in ("p", "doc_id", "plus", "minus", "u", "other")), strict=True):
                d = np.concatenate([to_set(plus.as_py()), to_set(minus.as_py())])
                need = max(1, -(-(u.as_py() + other.as_py()) // (2 * whole)))
                d = d[: max(0, len(d) - need + 1)]
                h.append(d)
                p += [star.as_py()] * len(d)
                doc += [i.as_py()] * len(d)
            yield batch(entry_schema, p=p, h=np.concatenate(h).astype(np.int64), doc_id=doc)

    link_schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            a, b = [], []
            for x, y, u, v, *parts in zip(*(t.column(k) for k in ("a", "b", "u", "v", "pa", "ma", "pb", "mb")), strict=True):
                more_a, less_a, more_b, less_b = (to_set(z.as_py()) for z in parts)
                if u.as_py() + v.as_py() <= 2 * whole * (overlap(more_a, more_b) + overlap(less_a, less_b)):
                    a.append(x.as_py())
                    b.append(y.as_py())
            yield batch(link_schema, a=a, b=b)

    count = members.groupBy("star").agg(F.count("*").alias("n"))
    both = pairs.join(count.toDF("p", "np"), "p").join(count.toDF("q", "nq"), "q").withColumn("keep", F.col("np") >= F.col("nq"))
    turned = both.select(*[F.when(F.col("keep"), F.col(x)).otherwise(F.col(y)).alias(x) for x, y in (("p", "q"), ("q", "p"), ("p_only", "q_only"), ("q_only", "p_only"))])
    own = members.select(F.col("star").alias("q"), "doc_id", "size", "plus", "minus")
    far = scratch.save(turned.join(own, "q").mapInArrow(from_p, "p bigint, q bigint, doc_id bigint, plus binary, minus binary, u bigint").join(members.select(F.col("doc_id").alias("p"), (part * F.col("size")).cast("bigint").alias("up")), "p").withColumn("near", F.col("u") <= F.col("up")), "far")
    direct = far.where("near").select(F.col("p").alias("a"), F.col("doc_id").alias("b"))
    rest = far.join(far.where("near").select("p", "q").distinct(), ["p", "q"], "left_anti").drop("near", "up")
    least_far = rest.groupBy("p").agg(F.min("u").alias("other"))
    close = members.withColumnRenamed("star", "p").join(least_far, "p").withColumn("u", (whole * F.col("apart") - part * F.col("size")).cast("bigint"))
    least_close = close.groupBy("p").agg(F.min("u").alias("other"))
    ddl = "p bigint, h bigint, doc_id bigint"
    first = close.select("p", "doc_id", "plus", "minus", "u", "other").mapInArrow(entries, ddl).withColumnRenamed("doc_id", "a")
    second = rest.select("p", "doc_id", "plus", "minus", "u").dropDuplicates(["p", "doc_id"]).join(least_close, "p").mapInArrow(entries, ddl).withColumnRenamed("doc_id", "b")
    met = first.join(second, ["p", "h"]).select("p", "a", "b").distinct()
    met = met.join(close.select("p", F.col("doc_id").alias("a"), "u", F.col("plus").alias("pa"), F.col("minus").alias("ma")), ["p", "a"])
    met = met.join(rest.select("p", F.col("doc_id").alias("b"), F.col("u").alias("v"), F.col("plus").alias("pb"), F.col("minus").alias("mb")), ["p", "b"])
    out = scratch.save(direct.unionByName(met.select("a", "b", "u", "v", "pa", "ma", "pb", "mb").mapInArrow(verify, "a bigint, b bigint")), "links")
    scratch.drop(far)
    return out


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, settled.

    Documents whose sets of n-word shingles have 100 * intersection >= percent * union link; component_id is the
    smallest doc_id reached by links. A document of fewer than n words has its whole sequence as one shingle;
    one without words, or with a null text, has none and links with nothing. Rows of equal sets share a class,
    whatever their number; repeated rows give a row each. A row with a null doc_id links with nothing and has a
    null component_id. An empty table gives an empty one; other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "setjoin")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = docs.where("doc_id is not null")
    first = scratch.save(zoned(known, n, 2 * shuffle_partitions(spark), ZONE), "zones")
    rows = first.where("bucket is null").select("doc_id", "size", "in_zone", "shared", "f1", "f2")
    elsewhere = found_shared(first.where("bucket is not null"))
    joined = rows.join(elsewhere, "doc_id", "left").withColumn("alone", F.col("in_zone") - F.col("shared") - F.coalesce("n", F.lit(0)))
    state = scratch.save(joined.select("doc_id", "size", "f1", "f2", F.expr(f"size = 0 or 100 * (size - alone) < {percent} * size").alias("settled")), "state")
    scratch.drop(first)
    open_rows = state.where("not settled")
    classes = scratch.save(open_rows.groupBy("size", "f1", "f2").agg(F.min("doc_id").alias("class")), "classes")

    set_schema = pa.schema([("doc_id", pa.int64()), ("size", pa.int32()), ("f1", pa.int64()), ("f2", pa.int64()), ("parity", pa.binary()), ("hashes", pa.binary())])

    sent = spark.sparkContext.broadcast(bitmap(classes.select(F.xxhash64("class")), CLASS_BITS))

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_blocks(batches):
            b = b.filter(pa.array(in_bitmap(b.column("key").to_numpy(), sent.value, CLASS_BITS))).drop_columns(["key"])
            if not b.num_rows:
                continue
            sets = sets_of(as_bytes(b.column("text")), n)
            prints = [fingerprint(s) for s in sets]
            yield batch(set_schema, doc_id=b.column("doc_id"), size=np.array([len(s) for s in sets], np.int32), f1=[p[0] for p in prints], f2=[p[1] for p in prints], parity=[parity(s) for s in sets], hashes=[s.tobytes() for s in sets])

    # the bitmap keeps the texts of all classes and a few others; the join then drops these
    made = known.withColumn("key", F.xxhash64("doc_id")).mapInArrow(make, "doc_id bigint, size int, f1 bigint, f2 bigint, parity binary, hashes binary")
    made = made.where("size > 0").join(classes.select(F.col("class").alias("doc_id"), "size", "f1", "f2"), ["doc_id", "size", "f1", "f2"], "left_semi")
    sets = scratch.save(made.groupBy("doc_id", "size", "f1", "f2").agg(F.first("parity").alias("parity"), F.first("hashes").alias("hashes")).drop("f1", "f2"), "sets")
    linked = scratch.save(families(sets, percent), "families")
    near = components(linked.select("a", "b"), scratch).toDF("doc_id", "family")
    nothing, none = F.lit(b""), F.lit(0).cast("bigint")
    chosen = linked.groupBy("a").agg(F.min(F.struct("b", "apart", "plus", "minus")).alias("m")).withColumnRenamed("a", "doc_id")
    members = sets.select("doc_id", "size").join(chosen, "doc_id", "left")
    members = scratch.save(members.select("doc_id", "size", F.coalesce("m.b", "doc_id").alias("star"), F.coalesce("m.apart", none).alias("apart"), F.coalesce("m.plus", nothing).alias("plus"), F.coalesce("m.minus", nothing).alias("minus")), "members")
    grouped = scratch.save(sets.join(members.select("doc_id", "star"), "doc_id").join(near, "doc_id", "left").withColumn("family", F.coalesce("family", "doc_id")), "grouped")
    scratch.drop(sets)  # grouped has the same rows
    reach = members.groupBy("star").agg(F.max((100 - percent) * F.col("size") + (100 + percent) * F.col("apart")).alias("reach")).withColumnRenamed("star", "doc_id")
    facts = scratch.save(grouped.select("doc_id", "size", "parity").join(reach, "doc_id"), "facts")
    met = scratch.save(differences(near_enough(candidates(grouped, percent, scratch), facts, percent, "a", "b"), grouped, percent).join(facts.select(F.col("doc_id").alias("a"), F.col("size").alias("na")), "a").join(facts.select(F.col("doc_id").alias("b"), F.col("size").alias("nb")), "b").select("a", "b", "plus", "minus", ((100 + percent) * F.col("apart") <= (100 - percent) * (F.col("na") + F.col("nb"))).alias("links")), "met")
    links = linked.select("a", "b").unionByName(met.where("links").select("a", "b"))
    so_far = components(links, scratch)
    part = lambda c: so_far.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in"))
    undecided = met.where("not links").join(part("a"), "a", "left").join(part("b"), "b", "left").where("coalesce(a_in, a) <> coalesce(b_in, b)").select(F.col("a").alias("p"), F.col("b").alias("q"), F.col("plus").alias("p_only"), F.col("minus").alias("q_only"))
    more = member_links(undecided, members, scratch, percent)
    final = components(links.unionByName(more), scratch).toDF("class", "component")
    scratch.drop(grouped, members, facts, linked, met, more)
    classes = classes.join(final, "class", "left").select("size", "f1", "f2", F.coalesce("component", "class").alias("component"))
    done = open_rows.join(classes, ["size", "f1", "f2"]).select("doc_id", "size", "component", "settled")
    out = state.where("settled").select("doc_id", "size", F.col("doc_id").alias("component"), "settled").unionByName(done)

    count_schema = pa.schema([("size", pa.int32())])

    def sizes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_blocks(batches):
            yield batch(count_schema, size=np.array([len(s) for s in sets_of(as_bytes(b.column("text")), n)], np.int32))

    nameless = docs.where("doc_id is null").select("text").mapInArrow(sizes, "size int").selectExpr("cast(null as bigint) doc_id", "size", "cast(null as bigint) component", "true settled")
    return out.unionByName(nameless).select("doc_id", F.col("size").cast("bigint").alias("n_shingles"), F.col("component").alias("component_id"), "settled")
