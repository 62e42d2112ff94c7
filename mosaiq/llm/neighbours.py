"""Near-duplicate vectors by NN-descent.

Equal vectors of a label are one node. A first neighbour graph comes from blocks: vectors on the same side of random
hyperplanes, in lots of bounded size, each node with its nearest ones. The graph is then refined: neighbours of one
node are compared with each other and enter the lists of both ends where they are nearer than what these hold. A list
that is full of links is saturated and is enlarged. Links (pairs at or above the threshold) that a block or a list
shows are kept as stars, so a group of near copies costs a row a node and none is lost when lists are cut.

When the lists have settled, the links of a sample are searched among all rows. If too few of them lie in
one component, new blocks are added and the walk goes on; if that isn't enough either, the labels are compared whole.
At the end, the nodes of a component are compared in lots, in double precision, which counts the links of each
vector exactly, without a list of pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, batch, shuffle_partitions
from .graph import components

FOUND = "a bigint, b bigint, cos double, link boolean"
FOUND_SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("cos", pa.float64()), ("link", pa.bool_())])


def unit_rows(column: pa.Array) -> np.ndarray:
    """Vectors of equal length, as rows of length one."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def stars(p: np.ndarray, q: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest one it reaches by the links p, q."""
    low = np.arange(n)
    while True:
        u, v = low[p], low[q]
        open_ = u != v
        if not open_.any():
            return low
        p, q, u, v = p[open_], q[open_], u[open_], v[open_]
        np.minimum.at(low, np.maximum(u, v), np.minimum(u, v))
        while (low[low] != low).any():
            low = low[low]


def compared(x: np.ndarray, y: np.ndarray | None, ids: np.ndarray, copies: np.ndarray, threshold: float, step: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Links between x and y, or inside x: for each row (of x, then of y) the linked vectors and the smallest row it reaches.

    ``ids`` and ``copies`` are of the rows of x, then of y, in rising order of ids in each.
    """
    n, z = len(x), x if y is None else y
    at = 0 if y is None else n
    counts, low = np.zeros(len(ids), np.int64), np.arange(len(ids))
    for i in range(0, n, step):
        c = x[i : i + step] @ z.T
        if y is None:
            c[np.arange(len(c)), np.arange(i, i + len(c))] = -2
        p, q = np.nonzero(c >= threshold)
        if not len(p):
            continue
        p, q = p + i, q + at
        counts += np.bincount(p, copies[q], len(ids)).astype(np.int64)
        if y is not None:
            counts += np.bincount(q, copies[p], len(ids)).astype(np.int64)
        low = stars(np.concatenate([p, np.arange(len(ids))]), np.concatenate([q, low]), len(ids))
    return counts, low


def lots_met(nodes: DataFrame, sizes: DataFrame, lot: int, threshold: float) -> DataFrame:
    """node, links, other: what each pair of lots of a group finds of its nodes; other is a node that it reaches."""
    found = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])
    many = F.greatest(F.lit(1), F.ceil(F.col("n") / lot)).cast("int")
    cut = nodes.join(sizes, "grp").withColumn("lots", many).withColumn("lot", F.pmod(F.xxhash64("node"), F.col("lots")).cast("int"))
    others = F.sequence(F.lit(0), F.col("lots") - 1)
    sent = cut.withColumn("other", F.explode(others)).select("node", "copies", "v", F.size("v").alias("w"), "grp", F.least("lot", "other").alias("i"), F.greatest("lot", "other").alias("j"), (F.col("lot") > F.col("other")).alias("second"))

    def meet(table: pa.Table) -> pa.Table:
        out = []
        width = table.column("w").to_numpy()
        for w in np.unique(width):  # a group's hash may be of vectors of two lengths
            own = table.filter(pa.array(width == w))
            second, ids, copies = (own.column(k).to_numpy() for k in ("second", "node", "copies"))
            x = unit_rows(own.column("v").combine_chunks())
            o = np.lexsort((ids, second))
            second, ids, copies, x = second[o], ids[o], copies[o], x[o]
            n = int((~second).sum())
            alone = own.column("i")[0] == own.column("j")[0]
            if not alone and n in (0, len(ids)):
                continue
            counts, low = compared(x[:n], None if alone else x[n:], ids, copies, threshold)
            hit = np.flatnonzero(counts)
            out.append(pa.table({"node": ids[hit], "links": counts[hit], "other": ids[low[hit]]}, schema=found))
        return pa.concat_tables(out) if out else found.empty_table()

    return sent.groupBy("grp", "i", "j").applyInArrow(meet, "node bigint, links bigint, other bigint")


def blocked(nodes: DataFrame, sizes: DataFrame, dims: int, turn: int, lot: int) -> DataFrame:
    """node, block, v: blocks hold about ``lot`` nodes of one group and one side of this turn's hyperplanes."""
    planes = np.random.default_rng(600 + turn).normal(size=(dims, 40))
    kind = nodes.schema["v"].dataType
    inner = pa.float32() if kind.elementType.simpleString() == "float" else pa.float64()
    schema = pa.schema([("node", pa.int64()), ("grp", pa.int64()), ("code", pa.int64()), ("v", pa.list_(inner))])

    def codes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = 1 << np.arange(40, dtype=np.int64)
        for b in batches:
            if b.num_rows:
                bits = np.maximum(0, np.ceil(np.log2(b.column("n").to_numpy() / lot))).astype(np.int64)
                code = ((unit_rows(b.column("v")) @ planes > 0) * weight).sum(1) & ((1 << bits) - 1)
                yield batch(schema, node=b.column("node"), grp=b.column("grp"), code=code, v=b.column("v"))

    coded = nodes.join(sizes, "grp").select("node", "grp", "n", "v").mapInArrow(codes, f"node bigint, grp bigint, code bigint, v {kind.simpleString()}")
    many = coded.groupBy("grp", "code").agg(F.count("*").alias("m"))
    part = F.pmod(F.xxhash64("node", F.lit(turn)), F.greatest(F.lit(1), F.ceil(F.col("m") / (2 * lot))))
    return coded.join(many, ["grp", "code"]).select("node", F.xxhash64("grp", "code", part).alias("block"), "v")


def nearest_in_blocks(blocks: DataFrame, keep: int, threshold: float) -> DataFrame:
    """Of each block: for every node its ``keep`` nearest, and the links as stars."""

    def inside(table: pa.Table) -> pa.Table:
        ids, x = table.column("node").to_numpy(), unit_rows(table.column("v").combine_chunks())
        a, b, cos, low = [], [], [], np.arange(len(ids))
        many = min(keep, len(ids) - 1)
        for i in range(0, len(x) if many else 0, 512):
            c = x[i : i + 512] @ x.T
            rows = np.arange(len(c))
            c[rows, i + rows] = -2
            near = np.argpartition(-c, many - 1, axis=1)[:, :many]
            a.append(np.repeat(ids[i : i + len(c)], many))
            b.append(ids[near].ravel())
            cos.append(np.take_along_axis(c, near, 1).ravel())
            p, q = np.nonzero(c >= threshold)
            if len(p):
                low = stars(np.concatenate([p + i, np.arange(len(ids))]), np.concatenate([q, low]), len(ids))
        tied = np.flatnonzero(low != np.arange(len(ids)))
        one, other, value = (np.concatenate(z) if z else np.empty(0) for z in (a, b, cos))
        return pa.table({"a": np.concatenate([one, ids[tied]]).astype(np.int64), "b": np.concatenate([other, ids[low[tied]]]).astype(np.int64), "cos": np.concatenate([value, np.ones(len(tied))]), "link": np.repeat([False, True], [len(one), len(tied)])}, schema=FOUND_SCHEMA)

    return blocks.groupBy("block").applyInArrow(inside, FOUND)


def neighbour_lists(edges: DataFrame, keep: int, threshold: float) -> DataFrame:
    """u, v, cos, far: of both ends' lists the nearest ``keep``, four times as many if these are all links; far is the last one's cos, -2 if places are left."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"), "cos").unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"), "cos"))
    near = both.groupBy("u", "v").agg(F.max("cos").alias("cos"))
    parts = shuffle_partitions(edges.sparkSession)
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("cos", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen, links = None, 0, 0
        for t in batches:
            if not t.num_rows:
                continue
            u, c = t.column("u").to_numpy(), t.column("cos").to_numpy()
            head = np.concatenate([[True], u[1:] != u[:-1]])
            run_ = np.cumsum(head) - 1
            start = np.flatnonzero(head)
            place = np.arange(len(u)) - start[run_]
            total = np.cumsum(c >= threshold)
            before = np.where(start > 0, total[start - 1], 0)[run_]
            linked = total - before
            if u[0] == last:  # the list goes on from the batch before
                place[run_ == 0] += seen
                linked[run_ == 0] += links
            last, seen, links = u[-1], int(place[-1]) + 1, int(linked[-1])
            ok = (place < keep) | (place < 4 * keep) & (linked > place)
            yield batch(schema, u=u[ok], v=t.column("v").to_numpy()[ok], cos=c[ok])

    cut = near.repartition(parts, "u").sortWithinPartitions("u", F.desc("cos"), "v").mapInArrow(run, "u bigint, v bigint, cos double")
    last = cut.groupBy("u").agg(F.when(F.count("*") >= keep, F.min("cos")).otherwise(F.lit(-2.0)).alias("far"))
    return cut.join(last, "u")


def walked(lists: DataFrame, nodes: DataFrame, threshold: float, split: int = 256) -> DataFrame:
    """Neighbours of neighbours: pairs that are nearer than what a list of theirs holds, and links as stars.

    At each node u its list meets itself and the nodes that have u in theirs. Of these a hub has many; they are dealt
    to tasks, ``split`` to each, and u's list goes to all of them.
    """
    fars = lists.select(F.col("u").alias("v"), "far").dropDuplicates(["v"])
    parts = lists.groupBy("v").agg(F.ceil(F.count("*") / split).cast("int").alias("parts")).withColumnRenamed("v", "u")
    back = lists.select(F.col("v").alias("u"), F.col("u").alias("v")).join(parts, "u").select("u", F.pmod(F.xxhash64("v"), "parts").cast("int").alias("part"), "v", F.lit(1).alias("side"))
    own = lists.select("u", "v").join(parts, "u", "left").select("u", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), "v", F.lit(0).alias("side"))
    rows = own.unionByName(back).groupBy("u", "part", "v").agg(F.min("side").alias("side")).withColumn("u", F.xxhash64("u", "part"))
    rows = rows.join(fars, "v").join(nodes.select(F.col("node").alias("v"), F.col("v").alias("x")), "v")
    rows = rows.select("u", "v", "side", "far", "x").repartition(shuffle_partitions(lists.sparkSession), "u").sortWithinPartitions("u", "side", "v")

    def one(v, near, far, x, out) -> None:
        """The first ``near`` of these nodes are the list."""
        c = x[:near] @ x.T
        new = np.arange(near)[:, None] < np.arange(len(v))[None]
        p, q = np.nonzero((c > np.minimum(far[:near, None], far[None])) & new)
        out.append((v[p], v[q], c[p, q], np.zeros(len(p), bool)))
        p, q = np.nonzero((c >= threshold) & new)
        if len(p):
            low = stars(p, q, len(v))
            tied = np.flatnonzero(low != np.arange(len(v)))
            out.append((v[tied], v[low[tied]], np.ones(len(tied)), np.ones(len(tied), bool)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def done(table: pa.Table) -> pa.RecordBatch:
            u, v, far, x = table.column("u").to_numpy(), table.column("v").to_numpy(), table.column("far").to_numpy(), unit_rows(table.column("x").combine_chunks())
            side = table.column("side").to_numpy()
            edge = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1], [True]]))
            out: list = []
            for i, j in zip(edge[:-1], edge[1:], strict=True):
                one(v[i:j], int((side[i:j] == 0).sum()), far[i:j], x[i:j], out)
            a, b, cos, link = (np.concatenate([o[k] for o in out]) for k in range(4))
            low, high = np.minimum(a, b), np.maximum(a, b)
            _, first = np.unique(np.rec.fromarrays([low, high, link]), return_index=True)
            return batch(FOUND_SCHEMA, a=low[first], b=high[first], cos=cos[first], link=link[first])

        for t in batches:
            if not t.num_rows:
                continue
            table = pa.Table.from_batches([t]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([t])])
            cut = int(np.searchsorted(table.column("u").to_numpy(), table.column("u")[-1].as_py()))
            if cut:
                yield done(table.slice(0, cut))
            rest = table.slice(cut)
        if rest is not None:
            yield done(rest)

    return rows.mapInArrow(run, FOUND)


def audit(nodes: DataFrame, sizes: DataFrame, comp: DataFrame, threshold: float, sample: int, wanted: int = 100) -> tuple[int, int]:
    """How many links a sample of nodes has, by comparison with all nodes of their groups, and how many lie inside a component.

    The sample (by a hash of the node) has about ``sample`` nodes, and grows, eight-fold and twice at most, until
    it shows ``wanted`` links. Vectors of all lengths take part.
    """
    count = sizes.agg(F.sum("n")).first()[0]
    for _ in range(3):
        share = int(2**30 * min(1.0, sample / max(1, count)))
        picked = nodes.where(F.pmod(F.xxhash64("node", F.lit(17)), F.lit(2**30)) < share).select("node", "grp", "v").collect()  # about ``sample`` rows
        by_group: dict[int, tuple] = {}
        for g in {r.grp for r in picked}:  # a group's vectors are of one length, but for equal hashes
            own = [r for r in picked if r.grp == g]
            width = max(len(r.v) for r in own)
            own = [r for r in own if len(r.v) == width]
            by_group[g] = np.array([r.node for r in own]), unit_rows(pa.array([r.v for r in own], pa.list_(pa.float64()))), width
        sent = nodes.sparkSession.sparkContext.broadcast(by_group)

        def run(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                g, node, w = b.column("grp").to_numpy(), b.column("node").to_numpy(), b.column("w").to_numpy()
                for k in np.unique(g):
                    if k in sent.value:
                        ids, x, width = sent.value[k]
                        at = np.flatnonzero((g == k) & (w == width))
                        if len(at):
                            p, q = np.nonzero(x @ unit_rows(b.column("v").take(pa.array(at))).T >= threshold)
                            own = ids[p] != node[at[q]]
                            yield pa.RecordBatch.from_pydict({"a": ids[p[own]], "b": node[at[q[own]]]})

        truth = nodes.select("node", "grp", F.size("v").alias("w"), "v").mapInArrow(run, "a bigint, b bigint")
        got = truth.join(comp.toDF("a", "ca"), "a", "left").join(comp.toDF("b", "cb"), "b", "left").agg(F.count("*").alias("n"), F.count(F.when(F.col("ca") == F.col("cb"), 1)).alias("k")).first()
        if got.n >= wanted or share >= 2**30:
            break
        sample *= 8
    return got.n, got.k


def near_vectors(table: DataFrame, threshold: float = 0.98, keep: int = 8, lot: int = 1000, turns: int = 3, rounds: int = 4, recall: float = 0.999, most_turns: int = 5, sample: int = 512) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept, from (vec_id, embedding, label).

    Vectors link if labels are equal and not null and their cosine is at least ``threshold`` (a cosine equal to it
    links). Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label, link
    with nothing; vectors of unequal lengths don't either. Rows with a null vec_id link with nothing and have a null
    component_id. Of repeated rows each is a vector of its own and counts as a link of the others; other columns are
    ignored. The audit finds at least ``recall`` of a sample's links, or the labels are compared whole.
    """
    spark = table.sparkSession
    scratch = Scratch(spark, "neighbours")
    rows = table.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").alias("v"), F.col("label").alias("label"))
    if rows.schema["v"].dataType.simpleString() not in ("array<float>", "array<double>"):
        rows = rows.withColumn("v", F.col("v").cast("array<double>"))
    sound = F.expr("vec_id is not null and label is not null and v is not null and size(v) > 0 and exists(v, x -> x <> 0) and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    marked = scratch.save(rows.withColumn("sound", F.coalesce(sound, F.lit(False))), "rows")
    valid = marked.where("sound").select("vec_id", F.xxhash64("label", F.size("v")).alias("grp"), "v")
    members = valid.withColumn("key", F.xxhash64("v")).withColumn("key2", F.hash("v"))
    nodes = scratch.save(members.groupBy("grp", "key", "key2").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("v").alias("v")), "nodes")
    sizes = nodes.groupBy("grp").agg(F.count("*").alias("n"))
    lengths = [r.s for r in nodes.select(F.size("v").alias("s")).distinct().collect()]
    if not lengths:
        return marked.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    edges = links = None
    grouped, turn = None, 0

    def taken(found: DataFrame, edges: DataFrame | None, links: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """Old and new lists, cut; and the links as stars of all so far."""
        found = scratch.save(found, "found")
        pairs = found.where("not link").select("a", "b", "cos")
        tied = found.where("link").select("a", "b")
        lists = scratch.save(neighbour_lists(pairs if edges is None else pairs.unionByName(edges.select(F.col("u").alias("a"), F.col("v").alias("b"), "cos")), keep, threshold), "lists")
        joined = components(tied if links is None else tied.unionByName(links.select(F.col("node").alias("a"), F.col("component").alias("b"))), scratch)
        scratch.drop(found)
        return lists, joined

    while grouped is None:
        blocks = [nearest_in_blocks(blocked(nodes.where(F.size("v") == dims), sizes, dims, t, lot), keep, threshold) for t in range(turn, turn + (1 if turn else turns)) for dims in lengths]
        turn += 1 if turn else turns
        found = blocks[0]
        for more in blocks[1:]:
            found = found.unionByName(more)
        edges, links = taken(found, edges, links)
        size = total = edges.agg(F.sum("cos"), F.count("*")).first()
        for _ in range(rounds):
            edges, links = taken(walked(edges, nodes, threshold), edges, links)
            size, total = edges.agg(F.sum("cos"), F.count("*")).first(), size
            if abs(size[0] - total[0]) <= 0.002 * total[1]:
                break
        true, held = audit(nodes, sizes, links, threshold, sample)
        if held >= recall * true:
            grouped = nodes.join(links, "node").select("node", "copies", "v", F.xxhash64("grp", "component").alias("grp"))
        elif turn >= most_turns:
            grouped = nodes.select("node", "copies", "v", "grp")
    grouped = scratch.save(grouped, "grouped")
    met = scratch.save(lots_met(grouped, grouped.groupBy("grp").agg(F.count("*").alias("n")), lot, threshold), "met")
    comp = components(met, scratch, "node", "other")
    degree = met.groupBy("node").agg(F.sum("links").alias("outside"))
    facts = nodes.select("node", "grp", "key", "key2", "copies").join(degree, "node", "left").join(comp, "node", "left")
    facts = facts.select("grp", "key", "key2", (F.col("copies") - 1 + F.coalesce("outside", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    linked = members.select("vec_id", "grp", "key", "key2").join(facts, ["grp", "key", "key2"]).select("vec_id", "n_links", "component_id")
    alone = marked.where("not sound").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
