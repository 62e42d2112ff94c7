"""Substring dedup: near-duplicate passages of documents, found through compact windows of min-hashes.

Every text is a sequence of 5-word shingles. For each of a few hash functions, the nodes of the Cartesian tree over
its hashes whose subtrees span at least ``t`` shingles are compact windows: all subsequences inside such a window
that hold its node have that node's hash as their min-hash. Windows of equal min-hash are joined in two passes.

First, windows that agree on all a passage around the node can hold are one class: its later documents are joined with
its first one. The classes' first documents are joined with the first and the one before of the same min-hash, and of
those that also agree on the shingles around the node, in one of the ``contexts``. Two windows match if the
subsequences they share, around the node, span t shingles; pairs of places where enough functions match, or one
class, are then verified on the shingles themselves.

Then, min-hashes of which some pairs of classes were left out are looked at again (``further_pairs``): a window around which
something isn't covered by the passages found so far asks the earlier ones that may share a passage with it, until nothing
more can be added. At most so many shingles of a passage are missing from the other, so one of any few more must be there:
these are looked up. Of what they answer, as few are kept as cover all of it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, batch, parted, shuffle_partitions, text_blocks
from .words import U, as_bytes, mix, powers, ranges, segment, shingles

SALT = np.random.default_rng(303).integers(0, 2**64, 64, U)


def compact_windows(g: np.ndarray, first: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, c, l, r) of the compact windows of at least t hashes, places counted from each text's start.

    ``first`` has the texts' ranges in g. l and r are the ends of node c's subtree: the widest range around c
    without a smaller hash; of equal hashes the left one is the upper node.
    """
    count = np.diff(first)
    text = np.repeat(np.arange(len(count)), count)
    begin, end = first[:-1][text] if len(text) else text, first[1:][text] if len(text) else text
    levels = [g]
    while 2 << (len(levels) - 1) <= max(int(count.max(initial=0)), t):
        m, s = levels[-1], 1 << (len(levels) - 1)
        levels.append(np.minimum(m[:-s], m[s:]) if len(m) > s else m[:0])
    k = t.bit_length() - 1
    if len(levels) <= k or len(g) < t:
        return (np.empty(0, np.int64),) * 4
    low = levels[k]
    low = np.minimum(low[: len(g) - t + 1], low[t - (1 << k) :][: len(g) - t + 1])
    start = np.flatnonzero(np.arange(len(low)) + t <= end[: len(low)])
    if not len(start):
        return (np.empty(0, np.int64),) * 4
    new = np.concatenate([[True], (np.diff(start) != 1) | (low[start[1:]] != low[start[:-1]]) | (text[start[1:]] != text[start[:-1]]) | (g[start[1:] - 1] == low[start[1:]])])  # the last: an equal hash has left
    at = start[new]
    c = np.concatenate([x + np.lib.stride_tricks.sliding_window_view(g, t)[x].argmin(1) for x in np.array_split(at, -(-len(at) // 4096))])
    c = np.unique(c)
    left, right = c.copy(), c.copy()
    for k in range(len(levels) - 1, -1, -1):
        m, s = levels[k], 1 << k
        to = left - s
        ok = to >= begin[c]
        ok[ok] = m[to[ok]] > g[c[ok]]
        left[ok] -= s
        ok = right + s < end[c]
        ok[ok] = m[right[ok] + 1] >= g[c[ok]]
        right[ok] += s
    return text[c], c - begin[c], left - begin[c], right - begin[c]


def contexts(t: int, parts: int = 4) -> list[tuple[int, int]]:
    """How many shingles to the left and right of the node a context has.

    A range of t shingles around a node holds one of them at least, wherever the node is in it.
    """
    step = -(-t // parts)
    return [(min(i, t - step), max(0, t - step - i)) for i in range(0, t, step)]


def context_hashes(g: np.ndarray, at: np.ndarray, c: np.ndarray, left: np.ndarray, right: np.ndarray, t: int) -> np.ndarray:
    """For nodes at these places of g, a column of 32 bits for each context; 0 where it isn't inside the window."""
    around = contexts(t)
    out = np.zeros((len(at), len(around)), np.int32)
    if not len(at):
        return out
    up, down = powers(len(g))
    total = np.zeros(len(g) + 1, U)
    np.cumsum(g * up[: len(g)], out=total[1:])
    for k, (i, j) in enumerate(around):
        ok = np.flatnonzero((c - left >= i) & (right - c >= j))
        lo = at[ok] - i
        out[ok, k] = (((mix((total[at[ok] + j + 1] - total[lo]) * down[lo]) >> U(32)) | U(1)).astype(np.uint32)).view(np.int32)
    return out


def reach(c: np.ndarray, left: np.ndarray, right: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """The part of the windows that is at most w shingles away from the node."""
    return np.maximum(left, c - w), np.minimum(right, c + w)


def class_hashes(g: np.ndarray, at: np.ndarray, c: np.ndarray, left: np.ndarray, right: np.ndarray, w: int) -> np.ndarray:
    """For nodes at these places of g, 32 bits of the shingles in ``reach`` and of where it ends."""
    if not len(at):
        return np.zeros(0, np.int32)
    up, down = powers(len(g))
    total = np.zeros(len(g) + 1, U)
    np.cumsum(g * up[: len(g)], out=total[1:])
    lo, hi = reach(c, left, right, w)
    x = (total[at + (hi - c) + 1] - total[at - (c - lo)]) * down[at - (c - lo)]
    return (mix(x + (c - lo).astype(U) * U(0xD6E8FEB86659FD93) + (hi - c).astype(U)) >> U(32)).astype(np.uint32).view(np.int32)


def by_class(key, doc, at) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(later, first, kept): rows of a class (equal key, contexts and class hash) in other documents with the class's first row; the rows of the classes' first documents.

    Rows must be sorted by key, document and place.
    """
    o = np.lexsort((np.arange(len(key)), at[:, -1], key))
    same = (key[o[1:]] == key[o[:-1]]) & (at[o[1:], 3:] == at[o[:-1], 3:]).all(1)
    head = np.concatenate([[True], ~same])
    run = np.flatnonzero(head)[np.cumsum(head) - 1]
    other = doc[o] != doc[o[run]]
    return o[other], o[run[other]], np.sort(o[~other])


def shared(at, a, b, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows whose shared window spans t, and how far it goes to the left and right of the node."""
    c, left, right = at[:, 0], at[:, 1], at[:, 2]
    wl, wr = np.minimum(c[a] - left[a], c[b] - left[b]), np.minimum(right[a] - c[a], right[b] - c[b])
    wide = wl + wr + 1 >= t
    return a[wide], b[wide], wl[wide], wr[wide]


def star(key, doc, at, t: int):
    """Pairs of rows (later, earlier) with equal key and different documents: with the first of the run and the one before.

    The same for runs of equal key and equal context, for each context. Rows must be sorted by key, document and place;
    ``at`` has node, left, right, the contexts and the class. Pairs whose shared window is under t are left out. Also:
    how far the shared window goes to the left and right of the node, and the rows of runs with pairs that are not tried.
    """
    head = np.concatenate([[True], key[1:] != key[:-1]])
    later, earlier = _run_pairs(head, doc)
    edge = np.flatnonzero(head)
    size = np.diff(np.append(edge, len(key)))
    new = np.concatenate([[True], doc[1:] != doc[:-1]]) | head
    docs = np.add.reduceat(new, edge)
    # whole: a run of one document, two with one row in the first, three with one row in each of the first two
    second, third = (np.where(size > k, new[np.minimum(edge + k, len(key) - 1)], True) for k in (1, 2))
    left_out = np.flatnonzero(np.repeat((docs > 1) & ~((docs == 2) & second) & ~((docs == 3) & second & third), size))
    many = np.flatnonzero(np.repeat(size, size) > 1)
    for k in range(3, at.shape[1] - 1):
        rows = many[at[many, k] != 0]
        rows = rows[np.lexsort((rows, at[rows, k], key[rows]))]
        if not len(rows):
            continue
        head = np.concatenate([[True], (key[rows[1:]] != key[rows[:-1]]) | (at[rows[1:], k] != at[rows[:-1], k])])
        p, q = _run_pairs(head, doc[rows])
        later, earlier = np.concatenate([later, rows[p]]), np.concatenate([earlier, rows[q]])
    pair = np.unique(later * len(key) + earlier)
    return *shared(at, pair // len(key), pair % len(key), t), left_out


def _run_pairs(head: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row with the first of its run, and with the last row of the document before, if these are other documents."""
    run = np.flatnonzero(head)[np.cumsum(head) - 1]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | head[1:]])
    before = np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0)) - 1  # the last row of the document before
    rows = np.flatnonzero(doc != doc[run])
    more = rows[doc[before[rows]] != doc[run[rows]]]
    return np.concatenate([rows, more]), np.concatenate([run[rows], before[more]])


def packed(x: np.ndarray) -> bytes:
    """The rows' first bytes, then their second ones, and so on: high bytes are mostly zero and compress well."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()


def unpacked(data: bytes, kind, many: int) -> np.ndarray:
    """Rows of many numbers of this kind, from ``packed``."""
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(many * np.dtype(kind).itemsize, -1).T).view(kind)


BLOB = pa.schema([("bucket", pa.int32()), ("fn", pa.int32()), ("key", pa.binary()), ("doc", pa.binary()), ("at", pa.binary())])


SURE = 32  # added to a function's number where a pair needs no second function


def joined_windows(docs: DataFrame, n: int, t: int, widest: int, functions: int, buckets: int, scratch: Scratch) -> DataFrame:
    """Pairs a > b of documents and matching places in them: a, b, fn, ca, cb, wl, wr; and, with b null, the windows (key, fn, a, ca, wl, wr) of runs with pairs that are not tried."""
    def blobs(fn: int, bucket: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        """A row for each bucket that occurs, with its part of the columns."""
        o = np.argsort(bucket, kind="stable")
        edge = np.searchsorted(bucket[o], np.arange(buckets + 1))
        full = np.flatnonzero(np.diff(edge))
        rows = {"bucket": full.astype(np.int32), "fn": np.full(len(full), fn, np.int32)} | {k: [packed(x[o[edge[i] : edge[i + 1]]]) for i in full] for k, x in zip(("key", "doc", "at"), columns, strict=True)}
        for i in range(0, len(full), 64):
            yield batch(BLOB, **{k: v[i : i + 64] for k, v in rows.items()})

    def flush(lots) -> Iterator[pa.RecordBatch]:
        for fn, parts in enumerate(lots):
            key, doc, at = (np.concatenate([p[k] for p in parts]) for k in range(3))
            if not len(key):
                continue
            o = np.lexsort((at[:, 0], doc, key))
            key, doc, at = key[o], doc[o], at[o]
            a, b, head = by_class(key, doc, at)
            a, b, wl, wr = shared(at, a, b, t)
            # pairs made here only pass through a bucket, any one: 4096 go to the same, those of a task to one after the other
            yield from blobs(fn + SURE, (np.arange(len(a)) // 4096 + int(key[0] % U(buckets))) % buckets, doc[a], doc[b], np.column_stack([at[a, 0], at[b, 0], wl, wr]).astype(np.int32))
            key, doc, at = key[head], doc[head], at[head]
            yield from blobs(fn, ((key >> U(8)) % U(buckets)).astype(np.int64), key, doc, at)

    def windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lots, held = [[] for _ in range(functions)], 0
        for b in text_blocks(batches, most=1 << 19):
            ids = b.column("doc_id").to_numpy()
            h, first = shingles(segment(as_bytes(b.column("text"))), n)
            for fn in range(functions):
                g = mix(h ^ SALT[fn])
                text, c, left, right = compact_windows(g, first, t)
                node = first[:-1][text] + c if len(c) else c
                lots[fn].append((g[node], ids[text], np.column_stack([c, left, right, context_hashes(g, node, c, left, right, t), class_hashes(g, node, c, left, right, widest)]).astype(np.int32)))
            held += len(h)
            if held > 2_000_000:
                yield from flush(lots)
                lots, held = [[] for _ in range(functions)], 0
                pa.default_memory_pool().release_unused()
        if held:
            yield from flush(lots)

    def rows_of(table: pa.Table, kind, wide: int) -> tuple[np.ndarray, ...]:
        """fn, key (of this kind), doc and at (so many columns) of blobs."""
        fn = np.repeat(table.column("fn").to_numpy(), [len(x.as_py()) // 8 for x in table.column("key")])
        key, doc, at = (np.concatenate([np.empty((0, many), k), *(unpacked(x, k, many) for x in table.column(name).to_pylist())]) for name, k, many in (("key", kind, 1), ("doc", np.int64, 1), ("at", np.int32, wide)))
        return fn, key[:, 0], doc[:, 0], at

    def meet(table: pa.Table) -> pa.Table:
        made = pa.array(table.column("fn").to_numpy() >= SURE)
        fn, a, b, at = rows_of(table.filter(made), np.int64, 4)
        passed = pa.table({"a": a, "b": b, "fn": fn, "ca": at[:, 0], "cb": at[:, 1], "wl": at[:, 2], "wr": at[:, 3], "key": pa.nulls(len(a), pa.int64())})
        fn, key, doc, at = rows_of(table.filter(pc.invert(made)), U, 4 + len(contexts(t)))
        if not len(key):
            return passed
        o = np.lexsort((at[:, 0], doc, key))
        key, doc, at, fn = key[o], doc[o], at[o], fn[o]
        a, b, kept = by_class(key, doc, at)
        found = [(*shared(at, a, b, t), SURE)]
        a, b, wl, wr, rest = star(key[kept], doc[kept], at[kept], t)
        found.append((kept[a], kept[b], wl, wr, 0))
        rest = kept[rest]
        tables = [pa.table({"a": doc[a], "b": doc[b], "fn": fn[a] + np.int32(more), "ca": at[a, 0], "cb": at[b, 0], "wl": wl, "wr": wr, "key": pa.nulls(len(a), pa.int64())}) for a, b, wl, wr, more in found]
        c, left, right = at[rest, 0], at[rest, 1], at[rest, 2]
        none = {x: pa.nulls(len(rest), k) for x, k in (("b", pa.int64()), ("cb", pa.int32()))}
        return pa.concat_tables([passed, *tables, pa.table({"a": doc[rest], "b": none["b"], "fn": fn[rest], "ca": c, "cb": none["cb"], "wl": c - left, "wr": right - c, "key": key[rest].view(np.int64)})])

    made = docs.mapInArrow(windows, "bucket int, fn int, key binary, doc binary, at binary")
    return scratch.save(made.groupBy("bucket").applyInArrow(meet, "a bigint, b bigint, fn int, ca int, cb int, wl int, wr int, key bigint"), "pairs")


def further_pairs(docs: DataFrame, windows: DataFrame, passages: DataFrame, n: int, t: int, widest: int, most: int, drift: int) -> DataFrame:
    """Pairs a > b of windows (key, fn, a, ca, wl, wr) of equal key that share what ``passages`` don't cover in a: a, b, fn, ca, cb, wl, wr.

    At most ``most`` of the t shingles of a passage of a are not in b's, which is at most ``widest`` shingles long. So one of
    any most + 1 of them is in b's window; of every range of t around the node, those that stand in the fewest earlier
    windows are asked for. The answers are checked here, some at a time, with the same hashes as in the end: a pair is
    returned only if it covers something that those before it don't, so pairs grow with the windows, not with their square.
    """
    need = t - most
    buckets = 2 * shuffle_partitions(docs.sparkSession)
    schema = pa.schema([("bucket", pa.int32()), ("key", pa.int64()), ("doc", pa.int64()), ("c", pa.int32()), ("wl", pa.int32()), ("wr", pa.int32()), ("data", pa.binary()), ("gone", pa.binary())])

    def content(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_blocks(batches):
            h, first = shingles(segment(as_bytes(b.column("text"))), n)
            small = (h >> U(32)).astype("<u4")
            parts, data, gone = [], [], []
            for i, (doc, rows, spans) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("rows"), b.column("spans").to_pylist(), strict=True)):
                rows = rows.values
                key, fn, c, wl, wr = (rows.field(k).to_numpy() for k in ("key", "fn", "ca", "wl", "wr"))
                base, count = first[i], first[i + 1] - first[i]
                ok = c + wr < count
                ok[ok] = mix(h[base + c[ok]] ^ SALT[fn[ok]]).view(np.int64) == key[ok]  # another text of the same id
                key, c, wl, wr = (x[ok] for x in (key, c, wl, wr))
                parts.append((key, np.full(len(key), doc), c, wl, wr))
                own, covered = small[base : base + count], np.zeros(count, bool)
                for s in spans or []:
                    covered[s["start"] : max(s["start"], s["end"] - n + 1)] = True
                for lo, hi in zip((c - np.minimum(wl, widest)).tolist(), (c + np.minimum(wr, widest) + 1).tolist(), strict=True):
                    data.append(own[lo:hi].tobytes())
                    gone.append(covered[lo:hi].tobytes())
            key, doc, c, wl, wr = (np.concatenate(x) for x in zip(*parts, strict=True))
            bucket = ((key.view(U) >> U(8)) % U(buckets)).astype(np.int32)
            rows = dict(zip(schema.names, (bucket, key, doc, c, wl, wr, data, gone), strict=True))
            for i in range(0, len(key), 4096):
                yield batch(schema, **{k: v[i : i + 4096] for k, v in rows.items()})

    def flat(column) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), np.uint8)

    def digest(x: np.ndarray) -> np.ndarray:
        parts = np.array_split(x, -(-len(x) // 4096))
        return np.concatenate([mix(part.astype(U) + (np.arange(x.shape[1]).astype(U) << U(40))).sum(1, dtype=U) for part in parts])

    def meet(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("doc", "ascending"), ("c", "ascending")])
        key = table.column("key").to_numpy()
        edge, parts = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)).tolist(), []
        start = 0
        for end in edge:  # whole runs, some thousand windows at a time
            if end - start >= 4096 or end == len(key):
                parts.append(pairs_of(table.slice(start, end - start)))
                start = end
        return pa.concat_tables(parts)

    def pairs_of(table: pa.Table) -> pa.Table:
        key, doc, c, wl, wr = (table.column(k).to_numpy() for k in ("key", "doc", "c", "wl", "wr"))
        many, place = len(key), np.arange(-widest, widest + 1)
        head = np.concatenate([[True], key[1:] != key[:-1]])
        run = np.cumsum(head) - 1
        new_doc = head | np.concatenate([[True], doc[1:] != doc[:-1]])
        before = np.flatnonzero(new_doc)[np.cumsum(new_doc) - 1]  # rows of a run that come before this one have earlier documents
        inside = (place >= -wl[:, None]) & (place <= wr[:, None])  # the node is in the middle
        held, open_ = np.zeros(inside.shape, np.uint32), np.zeros(inside.shape, bool)
        held[inside], open_[inside] = flat(table.column("data")).view("<u4"), flat(table.column("gone")) == 0
        # of windows with the same shingles, the first is enough to be found, and one in t places of a document to ask: its
        # pairs are verified t shingles beyond what they share
        same = mix(digest(held) ^ mix(run.astype(U))) + mix(np.minimum(wl, widest).astype(U) << U(32) | np.minimum(wr, widest).astype(U))
        sole, asks = np.zeros(many, bool), np.zeros(many, bool)
        sole[np.unique(same, return_index=True)[1]] = True
        asks[np.unique(mix(mix(same + mix(doc.view(U))) ^ digest(open_)) + (c // t).astype(U), return_index=True)[1]] = True
        asks &= before > np.flatnonzero(head)[run]
        sole = np.flatnonzero(sole)
        row = np.repeat(sole, inside[sole].sum(1))
        entry = (run[row] << 32) | held[sole][inside[sole]]
        o = np.argsort(entry, kind="stable")
        row, entry = row[o], entry[o]
        once = np.concatenate([[True], (row[1:] != row[:-1]) | (entry[1:] != entry[:-1])])  # rows are in order
        row, entry = row[once], entry[once]
        first = np.concatenate([[True], entry[1:] != entry[:-1]])
        code = (np.cumsum(first) - 1) * many + row
        first = np.flatnonzero(first)
        entries = entry[first]
        ordered = np.sort(np.where(inside[sole], held[sole], held[sole, widest][:, None]), axis=1)  # the node's stands for those outside
        marks = np.zeros((len(sole), 1024), bool)  # of the shingles in a window, and perhaps of others
        marks[np.repeat(np.arange(len(sole)), inside[sole].sum(1)), held[sole][inside[sole]] & 1023] = True

        def lists(who: np.ndarray, what: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Where the windows of earlier documents with this shingle begin and end in ``row``."""
            k = np.minimum(np.searchsorted(entries, (run[who] << 32) | what), len(entries) - 1)
            return first[k], np.searchsorted(code, k * many + before[who])

        def covered(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            """The places of a that lie in passages which b's window holds, as ``shared_spans`` finds them."""
            x, y = held[a], ordered[np.searchsorted(sole, b)]
            at = np.zeros(x.shape, np.intp)
            for step in (1 << k for k in range(x.shape[1].bit_length() - 1, -1, -1)):
                to = np.minimum(at + step, x.shape[1] - 1)
                at = np.where(np.take_along_axis(y, to, 1) <= x, to, at)
            in_b = (np.take_along_axis(y, at, 1) == x) & inside[a]
            low, high = reaches(a, b)
            in_b &= (place >= -(low + t)[:, None]) & (place <= (high + t)[:, None])  # what will be verified
            total = np.zeros((len(a), x.shape[1] + 1), np.int32)
            np.cumsum(in_b, axis=1, out=total[:, 1:])
            good = np.zeros((len(a), x.shape[1] + t), np.int32)
            np.cumsum(total[:, t:] - total[:, :-t] >= need, axis=1, out=good[:, t : x.shape[1] + 1])
            good[:, x.shape[1] + 1 :] = good[:, x.shape[1]][:, None]
            wide = good[:, t:] > good[:, :-t]
            index = np.arange(x.shape[1], dtype=np.int32)
            outer = np.maximum.accumulate(np.where(wide, np.int32(-1), index), axis=1)  # the last place outside, the last one in b
            wide &= np.maximum.accumulate(np.where(in_b, index, np.int32(-1)), axis=1) > outer
            outer = np.minimum.accumulate(np.where(wide, np.int32(len(index)), index)[:, ::-1], axis=1)[:, ::-1]
            return wide & (np.minimum.accumulate(np.where(in_b, index, np.int32(len(index)))[:, ::-1], axis=1)[:, ::-1] < outer)

        def reaches(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return np.minimum(wl[b], np.maximum(wl[a], widest)), np.minimum(wr[b], np.maximum(wr[a], widest))

        def may_hold(a: np.ndarray, b: np.ndarray, free: np.ndarray) -> np.ndarray:
            """Whether b may hold a passage of a with open places: ``covered`` at less cost, and never false where that adds something."""
            in_b = marks[np.searchsorted(sole, b)[:, None], held[a] & 1023] & inside[a]
            total = np.zeros((len(a), len(place) + 1), np.int32)
            np.cumsum(in_b, axis=1, out=total[:, 1:])
            opens = np.zeros((len(a), len(place) + 1), np.int32)
            np.cumsum(free, axis=1, out=opens[:, 1:])
            return ((total[:, t:] - total[:, :-t] >= need) & (opens[:, t:] > opens[:, :-t])).any(1)

        def questions(some: np.ndarray, who: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, ...]:
            """(index, begin, end) of lists: every window that adds something in a range of t around the node is in one of its window's.

            Of a range, most + 1 shingles at least are in no list to leave out: those in the fewest windows, or, if the node is
            covered, the nearest open one and those beyond it, as what is found ends with a shingle that both have.
            """
            near, sums = slice(widest - t + 1, widest + t), lambda v: np.lib.stride_tricks.sliding_window_view(v, t, axis=1)
            lo, hi = (k.reshape(len(who), 2 * t - 1) for k in lists(np.repeat(who, 2 * t - 1), held[who, near].ravel()))
            times = np.where(inside[who, near], hi - lo, 0)
            free, at = free[:, near], np.arange(2 * t - 1)
            is_open = free[:, t - 1]
            left, right = t - 1 - free[:, t - 1 :: -1].argmax(1), t - 1 + free[:, t - 1 :].argmax(1)
            left[~free[:, :t].any(1)], right[~free[:, t - 1 :].any(1)] = -1, 3 * t
            beyond = ((at <= left[:, None]) & (at >= left[:, None] - most)) | ((at >= right[:, None]) & (at <= right[:, None] + most)) | is_open[:, None]
            ok = sums(inside[who, near]).all(2) & sums(free).any(2) & (sums(beyond & (times > 0))).any(2)
            ok &= t - (sums(times > 0)).sum(2) <= most
            x, y = np.nonzero(ok)
            few = np.argpartition(sums(times)[x, y], most, axis=1)[:, : most + 1]
            rare, edge = np.zeros(times.shape, bool), np.zeros((len(who), 2 * t), np.int64)
            rare[np.repeat(x, most + 1), (few + y[:, None]).ravel()] = True
            np.add.at(edge, (x, y), 1)
            np.add.at(edge, (x, y + t), -1)
            beyond &= np.cumsum(edge, axis=1)[:, :-1] > 0
            taken = np.where((~is_open & ((times * beyond).sum(1) < (times * rare).sum(1)))[:, None], beyond, rare) & (times > 0)
            x, y = np.nonzero(taken)
            return some[x], lo[x, y], hi[x, y]

        def answers(who: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            """For these windows, earlier ones that together cover what any earlier one covers."""
            free = open_[who]
            x, lo, hi = questions(np.arange(len(who)), who, free)
            size = np.full(len(x), 4)
            while len(x):
                some = np.arange(len(x))
                some = some[: max(1, int(np.searchsorted(np.cumsum(np.minimum(size, hi - lo)), 65536, "right")))]
                end = np.minimum(lo[some] + size[some], hi[some])
                pair = np.unique(np.repeat(x[some], end - lo[some]) * many + row[ranges(lo[some], end - lo[some])])
                lo[some], size[some] = end, np.minimum(size[some] * 4, 65536)
                changed = np.zeros(len(who), bool)
                found = [(np.empty(0, np.int64), np.empty((0, len(place)), bool))]
                for lot in np.array_split(pair, -(-len(pair) // 4096)) if len(pair) else ():
                    lot = lot[may_hold(who[lot // many], lot % many, free[lot // many])]
                    cover = covered(who[lot // many], lot % many)
                    adds = (cover & free[lot // many]).any(1)
                    found.append((lot[adds], cover[adds]))
                pair, cover = (np.concatenate(k) for k in zip(*found, strict=True))
                while len(pair):  # of each window's, that which covers most, the earliest of these
                    w = pair // many
                    gain = (cover & free[w]).sum(1)
                    keep = gain > 0
                    pair, cover, w, gain = pair[keep], cover[keep], w[keep], gain[keep]
                    o = np.lexsort((pair, -gain, w))
                    best = o[np.concatenate([[True], w[o[1:]] != w[o[:-1]]])] if len(o) else o
                    free[w[best]] &= ~cover[best]
                    changed[w[best]] = True
                    yield who[w[best]], pair[best] % many
                # once the node is covered, only what adds something is of interest
                changed &= ~free[:, widest]
                keep = (lo < hi) & ~changed[x]
                again = np.flatnonzero(changed)
                more, low, high = questions(again, who[again], free[again])
                x, lo, hi, size = (np.concatenate([k[keep], v]) for k, v in ((x, more), (lo, low), (hi, high), (size, np.full(len(more), 4))))

        some = np.flatnonzero(asks & (open_[:, widest - t + 1 : widest + t]).any(1))
        found = [(some[:0], some[:0])]
        for i in range(0, len(some), 1024):
            found += answers(some[i : i + 1024])
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        low, high = reaches(a, b)
        return pa.table({"a": doc[a], "b": doc[b], "fn": np.full(len(a), SURE, np.int32), "ca": c[a], "cb": c[b], "wl": low.astype(np.int32), "wr": high.astype(np.int32)})

    rows = windows.groupBy(F.col("a").alias("doc_id")).agg(F.collect_list(F.struct("key", "fn", "ca", "wl", "wr")).alias("rows"))
    spans = passages.groupBy("doc_id").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    each = parted(docs, windows.select("a"))[0].join(rows, "doc_id").join(spans, "doc_id", "left").select("doc_id", "text", "rows", "spans").mapInArrow(content, "bucket int, key bigint, doc bigint, c int, wl int, wr int, data binary, gone binary")
    return each.groupBy("bucket").applyInArrow(meet, "a bigint, b bigint, fn int, ca int, cb int, wl int, wr int")


def aligned(pairs: DataFrame, t: int, enough: int, drift: int) -> DataFrame:
    """Places where at least ``enough`` functions match, or one that is sure: a, a0, a1, b, b0, b1 (ranges of shingles: the shared windows, in a with t to spare)."""
    schema = pa.schema([(x, pa.int64() if len(x) == 1 else pa.int32()) for x in ("a", "a0", "a1", "b", "b0", "b1")])

    def clusters(table: pa.Table) -> pa.RecordBatch:
        a, b, fn, ca, cb, wl, wr = (table.column(x).to_numpy() for x in ("a", "b", "fn", "ca", "cb", "wl", "wr"))
        shift = ca.astype(np.int64) - cb
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (np.diff(shift) > drift)])
        # within a lot of equal shift, matches a long way apart are places of their own
        lot = np.cumsum(new)
        o = np.lexsort((ca, lot))
        a, b, fn, ca, cb, wl, wr, lot = (x[o] for x in (a, b, fn, ca, cb, wl, wr, lot))
        head = np.flatnonzero(np.concatenate([[True], (lot[1:] != lot[:-1]) | (np.diff(ca) > 2 * t)]))
        bits = np.bitwise_or.reduceat(1 << fn.astype(np.int64), head)
        many = sum((bits >> k) & 1 for k in range(64))
        lows, highs = [np.minimum.reduceat(x - wl, head) for x in (ca, cb)], [np.maximum.reduceat(x + wr, head) + 1 for x in (ca, cb)]
        ok = (many >= enough) | (bits >> SURE != 0)
        return batch(schema, a=a[head][ok], a0=np.maximum(lows[0] - t, 0)[ok], a1=(highs[0] + t)[ok], b=b[head][ok], b0=lows[1][ok], b1=highs[1][ok])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for x in batches:
            if not x.num_rows:
                continue
            table = pa.Table.from_batches([x]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([x])])
            a, b = table.column("a").to_numpy(), table.column("b").to_numpy()
            same = np.flatnonzero((a != a[-1]) | (b != b[-1]))
            cut = int(same[-1]) + 1 if len(same) else 0
            if cut:
                yield clusters(table.slice(0, cut))
            rest = table.slice(cut)
        if rest is not None:
            yield clusters(rest)

    ordered = pairs.repartition(shuffle_partitions(pairs.sparkSession), "a", "b").selectExpr("a", "b", "fn", "ca", "cb", "wl", "wr", "ca - cb as shift").sortWithinPartitions("a", "b", "shift")
    return ordered.drop("shift").mapInArrow(run, "a bigint, a0 int, a1 int, b bigint, b0 int, b1 int")


def slices(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """The shingle hashes (32 bits) of wanted ranges: doc, lo, hi, data."""
    schema = pa.schema([("doc", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("data", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_blocks(batches):
            h, first = shingles(segment(as_bytes(b.column("text"))), n)
            h = (h >> U(32)).astype("<u4")
            out = []
            for i, (doc, spans) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("spans").to_pylist(), strict=True)):
                own = h[first[i] : first[i + 1]]
                out += [(doc, s["lo"], s["hi"], own[s["lo"] : s["hi"]].tobytes()) for s in spans]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], f.type) for k, f in enumerate(schema)], schema=schema)

    spans = wanted.groupBy("doc").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")).withColumnRenamed("doc", "doc_id")
    return parted(docs, wanted.select("doc"))[0].join(spans, "doc_id").select("doc_id", "text", "spans").mapInArrow(run, "doc bigint, lo int, hi int, data binary")


def shared_spans(x: np.ndarray, y: np.ndarray, t: int, percent: int) -> list[tuple[int, int]]:
    """Ranges of x covered by runs of t hashes of which so many are in y that a Jaccard similarity of percent is reached."""
    if len(x) < t or not len(y):
        return []
    y = np.sort(y)
    held = y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x
    total = np.concatenate([[0], np.cumsum(held)])
    need = -(-2 * percent * t // (100 + percent))
    good = np.flatnonzero(total[t:] - total[:-t] >= need)
    if not len(good):
        return []
    out = []
    for part in np.split(good, np.flatnonzero(np.diff(good) > t) + 1):
        lo, hi = int(part[0]), int(part[-1]) + t
        inside = np.flatnonzero(held[lo:hi])
        out.append((lo + int(inside[0]), lo + int(inside[-1]) + 1))
    return out


def repeated_passages(docs: DataFrame, min_words: int = 50, n: int = 5, percent: int = 80, functions: int = 4, enough: int = 2) -> DataFrame:
    """Passages that repeat a passage of a document with a smaller id: doc_id, start, end (words), source_id.

    A passage has ``min_words`` words at least, and so have the windows: 100 * (shared n-word shingles) >=
    percent * (all of both). The first document of equal passages isn't returned as doc_id. Texts that are null
    or shorter than min_words have none; rows with null ids are left out; of rows with equal ids each text is
    taken. Nothing is found in an empty table; other columns are ignored. Not every earlier document that holds a
    passage is named as its source: those that are named cover what the others would.
    """
    t = max(1, min_words - n + 1)
    scratch = Scratch(docs.sparkSession, "substring")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    widest, need, drift = t * 100 // percent, -(-2 * percent * t // (100 + percent)), max(4, t // 4)
    pairs = joined_windows(docs, n, t, widest, functions, 2 * shuffle_partitions(docs.sparkSession), scratch)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("source_id", pa.int64())])

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            out = []
            for a, a0, b, da, db in zip(*(x.column(k).to_pylist() for k in ("a", "a0", "b", "da", "db")), strict=True):
                out += [(a, a0 + i, a0 + j + n - 1, b) for i, j in shared_spans(np.frombuffer(da, "<u4"), np.frombuffer(db, "<u4"), t, percent)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)

    def verified(pairs: DataFrame) -> DataFrame:
        places = scratch.save(aligned(pairs, t, enough, drift), "places")
        wanted = places.selectExpr("a doc", "a0 lo", "a1 hi").unionByName(places.selectExpr("b doc", "b0 lo", "b1 hi")).distinct()
        cut = scratch.save(slices(docs, wanted, n), "slices")
        both = places.join(cut.toDF("a", "a0", "a1", "da"), ["a", "a0", "a1"]).join(cut.toDF("b", "b0", "b1", "db"), ["b", "b0", "b1"])
        out = scratch.save(both.select("a", "a0", "b", "da", "db").mapInArrow(verify, "doc_id bigint, start int, end int, source_id bigint").distinct(), "passages")
        scratch.drop(places, cut)
        return out

    first = verified(pairs.where("b is not null").drop("key"))
    more = verified(further_pairs(docs, pairs.where("b is null").drop("b", "cb"), first, n, t, widest, t - need, drift))
    scratch.drop(pairs)
    out = scratch.save(first.unionByName(more).distinct(), "all")
    scratch.drop(first, more)
    return out


def without_repeats(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """The documents without the words of these passages (doc_id, start, end); text and n_chars change, if there.

    What remains around a passage is joined by one line end. A document that loses all its words is left out;
    one without passages stays as it is, also with a null text or id.
    """
    schema = docs.schema
    spans = passages.groupBy("doc_id").agg(F.collect_set(F.struct("start", "end")).alias("_spans"))
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_blocks(batches):
            texts = as_bytes(b.column("text"))
            w = segment(texts, lower=False)
            out, keep = [], []
            for i, spans in enumerate(b.column("_spans").to_pylist()):
                gone, first, base = np.zeros(w.first[i + 1] - w.first[i], bool), w.first[i], w.text_start[i]
                for s in spans or []:
                    gone[s["start"] : s["end"]] = True
                if not gone.any():
                    out.append(b.column("text")[i].as_py())
                    keep.append(True)
                    continue
                edge = np.flatnonzero(np.diff(np.concatenate([[True], gone, [True]]).astype(np.int8)))
                parts = [texts[i][w.start[first + p] - base : w.end[first + q - 1] - base] for p, q in zip(edge[::2], edge[1::2], strict=True)]
                out.append(b"\n".join(parts).decode())
                keep.append(bool(parts))
            cols = {c: b.column(c) for c in rest} | {"text": pa.array(out, pa.string())}
            if "n_chars" in schema.names:
                old = b.column("n_chars").to_pylist()
                cols["n_chars"] = pa.array([len(x) if s else y for x, s, y in zip(out, b.column("_spans").to_pylist(), old, strict=True)], b.column("n_chars").type)
            yield pa.RecordBatch.from_pydict({c: cols[c] for c in schema.names}).filter(pa.array(keep))

    held, others = parted(docs, passages.select("doc_id"))
    return others.unionByName(held.join(spans, "doc_id", "left").mapInArrow(cut, schema))
