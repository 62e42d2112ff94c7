"""Benchmark decontamination by greedy string tiling.

Texts are cut into words (runs of ASCII letters, digits and bytes above 127, A-Z lower-cased). Rolling hashes of
``seed`` words find what a document shares with a test item; runs of seeds on a diagonal are matches, of which the
longest is marked again and again, and what it overlaps is shortened, until none of ``seed`` words is left. The
share of an item's words under marks is its coverage, in whatever order the passages stand in the document.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, text_blocks
from .words import Words, as_bytes, gram_hashes, word_hashes

_GAP = np.array([not (chr(c).isalnum() or c > 127) for c in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
RESULT = "doc_id bigint, item_id bigint, coverage double, covered int, item_words int, tiles int"


def alnum_words(texts: list[bytes]) -> Words:
    data = _LOWER[np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)]
    edge = np.diff(_GAP[data].view(np.int8))
    start, end = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
    at = np.cumsum([1, *(len(t) + 1 for t in texts)])
    return Words(data, start, end, np.searchsorted(start, at), at)


def tile(hits: list[tuple[int, int]], length: int, seed: int) -> list[tuple[int, int, int]]:
    """Tiles (place in document, place in item, words) from seed hits (document, item) of ``seed`` words.

    Of equally long matches the first in the document, then in the item, is marked.
    """
    heap: list[tuple[int, int, int]] = []
    by_diagonal: dict[int, list[int]] = {}
    for i, j in hits:
        by_diagonal.setdefault(i - j, []).append(j)
    for d, js in by_diagonal.items():
        js.sort()
        first = last = js[0]
        for j in [*js[1:], None]:
            if j is not None and j == last + 1:
                last = j
                continue
            heap.append((-(last - first + seed), d + first, first))
            first = last = j
    heapq.heapify(heap)
    doc_used: set[int] = set()
    item_used = bytearray(length)
    tiles = []
    while heap:
        n, i, j = heapq.heappop(heap)
        free, best, k = 0, (0, 0), 0
        for k in range(-n):
            free = 0 if item_used[j + k] or i + k in doc_used else free + 1
            if free > best[0]:
                best = (free, k - free + 1)
        if best[0] < seed:
            continue
        if best[0] < -n:  # part of it is marked: what is left goes back in line
            heapq.heappush(heap, (-best[0], i + best[1], j + best[1]))
            rest = [(best[1] - 0, 0)] if best[1] >= seed else []
            tail = -n - best[1] - best[0]
            rest += [(tail, best[1] + best[0])] if tail >= seed else []
            for m, k in rest:
                heapq.heappush(heap, (-m, i + k, j + k))
            continue
        doc_used.update(range(i, i - n))
        item_used[j : j - n] = b"\1" * -n
        tiles.append((i, j, -n))
    return tiles


class Items:
    """Test items and their seeds, sorted by hash."""

    def __init__(self, ids: list[int], texts: list[bytes], seed: int):
        w = alnum_words(texts)
        h, n = word_hashes(w), np.diff(w.first)
        self.ids, self.length = ids, n
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in {min(seed, int(x)) for x in n if x}:
            g = gram_hashes(h, size)
            rows = [k for k, x in enumerate(n) if x and min(seed, x) == size]
            item = np.concatenate([np.full(n[k] - size + 1, k) for k in rows])
            at = np.concatenate([np.arange(n[k] - size + 1) for k in rows])
            value = g[w.first[item] + at]
            order = np.argsort(value, kind="stable")
            light = np.zeros(1 << 20, bool)
            light[(value >> np.uint64(44)).astype(np.int64)] = True
            self.by_size[size] = (value[order], item[order], at[order], light)

    def matches(self, texts: list[bytes], threshold: float) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, covered words, tiles) with a coverage of at least ``threshold``."""
        w = alnum_words(texts)
        h = word_hashes(w)
        for size, (value, item, at, light) in self.by_size.items():
            g = gram_hashes(h, size)
            pos = np.flatnonzero(light[(g >> np.uint64(44)).astype(np.int64)])
            left, right = np.searchsorted(value, g[pos]), np.searchsorted(value, g[pos], "right")
            pos, left, right = (x[right > left] for x in (pos, left, right))
            doc = np.searchsorted(w.first, pos, "right") - 1
            ok = pos + size <= w.first[doc + 1]
            pos, left, right, doc = (x[ok] for x in (pos, left, right, doc))
            for d in np.unique(doc):
                mine = np.flatnonzero(doc == d) if len(doc) < 64 else np.arange(*np.searchsorted(doc, [d, d + 1]))
                by_item: dict[int, list[tuple[int, int]]] = {}
                for p, a, b in zip(pos[mine].tolist(), left[mine].tolist(), right[mine].tolist(), strict=True):
                    for k in range(a, b):
                        by_item.setdefault(int(item[k]), []).append((p, int(at[k])))
                for k, hits in by_item.items():
                    n = int(self.length[k])
                    might = np.zeros(n + size, np.int32)
                    for j in {j for _, j in hits}:
                        might[j : j + size] = 1
                    if might[:n].sum() < threshold * n:
                        continue
                    tiles = tile(hits, n, size)
                    covered = sum(t[2] for t in tiles)
                    if covered >= threshold * n:
                        yield int(d), k, covered, len(tiles)


def contaminated(docs: DataFrame, items: DataFrame, seed: int = 4, threshold: float = 0.5, block_bytes: int = 16 << 20) -> DataFrame:
    """Pairs of a document and a test item of which it holds at least ``threshold``: doc_id, item_id, coverage, ...

    Items are sent to all tasks in blocks of about ``block_bytes`` bytes of text, one pass over the documents
    for each block; their size is measured first. An item of fewer than ``seed`` words matches as a whole.
    Null or wordless texts, on either side, match nothing; of items with null id none is tested. Repeated rows
    of documents or items give a row each; an empty table gives none; other columns are ignored.
    """
    docs = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
    items = items.selectExpr("cast(item_id as bigint) item_id", "text").where("item_id is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = -(-int(size) // block_bytes) or 1
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("covered", pa.int32()), ("item_words", pa.int32()), ("tiles", pa.int32())])
    out = None
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()  # block_bytes at most
        sent = docs.sparkSession.sparkContext.broadcast(([r.item_id for r in part], [r.text.encode() for r in part]))

        def run(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            tests = Items(*sent.value, seed)
            for b in text_blocks(batches):
                ids = b.column("doc_id").to_pylist()
                rows = list(tests.matches(as_bytes(b.column("text")), threshold))
                if rows:
                    n = [int(tests.length[r[1]]) for r in rows]
                    yield batch(schema, doc_id=[ids[r[0]] for r in rows], item_id=[tests.ids[r[1]] for r in rows], coverage=[r[2] / m for r, m in zip(rows, n, strict=True)], covered=[r[2] for r in rows], item_words=n, tiles=[r[3] for r in rows])

        found = docs.mapInArrow(run, RESULT)
        out = found if out is None else out.unionByName(found)
    return out
