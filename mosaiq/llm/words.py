"""Word segmentation, word hashes and shingle hashes of many texts at once, in numpy.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D of the UTF-8 text. Hashes have 64 bits: a word's
is a polynomial in its bytes, taken from prefix sums over the whole block, then mixed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240521).integers(0, 2**64, 256, U)
BASE, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)
_power: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> list[np.ndarray]:
    """BASE**i and BASE**-i for i < n, modulo 2**64."""
    if len(_power[0]) < n:
        for k, b in enumerate((BASE, INVERSE)):
            p = np.full(n + n // 4, b, U)
            p[0] = 1
            _power[k] = np.multiply.accumulate(p)
    return _power


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (two multiply-and-shift rounds)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@dataclass
class Words:
    """Words of a block of texts: byte ranges in ``data``, and for each text the range of its words."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # of text i: words first[i] to first[i + 1]
    text_start: np.ndarray  # byte at which text i starts in data

    def __len__(self) -> int:
        return len(self.first) - 1

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.first))

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def as_bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def segment(texts: list[bytes], lower: bool = True) -> Words:
    data = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
    if lower:
        data = _LOWER[data]
    edge = np.diff(_SPACE[data].view(np.int8))
    start, end = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
    at = np.cumsum([1, *(len(t) + 1 for t in texts)])
    return Words(data, start, end, np.searchsorted(start, at), at)


def word_hashes(w: Words) -> np.ndarray:
    up, down = powers(len(w.data))
    total = np.zeros(len(w.data) + 1, U)
    np.cumsum(_BYTE[w.data] * up[: len(w.data)], out=total[1:])
    return mix((total[w.end] - total[w.start]) * down[w.start] + (w.end - w.start).astype(U) * U(0xD6E8FEB86659FD93))


_PLACE = np.random.default_rng(77).integers(0, 2**63, 64, U) * U(2) + U(1)


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words (across texts too): place-weighted sums, mixed."""
    if len(h) < n:
        return np.empty(0, U)
    out = np.zeros(len(h) - n + 1, U)
    for k in range(n):
        out += h[k : len(h) - n + 1 + k] * _PLACE[k]
    return mix(out)


def shingles(w: Words, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles in order, and the range of each text's (first[i] to first[i + 1]).

    A text of fewer than n words, but one at least, has one shingle: all its words.
    """
    h, count = word_hashes(w), np.diff(w.first)
    many = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    first = np.concatenate([[0], np.cumsum(many)])
    out = np.empty(first[-1], U)
    full = gram_hashes(h, n)
    long = np.flatnonzero(count >= n)
    at = np.repeat(w.first[long] - first[long], many[long]) + ranges(first[long], many[long])
    out[ranges(first[long], many[long])] = full[at]
    for i in np.flatnonzero((count > 0) & (count < n)):
        part = h[w.first[i] : w.first[i + 1]]
        with np.errstate(over="ignore"):
            out[first[i]] = mix((part * _PLACE[8 : 8 + len(part)]).sum(dtype=U).reshape(1) + U(len(part)))[0]
    return out, first


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (count[0] of them), start[1], ..."""
    total = int(count.sum())
    if not total:
        return np.empty(0, np.int64)
    before = np.concatenate([[0], np.cumsum(count)[:-1]])
    return np.arange(total) + np.repeat(start - before, count)
