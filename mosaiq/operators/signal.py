"""Convolution and discrete Fourier transforms.

A convolution along a line cuts the output in blocks, each made by one task from its cells and the few before them, so
a cell is shuffled at most twice whatever the kernel's length. Planes, and kernels over LONGEST, explode every cell over
the kernel and sum what meets. No line has to fit a task, except for transforms: these take whole lines, short ones together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..array import Array, array, idx, linear, sanitize_axis, unravel
from ..functions import types as ty
from .factories import cells_of

#: Cells of a block of the output (or the kernel's length, if that is more), and the longest kernel sent to tasks.
BLOCK, LONGEST = 1 << 16, 1_000_000
#: Cells of the lines that are transformed together.
TOGETHER = 1 << 16


def _bounds(n: int, m: int, mode: str) -> tuple[int, int]:
    if mode not in ("full", "same", "valid"):
        raise ValueError("mode is full, same or valid")
    if mode == "same" and m % 2 == 0:
        raise ValueError("mode same needs kernels of odd length")
    start = {"full": 0, "same": m // 2, "valid": m - 1}[mode]
    return start, n + m - 1 - 2 * start


def convolve(a, v, mode="full", stride=1):
    """1-D convolution along the last axis (of a batch of signals with one kernel)."""
    a, v = (x if isinstance(x, Array) else array(x) for x in (a, v))
    if a.ndim == 1 and v.ndim == 1 and v.size > a.size:
        a, v = v, a
    if v.ndim != 1:
        raise ValueError("the kernel has one axis")
    return _conv(a, v, (mode,), (stride,))


def convolve2d(a, v, mode="full", stride=(1, 1)):
    a, v = (x if isinstance(x, Array) else array(x) for x in (a, v))
    stride = (stride, stride) if isinstance(stride, int) else tuple(stride)
    return _conv(a, v, (mode, mode), stride)


def _lines(a: Array, w: np.ndarray, mode: str, stride: int, cast: str, dtype: str) -> Array:
    """Convolution along the last axis by blocks of the output: each takes its cells and the len(w) - 1 before them.

    A cell goes to the one or two blocks that it reaches, and a block's result is whole, so nothing is summed afterwards.
    """
    nb, m = a.ndim - 1, len(w)
    keys, at = idx(nb), F.col(f"i{nb}")
    start, n = _bounds(a.shape[-1], m, mode)
    block = max(BLOCK, m)
    reach = F.sequence(F.call_function("div", at, F.lit(block)), F.call_function("div", at + (m - 1), F.lit(block)))
    cells = a.cells().select(*keys, at, F.col("v").cast(cast).alias("v"), F.explode(reach).alias("_b"))

    def run(table: pa.Table) -> pa.Table:
        first = table.column("_b")[0].as_py() * block
        x = np.zeros(block + m - 1, w.dtype)
        x[table.column(f"i{nb}").to_numpy() - first + m - 1] = table.column("v").to_numpy()
        y, p = np.convolve(x, w, "valid"), np.arange(first, first + block) - start
        keep = (p >= 0) & (p < n) & (p % stride == 0)
        p, y = p[keep] // stride, y[keep]
        return pa.table({k: np.full(len(p), table.column(k)[0].as_py(), np.int64) for k in keys} | {f"i{nb}": p.astype(np.int64), "v": y})

    schema = ", ".join([*(f"{k} bigint" for k in keys), f"i{nb} bigint", f"v {cast}"])
    return Array(cells.groupBy(*keys, "_b").applyInArrow(run, schema), [*a.shape[:-1], max(0, -(-n // stride))], dtype)


def _conv(a: Array, v: Array, modes, strides) -> Array:
    d = len(strides)
    if any(s < 1 for s in strides):
        raise ValueError("strides are positive")
    if any(s > 1 for s in strides) and "same" in modes:
        raise ValueError("mode same takes no strides")
    if not ty.is_exact(a.dtype) or not ty.is_exact(v.dtype):
        cast = "double"
    else:
        cast = "bigint"
    if d == 1 and v.size <= LONGEST:
        w = v.numpy().astype(np.float64 if cast == "double" else np.int64)
        return _lines(a, w, modes[0], strides[0], cast, ty.promote_types(a.dtype, v.dtype))
    k = v.cells().select(*[F.col(f"i{j}").alias(f"_k{j}") for j in range(d)], F.col("v").cast(cast).alias("_w"))
    cells, shape, names = a.cells().withColumn("v", F.col("v").cast(cast)).crossJoin(F.broadcast(k) if v.size <= LONGEST else k), list(a.shape), idx(a.ndim)
    for j in range(d):
        ax = a.ndim - d + j
        start, n = _bounds(a.shape[ax], v.shape[j], modes[j])
        shape[ax] = max(0, -(-n // strides[j]))
        at = F.col(f"i{ax}") + F.col(f"_k{j}") - start
        cells = cells.withColumn(f"i{ax}", at).where((F.col(f"i{ax}") >= 0) & (F.col(f"i{ax}") < n))
        if strides[j] > 1:
            cells = cells.where(F.col(f"i{ax}") % strides[j] == 0).withColumn(f"i{ax}", F.call_function("div", F.col(f"i{ax}"), F.lit(strides[j])))
    out = cells.groupBy(*names).agg(F.sum(F.col("v") * F.col("_w")).alias("v"))
    return Array(out, shape, ty.promote_types(a.dtype, v.dtype))


def _line(a: Array, axis: int, f, n: int, complex_out: bool) -> Array:
    """A function of each line along an axis: a group has whole lines, as many as TOGETHER cells, and they are done at once."""
    axis = sanitize_axis(a.shape, axis)
    others = [k for k in range(a.ndim) if k != axis]
    length, was_complex, rest = a.shape[axis], ty.is_complex(a.dtype), [a.shape[k] for k in others]
    value = F.struct(F.col("v.re").cast("double").alias("re"), F.col("v.im").cast("double").alias("im")) if was_complex else F.struct(F.col("v").cast("double").alias("re"), F.lit(0.0).alias("im"))
    line = linear(rest, [f"i{k}" for k in others])
    group = F.call_function("div", line, F.lit(max(1, TOGETHER // max(1, length, n))))
    frame = a.cells().select(group.alias("_g"), line.alias("_l"), F.col(f"i{axis}").alias("_p"), value.re.alias("re"), value.im.alias("im"))

    def run(table: pa.Table) -> pa.Table:
        lines, at = np.unique(table.column("_l").to_numpy(), return_inverse=True)
        x = np.zeros((len(lines), length), complex if was_complex else float)
        re = table.column("re").to_numpy()
        x[at, table.column("_p").to_numpy()] = re + 1j * table.column("im").to_numpy() if was_complex else re
        y = np.asarray(f(x))
        m = y.shape[1]
        return pa.table({"_l": np.repeat(lines, m), "_p": np.tile(np.arange(m), len(lines)), "re": y.real.ravel().astype(float), "im": y.imag.ravel().astype(float) if np.iscomplexobj(y) else np.zeros(y.size)})

    done = frame.groupBy("_g").applyInArrow(run, "_l bigint, _p bigint, re double, im double")
    back = dict(zip(others, unravel(F.col("_l"), rest), strict=True))
    cols = [(F.col("_p") if k == axis else back[k]).alias(c) for k, c in enumerate(idx(a.ndim))]
    v = F.struct("re", "im") if complex_out else F.col("re")
    return Array(done.select(*cols, v.alias("v")), [n if k == axis else m for k, m in enumerate(a.shape)], "complex128" if complex_out else "float64")


def _one(name: str, length, complex_out: bool, real_in: bool = False):
    g = getattr(np.fft, name)

    def call(x, n=None, axis=-1, norm=None):
        if real_in and ty.is_complex(x.dtype):
            raise TypeError(f"{name} takes real numbers")
        m = x.shape[axis] if n is None else n
        size = length(m) if n is None or name in ("rfft", "ihfft") else n
        return _line(x, axis, lambda lines: g(lines, n=n, axis=-1, norm=norm), size, complex_out)

    call.__name__, call.__doc__ = name, f"{name} along an axis, with length n and norm as in NumPy."
    return call


fft, ifft = _one("fft", lambda m: m, True), _one("ifft", lambda m: m, True)
rfft, irfft = _one("rfft", lambda m: m // 2 + 1, True, True), _one("irfft", lambda m: 2 * (m - 1), False)
hfft, ihfft = _one("hfft", lambda m: 2 * (m - 1), False), _one("ihfft", lambda m: m // 2 + 1, True, True)


def _many(first, rest, first_last: bool):
    """An n-D transform: one kind on the last axis, another on the others, in the order given."""

    def call(x, s=None, axes=None, norm=None):
        axes = list(range(x.ndim))[-len(s) if s else -x.ndim :] if axes is None else list(axes)
        s = [None] * len(axes) if s is None else list(s)
        order = list(zip(s, axes, strict=True))
        if first_last:
            x = first(x, order[-1][0], order[-1][1], norm)
            for n, ax in order[:-1]:
                x = rest(x, n, ax, norm)
            return x
        for n, ax in order[:-1]:
            x = rest(x, n, ax, norm)
        return first(x, order[-1][0], order[-1][1], norm)

    return call


fftn, ifftn, rfftn, irfftn = _many(fft, fft, True), _many(ifft, ifft, True), _many(rfft, fft, True), _many(irfft, ifft, False)
hfftn, ihfftn = _many(hfft, fft, False), _many(ihfft, ifft, True)


def _two(f):
    return lambda x, s=None, axes=(-2, -1), norm=None: f(x, s, axes, norm)


fft2, ifft2, rfft2, irfft2, hfft2, ihfft2 = map(_two, (fftn, ifftn, rfftn, irfftn, hfftn, ihfftn))


def fftfreq(n, d=1.0, dtype="float32", **_):
    if isinstance(d, complex):
        raise NotImplementedError("d is real")
    k = F.when(F.col("id") < (n + 1) // 2, F.col("id")).otherwise(F.col("id") - n)
    return cells_of((n,), k / float(n * d), dtype or "float32")


def rfftfreq(n, d=1.0, dtype="float32", **_):
    return cells_of((n // 2 + 1,), F.col("id") / float(n * d), dtype or "float32")


def fftshift(x, axes=None):
    from .manipulations import roll

    axes = range(x.ndim) if axes is None else [axes] if isinstance(axes, int) else axes
    return roll(x, [x.shape[k] // 2 for k in axes], list(axes))


def ifftshift(x, axes=None):
    from .manipulations import roll

    axes = range(x.ndim) if axes is None else [axes] if isinstance(axes, int) else axes
    return roll(x, [-(x.shape[k] // 2) for k in axes], list(axes))
