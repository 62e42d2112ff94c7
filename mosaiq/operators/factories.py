"""Generators: ranges, fills, grids, random numbers by counter, and matrices of known structure.

Random values are a function of (seed, draw, cell), so they don't depend on partitions and can be made again after
the loss of an executor.
"""

from __future__ import annotations

import math
import time

import numpy as np
from pyspark.sql import functions as F

from ..array import Array, array, idx, linear, number_rows, sanitize_shape, session, unravel
from ..array import prod as _size
from ..functions import expr
from ..functions import types as ty


def cells_of(shape, value, dtype, split=0) -> Array:
    shape = sanitize_shape(shape)
    spark = session()
    base = spark.range(_size(shape))
    frame = base.select(*[c.alias(f"i{k}") for k, c in enumerate(unravel(F.col("id"), shape))], "id")
    return Array(frame, shape, dtype, value.cast(ty.SPARK[ty.canonical(dtype)]) if not ty.is_complex(dtype) else value, split)


def full(shape, fill_value, dtype="float32", split=0, **_):
    v = expr.complex_(F.lit(complex(fill_value).real), F.lit(complex(fill_value).imag)) if ty.is_complex(dtype) else F.lit(fill_value)
    return cells_of(shape, v, dtype, split)


def zeros(shape, dtype="float32", split=0, **_):
    return full(shape, 0, dtype, split)


def ones(shape, dtype="float32", split=0, **_):
    return full(shape, 1, dtype, split)


empty = zeros


def full_like(a, fill_value, dtype=None, **_):
    return full(a.shape, fill_value, dtype or a.dtype)


def zeros_like(a, dtype=None, **_):
    return full_like(a, 0, dtype)


def ones_like(a, dtype=None, **_):
    return full_like(a, 1, dtype)


empty_like = zeros_like


def eye(shape, dtype="float32", split=0, k=0, **_):
    n = (shape, shape) if isinstance(shape, int) else tuple(shape) if len(shape) > 1 else (shape[0], shape[0])
    return cells_of(n, (F.col("i1") - F.col("i0") == k).cast("int"), dtype, split)


def arange(*args, dtype=None, split=0, **_):
    start, stop, step = (0, args[0], 1) if len(args) == 1 else (*args, 1)[:3]
    n = max(0, math.ceil((stop - start) / step))
    t = dtype or ("int32" if all(isinstance(x, int) for x in (start, stop, step)) else "float32")
    return cells_of((n,), F.lit(start) + F.col("id") * step, t, split)


def linspace(start, stop, num=50, endpoint=True, retstep=False, dtype="float32", split=0, **_):
    step = (stop - start) / max(1, num - 1 if endpoint else num)
    out = cells_of((num,), F.lit(float(start)) + F.col("id") * float(step), dtype or "float32", split)
    return (out, step) if retstep else out


def logspace(start, stop, num=50, endpoint=True, base=10.0, dtype="float32", split=0, **_):
    x = linspace(start, stop, num, endpoint, dtype="float64")
    return x.apply(lambda v: F.pow(F.lit(float(base)), v).cast(ty.SPARK[ty.canonical(dtype or "float32")]), dtype or "float32")


def meshgrid(*arrays, indexing="xy"):
    if indexing not in ("xy", "ij"):
        raise ValueError("indexing is xy or ij")
    from ..array import broadcast_to
    from .manipulations import swapaxes

    shape = [a.size for a in arrays]
    out = []
    for k, a in enumerate(arrays):
        line = Array(a.cells().select(*[(F.col("i0") if j == k else F.lit(0).cast("bigint")).alias(f"i{j}") for j in range(len(arrays))], "v"), [n if j == k else 1 for j, n in enumerate(shape)], a.dtype)
        grid = broadcast_to(line, shape)
        out.append(swapaxes(grid, 0, 1) if indexing == "xy" and len(arrays) > 1 else grid)
    return out


def from_dlpack(x, **_):
    return array(np.from_dlpack(x))


def from_partition_dict(parted: dict, comm=None) -> Array:
    """From a dictionary of blocks: shape, and partitions with start, shape and data."""
    out = np.zeros(parted["shape"], dtype=np.asarray(next(iter(parted["partitions"].values()))["data"]).dtype)
    for p in parted["partitions"].values():
        out[tuple(slice(s, s + n) for s, n in zip(p["start"], p["shape"], strict=True))] = np.asarray(p["data"]() if callable(p["data"]) else p["data"])
    return array(out)


def from_partitioned(x, comm=None) -> Array:
    return from_partition_dict(x.__partitioned__)


# random numbers

_state = {"seed": 0, "draw": 0}


def seed(seed=None):
    _state.update(seed=int(time.time() * 1e6) % 2**31 if seed is None else int(seed), draw=0)


def get_state():
    return ("Counter", _state["seed"], _state["draw"], 0, 0.0)


def set_state(state):
    if state[0] != "Counter":
        raise ValueError("state of another generator")
    _state.update(seed=int(state[1]), draw=int(state[2]))


def hashed(salt: int = 0, at=None):
    """53 random bits as a double in [0, 1), for each cell."""
    at = F.col("id") if at is None else at
    return F.shiftrightunsigned(F.xxhash64(at, F.lit(_state["seed"]), F.lit(_state["draw"]), F.lit(salt)), 11).cast("double") * 2.0**-53


def _draw(shape, value, dtype, split=0):
    out = cells_of(() if shape is None else shape, value, dtype, split)
    _state["draw"] += 1
    return out


def rand(*d, dtype="float32", split=0, **_):
    return _draw(d or (1,), hashed(), dtype, split)


def random(shape=None, dtype="float32", split=0, **_):
    return _draw((1,) if shape is None else shape, hashed(), dtype, split)


ranf = random_sample = sample = random


def _gauss(salt: int = 0):
    return F.sqrt(-2.0 * F.log(1.0 - hashed(salt))) * F.cos(2 * math.pi * hashed(salt + 1))


def randn(*d, dtype="float32", split=0, **_):
    return _draw(d or (1,), _gauss(), dtype, split)


def standard_normal(shape=None, dtype="float32", split=0, **_):
    return _draw((1,) if shape is None else shape, _gauss(), dtype, split)


def normal(mean=0.0, std=1.0, shape=None, dtype="float32", split=0, **_):
    if std < 0:
        raise ValueError("std must not be negative")
    return _draw((1,) if shape is None else shape, _gauss() * std + mean, dtype, split)


def randint(low, high=None, size=None, dtype="int32", split=0, **_):
    low, high = (0, low) if high is None else (low, high)
    if high <= low:
        raise ValueError("low must be less than high")
    return _draw((1,) if size is None else size, F.floor(hashed() * (high - low)) + low, dtype, split)


random_integer = randint


def randperm(n, dtype="int64", split=0, **_):
    cells = session().range(n).select("id", hashed().alias("_h"))
    _state["draw"] += 1
    return Array(number_rows(cells, ["_h", "id"], "i0").select("i0", F.col("id").alias("v")), (n,), dtype)


def permutation(x, **_):
    """Rows along axis 0 in random order; of an integer the numbers below it."""
    if isinstance(x, int):
        return randperm(x)
    p = randperm(x.shape[0]).cells().select(F.col("i0").alias("_new"), F.col("v").alias("i0"))
    return Array(x.cells().join(p, "i0").withColumn("i0", F.col("_new")).select(*idx(x.ndim), "v"), x.shape, x.dtype)


# matrices of known structure


def parter(n, dtype="float32", **_):
    return cells_of((n, n), 1.0 / (F.col("i0") - F.col("i1") + 0.5), dtype)


def hermitian(n, dtype="complex64", positive_definite=False, **_):
    from .elementwise import mul
    from .linalg import matmul

    if ty.is_complex(dtype):
        low, high = F.least("i0", "i1"), F.greatest("i0", "i1")
        at = low * n + high
        im = F.when(F.col("i0") == F.col("i1"), 0.0).when(F.col("i0") < F.col("i1"), hashed(7, at)).otherwise(-hashed(7, at))
        re = hashed(5, at) + (F.when(F.col("i0") == F.col("i1"), float(2 * n)).otherwise(0.0) if positive_definite else 0.0)
        out = cells_of((n, n), expr.complex_(re, im), dtype)
        _state["draw"] += 1
        return out
    a = randn(n, n, dtype="float64")
    return matmul(a, a.T) if positive_definite else mul(a + a.T, 0.5)


def random_orthogonal(m, n, dtype="float32", **_):
    from .linalg import qr

    if n > m:
        raise ValueError("needs at least as many rows as columns")
    return qr(randn(m, n, dtype="float64")).Q.astype(dtype)


def random_known_singularvalues(m, n, singular_values, dtype="float32", **_):
    from .linalg import matmul

    s = np.asarray(singular_values.numpy() if isinstance(singular_values, Array) else singular_values, dtype=float)
    u, v = random_orthogonal(m, len(s), "float64"), random_orthogonal(n, len(s), "float64")
    us = Array(u.cells(), u.shape, "float64", F.col("v") * F.element_at(F.array(*[F.lit(float(x)) for x in s]), (F.col("i1") + 1).cast("int")))
    return matmul(us, v.T).astype(dtype), (u, array(s), v)


def random_known_rank(m, n, r, quantile_function=lambda x: -np.log(x), dtype="float32", **_):
    s = np.sort(quantile_function(np.random.default_rng(_state["seed"]).random(r)))[::-1]
    return random_known_singularvalues(m, n, s, dtype)


def create_spherical_dataset(num_samples_cluster, radius=1.0, offset=4.0, dtype="float32", random_state=1):
    """Four balls of points in three dimensions, around multiples of the offset on the diagonal."""
    seed(random_state)
    n = 4 * num_samples_cluster
    unit = F.col("id") - F.col("id") % 3
    centre = F.element_at(F.array(*[F.lit(float(c * offset)) for c in (-2, -1, 1, 2)]), (F.floor(F.col("i0") / num_samples_cluster) + 1).cast("int"))
    theta, z = hashed(1, unit) * 2 * math.pi, hashed(2, unit) * 2 - 1
    r, flat = F.pow(hashed(3, unit), F.lit(1 / 3)) * radius, F.sqrt(1 - z * z)
    part = F.when(F.col("i1") == 0, flat * F.cos(theta)).when(F.col("i1") == 1, flat * F.sin(theta)).otherwise(z)
    return cells_of((n, 3), centre + r * part, dtype)


def create_clusters(n_samples, n_features, n_clusters, cluster_mean, cluster_std, cluster_weight=None, device=None):
    """A Gaussian mixture; spreads are one number a cluster, or one for each of its features."""
    w = np.full(n_clusters, 1 / n_clusters) if cluster_weight is None else np.asarray(cluster_weight, float) / np.sum(cluster_weight)
    mean = np.broadcast_to(np.asarray(cluster_mean, float).reshape(n_clusters, -1), (n_clusters, n_features))
    std = np.broadcast_to(np.asarray(cluster_std, float).reshape(n_clusters, -1), (n_clusters, n_features))
    u = hashed(11, F.col("i0"))
    k = F.lit(0)
    for edge in np.cumsum(w)[:-1]:
        k = k + (u >= float(edge)).cast("int")
    pick = lambda t: F.element_at(F.element_at(F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in t]), k + 1), (F.col("i1") + 1).cast("int"))
    return _draw((n_samples, n_features), pick(mean) + pick(std) * _gauss(13), "float32")
