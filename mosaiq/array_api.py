"""The array library under the names and defaults of the Python array API: 64-bit defaults, keyword-only options."""

from __future__ import annotations

from collections import namedtuple

import numpy as np

from .array import Array, broadcast_to  # noqa: F401
from .array import array as make
from .functions import types as ty
from .operators import elementwise as ew
from .operators import factories as fa
from .operators import linalg
from .operators import manipulations as ma
from .operators import reductions as re

e, pi, inf, nan, newaxis = ty.e, ty.pi, ty.inf, ty.nan, None
bool, int8, int16, int32, int64, uint8, float32, float64, complex64, complex128 = "bool", "int8", "int16", "int32", "int64", "uint8", "float32", "float64", "complex64", "complex128"  # noqa: A001

for _n in ("abs", "acos", "acosh", "add", "asin", "asinh", "atan", "atan2", "atanh", "bitwise_and", "bitwise_left_shift", "bitwise_invert", "bitwise_or", "bitwise_right_shift", "bitwise_xor", "ceil", "conj", "copysign", "cos", "cosh", "divide", "exp", "expm1", "floor", "floor_divide", "greater", "greater_equal", "hypot", "imag", "isfinite", "isinf", "isnan", "less", "less_equal", "log", "log1p", "log2", "log10", "logaddexp", "logical_and", "logical_not", "logical_or", "logical_xor", "maximum", "minimum", "multiply", "negative", "not_equal", "positive", "pow", "real", "remainder", "round", "sign", "signbit", "sin", "sinh", "square", "sqrt", "subtract", "tan", "tanh", "trunc", "nonzero"):
    globals()[_n] = getattr(ew, _n)
for _n in ("broadcast_arrays", "concat", "matrix_transpose", "moveaxis", "permute_dims", "roll", "stack", "take", "tile", "repeat", "unique_all", "unique_counts", "unique_inverse", "unique_values"):
    globals()[_n] = getattr(ma, _n)
UniqueInverseResult = ma.UniqueInverse
equal = ew.eq


def clip(x, /, min=None, max=None):  # noqa: A002
    return ew.clip(x, min, max)


def where(condition, x1, x2, /):
    return ew.where(condition, x1, x2)


def _default(x) -> str:
    """bool, int64 or float64 for Python numbers and lists of them."""
    return {"b": "bool", "i": "int64", "u": "int64", "f": "float64", "c": "complex128"}[np.asarray(x).dtype.kind]


def asarray(obj, /, *, dtype=None, device=None, copy=None):
    return make(obj, dtype or (None if isinstance(obj, Array | np.ndarray) else _default(obj)))


def arange(start, /, stop=None, step=1, *, dtype=None, device=None):
    start, stop = (0, start) if stop is None else (start, stop)
    return fa.arange(start, stop, step, dtype=dtype or ("int64" if all_int(start, stop, step) else "float64"))


def all_int(*x):
    return not [v for v in x if not isinstance(v, int)]


def linspace(start, stop, /, num, *, dtype=None, device=None, endpoint=True):
    return fa.linspace(start, stop, num, endpoint, dtype=dtype or "float64")


def empty(shape, *, dtype=None, device=None):
    return fa.zeros(shape, dtype or "float64")


def zeros(shape, *, dtype=None, device=None):
    return fa.zeros(shape, dtype or "float64")


def ones(shape, *, dtype=None, device=None):
    return fa.ones(shape, dtype or "float64")


def full(shape, fill_value, *, dtype=None, device=None):
    return fa.full(shape, fill_value, dtype or _default(fill_value))


def eye(n_rows, n_cols=None, /, *, k=0, dtype=None, device=None):
    return fa.eye((n_rows, n_cols or n_rows), dtype or "float64", k=k)


def full_like(x, /, fill_value, *, dtype=None, device=None):
    return fa.full_like(x, fill_value, dtype)


def zeros_like(x, /, *, dtype=None, device=None):
    return fa.zeros_like(x, dtype)


def ones_like(x, /, *, dtype=None, device=None):
    return fa.ones_like(x, dtype)


def empty_like(x, /, *, dtype=None, device=None):
    return fa.zeros_like(x, dtype)


def from_dlpack(x, /, **_):
    return fa.from_dlpack(x)


def meshgrid(*arrays, indexing="xy"):
    return fa.meshgrid(*arrays, indexing=indexing)


def tril(x, /, *, k=0):
    return ma.tril(x, k)


def triu(x, /, *, k=0):
    return ma.triu(x, k)


def astype(x, dtype, /, *, copy=True, device=None):
    return x.astype(dtype)


def can_cast(from_, to, /):
    return ty.can_cast(from_, to, "safe")


def isdtype(dtype, kind):
    kinds = {"bool": {0}, "signed integer": {1}, "unsigned integer": {1}, "integral": {1}, "real floating": {2}, "complex floating": {3}, "numeric": {1, 2, 3}}
    if isinstance(kind, tuple):
        return len([k for k in kind if isdtype(dtype, k)]) > 0
    t = ty.canonical(dtype)
    if kind in kinds:
        return ty.KINDS[t] in kinds[kind] and not (kind == "signed integer" and t == "uint8") and not (kind == "unsigned integer" and t != "uint8")
    return t == ty.canonical(kind)


finfo, iinfo, result_type = ty.finfo, ty.iinfo, ty.result_type


def expand_dims(x, /, *, axis=0):
    return ma.expand_dims(x, axis)


def flip(x, /, *, axis=None):
    return ma.flip(x, axis)


def reshape(x, /, shape, *, copy=None):
    return ma.reshape(x, tuple(shape))


def squeeze(x, /, axis):
    return ma.squeeze(x, axis)


def sort(x, /, *, axis=-1, descending=False, stable=True):
    return re.sort(x, axis, descending)[0]


def argsort(x, /, *, axis=-1, descending=False, stable=True):
    return re.argsort(x, axis, descending)


def _reduced(f):
    def call(x, /, *, axis=None, keepdims=False, dtype=None):
        out = f(x, axis, keepdims=keepdims)
        return out if dtype is None else out.astype(dtype)

    call.__name__ = f.__name__
    return call


sum, prod, max, min, mean, all, any, argmax, argmin = map(_reduced, (re.sum, re.prod, re.max, re.min, re.mean, re.all, re.any, re.argmax, re.argmin))  # noqa: A001


def std(x, /, *, axis=None, correction=0.0, keepdims=False):
    return re.std(x, axis, int(correction), keepdims)


def var(x, /, *, axis=None, correction=0.0, keepdims=False):
    return re.var(x, axis, int(correction), keepdims)


def cumulative_sum(x, /, *, axis=0, dtype=None, include_initial=False):
    out = re.cumsum(x, axis)
    if include_initial:
        out = ma.concatenate([fa.zeros([1 if k == axis else n for k, n in enumerate(x.shape)], out.dtype), out], axis)
    return out if dtype is None else out.astype(dtype)


def diff(x, /, *, axis=-1, n=1, prepend=None, append=None):
    return re.diff(x, n, axis, prepend, append)


def matmul(x1, x2, /):
    return linalg.matmul(x1, x2)


def tensordot(x1, x2, /, *, axes=2):
    return linalg.tensordot(x1, x2, axes)


def vecdot(x1, x2, /, *, axis=-1):
    return linalg.vecdot(x1, x2, axis)


Info = namedtuple("Info", "capabilities default_device default_dtypes devices dtypes")


def __array_namespace_info__() -> Info:
    kinds = {k: [t for t in ty.KINDS if isdtype(t, k)] for k in ("bool", "signed integer", "unsigned integer", "integral", "real floating", "complex floating", "numeric")}

    def dtypes(*, device=None, kind=None):
        names = list(ty.KINDS) if kind is None else kinds[kind] if isinstance(kind, str) else [t for k in kind for t in kinds[k]]
        return {t: t for t in names}

    return Info(lambda: {"boolean indexing": True, "data-dependent shapes": True, "max dimensions": 64}, lambda: "cpu", lambda *, device=None: {"real floating": "float64", "complex floating": "complex128", "integral": "int64", "indexing": "int64"}, lambda: ["cpu"], dtypes)

