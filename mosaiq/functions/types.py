"""Element types, their Spark types, promotion and casting rules."""

from __future__ import annotations

import numpy as np
from pyspark.sql import types as T

#: The element types in the order of their kinds, with bits.
KINDS = {"bool": 0, "uint8": 1, "int8": 1, "int16": 1, "int32": 1, "int64": 1, "float32": 2, "float64": 2, "complex64": 3, "complex128": 3}
SPARK = {"bool": "boolean", "uint8": "smallint", "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "float32": "float", "float64": "double", "complex64": "struct<re:float,im:float>", "complex128": "struct<re:double,im:double>"}
ALIASES = {"bool_": "bool", "?": "bool", "ubyte": "uint8", "u1": "uint8", "byte": "int8", "i1": "int8", "short": "int16", "i2": "int16", "int": "int32", "int_": "int32", "i4": "int32", "long": "int64", "i8": "int64", "float16": "float32", "half": "float32", "f2": "float32", "float": "float32", "float_": "float32", "f4": "float32", "double": "float64", "f8": "float64", "cfloat": "complex64", "csingle": "complex64", "complex": "complex64", "cdouble": "complex128"}
GROUPS = {"number": {1, 2, 3}, "integer": {1}, "signedinteger": {1}, "unsignedinteger": {1}, "floating": {2}, "complexfloating": {3}}
e, pi, inf, nan, newaxis = np.e, np.pi, np.inf, np.nan, None


def canonical(t) -> str:
    """The name of a type given by name, Python type, NumPy type or Spark type."""
    if isinstance(t, T.DataType):
        if isinstance(t, T.StructType):
            return "complex64" if isinstance(t[0].dataType, T.FloatType) else "complex128"
        return {"boolean": "bool", "tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64", "float": "float32", "double": "float64"}[t.simpleString()]
    if isinstance(t, type):
        t = {bool: "bool", int: "int32", float: "float32", complex: "complex64"}.get(t, t)
    name = t if isinstance(t, str) else np.dtype(t).name
    name = ALIASES.get(name, name)
    if name not in KINDS:
        raise TypeError(f"not an element type: {t!r}")
    return name


def numpy_type(t) -> np.dtype:
    return np.dtype(canonical(t))


def promote_types(a, b) -> str:
    """The smallest type that both go to; integers meet 32-bit floats in float32 (64-bit ones in float64)."""
    a, b = canonical(a), canonical(b)
    if a == b:
        return a
    ka, kb = KINDS[a], KINDS[b]
    if 2 in (ka, kb) and {ka, kb} & {0, 1} or 3 in (ka, kb) and {ka, kb} & {0, 1}:
        low, high = (a, b) if ka < kb else (b, a)
        return {"float32": "float64", "complex64": "complex128"}.get(high, high) if low == "int64" else high
    return np.promote_types(a, b).name


def result_type(*items) -> str:
    """The type of an operation: arrays and types come before 0-d arrays, these before Python scalars of no higher kind."""
    ranks: dict[int, str] = {}
    for x in items:
        scalar = isinstance(x, bool | int | float | complex)
        rank = 2 if scalar else 1 if getattr(x, "shape", None) == () else 0
        t = canonical(type(x)) if scalar else canonical(getattr(x, "dtype", x))
        ranks[rank] = promote_types(ranks[rank], t) if rank in ranks else t
    out = None
    for rank in sorted(ranks):
        out = ranks[rank] if out is None else out if KINDS[ranks[rank]] <= KINDS[out] else promote_types(out, ranks[rank])
    return out


def can_cast(a, b, casting: str = "intuitive") -> bool:
    """Whether a value or type may be cast: no, safe, same_kind, unsafe, or intuitive (safe, or integer to a float of as many bits)."""
    if casting not in ("no", "safe", "same_kind", "unsafe", "intuitive"):
        raise ValueError(f"unknown casting rule {casting!r}")
    a, b = canonical(type(a) if isinstance(a, bool | int | float | complex) else getattr(a, "dtype", a)), canonical(b)
    if casting == "no":
        return a == b
    if casting == "unsafe":
        return True
    if np.can_cast(a, b, "safe"):
        return True
    if casting == "same_kind":
        return bool(np.can_cast(a, b, "same_kind"))
    return casting == "intuitive" and (a, b) in {("int32", "float32"), ("int32", "complex64")}


def issubdtype(a, b) -> bool:
    a = canonical(a)
    if b in GROUPS:
        return KINDS[a] in GROUPS[b] and not (b == "signedinteger" and a == "uint8") and not (b == "unsignedinteger" and a != "uint8")
    return a == canonical(b)


def is_exact(t) -> bool:
    return KINDS[canonical(t)] < 2


def is_inexact(t) -> bool:
    return KINDS[canonical(t)] > 1


def is_real_floating(t) -> bool:
    return KINDS[canonical(t)] == 2


def is_complex(t) -> bool:
    return KINDS[canonical(t)] == 3


def at_least_float(t) -> str:
    t = canonical(t)
    return t if is_inexact(t) else "float64" if t == "int64" else "float32"


class finfo:
    def __new__(cls, t):
        if not is_inexact(t):
            raise TypeError(f"not a floating type: {t}")
        return np.finfo(numpy_type(t))


class iinfo:
    def __new__(cls, t):
        return np.iinfo(numpy_type(t))
