"""Element-wise functions of arrays, made from the column functions by rule; operators and in-place forms."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from ..array import Array, elementwise, lift
from ..functions import expr
from ..functions import types as ty

COMPLEX = {"add": expr.cadd, "sub": expr.csub, "mul": expr.cmul, "div": expr.cdiv, "exp": expr.cexp, "abs": expr.cabs, "absolute": expr.cabs, "sign": expr.csign, "sgn": expr.csign, "neg": lambda z: expr.complex_(-z.re, -z.im), "pos": lambda z: z, "eq": lambda x, y: (x.re == y.re) & (x.im == y.im), "ne": lambda x, y: (x.re != y.re) | (x.im != y.im)}
FLAGGED = {"bitwise_and", "bitwise_or", "bitwise_xor", "invert"}


def out_type(name: str, *types: str) -> str:
    t = functools.reduce(ty.promote_types, types)
    if name in expr.BOOLEAN:
        return "bool"
    if name in ("abs", "absolute") and ty.is_complex(t):
        return "float32" if t == "complex64" else "float64"
    return ty.at_least_float(t) if name in expr.FLOATING else t


def _make(name: str, many: int):
    f = getattr(expr, name)

    def call(*args, out=None, where=True, dtype=None, **more):
        operands, rest = args[:many], args[many:]
        if not any(isinstance(x, Array) for x in operands):
            raise TypeError(f"{name} needs an array")
        like = next(x for x in operands if isinstance(x, Array))
        arrays = [lift(x, like) for x in operands]
        t = ty.result_type(*[x if not isinstance(x, Array) and isinstance(x, bool | int | float | complex) else a for x, a in zip(operands, arrays, strict=True)])
        if name in expr.EXACT and not ty.is_exact(t):
            raise TypeError(f"{name} takes integers or booleans, not {t}")
        if ty.is_complex(t):
            g = COMPLEX.get(name)
            if g is None:
                raise TypeError(f"{name} takes no complex numbers")
            arrays = [a.astype(t) for a in arrays]
        elif name in FLAGGED:
            g = functools.partial(f, boolean=t == "bool")
        elif name in ("floordiv", "remainder", "fmod", "minimum") and ty.is_exact(t):
            g = functools.partial(f, exact=True)
        else:
            g = f
            if name in ("add", "sub", "mul", "neg") and t in ("bool",):
                t = "int32"
            if name in ("add", "sub", "mul"):  # in the promoted type, so nothing overflows before
                cast = ty.SPARK[t]
                g = lambda *v: f(*[x.cast(cast) for x in v])
        res = elementwise(lambda *v: g(*v, *rest, **more), *arrays, dtype=dtype or out_type(name, t), where=where)
        return res

    call.__name__ = call.__qualname__ = name
    call.__doc__ = f.__doc__ or f"Element-wise {name}, with broadcasting; ``where`` keeps the first operand where it is false."
    return call


for _name in expr.UNARY:
    globals()[_name] = _make(_name, 1)
for _name in expr.BINARY:
    globals()[_name] = _make(_name, 2)
for _alias, _name in expr.ALIASES.items():
    globals()[_alias] = globals()[_name]


def divmod(x, y, **more):  # noqa: A001
    return globals()["floordiv"](x, y, **more), globals()["remainder"](x, y, **more)


def modf(x):
    whole = globals()["trunc"](x)
    frac = x.with_value(expr.modf(x.value).fraction, whole.dtype)
    return frac, whole


def conjugate(x):
    return x.apply(expr.conjugate) if ty.is_complex(x.dtype) else x


conj = conjugate


def real(x):
    return x.real


def imag(x):
    return x.imag


def angle(x, deg: bool = False):
    if ty.is_complex(x.dtype):
        return x.apply(lambda v: expr.angle(v, deg), "float64" if x.dtype == "complex128" else "float32")
    return x.apply(lambda v: F.when(v < 0, 180.0 if deg else ty.pi).otherwise(0.0), "float64")


def iscomplex(x):
    return x.apply(lambda v: expr.iscomplex(v, ty.is_complex(x.dtype)), "bool")


def isreal(x):
    return x.apply(lambda v: expr.isreal(v, ty.is_complex(x.dtype)), "bool")


def where(cond, x=None, y=None):
    """x where cond holds, else y; with cond alone its non-zero places."""
    if x is None and y is None:
        return nonzero(cond)
    like = next(a for a in (cond, x, y) if isinstance(a, Array))
    a, b = lift(x, like), lift(y, like)
    t = ty.result_type(x if not isinstance(x, Array) else a, y if not isinstance(y, Array) else b)
    return elementwise(expr.where, cond, a, b, dtype=t)


def nonzero(x) -> Array:
    """Coordinates of the non-zero cells, (n, ndim), in row-major order."""
    from ..array import idx, linear, number_rows

    rows = x.cells().where(expr.truth(F.col("v"))).select(linear(x.shape).alias("_at"), F.array(*idx(x.ndim)).alias("at"))
    n = number_rows(rows, ["_at"])
    cells = n.select(F.col("row_id").alias("i0"), F.posexplode("at").alias("i1", "v")).select("i0", F.col("i1").cast("bigint").alias("i1"), "v")
    return Array(cells, (rows.count(), x.ndim), "int64")


def equal(x, y) -> bool:
    """Whether shapes and all elements are equal; arrays of one element compare as scalars."""
    if isinstance(x, Array) and isinstance(y, Array) and x.shape != y.shape and 1 not in (x.size, y.size):
        return False
    return bool(globals()["eq"](x, y).reduce(lambda v: F.coalesce(F.bool_and(v), F.lit(True)), "bool"))


def allclose(x, y, rtol: float = 1e-5, atol: float = 1e-8, equal_nan: bool = False) -> bool:
    near = globals()["isclose"](x, y, rtol, atol, equal_nan)
    return bool(near.reduce(lambda v: F.coalesce(F.bool_and(v), F.lit(True)), "bool"))


def _bind() -> None:
    hooks = {"add": "add", "sub": "sub", "mul": "mul", "truediv": "div", "floordiv": "floordiv", "mod": "remainder", "pow": "pow", "and": "bitwise_and", "or": "bitwise_or", "xor": "bitwise_xor", "lshift": "left_shift", "rshift": "right_shift", "eq": "eq", "ne": "ne", "lt": "lt", "le": "le", "gt": "gt", "ge": "ge"}
    for hook, name in hooks.items():
        f = globals()[name]
        setattr(Array, f"__{hook}__", lambda a, b, f=f: f(a, b))
        if hook not in ("eq", "ne", "lt", "le", "gt", "ge"):
            setattr(Array, f"__r{hook}__", lambda a, b, f=f: f(lift(b, a), a))
            setattr(Array, f"__i{hook}__", lambda a, b, f=f: f(a, b).astype(a.dtype))
    Array.__hash__ = object.__hash__
    Array.__neg__, Array.__pos__, Array.__invert__, Array.__abs__ = (globals()[n] for n in ("neg", "pos", "invert", "abs"))
    Array.__divmod__ = divmod
    for name in [*expr.UNARY, *expr.BINARY, *expr.ALIASES]:
        if not hasattr(Array, name):
            setattr(Array, name, globals()[name])
        # the trailing form keeps the first operand's type and shape; arrays don't change, so it returns the new one
        setattr(Array, f"{name}_", lambda a, *b, f=globals()[name], **m: f(a, *b, **m).astype(a.dtype))
    for name in ("modf", "conj", "conjugate", "nonzero", "allclose", "angle"):
        setattr(Array, name, globals()[name])


_bind()
