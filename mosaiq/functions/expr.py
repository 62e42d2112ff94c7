"""Element-wise functions of columns. Pure: Column (or literal) in, Column out; usable on any DataFrame.

They follow IEEE arithmetic where Spark doesn't: no NULL or error for x / 0 or log(0), NaN equals nothing, order
comparisons with NaN are false. Complex numbers are structs of re and im. NULL stays NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")


def c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def d(x) -> Column:
    return c(x).cast("double")


def guarded(x: Column, then: Column) -> Column:
    """NaN where x is NaN, else ``then``."""
    return F.when(F.isnan(x), F.lit(NAN)).otherwise(then)


# arithmetic


def add(x, y):
    return c(x) + c(y)


def sub(x, y):
    return c(x) - c(y)


def mul(x, y):
    return c(x) * c(y)


def signbit(x):
    """Whether the sign bit is set; also of -0.0."""
    return (c(x) < 0) | ((c(x) == 0) & d(x).cast("string").startswith("-"))


def div(x, y):
    """True division: infinities and NaN by zero."""
    x, y = d(x), d(y)
    return F.when(y == 0, x * F.when(signbit(y), F.lit(-INF)).otherwise(F.lit(INF))).otherwise(x / F.when(y == 0, F.lit(1.0)).otherwise(y))


def floor(x):
    x = d(x)
    return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)


def ceil(x):
    x = d(x)
    return F.when(F.abs(x) < 2.0**52, F.ceil(x).cast("double")).otherwise(x)


def trunc(x):
    return F.when(d(x) < 0, ceil(x)).otherwise(floor(x))


def remainder(x, y, exact: bool = False):
    """Modulo with the divisor's sign. ``exact``: integers; then NULL for a zero divisor."""
    if exact:
        y = F.nullif(c(y), F.lit(0))
        return ((c(x) % y) + y) % y
    return F.when(d(y) == 0, F.lit(NAN)).otherwise(d(x) - d(y) * floor(div(x, y)))


def floordiv(x, y, exact: bool = False):
    if exact:
        return F.call_function("div", c(x) - remainder(x, y, True), F.nullif(c(y), F.lit(0)))
    return floor(div(x, y))


def divmod(x, y, exact: bool = False):  # noqa: A001
    return F.struct(floordiv(x, y, exact).alias("quotient"), remainder(x, y, exact).alias("remainder"))


def fmod(x, y, exact: bool = False):
    """Remainder with the dividend's sign."""
    if exact:
        return c(x) % F.nullif(c(y), F.lit(0))
    return F.when(d(y) == 0, F.lit(NAN)).otherwise(d(x) - d(y) * trunc(div(x, y)))


def neg(x):
    return -c(x)


def pos(x):
    return c(x)


def pow(x, y):  # noqa: A001
    return F.pow(d(x), d(y))


def copysign(x, y):
    return F.abs(d(x)) * F.when(signbit(y), F.lit(-1.0)).otherwise(F.lit(1.0))


def hypot(x, y):
    return F.hypot(d(x), d(y))


def gcd(x, y):
    """Greatest common divisor, by Euclid's steps folded over a fixed sequence (64-bit numbers need under 93)."""
    start = F.struct(F.abs(c(x).cast("bigint")).alias("a"), F.abs(c(y).cast("bigint")).alias("b"))
    step = lambda s, _: F.when(s.b == 0, s).otherwise(F.struct(s.b.alias("a"), (s.a % F.when(s.b == 0, F.lit(1)).otherwise(s.b)).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(93)), start, step, lambda s: s.a)


def lcm(x, y):
    g = gcd(x, y)
    return F.when(g == 0, F.lit(0).cast("bigint")).otherwise(F.call_function("div", F.abs(c(x).cast("bigint")), F.when(g == 0, F.lit(1)).otherwise(g)) * F.abs(c(y).cast("bigint")))


def nan_to_num(x, nan: float = 0.0, posinf: float | None = None, neginf: float | None = None):
    x = d(x)
    top = 1.7976931348623157e308
    return F.when(F.isnan(x), F.lit(float(nan))).when(x == INF, F.lit(top if posinf is None else float(posinf))).when(x == -INF, F.lit(-top if neginf is None else float(neginf))).otherwise(x)


# bits


def bitwise_and(x, y, boolean: bool = False):
    return c(x) & c(y) if boolean else c(x).bitwiseAND(c(y))


def bitwise_or(x, y, boolean: bool = False):
    return c(x) | c(y) if boolean else c(x).bitwiseOR(c(y))


def bitwise_xor(x, y, boolean: bool = False):
    return c(x) != c(y) if boolean else c(x).bitwiseXOR(c(y))


def invert(x, boolean: bool = False):
    return ~c(x) if boolean else F.bitwise_not(c(x))


def left_shift(x, y):
    return F.call_function("shiftleft", c(x), c(y).cast("int"))


def right_shift(x, y):
    return F.call_function("shiftright", c(x), c(y).cast("int"))


# exponents, logarithms, trigonometry


def _log(f, zero: float = 0.0):
    def out(x):
        x = d(x)
        inside = F.when(x > zero, x).otherwise(F.lit(1.0))
        return F.when(F.isnan(x) | (x < zero), F.lit(NAN)).when(x == zero, F.lit(-INF)).otherwise(f(inside))

    return out


def _unary(f):
    return lambda x: f(d(x))


exp, expm1, sqrt = _unary(F.exp), _unary(F.expm1), _unary(F.sqrt)
log, log2, log10, log1p = _log(F.log), _log(F.log2), _log(F.log10), _log(F.log1p, -1.0)
sin, cos, tan, sinh, cosh, tanh = (_unary(f) for f in (F.sin, F.cos, F.tan, F.sinh, F.cosh, F.tanh))
arcsin, arccos, arctan, asinh, acosh, atanh = (_unary(f) for f in (F.asin, F.acos, F.atan, F.asinh, F.acosh, F.atanh))
deg2rad = radians = _unary(F.radians)
rad2deg = degrees = _unary(F.degrees)


def exp2(x):
    return F.pow(F.lit(2.0), d(x))


def square(x):
    return d(x) * d(x)


def arctan2(x, y):
    """Angle of (y, x) in its quadrant; signs of zeros count."""
    x, y = d(x), d(y)
    flat = F.when(signbit(y), F.lit(3.141592653589793)).otherwise(F.lit(0.0))
    return F.when((x == 0) & ~F.isnan(y), F.when(signbit(x), -flat).otherwise(flat)).otherwise(F.atan2(x, y))


def logaddexp(x, y):
    x, y = d(x), d(y)
    return F.when(x == y, x + 0.6931471805599453).otherwise(F.greatest(x, y) + F.log1p(F.exp(-F.abs(x - y))))


def logaddexp2(x, y):
    x, y = d(x), d(y)
    return F.when(x == y, x + 1.0).otherwise(F.greatest(x, y) + F.log1p(F.pow(F.lit(2.0), -F.abs(x - y))) / 0.6931471805599453)


# rounding


def abs(x):  # noqa: A001
    return F.abs(c(x))


absolute = abs


def fabs(x):
    return F.abs(d(x))


def clip(x, low=None, high=None):
    if low is None and high is None:
        raise ValueError("either low or high must be given")
    out = c(x)
    out = out if high is None else F.least(out, c(high))
    out = out if low is None else F.greatest(out, c(low))
    return F.when(F.isnan(d(x)), d(x)).otherwise(out)


def modf(x):
    whole = trunc(x)
    return F.struct(F.when(F.abs(d(x)) == INF, F.lit(0.0)).otherwise(d(x) - whole).alias("fraction"), whole.alias("integral"))


def round(x, decimals: int = 0):  # noqa: A001
    """To the nearest, ties to even, after scaling by 10**decimals."""
    x = d(x)
    scaled = x * float(10**decimals)
    near = F.when(F.abs(scaled) < 2.0**52, F.rint(scaled)).otherwise(scaled)
    return near / float(10**decimals)


def sign(x):
    return F.signum(d(x))


sgn = sign


# complex numbers


def complex_(re, im=0.0):
    return F.struct(d(re).alias("re"), d(im).alias("im"))


def real(z, is_complex: bool = True):
    return c(z).re if is_complex else c(z)


def imag(z, is_complex: bool = True):
    return c(z).im if is_complex else F.lit(0.0)


def conjugate(z):
    return complex_(z.re, -z.im)


conj = conjugate


def angle(z, deg: bool = False):
    a = F.atan2(z.im, z.re)
    return F.degrees(a) if deg else a


def cabs(z):
    return F.hypot(z.re, z.im)


def cadd(x, y):
    return complex_(x.re + y.re, x.im + y.im)


def csub(x, y):
    return complex_(x.re - y.re, x.im - y.im)


def cmul(x, y):
    return complex_(x.re * y.re - x.im * y.im, x.re * y.im + x.im * y.re)


def cdiv(x, y):
    n = y.re * y.re + y.im * y.im
    return complex_(div(x.re * y.re + x.im * y.im, n), div(x.im * y.re - x.re * y.im, n))


def cexp(z):
    return complex_(F.exp(z.re) * F.cos(z.im), F.exp(z.re) * F.sin(z.im))


def csign(z):
    n = cabs(z)
    return complex_(F.when(n == 0, 0.0).otherwise(z.re / F.nullif(n, F.lit(0.0))), F.when(n == 0, 0.0).otherwise(z.im / F.nullif(n, F.lit(0.0))))


def iscomplex(z, is_complex: bool = True):
    return z.im != 0 if is_complex else F.lit(False)


def isreal(z, is_complex: bool = True):
    return z.im == 0 if is_complex else F.lit(True)


# predicates


def isnan(x):
    return F.isnan(d(x))


def isinf(x):
    return F.abs(d(x)) == INF


def isfinite(x):
    return ~(isnan(x) | isinf(x))


def isposinf(x):
    return d(x) == INF


def isneginf(x):
    return d(x) == -INF


def _either(x, y):
    return isnan(x) | isnan(y)


def eq(x, y):
    return (c(x) == c(y)) & ~_either(x, y)


def ne(x, y):
    return (c(x) != c(y)) | _either(x, y)


def lt(x, y):
    return (c(x) < c(y)) & ~_either(x, y)


def le(x, y):
    return (c(x) <= c(y)) & ~_either(x, y)


def gt(x, y):
    return (c(x) > c(y)) & ~_either(x, y)


def ge(x, y):
    return (c(x) >= c(y)) & ~_either(x, y)


def truth(x):
    return d(x) != 0


def logical_and(x, y):
    return truth(x) & truth(y)


def logical_or(x, y):
    return truth(x) | truth(y)


def logical_xor(x, y):
    return truth(x) != truth(y)


def logical_not(x):
    return ~truth(x)


def isclose(x, y, rtol: float = 1e-5, atol: float = 1e-8, equal_nan: bool = False):
    x, y = d(x), d(y)
    near = F.when(isinf(x) | isinf(y), x == y).otherwise(F.abs(x - y) <= atol + rtol * F.abs(y))
    return F.when(_either(x, y), isnan(x) & isnan(y) if equal_nan else F.lit(False)).otherwise(near)


def where(cond, x, y):
    """x where cond is true and not 0; the branch that isn't chosen doesn't leak in."""
    return F.when(c(cond).cast("boolean"), c(x)).otherwise(c(y))


def maximum(x, y):
    return F.greatest(c(x), c(y))


def minimum(x, y, exact: bool = False):
    if exact:
        return F.least(c(x), c(y))
    return F.when(_either(x, y), F.lit(NAN)).otherwise(F.least(c(x), c(y)))


def bucketize(x, boundaries: list[float], right: bool = False):
    """Place among ascending boundaries: how many are less than x (``right``: at most x)."""
    b = F.array(*[F.lit(float(v)) for v in boundaries])
    inside = F.filter(b, lambda v: v <= d(x)) if right else F.filter(b, lambda v: v < d(x))
    return F.size(inside)


def digitize(x, bins: list[float], right: bool = False):
    if len(bins) > 1 and bins[0] > bins[-1]:
        return F.lit(len(bins)) - bucketize(x, list(bins)[::-1], not right)
    return bucketize(x, list(bins), not right)


UNARY = ("neg", "pos", "invert", "exp", "expm1", "exp2", "log", "log2", "log10", "log1p", "sqrt", "square", "arccos", "acosh", "arcsin", "asinh", "arctan", "atanh", "cos", "cosh", "deg2rad", "degrees", "rad2deg", "radians", "sin", "sinh", "tan", "tanh", "abs", "absolute", "ceil", "fabs", "floor", "round", "sgn", "sign", "trunc", "clip", "nan_to_num", "isfinite", "isinf", "isnan", "isneginf", "isposinf", "logical_not", "signbit")
BINARY = ("add", "sub", "mul", "div", "floordiv", "remainder", "fmod", "pow", "copysign", "hypot", "gcd", "lcm", "bitwise_and", "bitwise_or", "bitwise_xor", "left_shift", "right_shift", "arctan2", "logaddexp", "logaddexp2", "eq", "ne", "lt", "le", "gt", "ge", "logical_and", "logical_or", "logical_xor", "isclose", "maximum", "minimum")
#: Other names of the same functions.
ALIASES = {"acos": "arccos", "arccosh": "acosh", "asin": "arcsin", "arcsinh": "asinh", "atan": "arctan", "atan2": "arctan2", "arctanh": "atanh", "divide": "div", "floor_divide": "floordiv", "bitwise_not": "invert", "bitwise_invert": "invert", "multiply": "mul", "negative": "neg", "positive": "pos", "power": "pow", "mod": "remainder", "subtract": "sub", "bitwise_left_shift": "left_shift", "bitwise_right_shift": "right_shift", "greater_equal": "ge", "greater": "gt", "less_equal": "le", "less": "lt", "not_equal": "ne"}
BOOLEAN = {"eq", "ne", "lt", "le", "gt", "ge", "logical_and", "logical_or", "logical_xor", "logical_not", "isclose", "isfinite", "isinf", "isnan", "isneginf", "isposinf", "signbit"}
EXACT = {"bitwise_and", "bitwise_or", "bitwise_xor", "invert", "left_shift", "right_shift", "gcd", "lcm"}
FLOATING = {"div", "hypot", "copysign", "arctan2", "logaddexp", "logaddexp2", "exp", "expm1", "exp2", "log", "log2", "log10", "log1p", "sqrt", "square", "arccos", "acosh", "arcsin", "asinh", "arctan", "atanh", "cos", "cosh", "deg2rad", "degrees", "rad2deg", "radians", "sin", "sinh", "tan", "tanh", "ceil", "fabs", "floor", "trunc"}
