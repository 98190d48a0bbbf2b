"""Elementwise functions as Column expressions, with IEEE results where Spark's own differ.

``UFUNCS[name]`` is (builder, operands, identity).  Everything stays inside code generation; each guard exists because
Spark raises or returns NULL where an array engine returns inf, nan or 0.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _d(x: Column) -> Column:
    return x.cast("double")


def _log(x: Column, f: Callable[[Column], Column] = F.log, zero: float = 0.0) -> Column:
    x = _d(x)
    return F.when(F.isnan(x), NAN).when(x > zero, f(x)).when(x == zero, -INF).otherwise(F.when(x.isNull(), None).otherwise(NAN))


def _divide(a: Column, b: Column) -> Column:
    a, b = _d(a), _d(b)
    return F.when(b != 0, a / b).when(b.isNull() | a.isNull(), None).when(F.isnan(a) | (a == 0), NAN).otherwise(F.signum(a) * F.when(b.cast("string") == "-0.0", -INF).otherwise(INF))


def _remainder(a: Column, b: Column) -> Column:
    r = a % F.nullif(b, F.lit(0))
    return F.when(b == 0, 0).when((r != 0) & ((r < 0) != (b < 0)), r + b).otherwise(r)


def _floor_divide(a: Column, b: Column) -> Column:
    """Toward minus infinity; 0 for a zero divisor, like integer arrays.  Exact for all 64-bit operands.

    ``a`` less the remainder is a multiple of ``b``; what double division misses of the quotient is a
    multiple too, and small enough to be divided exactly.
    """
    whole = a - _remainder(a, b)
    near = lambda x: F.floor(_d(x) / F.nullif(_d(b), F.lit(0.0)) + 0.5)
    return F.when(b == 0, 0).otherwise(near(whole) + near(whole - near(whole) * b))


def _propagate(pick: Callable[..., Column]) -> Callable[[Column, Column], Column]:
    return lambda a, b: F.when(F.isnan(_d(a)) | F.isnan(_d(b)), F.lit(NAN)).otherwise(pick(a, b))


def _keep_number(pick: Callable[..., Column]) -> Callable[[Column, Column], Column]:
    return lambda a, b: pick(F.nanvl(_d(a), _d(b)), F.nanvl(_d(b), _d(a)))


def _round_half_even(x: Column) -> Column:
    return F.rint(_d(x))


def _trunc(x: Column) -> Column:
    x = _d(x)
    return F.when(F.abs(x) >= 2.0**53, x).when(x < 0, _d(F.ceil(x))).otherwise(_d(F.floor(x)))


def _whole(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """floor and ceil that keep huge, infinite and nan values as they are."""
    return lambda x: F.when((F.abs(_d(x)) < 2.0**53), _d(f(_d(x)))).otherwise(_d(x))


def _shift(left: bool) -> Callable[[Column, Column], Column]:
    def f(a: Column, b: Column) -> Column:
        wide = (b < 0) | (b >= 64)
        amount = F.when(wide, 0).otherwise(b).cast("int")
        moved = F.call_function("shiftleft" if left else "shiftright", a.cast("long"), amount)
        return F.when(wide, 0 if left else F.when(a < 0, -1).otherwise(0)).otherwise(moved)

    return f


def _equal(a: Column, b: Column) -> Column:
    """NaN equals nothing; other types compare as they are."""
    return F.when(F.isnan(_d(a)) | F.isnan(_d(b)), False).otherwise(a == b)


def _logaddexp(base: float) -> Callable[[Column, Column], Column]:
    k = math.log(base)

    def f(a: Column, b: Column) -> Column:
        a, b = _d(a), _d(b)
        top, low = F.greatest(a, b), F.least(a, b)
        return F.when(top == -INF, -INF).otherwise(top + F.log1p(F.exp((low - top) * k)) / k)

    return f


def _gcd(a: Column, b: Column) -> Column:
    """Euclid's algorithm unrolled as a fold of 92 steps, the most that 64-bit operands need."""
    start = F.struct(F.abs(a).cast("long").alias("x"), F.abs(b).cast("long").alias("y"))
    step = lambda acc, _: F.when(acc["y"] == 0, acc).otherwise(F.struct(acc["y"].alias("x"), (acc["x"] % F.nullif(acc["y"], F.lit(0))).alias("y")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step, lambda acc: acc["x"])


def _lcm(a: Column, b: Column) -> Column:
    g = _gcd(a, b)
    return F.when(g == 0, 0).otherwise(F.abs(a).cast("long") / F.nullif(g, F.lit(0)) * F.abs(b)).cast("long")


def _frexp(x: Column) -> Column:
    x = _d(x)
    e = (F.floor(F.log2(F.abs(x))) + 1).cast("int")
    e = F.when(F.abs(x) / F.pow(F.lit(2.0), e) >= 1, e + 1).when(F.abs(x) / F.pow(F.lit(2.0), e) < 0.5, e - 1).otherwise(e)
    odd = (x == 0) | F.isnan(x) | (F.abs(x) == INF)
    return F.struct(F.when(odd, x).otherwise(x / F.pow(F.lit(2.0), e)).alias("mantissa"), F.when(odd, 0).otherwise(e).alias("exponent"))


def _modf(x: Column) -> Column:
    whole = _trunc(x)
    return F.struct(F.when(F.abs(_d(x)) == INF, 0.0).otherwise(_d(x) - whole).alias("fraction"), whole.alias("whole"))


def _gap(x: Column) -> Column:
    """Distance from a positive number to the next larger one."""
    e = F.floor(F.log2(F.nullif(x, F.lit(0.0)))).cast("double")
    e = F.when(F.pow(F.lit(2.0), e) > x, e - 1).when(F.pow(F.lit(2.0), e + 1) <= x, e + 1).otherwise(e)
    return F.when(F.isnan(x) | (x == INF), NAN).when(x == 0, 5e-324).otherwise(F.pow(F.lit(2.0), F.greatest(e, F.lit(-1022.0)) - 52))


def _spacing(x: Column) -> Column:
    x = _d(x)
    return F.when(x < 0, -_gap(-x)).otherwise(_gap(F.abs(x)))


def _nextafter(a: Column, b: Column) -> Column:
    a, b = _d(a), _d(b)
    size = F.abs(a)
    gap = _gap(size)
    inward = (b < a) == (a > 0)
    power = (size == F.pow(F.lit(2.0), F.round(F.log2(F.nullif(size, F.lit(0.0)))))) & (gap > 5e-324)
    step = F.when(power & inward, gap / 2).otherwise(gap)
    moved = F.when(size == INF, F.signum(a) * 1.7976931348623157e308).when(b > a, a + step).otherwise(a - step)
    return F.when(F.isnan(a) | F.isnan(b), NAN).when(a == b, b).otherwise(moved)


def _sign(x: Column) -> Column:
    return F.when(F.isnan(_d(x)), NAN).otherwise(F.signum(_d(x)))


def _power(a: Column, b: Column) -> Column:
    return F.pow(_d(a), _d(b))


def _bits(op: str) -> Callable[[Column, Column], Column]:
    return lambda a, b: getattr(a, op)(b)


_ONE = {
    "absolute": F.abs, "arccos": F.acos, "arccosh": lambda x: F.acosh(_d(x)), "arcsin": F.asin, "arcsinh": lambda x: F.asinh(_d(x)), "arctan": F.atan,
    "arctanh": lambda x: F.when(F.abs(_d(x)) == 1, F.signum(_d(x)) * INF).when(F.abs(_d(x)) > 1, NAN).otherwise(F.atanh(_d(x))),
    "bitwise_count": lambda x: F.bit_count(F.abs(x)), "cbrt": lambda x: F.cbrt(_d(x)), "ceil": _whole(F.ceil), "conjugate": lambda x: x, "cos": F.cos, "cosh": F.cosh,
    "deg2rad": F.radians, "exp": F.exp, "exp2": lambda x: F.pow(F.lit(2.0), _d(x)), "expm1": F.expm1, "fabs": lambda x: F.abs(_d(x)), "floor": _whole(F.floor),
    "frexp": _frexp, "invert": lambda x: F.bitwise_not(x), "isfinite": lambda x: ~F.isnan(_d(x)) & (F.abs(_d(x)) != INF), "isinf": lambda x: F.abs(_d(x)) == INF, "isnan": lambda x: F.isnan(_d(x)), "isnat": lambda x: x.isNull(),
    "log": lambda x: _log(x), "log10": lambda x: _log(x, F.log10), "log1p": lambda x: _log(x, F.log1p, -1.0), "log2": lambda x: _log(x, F.log2), "logical_not": lambda x: x == 0,
    "modf": _modf, "negative": lambda x: -x, "positive": lambda x: x, "rad2deg": F.degrees, "reciprocal": lambda x: _divide(F.lit(1.0), x), "rint": _round_half_even,
    "sign": _sign, "signbit": lambda x: (_d(x) < 0) | (_d(x).cast("string") == "-0.0"), "sin": F.sin, "sinh": F.sinh, "spacing": _spacing, "sqrt": lambda x: F.sqrt(_d(x)),
    "square": lambda x: x * x, "tan": F.tan, "tanh": F.tanh, "trunc": _trunc,
}
_TWO = {
    "add": (lambda a, b: a + b, 0), "arctan2": (F.atan2, None), "bitwise_and": (_bits("bitwiseAND"), -1), "bitwise_or": (_bits("bitwiseOR"), 0), "bitwise_xor": (_bits("bitwiseXOR"), 0),
    "copysign": (lambda a, b: F.when(_ONE["signbit"](b), -F.abs(_d(a))).otherwise(F.abs(_d(a))), None), "divide": (_divide, None),
    "divmod": (lambda a, b: F.struct(_floor_divide(a, b).alias("quotient"), _remainder(a, b).alias("remainder")), None), "equal": (_equal, None),
    "float_power": (_power, None), "floor_divide": (_floor_divide, None), "fmax": (_keep_number(F.greatest), None), "fmin": (_keep_number(F.least), None),
    "fmod": (lambda a, b: F.when(b == 0, NAN).otherwise(_d(a) % F.nullif(_d(b), F.lit(0.0))), None), "gcd": (_gcd, 0), "greater": (lambda a, b: ~F.isnan(_d(a)) & ~F.isnan(_d(b)) & (a > b), None),
    "greater_equal": (lambda a, b: ~F.isnan(_d(a)) & ~F.isnan(_d(b)) & (a >= b), None), "heaviside": (lambda a, b: F.when(F.isnan(_d(a)), NAN).when(a == 0, b).when(a < 0, 0.0).otherwise(1.0), None),
    "hypot": (F.hypot, 0), "lcm": (_lcm, None), "ldexp": (lambda a, b: _d(a) * F.pow(F.lit(2.0), _d(b)), None), "left_shift": (_shift(True), None),
    "less": (lambda a, b: ~F.isnan(_d(a)) & ~F.isnan(_d(b)) & (a < b), None), "less_equal": (lambda a, b: ~F.isnan(_d(a)) & ~F.isnan(_d(b)) & (a <= b), None),
    "logaddexp": (_logaddexp(math.e), -INF), "logaddexp2": (_logaddexp(2.0), -INF), "logical_and": (lambda a, b: (a != 0) & (b != 0), True), "logical_or": (lambda a, b: (a != 0) | (b != 0), False),
    "logical_xor": (lambda a, b: (a != 0) != (b != 0), False), "maximum": (_propagate(F.greatest), None), "minimum": (_propagate(F.least), None), "multiply": (lambda a, b: a * b, 1),
    "nextafter": (_nextafter, None), "not_equal": (lambda a, b: ~_equal(a, b), None), "power": (_power, None), "remainder": (_remainder, None), "right_shift": (_shift(False), None), "subtract": (lambda a, b: a - b, None),
    "vecdot": (lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: _d(x) * _d(y)), F.lit(0.0), lambda s, x: s + x), None),
}
ALIASES = {
    "abs": "absolute", "acos": "arccos", "acosh": "arccosh", "asin": "arcsin", "asinh": "arcsinh", "atan": "arctan", "atan2": "arctan2", "atanh": "arctanh", "bitwise_invert": "invert", "bitwise_not": "invert",
    "bitwise_left_shift": "left_shift", "bitwise_right_shift": "right_shift", "conj": "conjugate", "degrees": "rad2deg", "mod": "remainder", "pow": "power", "radians": "deg2rad", "true_divide": "divide",
}
UFUNCS: dict[str, tuple[Callable[..., Column], int, object]] = {k: (f, 1, None) for k, f in _ONE.items()} | {k: (f, 2, i) for k, (f, i) in _TWO.items()}
UFUNCS |= {a: UFUNCS[n] for a, n in ALIASES.items()}


def ufunc(name: str, *operands) -> Column:
    build, n, _ = UFUNCS[name]
    if len(operands) != n:
        raise TypeError(f"{name} takes {n} operands")
    return build(*[_c(x) for x in operands])


def isclose(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8, equal_nan: bool = False) -> Column:
    a, b = _d(a), _d(b)
    near = F.when(F.isnan(a) | F.isnan(b), F.lit(equal_nan) & F.isnan(a) & F.isnan(b)).when((F.abs(a) == INF) | (F.abs(b) == INF), a == b)
    return near.otherwise(F.abs(a - b) <= atol + rtol * F.abs(b))


def clip(x: Column, low=None, high=None) -> Column:
    x = x if low is None else ufunc("maximum", x, low)
    return x if high is None else ufunc("minimum", x, high)


def around(x: Column, decimals: int = 0) -> Column:
    return F.bround(x, decimals)


def fix(x: Column) -> Column:
    return _trunc(x)


def sinc(x: Column) -> Column:
    y = _d(x) * math.pi
    return F.when(y == 0, 1.0).otherwise(F.sin(y) / F.nullif(y, F.lit(0.0)))


def i0(x: Column) -> Column:
    """Modified Bessel function of order 0 by its power series; 60 terms reach double precision up to |x| about 30."""
    q = _d(x) * _d(x) / 4
    terms = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")), lambda acc, k: F.struct((acc["t"] * q / (k * k)).alias("t"), (acc["s"] + acc["t"] * q / (k * k)).alias("s")))
    return terms["s"]


def nan_to_num(x: Column, nan: float = 0.0, posinf: float = 1.7976931348623157e308, neginf: float = -1.7976931348623157e308) -> Column:
    x = _d(x)
    return F.when(F.isnan(x), nan).when(x == INF, posinf).when(x == -INF, neginf).otherwise(x)


def isposinf(x: Column) -> Column:
    return _d(x) == INF


def isneginf(x: Column) -> Column:
    return _d(x) == -INF


def base_repr(x: Column, base: int = 2) -> Column:
    return F.concat(F.when(x < 0, "-").otherwise(""), F.conv(F.abs(x).cast("string"), 10, base))


def binary_repr(x: Column, width: int) -> Column:
    return F.lpad(F.when(x < 0, F.substring(F.bin(x.cast("long")), 65 - width, width)).otherwise(F.bin(x.cast("long"))), width, "0")


# Complex numbers: struct<re, im>.
def cplx(re, im=0.0) -> Column:
    return F.struct(_d(_c(re)).alias("re"), _d(_c(im)).alias("im"))


def cadd(a: Column, b: Column) -> Column:
    return cplx(a["re"] + b["re"], a["im"] + b["im"])


def cmul(a: Column, b: Column) -> Column:
    return cplx(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def cabs(a: Column) -> Column:
    return F.hypot(a["re"], a["im"])


def angle(a: Column, deg: bool = False) -> Column:
    out = F.atan2(a["im"], a["re"])
    return F.degrees(out) if deg else out


def cconj(a: Column) -> Column:
    return cplx(a["re"], -a["im"])


# emath: real input, complex result where the real function is undefined.
def esqrt(x: Column) -> Column:
    return F.when(x < 0, cplx(0.0, F.sqrt(-_d(x)))).otherwise(cplx(F.sqrt(F.abs(_d(x)))))


def elog(x: Column, base: float = math.e) -> Column:
    return cplx(_log(F.abs(x)) / math.log(base), F.when(x < 0, math.pi / math.log(base)).otherwise(0.0))


def epower(x: Column, p: float) -> Column:
    size = F.pow(F.abs(_d(x)), F.lit(float(p)))
    return F.when(x < 0, cplx(size * math.cos(math.pi * p), size * math.sin(math.pi * p))).otherwise(cplx(size))
