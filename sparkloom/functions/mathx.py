"""Math functions: null for what is no number and for NaN."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def real(x: Column) -> Column:
    """The number, or null."""
    d = x.try_cast("double")
    return F.when(~F.isnan(d), d)


def _guard(y: Column) -> Column:
    return F.when(~F.isnan(y), y)


#: Functions of one REAL argument.
UNARY = {n: getattr(F, n) for n in ("acos", "acosh", "asin", "asinh", "atan", "atanh", "cos", "cosh", "degrees", "exp", "radians", "sin", "sinh", "sqrt", "tan", "tanh")}


def unary(name: str, x: Column) -> Column:
    """A function by its name; outside its domain null."""
    d = real(x)
    if name in ("ln", "log10", "log2"):
        return F.when(d > 0, {"ln": F.ln, "log10": F.log10, "log2": F.log2}[name](d))
    return _guard(UNARY[name](d))


def log(x: Column, base: Column | None = None) -> Column:
    """log(X) is base 10; log(B, X) is null for a base of 1 or less."""
    if base is None:
        return unary("log10", x)
    return F.when((real(base) > 0) & (real(base) != 1) & (real(x) > 0), F.ln(real(x)) / F.ln(real(base)))


def trunc(x: Column) -> Column:
    """Towards zero; REAL stays REAL."""
    d = real(x)
    return F.when(d < 0, -F.floor(-d)).otherwise(F.floor(d)).cast("double")


def ceil(x: Column) -> Column:
    return F.ceil(real(x)).cast("double")


def floor(x: Column) -> Column:
    return F.floor(real(x)).cast("double")


def mod(x: Column, y: Column) -> Column:
    """C's fmod: REAL, null for 0."""
    return F.try_mod(real(x), real(y))


def gcd(a: Column, b: Column) -> Column:
    """The greatest common divisor, by as many Euclidean steps as 64-bit integers can need."""
    start = F.struct(F.abs(a.cast("long")).alias("a"), F.abs(b.cast("long")).alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.try_mod(s["a"], s["b"]).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step, lambda s: s["a"])


def lcm(a: Column, b: Column) -> Column:
    g = gcd(a, b)
    return F.when(g == 0, F.lit(0).cast("long")).otherwise(F.abs(a.cast("long") * F.call_function("div", b.cast("long"), F.when(g != 0, g))))
