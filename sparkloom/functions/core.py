"""Scalar functions with the semantics of an embedded SQL database, built from Spark's own expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_NUMBER = r"^[ \t\n\f\r]*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"


def number(x: Column) -> Column:
    """Text as a number: its longest numeric prefix, or 0."""
    return F.when(x.isNotNull(), F.coalesce(F.regexp_extract(x.cast("string"), _NUMBER, 1).try_cast("double"), F.lit(0.0)))


def cast_integer(x: Column) -> Column:
    """CAST(x AS INTEGER): towards zero, held at the ends of 64 bits; text by its prefix, null stays null."""
    d = number(x)
    top, low = F.lit(9223372036854775807), F.lit(-9223372036854775808).cast("long")
    exact = F.regexp_extract(x.cast("string"), r"^[ \t\n\f\r]*([+-]?[0-9]+)(?![0-9.eE])", 1).try_cast("long")
    return F.when(x.isNull(), F.lit(None).cast("long")).when(exact.isNotNull(), exact).when(d >= 9.223372036854775e18, top).when(d <= -9.223372036854775e18, low).otherwise(d.try_cast("long"))


def add(x: Column, y: Column) -> Column:
    """x + y of integers as a VARIANT: an integer, or REAL where it overflows."""
    return F.coalesce(F.try_add(x, y).cast("variant"), (x.cast("double") + y.cast("double")).cast("variant"))


def divide(x: Column, y: Column, integers: bool = False) -> Column:
    """x / y: null for y = 0; towards zero for integers."""
    if integers:
        return F.when(y != 0, F.call_function("div", x.cast("long"), F.when(y != 0, y.cast("long"))))
    return F.try_divide(x.cast("double"), y.cast("double"))


def modulo(x: Column, y: Column) -> Column:
    """x % y of operands cast to integers: null for y = 0."""
    return F.try_mod(x.cast("long"), y.cast("long"))


def shift_left(x: Column, k: Column) -> Column:
    """x << k; a negative count shifts to the right, 64 or more leaves 0 or, to the right, the sign."""
    sign = F.when(x < 0, F.lit(-1)).otherwise(F.lit(0)).cast("long")
    k = k.cast("int")
    left = F.call_function("shiftleft", x, F.greatest(k, F.lit(0)))
    right = F.call_function("shiftright", x, F.greatest(-k, F.lit(0)))
    return F.when(k >= 64, F.lit(0).cast("long")).when(k >= 0, left).when(k > -64, right).otherwise(sign)


def shift_right(x: Column, k: Column) -> Column:
    return shift_left(x, -k)


def glob_regex(pattern: str) -> str:
    """A GLOB pattern as a regular expression: ``*``, ``?`` and ``[...]`` (``[^...]`` negates)."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (end := pattern.find("]", i + 2 + (pattern[i + 1 : i + 2] == "^"))) > 0:
            body = pattern[i + 1 : end]
            negate, body = body[:1] == "^", body.lstrip("^") if body[:1] == "^" else body
            out += "[" + "^" * negate + body.replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&") + "]"
            i = end
        else:
            out += "\\" + c if not c.isalnum() and c.isascii() else c
        i += 1
    return f"(?s)\\A{out}\\z"


def glob(pattern: str, x: Column) -> Column:
    return x.rlike(glob_regex(pattern))


def to_char(x: Column, fmt: str) -> Column:
    """A number by a format of 9s and 0s; a 0 in the last place shows a zero that 9s would leave blank."""
    whole = fmt.partition(".")[0]
    text = F.to_char(x, F.lit(fmt))
    return F.when(x == 0, F.lpad(F.lit("0"), len(whole), " ")).otherwise(text) if "." not in fmt and whole.startswith("9") and whole.endswith("0") else text


def similar(pattern: str, x: Column) -> Column:
    """SIMILAR TO: ``%`` and ``_`` as in LIKE, else a regular expression's brackets, alternatives and repeats."""
    regex = "".join({"%": ".*", "_": "."}.get(c, "\\" + c if c in ".^$\\" else c) for c in pattern)
    return x.rlike(f"(?s)\\A(?:{regex})\\z")


def lower(x: Column) -> Column:
    """ASCII letters in lower case."""
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def upper(x: Column) -> Column:
    return F.translate(x, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def concat(*xs: Column) -> Column:
    """Nulls count as empty."""
    return F.concat(*[F.coalesce(x.cast("string"), F.lit("")) for x in xs])


def substr(x: Column, y: Column | int, z: Column | int | None = None) -> Column:
    """substr(X, Y[, Z]): a negative Y counts from the end, a negative Z takes what is before; position 0 is before the first."""
    n = F.char_length(x)
    y = F.lit(y) if isinstance(y, int) else y
    z = F.lit(z) if isinstance(z, int) else z
    # the range of 0-based positions wanted, cut to the text
    start = F.when(y < 0, n + y).otherwise(y - 1)
    if z is None:
        a, b = F.when((y == 0), F.lit(0)).otherwise(start), n
    else:
        a = F.when(z < 0, start + z).otherwise(start)
        b = F.when(z < 0, start).otherwise(start + z)
    a, b = F.greatest(a, F.lit(0)), F.least(b, n)
    return F.when(x.isNull() | y.isNull(), None).otherwise(F.substring(x, a + 1, F.greatest(b - a, F.lit(0))))


def length(x: Column) -> Column:
    """Code points up to the first NUL."""
    return F.char_length(F.substring_index(x, "\x00", 1))


def instr(x: Column, y: Column) -> Column:
    """1-based position of y in x, 0 if it isn't there."""
    return F.call_function("instr", x, y)


def round_(x: Column, digits: int = 0) -> Column:
    """Always REAL, half away from zero; negative digits count as 0."""
    return F.round(x.cast("double"), max(0, min(30, digits)))


def sign(x: Column) -> Column:
    """-1, 0 or 1; null for what is no number."""
    return F.signum(x.try_cast("double")).cast("long")


def scalar_max(*xs: Column) -> Column:
    """The greatest, or null if any is null."""
    return F.when(_any_null(xs), None).otherwise(F.greatest(*xs))


def scalar_min(*xs: Column) -> Column:
    return F.when(_any_null(xs), None).otherwise(F.least(*xs))


def _any_null(xs) -> Column:
    out = xs[0].isNull()
    for x in xs[1:]:
        out = out | x.isNull()
    return out


def quote(x: Column, kind: str = "text") -> Column:
    """A SQL literal of the value."""
    if kind == "blob":
        text = F.concat(F.lit("X'"), F.hex(x), F.lit("'"))
    elif kind == "text":
        text = F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("''")), F.lit("'"))
    else:
        text = x.cast("string")
    return F.coalesce(text, F.lit("NULL"))


def unhex(x: Column, ignore: str = "") -> Column:
    """Hex as a blob; null if malformed, leaving out the characters of ``ignore``."""
    return F.try_to_binary(F.translate(x, ignore, "") if ignore else x, F.lit("hex"))


def char(*codes: Column) -> Column:
    """Text of code points, by way of UTF-32."""
    hexes = F.concat(*[F.lpad(F.hex(c.cast("long")), 8, "0") for c in codes])
    return F.decode(F.unhex(hexes), "UTF-32")


def soundex(x: Column) -> Column:
    """Soundex; ``?000`` for what has no ASCII letter."""
    return F.when(x.isNull() | ~x.rlike("[A-Za-z]") | ~x.rlike(r"\A[\x00-\x7F]*\z"), F.lit("?000")).otherwise(F.soundex(F.regexp_replace(x, "[^A-Za-z]", "")))


def zeroblob(n: Column) -> Column:
    return F.unhex(F.repeat(F.lit("00"), n))
