"""Functions that need a value's own text or bytes: printf, escapes, byte access, phonetics."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, functions as F

from .ext import _map

_SPEC = re.compile(r"%([-+ 0#,!]*)(\*|\d+)?(?:\.(\*|\d+))?(?:ll|l|h)?([diufeEgGxXoscqQwr%n])")


def format_text(fmt: str, *args) -> str:
    """printf of the embedded dialect: %q doubles quotes, %Q quotes too (NULL for null), %w doubles double quotes, %r is an ordinal, ``,`` groups digits."""
    rest = list(args)

    def take(default=None):
        return rest.pop(0) if rest else default

    def integer(v) -> int:
        if isinstance(v, str):
            m = re.match(r"\s*[+-]?\d+", v)
            return int(m[0]) if m else 0
        return int(v or 0)

    def one(m: re.Match) -> str:
        flags, width, precision, kind = m.groups()
        if kind == "%":
            return "%"
        width = integer(take()) if width == "*" else int(width or 0)
        precision = integer(take()) if precision == "*" else None if precision is None else int(precision)
        if kind == "n":
            return ""
        v = take()
        if kind in "diu":
            n = integer(v)
            body = f"{abs(n):,}" if "," in flags else str(abs(n))
            out = ("-" if n < 0 else "+" if "+" in flags else " " if " " in flags else "") + body
        elif kind in "feEgG":
            x = float(v) if isinstance(v, (int, float)) else float(m2[0]) if isinstance(v, str) and (m2 := re.match(r"\s*[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?", v, re.I)) else 0.0
            out = format(x, ("+" if "+" in flags else "") + ("," if "," in flags else "") + f".{6 if precision is None else precision}" + kind)
        elif kind in "xXo":
            out = format(integer(v) & (1 << 64) - 1, kind)
            out = ("0x" if "#" in flags and kind in "xX" else "") + out
        elif kind == "r":
            n = integer(v)
            out = f"{n}{'th' if 10 <= abs(n) % 100 <= 20 else {1: 'st', 2: 'nd', 3: 'rd'}.get(abs(n) % 10, 'th')}"
        else:
            text = "" if v is None else str(v)
            if kind == "c":
                text = text[:1]
            elif precision is not None:
                text = text[:precision]
            out = {"q": text.replace("'", "''"), "Q": "NULL" if v is None else "'" + text.replace("'", "''") + "'", "w": text.replace('"', '""')}.get(kind, text)
        if "-" in flags:
            return out.ljust(width)
        if "0" in flags and kind in "diufeEgGxXo" and len(out) < width:
            sign = out[:1] if out[:1] in "+-" else ""
            return sign + out[len(sign) :].rjust(width - len(sign), "0")
        return out.rjust(width)

    return _SPEC.sub(one, fmt)


def printf(fmt: str, *xs: Column) -> Column:
    """printf over Arrow batches; null arguments format as nothing (%Q: NULL)."""
    if not xs:
        return F.lit(format_text(fmt))

    @F.pandas_udf("string")
    def run(*cs: pd.Series) -> pd.Series:
        return pd.Series([format_text(fmt, *[None if v is None or v != v else v for v in row]) for row in zip(*cs)])

    return run(*xs)


def unistr(x: Column) -> Column:
    """``\\\\XXXX``, ``\\\\+XXXXXX``, ``\\\\uXXXX`` and ``\\\\UXXXXXXXX`` as characters; a double backslash as one."""
    return _map("string", decode_escapes, x)


def decode_escapes(v: str) -> str:
    return re.sub(r"\\(?:\\|\+([0-9A-Fa-f]{6})|u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|([0-9A-Fa-f]{4}))", lambda m: chr(int(next(g for g in m.groups() if g), 16)) if any(m.groups()) else "\\", v)


def get_byte(b: Column, at: int) -> Column:
    return F.conv(F.hex(F.substring(b, at + 1, 1)), 16, 10).cast("int")


def set_byte(b: Column, at: int, value: int) -> Column:
    return F.overlay(b, F.lit(bytes([value])), at + 1, 1)


def typeof(df, column: str) -> Column:
    """null, integer, real, text or blob, by the column's type and the value's being null."""
    kind = df.schema[column].dataType.simpleString()
    name = "integer" if kind in ("tinyint", "smallint", "int", "bigint", "boolean") else "real" if kind in ("float", "double") or kind.startswith("decimal") else "blob" if kind == "binary" else "text"
    return F.when(F.col(column).isNull(), "null").otherwise(name)


def array_set_element(a: Column, i: int, v: Column) -> Column:
    """A copy with element i (from 1) replaced."""
    return F.transform(a, lambda x, k: F.when(k == i - 1, v).otherwise(x))


def string_to_array(s: Column, sep: str | None, null: str | None = None) -> Column:
    """Pieces between separators (none: single characters); those equal to ``null`` become null."""
    out = F.split(s, "" if sep is None else re.escape(sep).replace("\\ ", " "), -1)
    if sep is None:
        out = F.filter(out, lambda x: x != "")
    return out if null is None else F.transform(out, lambda x: F.nullif(x, F.lit(null)))


#: Fixed values of refined Soundex: the digit of each letter from A to Z.
_REFINED = "01360240043788015936020505"


def refined_soundex(word: str) -> str:
    letters = [c for c in word.upper() if "A" <= c <= "Z"]
    if not letters:
        return ""
    digits = [_REFINED[ord(c) - 65] for c in letters]
    return letters[0] + "".join(d for k, d in enumerate(digits) if not k or d != digits[k - 1])


def fuzzy_rsoundex(x: Column) -> Column:
    return _map("string", refined_soundex, x)


#: Script codes by the Unicode block of a text's letters, in the order in which they are tried.
_SCRIPTS = ((215, r"\p{IsLatin}"), (200, r"\p{IsGreek}"), (220, r"\p{IsCyrillic}"), (125, r"\p{IsHebrew}"), (160, r"\p{IsArabic}"))


def fuzzy_script(x: Column) -> Column:
    """The script of a text's letters: 998 where there are several, 999 where there is none known."""
    hits = [(code, x.rlike(pattern).cast("int")) for code, pattern in _SCRIPTS]
    out = F.lit(999)
    for code, hit in reversed(hits):
        out = F.when(hit == 1, code).otherwise(out)
    return F.when(sum((h for _, h in hits), F.lit(0)) > 1, 998).otherwise(out)


def translit(x: Column) -> Column:
    """Latin letters without their marks."""
    import unicodedata

    return _map("string", lambda v: "".join(c for c in unicodedata.normalize("NFKD", v.replace("ß", "ss").replace("æ", "ae").replace("ø", "o")) if not unicodedata.combining(c)), x)


#: Fixed values of Caverphone: its replacements in order, as regular expressions.
_CAVERPHONE = (
    ("[^a-z]", ""), ("e$", ""), ("^cough", "cou2f"), ("^rough", "rou2f"), ("^tough", "tou2f"), ("^enough", "enou2f"), ("^trough", "trou2f"), ("^gn", "2n"), ("mb$", "m2"),
    ("cq", "2q"), ("ci", "si"), ("ce", "se"), ("cy", "sy"), ("tch", "2ch"), ("[cqx]", "k"), ("v", "f"), ("dg", "2g"), ("tio", "sio"), ("tia", "sia"), ("d", "t"), ("ph", "fh"), ("b", "p"), ("sh", "s2"), ("z", "s"),
    ("^[aeiou]", "A"), ("[aeiou]", "3"), ("j", "y"), ("^y3", "Y3"), ("^y", "A"), ("y", "3"), ("3gh3", "3kh3"), ("gh", "22"), ("g", "k"),
    ("s+", "S"), ("t+", "T"), ("p+", "P"), ("k+", "K"), ("f+", "F"), ("m+", "M"), ("n+", "N"), ("w3", "W3"), ("wh3", "Wh3"), ("w$", "3"), ("w", "2"), ("^h", "A"), ("h", "2"),
    ("r3", "R3"), ("r$", "3"), ("r", "2"), ("l3", "L3"), ("l$", "3"), ("l", "2"), ("2", ""), ("3$", "A"), ("3", ""),
)


def caverphone(x: Column) -> Column:
    """Caverphone of a word in lower case: ten characters; an empty text has none."""
    out = x
    for old, new in _CAVERPHONE:
        out = F.regexp_replace(out, old, new)
    return F.when(x == "", "").otherwise(F.rpad(out, 10, "1"))
