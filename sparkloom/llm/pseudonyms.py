"""Format-preserving pseudonyms: validated numbers and dates are permuted within their format by a keyed Feistel network.

Equal values have equal pseudonyms in all documents and in all ways of writing them, so
they stay linked; the key's holder can turn pseudonyms back.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import ship

#: Used where no key is given; production runs give their own.
KEY = b"sparkloom example key"
ROUNDS = 10
#: Dates of these years are taken for dates.
FIRST, LAST = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()


def permute(key: bytes, tweak: str, x: int, size: int, back: bool = False) -> int:
    """A keyed permutation of range(size): a balanced Feistel network over enough bits, walked until it's in the range."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, width = (1 << half) - 1, (half + 7) // 8
    name = tweak.encode()

    def f(r: int, v: int) -> int:
        return int.from_bytes(blake2b(bytes([r]) + v.to_bytes(width, "big") + name, key=key[:64], digest_size=max(width, 8)).digest(), "big") & mask

    while True:
        a, b = x >> half, x & mask
        if back:
            for r in reversed(range(ROUNDS)):
                a, b = b ^ f(r, a), a
        else:
            for r in range(ROUNDS):
                a, b = b, a ^ f(r, b)
        x = a << half | b
        if x < size:
            return x


def luhn(digits: str) -> int:
    """What the digits and their doubles sum to, modulo 10: 0 for a valid number."""
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(digits))) % 10


def _fill(shape: str, digits: str) -> str:
    """The digits of ``shape`` replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


@dataclass(frozen=True)
class Value:
    """A value found: its number in a range, and how a number of that range is written in its place (None: not in the format)."""

    kind: str
    tweak: str
    number: int
    size: int
    write: Callable[[int], str | None]


def _card(text: str) -> Value | None:
    digits = re.sub(r"\D", "", text)
    if luhn(digits) or len(set(digits)) == 1:
        return None
    n = len(digits) - 1

    def write(x: int) -> str:
        body = f"{x:0{n}d}"
        return _fill(text, body + str(-luhn(body + "0") % 10))

    return Value("card", f"card{n}", int(digits[:-1]), 10**n, write)


def _phone(text: str) -> Value | None:
    country = len(m[1]) if (m := re.match(r"\+(\d{1,3})(?=[ .(-])", text)) else 1 if text[0] == "+" else 0
    digits = re.sub(r"\D", "", text)
    n = len(digits) - country
    if not 10 <= len(digits) <= 15 or n < 7:
        return None
    return Value("phone", f"phone{n}", int(digits[country:]), 10**n, lambda x: _fill(text, digits[:country] + f"{x:0{n}d}"))


def _ip(text: str) -> Value | None:
    parts = text.split(".")
    if any(int(p) > 255 or len(p) > 1 and p[0] == "0" for p in parts):
        return None
    return Value("ip", "ip", int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, lambda x: ".".join(map(str, x.to_bytes(4, "big"))))


def _ssn(text: str) -> Value | None:
    ok = lambda s: s[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000"
    digits = text.replace("-", "")
    return Value("ssn", "ssn", int(digits), 10**9, lambda x: _fill(text, s) if ok(s := f"{x:09d}") else None) if ok(digits) else None


def _date(text: str) -> Value | None:
    mark = re.search(r"[-/.]", text)[0]
    parts = text.split(mark)
    padded = all(len(p) > 1 for p in parts)

    def order(p) -> str:
        return "ymd" if len(p[0]) == 4 else "mdy" if mark == "/" and int(p[0]) <= 12 else "dmy"

    how = order(parts)
    try:
        n = date(*(int(parts[how.index(c)]) for c in "ymd")).toordinal()
    except ValueError:
        return None
    if not FIRST <= n <= LAST:
        return None

    def write(x: int) -> str | None:
        d = date.fromordinal(FIRST + x)
        fields = {"y": f"{d.year:04d}", "m": f"{d.month:02d}" if padded else str(d.month), "d": f"{d.day:02d}" if padded else str(d.day)}
        out = [fields[c] for c in how]
        return mark.join(out) if order(out) == how and all(len(p) > 1 for p in out) == padded else None

    return Value("date", "date", n - FIRST, LAST - FIRST + 1, write)


def _email(text: str) -> Value | None:
    local, _, domain = text.partition("@")
    if len(local) > LOCAL or len(domain) > DOMAIN:
        return None
    places = [(k, 10 if c.isdigit() else 26, ord("0") if c.isdigit() else ord("a") if c.islower() else ord("A")) for k, c in enumerate(local) if c.isalnum()]
    if not re.fullmatch(r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}", domain) or len(places) < 3:
        return None
    number, size = 0, 1
    for k, radix, base in places:
        number, size = number * radix + ord(local[k]) - base, size * radix

    def write(x: int) -> str:
        out = list(local)
        for k, radix, base in reversed(places):
            x, r = divmod(x, radix)
            out[k] = chr(base + r)
        return "".join(out) + "@" + domain

    return Value("email", "email" + "".join("9" if r == 10 else "a" for _, r, _ in places), number, size, write)


#: Characters of an e-mail address before and after its @, at most, as mail systems have it.
LOCAL, DOMAIN = 64, 255
#: Runs of what numbers are written with; then the kinds, in the order in which they are tried.
_RUN = re.compile(r"[+(0-9][-+(0-9 )./]{5,}")
_NUMBER = re.compile(
    r"(?P<date>\d{4}(?P<a>[-/.])\d{1,2}(?P=a)\d{1,2}|\d{1,2}(?P<b>[-/.])\d{1,2}(?P=b)\d{4})"
    r"|(?P<ip>\d{1,3}(?:\.\d{1,3}){3})"
    r"|(?P<ssn>\d{3}-\d{2}-\d{4})"
    r"|(?P<phone>\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){2,3}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}(?P<c>[-.])\d{3}(?P=c)\d{4})"
    r"|(?P<card>\d{13,19}|\d{4}(?P<d>[ -])\d{4}(?P=d)\d{4}(?P=d)\d{4}|\d{4}(?P<e>[ -])\d{6}(?P=e)\d{5})"
)
#: Begins where a run of an address's characters does, so that a long run is read once; what follows the @ may be part of a next address.
_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[._%+-]*([A-Za-z0-9][A-Za-z0-9._%+-]*)@(?=([A-Za-z0-9][A-Za-z0-9.-]*[A-Za-z0-9]))")
_READ = {"card": _card, "phone": _phone, "ip": _ip, "ssn": _ssn, "date": _date, "email": _email}
KINDS = tuple(_READ)


def find(text: str, kinds=KINDS) -> Iterator[tuple[int, int, Value]]:
    """Valid values with their code point ranges, in order. A value doesn't touch other letters or digits."""
    found = []
    for run in _RUN.finditer(text):
        at = run.start()
        while m := _NUMBER.search(text, at, run.end()):
            s, e = m.span()
            touched = (s > 0 and (text[s - 1].isalnum() or text[s - 1] == "." and s > 1 and text[s - 2].isdigit())) or (e < len(text) and (text[e].isalnum() or text[e] in ".-/" and e + 1 < len(text) and text[e + 1].isdigit()))
            value = None if touched or m.lastgroup not in kinds else _READ[m.lastgroup](m[0])
            if value:
                found.append((s, e, value))
                at = e
            else:
                at = s + 1
                while at < len(text) and text[at - 1].isdigit() and text[at].isdigit():  # not from within a number
                    at += 1
    mails: list[tuple[int, int, Value]] = []
    for m in _EMAIL.finditer(text) if "email" in kinds and "@" in text else ():
        s, e = m.start(1), m.end(2)
        if (not mails or mails[-1][1] <= s) and (value := _email(text[s:e])):
            mails.append((s, e, value))
    return _merged(found, mails)


def _merged(numbers: list, mails: list) -> Iterator[tuple[int, int, Value]]:
    """Both lists, each in order and free of overlaps, as one; a number that overlaps an address is part of it."""
    k = 0
    for mail in mails:
        while k < len(numbers) and numbers[k][0] < mail[1]:
            if numbers[k][1] <= mail[0]:
                yield numbers[k]
            k += 1
        yield mail
    yield from numbers[k:]


@lru_cache(1 << 16)
def _moved(key: bytes, tweak: str, x: int, size: int, back: bool) -> int:
    return permute(key, tweak, x, size, back)


def pseudonym(value: Value, key: bytes, back: bool = False) -> str:
    """The value's pseudonym: walked on until it is one that the format allows."""
    x = value.number
    while True:
        x = _moved(key, value.tweak, x, value.size, back)
        if out := value.write(x):
            return out


def replace(text: str, key: bytes = KEY, kinds=KINDS, back: bool = False) -> tuple[str, list[tuple[str, int, int, str]]]:
    """The text with pseudonyms (or, ``back``, without), and each value's kind, range in the text given, and pseudonym."""
    out, spans, at = [], [], 0
    for s, e, value in find(text, kinds):
        new = pseudonym(value, key, back)
        out += [text[at:s], new]
        spans.append((value.kind, s, e, new))
        at = e
    return "".join([*out, text[at:]]), spans


def pseudonymise(docs: DataFrame, key: bytes = KEY, text: str = "text", kinds=KINDS, back: bool = False) -> DataFrame:
    """Adds _text (with pseudonyms) and _values: kind, start, end (code points of the text given) and pseudonym of each value.

    A column of ``docs`` with one of these names is replaced; others pass through.
    Null texts stay null and have no values; empty ones stay empty. What doesn't validate
    (a number whose check digit is wrong, no calendar day, an octet over 255) stays as it
    is. Each row is treated alone, so repeated rows agree, and an empty table stays empty.
    A text's time and memory grow with its length alone.
    """
    if not key:
        raise ValueError("a key is needed")
    ship(docs.sparkSession)
    rest = docs.drop("_text", "_values")
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("pseudonym", pa.string())])

    def run(batches):
        for b in batches:
            texts, values = [], []
            for t in b.column(text).to_pylist():
                new, spans = (None, []) if t is None else replace(t, key, kinds, back)
                texts.append(new)
                values.append([dict(zip(("kind", "start", "end", "pseudonym"), s)) for s in spans])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string()), pa.array(values, pa.list_(span))], [*b.schema.names, "_text", "_values"])

    spans = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("pseudonym", T.StringType())]))
    return rest.mapInArrow(run, T.StructType([*rest.schema.fields, T.StructField("_text", T.StringType()), T.StructField("_values", spans)]))


def op2_pseudonyms(spark, sf_dir: str) -> DataFrame:
    found = pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", F.size("_values").cast("long").alias("n_values"), F.sha2(F.coalesce("_text", F.lit("")), 256).alias("text_sha256"), F.col("_text").alias("text"), F.col("_values").alias("found"))
