"""Dates and times: ISO text, Julian days and epoch seconds, with the modifiers of an embedded SQL database."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

_UNITS = {"second": "seconds", "minute": "minutes", "hour": "hours", "day": "days", "month": "months", "year": "years"}
#: Formats by letter.
_FORMATS = {"d": "dd", "e": "d", "F": "yyyy-MM-dd", "H": "HH", "I": "hh", "j": "DDD", "k": "H", "l": "h", "m": "MM", "M": "mm", "p": "a", "R": "HH:mm", "S": "ss", "T": "HH:mm:ss", "Y": "yyyy"}


def stamp(x: Column, *modifiers: str, kind: str = "text") -> Column:
    """A time value (text, 'julianday', 'unixepoch' or 'auto') as a timestamp without time zone, after the modifiers.

    Text is a date with or without a time, a time of 2000-01-01, a Julian day, or 'now'.
    'auto' takes a number for a Julian day where it can be one, else for seconds.
    After a shift of months, 'floor' takes the last day of a month that lacks the day
    ('ceiling', as without either, runs over into the next).
    """
    steps = [m.strip().lower() for m in modifiers]
    if "auto" in steps:
        kind = "auto"
    if kind == "julianday":
        t = _julian(x)
    elif kind == "unixepoch":
        t = _seconds(x)
    elif kind == "auto":
        n = x.try_cast("double")
        t = F.when(n.isNull(), _text(x.cast("string"))).when((n >= 0) & (n < 5373484.5), _julian(n)).otherwise(_seconds(n))
    else:
        t = _text(x)
    for m, after in zip(steps, [*steps[1:], ""]):
        t = _modified(t, m, after == "floor")
    return t


def _julian(x: Column) -> Column:
    return F.timestamp_micros(F.round((x - 2440587.5) * 86400e3).cast("long") * 1000).cast("timestamp_ntz")


def _seconds(x: Column) -> Column:
    return F.timestamp_micros((x * 1_000_000).cast("long")).cast("timestamp_ntz")


def _text(x: Column) -> Column:
    x = F.trim(x)
    clock = F.when(x.rlike(r"^\d{2}:\d{2}"), F.concat(F.lit("2000-01-01 "), x)).otherwise(x)
    plain = F.when(F.lower(x) == "now", F.localtimestamp()).otherwise(clock.try_cast("timestamp_ntz"))
    return F.when(x.rlike(r"^\d+(\.\d+)?$"), _julian(x.try_cast("double"))).otherwise(plain)


def _modified(t: Column, m: str, clamp: bool = False) -> Column:
    if m in ("start of day", "start of month", "start of year"):
        return F.date_trunc(m[9:], t).cast("timestamp_ntz")
    if w := re.fullmatch(r"weekday ([0-6])", m):
        ahead = F.pmod(F.lit(int(w[1])) - (F.dayofweek(t) - 1), F.lit(7))
        return t + F.make_dt_interval(days=ahead)
    if w := re.fullmatch(r"([+-]?\d+(?:\.\d+)?) (second|minute|hour|day|month|year)s?", m):
        n, unit = float(w[1]), w[2]
        if unit in ("month", "year"):
            months = int(n) * (12 if unit == "year" else 1)
            return t + F.make_ym_interval(months=F.lit(months)) if clamp else _plus_months(t, months)
        seconds = n * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit]
        return t + F.make_dt_interval(secs=F.lit(seconds).cast("decimal(18,6)"))
    if w := re.fullmatch(r"([+-])(\d{4})-(\d\d)-(\d\d)(?: (\d\d):(\d\d)(?::(\d\d))?)?", m):
        sign = -1 if w[1] == "-" else 1
        months, seconds = int(w[2]) * 12 + int(w[3]), int(w[4]) * 86400 + int(w[5] or 0) * 3600 + int(w[6] or 0) * 60 + int(w[7] or 0)
        t = t + F.make_ym_interval(months=F.lit(sign * months)) if clamp else _plus_months(t, sign * months)
        return t + F.make_dt_interval(secs=F.lit(sign * seconds).cast("decimal(18,6)"))
    if w := re.fullmatch(r"([+-])(\d\d):(\d\d)(?::(\d\d))?", m):
        seconds = (int(w[2]) * 3600 + int(w[3]) * 60 + int(w[4] or 0)) * (-1 if w[1] == "-" else 1)
        return t + F.make_dt_interval(secs=F.lit(seconds).cast("decimal(18,6)"))
    if m == "localtime":
        return F.convert_timezone(F.lit("UTC"), F.current_timezone(), t)
    if m == "utc":
        return F.convert_timezone(F.current_timezone(), F.lit("UTC"), t)
    if m in ("subsec", "subsecond", "auto", "ceiling", "floor", "unixepoch", "julianday"):
        return t
    raise ValueError(f"no such modifier: {m}")


def _plus_months(t: Column, n: int) -> Column:
    """A day that the month doesn't have runs over into the next month."""
    first = F.date_trunc("month", t).cast("timestamp_ntz") + F.make_ym_interval(months=F.lit(n))
    return first + (t - F.date_trunc("month", t).cast("timestamp_ntz"))


def date(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd")


def time(t: Column, subsec: bool = False) -> Column:
    return F.date_format(t, "HH:mm:ss.SSS" if subsec else "HH:mm:ss")


def datetime(t: Column, subsec: bool = False) -> Column:
    return F.date_format(t, "yyyy-MM-dd HH:mm:ss.SSS" if subsec else "yyyy-MM-dd HH:mm:ss")


def micros(t: Column) -> Column:
    """Microseconds since 1970; the session's time zone is UTC."""
    return F.unix_micros(t.cast("timestamp"))


def julianday(t: Column) -> Column:
    return micros(t) / F.lit(86400e6) + F.lit(2440587.5)


def unixepoch(t: Column) -> Column:
    return F.floor(micros(t) / 1_000_000).cast("long")


def strftime(fmt: str, t: Column) -> Column:
    """The format's letters one by one; %s, %J, %w, %u, %U, %W, %f, %G, %V and %% as expressions."""
    out, i, literal = [], 0, ""
    while i < len(fmt):
        if fmt[i] != "%" or i + 1 == len(fmt):
            literal += fmt[i]
            i += 1
            continue
        c = fmt[i + 1]
        i += 2
        if c == "%":
            literal += "%"
            continue
        if literal:
            out.append(F.lit(literal))
            literal = ""
        monday = F.pmod(F.dayofweek(t) + 5, F.lit(7))
        week = lambda first: F.floor((F.dayofyear(t) + 6 - first) / 7)
        special = {
            "s": lambda: unixepoch(t).cast("string"), "J": lambda: julianday(t).cast("string"), "w": lambda: (F.dayofweek(t) - 1).cast("string"), "u": lambda: (monday + 1).cast("string"),
            "U": lambda: F.lpad(week(F.dayofweek(t) - 1).cast("string"), 2, "0"), "W": lambda: F.lpad(week(monday).cast("string"), 2, "0"),
            "f": lambda: F.date_format(t, "ss.SSS"), "V": lambda: F.lpad(F.weekofyear(t).cast("string"), 2, "0"), "P": lambda: F.lower(F.date_format(t, "a")),
        }
        if c == "G":
            out.append(F.date_part(F.lit("YEAROFWEEK"), t).cast("string"))
        elif c == "g":
            out.append(F.substring(F.date_part(F.lit("YEAROFWEEK"), t).cast("string"), -2, 2))
        elif c in special:
            out.append(special[c]())
        elif c in _FORMATS:
            out.append(F.date_format(t, _FORMATS[c]))
        else:
            raise ValueError(f"no such format: %{c}")
    if literal:
        out.append(F.lit(literal))
    return F.concat(*out) if out else F.lit("")


def time_trunc(t: Column, nanos: int) -> Column:
    """Down to a multiple of a duration."""
    step = max(1, nanos // 1000)
    return F.timestamp_micros(micros(t) - F.pmod(micros(t), F.lit(step))).cast("timestamp_ntz")


def time_sub(t: Column, u: Column) -> Column:
    """Nanoseconds from u to t."""
    return (micros(t) - micros(u)) * 1000


def time_compare(t: Column, u: Column) -> Column:
    return F.when(t < u, -1).when(t > u, 1).when(t == u, 0)
