"""Functions that SQL text can call, defined in SQL: Catalyst inlines them, so they cost what their bodies do.

Time values are timestamps without time zone, held to the microsecond; durations are
nanoseconds. Decimal functions work on 38 digits with 10 behind the point.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
_T, _D = "TIMESTAMP_NTZ", "DECIMAL(38,10)"
_STEP = "greatest(1L, ns div 1000)"

#: Parameters, type of the result, and body of each function.
DEFINITIONS: dict[str, tuple[str, str, str]] = {
    # times from parts, from counts since 1970, and back
    "time_now": ("", _T, "CAST(current_timestamp() AS TIMESTAMP_NTZ)"),
    "time_date": ("y INT, m INT, d INT, h INT DEFAULT 0, mi INT DEFAULT 0, s DOUBLE DEFAULT 0", _T, "make_timestamp_ntz(y, m, d, h, mi, s)"),
    "time_unix": ("s BIGINT, ns BIGINT DEFAULT 0", _T, f"timestampadd(MICROSECOND, s * 1000000 + ns div 1000, {_EPOCH})"),
    "time_milli": ("ms BIGINT", _T, f"timestampadd(MICROSECOND, ms * 1000, {_EPOCH})"),
    "time_micro": ("us BIGINT", _T, f"timestampadd(MICROSECOND, us, {_EPOCH})"),
    "time_nano": ("ns BIGINT", _T, f"timestampadd(MICROSECOND, ns div 1000, {_EPOCH})"),
    "time_to_micro": (f"t {_T}", "BIGINT", f"timestampdiff(MICROSECOND, {_EPOCH}, t)"),
    "time_to_unix": (f"t {_T}", "BIGINT", "CAST(floor(time_to_micro(t) / 1000000) AS BIGINT)"),
    "time_to_milli": (f"t {_T}", "BIGINT", "CAST(floor(time_to_micro(t) / 1000) AS BIGINT)"),
    "time_to_nano": (f"t {_T}", "BIGINT", "time_to_micro(t) * 1000"),
    # fields
    "time_get_year": (f"t {_T}", "INT", "year(t)"),
    "time_get_month": (f"t {_T}", "INT", "month(t)"),
    "time_get_day": (f"t {_T}", "INT", "day(t)"),
    "time_get_hour": (f"t {_T}", "INT", "hour(t)"),
    "time_get_minute": (f"t {_T}", "INT", "minute(t)"),
    "time_get_second": (f"t {_T}", "INT", "second(t)"),
    "time_get_nano": (f"t {_T}", "BIGINT", "pmod(time_to_micro(t), 1000000L) * 1000"),
    "time_get_weekday": (f"t {_T}", "INT", "dayofweek(t) - 1"),
    "time_get_yearday": (f"t {_T}", "INT", "dayofyear(t)"),
    "time_get_isoyear": (f"t {_T}", "INT", "extract(YEAROFWEEK FROM t)"),
    "time_get_isoweek": (f"t {_T}", "INT", "weekofyear(t)"),
    "time_get": (
        f"t {_T}, field STRING", "BIGINT",
        "CASE lower(field) WHEN 'millennium' THEN year(t) div 1000 WHEN 'century' THEN year(t) div 100 WHEN 'decade' THEN year(t) div 10 WHEN 'year' THEN year(t) WHEN 'quarter' THEN quarter(t)"
        " WHEN 'month' THEN month(t) WHEN 'day' THEN day(t) WHEN 'hour' THEN hour(t) WHEN 'minute' THEN minute(t) WHEN 'second' THEN second(t) WHEN 'milli' THEN pmod(time_to_micro(t), 1000000L) div 1000"
        " WHEN 'micro' THEN pmod(time_to_micro(t), 1000000L) WHEN 'isoyear' THEN extract(YEAROFWEEK FROM t) WHEN 'isoweek' THEN weekofyear(t) WHEN 'isodow' THEN weekday(t) + 1 WHEN 'yearday' THEN dayofyear(t)"
        " WHEN 'weekday' THEN dayofweek(t) - 1 WHEN 'epoch' THEN time_to_unix(t) END",
    ),
    # comparison
    "time_after": (f"t {_T}, u {_T}", "BOOLEAN", "t > u"),
    "time_before": (f"t {_T}, u {_T}", "BOOLEAN", "t < u"),
    "time_equal": (f"t {_T}, u {_T}", "BOOLEAN", "t = u"),
    "time_compare": (f"t {_T}, u {_T}", "INT", "CASE WHEN t < u THEN -1 WHEN t > u THEN 1 WHEN t = u THEN 0 END"),
    # durations
    "dur_ns": ("", "BIGINT", "1L"),
    "dur_us": ("", "BIGINT", "1000L"),
    "dur_ms": ("", "BIGINT", "1000000L"),
    "dur_s": ("", "BIGINT", "1000000000L"),
    "dur_m": ("", "BIGINT", "60000000000L"),
    "dur_h": ("", "BIGINT", "3600000000000L"),
    "time_add": (f"t {_T}, ns BIGINT", _T, "timestampadd(MICROSECOND, ns div 1000, t)"),
    "time_sub": (f"t {_T}, u {_T}", "BIGINT", "timestampdiff(MICROSECOND, u, t) * 1000"),
    "time_since": (f"t {_T}", "BIGINT", "time_sub(time_now(), t)"),
    "time_until": (f"t {_T}", "BIGINT", "time_sub(t, time_now())"),
    # a day that the month doesn't have becomes its last
    "time_add_date": (f"t {_T}, y INT, m INT DEFAULT 0, d BIGINT DEFAULT 0", _T, "timestampadd(DAY, d, timestampadd(MONTH, m, timestampadd(YEAR, y, t)))"),
    "time_floor": (f"t {_T}, ns BIGINT", _T, f"time_micro(time_to_micro(t) - pmod(time_to_micro(t), {_STEP}))"),
    "time_trunc_field": (
        f"t {_T}, field STRING", _T,
        "CASE lower(field) WHEN 'millennium' THEN make_timestamp_ntz(year(t) div 1000 * 1000, 1, 1, 0, 0, 0) WHEN 'century' THEN make_timestamp_ntz(year(t) div 100 * 100, 1, 1, 0, 0, 0)"
        " WHEN 'decade' THEN make_timestamp_ntz(year(t) div 10 * 10, 1, 1, 0, 0, 0) ELSE CAST(date_trunc(lower(field), t) AS TIMESTAMP_NTZ) END",
    ),
    "time_round": (f"t {_T}, ns BIGINT", _T, f"time_floor(timestampadd(MICROSECOND, {_STEP} div 2, t), ns)"),
    # text
    "time_offset_text": ("s INT", "STRING", "concat(if(s < 0, '-', '+'), lpad(abs(s) div 3600, 2, '0'), ':', lpad(abs(s) % 3600 div 60, 2, '0'))"),
    "time_fmt_datetime": (f"t {_T}, s INT DEFAULT 0", "STRING", "date_format(timestampadd(SECOND, s, t), 'yyyy-MM-dd HH:mm:ss')"),
    "time_fmt_date": (f"t {_T}, s INT DEFAULT 0", "STRING", "date_format(timestampadd(SECOND, s, t), 'yyyy-MM-dd')"),
    "time_fmt_time": (f"t {_T}, s INT DEFAULT 0", "STRING", "date_format(timestampadd(SECOND, s, t), 'HH:mm:ss')"),
    "time_fmt_iso": (
        f"t {_T}, s INT DEFAULT 0", "STRING",
        "concat(time_fmt_date(t, s), 'T', time_fmt_time(t, s), if(time_get_nano(t) = 0, '', concat('.', lpad(time_get_nano(t), 9, '0'))), if(s = 0, 'Z', time_offset_text(s)))",
    ),
    "time_parse": (
        "x STRING", _T,
        r"CASE WHEN x RLIKE '^\\d{4}-\\d{2}-\\d{2}T.*(Z|[-+]\\d{2}:\\d{2})$' THEN to_utc_timestamp(TRY_CAST(x AS TIMESTAMP), current_timezone()) WHEN x RLIKE '^\\d{4}-\\d{2}-\\d{2}( \\d{2}:\\d{2}:\\d{2})?$' THEN TRY_CAST(x AS TIMESTAMP_NTZ)"
        r" WHEN x RLIKE '^\\d{2}:\\d{2}:\\d{2}$' THEN TRY_CAST(concat('0001-01-01 ', x) AS TIMESTAMP_NTZ) END",
    ),
    # the text of a time value: a date, with or without a time, a time of 2000-01-01, or a Julian day
    "time_value": (
        "x STRING", _T,
        r"CASE WHEN x RLIKE '^\\s*\\d{2}:\\d{2}' THEN TRY_CAST(concat('2000-01-01 ', trim(x)) AS TIMESTAMP_NTZ) WHEN x RLIKE '^\\s*[0-9]+([.][0-9]+)?\\s*$' THEN time_micro(CAST(round((TRY_CAST(x AS DECIMAL(28,10)) - 2440587.5BD) * 86400000) * 1000 AS BIGINT))"
        " WHEN lower(x) = 'now' THEN time_now() ELSE TRY_CAST(x AS TIMESTAMP_NTZ) END",
    ),
    "time_plus_months": (f"t {_T}, m INT", _T, "timestampadd(MICROSECOND, timestampdiff(MICROSECOND, CAST(date_trunc('month', t) AS TIMESTAMP_NTZ), t), timestampadd(MONTH, m, CAST(date_trunc('month', t) AS TIMESTAMP_NTZ)))"),
    "time_months_between": (f"hi {_T}, lo {_T}", "INT", "CAST((year(hi) - year(lo)) * 12 + month(hi) - month(lo) AS INT)"),
    "time_whole_months": (f"hi {_T}, lo {_T}, m INT", "INT", "CASE WHEN time_plus_months(lo, m) <= hi THEN m WHEN time_plus_months(lo, m - 1) <= hi THEN m - 1 ELSE m - 2 END"),
    "time_diff_text": (
        "sign STRING, m INT, ms BIGINT", "STRING",
        "concat(sign, lpad(m div 12, 4, '0'), '-', lpad(m % 12, 2, '0'), '-', lpad(ms div 86400000, 2, '0'), ' ', lpad(ms % 86400000 div 3600000, 2, '0'), ':', lpad(ms % 3600000 div 60000, 2, '0'), ':', lpad(ms % 60000 div 1000, 2, '0'), '.', lpad(ms % 1000, 3, '0'))",
    ),
    "time_diff_ordered": (f"sign STRING, hi {_T}, lo {_T}, m INT", "STRING", "time_diff_text(sign, m, timestampdiff(MICROSECOND, time_plus_months(lo, m), hi) div 1000)"),
    "time_diff_of": (f"sign STRING, hi {_T}, lo {_T}", "STRING", "time_diff_ordered(sign, hi, lo, time_whole_months(hi, lo, time_months_between(hi, lo)))"),
    "timediff": ("a STRING, b STRING", "STRING", "CASE WHEN time_value(a) >= time_value(b) THEN time_diff_of('+', time_value(a), time_value(b)) WHEN time_value(a) < time_value(b) THEN time_diff_of('-', time_value(b), time_value(a)) END"),
    # decimals
    "numeric_encode": ("x STRING", _D, f"TRY_CAST(x AS {_D})"),
    "numeric_decode": (f"x {_D}", "STRING", r"regexp_replace(regexp_replace(CAST(x AS STRING), '(\\.[0-9]*?)0+$', '$1'), '\\.$', '')"),
    "numeric_add": (f"a {_D}, b {_D}", _D, f"CAST(a + b AS {_D})"),
    "numeric_sub": (f"a {_D}, b {_D}", _D, f"CAST(a - b AS {_D})"),
    "numeric_mul": (f"a {_D}, b {_D}", _D, f"CAST(a * b AS {_D})"),
    "numeric_div": (f"a {_D}, b {_D}", _D, f"CAST(try_divide(a, b) AS {_D})"),
    "numeric_lt": (f"a {_D}, b {_D}", "BOOLEAN", "a < b"),
    "numeric_eq": (f"a {_D}, b {_D}", "BOOLEAN", "a = b"),
    # values
    "boolean_to_int": ("x BOOLEAN", "INT", "CAST(x AS INT)"),
    "int_to_boolean": ("x INT", "BOOLEAN", "CAST(x AS BOOLEAN)"),
    "booleq": ("a STRING, b STRING", "INT", "CAST(a <=> b AS INT)"),
    "boolne": ("a STRING, b STRING", "INT", "CAST(NOT (a <=> b) AS INT)"),
    "validate_ipaddr": (
        "x STRING", "STRING",
        r"CASE WHEN x IS NULL OR x RLIKE '^((25[0-5]|2[0-4]\\d|1?\\d?\\d)(\\.(?!$)|$)){4}$' OR (x RLIKE '^[0-9A-Fa-f:]+$' AND x LIKE '%:%:%' AND size(split(x, ':')) <= 8 AND NOT x RLIKE '[0-9A-Fa-f]{5}') THEN x ELSE raise_error(concat('invalid IP address: ', x)) END",
    ),
    "random_integer": ("", "BIGINT", "xxhash64(uuid())"),
    "randomblob": ("n INT", "BINARY", "unhex(substr(array_join(transform(sequence(0, (greatest(1, n) - 1) div 16), i -> replace(uuid(), '-', '')), ''), 1, 2 * greatest(1, n)))"),
    "uuid4": ("", "BINARY", "unhex(replace(uuid(), '-', ''))"),
    "zeroblob": ("n INT", "BINARY", "unhex(repeat('00', n))"),
    "unistr_quote": (
        "x STRING", "STRING",
        # control characters as \\u00xx
        r"CASE WHEN x IS NULL THEN 'NULL' WHEN x RLIKE '[\\x01-\\x1f]' THEN concat('unistr(''', array_join(transform(split(replace(replace(x, '\\', '\\\\'), '''', ''''''), ''), c -> if(c RLIKE '[\\x01-\\x1f]', concat('\\u00', lower(lpad(hex(ascii(c)), 2, '0'))), c)), ''), ''')') ELSE concat('''', replace(x, '''', ''''''), '''') END",
    ),
    "json_error_text": ("j STRING", "STRING", "CASE WHEN j IS NOT NULL AND try_parse_json(j) IS NULL THEN 'malformed JSON' END"),
    "fuzzy_soundex": ("x STRING", "STRING", "soundex(x)"),
    # metadata in the dialect of another server
    "format_type": (
        "oid INT, mod INT DEFAULT -1", "STRING",
        # fixed values: the type numbers of that server's catalogue
        "CASE oid WHEN 16 THEN 'boolean' WHEN 17 THEN 'bytea' WHEN 18 THEN '\"char\"' WHEN 19 THEN 'name' WHEN 20 THEN 'bigint' WHEN 21 THEN 'smallint' WHEN 23 THEN 'integer' WHEN 25 THEN 'text' WHEN 26 THEN 'oid' WHEN 114 THEN 'json'"
        " WHEN 700 THEN 'real' WHEN 701 THEN 'double precision' WHEN 1000 THEN 'boolean[]' WHEN 1007 THEN 'integer[]' WHEN 1009 THEN 'text[]' WHEN 1022 THEN 'double precision[]'"
        " WHEN 1042 THEN concat('character', if(mod > 4, concat('(', mod - 4, ')'), '')) WHEN 1043 THEN concat('character varying', if(mod > 4, concat('(', mod - 4, ')'), ''))"
        " WHEN 1082 THEN 'date' WHEN 1083 THEN 'time without time zone' WHEN 1114 THEN 'timestamp without time zone' WHEN 1184 THEN 'timestamp with time zone' WHEN 1186 THEN 'interval'"
        " WHEN 1700 THEN concat('numeric', if(mod > 4, concat('(', shiftright(mod - 4, 16) & 65535, ',', (mod - 4) & 65535, ')'), '')) WHEN 2205 THEN 'regclass' WHEN 2206 THEN 'regtype' WHEN 2278 THEN 'void' WHEN 2950 THEN 'uuid' WHEN 3802 THEN 'jsonb' ELSE 'unknown' END",
    ),
    "pg_get_userbyid": ("oid INT", "STRING", "current_user()"),
    "pg_table_is_visible": ("oid INT", "INT", "1"),
    "pg_type_is_visible": ("oid INT", "INT", "1"),
    "pg_function_is_visible": ("oid INT", "INT", "1"),
    "pg_encoding_to_char": ("n INT", "STRING", "CASE n WHEN 0 THEN 'SQL_ASCII' ELSE 'UTF8' END"),
    "clock_timestamp": ("", "STRING", "date_format(current_timestamp(), 'yyyy-MM-dd HH:mm:ss.SSS')"),
    "transaction_timestamp": ("", "STRING", "clock_timestamp()"),
    "statement_timestamp": ("", "STRING", "clock_timestamp()"),
}

_NAME = re.compile(r"\b([a-z]\w+)\s*\(")
_installed: dict[str, set[str]] = {}


def install(spark: SparkSession, text: str | None = None) -> SparkSession:
    """Makes the functions that ``text`` names (default: all) callable in the session's SQL, once."""
    have = _installed.setdefault(spark._jsparkSession.sessionUUID(), set())

    def add(name: str) -> None:
        if name not in have:
            have.add(name)
            parameters, result, body = DEFINITIONS[name]
            needed(body)
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")

    def needed(body: str) -> None:
        for name in _NAME.findall(body.lower()):
            if name in DEFINITIONS:
                add(name)

    if text is None:
        for name in DEFINITIONS:
            add(name)
    else:
        needed(text)
    return spark
