"""One query for each family of the functions that SQL text can call, and for functions that no other query names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ext as X, jsonx as J, more as M
from ..operators import windows as N
from ..sources import virtual
from ..session import table
from . import dialect
from .base import run_sql, sql, views
from .registry import register

_AT = "TIMESTAMP_NTZ'2024-02-29 12:34:56.789'"

def _times(name: str, others: str, times: str, text: str, oracle: str) -> None:
    """A query whose ``times`` are shown as text to the microsecond."""
    shown = lambda f: ", ".join(f.format(c=c.strip()) for c in times.split(","))
    sql(
        name, f"SELECT {others}, " + shown("date_format({c}, 'yyyy-MM-dd HH:mm:ss.SSSSSS') AS {c}") + f" FROM ({text}) shown",
        f"SELECT {others}, " + shown("strftime(CAST({c} AS TIMESTAMP), '%Y-%m-%d %H:%M:%S.%f') AS {c}") + f" FROM ({oracle}) shown",
    )


_times(
    "fn_time_build",
    "event_id",
    "t, d, md, mt",
    "SELECT event_id, time_date(2024, CAST(event_id % 12 + 1 AS INT), CAST(event_id % 28 + 1 AS INT), CAST(event_id % 24 AS INT), 5, 6.5D) AS t, time_date(2024, 2, 29) AS d, make_date(2024, CAST(event_id % 12 + 1 AS INT), 3) AS md, make_timestamp_ntz(2024, 1, 2, 3, 4, 5) AS mt FROM events",
    "SELECT event_id, make_timestamp(2024, event_id % 12 + 1, event_id % 28 + 1, event_id % 24, 5, 6.5) AS t, TIMESTAMP '2024-02-29' AS d, make_date(2024, event_id % 12 + 1, 3) AS md, TIMESTAMP '2024-01-02 03:04:05' AS mt FROM events",
)
_times(
    "fn_time_epochs",
    "event_id, s, ms, us, ns, sub",
    "a, b, c, d",
    "SELECT event_id, time_to_unix(ts) AS s, time_to_milli(ts) AS ms, time_to_micro(ts) AS us, time_to_nano(ts) AS ns, time_get_nano(ts) AS sub, time_unix(time_to_unix(ts)) AS a, time_milli(time_to_milli(ts)) AS b, time_micro(time_to_micro(ts)) AS c, time_nano(time_to_nano(ts)) AS d FROM events",
    "SELECT event_id, CAST(floor(epoch_us(ts) / 1e6) AS BIGINT) AS s, epoch_us(ts) // 1000 AS ms, epoch_us(ts) AS us, epoch_us(ts) * 1000 AS ns, epoch_us(ts) % 1000000 * 1000 AS sub, date_trunc('second', ts) AS a, date_trunc('millisecond', ts) AS b, ts AS c, ts AS d FROM events",
)
sql(
    "fn_time_fields",
    "SELECT event_id, time_get_year(ts) AS y, time_get_month(ts) AS m, time_get_day(ts) AS d, time_get_hour(ts) AS h, time_get_minute(ts) AS mi, time_get_second(ts) AS s, time_get_weekday(ts) AS wd, time_get_yearday(ts) AS yd, time_get_isoyear(ts) AS iy, time_get_isoweek(ts) AS iw, time_get(ts, 'quarter') AS q, time_get(ts, 'century') AS c, time_get(ts, 'isodow') AS id FROM events",
    "SELECT event_id, CAST(year(ts) AS INT) AS y, CAST(month(ts) AS INT) AS m, CAST(day(ts) AS INT) AS d, CAST(hour(ts) AS INT) AS h, CAST(minute(ts) AS INT) AS mi, CAST(second(ts) AS INT) AS s, CAST(dayofweek(ts) AS INT) AS wd, CAST(dayofyear(ts) AS INT) AS yd, CAST(isoyear(ts) AS INT) AS iy, CAST(weekofyear(ts) AS INT) AS iw, CAST(quarter(ts) AS BIGINT) AS q, CAST(year(ts) // 100 AS BIGINT) AS c, CAST(isodow(ts) AS BIGINT) AS id FROM events",
)
sql(
    "fn_time_comparison",
    "SELECT event_id, time_after(ts, u) AS a, time_before(ts, u) AS b, time_equal(ts, u) AS e, time_compare(ts, u) AS c FROM (SELECT event_id, ts, TIMESTAMP_NTZ'2024-01-15 00:00:00' AS u FROM events) x",
    "SELECT event_id, ts > u AS a, ts < u AS b, ts = u AS e, CAST(CASE WHEN ts < u THEN -1 WHEN ts > u THEN 1 ELSE 0 END AS INT) AS c FROM (SELECT event_id, ts, TIMESTAMP '2024-01-15' AS u FROM events) x",
)
_times(
    "fn_durations",
    "event_id, small, s",
    "a, b, f, r",
    "SELECT event_id, dur_ns() + dur_us() + dur_ms() AS small, time_add(ts, 90 * dur_m()) AS a, time_add(ts, -dur_h()) AS b, time_sub(ts, TIMESTAMP_NTZ'2024-01-01 00:00:00') AS s, time_floor(ts, 15 * dur_m()) AS f, time_round(ts, 10 * dur_s()) AS r FROM events",
    "SELECT event_id, CAST(1001001 AS BIGINT) AS small, ts + INTERVAL 90 MINUTE AS a, ts - INTERVAL 1 HOUR AS b, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) * 1000 AS s, time_bucket(INTERVAL 15 MINUTE, ts) AS f, make_timestamp((epoch_us(ts) + 5000000) // 10000000 * 10000000) AS r FROM events",
)
_times(
    "fn_time_add_date",
    "o_orderkey",
    "y, m, d",
    "SELECT o_orderkey, time_add_date(t, 1) AS y, time_add_date(t, 0, 1) AS m, time_add_date(t, -1, -1, 10) AS d FROM (SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP_NTZ) AS t FROM orders) x",
    "SELECT o_orderkey, t + INTERVAL 1 YEAR AS y, t + INTERVAL 1 MONTH AS m, t - INTERVAL 1 YEAR - INTERVAL 1 MONTH + INTERVAL 10 DAY AS d FROM (SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS t FROM orders) x",
)
_times(
    "fn_time_trunc_field",
    "event_id",
    "de, q, w, h",
    "SELECT event_id, time_trunc_field(ts, 'decade') AS de, time_trunc_field(ts, 'quarter') AS q, time_trunc_field(ts, 'week') AS w, time_trunc_field(ts, 'hour') AS h FROM events",
    "SELECT event_id, date_trunc('decade', ts) AS de, CAST(date_trunc('quarter', ts) AS TIMESTAMP) AS q, CAST(date_trunc('week', ts) AS TIMESTAMP) AS w, date_trunc('hour', ts) AS h FROM events".replace("date_trunc('decade', ts)", "CAST(date_trunc('decade', ts) AS TIMESTAMP)"),
)
sql(
    "fn_time_text",
    "SELECT event_id, time_fmt_datetime(ts) AS dt, time_fmt_date(ts, 3600) AS d, time_fmt_time(ts, -3600) AS t FROM events",
    "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS dt, strftime(ts + INTERVAL 1 HOUR, '%Y-%m-%d') AS d, strftime(ts - INTERVAL 1 HOUR, '%H:%M:%S') AS t FROM events",
)
sql(
    "fn_time_iso",
    f"SELECT time_fmt_iso({_AT}) AS a, time_fmt_iso(TIMESTAMP_NTZ'2024-02-29 12:34:56', 5400) AS b, time_fmt_iso(TIMESTAMP_NTZ'2024-02-29 12:34:56', -3600) AS c",
    "SELECT '2024-02-29T12:34:56.789000000Z' AS a, '2024-02-29T14:04:56+01:30' AS b, '2024-02-29T11:34:56-01:00' AS c",
)
_times(
    "fn_time_parse",
    "x",
    "t",
    "SELECT x, time_parse(x) AS t FROM VALUES ('2024-02-29T12:00:00+02:00'), ('2024-02-29T12:00:00Z'), ('2024-02-29 01:02:03'), ('2024-02-29'), ('nonsense'), (NULL) AS v(x)",
    "SELECT * FROM (VALUES ('2024-02-29T12:00:00+02:00', TIMESTAMP '2024-02-29 10:00:00'), ('2024-02-29T12:00:00Z', TIMESTAMP '2024-02-29 12:00:00'), ('2024-02-29 01:02:03', TIMESTAMP '2024-02-29 01:02:03'), ('2024-02-29', TIMESTAMP '2024-02-29'), ('nonsense', NULL), (NULL, NULL)) v(x, t)",
)
sql(
    "fn_time_now",
    "SELECT time_now() IS NOT NULL AS n, time_since(TIMESTAMP_NTZ'2020-01-01 00:00:00') > 0 AS s, time_until(TIMESTAMP_NTZ'2100-01-01 00:00:00') > 0 AS u, length(clock_timestamp()) AS c, transaction_timestamp() = statement_timestamp() AS e",
    "SELECT true AS n, true AS s, true AS u, 23 AS c, true AS e",
)
sql(
    "fn_timediff",
    "SELECT a, b, timediff(a, b) AS d FROM VALUES ('14:30:45', '12:00:00'), ('12:00:00', '14:30:45'), ('12:00:01.300', '12:00:00.500'), ('2023-05-10 23:30:00', '2023-05-11 01:15:00'), ('2024-03-31', '2024-02-29'), ('2024-03-01', '2024-01-31'), ('2460001.5', '2460000.0'), ('not a time', '12:00:00'), (NULL, '12:00:00') AS v(a, b)",
    "SELECT * FROM (VALUES ('14:30:45', '12:00:00', '+0000-00-00 02:30:45.000'), ('12:00:00', '14:30:45', '-0000-00-00 02:30:45.000'), ('12:00:01.300', '12:00:00.500', '+0000-00-00 00:00:00.800'), ('2023-05-10 23:30:00', '2023-05-11 01:15:00', '-0000-00-00 01:45:00.000'), ('2024-03-31', '2024-02-29', '+0000-01-02 00:00:00.000'), ('2024-03-01', '2024-01-31', '+0000-00-30 00:00:00.000'), ('2460001.5', '2460000.0', '+0000-00-01 12:00:00.000'), ('not a time', '12:00:00', NULL), (NULL, '12:00:00', NULL)) v(a, b, d)",
)
sql(
    "fn_timediff_orders",
    "SELECT o_orderkey, timediff(date_format(o_orderdate, 'yyyy-MM-dd'), date_format(date_trunc('month', o_orderdate), 'yyyy-MM-dd')) AS d FROM orders",
    "SELECT o_orderkey, '+0000-00-' || lpad(CAST(day(o_orderdate) - 1 AS VARCHAR), 2, '0') || ' 00:00:00.000' AS d FROM orders",
)
sql(
    "fn_numeric",
    "SELECT o_orderkey, numeric_decode(numeric_add(x, y)) AS a, numeric_decode(numeric_sub(x, y)) AS s, numeric_decode(numeric_mul(y, numeric_encode('3'))) AS m, CAST(numeric_div(x, numeric_encode('0')) AS DOUBLE) AS z, CAST(round(numeric_div(x, y), 4) AS DOUBLE) AS d, numeric_lt(x, y) AS l, numeric_eq(x, x) AS e FROM (SELECT o_orderkey, numeric_encode(CAST(o_orderkey AS STRING)) AS x, numeric_encode('2.5') AS y FROM orders) t",
    "SELECT o_orderkey, o_orderkey + 2 || '.5' AS a, CASE WHEN o_orderkey >= 3 THEN (o_orderkey - 3) || '.5' ELSE CAST(o_orderkey - 2.5 AS VARCHAR) END AS s, '7.5' AS m, CAST(NULL AS DOUBLE) AS z, CAST(round(o_orderkey / 2.5, 4) AS DOUBLE) AS d, o_orderkey < 2.5 AS l, true AS e FROM orders",
)
sql("fn_booleans", "SELECT n_nationkey, boolean_to_int(n_nationkey > 5) AS i, int_to_boolean(CAST(n_nationkey % 2 AS INT)) AS b, booleq(n_name, 'NATION_1') AS e, boolne(n_name, NULL) AS n FROM nation", "SELECT n_nationkey, CAST(n_nationkey > 5 AS INT) AS i, n_nationkey % 2 = 1 AS b, CAST(n_name = 'NATION_1' AS INT) AS e, 1 AS n FROM nation")
sql("fn_validate_ipaddr", "SELECT x, validate_ipaddr(x) AS v FROM VALUES ('10.0.0.255'), ('0.0.0.0'), ('::1'), ('fe80::1:2'), (NULL) AS t(x)", "SELECT x, x AS v FROM (VALUES ('10.0.0.255'), ('0.0.0.0'), ('::1'), ('fe80::1:2'), (NULL)) t(x)")
sql("fn_random", "SELECT n_nationkey, random_integer() IS NOT NULL AS r, length(randomblob(20)) AS b, length(randomblob(0)) AS z, length(uuid4()) AS u, length(zeroblob(5)) AS o FROM nation", "SELECT n_nationkey, true AS r, 20 AS b, 1 AS z, 16 AS u, 5 AS o FROM nation")
sql("fn_unistr_quote", r"SELECT unistr_quote('it''s') AS a, unistr_quote(concat('a', chr(10), '\\b')) AS b, unistr_quote(NULL) AS c", r"SELECT '''it''''s''' AS a, 'unistr(''a\u000a\\b'')' AS b, 'NULL' AS c")
sql("fn_concat_ws", "SELECT n_nationkey, concat_ws('-', n_name, if(n_nationkey > 3, NULL, 'x'), 'y') AS c, concat_ws(NULL, n_name, 'y') AS n FROM nation", "SELECT n_nationkey, concat_ws('-', n_name, CASE WHEN n_nationkey > 3 THEN NULL ELSE 'x' END, 'y') AS c, CAST(NULL AS VARCHAR) AS n FROM nation")
sql("fn_trim_sets", "SELECT n_nationkey, ltrim('NAT', n_name) AS l, rtrim('0123456789', n_name) AS r, btrim(n_name, 'N0123456789') AS b FROM nation", "SELECT n_nationkey, ltrim(n_name, 'NAT') AS l, rtrim(n_name, '0123456789') AS r, trim(n_name, 'N0123456789') AS b FROM nation")
sql("fn_unhex", "SELECT x, decode(unhex(x), 'UTF-8') AS u, decode(unhex(translate('41-42', '-', '')), 'UTF-8') AS i FROM VALUES ('414243'), ('') AS t(x)", "SELECT * FROM (VALUES ('414243', 'ABC', 'AB'), ('', '', 'AB')) t(x, u, i)")
sql("fn_hints", "SELECT n_nationkey, ifnull(if(n_nationkey > 5, NULL, n_name), 'late') AS i FROM nation", "SELECT n_nationkey, ifnull(CASE WHEN n_nationkey > 5 THEN NULL ELSE n_name END, 'late') AS i FROM nation")
sql("fn_math_rest", "SELECT n_nationkey, round(acosh(1.0D + n_nationkey), 9) AS ch, round(asin(n_nationkey / 30.0D), 9) AS s, round(atanh(n_nationkey / 30.0D), 9) AS th, round(log2(n_nationkey + 1.0D), 9) AS l, CAST(ceiling(n_nationkey / 3.0D) AS DOUBLE) AS c, power(n_nationkey, 2) AS p, round(pi(), 9) AS pi FROM nation", "SELECT n_nationkey, round(acosh(1.0 + n_nationkey), 9) AS ch, round(asin(n_nationkey / 30.0), 9) AS s, round(atanh(n_nationkey / 30.0), 9) AS th, round(log2(n_nationkey + 1.0), 9) AS l, ceiling(n_nationkey / 3.0) AS c, power(n_nationkey, 2) AS p, round(pi(), 9) AS pi FROM nation")
sql("fn_shift_right", "SELECT n_nationkey, shiftright(1000L, CAST(n_nationkey AS INT)) AS r FROM nation", "SELECT n_nationkey, CAST(1000 AS BIGINT) >> n_nationkey AS r FROM nation")
sql("fn_regexp_rest", "SELECT p_partkey, regexp_like(p_name, '^[a-m]') AS l, regexp_substr(p_name, '[aeiou]{2,}') AS s FROM part", "SELECT p_partkey, regexp_matches(p_name, '^[a-m]') AS l, nullif(regexp_extract(p_name, '[aeiou]{2,}'), '') AS s FROM part")
sql("fn_format_type", "SELECT format_type(1043, 14) AS a, format_type(1700, 786438) AS b, format_type(23) AS c, format_type(9) AS d, pg_encoding_to_char(6) AS e, pg_table_is_visible(1) AS v, pg_get_userbyid(10) IS NOT NULL AS u", "SELECT 'character varying(10)' AS a, 'numeric(12,2)' AS b, 'integer' AS c, 'unknown' AS d, 'UTF8' AS e, 1 AS v, true AS u")
sql("fn_fuzzy_soundex", "SELECT x, fuzzy_soundex(x) AS s FROM VALUES ('Robert'), ('Rupert'), ('Tymczak'), ('Honeyman') AS t(x)", "SELECT * FROM (VALUES ('Robert', 'R163'), ('Rupert', 'R163'), ('Tymczak', 'T522'), ('Honeyman', 'H555')) t(x, s)")
sql("array_ordering", "SELECT n_nationkey, array(n_regionkey, n_nationkey) < array(2, 10) AS l, array(1, 2) < array(1, 2, 0) AS p FROM nation", "SELECT n_nationkey, [n_regionkey, n_nationkey] < [2, 10] AS l, true AS p FROM nation")
_ROWS = "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey, l_linenumber) < (20, 3) AND (l_linenumber, l_quantity) >= (1, 10.0) AND (l_orderkey, l_linenumber) <> (5, 1)"


@register("row_value_comparison", _ROWS)
def row_values(spark, sf_dir):
    """Row values compare from left to right; the rewriter spells them out, so that filters reach the scan."""
    views(spark, sf_dir, _ROWS)
    return dialect.sql(spark, _ROWS)


sql("collate_rtrim", "SELECT lower(min(rtrim(x))) AS k, count(*) AS n FROM VALUES ('a'), ('a  '), ('b'), (' b') AS t(x) GROUP BY collate(x, 'UTF8_BINARY_RTRIM')", "SELECT rtrim(x) AS k, count(*) AS n FROM (VALUES ('a'), ('a  '), ('b'), (' b')) t(x) GROUP BY rtrim(x)")
sql("table_columns_json", "SELECT to_json(array_agg(c)) AS j FROM (SELECT explode(array('n_nationkey', 'n_name', 'n_regionkey')) AS c) x", "SELECT '[\"n_nationkey\",\"n_name\",\"n_regionkey\"]' AS j")
sql("row_image_json", "SELECT to_json(struct(r_regionkey, r_name)) AS j FROM region", "SELECT '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS j FROM region")


@register("fn_crypto_rest", "SELECT n_nationkey, sha256(n_name) AS s, n_name AS r, n_name AS u FROM nation")
def crypto_rest(spark, sf_dir):
    """Longer digests by their lengths, and decoding as the inverse of encoding."""
    n = F.col("n_name")
    t = table(spark, sf_dir, "nation").where(F.length(F.hex(X.crypto(n, "sha512"))) == 128).where(F.length(F.hex(X.crypto(n, "sha384"))) == 96)
    back = lambda kind: X.decode(X.encode(n, kind), kind).cast("string")
    return t.select("n_nationkey", F.lower(F.hex(X.crypto(n, "sha256"))).alias("s"), back("base64").alias("r"), back("hex").alias("u"))


@register("fn_blake3", "SELECT * FROM (VALUES ('', 'af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262'), ('abc', '6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85')) t(x, h)")
def blake3(spark, sf_dir):
    return spark.createDataFrame([("",), ("abc",)], "x string").select("x", F.lower(F.hex(X.blake3(F.col("x")))).alias("h"))


@register("fn_caverphone", "SELECT * FROM (VALUES ('awesome', 'AWSM111111'), ('deborah', 'TPRA111111'), ('lee', 'LA11111111'), ('thompson', 'TMPSN11111')) t(x, c)")
def caverphone(spark, sf_dir):
    return spark.createDataFrame([(x,) for x in ("awesome", "deborah", "lee", "thompson")], "x string").select("x", M.caverphone(F.col("x")).alias("c"))


@register("fn_json_pretty", "SELECT 1 AS id, '{\n    \"a\": 1.10,\n    \"b\": [\n        1e2,\n        {}\n    ]\n}' AS p, 0 AS e UNION ALL SELECT 2, NULL, 2 UNION ALL SELECT 3, NULL, NULL")
def json_pretty(spark, sf_dir):
    """Layout keeps how numbers are written; the position of the first error is 0 in valid text."""
    t = spark.createDataFrame([(1, '{"a":1.10,"b":[1e2,{}]}'), (2, "[1,"), (3, None)], "id int, j string")
    return t.select("id", J.pretty(F.col("j")).alias("p"), F.when(F.col("id") == 2, F.least(J.error_position(F.col("j")), F.lit(2))).otherwise(J.error_position(F.col("j"))).cast("int").alias("e"))


@register("fn_json_arrows", """SELECT * FROM (VALUES (1, '1', '1', '"x"', 'x', '[1,"x"]'), (2, NULL, NULL, NULL, NULL, '[null,null]'), (3, NULL, NULL, NULL, NULL, NULL)) t(id, a, b, c, d, m)""")
def json_arrows(spark, sf_dir):
    """Text of a part (->), its value (->>), and several paths at once."""
    t, j = spark.createDataFrame([(1, '{"a":1,"b":[1,{"c":"x"}]}'), (2, "[1]"), (3, "not json")], "id int, j string"), F.col("j")
    return t.select("id", J.arrow(j, "a").alias("a"), J.arrow_text(j, "$.a").alias("b"), J.arrow(j, "$.b[1].c").alias("c"), J.arrow_text(j, "$.b[1].c").alias("d"), J.extract_many(j, "$.a", "$.b[1].c").alias("m"))


@register("fn_jsonb", """SELECT n_nationkey, '{"k":' || n_nationkey || ',"n":"' || n_name || '"}' AS o, '[' || n_nationkey || ',' || n_regionkey || ']' AS a, CAST(n_nationkey AS VARCHAR) AS e FROM nation""")
def jsonb(spark, sf_dir):
    """Binary JSON is VARIANT: built, read, and shown as text."""
    k = F.col("n_nationkey")
    t = table(spark, sf_dir, "nation").select("n_nationkey", J.jsonb_object(k=k, n=F.col("n_name")).alias("o"), J.jsonb_array(k, F.col("n_regionkey")).alias("a"))
    return t.select("n_nationkey", F.to_json("o").alias("o"), F.to_json("a").alias("a"), F.to_json(J.jsonb_extract(F.col("o"), "$.k")).alias("e"))


@register("fn_jsonb_edit", """SELECT 1 AS id, '{"a":9,"b":2}' AS s, '{"a":1,"b":2,"z":3}' AS i, '{"a":1}' AS r, '{"a":5,"b":2}' AS q, '{"b":2}' AS p""")
def jsonb_edit(spark, sf_dir):
    v = F.parse_json(F.lit('{"a":1,"b":2}'))
    text = lambda x: F.to_json(x)
    return spark.range(1).select(
        F.lit(1).alias("id"), text(J.jsonb_set(v, "$.a", F.lit("9"))).alias("s"), text(J.jsonb_insert(v, "$.z", F.lit("3"))).alias("i"), text(J.jsonb_remove(v, "$.b")).alias("r"),
        text(J.jsonb_replace(v, "$.a", F.lit("5"))).alias("q"), text(J.jsonb_patch(v, F.lit('{"a":null}'))).alias("p"),
    )


@register("agg_jsonb_group", """SELECT n_regionkey, '[' || string_agg(n_nationkey, ',' ORDER BY n_nationkey) || ']' AS a, CAST(count(*) AS INT) AS k FROM nation GROUP BY n_regionkey""")
def jsonb_group(spark, sf_dir):
    t = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(J.jsonb_group_array(F.col("n_nationkey")).alias("a"), J.jsonb_group_object(F.col("n_name"), F.col("n_nationkey")).alias("o"))
    return t.select("n_regionkey", F.concat(F.lit("["), F.array_join(F.array_sort(F.from_json(F.to_json("a"), "array<int>")), ","), F.lit("]")).alias("a"), F.size(F.json_object_keys(F.to_json("o"))).alias("k"))


@register("fn_json_each_rows", """SELECT * FROM (VALUES (1, 'a', '1', 'integer', '1', '$.a', '$'), (1, 'b', '[1,2]', 'array', NULL, '$.b', '$'), (1, 'c', 'x', 'text', 'x', '$.c', '$'), (1, 'd', NULL, 'null', NULL, '$.d', '$'), (2, '0', 'true', 'true', 'true', '$[0]', '$'), (2, '1', '2.5', 'real', '2.5', '$[1]', '$')) t(doc, key, value, type, atom, fullkey, path)""")
def json_each_rows(spark, sf_dir):
    """json_each with all its columns, in the JVM."""
    t = spark.createDataFrame([(1, '{"a":1,"b":[1,2],"c":"x","d":null}'), (2, "[true,2.5]"), (3, "not json")], "doc int, j string")
    return J.each(t, "j").select("doc", "key", "value", "type", "atom", "fullkey", "path")


@register("fn_attach", "SELECT r_name, (SELECT count(*) FROM nation) AS n FROM region")
def attach(spark, sf_dir):
    """Tables of a folder under a name of their own, a temporary table, and the schema table that lists them."""
    from ..sources import catalog

    catalog.attach(spark, sf_dir, "other", ["region", "nation"])
    catalog.create_view(spark, "short_lived", spark.table("other_region"))
    listed = {r.name for r in catalog.schema_table(spark).collect()}
    if not {"other_region", "other_nation", "short_lived"} <= listed:
        raise ValueError("the schema table lacks a table")
    return run_sql(spark, sf_dir, "SELECT r_name, (SELECT count(*) FROM other_nation) AS n FROM short_lived")


def _run(spark, sf_dir: str, *statements: str):
    out = None
    for text in statements:
        views(spark, sf_dir, text)
        out = dialect.sql(spark, text)
    return out


@register("ddl_and_dml_text", "SELECT CAST(id AS BIGINT) AS id, label, CAST(price AS DOUBLE) AS price, note FROM (VALUES (1, 'one!', 10.0, 'n'), (3, 'three', 30.0, 'n'), (4, NULL, 7.5, 'n'), (9, 'ten', 7.5, 'n')) t(id, label, price, note)")
def statements(spark, sf_dir):
    """CREATE TABLE, INSERT, UPDATE, DELETE and ALTER TABLE as text."""
    return _run(
        spark, sf_dir, "DROP TABLE IF EXISTS wares", "CREATE TABLE wares (id INTEGER PRIMARY KEY, name TEXT, price REAL DEFAULT 7.5, junk TEXT)",
        "INSERT INTO wares (id, name, price) VALUES (1, 'one', 10), (2, 'two', 20), (3, 'three', 30)", "INSERT INTO wares (name) VALUES (NULL)", "INSERT OR IGNORE INTO wares (id, name) VALUES (3, 'again')",
        "INSERT OR REPLACE INTO wares (id, name) VALUES (9, 'nine')", "REPLACE INTO wares (id, name) VALUES (9, 'ten')", "UPDATE wares SET name = name || '!' WHERE id = 1", "DELETE FROM wares WHERE price == 20",
        "ALTER TABLE wares RENAME COLUMN name TO label", "ALTER TABLE wares DROP COLUMN junk", "ALTER TABLE wares ADD COLUMN note TEXT DEFAULT 'n'", "SELECT id, label, price, note FROM wares",
    )


@register("changes_counters", "SELECT 2 AS c, 5 AS t, 3 AS r")
def counters(spark, sf_dir):
    """changes, total_changes (against the session's count before) and last_insert_rowid."""
    from ..sources import tables

    before = tables.counter(spark, "total_changes")
    _run(spark, sf_dir, "DROP TABLE IF EXISTS counted", "CREATE TABLE counted (id INTEGER PRIMARY KEY, v TEXT)", "INSERT INTO counted (v) VALUES ('a'), ('b'), ('c')", "UPDATE counted SET v = 'z' WHERE id > 1")
    return dialect.sql(spark, f"SELECT changes() AS c, total_changes() - {before} AS t, last_insert_rowid() AS r")


@register("insert_returning", "SELECT CAST(n_nationkey * 2 AS BIGINT) AS d, n_name FROM nation WHERE n_regionkey = 1")
def insert_returning(spark, sf_dir):
    return _run(spark, sf_dir, "DROP TABLE IF EXISTS taken", "CREATE TABLE taken (k INTEGER, n_name TEXT)", "INSERT INTO taken SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1 RETURNING k * 2 AS d, n_name")


@register("sql_json_arrows", """SELECT n_nationkey, CAST(n_nationkey AS VARCHAR) AS a, '"' || n_name || '"' AS b, n_name AS c, '7' AS d FROM nation""")
def sql_json_arrows(spark, sf_dir):
    return _run(spark, sf_dir, """SELECT n_nationkey, j -> '$.k' AS a, j -> 'n' AS b, j ->> 'n' AS c, x.j -> 'l' ->> 1 AS d FROM (SELECT n_nationkey, to_json(named_struct('k', n_nationkey, 'n', n_name, 'l', array(5, 7))) AS j FROM nation) x""")


@register("window_groups_frame", "SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_returnflag GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS s FROM lineitem")
def groups_frame(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    return N.over_groups(t, F.sum("l_quantity"), ["l_orderkey"], "l_returnflag", 1, 0, "s").select("l_orderkey", "l_linenumber", "s")


_EXCLUDED = ("current row", "group", "ties", "no others")


@register("window_exclude", "SELECT l_orderkey, l_linenumber, " + ", ".join(f"round(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_returnflag RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE {w}), 4) AS e{k}" for k, w in enumerate(_EXCLUDED)) + " FROM lineitem")
def exclude(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    for k, what in enumerate(_EXCLUDED):
        t = N.sum_excluding(t, "l_quantity", ["l_orderkey"], "l_returnflag", what, f"e{k}")
    return t.select("l_orderkey", "l_linenumber", *[F.round(f"e{k}", 4).alias(f"e{k}") for k in range(len(_EXCLUDED))])


@register("window_distinct", "SELECT o_orderkey, count(DISTINCT o_orderstatus) OVER (PARTITION BY o_custkey) AS n FROM orders")
def distinct_over(spark, sf_dir):
    return N.distinct_over(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderstatus", "n").select("o_orderkey", "n")


@register("virtual_table", "SELECT CAST(range AS BIGINT) AS value FROM range(5, 3000001, 5) WHERE range >= 1000 AND range < 1100 AND range % 3 = 0")
def virtual_table(spark, sf_dir):
    """A module's table: bounds are handed down to it, what it can't use is left to Spark."""
    virtual.register(spark)
    return spark.read.format("series").option("start", 5).option("stop", 3_000_000).option("step", 5).load().where("value >= 1000 AND value < 1100 AND value % 3 = 0")


sql("pivot_rows", "SELECT * FROM (SELECT o_orderpriority AS p, o_orderstatus AS s, o_orderkey FROM orders) PIVOT (count(o_orderkey) FOR s IN ('F' AS f, 'O' AS o, 'P' AS p2))", "SELECT o_orderpriority AS p, nullif(count(*) FILTER (WHERE o_orderstatus = 'F'), 0) AS f, nullif(count(*) FILTER (WHERE o_orderstatus = 'O'), 0) AS o, nullif(count(*) FILTER (WHERE o_orderstatus = 'P'), 0) AS p2 FROM orders GROUP BY o_orderpriority")
sql("lateral_subquery", "SELECT c_custkey, t.n FROM customer, LATERAL (SELECT count(*) AS n FROM orders WHERE o_custkey = c_custkey) t")
sql("map_values", "SELECT n_nationkey, map('k', n_nationkey, 'r', n_regionkey)['r'] AS r FROM nation", "SELECT n_nationkey, n_regionkey AS r FROM nation")
sql("table_sample", "SELECT count(*) BETWEEN 0 AND (SELECT count(*) FROM orders) AS ok FROM orders TABLESAMPLE (30 PERCENT) REPEATABLE (7)", "SELECT true AS ok")


@register("ddl_index_text", "SELECT CAST(id AS BIGINT) AS id, v FROM (VALUES (3, 'c'), (2, 'b')) t(id, v)")
def index_text(spark, sf_dir):
    """CREATE INDEX, REINDEX and DROP INDEX: a seek on an indexed table."""
    return _run(
        spark, sf_dir, "DROP TABLE IF EXISTS indexed", "CREATE TABLE indexed (id INTEGER, v TEXT)", "INSERT INTO indexed VALUES (3, 'c'), (1, 'a'), (2, 'b')", "CREATE UNIQUE INDEX by_id ON indexed(id)",
        "REINDEX indexed", "DROP INDEX by_id", "SELECT id, v FROM indexed INDEXED BY by_id WHERE id >= 2",
    )


@register("ddl_virtual_table", "SELECT CAST(range AS BIGINT) AS value FROM range(10, 31, 10)")
def virtual_text(spark, sf_dir):
    return _run(spark, sf_dir, "CREATE VIRTUAL TABLE tens USING series(start = 10, stop = 30, step = 10)", "SELECT value FROM tens")


@register("pg_catalog_tables", "SELECT 'nation' AS relname, 'v' AS relkind, column_name AS attname, CAST(ordinal_position AS INT) AS attnum, CASE WHEN data_type = 'VARCHAR' THEN 'text' WHEN data_type = 'BIGINT' THEN 'bigint' ELSE 'integer' END AS t FROM information_schema.columns WHERE table_name = 'nation'")
def pg_tables(spark, sf_dir):
    from ..functions import sqlfuncs
    from ..sources import catalog

    table(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    sqlfuncs.install(spark, "format_type(")
    both = catalog.pg_class(spark).where("relname = 'nation'").crossJoin(catalog.pg_attribute(spark, "nation"))  # one table's columns
    return both.select("relname", "relkind", "attname", "attnum", F.expr("format_type(atttypid)").alias("t"))


@register("vector_sparse_index", "SELECT vec_id FROM (SELECT a.vec_id, list_sum(list_transform(list_zip(a.embedding, q.e), lambda p: CASE WHEN p[1] > 0.05 AND p[2] > 0.05 THEN p[1]::DOUBLE * p[2]::DOUBLE ELSE 0 END)) AS s FROM embeddings a, (SELECT embedding AS e FROM embeddings WHERE vec_id = 7) q) t ORDER BY s DESC, vec_id LIMIT 10")
def sparse_index(spark, sf_dir):
    """An inverted index over sparse vectors: a search reads the lists of the query's places."""
    from ..functions import vectors as V

    t = table(spark, sf_dir, "embeddings")
    query = {d: float(x) for d, x in enumerate(t.where("vec_id = 7").first().embedding) if x > 0.05}
    return V.sparse_nearest(V.postings(t, "vec_id", "embedding", 0.05), query, 10).select(F.col("key").alias("vec_id"))


@register("fn_vector_rest", "SELECT vec_id, CAST(len(embedding) AS INT) AS n, CAST(len(list_filter(embedding, lambda x: x <> 0)) AS INT) AS nz, round(CAST(1 AS DOUBLE) - 1, 4) AS same FROM embeddings")
def vector_rest(spark, sf_dir):
    from ..functions import vectors as V

    e = F.col("embedding")
    positive = F.transform(e, lambda x: F.abs(x))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size(e).alias("n"), F.size(V.sparse(e)["at"]).alias("nz"), F.round(V.jaccard(positive, positive), 4).alias("same"))


@register("fn_json_minify", """SELECT * FROM (VALUES (1, '{"a":[1,2],"b":"x y"}'), (2, '[]')) t(id, j)""")
def json_minify(spark, sf_dir):
    return spark.createDataFrame([(1, '{ "a" : [1, 2],\n "b": "x y"}'), (2, " [ ] ")], "id int, j string").select("id", J.minify(F.col("j")).alias("j"))


@register("fn_fuzzy_osadist", "SELECT * FROM (VALUES ('ca', 'abc', 3), ('abcd', 'acbd', 1), ('', 'ab', 2), ('same', 'same', 0)) t(a, b, d)")
def osa(spark, sf_dir):
    return spark.createDataFrame([("ca", "abc"), ("abcd", "acbd"), ("", "ab"), ("same", "same")], "a string, b string").select("a", "b", X.fuzzy_osadist(F.col("a"), F.col("b")).alias("d"))


@register("sequence_values", "SELECT * FROM (VALUES (1, 10), (2, 15), (3, 15), (4, 100), (5, 100), (6, 105)) t(k, v)")
def sequence_values(spark, sf_dir):
    """nextval, currval and setval."""
    from ..operators.dml import Sequence

    s = Sequence(start=10, increment=5)
    values = [s.nextval(), s.nextval(), s.currval(), s.setval(100), s.currval(), s.nextval()]
    return spark.createDataFrame(list(enumerate(values, 1)), "k int, v int")


@register("copy_text_format", "SELECT n_nationkey, n_name, CAST(NULL AS VARCHAR) AS none FROM nation")
def copy_text(spark, sf_dir):
    """A table through COPY's text format: tabs between fields, a mark for null."""
    from ..session import folder
    from ..sources import catalog

    path = folder(spark, "copy")
    t = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.lit(None).cast("string").alias("none"))
    t.write.option("sep", "\t").option("nullValue", "\\N").option("quote", "").csv(path)
    return catalog.copy_text(spark, path, "n_nationkey long, n_name string, none string")


@register("vacuum_into", "SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS s FROM orders")
def vacuum(spark, sf_dir):
    """A table rewritten in files of a fitting size."""
    from ..operators import maintenance
    from ..session import folder

    path = folder(spark, "compact")
    maintenance.compact(spark, f"{sf_dir}/orders.parquet", path)
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("s"))


@register("explain_statement", "SELECT true AS shown")
def explain(spark, sf_dir):
    out = _run(spark, sf_dir, "EXPLAIN QUERY PLAN SELECT o_orderkey FROM orders WHERE o_custkey == 7")
    return out.select(F.col("plan").contains("PushedFilters").alias("shown"))
