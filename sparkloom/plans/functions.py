"""One query for each family of functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import core as C, datetimes as D, ext as X, jsonx as J, mathx as M, vectors as V
from ..session import table
from .base import sql
from .registry import register


def _on(name: str, oracle: str, source: str = "nation"):
    """Registers a function of a table."""

    def put(f):
        register(name, oracle)(lambda spark, sf_dir: f(table(spark, sf_dir, source)))
        return f

    return put


@_on("fn_text", "SELECT p_partkey, length(p_name) AS n, CAST(octet_length(encode(p_name)) AS INTEGER) AS o, lower(p_name) AS l, upper(p_name) AS u, trim(p_name) AS t, replace(p_name, 'a', 'xy') AS r, instr(p_name, ' ') AS i, repeat('ab', p_size % 4) AS rep, lpad(p_brand, 12, '*') AS lp, rpad(p_brand, 4, '*') AS rp, reverse(p_brand) AS rev, unicode(p_name) AS un FROM part".replace("length(p_name) AS n", "CAST(length(p_name) AS INTEGER) AS n").replace("instr(p_name, ' ') AS i", "CAST(instr(p_name, ' ') AS INTEGER) AS i"), "part")
def text(t):
    p = F.col("p_name")
    return t.select("p_partkey", C.length(p).alias("n"), F.octet_length(p).alias("o"), C.lower(p).alias("l"), C.upper(p).alias("u"), F.trim(p).alias("t"), F.replace(p, F.lit("a"), F.lit("xy")).alias("r"), C.instr(p, F.lit(" ")).alias("i"), F.repeat(F.lit("ab"), F.col("p_size") % 4).alias("rep"), F.lpad("p_brand", 12, "*").alias("lp"), F.rpad("p_brand", 4, "*").alias("rp"), F.reverse("p_brand").alias("rev"), F.ascii(p).alias("un"))


@register("fn_substr", "SELECT * FROM (VALUES (1, 'ello'), (2, 'el'), (3, 'he'), (4, 'lo'), (5, 'l'), (6, 'he'), (7, ''), (8, 'hello')) t(k, s)")
def substr(spark, sf_dir):
    """Starts of 0 and below, and lengths below 0."""
    cases = [(2, None), (2, 2), (0, 3), (-2, None), (-2, 1), (3, -2), (9, 2), (-9, None)]
    return spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), C.substr(F.lit("hello"), y, z).alias("s")) for k, (y, z) in enumerate(cases, 1)])).alias("x")).select("x.*")


@_on("fn_null_handling", "SELECT n_nationkey, coalesce(CASE WHEN n_nationkey > 5 THEN n_name END, '?') AS c, nullif(n_regionkey, 2) AS n, CASE WHEN n_nationkey > 5 THEN 'y' ELSE 'n' END AS i, CASE WHEN n_nationkey > 20 THEN NULL ELSE greatest(n_nationkey, n_regionkey) END AS hi, least(n_nationkey, n_regionkey) AS lo, n_name || '' AS cc FROM nation")
def null_handling(t):
    k = F.col("n_nationkey")
    maybe = F.when(k <= 20, k)
    return t.select("n_nationkey", F.coalesce(F.when(k > 5, F.col("n_name")), F.lit("?")).alias("c"), F.nullif("n_regionkey", F.lit(2)).alias("n"), F.when(k > 5, "y").otherwise("n").alias("i"), C.scalar_max(maybe, F.col("n_regionkey")).alias("hi"), C.scalar_min(k, F.col("n_regionkey")).alias("lo"), C.concat(F.col("n_name"), F.lit(None).cast("string")).alias("cc"))


@register("fn_cast", "SELECT * FROM (VALUES ('12', CAST(12 AS BIGINT)), ('12.9', 12), ('-3abc', -3), ('abc', 0), ('', 0), (' 7 ', 7), ('1e3', 1000), ('9223372036854775808', 9223372036854775807), (NULL, NULL)) t(x, i)")
def cast(spark, sf_dir):
    """Text to INTEGER by its longest numeric prefix, held within 64 bits."""
    t = spark.createDataFrame([(x,) for x in ("12", "12.9", "-3abc", "abc", "", " 7 ", "1e3", "9223372036854775808", None)], "x string")
    return t.select("x", C.cast_integer(F.col("x")).alias("i"))


@_on("fn_hex", "SELECT n_nationkey, hex(n_name) AS h, hex(CAST(n_nationkey AS VARCHAR)) AS d, sha256(n_name) AS s, md5(n_name) AS m, sha1(n_name) AS s1, to_base64(encode(n_name)) AS b FROM nation")
def hexes(t):
    n = F.col("n_name")
    return t.select("n_nationkey", F.hex(n).alias("h"), F.hex(F.col("n_nationkey").cast("string")).alias("d"), F.lower(F.hex(X.crypto(n, "sha256"))).alias("s"), F.lower(F.hex(X.crypto(n, "md5"))).alias("m"), F.lower(F.hex(X.crypto(n, "sha1"))).alias("s1"), X.encode(n, "base64").alias("b"))


@register("fn_quote_char_soundex", "SELECT * FROM (VALUES ('Robert', '''Robert''', 'R163'), ('it''s', '''it''''s''', 'I320'), ('1', '''1''', '?000')) t(x, q, s)")
def quotes(spark, sf_dir):
    return spark.createDataFrame([("Robert",), ("it's",), ("1",)], "x string").select("x", C.quote(F.col("x")).alias("q"), C.soundex(F.col("x")).alias("s"))


@_on("fn_char_codes", "SELECT n_nationkey, chr(960 + n_nationkey) || chr(128512) AS c FROM nation")
def chars(t):
    return t.select("n_nationkey", C.char(F.col("n_nationkey") + 960, F.lit(128512)).alias("c"))


@_on("fn_format", "SELECT o_orderkey, printf('%05d|%.2f|%s', o_orderkey, o_totalprice, o_orderstatus) AS f, round(o_totalprice) AS r, CAST(sign(o_totalprice - 200000) AS BIGINT) AS s FROM orders", "orders")
def formats(t):
    return t.select("o_orderkey", F.format_string("%05d|%.2f|%s", "o_orderkey", "o_totalprice", "o_orderstatus").alias("f"), C.round_(F.col("o_totalprice")).alias("r"), C.sign(F.col("o_totalprice") - 200000).alias("s"))


@_on("fn_like_glob_regexp", r"SELECT p_partkey, p_name ILIKE '%A_%' AS l, p_type GLOB '*[A-M]' AS g, regexp_matches(p_name, '[aeiou]{2}') AS r, regexp_extract(p_brand, '(\d+)', 1) AS c, regexp_replace(p_name, '[aeiou]', '_', 'g') AS p FROM part", "part")
def patterns(t):
    p = F.col("p_name")
    return t.select("p_partkey", p.ilike("%A_%").alias("l"), C.glob("*[A-M]", F.col("p_type")).alias("g"), p.rlike("[aeiou]{2}").alias("r"), F.regexp_extract("p_brand", r"(\d+)", 1).alias("c"), F.regexp_replace(p, "[aeiou]", "_").alias("p"))


_MATH = ("asinh", "atan", "cos", "cosh", "degrees", "exp", "radians", "sin", "sinh", "tan", "tanh")


@_on("fn_math", "SELECT n_nationkey, " + ", ".join(f"round({f}(n_nationkey / 10.0), 6) AS {f}" for f in _MATH) + ", round(sqrt(n_nationkey), 6) AS sq, CASE WHEN n_nationkey > 0 THEN round(ln(n_nationkey), 6) END AS ln, CASE WHEN n_nationkey > 0 THEN round(log10(n_nationkey), 6) END AS lg, CASE WHEN n_nationkey > 0 THEN round(log2(n_nationkey), 6) END AS l2, round(pow(n_nationkey, 1.5), 6) AS pw, round(atan2(n_nationkey, 3), 6) AS a2, CASE WHEN n_nationkey <= 10 THEN round(acos(n_nationkey / 10.0), 6) END AS ac FROM nation")
def math(t):
    k = F.col("n_nationkey")
    r = lambda c: F.round(c, 6)
    return t.select("n_nationkey", *[r(M.unary(f, k / 10.0)).alias(f) for f in _MATH], r(M.unary("sqrt", k)).alias("sq"), r(M.unary("ln", k)).alias("ln"), r(M.log(k)).alias("lg"), r(M.log(k, F.lit(2))).alias("l2"), r(F.pow(k, F.lit(1.5))).alias("pw"), r(F.atan2(k, F.lit(3))).alias("a2"), r(M.unary("acos", k / 10.0)).alias("ac"))


@_on("fn_rounding", "SELECT c_custkey, ceil(c_acctbal) AS c, floor(c_acctbal) AS f, trunc(c_acctbal) AS t, round(c_acctbal - 7.5 * trunc(c_acctbal / 7.5), 6) AS m, CAST(gcd(c_custkey, 84) AS BIGINT) AS g, CAST(lcm(c_custkey, 6) AS BIGINT) AS l, abs(c_acctbal) AS a FROM customer", "customer")
def rounding(t):
    b, k = F.col("c_acctbal"), F.col("c_custkey")
    return t.select("c_custkey", M.ceil(b).alias("c"), M.floor(b).alias("f"), M.trunc(b).alias("t"), F.round(M.mod(b, F.lit(7.5)), 6).alias("m"), M.gcd(k, F.lit(84)).alias("g"), M.lcm(k, F.lit(6)).alias("l"), F.abs(b).alias("a"))


@_on("fn_dates", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS d, strftime(ts, '%H:%M:%S') AS t, strftime(ts, '%Y-%m-%d %H:%M:%S') AS dt, round(epoch_us(ts) / 86400e6 + 2440587.5, 6) AS j, CAST(floor(epoch_us(ts) / 1e6) AS BIGINT) AS u, strftime(ts, '%j') AS yd, CAST(dayofweek(ts) AS VARCHAR) AS w, strftime(ts, '%U') AS wu, strftime(ts, '%W') AS wm, strftime(ts, '%V') AS iso, strftime(ts, '%G') AS g FROM events", "events")
def dates(t):
    s = F.col("ts")
    return t.select("event_id", D.date(s).alias("d"), D.time(s).alias("t"), D.datetime(s).alias("dt"), F.round(D.julianday(s), 6).alias("j"), D.unixepoch(s).alias("u"), D.strftime("%j", s).alias("yd"), D.strftime("%w", s).alias("w"), D.strftime("%U", s).alias("wu"), D.strftime("%W", s).alias("wm"), D.strftime("%V", s).alias("iso"), D.strftime("%G", s).alias("g"))


@_on("fn_date_modifiers", "SELECT o_orderkey, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS m, strftime(date_trunc('year', o_orderdate), '%Y-%m-%d') AS y, strftime(o_orderdate + INTERVAL 10 DAY - INTERVAL 3 HOUR, '%Y-%m-%d %H:%M:%S') AS a, strftime(o_orderdate + to_days(CAST((7 - dayofweek(o_orderdate)) % 7 AS INTEGER)), '%Y-%m-%d') AS w, strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH + to_days(CAST(day(o_orderdate) - 1 AS INTEGER)), '%Y-%m-%d') AS n FROM orders", "orders")
def date_modifiers(t):
    s = lambda *m: D.stamp(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), *m)
    return t.select("o_orderkey", D.date(s("start of month")).alias("m"), D.date(s("start of year")).alias("y"), D.datetime(s("+10 days", "-3 hours")).alias("a"), D.date(s("weekday 0")).alias("w"), D.date(s("+1 month")).alias("n"))


@register("fn_date_forms", """SELECT * FROM (VALUES ('2024-01-31', '+1 month', '2024-03-02 00:00:00'), ('2024-01-31', '+1 month, floor', '2024-02-29 00:00:00'), ('2024-01-31', '+1 month, ceiling', '2024-03-02 00:00:00'), ('12:34', '', '2000-01-01 12:34:00'), ('2460000.5', '', '2023-02-25 00:00:00'), ('1700000000', 'auto', '2023-11-14 22:13:20'), ('2460000.5', 'auto', '2023-02-25 00:00:00'), ('2024-02-29 01:00', '+0001-00-00, floor', '2025-02-28 01:00:00'), ('2024-02-29 01:00', '-0000-01-01 01:30', '2024-01-27 23:30:00'), ('2024-05-01', 'localtime, utc', '2024-05-01 00:00:00'), ('2024-13-01', '', NULL)) t(x, m, d)""")
def date_forms(spark, sf_dir):
    """All forms of a time value, and the modifiers that depend on others."""
    cases = [("2024-01-31", "+1 month"), ("2024-01-31", "+1 month, floor"), ("2024-01-31", "+1 month, ceiling"), ("12:34", ""), ("2460000.5", ""), ("1700000000", "auto"), ("2460000.5", "auto"), ("2024-02-29 01:00", "+0001-00-00, floor"), ("2024-02-29 01:00", "-0000-01-01 01:30"), ("2024-05-01", "localtime, utc"), ("2024-13-01", "")]
    rows = [F.struct(F.lit(x).alias("x"), F.lit(m).alias("m"), D.datetime(D.stamp(F.lit(x), *filter(None, m.split(", ")))).alias("d")) for x, m in cases]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


@_on("fn_time_values", "SELECT event_id, CAST(year(ts) AS INTEGER) AS y, CAST(month(ts) AS INTEGER) AS m, CAST(day(ts) AS INTEGER) AS d, CAST(hour(ts) AS INTEGER) AS h, CAST(minute(ts) AS INTEGER) AS mi, CAST(second(ts) AS INTEGER) AS s, CAST(dayofyear(ts) AS INTEGER) AS yd, CAST(weekofyear(ts) AS INTEGER) AS iw, CAST(isoyear(ts) AS INTEGER) AS iy, CAST((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) * 1000 AS BIGINT) AS sub, CASE WHEN ts < TIMESTAMP '2024-01-15' THEN -1 WHEN ts > TIMESTAMP '2024-01-15' THEN 1 ELSE 0 END AS c, epoch_us(time_bucket(INTERVAL 15 MINUTE, ts)) AS tr FROM events", "events")
def time_values(t):
    s = F.col("ts")
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    return t.select("event_id", F.year(s).alias("y"), F.month(s).alias("m"), F.day(s).alias("d"), F.hour(s).alias("h"), F.minute(s).alias("mi"), F.second(s).alias("s"), F.dayofyear(s).alias("yd"), F.weekofyear(s).alias("iw"), F.date_part(F.lit("YEAROFWEEK"), s).cast("int").alias("iy"), D.time_sub(s, at("2024-01-01")).alias("sub"), D.time_compare(s, at("2024-01-15")).alias("c"), D.micros(D.time_trunc(s, 900_000_000_000)).alias("tr"))


@_on("fn_json_read", "SELECT event_id, json_extract_string(props, '$.' || (json_keys(props)[1])) AS x, CAST(json_valid(props) AS INTEGER) AS v FROM events", "events")
def json_read(t):
    key = F.get(F.json_object_keys("props"), F.lit(0))
    return t.select("event_id", F.call_function("get_json_object", F.col("props"), F.concat(F.lit("$."), key)).alias("x"), J.valid(F.col("props")).alias("v"))


_DOCS = [(1, '{"a":1,"b":[1,2,{"c":"x"}],"d":null}'), (2, "[1,2.5,true]"), (3, '{"a":{"b":"t"}}'), (4, "not json")]


@register("fn_json_types", "SELECT * FROM (VALUES (1, 1, 'object'), (2, 1, 'array'), (3, 1, 'object'), (4, 0, NULL)) t(id, v, t)")
def json_types(spark, sf_dir):
    t = spark.createDataFrame(_DOCS, "id int, j string")
    return t.select("id", J.valid(F.col("j")).alias("v"), J.type_of(F.col("j")).alias("t"))


@register("fn_json_extract", """SELECT * FROM (VALUES (1, '1', 'x', '2'), (2, NULL, NULL, NULL), (3, '{"b":"t"}', NULL, NULL), (4, NULL, NULL, NULL)) t(id, a, c, e)""")
def json_extract(spark, sf_dir):
    t = spark.createDataFrame(_DOCS, "id int, j string")
    return t.select("id", J.extract(F.col("j"), "$.a").alias("a"), J.extract(F.col("j"), "$.b[2].c").alias("c"), J.extract(F.col("j"), "$.b[#-2]").alias("e"))


@register("fn_json_edit", """SELECT * FROM (VALUES (1, '{"a":9,"b":[1,2,{"c":"x"}],"d":null}', '{"a":1,"b":[1,2,{"c":"x"}],"d":null}', '{"a":1,"b":[1,2,{"c":"x"}],"d":null,"z":7}', '{"a":1,"d":null}', '{"b":[1,2,{"c":"x"}],"d":null,"n":1}', '{"a":1,"b":[1,2,{"c":"x"}],"d":null}'), (2, '[1,2.5,true]', '[1,2.5,true]', '[1,2.5,true]', '[1,2.5,true]', '{"n":1}', '[1,2.5,true]'), (3, '{"a":9}', '{"a":{"b":"t"}}', '{"a":{"b":"t"},"z":7}', '{"a":{"b":"t"}}', '{"n":1}', '{"a":{"b":"t"}}'), (4, NULL, NULL, NULL, NULL, NULL, NULL), (5, '{"a":9}', '{"a":1.10}', '{"a":1.10,"z":7}', '{"a":1.10}', '{"n":1}', '{"a":1.10}')) t(id, s, i, z, r, p, q)""")
def json_edit(spark, sf_dir):
    """json_set, json_insert, json_remove, json_patch and json_replace; malformed text gives null, numbers stay as written."""
    t, j = spark.createDataFrame([*_DOCS, (5, '{"a":1.10}')], "id int, j string"), F.col("j")
    return t.select("id", J.set_(j, "$.a", F.lit("9")).alias("s"), J.insert(j, "$.a", F.lit("9")).alias("i"), J.insert(j, "$.z", F.lit("7")).alias("z"), J.remove(j, "$.b").alias("r"), J.patch(j, F.lit('{"a":null,"n":1}')).alias("p"), J.replace(j, "$.z", F.lit("1")).alias("q"))


@register("fn_json_each", "SELECT n_nationkey, CAST(unnest([n_nationkey, n_regionkey]) AS BIGINT) AS v FROM nation")
def json_each(spark, sf_dir):
    """Elements of an array as rows."""
    t = table(spark, sf_dir, "nation").select("n_nationkey", F.to_json(F.array("n_nationkey", "n_regionkey")).alias("j"))
    return t.select("n_nationkey", F.explode(F.from_json("j", "array<bigint>")).alias("v"))


@register("fn_json_tree", "SELECT * FROM (VALUES (0, '$', 'object'), (1, '$.a', 'integer'), (2, '$.b', 'array'), (3, '$.b[0]', 'integer'), (4, '$.b[1]', 'integer'), (5, '$.b[2]', 'object'), (6, '$.b[2].c', 'text'), (7, '$.d', 'null')) t(id, fullkey, type)")
def json_tree(spark, sf_dir):
    spark.udtf.register("json_tree", J.JsonTree)
    return spark.sql("""SELECT t.id, t.fullkey, t.type FROM VALUES ('{"a":1,"b":[1,2,{"c":"x"}],"d":null}') AS d(j), LATERAL json_tree(d.j) t""")


@_on("fn_json_build", """SELECT n_nationkey, '[' || n_nationkey || ',"' || n_name || '",null]' AS a, '{"k":' || n_nationkey || ',"n":"' || n_name || '"}' AS o, 2 AS n FROM nation""")
def json_build(t):
    k, n = F.col("n_nationkey"), F.col("n_name")
    a = J.array_of(k, n, F.lit(None).cast("string"))
    return t.select("n_nationkey", a.alias("a"), J.object_of(k=k, n=n).alias("o"), J.array_length(F.to_json(F.array(k, k))).alias("n"))


@_on("fn_arrays", "SELECT n_nationkey, a[2] AS e, len(a) AS n, array_to_string(list_append(a, 9), ',') AS ap, array_to_string(list_prepend(9, a), ',') AS pr, array_to_string(list_concat(a, [7]), ',') AS cat, list_contains(a, 3) AS c, list_position(a, 3) AS p, array_to_string(a[1:2], ',') AS s, list_has_any(a, [1, 3]) AS o, list_has_all(a, [1]) AS al, array_to_string(string_split(n_name, '_'), '|') AS sp FROM (SELECT n_nationkey, n_name, [n_nationkey, n_regionkey, 3] AS a FROM nation) t".replace("len(a) AS n", "CAST(len(a) AS INTEGER) AS n").replace("list_position(a, 3) AS p", "CAST(list_position(a, 3) AS BIGINT) AS p"))
def arrays(t):
    a = F.array("n_nationkey", "n_regionkey", F.lit(3))
    j = lambda x: F.array_join(x, ",")
    return t.select("n_nationkey", F.try_element_at(a, F.lit(2)).alias("e"), F.size(a).alias("n"), j(F.array_append(a, 9)).alias("ap"), j(F.array_prepend(a, 9)).alias("pr"), j(F.concat(a, F.array(F.lit(7)))).alias("cat"), F.array_contains(a, 3).alias("c"), F.nullif(F.array_position(a, 3), F.lit(0)).alias("p"), j(F.slice(a, 1, 2)).alias("s"), F.arrays_overlap(a, F.array(F.lit(1), F.lit(3))).alias("o"), (F.size(F.array_except(F.array(F.lit(1)), a)) == 0).alias("al"), F.array_join(F.split("n_name", "_"), "|").alias("sp"))


@_on("fn_struct_union", "SELECT n_nationkey, n_name AS f, CASE WHEN n_nationkey % 2 = 0 THEN 'i' ELSE 't' END AS tag, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey END AS i FROM nation")
def struct_union(t):
    """Structs, and tagged unions as a tag with one field for each kind."""
    k = F.col("n_nationkey")
    u = F.when(k % 2 == 0, F.struct(F.lit("i").alias("tag"), k.alias("i"), F.lit(None).cast("string").alias("t"))).otherwise(F.struct(F.lit("t").alias("tag"), F.lit(None).cast("int").alias("i"), F.col("n_name").alias("t")))
    x = t.select("n_nationkey", F.struct("n_nationkey", "n_name").alias("s"), u.alias("u"))
    return x.select("n_nationkey", F.col("s.n_name").alias("f"), F.col("u.tag").alias("tag"), F.when(F.col("u.tag") == "i", F.col("u.i")).alias("i"))


@_on("fn_vectors", "SELECT a.vec_id, round(sqrt(list_sum(list_transform(list_zip(a.embedding, q.e), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2))), 4) AS l2, round(1 - list_sum(list_transform(list_zip(a.embedding, q.e), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) / sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE ** 2)) * list_sum(list_transform(q.e, lambda x: x::DOUBLE ** 2))), 4) AS cos FROM embeddings a, (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) q", "embeddings")
def vectors(t):
    q = t.where("vec_id = 0").select(F.col("embedding").alias("e"))
    x = t.crossJoin(F.broadcast(q))  # one row
    return x.select("vec_id", F.round(V.l2(F.col("embedding"), F.col("e")), 4).alias("l2"), F.round(V.cosine(F.col("embedding"), F.col("e")), 4).alias("cos"))


@register("vector_top_k", "SELECT vec_id FROM (SELECT a.vec_id, sqrt(list_sum(list_transform(list_zip(a.embedding, q.e), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2))) AS d FROM embeddings a, (SELECT embedding AS e FROM embeddings WHERE vec_id = 7) q) t ORDER BY d, vec_id LIMIT 10")
def vector_top_k(spark, sf_dir):
    t = table(spark, sf_dir, "embeddings")
    query = t.where("vec_id = 7").first().embedding
    return V.nearest(t, "embedding", query, 10, V.l2, "vec_id").select("vec_id")


@_on("fn_fuzzy", "SELECT n_nationkey, levenshtein(n_name, 'NATION_12') AS l, damerau_levenshtein(n_name, 'NATOIN_12') AS d, round(jaro_winkler_similarity(n_name, 'NATOIN_12'), 6) AS j, CASE WHEN length(n_name) = 9 THEN CAST(hamming(CASE WHEN length(n_name) = 9 THEN n_name ELSE 'NATION_12' END, 'NATION_12') AS INTEGER) ELSE -1 END AS h FROM nation".replace("levenshtein(n_name, 'NATION_12') AS l", "CAST(levenshtein(n_name, 'NATION_12') AS INTEGER) AS l"))
def fuzzy(t):
    n = F.col("n_name")
    return t.select("n_nationkey", X.fuzzy_leven(n, F.lit("NATION_12")).alias("l"), X.fuzzy_damlev(n, F.lit("NATOIN_12")).alias("d"), F.round(X.fuzzy_jarowin(n, F.lit("NATOIN_12")), 6).alias("j"), X.fuzzy_hamming(n, F.lit("NATION_12")).alias("h"))


@register("fn_ip", "SELECT * FROM (VALUES ('10.1.2.3/8', true, 4, '10.1.2.3', 8, '10.0.0.0/8'), ('192.168.1.9/24', false, 4, '192.168.1.9', 24, '192.168.1.0/24')) t(c, i, f, h, m, n)")
def ips(spark, sf_dir):
    t, c = spark.createDataFrame([("10.1.2.3/8",), ("192.168.1.9/24",)], "c string"), F.col("c")
    return t.select("c", X.ip_contains(c, F.lit("10.200.0.1")).alias("i"), X.ip_family(c).alias("f"), X.ip_host(c).alias("h"), X.ip_masklen(c).alias("m"), X.ip_network(c).alias("n"))


@register("fn_uuid", "SELECT true AS v4, true AS v7, CAST(1700000000000 AS BIGINT) AS ms, true AS round_trip")
def uuids(spark, sf_dir):
    t = spark.range(1).select(F.uuid().alias("u"), X.uuid7(F.lit(1_700_000_000.0)).alias("w"))
    return t.select(F.col("u").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-4").alias("v4"), F.col("w").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-7").alias("v7"), X.uuid7_timestamp_ms(F.col("w")).alias("ms"), (X.uuid_str(X.uuid_blob(F.col("w"))) == F.col("w")).alias("round_trip"))


sql("fn_decimal", "SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) + CAST(1.25 AS DECIMAL(18,2)) AS DOUBLE) AS a, CAST(o_totalprice AS DECIMAL(18,2)) < CAST(100000 AS DECIMAL(18,2)) AS l FROM orders")
sql("pg_input_is_valid", "SELECT x, TRY_CAST(x AS INT) IS NOT NULL AS ok FROM (VALUES ('1'), ('a'), ('12')) t(x)")
sql("pg_casts", "SELECT CAST('2024-02-29' AS DATE) AS d, CAST('42' AS INT) AS i, 'ABC' ILIKE 'a%' AS l")
