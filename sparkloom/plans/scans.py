"""Scans, projections, predicates and operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import core as C
from ..session import table
from ..sources import catalog, series
from .base import run_sql, sql
from .registry import register

sql("scan_full", "SELECT r_regionkey, r_name FROM region")
sql("scan_covering", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 49")
sql("seek_primary_key", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 42")
sql("seek_range", "SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem WHERE l_orderkey >= 100 AND l_orderkey < 120")
sql("seek_in_list", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (1, 5, 5, 42, 1000000)")
sql("multi_index_or", "SELECT p_partkey FROM part WHERE p_size = 10 OR p_brand = 'Brand#13'")
sql("multi_index_and", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_brand = 'Brand#13'")
sql("partial_index", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 400000")
sql("expression_index", "SELECT c_custkey FROM customer WHERE substr(c_name, 10, 8) = '00000007'")
sql("values_rows", "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS v(x, y)")
sql("from_subquery", "SELECT s.k, s.n FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) s WHERE s.n >= 3")
sql("cte_once", "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 300000) SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey")
sql("cte_twice", "WITH t AS (SELECT o_custkey AS k, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY o_custkey) SELECT a.k, a.s FROM t a WHERE a.s > (SELECT avg(s) FROM t)")
sql("cte_column_list", "WITH c(a, b) AS (SELECT n_nationkey, n_name FROM nation) SELECT a, b FROM c WHERE a < 5")
sql("cte_recursive", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 50) SELECT CAST(n AS BIGINT) AS n FROM t")
sql("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
sql("star_expansion", "SELECT n.*, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
sql("three_valued_logic", "SELECT event_id, (value > 50 AND event_type = 'click') AS a, (value > 50 OR NULL) AS o, NOT (value > 50) AS n FROM events")
sql("null_safe_equality", "SELECT a.x, b.y FROM (VALUES (1), (NULL), (3)) a(x) JOIN (VALUES (1), (NULL), (4)) b(y) ON a.x IS NOT DISTINCT FROM b.y")
sql("is_true", "SELECT n_nationkey, (n_nationkey > 5) IS TRUE AS t, (n_nationkey > NULL) IS NOT TRUE AS u FROM nation")
sql("is_null", "SELECT x, x IS NULL AS n, x IS NOT NULL AS m FROM (VALUES (1), (NULL)) t(x)")
sql("between", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity NOT BETWEEN 5 AND 45")
sql("in_table", "SELECT n_name FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name <> 'ASIA')")
sql("not_in_with_null", "SELECT n_name FROM nation WHERE n_nationkey NOT IN (SELECT CASE WHEN r_regionkey = 0 THEN NULL ELSE r_regionkey END FROM region)")
sql("like_ignores_case", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%A%' AND p_type NOT ILIKE 'z%'")
sql("like_escape", r"SELECT x FROM (VALUES ('a%b'), ('axb'), ('a_b')) t(x) WHERE x LIKE 'a!%b' ESCAPE '!'")
sql("row_values", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE struct(l_orderkey, l_linenumber) < named_struct('l_orderkey', 20L, 'l_linenumber', 3)", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey, l_linenumber) < (20, 3)")
sql("case_searched", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders")
sql("case_simple", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS code FROM orders")
sql("scalar_subquery", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)")
sql("exists_subquery", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)")
sql("not_exists_subquery", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)")
sql("correlated_subquery", "SELECT c_custkey, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n FROM customer c")
sql("bitwise", "SELECT n_nationkey, n_nationkey & 6 AS a, n_nationkey | 6 AS o, ~n_nationkey AS c FROM nation")
sql("unary", "SELECT n_nationkey, -n_nationkey AS m, +n_nationkey AS p FROM nation")


@register("in_list_glob", "SELECT p_partkey FROM part WHERE p_type GLOB 'S*[A-E]?*' OR p_brand GLOB 'Brand#[12]*'")
def glob(spark, sf_dir):
    """Case-sensitive patterns, rewritten to regular expressions that run in the JVM."""
    return table(spark, sf_dir, "part").where(C.glob("S*[A-E]?*", F.col("p_type")) | C.glob("Brand#[12]*", F.col("p_brand"))).select("p_partkey")


@register("division", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber - 3 = 0 THEN NULL ELSE CAST(trunc(l_orderkey / (l_linenumber - 3)) AS BIGINT) END AS q, CASE WHEN l_linenumber - 3 = 0 THEN NULL ELSE CAST(l_orderkey % (l_linenumber - 3) AS BIGINT) END AS r, CASE WHEN l_discount = 0 THEN NULL ELSE round(l_tax / l_discount, 6) END AS f FROM lineitem")
def division(spark, sf_dir):
    """Integers divide to integers, by zero to null; REAL operands divide as REAL."""
    t, by = table(spark, sf_dir, "lineitem"), F.col("l_linenumber") - 3
    return t.select("l_orderkey", "l_linenumber", C.divide(F.col("l_orderkey"), by, integers=True).alias("q"), C.modulo(F.col("l_orderkey"), by).alias("r"), F.round(C.divide(F.col("l_tax"), F.col("l_discount")), 6).alias("f"))


@register("overflow_to_real", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'BIGINT', '2', CAST(NULL AS DOUBLE)), (9007199254740992, 'BIGINT', '9007199254740993', NULL), (9223372036854775806, 'BIGINT', '9223372036854775807', NULL), (9223372036854775807, 'DOUBLE', NULL, CAST(9223372036854775808.0 AS DOUBLE))) t(x, kind, i, r)")
def overflow(spark, sf_dir):
    """Integer addition stays an integer, to the last digit, unless it overflows: then it goes on as REAL."""
    t = spark.sql("SELECT x, x AS y FROM VALUES (1L), (9007199254740992L), (9223372036854775806L), (9223372036854775807L) AS t(x)")
    t = t.select("x", C.add(F.col("y"), F.lit(1).cast("long")).alias("v")).withColumn("kind", F.schema_of_variant("v"))
    return t.select("x", "kind", F.when(F.col("kind") == "BIGINT", F.variant_get("v", "$", "string")).alias("i"), F.when(F.col("kind") == "DOUBLE", F.variant_get("v", "$", "double")).alias("r"))


@register("shifts", "SELECT k, CAST(CASE WHEN k >= 64 THEN 0 WHEN k >= 0 THEN CAST(5 AS BIGINT) << k WHEN k > -64 THEN CAST(5 AS BIGINT) >> (-k) ELSE 0 END AS BIGINT) AS l FROM (VALUES (0), (3), (-1), (40), (64), (-64)) t(k)")
def shifts(spark, sf_dir):
    """A negative count shifts the other way, a count of 64 or more gives 0 (or the sign)."""
    return spark.sql("SELECT * FROM VALUES (0), (3), (-1), (40), (64), (-64) AS t(k)").select("k", C.shift_left(F.lit(5).cast("long"), F.col("k")).alias("l"))


@register("concat_operator", "SELECT n_name || '-' || n_nationkey AS s FROM nation")
def concat(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.concat("n_name", F.lit("-"), F.col("n_nationkey").cast("string")).alias("s"))


@register("collate_nocase", "SELECT lower(x) AS k, count(*) AS n FROM (VALUES ('a'), ('A'), ('b'), ('B '), ('b ')) t(x) GROUP BY lower(x)")
def collate(spark, sf_dir):
    """Groups under a collation that ignores case; the key is shown in lower case."""
    return spark.sql("SELECT lower(min(x)) AS k, count(*) AS n FROM VALUES ('a'), ('A'), ('b'), ('B '), ('b ') AS t(x) GROUP BY collate(x, 'UTF8_LCASE')").select(F.col("k").cast("string").alias("k"), "n")


@register("parameters", "SELECT o_orderkey FROM orders WHERE o_custkey = 7 AND o_totalprice > 1000")
def parameters(spark, sf_dir):
    return run_sql(spark, sf_dir, "SELECT o_orderkey FROM orders WHERE o_custkey = :who AND o_totalprice > :least", who=7, least=1000)


@register("generate_series", "SELECT CAST(range AS BIGINT) AS value FROM range(5, 101, 5)")
def generate_series(spark, sf_dir):
    return series.generate_series(spark, 5, 100, 5)


@register("generate_series_lateral", "SELECT n_nationkey, CAST(unnest(range(1, n_nationkey % 3 + 2)) AS BIGINT) AS value FROM nation")
def series_lateral(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(1).cast("long"), (F.col("n_nationkey") % 3 + 1).cast("long"))).alias("value"))


@register("table_info", "SELECT CAST(ordinal_position - 1 AS BIGINT) AS cid, column_name AS name FROM information_schema.columns WHERE table_name = 'nation'")
def table_info(spark, sf_dir):
    return catalog.table_info(table(spark, sf_dir, "nation")).select("cid", "name")


@register("view_scan", "SELECT n_name, n_regionkey FROM nation WHERE n_regionkey = 2")
def view(spark, sf_dir):
    """A view is inlined: its filter reaches the scan."""
    catalog.create_view(spark, "asia_view", table(spark, sf_dir, "nation").where("n_regionkey = 2"))
    return spark.sql("SELECT n_name, n_regionkey FROM asia_view")


@register("csv_table", "SELECT r_regionkey, r_name FROM region")
def csv_table(spark, sf_dir):
    """A table that went through a CSV file."""
    return catalog.through_csv(table(spark, sf_dir, "region"))
