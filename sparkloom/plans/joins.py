"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..session import table
from .base import sql
from .registry import register

sql("join_inner", "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_mktsegment = 'BUILDING'")
sql("join_comma", "SELECT n.n_name, r.r_name FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey")
sql("join_cross", "SELECT a.r_name AS a, b.r_name AS b FROM region a CROSS JOIN region b")
sql("join_left", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 350000")
sql("join_right", "SELECT c.c_custkey, o.o_orderkey FROM orders o RIGHT JOIN customer c ON c.c_custkey = o.o_custkey AND o.o_totalprice > 350000")
sql("join_full", "SELECT a.n_nationkey AS x, b.r_regionkey AS y FROM nation a FULL JOIN region b ON a.n_nationkey = b.r_regionkey + 22")
sql("join_natural", "SELECT n_nationkey, n_name, s FROM nation NATURAL JOIN (SELECT n_nationkey, n_nationkey * 2 AS s FROM nation WHERE n_nationkey < 9) t")
sql("join_using", "SELECT n_nationkey, n_name, s FROM nation JOIN (SELECT n_nationkey, n_nationkey * 2 AS s FROM nation) t USING (n_nationkey)")
sql("join_semi", "SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49.5)")
sql("join_anti", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_discount > 0.09)")
sql("join_theta", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey")
sql("join_expression_key", "SELECT a.n_name AS a, b.r_name AS b FROM nation a JOIN region b ON a.n_nationkey % 5 = b.r_regionkey")
sql("join_null_keys", "SELECT a.x, b.y FROM (VALUES (1), (NULL), (2)) a(x) LEFT JOIN (VALUES (1), (NULL)) b(y) ON a.x = b.y")
sql("join_self", "SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id WHERE a.event_type = 'purchase' AND b.event_type = 'purchase'")
sql("join_five_tables", "SELECT r_name, round(sum(l_extendedprice), 2) AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")


@register("join_as_of", """
SELECT o_orderkey, o_custkey, o_orderdate, (SELECT max(p.ts) FROM (SELECT ts, user_id FROM events WHERE event_type = 'click') p WHERE p.user_id = o_custkey AND p.ts <= o_orderdate) AS last_click FROM orders""")
def as_of(spark, sf_dir):
    """Each order with the last click of that user before it."""
    clicks = table(spark, sf_dir, "events").where("event_type = 'click'").select(F.col("user_id").alias("o_custkey"), F.col("ts").alias("last_click"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return J.as_of_join(orders, clicks, ["o_custkey"], "o_orderdate", "last_click", ["last_click"])


@register("join_interval", "SELECT p_partkey, lo FROM part JOIN (SELECT CAST(900 + 50 * range AS DOUBLE) AS lo, CAST(1000 + 50 * range AS DOUBLE) AS hi FROM range(0, 20)) r ON p_retailprice >= lo AND p_retailprice < hi")
def interval(spark, sf_dir):
    """Prices in overlapping bands."""
    bands = spark.range(20).select((900.0 + 50 * F.col("id")).alias("lo"), (1000.0 + 50 * F.col("id")).alias("hi"))
    return J.interval_join(table(spark, sf_dir, "part"), bands, "p_retailprice", "lo", "hi", 100.0).select("p_partkey", "lo")


@register("join_salted", "SELECT l_returnflag, count(*) AS n FROM lineitem JOIN (SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem) t USING (l_returnflag) GROUP BY l_returnflag")
def salted(spark, sf_dir):
    """A join on a key of three values."""
    t = table(spark, sf_dir, "lineitem")
    return J.salted_join(t.select("l_returnflag", "l_orderkey", "l_linenumber"), t.select("l_returnflag", "l_linestatus").distinct(), ["l_returnflag"]).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@register("join_lateral_table_function", "SELECT n_name, CAST(unnest(range(1, n_nationkey + 1)) AS BIGINT) AS k FROM nation WHERE n_nationkey < 6")
def lateral(spark, sf_dir):
    table(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    return spark.sql("SELECT n_name, CAST(k AS BIGINT) AS k FROM nation, LATERAL explode(sequence(1, n_nationkey)) AS t(k) WHERE n_nationkey BETWEEN 1 AND 5")
