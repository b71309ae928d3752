"""Decision-support queries in the shape of TPC-H, adapted to the generated tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import table
from .registry import register


@register("tpch_q1", """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS sum_qty, round(sum(l_extendedprice), 4) AS sum_base_price,
       round(sum(l_extendedprice * (1 - l_discount)), 4) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 4) AS sum_charge,
       round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 4) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def q1(spark, sf_dir):
    """Pricing summary: scan, filter, partial and final aggregate on two low-cardinality keys."""
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    r = lambda c, n: F.round(c, n)
    return (
        table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02'").groupBy("l_returnflag", "l_linestatus")
        .agg(r(F.sum("l_quantity"), 4).alias("sum_qty"), r(F.sum("l_extendedprice"), 4).alias("sum_base_price"), r(F.sum(price), 4).alias("sum_disc_price"),
             r(F.sum(price * (1 + F.col("l_tax"))), 4).alias("sum_charge"), r(F.avg("l_quantity"), 4).alias("avg_qty"), r(F.avg("l_extendedprice"), 4).alias("avg_price"),
             r(F.avg("l_discount"), 4).alias("avg_disc"), F.count(F.lit(1)).alias("count_order"))
    )


def _rev(name: str, text: str, oracle: str | None = None) -> None:
    from .base import sql

    sql(name, text, oracle)


_rev("tpch_q3", "SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP_NTZ '1997-03-15' AND l_shipdate > TIMESTAMP_NTZ '1997-03-15' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10", "SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1997-03-15' AND l_shipdate > TIMESTAMP '1997-03-15' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10")
_rev("tpch_q4", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate) GROUP BY o_orderpriority")
_rev("tpch_q5", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name")
_rev("tpch_q6", "SELECT round(sum(l_extendedprice * l_discount), 4) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
_rev("tpch_q7", "SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, year(l_shipdate) AS l_year, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation n1 ON s_nationkey = n1.n_nationkey JOIN nation n2 ON c_nationkey = n2.n_nationkey WHERE n1.n_regionkey <> n2.n_regionkey GROUP BY n1.n_name, n2.n_name, year(l_shipdate)", "SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(year(l_shipdate) AS INTEGER) AS l_year, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation n1 ON s_nationkey = n1.n_nationkey JOIN nation n2 ON c_nationkey = n2.n_nationkey WHERE n1.n_regionkey <> n2.n_regionkey GROUP BY ALL")
_rev("tpch_q8", "SELECT year(o_orderdate) AS y, round(sum(CASE WHEN n_name = 'NATION_3' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS share FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE p_size < 25 GROUP BY year(o_orderdate)", "SELECT CAST(year(o_orderdate) AS INTEGER) AS y, round(sum(CASE WHEN n_name = 'NATION_3' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS share FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE p_size < 25 GROUP BY ALL")
_rev("tpch_q9", "SELECT n_name, year(o_orderdate) AS y, round(sum(l_extendedprice * (1 - l_discount) - p_retailprice * l_quantity * 0.1), 4) AS profit FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN nation ON s_nationkey = n_nationkey WHERE p_name LIKE '%a%' GROUP BY n_name, year(o_orderdate)", "SELECT n_name, CAST(year(o_orderdate) AS INTEGER) AS y, round(sum(l_extendedprice * (1 - l_discount) - p_retailprice * l_quantity * 0.1), 4) AS profit FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN nation ON s_nationkey = n_nationkey WHERE p_name LIKE '%a%' GROUP BY ALL")
_rev("tpch_q10", "SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, n_name FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey WHERE l_returnflag = 'R' GROUP BY c_custkey, c_name, n_name ORDER BY revenue DESC, c_custkey LIMIT 20")
_rev("tpch_q12", "SELECT o_orderpriority, sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS open_lines, sum(CASE WHEN l_linestatus <> 'O' THEN 1 ELSE 0 END) AS other FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity BETWEEN 10 AND 20 GROUP BY o_orderpriority", "SELECT o_orderpriority, CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS open_lines, CAST(sum(CASE WHEN l_linestatus <> 'O' THEN 1 ELSE 0 END) AS BIGINT) AS other FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity BETWEEN 10 AND 20 GROUP BY o_orderpriority")
_rev("tpch_q13", "SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority <> '1-URGENT' GROUP BY c_custkey) t GROUP BY c_count")
_rev("tpch_q14", "SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo FROM lineitem JOIN part ON l_partkey = p_partkey")
_rev("tpch_q15", "WITH revenue AS (SELECT l_suppkey AS k, round(sum(l_extendedprice * (1 - l_discount)), 4) AS total FROM lineitem GROUP BY l_suppkey) SELECT s_suppkey, s_name, total FROM supplier JOIN revenue ON s_suppkey = k WHERE total = (SELECT max(total) FROM revenue)")
_rev("tpch_q16", "SELECT p_brand, p_size, count(DISTINCT l_suppkey) AS suppliers FROM part JOIN lineitem ON p_partkey = l_partkey WHERE p_brand <> 'Brand#11' AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY p_brand, p_size")
_rev("tpch_q17", "SELECT round(sum(l_extendedprice) / 7.0, 4) AS yearly FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size < 10 AND l_quantity < (SELECT 0.5 * avg(l_quantity) FROM lineitem x WHERE x.l_partkey = p_partkey)")
_rev("tpch_q18", "SELECT c_custkey, o_orderkey, o_totalprice, round(sum(l_quantity), 4) AS q FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200) GROUP BY c_custkey, o_orderkey, o_totalprice")
_rev("tpch_q19", "SELECT round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey WHERE (p_size BETWEEN 1 AND 15 AND l_quantity BETWEEN 1 AND 11) OR (p_size BETWEEN 16 AND 30 AND l_quantity BETWEEN 10 AND 20) OR (p_size > 30 AND l_quantity > 40)")
_rev("tpch_q20", "SELECT s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7) GROUP BY l_suppkey HAVING sum(l_quantity) > 50)")
_rev("tpch_q21", "SELECT s_name, count(*) AS n FROM supplier JOIN lineitem l1 ON s_suppkey = l1.l_suppkey WHERE EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey) AND NOT EXISTS (SELECT 1 FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_returnflag = 'R') GROUP BY s_name")
_rev("tpch_q22", "SELECT c_nationkey, count(*) AS n, round(sum(c_acctbal), 4) AS s FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000) GROUP BY c_nationkey")
