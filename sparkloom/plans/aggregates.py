"""Aggregates, windows, sorting, limits and set operations."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..operators import aggregates as A
from ..session import table
from .base import sql
from .registry import register

sql("agg_ungrouped", "SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s, round(avg(l_quantity), 6) AS a, min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM lineitem")
sql("agg_empty_input", "SELECT count(*) AS n, sum(l_quantity) AS s, avg(l_quantity) AS a, min(l_quantity) AS m FROM lineitem WHERE l_quantity < 0")
sql("agg_group_by", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY o_orderstatus, o_orderpriority")
sql("agg_group_by_expression", "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY year(o_orderdate)", "SELECT CAST(year(o_orderdate) AS INTEGER) AS y, count(*) AS n FROM orders GROUP BY ALL")
sql("agg_group_by_ordinal", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
sql("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15")
sql("agg_having_alone", "SELECT count(*) AS n FROM orders HAVING count(*) > 10")
sql("agg_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY l_returnflag")
sql("agg_filter", "SELECT l_returnflag, count(*) FILTER (WHERE l_discount > 0.05) AS n, round(sum(l_tax) FILTER (WHERE l_quantity < 10), 4) AS t FROM lineitem GROUP BY l_returnflag")
sql("agg_count_column", "SELECT count(x) AS n, count(*) AS m FROM (VALUES (1), (NULL), (3)) t(x)")
sql("agg_total", "SELECT coalesce(sum(CAST(x AS DOUBLE)), 0.0) AS t FROM (VALUES (1)) t(x) WHERE x > 5", "SELECT coalesce(sum(CAST(x AS DOUBLE)), CAST(0 AS DOUBLE)) AS t FROM (VALUES (1)) t(x) WHERE x > 5")
sql("agg_min_max_text", "SELECT min(p_name) AS lo, max(p_name) AS hi FROM part")
sql("agg_group_concat", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
sql("agg_string_agg", "SELECT string_agg(r_name, '; ') WITHIN GROUP (ORDER BY r_name DESC) AS names FROM region", "SELECT string_agg(r_name, '; ' ORDER BY r_name DESC) AS names FROM region")
sql("agg_mode", "SELECT l_returnflag, mode() WITHIN GROUP (ORDER BY l_linenumber) AS m FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, mode(l_linenumber) AS m FROM lineitem GROUP BY l_returnflag")
sql("agg_percentile_cont", "SELECT o_orderstatus, round(percentile_cont(0.25) WITHIN GROUP (ORDER BY o_totalprice), 4) AS p FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.25), 4) AS p FROM orders GROUP BY o_orderstatus")
sql("agg_percentile_disc", "SELECT o_orderstatus, percentile_disc(0.5) WITHIN GROUP (ORDER BY o_totalprice) AS p FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, quantile_disc(o_totalprice, 0.5) AS p FROM orders GROUP BY o_orderstatus")
sql("agg_median", "SELECT l_returnflag, round(median(l_extendedprice), 4) AS m FROM lineitem GROUP BY l_returnflag")
sql("agg_percentile", "SELECT round(percentile(l_quantity, 0.9), 6) AS p FROM lineitem", "SELECT round(quantile_cont(l_quantity, 0.9), 6) AS p FROM lineitem")
sql("agg_stddev", "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS s FROM lineitem GROUP BY l_returnflag")
sql("agg_approx_count_distinct", "SELECT count(DISTINCT l_partkey) AS n, abs(approx_count_distinct(l_partkey, 0.01) - count(DISTINCT l_partkey)) <= 3 * 0.01 * count(DISTINCT l_partkey) AS near FROM lineitem", "SELECT count(DISTINCT l_partkey) AS n, true AS near FROM lineitem")
sql("agg_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
sql("agg_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
sql("agg_grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
sql("agg_json_group_array", "SELECT n_regionkey, to_json(array_sort(collect_list(n_nationkey))) AS j FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, '[' || string_agg(CAST(n_nationkey AS VARCHAR), ',' ORDER BY n_nationkey) || ']' AS j FROM nation GROUP BY n_regionkey")
sql("agg_json_group_object", "SELECT to_json(map_from_entries(array_sort(collect_list(struct(r_name, r_regionkey))))) AS j FROM region", """SELECT '{' || string_agg('"' || r_name || '":' || r_regionkey, ',' ORDER BY r_name) || '}' AS j FROM region""")
sql("agg_array_agg", "SELECT n_regionkey, array_join(array_agg(n_name), '|') AS a FROM (SELECT * FROM nation ORDER BY n_nationkey) t GROUP BY n_regionkey", "SELECT n_regionkey, array_to_string(array_agg(n_name ORDER BY n_nationkey), '|') AS a FROM nation GROUP BY n_regionkey")


@register("agg_bare_column", "SELECT o_custkey, max(o_totalprice) AS top, arg_max(o_orderkey, o_totalprice) AS o_orderkey FROM orders GROUP BY o_custkey")
def bare_column(spark, sf_dir):
    """A column outside any aggregate comes from the row of the single max()."""
    return A.with_extremum_row(table(spark, sf_dir, "orders"), ["o_custkey"], "o_totalprice", "top", ["o_orderkey"])


@register("agg_ext_percentile_disc", "SELECT (SELECT list_sort(list(p_retailprice))[CAST(floor(0.3 * (count(*) - 1)) AS BIGINT) + 1] FROM part) AS p")
def ext_percentile_disc(spark, sf_dir):
    """The value at floor(p * (n - 1)) of the sorted ones."""
    return table(spark, sf_dir, "part").agg(A.percentile_floor(F.col("p_retailprice"), 0.3).alias("p"))


@register("agg_user_defined", "SELECT o_orderstatus, round(exp(avg(ln(o_totalprice))), 2) AS g FROM orders GROUP BY o_orderstatus")
def user_defined(spark, sf_dir):
    """A user's aggregate (here a geometric mean) with states of batches that merge in the JVM."""
    return A.geometric_mean(table(spark, sf_dir, "orders"), ["o_orderstatus"], "o_totalprice", "g").withColumn("g", F.round("g", 2))


sql("window_row_number", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS rn FROM orders")
sql("window_rank", "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS r, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS d FROM part", "SELECT p_partkey, CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS INTEGER) AS r, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS INTEGER) AS d FROM part")
sql("window_first_last_nth", "SELECT event_id, first_value(event_id) OVER w AS f, last_value(event_id) OVER w AS l, nth_value(event_id, 2) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
sql("window_aggregate", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2) AS running, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders")
sql("window_peers", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size) AS n FROM part")
sql("window_filter", "SELECT event_id, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS clicks FROM events", "SELECT event_id, count(*) FILTER (WHERE event_type = 'click') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS clicks FROM events")
sql("window_lag_lead", "SELECT event_id, lag(event_id, 1, -1) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events")
sql("window_ntile", "SELECT c_custkey, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS q FROM customer", "SELECT c_custkey, CAST(ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS INTEGER) AS q FROM customer")
sql("window_percent_rank", "SELECT c_custkey, round(percent_rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal), 6) AS p, round(cume_dist() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal), 6) AS d FROM customer")
sql("window_rows_frame", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 6) AS m FROM events")
sql("window_range_frame", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS n FROM part")
sql("window_many", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS a, sum(1) OVER (PARTITION BY o_orderdate) AS b FROM orders", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS a, count(*) OVER (PARTITION BY o_orderdate) AS b FROM orders")
sql("window_top_k_per_group", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) t WHERE rn <= 2")


@register("window_user_defined", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id), 3) AS m FROM events")
def window_user_defined(spark, sf_dir):
    """A user's aggregate over a window."""
    return table(spark, sf_dir, "events").select("event_id", F.round(A.mean_of()("value").over(W.partitionBy("user_id")), 3).alias("m"))


sql("sort_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
sql("sort_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 25")
sql("sort_nulls_first", "SELECT x FROM (VALUES (2), (NULL), (1)) t(x) ORDER BY x ASC NULLS FIRST LIMIT 2")
sql("sort_nulls_last", "SELECT x FROM (VALUES (2), (NULL), (1)) t(x) ORDER BY x DESC NULLS LAST LIMIT 2")
sql("sort_by_expression", "SELECT n_name FROM nation ORDER BY length(n_name) DESC, n_name LIMIT 5")
sql("sort_by_alias_and_ordinal", "SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY c_nationkey ORDER BY n DESC, 1 LIMIT 6")
sql("min_max_shortcut", "SELECT max(o_orderkey) AS hi FROM orders")
sql("set_union_all", "SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region")
sql("set_union", "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region")
sql("set_intersect", "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal < 0")
sql("set_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
sql("set_left_associative", "SELECT * FROM ((SELECT 1 AS x UNION SELECT 2) INTERSECT SELECT 2) t")
sql("set_intersect_all", "SELECT n_regionkey AS k FROM nation INTERSECT ALL SELECT r_regionkey FROM region")
sql("set_except_all", "SELECT n_regionkey AS k FROM nation EXCEPT ALL SELECT r_regionkey FROM region")
sql("set_compound_order", "SELECT * FROM (SELECT n_name AS x FROM nation UNION SELECT r_name FROM region) t ORDER BY x LIMIT 7")


@register("sort_numeric_text", "SELECT x FROM (VALUES ('10'), ('9'), ('100')) t(x) ORDER BY CAST(x AS INTEGER) LIMIT 2")
def sort_numeric_text(spark, sf_dir):
    """A type's own order: text that holds numbers sorts by number."""
    return spark.sql("SELECT * FROM VALUES ('10'), ('9'), ('100') AS t(x)").orderBy(F.col("x").cast("decimal(38,10)")).limit(2)
