"""Queries in the embedded dialect, through the rewriter."""

from __future__ import annotations

from .base import views
from .dialect import sql as run
from .registry import register


def _text(name: str, text: str, oracle: str) -> None:
    def query(spark, sf_dir):
        views(spark, sf_dir, text)
        return run(spark, text)

    register(name, oracle)(query)


_text("sql_like_glob", "SELECT p_partkey FROM part WHERE p_name LIKE '%A%' AND p_type GLOB 'S*'", "SELECT p_partkey FROM part WHERE p_name ILIKE '%A%' AND p_type GLOB 'S*'")
_text("sql_is", "SELECT n_nationkey, n_regionkey IS 2 AS a, NULL IS n_regionkey AS b, n_regionkey IS NOT 2 AS c FROM nation", "SELECT n_nationkey, n_regionkey IS NOT DISTINCT FROM 2 AS a, NULL IS NOT DISTINCT FROM n_regionkey AS b, n_regionkey IS DISTINCT FROM 2 AS c FROM nation")
_text("sql_set_chain", "SELECT 1 AS x UNION SELECT 2 INTERSECT SELECT 2", "SELECT * FROM ((SELECT 1 AS x UNION SELECT 2) INTERSECT SELECT 2) t")
_text("sql_functions", "SELECT l_returnflag, total(l_quantity) AS t, iif(count(*) == 0, 'none', 'some') AS s, length(group_concat(DISTINCT l_linestatus)) AS g FROM lineitem NOT INDEXED GROUP BY l_returnflag", "SELECT l_returnflag, CAST(sum(l_quantity) AS DOUBLE) AS t, CASE WHEN count(*) = 0 THEN 'none' ELSE 'some' END AS s, CAST(length(string_agg(DISTINCT l_linestatus, ',')) AS INT) AS g FROM lineitem GROUP BY l_returnflag")
_text("sql_limits", "SELECT \"o_orderkey\" AS [k] FROM orders ORDER BY o_orderkey LIMIT 5, 3", "SELECT o_orderkey AS k FROM orders ORDER BY o_orderkey LIMIT 3 OFFSET 5")
_text("sql_cte_hints", "WITH t AS MATERIALIZED (SELECT o_custkey AS k FROM orders WHERE o_totalprice NOTNULL) SELECT k, count(*) AS n FROM t GROUP BY k -- by customer", "SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY ALL")
_text("sql_dates", "SELECT event_id, date(ts) AS d, unixepoch(ts) AS u FROM events", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS d, CAST(floor(epoch(ts)) AS BIGINT) AS u FROM events")
