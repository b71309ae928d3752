"""Queries of a web analytics log, over the event table, and graph-like walks."""

from __future__ import annotations

from .base import sql

sql("clicks_count", "SELECT count(*) AS n FROM events")
sql("clicks_filtered", "SELECT count(*) AS n FROM events WHERE value <> 0 AND event_type <> 'click'")
sql("clicks_totals", "SELECT round(sum(value), 3) AS s, count(*) AS n, round(avg(value), 6) AS a FROM events")
sql("clicks_users", "SELECT count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS kinds FROM events")
sql("clicks_range", "SELECT min(ts) AS lo, max(ts) AS hi FROM events")
sql("clicks_by_type", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type")
sql("clicks_top_users", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10")
sql("clicks_top_pairs", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type ORDER BY n DESC, user_id, event_type LIMIT 10")
sql("clicks_by_minute", "SELECT user_id, minute(ts) AS m, event_type, count(*) AS n FROM events GROUP BY user_id, minute(ts), event_type ORDER BY n DESC, user_id, m, event_type LIMIT 10", "SELECT user_id, CAST(minute(ts) AS INTEGER) AS m, event_type, count(*) AS n FROM events GROUP BY ALL ORDER BY n DESC, user_id, m, event_type LIMIT 10")
sql("clicks_point_lookup", "SELECT event_id FROM events WHERE user_id = 17")
sql("clicks_like", "SELECT count(*) AS n FROM pages WHERE url LIKE '%example%'")
sql("clicks_like_top", "SELECT length(url) AS k, min(url) AS u, count(*) AS n FROM pages WHERE url LIKE '%blog%' GROUP BY length(url) ORDER BY n DESC, k LIMIT 10", "SELECT CAST(length(url) AS INTEGER) AS k, min(url) AS u, count(*) AS n FROM pages WHERE url LIKE '%blog%' GROUP BY ALL ORDER BY n DESC, k LIMIT 10")
sql("clicks_latest", "SELECT event_id, ts FROM events WHERE event_type = 'purchase' ORDER BY ts, event_id LIMIT 10")
sql("clicks_host", r"SELECT regexp_replace(url, '^https?://(?:www\\.)?([^/]+)/.*$', '$1') AS k, round(avg(length(url)), 4) AS l, count(*) AS n FROM pages GROUP BY 1 HAVING count(*) > 1", r"SELECT regexp_replace(url, '^https?://(?:www\.)?([^/]+)/.*$', '\1') AS k, round(avg(length(url)), 4) AS l, count(*) AS n FROM pages GROUP BY 1 HAVING count(*) > 1")
sql("clicks_wide_sum", "SELECT " + ", ".join(f"sum(l_linenumber + {k}) AS s{k}" for k in range(30)) + " FROM lineitem", "SELECT " + ", ".join(f"CAST(sum(l_linenumber + {k}) AS BIGINT) AS s{k}" for k in range(30)) + " FROM lineitem")
sql("clicks_derived_keys", "SELECT user_id, user_id - 1 AS a, user_id - 2 AS b, count(*) AS n FROM events GROUP BY user_id, user_id - 1, user_id - 2 ORDER BY n DESC, user_id LIMIT 10")
sql("clicks_offset", "SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10 OFFSET 20")
sql("clicks_case_key", "SELECT CASE WHEN value > 50 THEN event_type ELSE '' END AS src, count(*) AS n FROM events GROUP BY 1")
sql("clicks_by_day", "SELECT CAST(ts AS DATE) AS d, count(*) AS n, count(DISTINCT user_id) AS u FROM events GROUP BY CAST(ts AS DATE)")
sql("graph_two_hops", "SELECT DISTINCT a.x, c.y FROM (SELECT DISTINCT o_custkey AS x, l_partkey AS p FROM orders JOIN lineitem ON o_orderkey = l_orderkey) a JOIN (SELECT DISTINCT l_partkey AS p, l_suppkey AS y FROM lineitem) c ON a.p = c.p")
sql("graph_degree", "SELECT l_suppkey AS node, count(DISTINCT l_partkey) AS degree FROM lineitem GROUP BY l_suppkey")
sql("graph_streaks", "SELECT user_id, max(n) AS longest FROM (SELECT user_id, grp, count(*) AS n FROM (SELECT user_id, d, date_add(d, -CAST(row_number() OVER (PARTITION BY user_id ORDER BY d) AS INT)) AS grp FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events) x) y GROUP BY user_id, grp) z GROUP BY user_id", "SELECT user_id, max(n) AS longest FROM (SELECT user_id, grp, count(*) AS n FROM (SELECT user_id, d, d - CAST(row_number() OVER (PARTITION BY user_id ORDER BY d) AS INTEGER) AS grp FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events) x) y GROUP BY user_id, grp) z GROUP BY user_id")
sql("graph_conversations", "SELECT conv_id, count(*) AS turns, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS asked FROM conversations GROUP BY conv_id", "SELECT conv_id, count(*) AS turns, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS BIGINT) AS asked FROM conversations GROUP BY conv_id")
