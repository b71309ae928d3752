"""Writes, constraints, change capture, full-text search and incremental views as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dml as W, fts
from ..session import folder, table
from ..streaming import ivm
from .base import sql
from .registry import register


def _customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")


@register("dml_insert_defaults", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 77, 'NEW' UNION ALL SELECT 78, 'unnamed'")
def insert_defaults(spark, sf_dir):
    t = table(spark, sf_dir, "region")
    t = W.insert(t, spark.createDataFrame([(77, "NEW")], "r_regionkey int, r_name string"))
    return W.insert(t, spark.createDataFrame([(78,)], "r_regionkey int"), {"r_name": F.lit("unnamed")})


@register("dml_insert_or_ignore", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 9, 'I'")
def or_ignore(spark, sf_dir):
    return W.insert_or(table(spark, sf_dir, "region"), spark.createDataFrame([(1, "X"), (9, "I")], "r_regionkey int, r_name string"), ["r_regionkey"], "ignore")


@register("dml_replace", "SELECT r_regionkey, CASE WHEN r_regionkey = 1 THEN 'X' ELSE r_name END AS r_name FROM region UNION ALL SELECT 9, 'I'")
def replace(spark, sf_dir):
    return W.insert_or(table(spark, sf_dir, "region"), spark.createDataFrame([(1, "X"), (9, "I")], "r_regionkey int, r_name string"), ["r_regionkey"], "replace")


@register("dml_upsert", "SELECT c.c_custkey, c.c_name, round(c.c_acctbal + coalesce(o.s, 0), 2) AS c_acctbal FROM customer c LEFT JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey")
def upsert(spark, sf_dir):
    """ON CONFLICT DO UPDATE SET c_acctbal = c_acctbal + excluded.c_acctbal."""
    new = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.lit("?").alias("c_name"), F.round(F.sum("o_totalprice"), 2).alias("c_acctbal"))
    out = W.upsert(_customers(spark, sf_dir), new, ["c_custkey"], {"c_acctbal": "t.c_acctbal + excluded.c_acctbal"})
    return out.withColumn("c_acctbal", F.round("c_acctbal", 2))


@register("dml_update", "SELECT c_custkey, c_name, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer".replace("0.0", "CAST(0 AS DOUBLE)"))
def update(spark, sf_dir):
    return W.update(_customers(spark, sf_dir), "c_acctbal < 0", {"c_acctbal": "0.0"})


@register("dml_update_from", "SELECT c.c_custkey, coalesce(n.n_name, c.c_name) AS c_name, c.c_acctbal FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_custkey")
def update_from(spark, sf_dir):
    source = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("c_custkey"), "n_name")
    return W.update_from(_customers(spark, sf_dir), source, ["c_custkey"], {"c_name": "s.n_name"})


@register("dml_delete", "SELECT c_custkey FROM customer WHERE NOT coalesce(c_acctbal < 0, false)")
def delete(spark, sf_dir):
    return W.delete(_customers(spark, sf_dir), "c_acctbal < 0").select("c_custkey")


@register("dml_returning", "SELECT c_custkey, c_acctbal * 2 AS doubled FROM customer WHERE c_acctbal > 9000")
def returning(spark, sf_dir):
    return W.returning(_customers(spark, sf_dir), "c_acctbal > 9000", "c_custkey", "c_acctbal * 2 AS doubled")


@register("dml_check", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def check(spark, sf_dir):
    return W.check(_customers(spark, sf_dir), positive_key="c_custkey > 0 OR c_custkey = 0")


@register("dml_violations", "SELECT 'unique' AS \"constraint\", (SELECT count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1)) AS n UNION ALL SELECT 'not null l_tax', (SELECT count(*) FROM lineitem WHERE l_tax IS NULL) UNION ALL SELECT 'foreign key', (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))")
def violations(spark, sf_dir):
    return W.violations(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_tax"], (["l_orderkey"], table(spark, sf_dir, "orders"), ["o_orderkey"]))


@register("dml_cascade", "SELECT count(*) AS children FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def cascade(spark, sf_dir):
    _, kept = W.delete_cascade(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), "c_acctbal < 0", "c_custkey", "o_custkey")
    return kept.agg(F.count(F.lit(1)).alias("children"))


@register("dml_generated_column", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net, round(l_extendedprice * (1 - l_discount), 4) * 2 AS twice FROM lineitem UNION ALL SELECT -1, 1, 75.0, 150.0")
def generated(spark, sf_dir):
    """Columns that follow from others, also for rows that are inserted later."""
    rules = {"twice": "net * 2", "net": "round(l_extendedprice * (1 - l_discount), 4)"}
    base = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount")
    new = spark.createDataFrame([(-1, 1, 100.0, 0.25)], "l_orderkey long, l_linenumber int, l_extendedprice double, l_discount double")
    return W.with_generated(W.insert(base, new), rules).select("l_orderkey", "l_linenumber", "net", "twice")


@register("cdc_changes", "SELECT r_regionkey, CAST(CASE WHEN r_regionkey = 0 THEN -1 ELSE 0 END AS INTEGER) AS change_type FROM region WHERE r_regionkey < 2 UNION ALL SELECT 9, 1")
def cdc(spark, sf_dir):
    """A delete, an update and an insert."""
    before = table(spark, sf_dir, "region")
    after = W.insert(W.update(W.delete(before, "r_regionkey = 0"), "r_regionkey = 1", {"r_name": "'changed'"}), spark.createDataFrame([(9, "I")], "r_regionkey int, r_name string"))
    return W.changes(before, after, ["r_regionkey"]).select("r_regionkey", "change_type")


@register("sequence_take", "SELECT count(*) AS n, CAST(min(range) AS BIGINT) AS lo, CAST(max(range) AS BIGINT) AS hi, count(DISTINCT range) AS d FROM range(100, 100 + (SELECT count(*) FROM nation) * 5, 5)")
def sequence(spark, sf_dir):
    t = W.Sequence(start=100, increment=5).take(table(spark, sf_dir, "nation"), "id")
    return t.agg(F.count("id").alias("n"), F.min("id").cast("long").alias("lo"), F.max("id").cast("long").alias("hi"), F.countDistinct("id").alias("d"))


_WORDS = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')"


@register("fts_match", f"SELECT doc_id FROM (SELECT doc_id, {_WORDS} AS t FROM documents) d WHERE (list_contains(t, 'the') AND NOT list_contains(t, 'und')) OR len(list_filter(t, lambda x: x LIKE 'chlich%')) > 0")
def fts_match(spark, sf_dir):
    return fts.match(table(spark, sf_dir, "documents"), ["text"], "(the NOT und) OR chlich*").select("doc_id")


@register("fts_phrase", f"SELECT doc_id FROM (SELECT doc_id, ' ' || array_to_string({_WORDS}, ' ') || ' ' AS t FROM documents) d WHERE t LIKE '% of the %'")
def fts_phrase(spark, sf_dir):
    return fts.match(table(spark, sf_dir, "documents"), ["text"], '"of the"').select("doc_id")


@register("fts_bm25_top", f"""
WITH d AS (SELECT doc_id, {_WORDS} AS t FROM documents), s AS (SELECT count(*) AS n, avg(len(t)) AS l FROM d),
q AS (SELECT unnest(['with', 'that', 'inly']) AS w),
h AS (SELECT doc_id, w, len(list_filter(t, lambda x: x = w)) AS tf, len(t) AS l FROM d, q WHERE list_contains(t, w)),
f AS (SELECT w, count(*) AS df FROM h GROUP BY w)
SELECT doc_id, round(sum(ln(1 + (s.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * h.l / s.l))), 6) AS score FROM h JOIN f USING (w), s GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 10""")
def bm25(spark, sf_dir):
    """Terms are counted where the texts are read, into a small table that both the statistics and the scores come from."""
    terms, path = ["with", "that", "inly"], folder(spark, "terms")
    fts.term_counts(table(spark, sf_dir, "documents"), "doc_id", ["text"], terms).write.parquet(path)
    found = fts.search(spark.read.parquet(path), terms, 10)
    return found.select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


@register("fts_stored_index", f"SELECT doc_id, CAST(len(list_filter({_WORDS}, lambda x: x = 'with')) AS BIGINT) AS n FROM documents WHERE list_contains({_WORDS}, 'with')")
def stored_index(spark, sf_dir):
    """A token table that is written once, of which a search reads the terms' buckets alone."""
    path = folder(spark, "index")
    fts.store(fts.index(table(spark, sf_dir, "documents"), "doc_id", ["text"]), path)
    return fts.stored(spark, path, ["with"]).select(F.col("key").alias("doc_id"), F.col("tf").alias("n"))


@register("fts_highlight", "SELECT r_regionkey, regexp_replace(r_name, '(?i)\\b(asia|africa)\\b', '<b>\\1</b>', 'g') AS h FROM region")
def highlight(spark, sf_dir):
    return table(spark, sf_dir, "region").select("r_regionkey", fts.highlight(F.col("r_name"), "asia OR africa").alias("h"))


@register("ivm_consolidate", "SELECT n_regionkey, CAST(count(*) AS BIGINT) AS w FROM nation WHERE n_nationkey >= 5 GROUP BY n_regionkey")
def zset(spark, sf_dir):
    """Inserted rows less deleted ones."""
    t = table(spark, sf_dir, "nation")
    return ivm.consolidate(ivm.delta(t.select("n_regionkey"), t.where("n_nationkey < 5").select("n_regionkey"))).withColumnRenamed("_weight", "w")


@register("ivm_filter_project", "SELECT event_id, value * 2 AS v FROM events WHERE event_type = 'click'")
def ivm_filter_project(spark, sf_dir):
    """A view that follows the event table as a stream."""
    view = ivm.MaterializedView(spark, folder(spark, "view"), lambda d: ivm.project_delta(ivm.filter_delta(d, "event_type = 'click'"), "event_id", "value * 2 AS v"))
    source = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    query = view.follow(stream, folder(spark, "view"))
    query.awaitTermination()
    return view.read()


@register("ivm_aggregate", "SELECT event_type, count(*) AS \"count\", round(sum(value), 4) AS \"sum\", round(avg(value), 6) AS \"avg\" FROM events WHERE event_id % 7 <> 3 GROUP BY event_type")
def ivm_aggregate(spark, sf_dir):
    """Two batches of inserts and one of deletes."""
    t = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    parts = [ivm.delta(t.where("event_id % 2 = 0")), ivm.delta(t.where("event_id % 2 <> 0")), ivm.delta(t.where("event_id % 7 = 3")).withColumn("_weight", -F.col("_weight"))]
    state = ivm.aggregate_state(parts[0], ["event_type"], "value")
    for p in parts[1:]:
        state = ivm.merge_states(state, ivm.aggregate_state(p, ["event_type"], "value"), ["event_type"])
    return ivm.aggregate_view(state, ["event_type"]).select("event_type", "count", F.round("sum", 4).alias("sum"), F.round("avg", 6).alias("avg"))


@register("ivm_join", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def ivm_join(spark, sf_dir):
    """Half of each table first, the other halves as changes."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("k"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_name")
    a, da = ivm.delta(o.where("o_orderkey % 2 = 0")), ivm.delta(o.where("o_orderkey % 2 <> 0"))
    b, db = ivm.delta(c.where("k % 3 = 0")), ivm.delta(c.where("k % 3 <> 0"))
    first = a.join(b.drop("_weight"), "k")
    return ivm.rows(ivm.apply_delta(first, ivm.join_delta(a, da, b, db, ["k"]))).select("o_orderkey", "c_name")


@register("ivm_outer_join", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def ivm_outer_join(spark, sf_dir):
    """Customers first, then the orders: rows that had no partner go when one comes."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("k"))
    a, b, none = ivm.delta(c), ivm.delta(o.where("o_orderkey % 2 = 0")), ivm.delta(c.limit(0))
    state = ivm.any_join(a, b, ["k"], "left")
    change = ivm.any_join_delta(a, none, b, ivm.delta(o.where("o_orderkey % 2 <> 0")), ["k"], "left")
    return ivm.rows(ivm.apply_delta(state, change)).select(F.col("k").alias("c_custkey"), "o_orderkey")


@register("ivm_view_of_view", "SELECT n_regionkey AS r, count(*) AS n FROM nation WHERE n_nationkey % 2 = 0 GROUP BY n_regionkey")
def ivm_view_of_view(spark, sf_dir):
    """A view's change is the next view's input."""
    t = table(spark, sf_dir, "nation")
    even = ivm.compile_view("SELECT n_regionkey AS r, n_nationkey FROM nation WHERE n_nationkey % 2 = 0")
    counted = ivm.compile_view("SELECT r, count(*) AS n FROM even GROUP BY r")
    for part in (ivm.delta(t.where("n_nationkey < 10")), ivm.delta(t.where("n_nationkey >= 10"))):
        counted.apply(even.apply(part))
    return counted.read()


@register("ivm_from_sql", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS s, round(avg(value * 2), 6) AS m FROM events WHERE value > 10 AND event_id % 5 <> 0 GROUP BY event_type")
def ivm_from_sql(spark, sf_dir):
    """A view from its SQL text: inserts in two batches, then deletes."""
    t = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    view = ivm.compile_view("SELECT event_type, count(*) AS n, sum(value) AS s, avg(value * 2) AS m FROM events WHERE value > 10 GROUP BY event_type")
    gone = ivm.delta(t.where("event_id % 5 = 0")).withColumn("_weight", -F.col("_weight"))
    for change in (ivm.delta(t.where("event_id % 2 = 0")), ivm.delta(t.where("event_id % 2 <> 0")), gone):
        view.apply(change)
    return view.read().select("event_type", "n", F.round("s", 4).alias("s"), F.round("m", 6).alias("m"))


@register("ivm_union", "SELECT n_name AS x FROM nation UNION SELECT r_name FROM region")
def ivm_union(spark, sf_dir):
    d = ivm.delta(table(spark, sf_dir, "nation").selectExpr("n_name AS x")).unionByName(ivm.delta(table(spark, sf_dir, "region").selectExpr("r_name AS x")))
    return ivm.consolidate(d).select("x")


@register("ivm_min_max", "SELECT event_type, min(value) AS \"min\", max(value) AS \"max\" FROM events WHERE value < 90 GROUP BY event_type")
def ivm_min_max(spark, sf_dir):
    t = table(spark, sf_dir, "events").select("event_type", "value")
    state = ivm.apply_delta(ivm.delta(t), ivm.delta(t.where("value >= 90")).withColumn("_weight", -F.col("_weight")))
    return ivm.extremes(state, ["event_type"], "value")


@register("stream_tumbling", "SELECT CAST(epoch(w) AS BIGINT) AS w, event_type, count(*) AS n FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS w, event_type FROM events) t WHERE w + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 1 DAY GROUP BY ALL")
def tumbling(spark, sf_dir):
    """Counts of hours, given out once the watermark has passed them; a second batch brings a row of the first hour, which is too late."""
    source = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = folder(spark, "hours")
    source.coalesce(1).write.parquet(f"{out}/in")
    late = source.orderBy("ts").limit(1).coalesce(1)
    counts = spark.readStream.schema(source.schema).parquet(f"{out}/in").withWatermark("ts", "1 day").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select(F.unix_seconds("window.start").alias("w"), "event_type", "n")

    def go_on():
        sink = counts.writeStream.outputMode("append").format("parquet").option("path", f"{out}/now").option("checkpointLocation", f"{out}/c").trigger(availableNow=True)
        sink.start().awaitTermination()

    go_on()
    late.write.mode("append").parquet(f"{out}/in")
    go_on()
    return spark.read.parquet(f"{out}/now")


sql("stream_sliding_batch", "SELECT unix_seconds(w.start) AS w, count(*) AS n FROM (SELECT window(CAST(ts AS TIMESTAMP), '2 hours', '1 hour') AS w FROM events) x GROUP BY w", "SELECT CAST(w AS BIGINT) AS w, count(*) AS n FROM (SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts)) - 3600 * unnest([0, 1]) AS w FROM events) t GROUP BY w")
sql("stream_session_batch", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id, session_window(CAST(ts AS TIMESTAMP), '30 minutes')", "SELECT user_id, count(*) AS n FROM (SELECT user_id, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events) a) b GROUP BY user_id, g")


def _stream(spark, sf_dir: str, windowed, *columns):
    """An append stream over the events: what the watermark, a day behind, has passed."""
    source = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = folder(spark, "stream")
    source.coalesce(1).write.parquet(f"{out}/in")
    rows = spark.readStream.schema(source.schema).parquet(f"{out}/in").withWatermark("ts", "1 day")
    counts = windowed(rows).select(*columns)
    counts.writeStream.outputMode("append").format("parquet").option("path", f"{out}/now").option("checkpointLocation", f"{out}/c").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/now")


_PASSED = "(SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 1 DAY"


@register("stream_sliding", f"SELECT CAST(epoch(w) AS BIGINT) AS w, count(*) AS n FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) - to_hours(unnest([0, 1])) AS w FROM events) t WHERE w + INTERVAL 2 HOUR <= {_PASSED} GROUP BY w")
def sliding(spark, sf_dir):
    """Windows of two hours that begin each hour, over a stream."""
    return _stream(spark, sf_dir, lambda rows: rows.groupBy(F.window("ts", "2 hours", "1 hour")).agg(F.count(F.lit(1)).alias("n")), F.unix_seconds("window.start").alias("w"), "n")


@register("stream_session", f"SELECT user_id, count(*) AS n FROM (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events) a) b GROUP BY user_id, g HAVING max(ts) + INTERVAL 30 MINUTE <= {_PASSED}")
def sessions(spark, sf_dir):
    """Sessions of a user that half an hour without an event ends, over a stream."""
    return _stream(spark, sf_dir, lambda rows: rows.groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count(F.lit(1)).alias("n")), "user_id", "n")
