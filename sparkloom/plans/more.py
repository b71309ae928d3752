"""Queries of the remaining functions and of maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import core as C, more as M, vectors as V
from ..operators import maintenance
from ..session import table
from .registry import register


@register("fn_printf", "SELECT r_regionkey, '[' || lpad(CAST(r_regionkey AS VARCHAR), 5, '0') || ']''' || r_name || '''|' || r_regionkey || CASE r_regionkey WHEN 1 THEN 'st' WHEN 2 THEN 'nd' WHEN 3 THEN 'rd' ELSE 'th' END AS f FROM region")
def printf(spark, sf_dir):
    return table(spark, sf_dir, "region").select("r_regionkey", M.printf("[%05d]%Q|%r", F.col("r_regionkey"), F.col("r_name"), F.col("r_regionkey")).alias("f"))


@register("fn_unistr", "SELECT 'é☃' AS a, 'a\\b' AS b")
def unistr(spark, sf_dir):
    return spark.range(1).select(M.unistr(F.lit("\\u00e9\\2603")).alias("a"), M.unistr(F.lit("a\\\\b")).alias("b"))


@register("fn_bytes", "SELECT n_nationkey, CAST(ascii(substr(n_name, 2, 1)) AS INTEGER) AS g, 'X' || substr(n_name, 2) AS s FROM nation")
def byte_access(spark, sf_dir):
    b = F.encode("n_name", "UTF-8")
    return table(spark, sf_dir, "nation").select("n_nationkey", M.get_byte(b, 1).alias("g"), F.decode(M.set_byte(b, 0, 88), "UTF-8").alias("s"))


@register("fn_typeof", "SELECT n_nationkey, 'integer' AS k, 'text' AS n FROM nation")
def typeof(spark, sf_dir):
    t = table(spark, sf_dir, "nation")
    return t.select("n_nationkey", M.typeof(t, "n_nationkey").alias("k"), M.typeof(t, "n_name").alias("n"))


@register("fn_array_edit", "SELECT n_nationkey, CAST(n_nationkey AS VARCHAR) || ',9,3' AS s, array_to_string(list_filter([n_nationkey, n_regionkey, 3], lambda x: x <> n_nationkey), ',') AS r, 'a|~|c' AS t FROM nation")
def array_edit(spark, sf_dir):
    a = F.array("n_nationkey", "n_regionkey", F.lit(3))
    j = lambda x: F.array_join(x, ",")
    return table(spark, sf_dir, "nation").select("n_nationkey", j(M.array_set_element(a, 2, F.lit(9))).alias("s"), j(F.array_remove(a, F.col("n_nationkey"))).alias("r"), F.array_join(M.string_to_array(F.lit("a.b.c"), ".", "b"), "|", "~").alias("t"))


@register("fn_vector_forms", "SELECT vec_id, CAST(len(list_filter(embedding, lambda x: x > 0)) AS INTEGER) AS bits, round(-list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 4) AS dot, CAST(len(embedding) * 2 AS INTEGER) AS twice, CAST(2 AS INTEGER) AS part, CAST(255 AS INTEGER) AS top FROM embeddings")
def vector_forms(spark, sf_dir):
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size(F.filter(V.one_bit(e), lambda b: b)).alias("bits"), F.round(V.dot(e, e), 4).alias("dot"), F.size(V.concat(e, e)).alias("twice"), F.size(V.slice_(e, 1, 3)).alias("part"), F.array_max(V.quantised(e)["q"]).alias("top"))


@register("fn_phonetic", "SELECT * FROM (VALUES ('Braz', 'B1905', 215), ('Brás', 'B193', 215), ('Ωμ', '', 200)) t(x, r, s)")
def phonetic(spark, sf_dir):
    return spark.createDataFrame([("Braz",), ("Brás",), ("Ωμ",)], "x string").select("x", M.fuzzy_rsoundex(F.col("x")).alias("r"), M.fuzzy_script(F.col("x")).alias("s"))


@register("fn_translit", "SELECT doc_id, strip_accents(replace(replace(replace(text, 'ß', 'ss'), 'æ', 'ae'), 'ø', 'o')) AS t FROM documents")
def translit(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", M.translit(F.col("text")).alias("t"))


@register("analyze_table", "SELECT 'o_orderkey' AS \"column\", count(*) AS \"rows\", CAST(0 AS BIGINT) AS \"nulls\", CAST(min(o_orderkey) AS VARCHAR) AS low, CAST(max(o_orderkey) AS VARCHAR) AS high FROM orders")
def analyze(spark, sf_dir):
    return maintenance.analyze(table(spark, sf_dir, "orders"), ["o_orderkey"]).drop("distinct")


@register("user_types", "SELECT n_nationkey, CAST(n_nationkey * 100 AS BIGINT) AS stored, CAST(n_nationkey AS DOUBLE) AS shown FROM nation")
def user_types(spark, sf_dir):
    """A type that is stored in cents."""
    cents = maintenance.UserType("bigint", lambda x: x * 100, lambda x: x / 100.0, lambda x: x >= 0)
    t = table(spark, sf_dir, "nation").select("n_nationkey", cents.write(F.col("n_nationkey")).alias("stored"))
    return t.withColumn("shown", cents.read(F.col("stored")))


@register("trigger_steps", "SELECT r_regionkey, CASE WHEN r_regionkey > 2 THEN upper(r_name) || '!' ELSE r_name END AS r_name FROM region")
def triggers(spark, sf_dir):
    t = maintenance.Triggers()
    t.on("before", "insert", lambda rows: rows.withColumn("r_name", F.concat(F.upper("r_name"), F.lit("!"))), "r_regionkey > 2")
    return t.run("before", "insert", table(spark, sf_dir, "region"))


@register("pg_to_char", "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS c FROM orders")
def to_char(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.trim(C.to_char(F.col("o_orderkey").cast("decimal(12,0)"), "999999990")).alias("c"))


@register("pg_similar", "SELECT p_partkey, regexp_full_match(p_name, '[a-m].*(e|o).') AS s, p_name ILIKE '%E%' AS l FROM part")
def similar(spark, sf_dir):
    """SIMILAR TO: SQL wildcards with a regular expression's alternatives, over the whole value."""
    p = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", C.similar("[a-m]%(e|o)_", p).alias("s"), p.ilike("%E%").alias("l"))
