"""Mixing sources to target weights with a time-varying curriculum. DataFrame and SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import keep, work_dir

#: A word is a run of bytes other than \\x20 and \\x09-\\x0D.
WORD = r"[^\x20\x09-\x0D]+"
#: Weights by a source's rank in code point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: A target's most, as a multiple of its source's size.
CAP = 3.0
#: Weight over training time, by the same rank: knots (time from 0 to 1, factor). Each is scaled to integral 1,
#: so that a source's whole demand is its target: heavy sources lead early, light ones late.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))
#: Hash ranges of a source; each is ordered on its own, and their sums give its start.
BUCKETS = 4096


def words(text: str | Column) -> Column:
    """Number of words (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def time_of(demand: Column, knots) -> Column:
    """The time at which a schedule's integral reaches the share ``demand`` of its whole (0 to 1)."""
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))
    if area <= 0 or any(k[1] < 0 for k in knots) or knots[0][0] != 0 or knots[-1][0] != 1:
        raise ValueError("a schedule runs from 0 to 1 and has weights of 0 or more, not all 0")
    out, done = F.lit(1.0), 1.0
    for (t0, d0), (t1, d1) in reversed(list(zip(knots, knots[1:]))):
        d0, d1 = d0 / area, d1 / area
        part = (t1 - t0) * (d0 + d1) / 2
        done -= part
        u = F.greatest(demand - F.lit(done), F.lit(0.0))
        slope = (d1 - d0) / (t1 - t0)
        root = d0 + F.sqrt(F.greatest(F.lit(d0 * d0) + 2 * slope * u, F.lit(0.0)))
        at = F.least(F.when(root > 0, F.lit(t0) + 2 * u / root).otherwise(F.lit(t0)), F.lit(t1))
        out = at if t1 == 1 else F.when(demand < done + part, at).otherwise(out)
    return out


def targets(sizes: DataFrame, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """Of one row per source (no_source, source, source_size): adds rank, weight and target.

    The targets share the sum of all sizes by weight; none is above ``cap`` times its
    source's size: they are the lesser of that and one common multiple of the weight,
    which is what resharing the excess until none is above comes to. The windows see one
    row of a source.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy("no_source", "source")) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", w).withColumn("_cap", F.lit(float(cap)) * F.col("source_size"))
    order = W.orderBy(F.col("_cap") / F.col("weight"), "rank")
    left = F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("_cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    level = left / F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    common = F.max(F.when(F.col("_level") * F.col("weight") <= F.col("_cap"), F.col("_level"))).over(W.partitionBy())
    return ranked.withColumn("_level", level).withColumn("target", F.coalesce(F.least("_cap", common * F.col("weight")), F.col("_cap"))).drop("_cap", "_level")


def mix_sources(docs: DataFrame, size: str, source: str = "source", key: Column | None = None, weights=WEIGHTS, cap: float = CAP, schedules=SCHEDULES, buckets: int = BUCKETS) -> DataFrame:
    """Adds _source_size, _target, _taken (words, repeats counted) and _positions (training times 0 to 1, one per pass).

    A column of ``docs`` with such a name is replaced, others pass through. ``size`` names
    a long column with each row's words, ``source`` one of strings; ``key`` (default: a hash
    of all columns) orders a source's rows, so reruns agree. A source's passes take its rows in
    that order until the target is reached; the row at which it is reached gives just the
    words still wanted. A null source is a source of its own and comes last; null sizes
    count as 0. An empty table gives an empty table; sources without words take nothing.
    Repeated rows stay apart. The hash ranges of a source are ordered apart, so that no
    task holds one source.
    """
    columns = [c for c in docs.columns if c not in ("_source_size", "_target", "_taken", "_positions")]
    key = F.xxhash64(*columns) if key is None else key
    named = [F.col(source).isNull().alias("_u"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_s")]
    rows = docs.select(F.struct(*columns).alias("_row"), *named, F.coalesce(F.col(size), F.lit(0)).cast("long").alias("_n"), key.alias("_h"))
    rows = rows.withColumn("_b", F.pmod("_h", F.lit(buckets)))
    sums = rows.groupBy("_u", "_s", "_b").agg(F.sum("_n").alias("_bn"))
    plan = targets(sums.groupBy(F.col("_u").alias("no_source"), F.col("_s").alias("source")).agg(F.sum("_bn").alias("source_size")), weights, cap)
    plan = plan.select(F.col("no_source").alias("_u"), F.col("source").alias("_s"), "source_size", "target", "rank")
    starts = sums.withColumn("_start", F.sum("_bn").over(W.partitionBy("_u", "_s").orderBy("_b")) - F.col("_bn")).drop("_bn")
    inner = F.sum("_n").over(W.partitionBy("_u", "_s", "_b").orderBy("_h", "_row").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")
    placed = rows.withColumn("_in", inner).join(starts.join(plan, ["_u", "_s"]), ["_u", "_s", "_b"])
    offset, whole = F.col("_start") + F.col("_in"), F.col("source_size")
    passes = F.when(whole > 0, F.floor(F.col("target") / whole)).otherwise(F.lit(0)).cast("long")
    rest = F.round(F.col("target")).cast("long") - passes * whole
    last = F.greatest(F.lit(0), F.least(rest - offset, F.col("_n")))
    many = passes + (last > 0).cast("long")
    share = lambda p: (offset + p * whole) / F.col("target")
    at = lambda p: F.coalesce(*[F.when(F.col("rank") % len(schedules) == k, time_of(share(p), s)) for k, s in enumerate(schedules)])
    positions = F.when((many > 0) & (F.col("_n") > 0), F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(many - 1, F.lit(0))), at)).otherwise(F.array().cast("array<double>"))
    return placed.select("_row.*", whole.alias("_source_size"), F.col("target").alias("_target"), (passes * F.col("_n") + last).alias("_taken"), positions.alias("_positions"))


def in_training_order(mixed: DataFrame) -> DataFrame:
    """Range-sorts rows by their first training position; rows that the mix leaves out come last."""
    return mixed.orderBy(F.get("_positions", F.lit(0)).asc_nulls_last(), *[c for c in mixed.columns if c in ("doc_id",)])


def op4_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # written, so that words are counted once
    sized = keep(docs.select("doc_id", "source", words("text").alias("size"), F.xxhash64("doc_id", "text").alias("_key")), f"{work_dir(spark)}/sizes")
    mixed = mix_sources(sized, "size", key=F.col("_key"))
    return in_training_order(mixed).select(
        "doc_id", "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken"), F.get("_positions", F.lit(0)).alias("first_position"),
    )
