"""Joins that need more than a join type: as-of, interval and salted joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def natural_join(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Joins on all common column names, which appear once; none in common gives the cross product."""
    common = [c for c in a.columns if c in b.columns]
    return a.join(b, common, how) if common else a.crossJoin(b)


def as_of_join(a: DataFrame, b: DataFrame, on: list[str], at: str, b_at: str, columns: list[str]) -> DataFrame:
    """Each row of ``a`` with ``columns`` of the last row of ``b`` at or before it, of the same keys; null where there is none.

    One shuffle of both sides by key and one sorted pass: no pairs are made.
    """
    value = F.struct(*columns)
    left = a.select(*on, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(b.select(value).schema[0].dataType).alias("_v"), F.struct(*a.columns).alias("_row"))
    right = b.select(*on, F.col(b_at).alias("_at"), F.lit(0).alias("_side"), value.alias("_v"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"))
    w = W.partitionBy(*on).orderBy("_at", "_side").rowsBetween(W.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn("_last", F.last("_v", ignorenulls=True).over(w))
    return both.where("_side = 1").select("_row.*", *[F.col(f"_last.{c}").alias(c) for c in columns])


def interval_join(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: float) -> DataFrame:
    """Points with the ranges [low, high) that hold them, by cells of ``width``: an equality join on cells in place of all pairs."""
    cell = lambda c: F.floor(c / F.lit(width)).cast("long")
    p = points.withColumn("_cell", cell(F.col(at)))
    r = ranges.withColumn("_cell", F.explode(F.sequence(cell(F.col(low)), cell(F.col(high)))))
    return p.join(r, "_cell").where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("_cell")


def salted_join(big: DataFrame, small: DataFrame, on: list[str], salts: int = 16, how: str = "inner") -> DataFrame:
    """An equality join whose hot keys of ``big`` are dealt over ``salts`` tasks; rows of ``small`` are repeated as often."""
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("the salted side has to be kept whole")
    a = big.withColumn("_salt", F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int"))
    b = small.withColumn("_salt", F.explode(F.array(*[F.lit(k) for k in range(salts)])))
    return a.join(b, [*on, "_salt"], how).drop("_salt")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
