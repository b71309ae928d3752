"""Maintenance of stored tables, user types and hooks after writes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def compact(spark: SparkSession, source: str, target: str, file_bytes: int = 256 << 20) -> int:
    """VACUUM INTO: rewrites a Parquet table in files of about ``file_bytes``; returns how many were asked for."""
    df = spark.read.parquet(source)
    size = float(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = max(1, -(-int(size) // file_bytes))
    df.repartition(n).write.mode("overwrite").parquet(target)
    return n


def analyze(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, distinct values, nulls and ends of each column, in one pass."""
    parts = [F.struct(F.lit(c).alias("column"), F.count(F.lit(1)).alias("rows"), F.approx_count_distinct(c).alias("distinct"), F.sum(F.col(c).isNull().cast("long")).alias("nulls"), F.min(c).cast("string").alias("low"), F.max(c).cast("string").alias("high")) for c in columns]
    return df.agg(F.array(*parts).alias("x")).select(F.explode("x").alias("x")).select("x.*")


@dataclass
class UserType:
    """A user's type: a base type, how values are encoded and decoded, and a check (a domain)."""

    base: str
    encode: Callable[[Column], Column] = field(default=lambda x: x)
    decode: Callable[[Column], Column] = field(default=lambda x: x)
    check: Callable[[Column], Column] | None = None

    def write(self, x: Column) -> Column:
        value = self.encode(x).cast(self.base)
        if self.check is None:
            return value
        ok = F.coalesce(self.check(x), F.lit(True))
        return F.when(ok, value).otherwise(F.raise_error(F.lit("value violates its domain")).cast(self.base))

    def read(self, x: Column) -> Column:
        return self.decode(x)


class Triggers:
    """Steps before and after writes, each given the rows that the write touches."""

    def __init__(self):
        self.steps: dict[tuple[str, str], list[tuple[str | None, Callable[[DataFrame], DataFrame | None]]]] = {}

    def on(self, time: str, event: str, step: Callable[[DataFrame], DataFrame | None], when: str | None = None) -> None:
        if time not in ("before", "after") or event not in ("insert", "update", "delete"):
            raise ValueError("a trigger runs before or after insert, update or delete")
        self.steps.setdefault((time, event), []).append((when, step))

    def run(self, time: str, event: str, rows: DataFrame) -> DataFrame:
        """Runs the steps in order; one that returns rows replaces those that its condition chose."""
        for when, step in self.steps.get((time, event), []):
            chosen = rows if when is None else rows.where(when)
            new = step(chosen)
            if new is not None:
                rows = new if when is None else rows.where(~F.coalesce(F.expr(when), F.lit(False))).unionByName(new)
        return rows
