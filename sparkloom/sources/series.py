"""Integer sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def generate_series(spark: SparkSession, start: int, stop: int, step: int = 1) -> DataFrame:
    """``value`` from start to stop, both included where met. A step of 0 counts as 1; a bad direction gives no rows."""
    step = step or 1
    return spark.range(start, stop + (1 if step > 0 else -1), step).withColumnRenamed("id", "value")
