"""Queries given as SQL text."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..functions import sqlfuncs
from ..session import table
from .registry import register

#: The generated tables.
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def views(spark: SparkSession, sf_dir: str, text: str) -> None:
    """Makes a view of each table that the text names."""
    for name in TABLES:
        if re.search(rf"\b{name}\b", text):
            table(spark, sf_dir, name).createOrReplaceTempView(name)


def run_sql(spark: SparkSession, sf_dir: str, text: str, **args) -> DataFrame:
    views(spark, sf_dir, text)
    sqlfuncs.install(spark, text)
    return spark.sql(text, args=args or None)


def sql(name: str, text: str, oracle: str | None = None) -> None:
    """Registers a query in Spark SQL; the oracle is the same text where the dialects agree."""
    register(name, oracle or text)(lambda spark, sf_dir: run_sql(spark, sf_dir, text))
