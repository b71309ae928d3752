"""Aggregates that Spark has no single function for."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def with_extremum_row(df: DataFrame, keys: list[str], by: str, alias: str, bare: list[str], least: bool = False) -> DataFrame:
    """GROUP BY with bare columns: they come from the row of the single max() or min()."""
    pick, best = (F.min_by, F.min) if least else (F.max_by, F.max)
    return df.groupBy(*keys).agg(best(by).alias(alias), *[pick(c, by).alias(c) for c in bare])


def total(x: Column) -> Column:
    """The sum as REAL, 0.0 of nothing."""
    return F.coalesce(F.sum(x.cast("double")), F.lit(0.0))


def percentile_floor(x: Column, p: float) -> Column:
    """The value at floor(p * (n - 1)) of the sorted ones; null for p over 1."""
    return F.lit(None) if p > 1 else F.get(F.sort_array(F.collect_list(x)), F.floor(F.lit(p) * (F.count(x) - 1)).cast("int"))


def user_aggregate(df: DataFrame, keys: list[str], columns: list[str], partial: Callable[[pd.DataFrame], pd.DataFrame], states: dict[str, str], merge: dict[str, str], result: Column) -> DataFrame:
    """A user's aggregate with states that merge: no group is ever whole in one place.

    ``partial`` makes of a batch of ``columns`` a row of ``states`` (names and types) for each
    group of it; ``merge`` names the aggregate that joins each state; ``result`` is an
    expression over the merged ones.
    """
    t = df.select(*keys, *columns)
    shape = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in t.select(*keys).schema], *[f"{n} {k}" for n, k in states.items()]])

    def run(batches):
        for b in batches:
            if len(b):
                yield b.groupby(keys, dropna=False).apply(partial, include_groups=False).reset_index()[[*keys, *states]]

    parts = t.mapInPandas(run, shape)
    return parts.groupBy(*keys).agg(*[F.expr(f"{how}({n})").alias(n) for n, how in merge.items()]).select(*keys, result)


def geometric_mean(df: DataFrame, keys: list[str], column: str, alias: str) -> DataFrame:
    """A user-defined aggregate, by way of counts and sums of logarithms."""

    def partial(b: pd.DataFrame) -> pd.Series:
        x = b[column].dropna()
        return pd.Series({"n": float(len(x)), "s": float(np.log(x).sum())})

    return user_aggregate(df, keys, [column], partial, {"n": "double", "s": "double"}, {"n": "sum", "s": "sum"}, F.exp(F.try_divide("s", "n")).alias(alias))


def mean_of():
    """A user-defined aggregate that also runs over windows."""

    @F.pandas_udf("double")
    def f(x: pd.Series) -> float:
        return float(x.mean())

    return f
