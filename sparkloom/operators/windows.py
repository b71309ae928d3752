"""Window forms that Spark lacks: frames counted in peer groups, EXCLUDE, and DISTINCT aggregates over partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def over_groups(df: DataFrame, value: Column, keys: list[str], order: str, before: int | None, after: int | None, alias: str) -> DataFrame:
    """An aggregate over a GROUPS frame: from ``before`` peer groups back to ``after`` ahead (None: to the end).

    Peer groups are numbered by their dense rank, over which the frame is one of RANGE.
    """
    ranked = df.withColumn("_group", F.dense_rank().over(W.partitionBy(*keys).orderBy(order)))
    low = W.unboundedPreceding if before is None else -before
    high = W.unboundedFollowing if after is None else after
    return ranked.withColumn(alias, value.over(W.partitionBy(*keys).orderBy("_group").rangeBetween(low, high))).drop("_group")


def sum_excluding(df: DataFrame, x: str, keys: list[str], order: str, what: str, alias: str) -> DataFrame:
    """sum(x) over the frame up to the current row's peers, EXCLUDE ``what``: 'current row', 'group', 'ties' or 'no others'.

    A sum without some rows is the sum less theirs; null where no row of a value is left.
    """
    frame, peers = W.partitionBy(*keys).orderBy(order), W.partitionBy(*keys, order)
    own, one = F.col(x), F.col(x).isNotNull().cast("long")
    gone = {
        "no others": (F.lit(0), F.lit(0)), "current row": (F.coalesce(own, F.lit(0)), one), "group": (F.coalesce(F.sum(own).over(peers), F.lit(0)), F.count(own).over(peers)),
        "ties": (F.coalesce(F.sum(own).over(peers), F.lit(0)) - F.coalesce(own, F.lit(0)), F.count(own).over(peers) - one),
    }[what]
    total, n = F.sum(own).over(frame), F.count(own).over(frame)
    return df.withColumn(alias, F.when(n - gone[1] > 0, total - gone[0]))


def distinct_over(df: DataFrame, keys: list[str], x: str, alias: str) -> DataFrame:
    """count(DISTINCT x) OVER (PARTITION BY keys): an aggregate that meets its rows again by a join, so no partition is one task."""
    n = df.groupBy(*keys).agg(F.countDistinct(x).alias(alias)).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], alias)
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return df.join(n, same, "left").drop(*[f"_k{i}" for i in range(len(keys))])
