"""Vectors as arrays of numbers: distances by higher-order functions in the JVM, top-k by a bounded heap per task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def parse(x: Column, kind: str = "float") -> Column:
    """vector32 ('float') or vector64 ('double') of JSON text."""
    return F.from_json(x, f"array<{kind}>")


def extract(v: Column) -> Column:
    return F.to_json(v)


def _same(a: Column, b: Column, value: Column) -> Column:
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit("vectors must have the same dimensions")).cast("double"))


def _sum(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    """The negative dot product, so that less is nearer."""
    return _same(a, b, -_sum(a, b, lambda x, y: x * y))


def l2(a: Column, b: Column) -> Column:
    return _same(a, b, F.sqrt(_sum(a, b, lambda x, y: (x - y) * (x - y))))


def cosine(a: Column, b: Column) -> Column:
    """1 less the cosine."""
    norm = F.sqrt(_sum(a, a, lambda x, y: x * y) * _sum(b, b, lambda x, y: x * y))
    return _same(a, b, 1 - F.try_divide(_sum(a, b, lambda x, y: x * y), norm))


def jaccard(a: Column, b: Column) -> Column:
    """1 less the weighted Jaccard similarity."""
    return _same(a, b, 1 - F.try_divide(_sum(a, b, F.least), _sum(a, b, F.greatest)))


def concat(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def slice_(v: Column, low: int, high: int) -> Column:
    """Elements low to high - 1, from 0."""
    return F.slice(v, low + 1, high - low)


def sparse(v: Column) -> Column:
    """dims, and places and values of what isn't 0."""
    pairs = F.filter(F.transform(v, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda p: p["x"] != 0)
    return F.struct(F.size(v).alias("dims"), F.transform(pairs, lambda p: p["i"]).alias("at"), F.transform(pairs, lambda p: p["x"]).alias("x"))


def quantised(v: Column) -> Column:
    """Eight bits for each element, with scale and shift."""
    low, high = F.array_min(v), F.array_max(v)
    scale = F.when(high > low, (high - low) / 255.0).otherwise(F.lit(1.0))
    return F.struct(F.transform(v, lambda x: F.round((x - low) / scale).cast("int")).alias("q"), scale.alias("scale"), low.alias("shift"))


def one_bit(v: Column) -> Column:
    return F.transform(v, lambda x: x > 0)


def nearest(df: DataFrame, column: str, query: list[float], k: int, distance=cosine, ties: str | None = None) -> DataFrame:
    """The k nearest rows: each task keeps k, nothing else moves."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return df.withColumn("distance", distance(F.col(column), q)).orderBy("distance", *([ties] if ties else [])).limit(k)


def postings(df: DataFrame, key: str, column: str, least: float = 0.0) -> DataFrame:
    """An inverted index of sparse vectors: dim, key and x for each element above ``least``."""
    pairs = F.filter(F.transform(column, lambda x, i: F.struct(i.alias("dim"), x.cast("double").alias("x"))), lambda p: p["x"] > least)
    return df.select(F.col(key).alias("key"), F.explode(pairs).alias("p")).select("p.dim", "key", "p.x")


def sparse_nearest(index: DataFrame, query: dict[int, float], k: int) -> DataFrame:
    """The k greatest inner products with a sparse query: only the lists of its places are read."""
    weight = F.coalesce(*[F.when(F.col("dim") == d, F.lit(float(x))) for d, x in query.items()])
    hits = index.where(F.col("dim").isin(list(query))).groupBy("key").agg(F.sum(F.col("x") * weight).alias("score"))
    return hits.orderBy(F.desc("score"), "key").limit(k)
