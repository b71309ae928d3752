"""Incrementally maintained views: deltas are rows with weights, applied batch by batch."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

WEIGHT = "_weight"


def delta(inserted: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """A change as rows of weight 1 (inserted) and -1 (deleted)."""
    out = inserted.withColumn(WEIGHT, F.lit(1).cast("long"))
    return out if deleted is None else out.unionByName(deleted.withColumn(WEIGHT, F.lit(-1).cast("long")))


def consolidate(d: DataFrame) -> DataFrame:
    """Equal rows merge; what adds up to 0 goes."""
    columns = [c for c in d.columns if c != WEIGHT]
    return d.groupBy(*columns).agg(F.sum(WEIGHT).alias(WEIGHT)).where(f"{WEIGHT} <> 0")


def apply_delta(state: DataFrame, d: DataFrame) -> DataFrame:
    """A weighted table after a change."""
    return consolidate(state.unionByName(d))


def rows(state: DataFrame) -> DataFrame:
    """A weighted table as plain rows, each as often as its weight."""
    return state.where(f"{WEIGHT} > 0").withColumn("_n", F.explode(F.expr(f"sequence(1L, {WEIGHT})"))).drop(WEIGHT, "_n")


def filter_delta(d: DataFrame, where: str) -> DataFrame:
    return d.where(where)


def project_delta(d: DataFrame, *expressions: str) -> DataFrame:
    return d.selectExpr(*expressions, WEIGHT)


def join_delta(a: DataFrame, da: DataFrame, b: DataFrame, db: DataFrame, on: list[str]) -> DataFrame:
    """The change of an inner join: dA x B + A x dB + dA x dB, where A and B are the tables before."""

    def one(x: DataFrame, y: DataFrame) -> DataFrame:
        y = y.withColumnRenamed(WEIGHT, "_w2")
        return x.join(y, on).withColumn(WEIGHT, F.col(WEIGHT) * F.col("_w2")).drop("_w2")

    return reduce(DataFrame.unionByName, (one(da, b), one(a, db), one(da, db)))


def any_join(a: DataFrame, b: DataFrame, on: list[str], how: str) -> DataFrame:
    """A join of weighted tables of any kind but cross: a row without a partner has its own weight."""
    both = a.join(b.withColumnRenamed(WEIGHT, "_w2"), on, how)
    one = lambda c: F.coalesce(F.col(c), F.lit(1))
    return both.withColumn(WEIGHT, one(WEIGHT) * one("_w2")).drop("_w2")


def any_join_delta(a: DataFrame, da: DataFrame, b: DataFrame, db: DataFrame, on: list[str], how: str) -> DataFrame:
    """The change of a join of any kind: what it is after for the keys that changed, less what it was. Only these keys' rows are read."""
    keys = da.select(*on).unionByName(db.select(*on)).distinct()
    some = lambda x: x.join(keys, on, "left_semi")
    before = any_join(some(a), some(b), on, how)
    after = any_join(some(apply_delta(a, da)), some(apply_delta(b, db)), on, how)
    return consolidate(after.unionByName(before.withColumn(WEIGHT, -F.col(WEIGHT))))


def aggregate_state(d: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per group the parts that add up over changes: rows, values that aren't null, and their sum."""
    w = F.col(WEIGHT)
    return d.groupBy(*keys).agg(F.sum(w).alias("_rows"), F.sum(F.when(F.col(value).isNotNull(), w).otherwise(0)).alias("_n"), F.sum(F.coalesce(F.col(value), F.lit(0)) * w).alias("_sum"))


def merge_states(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.unionByName(b).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("_rows", "_n", "_sum")]).where("_rows > 0")


def aggregate_view(state: DataFrame, keys: list[str]) -> DataFrame:
    """count, sum and avg of the groups."""
    return state.select(*keys, F.col("_rows").alias("count"), F.when(F.col("_n") > 0, F.col("_sum")).alias("sum"), F.when(F.col("_n") > 0, F.col("_sum") / F.col("_n")).alias("avg"))


def extremes(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """min and max from a weighted table of (keys, value): right under deletes, since the values themselves are kept."""
    return values.where(f"{WEIGHT} > 0").groupBy(*keys).agg(F.min(value).alias("min"), F.max(value).alias("max"))


class MaterializedView:
    """A view's weighted rows in a folder, one version for each batch; a batch that runs twice is applied once.

    What the folder holds is the state: a view made anew on it, as after a restart, goes on
    from its newest whole version. The one before is kept for readers; older ones go.
    """

    def __init__(self, spark: SparkSession, path: str, compute: Callable[[DataFrame], DataFrame]):
        self.spark, self.path, self.compute = spark, path, compute
        self.version = max(self.versions(), default=None)

    def _files(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """The batches whose versions are whole."""
        top, fs = self._files()
        new = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        names = [s.getPath().getName() for s in fs.listStatus(top)] if fs.exists(top) else []
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(new(f"{self.path}/{n}/_SUCCESS")))

    def apply(self, change: DataFrame, batch: int) -> None:
        """Applies a weighted change of the base table."""
        if self.version is not None and batch <= self.version:
            return
        d = self.compute(change)
        now = d if self.version is None else self.read_weighted().unionByName(d)
        consolidate(now).write.mode("overwrite").parquet(f"{self.path}/v{batch}")
        self.version = batch
        _, fs = self._files()
        for old in self.versions()[:-2]:
            fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{old}"), True)

    def read_weighted(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v{self.version}")

    def read(self, uncommitted: DataFrame | None = None) -> DataFrame:
        """The view's rows, with a change that isn't committed yet if one is given."""
        state = self.read_weighted()
        return rows(consolidate(state.unionByName(self.compute(uncommitted))) if uncommitted is not None else state)

    def follow(self, stream: DataFrame, checkpoint: str, **trigger):
        """Maintains the view from a stream of inserted rows."""
        trigger = trigger or {"availableNow": True}
        run = lambda batch, n: self.apply(delta(batch), n)
        return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**trigger).start()


class SqlView:
    """A view's circuit: filter and project, then, with groups, states that add up over changes."""

    def __init__(self, items: list[tuple[str, str]], where: str | None, keys: list[str]):
        self.items, self.where, self.keys, self.state = items, where, keys, None

    def apply(self, change: DataFrame) -> DataFrame:
        """Takes a weighted change of the table and returns the view's own."""
        d = change.where(self.where) if self.where else change
        if not self.keys:
            out = consolidate(d.selectExpr(*[f"{e} AS {n}" for e, n in self.items], WEIGHT))
            self.state = out if self.state is None else apply_delta(self.state, out)
            return out
        w, aggregates = F.col(WEIGHT), [F.sum(WEIGHT).alias("_rows")]
        for k, (e, _) in enumerate(self.items):
            if m := _AGGREGATE.fullmatch(e):
                x = F.lit(1) if m[2] == "*" else F.expr(m[2])
                aggregates += [F.sum(F.when(x.isNotNull(), w).otherwise(0)).alias(f"_n{k}"), F.sum(F.coalesce(x, F.lit(0)) * w).alias(f"_s{k}")]
        part = d.groupBy(*self.keys).agg(*aggregates)
        before = self.state
        if before is None:
            self.state = part.where("_rows > 0")
        else:
            self.state = before.unionByName(part).groupBy(*self.keys).agg(*[F.sum(c).alias(c) for c in part.columns if c not in self.keys]).where("_rows > 0")
        touched = lambda s: self._shown(s.join(part.select(*self.keys), self.keys, "left_semi"))
        after = delta(touched(self.state))
        return after if before is None else consolidate(after.unionByName(touched(before).withColumn(WEIGHT, F.lit(-1).cast("long"))))

    def _shown(self, state: DataFrame) -> DataFrame:
        def column(k: int, e: str):
            m = _AGGREGATE.fullmatch(e)
            if not m:
                return F.col(e)
            n, s = F.col(f"_n{k}"), F.col(f"_s{k}")
            return {"count": n, "sum": F.when(n > 0, s), "avg": F.when(n > 0, s / n)}[m[1].lower()]

        return state.select(*[column(k, e).alias(n) for k, (e, n) in enumerate(self.items)])

    def read(self) -> DataFrame:
        return self._shown(self.state) if self.keys else rows(self.state)


_AGGREGATE = re.compile(r"(?is)(count|sum|avg)\s*\((.*)\)")
_VIEW = re.compile(r"(?is)\s*select\s+(?P<items>.*?)\s+from\s+\w+(?:\s+where\s+(?P<where>.*?))?(?:\s+group\s+by\s+(?P<keys>.*?))?\s*;?\s*")


def compile_view(text: str) -> SqlView:
    """SELECT over one table, with WHERE and GROUP BY (count, sum and avg), as a view that takes changes."""
    from ..sources.tables import parts

    m = _VIEW.fullmatch(text)
    if not m or re.search(r"(?i)\b(join|having|distinct|union|order|limit)\b", text):
        raise ValueError("an incremental view is SELECT ... FROM one table [WHERE ...] [GROUP BY ...]")
    items = []
    for item in parts(m["items"]):
        e, _, name = re.sub(r"(?i)\s+as\s+(\w+)$", "\x00\\1", item).partition("\x00")
        items.append((e.strip(), name or e.strip()))
    keys = parts(m["keys"] or "")
    lacking = [e for e, _ in items if keys and e not in keys and not _AGGREGATE.fullmatch(e)]
    if lacking:
        raise ValueError(f"neither grouped by nor an aggregate: {', '.join(lacking)}")
    return SqlView(items, m["where"], keys)
