"""Writes as rewrites of tables: insert, upsert, update, delete, constraints, change capture and sequences."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..session import folder


class ConstraintError(ValueError):
    """A write that a constraint forbids."""


def insert(table: DataFrame, rows: DataFrame, defaults: dict[str, Column] | None = None) -> DataFrame:
    """Appends rows; columns that they lack take their default, or null."""
    defaults = defaults or {}
    have = set(rows.columns)
    return table.unionByName(rows.select(*[F.col(c) if c in have else defaults.get(c, F.lit(None)).cast(table.schema[c].dataType).alias(c) for c in table.columns]))


def insert_or(table: DataFrame, rows: DataFrame, key: list[str], policy: str) -> DataFrame:
    """INSERT OR IGNORE, REPLACE or ABORT on a unique key: an anti join and a union."""
    rows = rows.dropDuplicates(key)
    if policy == "ignore":
        return table.unionByName(rows.join(table.select(*key), key, "left_anti"))
    if policy == "replace":
        return table.join(rows.select(*key), key, "left_anti").unionByName(rows)
    if policy == "abort":
        if not rows.join(table.select(*key), key, "left_semi").isEmpty():
            raise ConstraintError(f"UNIQUE constraint failed: {', '.join(key)}")
        return table.unionByName(rows)
    raise ValueError(f"no such policy: {policy}")


def upsert(table: DataFrame, rows: DataFrame, key: list[str], update: dict[str, str] | None) -> DataFrame:
    """ON CONFLICT (key) DO UPDATE SET column = expression, over ``t`` and ``excluded``; None: DO NOTHING. One full join on the key."""
    if update is None:
        return insert_or(table, rows, key, "ignore")
    on = " AND ".join(f"t.{k} = excluded.{k}" for k in key)
    both = table.withColumn("_t", F.lit(True)).alias("t").join(rows.withColumn("_e", F.lit(True)).alias("excluded"), F.expr(on), "full")
    old, new = F.col("t._t").isNotNull(), F.col("excluded._e").isNotNull()

    def column(c: str) -> Column:
        changed = F.expr(update[c]) if c in update else F.col(f"t.{c}")
        return F.when(old & new, changed).when(old, F.col(f"t.{c}")).otherwise(F.col(f"excluded.{c}")).cast(table.schema[c].dataType).alias(c)

    return both.select(*[column(c) for c in table.columns])


def with_generated(table: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Adds generated columns, each an expression over others, generated ones too; a circle among them is an error."""
    left = dict(rules)
    while left:
        ready = {c: e for c, e in left.items() if not any(re.search(rf"\b{other}\b", e) for other in left)}
        if not ready:
            raise ConstraintError(f"generated columns in a circle: {', '.join(sorted(left))}")
        table = table.withColumns({c: F.expr(e) for c, e in ready.items()})
        left = {c: e for c, e in left.items() if c not in ready}
    return table.select(*[c for c in table.columns if c not in rules], *rules)


def update(table: DataFrame, where: str, changes: dict[str, str]) -> DataFrame:
    """UPDATE t SET ... WHERE: all expressions see the old row."""
    return table.select(*[F.when(F.expr(where), F.expr(changes[c])).otherwise(F.col(c)).cast(table.schema[c].dataType).alias(c) if c in changes else F.col(c) for c in table.columns])


def update_from(table: DataFrame, source: DataFrame, on: list[str], changes: dict[str, str]) -> DataFrame:
    """UPDATE t SET column = expression of source FROM source; unmatched rows stay."""
    s = source.dropDuplicates(on).withColumn("_hit", F.lit(True)).alias("s")
    both = table.alias("t").join(s, [F.col(f"t.{k}") == F.col(f"s.{k}") for k in on], "left")
    return both.select(*[F.when(F.col("s._hit"), F.expr(changes[c])).otherwise(F.col(f"t.{c}")).cast(table.schema[c].dataType).alias(c) if c in changes else F.col(f"t.{c}") for c in table.columns])


def delete(table: DataFrame, where: str) -> DataFrame:
    """DELETE FROM t WHERE: a condition that is null deletes nothing."""
    return table.where(~F.coalesce(F.expr(where), F.lit(False)))


def returning(table: DataFrame, where: str, *columns: str) -> DataFrame:
    """The rows that a statement touches."""
    return table.where(where).selectExpr(*(columns or ("*",)))


def check(table: DataFrame, **rules: str) -> DataFrame:
    """CHECK constraints: the write fails at the first row for which one is false (null passes)."""
    for name, rule in rules.items():
        ok = F.coalesce(F.expr(rule), F.lit(True))
        table = table.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit(f"CHECK constraint failed: {name}")).cast("boolean")))
    return table


def violations(table: DataFrame, unique: list[str] | None = None, not_null: list[str] = (), foreign: tuple[list[str], DataFrame, list[str]] | None = None) -> DataFrame:
    """constraint and n: how many keys or rows break each constraint."""
    spark, out = table.sparkSession, []
    if unique:
        keyed = table.where(F.expr(" AND ".join(f"{c} IS NOT NULL" for c in unique)))
        out.append(keyed.groupBy(*unique).count().where("count > 1").agg(F.lit("unique").alias("constraint"), F.count(F.lit(1)).alias("n")))
    for c in not_null:
        out.append(table.where(F.col(c).isNull()).agg(F.lit(f"not null {c}").alias("constraint"), F.count(F.lit(1)).alias("n")))
    if foreign:
        columns, parent, keys = foreign
        lost = table.dropna(subset=columns).join(parent.select(*[F.col(k).alias(c) for c, k in zip(columns, keys)]), columns, "left_anti")
        out.append(lost.agg(F.lit("foreign key").alias("constraint"), F.count(F.lit(1)).alias("n")))
    result = spark.createDataFrame([], "constraint string, n long")
    for x in out:
        result = result.unionByName(x)
    return result


def delete_cascade(parent: DataFrame, child: DataFrame, where: str, key: str, reference: str, action: str = "cascade") -> tuple[DataFrame, DataFrame]:
    """Deletes parents and, by the foreign key's action (cascade, set null, restrict), treats their children."""
    gone = parent.where(where).select(F.col(key).alias(reference))
    if action == "restrict":
        if not child.join(gone, reference, "left_semi").isEmpty():
            raise ConstraintError("FOREIGN KEY constraint failed")
        kept = child
    elif action == "cascade":
        kept = child.join(gone, reference, "left_anti")
    else:
        marked = child.join(gone.distinct().withColumn("_gone", F.lit(True)), reference, "left")
        kept = marked.withColumn(reference, F.when(F.col("_gone").isNull(), F.col(reference))).select(*child.columns)
    return delete(parent, where), kept


def changes(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Change capture: one row per key that differs, change_type 1 (insert), 0 (update) or -1 (delete), with both images as JSON."""
    image = F.to_json(F.struct(*before.columns), {"ignoreNullFields": "false"})
    a = before.select(*key, image.alias("before"))
    b = after.select(*key, image.alias("after"))
    kind = F.when(F.col("before").isNull(), 1).when(F.col("after").isNull(), -1).otherwise(0)
    return a.join(b, key, "full").where(~F.col("before").eqNullSafe(F.col("after"))).select(*key, kind.alias("change_type"), "before", "after")


@dataclass
class Sequence:
    """A sequence of the driver: nextval, currval and setval; ``take`` numbers the rows of a table in one go."""

    start: int = 1
    increment: int = 1
    low: int | None = None
    high: int | None = None
    cycle: bool = False
    value: int | None = field(default=None)

    def nextval(self) -> int:
        n = self.start if self.value is None else self.value + self.increment
        if (self.high is not None and n > self.high) or (self.low is not None and n < self.low):
            if not self.cycle:
                raise ConstraintError("sequence is exhausted")
            n = self.low if self.increment > 0 and self.low is not None else self.start if self.increment > 0 else self.high
        self.value = n
        return n

    def currval(self) -> int:
        if self.value is None:
            raise ConstraintError("sequence hasn't been used in this session")
        return self.value

    def setval(self, n: int, called: bool = True) -> int:
        self.value = n if called else n - self.increment
        return n

    def take(self, df: DataFrame, column: str) -> DataFrame:
        """Adds the next values, without gaps: rows are counted by partition, not brought together.

        The rows are written with their places first, so that no rerun numbers them anew.
        """
        spark, path = df.sparkSession, folder(df.sparkSession, "numbered")
        base = self.start if self.value is None else self.value + self.increment
        df.withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()).write.parquet(path)
        tagged = spark.read.parquet(path)
        sizes = sorted((r._p, r["count"]) for r in tagged.groupBy("_p").count().collect())  # one number per partition
        offsets, n = [], 0
        for p, k in sizes:
            offsets.append((p, n))
            n += k
        starts = spark.createDataFrame(offsets, "_p int, _o long")
        self.value = base + (n - 1) * self.increment if n else self.value
        within = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
        return tagged.join(F.broadcast(starts), "_p").withColumn(column, F.lit(base) + (F.col("_o") + within) * self.increment).drop("_p", "_m", "_o")
