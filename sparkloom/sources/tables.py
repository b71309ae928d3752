"""Tables of a session that statements change: CREATE TABLE, ALTER TABLE, INSERT, UPDATE and DELETE as text.

A table is a temporary view over a plan, and a statement replaces the view by a rewrite of
it; nothing is run until the table is read, but for the counts that changes() tells. Where
the session names a checkpoint folder, every tenth statement on a table cuts its lineage.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import dml
from ..session import folder
from . import virtual

#: Types by the words of their declared names, in the order in which they are tried.
_TYPES = (("INT", "bigint"), ("CHAR", "string"), ("CLOB", "string"), ("TEXT", "string"), ("BLOB", "binary"), ("REAL", "double"), ("FLOA", "double"), ("DOUB", "double"), ("BOOL", "boolean"), ("DATE", "string"))
_NAME = r"[\w\"`]+"
_state: dict[str, dict] = {}


def _of(spark: SparkSession) -> dict:
    return _state.setdefault(spark._jsparkSession.sessionUUID(), {"changes": 0, "total_changes": 0, "last_insert_rowid": 0, "tables": {}})


def counter(spark: SparkSession, name: str) -> int:
    """changes, total_changes or last_insert_rowid."""
    return _of(spark)[name]


def type_of(declared: str) -> str:
    """A declared type's name as a Spark type: text where it says nothing."""
    return next((t for word, t in _TYPES if word in declared.upper()), "decimal(38,10)" if re.match(r"(?i)num|dec", declared) else "string")


def _plain(name: str) -> str:
    return name.strip().strip('"`')


def _replace(spark: SparkSession, name: str, df: DataFrame) -> None:
    own = _of(spark)["tables"].setdefault(name, {"defaults": {}, "key": None, "rows": 0, "writes": 0})
    own["writes"] += 1
    if own["writes"] % 10 == 0 and spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        df = df.checkpoint()
    df.createOrReplaceTempView(name)


def _count(spark: SparkSession, n: int) -> None:
    s = _of(spark)
    s["changes"] = n
    s["total_changes"] += n


def parts(text: str) -> list[str]:
    """What commas part, outside parentheses and quotes."""
    out, depth, quoted = [""], 0, False
    for c in text:
        quoted ^= c == "'"
        depth += 0 if quoted else (c == "(") - (c == ")")
        if c == "," and not depth and not quoted:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out if x.strip()]


def write(spark: SparkSession, text: str, translate: Callable[[str], str], args: dict | None = None) -> DataFrame:
    """Runs one statement; returns the rows of RETURNING, or none."""
    returning = None
    if m := re.search(r"(?is)\breturning\s+(.*)$", text):
        returning, text = translate(m[1]), text[: m.start()].rstrip()
    forms = (
        (rf"create\s+(?:temp(?:orary)?\s+)?table\s+(if\s+not\s+exists\s+)?({_NAME})\s*\((.*)\)(?:\s*strict)?", _create),
        (rf"create\s+virtual\s+table\s+({_NAME})\s+using\s+(\w+)\s*\((.*)\)", _create_virtual),
        (rf"create\s+(unique\s+)?index\s+(?:if\s+not\s+exists\s+)?({_NAME})\s+on\s+({_NAME})\s*\((.*)\)", _create_index),
        (rf"drop\s+index\s+(if\s+exists\s+)?({_NAME})", _drop_index),
        (rf"reindex\s+({_NAME})", _reindex),
        (rf"alter\s+table\s+({_NAME})\s+(.*)", _alter),
        (rf"(insert|replace)(?:\s+or\s+(\w+))?\s+into\s+({_NAME})\s*(?:\(([^()]*)\)\s*)?(values\b.*|select\b.*|with\b.*|default\s+values)", _insert),
        (rf"update\s+({_NAME})\s+set\s+(.*?)(?:\s+where\s+(.*))?", _update),
        (rf"delete\s+from\s+({_NAME})(?:\s+where\s+(.*))?", _delete),
    )
    for pattern, run in forms:
        if m := re.fullmatch("(?is)" + pattern, text):
            rows = run(spark, m, translate, args)
            return spark.createDataFrame([], "changed string") if returning is None or rows is None else rows.selectExpr(*parts(returning))
    raise ValueError(f"no such statement: {text[:40]}")


def _create(spark, m, translate, args) -> None:
    name = _plain(m[2])
    if m[1] and spark.catalog.tableExists(name):
        return
    own, columns = {"defaults": {}, "key": None, "rows": 0, "writes": 0}, []
    for part in parts(m[3]):
        if re.match(r"(?i)(primary\s+key|unique|check|foreign\s+key|constraint)\b", part):
            if k := re.match(r"(?i)primary\s+key\s*\(\s*([^,)]+)\)", part):
                own["key"] = _plain(k[1])
            continue
        column, _, rest = part.partition(" ")
        column = _plain(column)
        declared = re.split(r"(?i)\b(primary|not|null|default|unique|check|references|collate|generated)\b", rest)[0]
        columns.append(f"`{column}` {type_of(declared)}")
        if re.search(r"(?i)primary\s+key", rest):
            own["key"] = column
        if d := re.search(r"(?i)default\s+(\([^)]*\)|'(?:[^']|'')*'|[-\w.]+)", rest):
            own["defaults"][column] = d[1]
    _of(spark)["tables"][name] = own
    _replace(spark, name, spark.createDataFrame([], ", ".join(columns)))


def _create_virtual(spark, m, translate, args) -> None:
    """A module's table; its arguments are options, name = value."""
    options = {k.strip(): v.strip().strip("'\"") for k, _, v in (p.partition("=") for p in parts(m[3]))}
    if m[2].lower() == "series":
        virtual.register(spark)
    spark.read.format(m[2]).options(**options).load().createOrReplaceTempView(_plain(m[1]))


def _indexes(spark) -> dict:
    return _of(spark).setdefault("indexes", {})


def _create_index(spark, m, translate, args) -> None:
    """An index is the table itself, written in the order of its columns, so that the statistics of its files and row groups lead a seek."""
    name, unique, table, columns = _plain(m[2]), bool(m[1]), _plain(m[3]), [_plain(c) for c in parts(m[4])]
    t = spark.table(table)
    keyed = t.dropna(subset=columns)
    if unique and not keyed.groupBy(*columns).count().where("count > 1").isEmpty():
        raise dml.ConstraintError(f"UNIQUE constraint failed: {', '.join(f'{table}.{c}' for c in columns)}")
    path = folder(spark, f"index-{name}")
    t.orderBy(*[F.expr(c) for c in columns]).write.parquet(path)
    _replace(spark, table, spark.read.parquet(path))
    _indexes(spark)[name] = (table, m[4], unique)


def _drop_index(spark, m, translate, args) -> None:
    if _indexes(spark).pop(_plain(m[2]), None) is None and not m[1]:
        raise ValueError(f"no such index: {_plain(m[2])}")


def _reindex(spark, m, translate, args) -> None:
    """Writes a table again in the order of an index, or of all of its own."""
    for name, (table, columns, unique) in list(_indexes(spark).items()):
        if _plain(m[1]) in (name, table):
            _create_index(spark, [None, unique, name, table, columns], translate, args)


def _alter(spark, m, translate, args) -> None:
    name, what, tables = _plain(m[1]), m[2].strip(), _of(spark)["tables"]
    t = spark.table(name)
    if r := re.fullmatch(rf"(?is)rename\s+to\s+({_NAME})", what):
        new = _plain(r[1])
        tables[new] = tables.pop(name, {"defaults": {}, "key": None, "rows": 0, "writes": 0})
        _replace(spark, new, t)
        spark.catalog.dropTempView(name)
    elif r := re.fullmatch(rf"(?is)rename\s+(?:column\s+)?({_NAME})\s+to\s+({_NAME})", what):
        _replace(spark, name, t.withColumnRenamed(_plain(r[1]), _plain(r[2])))
    elif r := re.fullmatch(rf"(?is)drop\s+(?:column\s+)?({_NAME})", what):
        _replace(spark, name, t.drop(_plain(r[1])))
    elif r := re.fullmatch(rf"(?is)add\s+(?:column\s+)?({_NAME})\s*(.*?)(?:\s+default\s+(.+))?", what):
        value = F.expr(translate(r[3])) if r[3] else F.lit(None)
        _replace(spark, name, t.withColumn(_plain(r[1]), value.cast(type_of(r[2]))))
        if r[3]:
            tables[name]["defaults"][_plain(r[1])] = r[3]
    else:
        raise ValueError(f"no such change of a table: {what}")


def _insert(spark, m, translate, args) -> DataFrame:
    policy, name = ("replace" if m[1].lower() == "replace" else (m[2] or "abort").lower()), _plain(m[3])
    t, own = spark.table(name), _of(spark)["tables"].setdefault(name, {"defaults": {}, "key": None, "rows": 0, "writes": 0})
    defaults = {c: F.expr(translate(v)) for c, v in own["defaults"].items()}
    if re.match(r"(?is)default\s+values", m[5]):
        rows = spark.range(1).select(*[defaults.get(c, F.lit(None)).cast(t.schema[c].dataType).alias(c) for c in t.columns])
    else:
        columns = [_plain(c) for c in m[4].split(",")] if m[4] else t.columns
        source = spark.sql(translate(m[5]), args=args)
        if len(source.columns) != len(columns):
            raise ValueError(f"{len(source.columns)} values for {len(columns)} columns")
        rows = dml.insert(t.limit(0), source.toDF(*columns), defaults)
    n = rows.count()
    key = own["key"]
    if key:
        numbered = dict(t.dtypes)[key] == "bigint"
        if numbered:  # a key that isn't given goes on from the greatest
            top = t.agg(F.max(key)).first()[0] or 0
            if rows.where(F.col(key).isNull()).count():
                rows = dml.Sequence(start=top + 1).take(rows.drop(key), key).select(*[F.col(c).cast(t.schema[c].dataType).alias(c) for c in t.columns])
        before = t.count()
        out = dml.insert_or(t, rows, [key], policy if policy in ("ignore", "replace") else "abort")
        n = out.count() - before if policy == "ignore" else n
        last = (rows.agg(F.max(key)).first()[0] if numbered else own["rows"] + n) or 0
    else:
        out, last = t.unionByName(rows), own["rows"] + n
    own["rows"] += n
    _of(spark)["last_insert_rowid"] = int(last) if n else _of(spark)["last_insert_rowid"]
    _replace(spark, name, out)
    _count(spark, n)
    return rows


def _update(spark, m, translate, args) -> DataFrame:
    name, where = _plain(m[1]), translate(m[3]) if m[3] else "true"
    t = spark.table(name)
    changes = {_plain(c): translate(v) for c, _, v in (p.partition("=") for p in parts(m[2]))}
    missing = set(changes) - set(t.columns)
    if missing:
        raise ValueError(f"no such column: {', '.join(sorted(missing))}")
    touched = t.where(where)
    _count(spark, touched.count())
    _replace(spark, name, dml.update(t, where, changes))
    return dml.update(touched, "true", changes)


def _delete(spark, m, translate, args) -> DataFrame:
    name, where = _plain(m[1]), translate(m[2]) if m[2] else "true"
    t = spark.table(name)
    gone = t.where(where)
    _count(spark, gone.count())
    _replace(spark, name, dml.delete(t, where))
    return gone
