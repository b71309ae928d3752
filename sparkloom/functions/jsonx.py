"""JSON functions. Reading runs in the JVM; edits of documents are Arrow-batched pandas UDFs.

Malformed documents (and malformed new values) give null; numbers stay as they are written.
"""

from __future__ import annotations

import json
import re
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf, udtf

_STEP = re.compile(r"\.\"((?:[^\"\\]|\\.)*)\"|\.([^.\[\"]+)|\[(#-)?(\d+)\]|\[(#)\]")


def path_steps(path: str) -> list:
    """A path as keys and indexes: ``[n]`` an int, ``[#-n]`` a negative int, ``[#]`` the end (None)."""
    if not path.startswith("$"):
        raise ValueError(f"bad JSON path: {path}")
    out, at = [], 1
    while at < len(path):
        m = _STEP.match(path, at)
        if not m:
            raise ValueError(f"bad JSON path: {path}")
        out.append(m[1] if m[1] is not None else m[2] if m[2] is not None else None if m[5] else -int(m[4]) if m[3] else int(m[4]))
        at = m.end()
    return out


def extract(j: Column, path: str) -> Column:
    """json_extract with one path, as text: scalars bare, arrays and objects as JSON."""
    if "#" in path:
        v = F.try_parse_json(j)
        done = "$"
        for step in path_steps(path):
            if isinstance(step, int) and step < 0:
                size = F.json_array_length(F.get_json_object(j, done))
                return F.get(F.from_json(F.get_json_object(j, done), "array<string>"), (size + step).cast("int"))
            done += f"[{step}]" if isinstance(step, int) else f".{step}"
        return F.variant_get(v, done, "string")
    return F.get_json_object(j, path)


def valid(j: Column) -> Column:
    return F.when(j.isNotNull(), F.try_parse_json(j).isNotNull().cast("int"))


def minify(j: Column) -> Column:
    return F.to_json(F.parse_json(j))


def array_length(j: Column, path: str = "$") -> Column:
    return F.json_array_length(F.get_json_object(j, path) if path != "$" else j)


def type_of(j: Column, path: str = "$") -> Column:
    """null, true, false, integer, real, text, array or object."""
    v = F.try_variant_get(F.try_parse_json(j), path, "variant")
    kind = F.schema_of_variant(v)
    text = F.variant_get(v, "$", "string")
    return (
        F.when(v.isNull(), None).when(kind == "VOID", "null").when(kind == "BOOLEAN", text).when(kind == "BIGINT", "integer")
        .when(kind.startswith("DECIMAL") | (kind == "DOUBLE"), "real").when(kind == "STRING", "text").when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object")
    )


def array_of(*xs: Column) -> Column:
    """json_array of values of any types."""
    return F.concat(F.lit("["), F.concat_ws(",", *[literal(x) for x in xs]), F.lit("]"))


def literal(x: Column) -> Column:
    """json_quote."""
    text = F.to_json(F.array(x))
    return F.substring(text, F.lit(2), F.length(text) - 2)


def object_of(**xs: Column) -> Column:
    return F.to_json(F.struct(*[x.alias(k) for k, x in xs.items()]), {"ignoreNullFields": "false"})


def _put(doc, steps: list, value, insert: bool, replace: bool):
    if not steps:
        return value if replace else doc
    if doc is None and not isinstance(doc, (dict, list)):
        return doc
    head, rest = steps[0], steps[1:]
    if isinstance(doc, dict) and isinstance(head, str):
        if head in doc:
            doc[head] = _put(doc[head], rest, value, insert, replace)
        elif insert and not rest:
            doc[head] = value
        elif insert:
            doc[head] = _put([] if not isinstance(rest[0], str) else {}, rest, value, insert, replace)
    elif isinstance(doc, list) and not isinstance(head, str):
        k = len(doc) if head is None else len(doc) + head if head < 0 else head
        if 0 <= k < len(doc):
            doc[k] = _put(doc[k], rest, value, insert, replace)
        elif k == len(doc) and insert and not rest:
            doc.append(value)
    return doc


def _remove(doc, steps: list):
    if steps:
        for s in steps[:-1]:
            try:
                doc = doc[s]
            except (KeyError, IndexError, TypeError):
                return
        try:
            del doc[steps[-1]]
        except (KeyError, IndexError, TypeError):
            return


def _merge(a, b):
    """RFC 7396."""
    if not isinstance(b, dict):
        return b
    out = dict(a) if isinstance(a, dict) else {}
    for k, v in b.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = _merge(out.get(k), v)
    return out


class Number(str):
    """A number as it is written."""


def _parse(text: str):
    return json.loads(text, parse_float=Number, parse_int=Number)


def _load(text: str | None):
    """A document, or None and False where there is none or it is malformed."""
    try:
        return (None, False) if text is None else (_parse(text), True)
    except ValueError:
        return None, False


def _dump(x, indent: str | None = None, at: str = "") -> str:
    if isinstance(x, Number):
        return str(x)
    if isinstance(x, (dict, list)) and x:
        inner = "" if indent is None else at + indent
        before, between, after = ("", ",", "") if indent is None else ("\n" + inner, ",\n" + inner, "\n" + at)
        colon = ":" if indent is None else ": "
        if isinstance(x, dict):
            parts = (json.dumps(k, ensure_ascii=False) + colon + _dump(v, indent, inner) for k, v in x.items())
        else:
            parts = (_dump(v, indent, inner) for v in x)
        left, right = "{}" if isinstance(x, dict) else "[]"
        return left + before + between.join(parts) + after + right
    return json.dumps(x, separators=(",", ":"), ensure_ascii=False)


def _edit(path: str, insert: bool, replace: bool):
    steps = path_steps(path)

    def one(doc, value):
        (x, ok), (v, fine) = _load(doc), (None, True) if value is None else _load(value)
        return _dump(_put(x, steps, v, insert, replace)) if ok and fine else None

    @pandas_udf("string")
    def f(docs: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([one(d, v) for d, v in zip(docs, values)], dtype=object)

    return f


def set_(j: Column, path: str, value: Column) -> Column:
    """json_set: overwrite or insert; the value is JSON text."""
    return _edit(path, True, True)(j, value)


def insert(j: Column, path: str, value: Column) -> Column:
    return _edit(path, True, False)(j, value)


def replace(j: Column, path: str, value: Column) -> Column:
    return _edit(path, False, True)(j, value)


def remove(j: Column, *paths: str) -> Column:
    all_steps = [path_steps(p) for p in paths]

    def one(doc):
        x, ok = _load(doc)
        for steps in all_steps:
            _remove(x, steps)
        return _dump(x) if ok else None

    return _over(one, j)


def patch(a: Column, b: Column) -> Column:
    def one(x, y):
        (p, ok), (q, fine) = _load(x), _load(y)
        return _dump(_merge(p, q)) if ok and fine else None

    return _over(one, a, b)


def pretty(j: Column, indent: str = "    ") -> Column:
    """json_pretty: one element a line."""

    def one(doc):
        x, ok = _load(doc)
        return _dump(x, indent) if ok else None

    return _over(one, j)


def _over(one, *columns: Column, kind: str = "string") -> Column:
    @pandas_udf(kind)
    def f(*xs: pd.Series) -> pd.Series:
        return pd.Series([one(*row) for row in zip(*xs)], dtype=object)

    return f(*columns)


def error_position(j: Column) -> Column:
    """0 for valid text, else the place (from 1) at which reading it fails."""

    def one(doc):
        if doc is None:
            return None
        try:
            _parse(doc)
            return 0
        except json.JSONDecodeError as e:
            return e.pos + 1

    return _over(one, j, kind="long")


def _path(path: str) -> str:
    """A path, or a key alone as a path."""
    return path if path.startswith("$") else f"$['{path}']" if not path.isidentifier() else f"$.{path}"


def arrow(j: Column, path: str | int) -> Column:
    """j -> path: the part as JSON text, null where there is none."""
    return F.to_json(F.try_variant_get(F.try_parse_json(j), f"$[{path}]" if isinstance(path, int) else _path(path), "variant"))


def arrow_text(j: Column, path: str | int) -> Column:
    """j ->> path: the part as a value."""
    return F.try_variant_get(F.try_parse_json(j), f"$[{path}]" if isinstance(path, int) else _path(path), "string")


def extract_many(j: Column, *paths: str) -> Column:
    """json_extract with several paths: a JSON array, null where a path leads nowhere."""
    parts = F.concat_ws(",", *[F.coalesce(arrow(j, p), F.lit("null")) for p in paths])
    return F.when(valid(j) == 1, F.concat(F.lit("["), parts, F.lit("]")))


def jsonb_object(**xs: Column) -> Column:
    """Binary JSON is VARIANT."""
    return F.to_variant_object(F.struct(*[x.alias(k) for k, x in xs.items()]))


def jsonb_array(*xs: Column) -> Column:
    return F.parse_json(array_of(*xs))


def jsonb_extract(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def jsonb_set(v: Column, path: str, value: Column) -> Column:
    return F.try_parse_json(set_(F.to_json(v), path, value))


def jsonb_insert(v: Column, path: str, value: Column) -> Column:
    return F.try_parse_json(insert(F.to_json(v), path, value))


def jsonb_replace(v: Column, path: str, value: Column) -> Column:
    return F.try_parse_json(replace(F.to_json(v), path, value))


def jsonb_remove(v: Column, *paths: str) -> Column:
    return F.try_parse_json(remove(F.to_json(v), *paths))


def jsonb_patch(v: Column, other: Column) -> Column:
    return F.try_parse_json(patch(F.to_json(v), other))


def jsonb_group_array(x: Column) -> Column:
    """Nulls are elements too."""
    return F.parse_json(F.concat(F.lit("["), F.array_join(F.collect_list(F.coalesce(literal(x), F.lit("null"))), ","), F.lit("]")))


def jsonb_group_object(k: Column, v: Column) -> Column:
    return F.parse_json(F.concat(F.lit("{"), F.array_join(F.collect_list(F.concat(literal(k.cast("string")), F.lit(":"), F.coalesce(literal(v), F.lit("null")))), ","), F.lit("}")))


def each(df: DataFrame, column: str) -> DataFrame:
    """json_each: one row per element of a document's top level, beside the row's own columns; an object's keys come in order.

    Adds key, value, type, atom (null for arrays and objects), id, parent, fullkey and path.
    """
    view = f"_each_{uuid.uuid4().hex}"
    df.withColumn("_doc", F.try_parse_json(F.col(column))).createOrReplaceTempView(view)
    t = df.sparkSession.sql(f"SELECT t.*, e.pos AS _pos, e.key AS _key, e.value AS _value FROM {view} t, LATERAL variant_explode(t._doc) e")
    v, key = F.col("_value"), F.coalesce("_key", F.col("_pos").cast("string"))
    kind = type_of(F.to_json(v))
    text = F.when(kind.isin("array", "object"), F.to_json(v)).otherwise(F.variant_get(v, "$", "string"))
    full = F.when(F.col("_key").isNull(), F.concat(F.lit("$["), key, F.lit("]"))).otherwise(F.concat(F.lit("$."), key))
    return t.select(
        *[c for c in df.columns], key.alias("key"), text.alias("value"), kind.alias("type"), F.when(~kind.isin("array", "object"), text).alias("atom"),
        (F.col("_pos") + 1).alias("id"), F.lit(None).cast("int").alias("parent"), full.alias("fullkey"), F.lit("$").alias("path"),
    )


@udtf(returnType="key string, value string, type string, atom string, id int, parent int, fullkey string, path string")
class JsonTree:
    """json_tree: all values of a document, depth first."""

    def eval(self, doc: str):
        if doc is not None:
            x, ok = _load(doc)
            if ok:
                yield from self._walk(x, None, None, "$", None, [0])

    def _walk(self, v, key, parent, full, path, n):
        kind = "null" if v is None else str(v).lower() if isinstance(v, bool) else ("integer" if v.lstrip("-").isdigit() else "real") if isinstance(v, Number) else "text" if isinstance(v, str) else "array" if isinstance(v, list) else "object"
        text = None if v is None else str(v) if isinstance(v, str) else _dump(v)
        own = n[0]
        n[0] += 1
        yield key, text, kind, text if kind not in ("array", "object") else None, own, parent, full, path if path is not None else "$"
        items = v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ()
        for k, x in items:
            yield from self._walk(x, str(k), own, f"{full}[{k}]" if isinstance(v, list) else f"{full}.{k}", full, n)


