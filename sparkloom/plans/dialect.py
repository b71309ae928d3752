"""SQL text in the dialect of an embedded database, rewritten to Spark SQL.

The rewriter works on tokens, so text in quotes and comments is safe. What it changes is
what differs between the dialects: LIKE ignores case, GLOB and REGEXP, IS between any two
values, ``==``, quoting of names, index hints, LIMIT forms, set operations of one
precedence, row values, JSON arrows, and functions of other names. Statements that write
(INSERT, UPDATE, DELETE, CREATE TABLE, ALTER TABLE, DROP) replace a table of the session.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..functions import sqlfuncs
from ..functions.core import glob_regex
from ..sources import catalog, tables

_TOKEN = re.compile(
    r"(?P<space>\s+|--[^\n]*|/\*.*?\*/)|(?P<string>'(?:[^']|'')*')|(?P<name>\"(?:[^\"]|\"\")*\"|`(?:[^`]|``)*`|\[[^\]]*\])|(?P<blob>[xX]'[0-9a-fA-F]*')"
    r"|(?P<number>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|(?P<word>[A-Za-z_\u0080-\U0010FFFF][\w$]*)|(?P<param>[?:@$]\w*)|(?P<op>\|\||==|<>|!=|<=|>=|<<|>>|->>|->|::|.)",
    re.S,
)
#: Functions whose calls only change their names.
_NAMES = {"ifnull": "ifnull", "iif": "if", "unicode": "ascii", "char_length": "char_length", "string_reverse": "reverse", "stddev": "stddev_samp", "gen_random_uuid": "uuid", "uuid4_str": "uuid", "fuzzy_leven": "levenshtein", "fuzzy_soundex": "soundex", "regexp_capture": "regexp_extract", "regexp_substr": "regexp_substr", "json_valid": "json_valid_text", "likely": "", "unlikely": "", "array_length": "cardinality", "array_cat": "concat", "trunc": "trunc_number"}
#: Calls that become expressions; {0} is the first argument and so on.
_CALLS = {
    ("total", 1): "coalesce(sum(CAST({0} AS DOUBLE)), 0.0D)", ("group_concat", 1): "listagg(CAST({0} AS STRING), ',')", ("group_concat", 2): "listagg(CAST({0} AS STRING), {1})",
    ("log", 1): "log10({0})", ("log", 2): "log({0}, {1})", ("trunc_number", 1): "CAST(CASE WHEN {0} < 0 THEN ceil({0}) ELSE floor({0}) END AS DOUBLE)", ("mod", 2): "try_mod(CAST({0} AS DOUBLE), CAST({1} AS DOUBLE))",
    ("glob", 2): "{1} RLIKE {0}", ("date", 1): "date_format(CAST({0} AS TIMESTAMP_NTZ), 'yyyy-MM-dd')", ("time", 1): "date_format(CAST({0} AS TIMESTAMP_NTZ), 'HH:mm:ss')", ("datetime", 1): "date_format(CAST({0} AS TIMESTAMP_NTZ), 'yyyy-MM-dd HH:mm:ss')",
    ("julianday", 1): "unix_micros(CAST({0} AS TIMESTAMP)) / 86400e6D + 2440587.5D", ("unixepoch", 1): "unix_seconds(CAST({0} AS TIMESTAMP))", ("json_extract", 2): "get_json_object({0}, {1})", ("json_valid_text", 1): "CAST(try_parse_json({0}) IS NOT NULL AS INT)",
    ("sign", 1): "CAST(sign(TRY_CAST({0} AS DOUBLE)) AS BIGINT)", ("zeroblob", 1): "unhex(repeat('00', {0}))", ("hex", 1): "hex(CAST({0} AS STRING))", ("json_array_length", 1): "json_array_length({0})", ("likelihood", 2): "({0})",
}


@dataclass
class Token:
    kind: str
    text: str

    @property
    def up(self) -> str:
        return self.text.upper() if self.kind == "word" else ""


def tokenize(text: str) -> list[Token]:
    """Tokens without comments; runs of white space are one space."""
    out = []
    for m in _TOKEN.finditer(text):
        if m.lastgroup == "space":
            if out and out[-1].kind != "space":
                out.append(Token("space", " "))
        else:
            out.append(Token(m.lastgroup, m[0]))
    while out and (out[-1].kind == "space" or out[-1].text == ";"):
        out.pop()
    return out


def translate(text: str) -> str:
    """One query in Spark SQL."""
    return "".join(t.text for t in _compound(_calls(_rows(_arrows(_tokens(tokenize(text))))))).strip()


def _next(ts: list[Token], k: int) -> int:
    k += 1
    while k < len(ts) and ts[k].kind == "space":
        k += 1
    return k


def _tokens(ts: list[Token]) -> list[Token]:
    out: list[Token] = []
    k = 0
    while k < len(ts):
        t, n = ts[k], _next(ts, k)
        after = ts[n] if n < len(ts) else Token("end", "")
        if t.kind == "string":
            t = Token("string", t.text.replace("\\", "\\\\"))
        elif t.kind == "name":
            t = Token("name", "`" + t.text[1:-1].replace('""', '"').replace("`", "``") + "`")
        elif t.text == "==":
            t = Token("op", "=")
        elif t.up == "LIKE":
            t = Token("word", "ILIKE")
        elif t.up == "GLOB" and after.kind == "string":
            pattern = glob_regex(after.text[1:-1].replace("''", "'")).replace("\\", "\\\\").replace("'", "''")
            out += [Token("word", "RLIKE"), Token("space", " "), Token("string", f"'{pattern}'")]
            k = n + 1
            continue
        elif t.up == "REGEXP":
            t = Token("word", "RLIKE")
        elif t.up == "ISNULL":
            t = Token("word", "IS NULL")
        elif t.up == "NOTNULL":
            t = Token("word", "IS NOT NULL")
        elif t.up == "IS":
            no = after.up == "NOT"
            then = ts[_next(ts, n)] if no and _next(ts, n) < len(ts) else after
            if then.up not in ("NULL", "TRUE", "FALSE", "DISTINCT", "UNKNOWN"):
                t = Token("word", f"IS {'' if no else 'NOT '}DISTINCT FROM")
                if no:
                    k = n
            out.append(t)
            k += 1
            continue
        elif t.up == "INDEXED" and after.up == "BY":
            k = _next(ts, n) + 1
            continue
        elif t.up == "NOT" and after.up in ("INDEXED", "MATERIALIZED"):
            k = n + 1
            continue
        elif t.up == "MATERIALIZED":
            k += 1
            continue
        elif t.up == "LIMIT":
            if after.text == "-":  # a negative limit is none
                k = _next(ts, n) + 1
                if k < len(ts) and ts[k].kind == "space":
                    k += 1
                continue
            m = _next(ts, n)
            if m < len(ts) and ts[m].text == ",":
                count = ts[_next(ts, m)]
                out += [Token("word", f"LIMIT {count.text} OFFSET {after.text}")]
                k = _next(ts, m) + 1
                continue
        out.append(t)
        k += 1
    return out


def _opening(ts: list[Token], k: int) -> int:
    """Where the operand that ends at k begins: a name, a literal, a parenthesis, or a call."""
    if ts[k].text == ")":
        depth = 0
        while k >= 0:
            depth += (ts[k].text == ")") - (ts[k].text == "(")
            if not depth:
                break
            k -= 1
        if k and ts[k - 1].kind in ("word", "call"):
            k -= 1
    while k > 1 and ts[k - 1].text == "." and ts[k - 2].kind in ("word", "name"):
        k -= 2
    return k


def _closing(ts: list[Token], k: int) -> int:
    """Where the parenthesis that opens at k closes."""
    depth = 0
    for end in range(k, len(ts)):
        depth += (ts[end].text == "(") - (ts[end].text == ")")
        if not depth:
            return end
    raise ValueError("a parenthesis isn't closed")


def _arrows(ts: list[Token]) -> list[Token]:
    """``j -> p`` as the part's JSON text, ``j ->> p`` as its value; p is a path, a key or a place, given as a literal."""
    k = 0
    while k < len(ts):
        if ts[k].text in ("->", "->>") and ts[k].kind == "op":
            right = _next(ts, k)
            left = k - 1
            while ts[left].kind == "space":
                left -= 1
            start = _opening(ts, left)
            body = "".join(t.text for t in ts[start : left + 1])
            if ts[right].kind == "number":
                path = f"$[{ts[right].text}]"
            elif ts[right].kind == "string":
                path = ts[right].text[1:-1]
                path = path if path.startswith("$") else f"$['{path}']".replace("'", "''") if not path.isidentifier() else f"$.{path}"
            else:
                raise ValueError("a JSON arrow takes a literal path, key or place")
            part = f"try_variant_get(try_parse_json({body}), '{path}', '{'string' if ts[k].text == '->>' else 'variant'}')"
            ts = [*ts[:start], Token("call", part if ts[k].text == "->>" else f"to_json({part})"), *ts[right + 1 :]]
            k = start
        k += 1
    return ts


def _rows(ts: list[Token]) -> list[Token]:
    """Comparisons of row values, from left to right."""
    k = 0
    while k < len(ts):
        before = next((t for t in reversed(ts[:k]) if t.kind != "space"), Token("op", "("))
        if ts[k].text == "(" and not (k and ts[k - 1].kind in ("word", "call") and ts[k - 1].up not in ("WHERE", "AND", "OR", "NOT", "ON", "WHEN", "HAVING")) and before.up != "IN":
            end = _closing(ts, k)
            op = _next(ts, end)
            if op < len(ts) and ts[op].text in ("<", "<=", ">", ">=", "=", "<>", "!=") and (right := _next(ts, op)) < len(ts) and ts[right].text == "(":
                last = _closing(ts, right)
                xs, ys = _parts(ts[k + 1 : end]), _parts(ts[right + 1 : last])
                if len(xs) == len(ys) > 1 and not xs[0].upper().startswith("SELECT") and not ys[0].upper().startswith("SELECT"):
                    ts = [*ts[:k], Token("call", _lexical(ts[op].text, xs, ys)), *ts[last + 1 :]]
        k += 1
    return ts


def _parts(ts: list[Token]) -> list[str]:
    """What commas part, outside parentheses."""
    out, depth = [""], 0
    for t in ts:
        depth += (t.text == "(") - (t.text == ")")
        if t.text == "," and not depth:
            out.append("")
        else:
            out[-1] += t.text
    return [x.strip() for x in out]


def _lexical(op: str, xs: list[str], ys: list[str]) -> str:
    if op in ("=", "<>", "!="):
        same = " AND ".join(f"{x} = {y}" for x, y in zip(xs, ys))
        return f"({same})" if op == "=" else f"(NOT ({same}))"
    strict = op[0]
    out = f"{xs[-1]} {op} {ys[-1]}"
    for x, y in reversed(list(zip(xs[:-1], ys[:-1]))):
        out = f"{x} {strict} {y} OR ({x} = {y} AND ({out}))"
    return f"({out})"


def _calls(ts: list[Token]) -> list[Token]:
    """Renames functions and rewrites calls, innermost first."""
    k = len(ts) - 1
    while k >= 0:
        name = ts[k].text.lower() if ts[k].kind == "word" else ""
        name = _NAMES.get(name, name)
        if k + 1 < len(ts) and ts[k + 1].text == "(" and ts[k].kind == "word":
            args, depth, at, end = [], 0, k + 2, k + 1
            for end in range(k + 1, len(ts)):
                depth += (ts[end].text == "(") - (ts[end].text == ")")
                if (depth == 1 and ts[end].text == ",") or depth == 0:
                    args.append("".join(x.text for x in ts[at:end]).strip())
                    at = end + 1
                if not depth:
                    break
            form = _CALLS.get((name, len(args)))
            if form and args[0]:
                distinct = re.match(r"(?i)distinct\s+(.*)", args[0], re.S)
                new = form.format(distinct[1] if distinct else args[0], *args[1:])
                ts[k : end + 1] = [Token("call", new.replace("(CAST(", "(DISTINCT CAST(", 1) if distinct else new)]
            elif ts[k].text.lower() in _NAMES:
                ts[k] = Token("word", name)
        k -= 1
    return ts


def _compound(ts: list[Token]) -> list[Token]:
    """Set operations apply from left to right: a mixed chain gets parentheses."""
    depth, marks = 0, []
    for k, t in enumerate(ts):
        depth += (t.text == "(") - (t.text == ")")
        if not depth and t.up in ("UNION", "INTERSECT", "EXCEPT"):
            marks.append(k)
    if len(marks) < 2 or len({ts[k].up for k in marks}) == 1:
        return ts
    stop = next((k for k in range(marks[-1], len(ts)) if ts[k].up in ("ORDER", "LIMIT")), len(ts))
    body = ts[:stop]
    for k in reversed(marks[1:]):
        body.insert(k, Token("op", ") "))
    return [Token("op", "(")] * (len(marks) - 1) + body + ([Token("space", " ")] if stop < len(ts) else []) + ts[stop:]


def sql(spark: SparkSession, text: str, **args) -> DataFrame:
    """Runs a statement: a query, EXPLAIN, VALUES, PRAGMA table_info or table_list, CREATE [TEMP] VIEW or TABLE, DROP, ALTER TABLE, INSERT, UPDATE or DELETE.

    A write returns its rows where it says RETURNING, else none; changes(), total_changes()
    and last_insert_rowid() tell of the session's writes.
    """
    head = text.strip().rstrip(";")
    head = re.sub(r"(?i)\b(changes|total_changes|last_insert_rowid)\s*\(\s*\)", lambda m: str(tables.counter(spark, m[1].lower())), head)
    if re.match(r"(?is)(insert|replace|update|delete|alter|reindex|drop\s+index|create\s+(unique\s+)?index|create\s+virtual|create\s+(temp(orary)?\s+)?table\s+(if\s+not\s+exists\s+)?[\w\"`]+\s*\()", head):
        return tables.write(spark, head, translate, args or None)
    sqlfuncs.install(spark, head.lower())
    if m := re.fullmatch(r"(?is)pragma\s+table_info\s*\(\s*['\"]?(\w+)['\"]?\s*\)", head):
        return catalog.table_info(spark.table(m[1]))
    if re.fullmatch(r"(?is)pragma\s+table_list", head):
        return catalog.schema_table(spark)
    if m := re.match(r"(?is)explain\s+(?:query\s+plan\s+)?(.*)", head):
        return spark.sql("EXPLAIN FORMATTED " + translate(m[1]), args=args or None)
    if m := re.match(r"(?is)create\s+(?:temp(?:orary)?\s+)?(?:view|table)\s+(if\s+not\s+exists\s+)?(\w+)\s+as\s+(.*)", head):
        df = spark.sql(translate(m[3]), args=args or None)
        catalog.create_view(spark, m[2], df, bool(m[1]))
        return df.limit(0)
    if m := re.fullmatch(r"(?is)drop\s+(?:view|table)\s+(if\s+exists\s+)?(\w+)", head):
        if not spark.catalog.dropTempView(m[2]) and not m[1]:
            raise ValueError(f"no such table: {m[2]}")
        return spark.createDataFrame([], "dropped string")
    return spark.sql(translate(head), args=args or None)
