"""Full-text search over a token table: match, BM25 scores, highlights and top-k."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

K1, B = 1.2, 0.75


def tokens(text: Column, tokenizer: str = "default", n: int = 3) -> Column:
    """An array of tokens: default and simple (lower-case words), whitespace, raw (one token) or ngram."""
    if tokenizer == "raw":
        return F.array(text)
    if tokenizer == "whitespace":
        return F.filter(F.split(text, r"\s+"), lambda t: t != "")
    if tokenizer == "ngram":
        return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(F.lower(text), i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def index(df: DataFrame, key: str, columns: list[str], tokenizer: str = "default") -> DataFrame:
    """The token table: key, field, token, tf and the field's length. It is written once and read by queries."""
    parts = [df.select(F.col(key).alias("key"), F.lit(c).alias("field"), tokens(F.col(c), tokenizer).alias("t")) for c in columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.select("key", "field", F.size("t").alias("length"), F.explode("t").alias("token")).groupBy("key", "field", "length", "token").agg(F.count(F.lit(1)).alias("tf"))


def _phrase(tokens_: Column, words: list[str]) -> Column:
    line = lambda x: F.concat(F.lit("\x01"), x, F.lit("\x01"))
    return F.contains(line(F.array_join(tokens_, "\x01")), line(F.lit("\x01".join(words))))


class Query:
    """A parsed query: terms, ``"phrases"``, ``prefix*``, ``field:term``, AND, OR, NOT and parentheses. Terms side by side are joined by OR."""

    _PART = re.compile(r'\s*(?:(\()|(\))|(?:(\w+):)?"([^"]*)"|(?:(\w+):)?([\w\u0080-￿]+\*?))')

    def __init__(self, text: str):
        self.parts, at = [], 0
        while at < len(text.rstrip()):
            m = self._PART.match(text, at)
            if not m:
                raise ValueError(f"bad query at {at}: {text}")
            self.parts.append(m.groups())
            at = m.end()
        self.k, self.terms = 0, []
        self.tree = self._either()
        if self.k < len(self.parts):
            raise ValueError(f"bad query: {text}")

    def _word(self):
        return self.parts[self.k][5] if self.k < len(self.parts) else None

    def _either(self):
        out = self._all()
        while self.k < len(self.parts) and not self.parts[self.k][1]:
            if self._word() == "OR":
                self.k += 1
            out = ("or", out, self._all())
        return out

    def _all(self):
        out = self._one()
        while self._word() in ("AND", "NOT"):
            if self._word() == "NOT":
                self.k += 1
                out = ("and", out, ("not", self._one()))
            else:
                self.k += 1
                out = ("and", out, self._one())
        return out

    def _one(self):
        if self._word() == "NOT":
            self.k += 1
            return ("not", self._one())
        opened, _, pf, phrase, f, word = self.parts[self.k]
        self.k += 1
        if opened:
            out = self._either()
            self.k += 1
            return out
        if phrase is not None:
            words = [w for w in re.split(r"[^\w]+", phrase.lower()) if w]
            self.terms += [(pf, w) for w in words]
            return ("phrase", pf, words)
        self.terms.append((f, word.lower()))
        return ("term", f, word.lower())

    def condition(self, columns: dict[str, Column]) -> Column:
        """The query as a condition on arrays of tokens."""

        def of(x) -> Column:
            if x[0] == "and":
                return of(x[1]) & of(x[2])
            if x[0] == "or":
                return of(x[1]) | of(x[2])
            if x[0] == "not":
                return ~of(x[1])
            some = [columns[x[1]]] if x[1] else list(columns.values())
            out = F.lit(False)
            for c in some:
                if x[0] == "phrase":
                    hit = _phrase(c, x[2])
                elif x[2].endswith("*"):
                    hit = F.exists(c, lambda t: t.startswith(x[2][:-1]))
                else:
                    hit = F.array_contains(c, x[2])
                out = out | hit
            return out

        return of(self.tree)


def match(df: DataFrame, columns: list[str], query: str, tokenizer: str = "default") -> DataFrame:
    """fts_match: the rows that the query holds for. One narrow pass."""
    return df.where(Query(query).condition({c: tokens(F.col(c), tokenizer) for c in columns}))


def score(idx: DataFrame, documents: int, mean_length: float, terms: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """key and BM25 score of the rows with any of the terms, from a token table: only the terms' rows move."""
    hits = idx.where(F.col("token").isin(terms))
    df = hits.groupBy("token").agg(F.countDistinct("key").alias("df"))
    idf = F.log(1 + (F.lit(documents) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(mean_length)))
    weight = F.lit(1.0)
    for c, w in (weights or {}).items():
        weight = F.when(F.col("field") == c, F.lit(w)).otherwise(weight)
    return hits.join(F.broadcast(df), "token").groupBy("key").agg(F.sum(idf * tf * weight).alias("score"))  # one row per term


def term_counts(df: DataFrame, key: str, columns: list[str], terms: list[str], tokenizer: str = "default") -> DataFrame:
    """key, length, and how often each of the terms comes up: one narrow pass, nothing exploded."""
    words = F.concat(*[F.coalesce(tokens(F.col(c), tokenizer), F.array().cast("array<string>")) for c in columns])
    counts = df.select(F.col(key).alias("key"), words.alias("t"))

    def times(term: str) -> Column:
        return F.size(F.filter("t", lambda x: x == F.lit(term)))

    return counts.select("key", F.size("t").alias("length"), *[times(w).alias(f"tf{k}") for k, w in enumerate(terms)])


def search(counts: DataFrame, terms: list[str], k: int) -> DataFrame:
    """The k best keys by BM25, from a table of term_counts. Corpus statistics come from the same table, as one row."""
    stats = counts.agg(F.count(F.lit(1)).alias("_n"), F.avg("length").alias("_mean"), *[F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"_df{i}") for i in range(len(terms))])
    hits = counts.where(" OR ".join(f"tf{i} > 0" for i in range(len(terms)))).crossJoin(F.broadcast(stats))
    idf = lambda i: F.log(1 + (F.col("_n") - F.col(f"_df{i}") + 0.5) / (F.col(f"_df{i}") + 0.5))
    tf = lambda i: F.col(f"tf{i}") * (K1 + 1) / (F.col(f"tf{i}") + K1 * (1 - B + B * F.col("length") / F.col("_mean")))
    return top_k(hits.select("key", sum((idf(i) * tf(i) for i in range(len(terms))), F.lit(0.0)).alias("score")), k)


def store(idx: DataFrame, path: str, buckets: int = 64) -> None:
    """CREATE INDEX USING fts: the token table in folders by a hash of the token, sorted, so that a search reads few files and row groups."""
    idx.withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(buckets))).repartition("bucket").sortWithinPartitions("token", "key").write.mode("overwrite").partitionBy("bucket").parquet(path)


def stored(spark, path: str, terms: list[str], buckets: int = 64) -> DataFrame:
    """The rows of the terms in a stored token table; other buckets aren't read."""
    wanted = spark.range(1).select(*[F.pmod(F.xxhash64(F.lit(t)), F.lit(buckets)).alias(f"b{k}") for k, t in enumerate(terms)]).first()
    return spark.read.parquet(path).where(F.col("bucket").isin(sorted({int(b) for b in wanted})) & F.col("token").isin(terms)).drop("bucket")


def top_k(scores: DataFrame, k: int) -> DataFrame:
    return scores.orderBy(F.desc("score"), "key").limit(k)


def highlight(text: Column, query: str, before: str = "<b>", after: str = "</b>") -> Column:
    """fts_highlight: wraps the query's terms."""
    terms = {t.rstrip("*") + (r"[\p{L}\p{N}]*" if t.endswith("*") else "") for _, t in Query(query).terms}
    quoted = "|".join(sorted(terms, key=len, reverse=True))
    return F.regexp_replace(text, rf"(?i)(?<![\p{{L}}\p{{N}}])({quoted})(?![\p{{L}}\p{{N}}])", f"{before}$1{after}")
