"""Compression classifier: dictionaries of good and bad text; the difference of compressed sizes becomes a calibrated score."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import settled, ship, slice_texts, utf8

#: Labelled rows of each class that a fit looks at, at most, and their bytes on average; a fit sees fewer rows where these are longer, all of them whole.
SAMPLE_ROWS, SAMPLE_BYTES = 2000, 16 << 10
#: Bytes of a dictionary.
DICTIONARY = 96 << 10
#: A text is compressed in pieces of so many bytes, so that dictionaries count all along it.
PIECE = 2 << 10
LEVEL = 3


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    base: float


def _dictionary(texts: list[bytes]) -> bytes:
    import zstandard as z

    pieces = [t[k : k + PIECE] for t in texts for k in range(0, len(t), PIECE)]
    try:
        return z.train_dictionary(DICTIONARY, pieces).as_bytes()
    except z.ZstdError:  # too few samples: their end is the dictionary
        return b"\n".join(pieces)[-DICTIONARY:]


class Scorer:
    def __init__(self, model: Model):
        import zstandard as z

        self.model = model
        dictionaries = [z.ZstdCompressionDict(d) if d else None for d in (model.good, model.bad)]
        for d in dictionaries:
            if d:
                d.precompute_compress(level=LEVEL)
        options = {"write_content_size": False, "write_dict_id": False, "write_checksum": False}
        self.good, self.bad = (z.ZstdCompressor(level=LEVEL, dict_data=d, **options).compress for d in dictionaries)

    def features(self, text: bytes) -> tuple[float, float]:
        """The normalised difference of compressed sizes, and the size by the good dictionary against the text's own."""
        g = b = 0
        for k in range(0, len(text), PIECE):
            part = text[k : k + PIECE]
            g += len(self.good(part))
            b += len(self.bad(part))
        return ((b - g) / (b + g), g / len(text)) if text else (0.0, 0.5)

    def score(self, text: bytes) -> float:
        if not self.model.weights:
            return self.model.base
        a, (x, y) = self.model.weights, self.features(text)
        z = a[0] + a[1] * x + a[2] * y + a[3] * y * y
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        g = x.T @ (weight * (p - y)) + ridge * w
        h = (x.T * (weight * np.maximum(p * (1 - p), 1e-6))) @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows that no fit may look at."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 3 == 1, F.lit(False))


def _whole_rows(lengths: list[tuple], budget: int) -> list[tuple]:
    """Of (label, hash, id, text's hash, bytes), by class the first in order of hash that fit the budget, and 8 that aren't empty in any case."""
    out = []
    for y in (True, False):
        size = some = 0
        for r in sorted(r for r in lengths if r[0] == y):
            if some >= 8 and size + r[4] > budget:
                break
            size, some = size + r[4], some + (r[4] > 0)
            out.append(r)
    return out


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits on at most ``sample_rows`` labelled documents of each class, those of least hash, which aren't held out.

    Their texts are read whole, SAMPLE_BYTES each on average: longer ones make for fewer
    rows. Rows with one id count as one, the one whose text has the least hash.
    One half of them makes the dictionaries, the other the calibration. Contradicting
    labels count as their mean. Without documents of both classes every score is the
    share of good ones (0.5 without any).
    """
    # internal names stand beside none of the table's own: only what is named here is read
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id)).groupBy(F.col(doc_id).alias("_d"))
    known = known.agg((F.avg(label) >= 0.5).alias("_y"))
    counts = {r._y: r["count"] for r in known.groupBy("_y").count().collect()}
    total = sum(counts.values())
    base = counts.get(True, 0) / total if total else 0.5
    if len(counts) < 2:
        return Model(b"", b"", (), base)
    order = F.xxhash64(F.lit("sample"), "_d")
    some = known.where("_y").orderBy(order, "_d").limit(sample_rows).unionAll(known.where("not _y").orderBy(order, "_d").limit(sample_rows))
    texts = docs.select(F.col(doc_id).alias("_d"), F.coalesce(text, F.lit("")).alias("t")).withColumn("x", F.xxhash64("t"))
    found = texts.join(F.broadcast(some), "_d").groupBy("_d", "_y").agg(F.min(F.struct("x", F.octet_length("t").alias("n"))).alias("m"))
    lengths = [tuple(r) for r in found.select("_y", order, "_d", "m.x", "m.n").collect()]  # one small row for each labelled row of the sample
    chosen = docs.sparkSession.createDataFrame(_whole_rows(lengths, sample_rows * SAMPLE_BYTES), T.StructType([T.StructField("_y", T.BooleanType()), T.StructField("h", T.LongType()), found.schema["_d"], T.StructField("x", T.LongType()), T.StructField("n", T.LongType())]))
    found = texts.join(F.broadcast(chosen), ["_d", "x"]).dropDuplicates(["_d"]).select("_y", "h", "t")
    rows = sorted(((r._y, r.h, r.t.encode()) for r in found.collect()), key=lambda r: r[1:])
    half = {y: [t for v, _, t in rows if v == y and t] for y in (True, False)}
    if min(map(len, half.values())) < 4:
        return Model(b"", b"", (), base)
    model = Model(_dictionary(half[True][::2]), _dictionary(half[False][::2]), (), base)
    scorer, x, y = Scorer(model), [], []
    for v in (True, False):
        for t in half[v][1::2]:
            d, r = scorer.features(t)
            x.append((1.0, d, r, r * r))
            y.append(float(v))
    y = np.array(y)
    share = np.where(y > 0, base / max(y.sum(), 1), (1 - base) / max(len(y) - y.sum(), 1)) * len(y)  # the classes in their true shares
    model.weights = tuple(_logistic(np.array(x), y, share).tolist())
    return model


def score_quality(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds _score (0 to 1; higher: good likelier) for every whole text; an older column of that name is replaced.

    Null and empty texts get the score that the calibration gives no evidence. Rows are
    judged one by one, so repeated rows agree; other columns pass through; an empty table
    stays empty.
    """
    spark = ship(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)  # two dictionaries of bounded size
    rest = docs.drop("_score")

    def run(batches):
        s = Scorer(sent.value)
        for b in batches:
            scores = [s.score(t) for t in slice_texts(*utf8(b.column(text)))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], [*b.schema.names, "_score"])

    return rest.mapInArrow(settled(run), T.StructType([*rest.schema.fields, T.StructField("_score", T.DoubleType())]))


def op5_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, model).select("doc_id", held_out().alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))
