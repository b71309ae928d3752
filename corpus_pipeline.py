"""The corpus pipeline: quality filter, near-duplicates, decontamination, mixing, token records.

Every stage takes (spark, docs, sf_dir), reads all of ``docs`` and returns a DataFrame.
All but the last return the columns of ``documents``; each stage's result is written as
Parquet and read again as the next one's ``docs``.

All stages stand null and empty texts, null ids, repeated rows, texts of any length, empty
tables and extra columns of any name, which they pass through (the last one reads doc_id and
text alone). What becomes of each is said at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkloom.llm import common, decontaminate as clean, mixing, neardup, quality as classifier, tokens

#: Documents are rejected below this score. Where the classes are this uneven, 0.5 is the
#: calibrated point at which a document is as likely bad as good.
LEAST_SCORE = 0.5
#: SQL can't express compression, MinHash or tokenizers; tests compare run() with plain loops.
ORACLE_SQL = None


def apart(docs: DataFrame) -> tuple[DataFrame, list]:
    """``docs`` with names of extra columns that no operator uses, and what selects the old names again."""
    names = {c: c if c in ("doc_id", "text", "source") else f"extra{k}" for k, c in enumerate(docs.columns)}
    return docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), [F.col(n).alias(c) for c, n in names.items()]


def merged(docs: DataFrame) -> DataFrame:
    """``docs`` in partitions of some 48 MB, or as many as there are cores: a stage's files are as few as its input's size asks for."""
    spark = docs.sparkSession
    return docs.coalesce(common.partitions_for(spark, common.input_bytes(docs), 48 << 20))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the compression classifier doesn't reject. It learns from labelled documents of this stage's input.

    Null and empty texts get the score that calibration gives no evidence; repeated rows
    are judged alike; an empty table stays empty.
    """
    docs, back = apart(docs)
    model = classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classifier.score_quality(merged(docs), model).where(F.col("_score") >= LEAST_SCORE).select(*back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates: the least by doc_id (null last), then by hash of the text.

    Rows are judged by what they hold, so that of two rows with one id only the copy goes.
    Of rows that agree in id and text that with the least hash of all columns stays, once.
    Texts without words (null ones too) are no one's near-duplicates. An empty table stays empty.
    """
    docs, back = apart(docs)
    found = neardup.near_duplicates(docs)
    key = [F.col("doc_id").isNull().alias("_u"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_d")]
    chosen = found.where("first").select(*key, F.col("h").alias("_h")).distinct()
    keyed = docs.select("*", *key, F.xxhash64("text").alias("_h"), F.xxhash64(*docs.columns).alias("_x"))
    light = keyed.groupBy("_u", "_d", "_h", "_x").agg(F.count(F.lit(1)).alias("_n"))
    light = light.groupBy("_u", "_d", "_h").agg(F.min(F.struct("_x", "_n")).alias("_m")).select("_u", "_d", "_h", "_m._x", "_m._n")
    rows = keyed.join(chosen.join(light, ["_u", "_d", "_h"]), ["_u", "_d", "_h", "_x"])
    once = rows.where("_n = 1").select(*back)
    kept = once.unionAll(rows.where("_n > 1").select(*back).dropDuplicates())
    return kept.coalesce(common.partitions_for(spark, common.input_bytes(docs), 48 << 20))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark.

    Null and empty texts hold none; repeated rows are judged alike; an empty table stays empty.
    """
    docs, back = apart(docs)
    marked = clean.decontaminate(merged(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return marked.where("_n_hit = 0").select(*back)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats, keeps or leaves out documents as their source's target asks, in the order of their training positions.

    A document that the mix takes p times is p rows. One that it takes in part counts
    as a whole row. A document that it leaves out goes, as do those without words (null
    texts too). Null sources are a source of their own. Repeated rows count one by one;
    an empty table stays empty.
    """
    docs, back = apart(docs)
    sized = docs.select("*", mixing.words("text").alias("_size"))
    placed = mixing.mix_sources(sized, "_size", key=F.xxhash64("doc_id", "text"))
    return placed.select("*", F.explode("_positions").alias("_at")).orderBy("_at", "doc_id").select(*back)


def token_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes all rows as token records and returns what the files hold, in ascending doc_id order (null first).

    Null and empty texts are the end id alone; repeated rows are records of their own; an
    empty table gives none.
    """
    return tokens.token_records(docs)


STAGES = [
    ("quality classifier", quality),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("token records", token_records),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, writing each result to the shared folder."""
    out = common.work_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.keep(docs, f"{out}/{k}")
    return docs
