import pytest


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    """Writes a folder of Parquet tables."""

    def make(**frames):
        top = tmp_path_factory.mktemp("tables")
        for name, df in frames.items():
            df.write.parquet(f"{top}/{name}.parquet")
        return str(top)

    return make


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and very long texts, ties and repeated rows."""
    w = [f"w{k * 7919 % 1000}" for k in range(3000)]
    base = " ".join(w[:60])
    rows = [
        (1, base), (2, base), (3, None), (4, ""), (5, " \t\n"), (6, "one"), (7, " ".join(w[:60] + ["tail"])), (8, " ".join(w)), (9, " ".join(w[500:]) + " end"),
        (10, "en " * 500), (11, "en " * 300 + "x"), (12, "Ünïcödé ßtraße " * 12), (13, " ".join(w[100:140])), (14, " ".join(w[:59])), (15, " ".join(w[:30] + ["q"] + w[31:60])), (16, "x" * 70000),
    ]
    return rows


@pytest.fixture(scope="session")
def frame(spark):
    def make(rows, extra=True):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        return df.selectExpr("*", "'s' AS source", "1 AS node", "2 AS tid", "3 AS _size") if extra else df

    return make
