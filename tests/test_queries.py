"""Every query with an oracle gives DuckDB's rows on the smallest tables."""

import glob
import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from sparkloom.plans import registry

NAMES = sorted(registry.oracle_sql())


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return repr(v)
    if isinstance(v, (int, float, Decimal)):
        f = float(v)
        return "nan" if math.isnan(f) else str(int(v)) if f == int(f) and abs(f) < 1e15 else f"{f:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


@pytest.mark.parametrize("name", NAMES)
def test_rows_are_the_oracles(name, spark, data, duck):
    df = registry.queries()[name](spark, data)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = duck.execute(registry.oracle_sql()[name])
    have = [d[0] for d in result.description]
    assert sorted(have) == columns
    want = sorted(tuple(plain(r[have.index(c)]) for c in columns) for r in result.fetchall())
    assert got == want


def test_filters_and_columns_reach_the_scan(spark, data):
    plan = registry.queries()["tpch_q6"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_discount)" in plan or "PushedFilters: [IsNotNull(" in plan
    assert "l_orderkey" not in plan


def test_names_are_registered_once():
    with pytest.raises(ValueError):
        registry.register(NAMES[0])(lambda spark, sf_dir: None)


def test_translit_covers_every_language(spark, tmp_path):
    rows = [(1, "Größe Äpfel", "de"), (2, "el niño", "es"), (3, "déjà vu", "fr"), (4, "plain", "en"), (5, "Ærø ærø", None), (6, None, "de")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.t for r in registry.queries()["fn_translit"](spark, str(tmp_path)).collect()}
    assert got == {1: "Grosse Apfel", 2: "el nino", 3: "deja vu", 4: "plain", 5: "Æro aero", 6: None}


def test_two_hops_start_at_every_customer(spark, data):
    got = [tuple(r) for r in registry.queries()["graph_two_hops"](spark, data).select("x", "y").collect()]
    orders, lines = (spark.read.parquet(f"{data}/{t}.parquet").collect() for t in ("orders", "lineitem"))
    suppliers, customer = {}, {r.o_orderkey: r.o_custkey for r in orders}
    for r in lines:
        suppliers.setdefault(r.l_partkey, set()).add(r.l_suppkey)
    want = {(customer[r.l_orderkey], y) for r in lines if r.l_orderkey in customer for y in suppliers[r.l_partkey]}
    assert len(got) == len(want) and set(got) == want and max(x for x, _ in got) >= 10


def test_the_approximate_count_is_called(spark, data):
    df = registry.queries()["agg_approx_count_distinct"](spark, data)
    assert "approx_count_distinct" in df._jdf.queryExecution().optimizedPlan().toString()
    row = df.first()
    assert row.near and row.n == spark.read.parquet(f"{data}/lineitem.parquet").select("l_partkey").distinct().count()


def test_array_edit_covers_every_nation(spark, data):
    nations = {r.n_nationkey: r.n_regionkey for r in spark.read.parquet(f"{data}/nation.parquet").collect()}
    got = {r.n_nationkey: r.r for r in registry.queries()["fn_array_edit"](spark, data).collect()}
    assert got == {k: ",".join(str(x) for x in (k, v, 3) if x != k) for k, v in nations.items()} and len(got) == 25
