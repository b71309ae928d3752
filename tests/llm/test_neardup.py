import numpy as np

from sparkloom.llm import neardup as N


def test_against_all_pairs(spark, data):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in N.op10_near_duplicates(spark, data).collect()}
    assert got == N.brute(docs)


def test_edges(spark, frame, odd):
    rows = odd + [(20, "ONE"), (21, "a b c"), (22, "A  b\nC"), (23, "a b")]
    got = N.near_duplicates(frame(rows + odd[:2])).collect()
    assert len(got) == len(rows) + 2
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == N.brute(rows)
    assert N.near_duplicates(frame([])).count() == 0


def test_loose_copies(spark, frame):
    """Copies around the threshold: buckets that aren't connected, and chains."""
    rng = np.random.default_rng(1)
    base = [f"t{k}" for k in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for k in rng.choice(120, int(rng.integers(1, 12)), replace=False):
            w[k] = f"e{rng.integers(40)}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(frame(rows)).collect()}
    assert got == N.brute(rows)


def test_components_of_a_chain(spark, tmp_path):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r.node: r.comp for r in N.components(edges, f"file://{tmp_path}/c").collect()}
    assert got == {k: 0 for k in range(1, 41)} | {101: 100}


def test_estimate():
    rng = np.random.default_rng(2)
    both, a, b = (rng.integers(0, 1 << 63, n).astype(np.uint64) * 2 for n in (800, 100, 100))
    x, y = np.concatenate([both, a]), np.concatenate([both, b])
    r = N.registers(np.concatenate([x, y]), np.array([0, len(x)]))
    assert abs(N.estimate(r[:1], r[1:], np.array([900]), np.array([900]))[0] - 0.8) < 0.2
    assert 0 < N.collisions(np.array([900.0]), np.array([900.0]))[0] < 0.01


def test_first_rows(spark, frame, odd):
    """Rows are told apart where ids repeat, and one row of each group is first."""
    a, b = odd[0][1], " ".join(f"other{k}" for k in range(30))
    got = {(r.doc_id, r.h): r.first for r in N.near_duplicates(frame([(3, a), (5, b), (5, a), (None, a), (None, None), (7, "")])).collect()}
    h = {t: r for t, r in frame([(1, a), (2, b), (3, None), (4, "")]).selectExpr("text", "xxhash64(text)").collect()}
    assert got == {(3, h[a]): True, (5, h[b]): True, (5, h[a]): False, (None, h[a]): False, (None, h[None]): True, (7, h[""]): True}
    ids = {r.doc_id: r.component_id for r in N.near_duplicates(frame([(None, a), (None, a + " x")])).collect()}
    assert ids == {None: None}


def test_hot_keys_are_dealt(spark, tmp_path):
    """A class, a bucket and a star with most of all rows: the same rows come out, and no key is one task."""
    left = spark.range(20_000).selectExpr("id", "if(id % 3 = 0, id, -1) AS k")
    right = left.groupBy("k").count().selectExpr("k", "k * 2 AS v", "count AS n")
    hot = N.hot_keys(right, "k", "n", 20_000)
    assert hot == [-1]
    found = N.join_salted(left, right.drop("n"), ["k"], hot, N.F.col("id"))
    assert found.columns == ["id", "k", "v"] and found.where("v = 2 * k").count() == 20_000
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        most = found.groupBy(N.F.spark_partition_id()).count().agg({"count": "max"}).first()[0]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert most < 10_000  # of 13,334 rows with one key
    part = right.where("k > 100").drop("n")
    assert N.join_salted(left, part, ["k"], hot, N.F.col("id")).count() == left.where("k > 100").count()
    assert N.join_salted(left, part, ["k"], hot, N.F.col("id"), "left").count() == 20_000
    edges = spark.range(1, 2000).selectExpr("id AS a", "0L AS b")
    assert N.components(edges, f"file://{tmp_path}/c").where("comp = 0").count() == 1999


def test_recall_of_bands():
    """Pairs at the threshold share a band, as the formula has it: one in 190,000 is missed."""
    rng = np.random.default_rng(4)
    missed = 0
    for _ in range(40):
        x = rng.integers(0, 1 << 63, (50, 115)).astype(np.uint64) * 2 + 1
        a, b = np.ascontiguousarray(x[:, :105]), np.concatenate([x[:, :90], x[:, 100:]], 1)  # 90 of 120 in both
        starts = np.arange(0, a.size, 105)
        r, s = (N.registers(y.reshape(-1), starts).reshape(50, -1, N.ROWS) for y in (a, b))
        missed += int((~(r == s).all(2).any(1)).sum())
    assert missed == 0
    assert (1 - 0.75**N.ROWS) ** (N.REGISTERS // N.ROWS) < 1 / 180_000


def test_sets_are_told_apart_by_two_families():
    data = np.frombuffer(b"a b c d e f", np.uint8)
    x, y = (N.shingle_hashes(data, np.array([0, len(data)]), other=o)[0] for o in (False, True))
    assert len(x) == 2 and not set(x.tolist()) & set(y.tolist())


def test_very_long_texts(spark, frame):
    rng = np.random.default_rng(6)
    words = [f"w{k}" for k in rng.integers(0, 50_000, 150_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:140_000])), (3, " ".join(words[:20_000])), (4, "x" * 500_000), (5, "la " * 100_000), (6, "la " * 99_000), (7, " " * 200_000)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(frame(rows)).collect()}
    assert got == N.brute(rows) and got[2][1] == 1 and got[6][1] == 5
