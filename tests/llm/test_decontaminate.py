from hypothesis import given, settings, strategies as st

from sparkloom.llm import decontaminate as D


def test_against_plain_loops(spark, data):
    got = {r.doc_id: tuple(r)[:6] for r in D.op6_decontaminate(spark, data).collect()}
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    assert got == {r[0]: r for r in D.brute(docs, items)}


def test_edges_and_blocks(spark, frame, odd):
    items = [(1, "One"), (2, None), (None, "w0"), (3, "!!"), (4, " ".join(f"W{k * 7919 % 1000}" for k in range(20, 45))), (4, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = odd + [(6, "one"), (None, "ONE, two")]
    want = D.brute(rows, [(i, t) for i, t in items if i is not None])
    for states in (1 << 20, 60):  # one automaton, or several
        found = D.decontaminate(frame(rows), bench, states=states).collect()
        assert sorted((r.doc_id or -1, r._n_words, r._n_hit, len(r._items)) for r in found) == sorted((w[0] or -1, *w[1:4]) for w in want)
    spans = {r.doc_id: r._spans for r in found if r._n_hit}
    assert [(s.start, s.end) for s in spans[None]] == [(0, 3)]


def test_empty(spark, frame):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert D.decontaminate(frame([]), bench).count() == 0
    assert D.decontaminate(frame([(1, "a b")]), bench).first()._n_hit == 0


def test_clashing_columns_are_replaced(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", 7, 9)], "doc_id long, text string, _items string, _words int, _n_hit int")
    bench = spark.createDataFrame([(5, "b")], "item_id long, text string")
    found = D.decontaminate(docs, bench)
    assert found.columns == ["doc_id", "text", "_words", "_n_words", "_n_hit", "_spans", "_items"]
    r = found.first()
    assert (r._words, r._n_words, r._n_hit, r._items) == (7, 3, 1, ["5"])


def test_long_texts_and_items(spark, monkeypatch):
    """A text far larger than a piece, and an item larger than a chunk, in a process of its own module settings."""
    words = [f"w{k * 7919 % 30011}" for k in range(30_000)]
    items = [(1, " ".join(words[100:5100])), (2, "w1 w2 w3")]
    text = " ".join([*words, "w1", "w2", "w3"])
    monkeypatch.setattr(D, "CHUNK", 700)
    batches = [D.pa.RecordBatch.from_pydict({"i": [str(i) for i, _ in items], "t": [t for _, t in items]})]
    parts = [r for b in D._chunks(10)(batches) for r in b.to_pylist()]
    assert len(parts) > 5 and max(p["n"] for p in parts) <= 709
    a = D.Automaton([(p["i"], p["t"]) for p in parts], 10)
    data = D.np.frombuffer(text.encode(), D.np.uint8)
    n, _, start, end, _, item = a.judge(data, D.np.array([0, len(data)]))
    want = D.brute([(1, text)], [(2, items[1][1])])[0]
    ranges = D.merged(zip(start.tolist(), end.tolist()))
    assert n.tolist() == [30_003] == [want[1]] and {a.names[k] for k in item} == {"1", "2"}
    assert (100, 5100) in ranges and (30_000, 30_003) in ranges


def test_memory_of_a_large_benchmark():
    """States cost some twenty bytes each, so an automaton of STATES states stays below 200 MB; 16 MB of benchmark text take several."""
    rng = D.np.random.default_rng(5)
    words = [f"w{k}".encode() for k in rng.integers(0, 40_000, 120_000)]
    a = D.Automaton([("1", b" ".join(words))], 10)
    assert a.n > 1_000_000 and a.size() / a.n < 30 and D.STATES * 30 < 200 << 20


@settings(max_examples=60, deadline=None)
@given(st.text("aAb1 .é", max_size=60), st.lists(st.text("aAb1 .é", max_size=20), max_size=4))
def test_scan(text, items):
    named = [(str(i), t.encode()) for i, t in enumerate(items)]
    a = D.Automaton(named, 3)
    raw = text.encode()
    data = D.np.frombuffer(raw + raw, D.np.uint8)
    n, row, start, end, of, _ = a.judge(data, D.np.array([0, len(raw), 2 * len(raw)]))
    for r in range(2):
        ranges = D.merged((s, e) for k, s, e in zip(row.tolist(), start.tolist(), end.tolist()) if k == r)
        hit = sum(b - a for a, b in ranges)
        assert (1, int(n[r]), hit, int((of == r).sum())) == D.brute([(1, text)], list(enumerate(items)), 3)[0][:4]
        spans = D.spans_of(raw, ranges)
        assert sum(len(D.words_of(text[x:y].encode())) for x, y in spans) == hit
