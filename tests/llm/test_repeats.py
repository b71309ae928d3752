import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from sparkloom.llm import fmindex, induced, repeats
from sparkloom.llm.repeats import Kind


def test_words_against_a_table_of_windows(spark, data):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in fmindex.op8_substring_dedup(spark, data).collect()}
    assert got == fmindex.brute(docs)


def test_bytes_against_a_table_of_windows(spark, data):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in induced.op9_suffix_dedup(spark, data).collect()}
    assert got == induced.brute(docs)


@pytest.mark.parametrize("hot", [20_000, 1])
def test_edges(spark, frame, odd, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", hot)
    for module, call, names in ((fmindex, fmindex.substring_dedup, ("n_units", "n_removed", "kept_sha256")), (induced, induced.suffix_dedup, ("n_units", "n_removed", "n_spans", "kept_sha256"))):
        want = module.brute(odd)
        got = call(frame(odd + odd[:3])).collect()  # repeated rows get equal results
        assert len(got) == len(odd) + 3
        assert {r.doc_id: tuple(r[c] for c in names) for r in got} == want


def test_empty_and_text(spark, frame):
    assert fmindex.substring_dedup(frame([])).count() == 0
    a = " ".join(f"a{k}" for k in range(25))
    rows = {r.doc_id: r for r in fmindex.substring_dedup(frame([(1, a), (2, "x " + a + " y")]), with_text=True).collect()}
    assert rows[2].kept_text == "x y" and rows[2].spans == [1, 25] and rows[1].n_removed == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "c"]), min_size=4, max_size=30), min_size=1, max_size=5))
def test_fm_index_shard(texts):
    contents = [" ".join(t).encode() for t in texts]
    d = np.arange(len(texts))
    got = fmindex.decide(contents, d, np.zeros(len(texts), np.int64), Kind("word", 4, 2, True))
    seen = set()
    for t, flags in zip(texts, got):
        for i in range(len(t) - 3):
            w = tuple(t[i : i + 4])
            assert flags[i] == (w in seen)
            seen.add(w)


def test_fm_index_is_compressed_and_decides():
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in rng.integers(0, 2000, 60_000)]
    words[40_000:45_000] = words[1000:6000]
    contents = [" ".join(words[k : k + 500]).encode() for k in range(0, 60_000, 500)]
    place = np.arange(60_000)
    text = np.append(rng.integers(1, 2000, 60_000), 0)
    index = fmindex.FMIndex(text, 20, np.append(place, 1 << 62))
    assert index.nbytes() < 3.2 * len(text)  # eleven bits of wavelet, a bit of grouping, their ranks, and two integers a word
    got = np.concatenate(fmindex.decide(contents, np.arange(len(contents)), np.zeros(len(contents), np.int64), Kind("word", 20, 5, True)))
    seen, want = set(), []
    for c in contents:
        w = c.split()
        for i in range(len(w) - 19):
            want.append(tuple(w[i : i + 20]) in seen)
            seen.add(tuple(w[i : i + 20]))
    assert got.tolist() == want and sum(want) > 4000


@settings(max_examples=60, deadline=None)
@given(st.lists(st.booleans(), min_size=1, max_size=400))
def test_bits(flags):
    b = np.array(flags)
    bits, at = fmindex.Bits(b), np.flatnonzero(b)
    assert bits.rank(np.arange(len(b) + 1)).tolist() == np.concatenate([[0], np.cumsum(b)]).tolist()
    assert bits.select(np.arange(len(at))).tolist() == at.tolist()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=120), st.integers(1, 40), st.booleans())
def test_reduced_sorting(symbols, width, spill):
    text = np.array([*symbols, 0])
    was, induced.RANGE = induced.RANGE, width
    try:
        order = induced.reduced_sort(text, 50, 40 if spill else 1 << 20, "file:///tmp" if spill else None)
    finally:
        induced.RANGE = was
    keys = [tuple(text[i : i + 50].tolist()) for i in order]
    assert sorted(order.tolist()) == list(range(len(text))) and keys == sorted(keys)


def test_recursion_and_spilling(tmp_path, monkeypatch):
    """A shard far larger than its queue's memory: tuples of every level go through files, and names are sorted recursively."""
    levels, spills = set(), []
    was_sort, was_spill = induced.reduced_sort, induced.Lanes._spill
    monkeypatch.setattr(induced, "reduced_sort", lambda t, d, q, s, level=1: levels.add(level) or was_sort(t, d, q, s, level))
    monkeypatch.setattr(induced.Lanes, "_spill", lambda self: spills.append(self.size) or was_spill(self))
    monkeypatch.setattr(induced, "RANGE", 500)
    rng = np.random.default_rng(9)
    some = rng.integers(97, 101, 30_000).astype(np.uint8).tobytes()
    contents = [some[k : k + 3000] for k in range(0, 27_000, 2500)] + [b"ab" * 2000, b"x" * 3000]
    got = induced.decide(contents, np.arange(len(contents)), np.zeros(len(contents), np.int64), Kind("byte", 50, 20, False), 4096, f"file://{tmp_path}")
    seen: dict = {}
    for k, (c, flags) in enumerate(zip(contents, got)):
        assert flags.tolist() == [seen.get(c[i : i + 50], k) < k for i in range(len(c) - 49)]
        for i in range(len(c) - 49):
            seen.setdefault(c[i : i + 50], k)
    assert len(levels) > 1 and len(spills) > 10 and not list(tmp_path.iterdir())


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=80), st.booleans())
def test_induced_sorting(symbols, spill):
    text = np.array([*symbols, 0], np.uint8)
    order, common = induced.suffix_sort(text, 50, 40 if spill else 1 << 20, "file:///tmp" if spill else None)
    keys = [tuple(text[i : i + 50].tolist()) for i in order]
    assert sorted(order.tolist()) == list(range(len(text))) and keys == sorted(keys)
    for a, b, n in zip(keys, keys[1:], common[1:].tolist()):
        assert n == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([1, 200, 255]), st.integers(1, 25)), min_size=40, max_size=60))
def test_runs_of_many_lengths(runs):
    """Substrings between leftmost S positions that begin alike, and end in different rounds of naming."""
    text = np.append(np.repeat(*np.array(runs).T), 0).astype(np.uint8)
    order, common = induced.suffix_sort(text, 50)
    keys = [tuple(text[i : i + 50].tolist()) for i in order]
    assert sorted(order.tolist()) == list(range(len(text))) and keys == sorted(keys)
    reduced = induced.reduced_sort(text.astype(np.int64) * 300, 50, 1 << 20, None)
    assert [tuple(text[i : i + 50].tolist()) for i in reduced] == keys


def test_rules_and_blanks_of_many_lengths(spark, frame):
    """Lines of one character and indents, whose lengths differ, beside passages that documents share."""
    rng = np.random.default_rng(4)
    part = lambda: [chr(rng.integers(97, 100)) * int(rng.integers(1, 70)), " " * int(rng.integers(1, 30)), "zyxwvutsrqponmlkji"[: rng.integers(1, 18)], "".join(map(chr, rng.integers(97, 123, 12)))][rng.integers(0, 4)]
    shared = ["".join(part() for _ in range(12)) for _ in range(20)]
    rows = [(d, "".join(shared[rng.integers(0, 20)] if rng.random() < 0.3 else part() for _ in range(25))) for d in range(60)]
    got = {r.doc_id: (r.n_units, r.n_removed, r.n_spans, r.kept_sha256) for r in induced.suffix_dedup(frame(rows)).collect()}
    assert got == induced.brute(rows)


def test_long_texts_are_cut_into_pieces(monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 64)
    monkeypatch.setattr(repeats, "LONGEST", 16)
    data = np.frombuffer(b"abc" * 100 + bytes(range(97, 122)) * 8, np.uint8)
    u = repeats.Units(Kind("byte", 20, 16, False), data, np.array([0, len(data)]))
    got = sorted((int(s), int(n)) for _, starts, n, _, _ in u.segments() for s, n in zip(starts, n))
    assert got[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(got, got[1:])) and sum(got[-1]) == len(data) - 19


def test_shards_spill_their_queues(spark, frame, odd, tmp_path, monkeypatch):
    folder = tmp_path / "spill"
    monkeypatch.setattr(induced, "work_dir", lambda spark: f"file://{folder}")
    call = lambda: {r.doc_id: (r.n_units, r.n_removed, r.n_spans, r.kept_sha256) for r in induced.suffix_dedup(frame(odd), queue_bytes=40).collect()}
    with pytest.raises(Exception, match="lanes-"):  # the folder isn't there yet: shards do write to it
        call()
    folder.mkdir()
    assert call() == induced.brute(odd)
    assert not list(folder.iterdir())  # what was spilled is deleted when read


def test_a_key_is_hot_by_its_segments(spark, frame, monkeypatch):
    """One gram that comes up many times in two texts, before ever new text."""
    monkeypatch.setattr(repeats, "HOT", 50)
    rng, kind = np.random.default_rng(5), Kind("byte", 50, 20, False)
    some = rng.integers(97, 123, (500, 20)).astype(np.uint8)
    hashes = [repeats.Units(kind, x, np.array([0, 20])).grams(0, 1)[0] for x in some]
    gram = some[np.argmin(hashes)].tobytes().decode()  # of so low a hash that windows have it for their key
    rows = [(d, "".join(gram + "".join(map(chr, rng.integers(97, 123, 40))) for _ in range(100))) for d in (1, 2)]
    docs = frame(rows).selectExpr("doc_id", "doc_id AS d", "doc_id AS tid", "text")
    assert all(r.hot for r in repeats._wanted(docs, kind).collect())
    got = {r.doc_id: (r.n_units, r.n_removed, r.n_spans, r.kept_sha256) for r in induced.suffix_dedup(frame(rows)).collect()}
    assert got == induced.brute(rows)
    # a run of one gram is long segments: it counts by its windows
    docs = frame([(1, "x" * 5000), (2, "x" * 5000 + "y")]).selectExpr("doc_id", "doc_id AS d", "doc_id AS tid", "text")
    assert all(r.hot for r in repeats._wanted(docs, kind).collect())


def test_windows_of_a_hot_key_are_one_row_a_text(spark, frame, monkeypatch):
    """Periodic lines of many lengths: the few different windows of each text are joined, not each place of them."""
    monkeypatch.setattr(repeats, "HOT", 50)
    rows = [(d, f"w{d} " * (d % 3) + "la li lu " * (300 + 7 * d) + f"end {d}") for d in range(30)]
    for module, call, names, kind in (
        (fmindex, fmindex.substring_dedup, ("n_units", "n_removed", "kept_sha256"), Kind("word", 20, 5, True)),
        (induced, induced.suffix_dedup, ("n_units", "n_removed", "n_spans", "kept_sha256"), Kind("byte", 50, 20, False)),
    ):
        docs = frame(rows).selectExpr("doc_id", "doc_id AS d", "doc_id AS tid", "text")
        made = docs.select("tid", "d", "text").join(repeats._wanted(docs, kind), "tid").mapInArrow(repeats._instances(kind), repeats._INSTANCES).where("n = 1")
        places = made.selectExpr("count(*) AS n", "sum(1 + size(more)) AS places").first()
        assert places.places > 30 * 800 and places.n < 30 * 40
        got = {r.doc_id: tuple(r[c] for c in names) for r in call(frame(rows)).collect()}
        assert got == module.brute(rows)


def test_texts_with_one_hash_are_told_apart(spark, frame, odd, monkeypatch):
    """A hash that all texts share: a second one keeps them apart."""
    rows = odd + odd[:2]
    light = frame(rows).selectExpr("doc_id AS d", "cast(length(text) % 2 AS long) AS h", "xxhash64(7, text) AS g")
    tid = repeats._identity(light)
    names = {(r.h, r.g): r.t for r in light.select("h", "g", tid.alias("t")).collect()}
    assert len(set(names.values())) == len(names) > 3
    apart = frame([(1, "a"), (2, "b")]).selectExpr("doc_id AS d", "xxhash64(text) AS h", "xxhash64(7, text) AS g")
    assert apart.where(repeats._identity(apart) == repeats.F.col("h")).count() == 2


def test_many_copies_of_one_text(spark, frame):
    """Copies beyond a thousandth of all rows: none of their texts but the first goes on."""
    text = " ".join(f"c{k}" for k in range(40))
    rows = [(k, text) for k in range(300)] + [(1000 + k, "") for k in range(300)] + [(2000, "x " + text), (2001, "short")]
    for module, call, names in ((fmindex, fmindex.substring_dedup, ("n_units", "n_removed", "kept_sha256")), (induced, induced.suffix_dedup, ("n_units", "n_removed", "n_spans", "kept_sha256"))):
        got = {r.doc_id: tuple(r[c] for c in names) for r in call(frame(rows)).collect()}
        assert got == module.brute(rows)


def test_very_long_texts(spark, frame):
    """Texts of a megabyte: a shared half, one word or byte many times, and white space alone."""
    rng = np.random.default_rng(6)
    words = [f"w{k}" for k in rng.integers(0, 50_000, 150_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:50_000] + ["new"] + words[90_000:])), (3, "x" * 400_000), (4, "x" * 100_000 + "y"), (5, "la " * 100_000), (6, " " * 200_000)]
    for module, call, names in ((fmindex, fmindex.substring_dedup, ("n_units", "n_removed", "kept_sha256")), (induced, induced.suffix_dedup, ("n_units", "n_removed", "n_spans", "kept_sha256"))):
        got = {r.doc_id: tuple(r[c] for c in names) for r in call(frame(rows)).collect()}
        assert got == module.brute(rows)


def test_no_table_is_left_behind(spark, frame):
    def fail(*_):
        raise RuntimeError("a shard fails")

    text = " ".join(f"w{k}" for k in range(60))
    with pytest.raises(Exception, match="a shard fails"):
        repeats.without_repeats(frame([(1, text + " a"), (2, text + " b")]), Kind("word", 20, 5, True), fail).collect()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("sparkloom_")]
