"""Operators that treat documents one by one, and the pipeline."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

import corpus_pipeline
from sparkloom.llm import fuzzyhash as H, mixing as M, pseudonyms as P, quality as Q, tokens as K, warc
from sparkloom.llm.crc32c import crc32c


def test_crc32c():
    assert crc32c([b"123456789"])[0] == 0xE3069283
    parts = [b"", b"a" * 511, b"b" * 512, bytes(range(256)) * 9, b"123456789"]
    assert crc32c(parts).tolist() == [crc32c([p])[0] for p in parts]


def test_fingerprints_against_a_loop(spark, frame, odd):
    rows = [(d, t) for d, t in odd if d is not None]
    got = {r.doc_id: tuple(r)[1:] for r in H.compare_with_next(frame(rows)).collect()}
    assert got == H.brute(rows)
    assert H.compare_with_next(frame([])).count() == 0
    one = H.compare_with_next(frame([(1, "abcdef")])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and one.near_next == 1.0


def test_fingerprints_find_edits():
    rng = np.random.default_rng(3)
    text = " ".join("".join(map(chr, rng.integers(97, 123, 6))) for _ in range(400))
    other = " ".join("".join(map(chr, rng.integers(97, 123, 6))) for _ in range(400))
    f = lambda t: H.fingerprint(t.encode())
    assert H.likeness(f(text), f(H.edited(text, other))) > 0.5 > 0.2 > H.likeness(f(text), f(other))
    assert H.likeness("0::", "0::") == 1.0 and H.likeness("0::", f(text)) == 0.0


@settings(max_examples=30, deadline=None)
@given(st.text(max_size=300))
def test_fingerprints_in_steps(text):
    was = H.STEP
    whole = H.fingerprint(text.encode())
    H.STEP = 16
    try:
        assert H.fingerprint(text.encode()) == whole
    finally:
        H.STEP = was


def test_mixing(spark, frame):
    rows = [(k, " ".join(["w"] * (1 + k % 9)), f"s{k % 5}" if k % 7 else None) for k in range(300)] + [(1000, None, "s0"), (1001, "", "empty"), (5, "w w w w w w", "s0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("rank", M.F.lit(1))
    sized = df.withColumn("n", M.words("text"))
    out = M.mix_sources(sized, "n").toPandas()
    assert len(out) == len(rows)
    by = out.groupby(out.source.fillna("~")).agg(size=("n", "sum"), target=("_target", "first"), taken=("_taken", "sum"))
    total = by["size"].sum()
    assert abs(by.target.sum() - total) < 1e-6 and (by.target <= 3 * by["size"] + 1e-9).all()
    assert ((by.taken - by.target).abs() <= 1).all() and (out._taken <= 3 * out.n).all()
    assert all(len(p) == -(-t // n) if n else not len(p) for p, t, n in zip(out._positions, out._taken, out.n))
    assert M.mix_sources(sized, "n").toPandas().sort_values(["doc_id", "text"])._taken.tolist() == out.sort_values(["doc_id", "text"])._taken.tolist()
    assert M.mix_sources(sized.limit(0), "n").count() == 0


def test_schedules(spark):
    for knots in M.SCHEDULES:
        t = [r[0] for r in spark.range(101).select(M.time_of(M.F.col("id") / 100.0, knots)).collect()]
        area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))
        for k, x in enumerate(t):
            done = sum((min(x, b[0]) - a[0]) * (2 * a[1] + (b[1] - a[1]) * (min(x, b[0]) - a[0]) / (b[0] - a[0])) / 2 for a, b in zip(knots, knots[1:]) if x > a[0]) / area
            assert abs(done - k / 100) < 1e-9
    with pytest.raises(ValueError):
        M.time_of(M.F.lit(0.5), ((0.0, 0.0), (1.0, 0.0)))


def test_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    got = Q.op5_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.97
    good = got[got.quality == 1]
    assert (good.predicted == 1).mean() > 0.99


def test_quality_edges(spark, frame, odd):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    model = Q.fit(frame(odd), labels)
    out = Q.score_quality(frame(odd), model).collect()
    assert len(out) == len(odd) and all(0 <= r._score <= 1 for r in out)
    assert Q.score_quality(frame([]), model).count() == 0
    assert Q.fit(frame([]), labels.limit(0)).base == 0.5


def test_tokens_round_trip(spark, frame, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = odd + [(None, "null id"), (1, odd[0][1]), (30, "don't I'M x's!! «la», H̱a \x01 a\x01b ½Ⅷ")]
    got = sorted((tuple(r) for r in K.token_records(frame(rows)).collect()), key=lambda r: r[1])
    start, want = 0, []
    for d, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert K.token_records(frame([])).count() == 0


def test_equal_ids_have_a_defined_order(spark, frame):
    rows = [(1, f"text {k}") for k in range(40)] + [(None, "b"), (None, "a"), (0, "z")]
    df = frame(rows)
    order = {(r.doc_id, r.text): r.h for r in df.select("doc_id", "text", M.F.xxhash64("text").alias("h")).collect()}
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = [zlib.crc32(np.array(t.encode(x, add_special_tokens=False).ids + [1], "<u4").tobytes()) for d, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, order[r]))]
    got = sorted((tuple(r) for r in K.token_records(df.repartition(7)).collect()), key=lambda r: r[1])
    assert [r[3] for r in got] == want


def test_plain_words_agree_with_the_library():
    """All letters that go the short way, alone, in pairs, in both cases and before punctuation."""
    import public_tokenizers

    e = K.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    letters = [c for c in map(chr, range(0x130)) if c.isalpha()]
    words = [*letters, *(a + b for a in letters for b in letters), *(f"x{a}{p}" for a in letters for p in (",", ".!", "*:", "$%&#", "?;"))]
    for k in range(0, len(words), 500):
        text = " ".join(words[k : k + 500])
        want = e.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(e.encode([text.encode()])[0], "<u2").tolist() == want


def test_remembered_words_stay_in_their_bound(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(K, "CACHE_BYTES", 10_000)
    e = K.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    for k in range(30):
        texts = [f"w{k * 100 + i} hello".encode() for i in range(100)]
        got = e.encode(texts)
        assert np.frombuffer(got[7], "<u2").tolist() == e.tokenizer.encode(texts[7].decode(), add_special_tokens=False).ids
        assert e.words.nbytes + e.flat.nbytes + e.n.nbytes < 20_000


def test_frames_are_checked():
    made = K.frames([b"abc", b"", b"x" * 1000])
    data, offsets = b"".join(made), [0, len(made[0]), len(made[0]) + len(made[1])]
    assert K.read_frames(data, [offsets[2], offsets[0], offsets[1]]) == [b"x" * 1000, b"abc", b""]
    with pytest.raises(ValueError):
        K.read_frames(data.replace(b"abc", b"abd"), offsets)


def test_long_texts_are_encoded_in_pieces(monkeypatch):
    import public_tokenizers

    e = K.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    text = ("hello, wörld! " * 50).encode()
    whole = e.encode([text])
    monkeypatch.setattr(K, "PIECE", 17)
    assert e.encode([text]) == whole


@pytest.mark.parametrize("version", [1, 2, None])
def test_warc(spark, version):
    rows = [(5, "http://a b/", "x" * 200), (3, None, "x" * 200), (4, "q", None), (9, "q", "b"), (8, "q", "b"), (7, "q", "é" * 60), (6, "q", "é" * 60), (None, "q", "x" * 200), (3, "z", "x" * 200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = warc.pages_through_warc(df, version).collect()
    assert len(got) == len(rows)
    for r in got:
        pages = [h for p, _, h in rows if p == r.page_id]
        assert r.payload_digest in {hashlib.sha256((h or "").encode()).hexdigest() for h in pages}
    types = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got)
    assert types == [(0, "revisit", 3), (3, "response", None), (3, "revisit", 3), (4, "response", None), (5, "revisit", 3), (6, "response", None), (7, "revisit", 6), (8, "response", None), (9, "response", None)]
    ids = {r.record_id for r in got}
    assert len(ids) == len(rows) and all(r.refers_to_record in ids for r in got if r.record_type == "revisit")
    assert warc.pages_through_warc(df.limit(0)).count() == 0


def test_long_pages_and_other_columns(spark):
    """A page far larger than what is read at a time, and columns with the names that the operator uses."""
    rng = np.random.default_rng(8)
    big = "".join(map(chr, rng.integers(97, 123, 3_000_000)))
    rows = [(1, "u", big, "x", "y"), (2, "u", big, "x", "y"), (3, "u", big[:99], "x", "y"), (4, "u", big[:99], "x", "y")]
    got = {r.page_id: r for r in warc.pages_through_warc(spark.createDataFrame(rows, "page_id long, url string, html string, digest string, k string")).collect()}
    assert [got[k].payload_bytes for k in (1, 2, 3, 4)] == [3_000_000, 3_000_000, 99, 99]
    assert [(got[k].record_type, got[k].refers_to) for k in (1, 2, 3, 4)] == [("response", None), ("revisit", 1), ("response", None), ("response", None)]
    assert got[2].refers_to_record == got[1].record_id


def test_members_are_streamed():
    import io

    made = [warc.member(bytes([k]) * (k * 7000)) for k in range(1, 9)]
    for step in (1, 97, 1 << 16):
        got = list(warc.members(io.BytesIO(b"".join(made)), step))
        assert [x for _, _, x in got] == [bytes([k]) * (k * 7000) for k in range(1, 9)] and [n for _, n, _ in got] == [len(m) for m in made]
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(made[0][:-3])))


def test_arc_lines():
    record = b"http://x/a b 1.2.3.4 19970101123456 text/html; charset=x 3\nabc\n"
    (fields, body), = warc.parse_arc(record, 1)
    assert body == b"abc" and fields["url"] == "http://x/a b" and fields["type"] == "text/html; charset=x" and warc.warc_date(fields["date"]) == "1997-01-01T12:34:56Z"
    for bad in (b"http://x 1.2.3.4 1997 text/html 9\nabc", b"nonsense\n"):
        with pytest.raises(ValueError):
            list(warc.parse_arc(bad, 1))


def test_pseudonyms(spark, frame):
    text = "call +1 (017) 555-7713 or (017) 555-7713, card 4111 1111 1111 1111, 4111111111111111; 47.129.145.209 on 2020-02-29, ssn 123-45-6789, ab.cd@x.example.com"
    new, spans = P.replace(text, b"k")
    assert len(spans) == 8 and P.replace(new, b"k", back=True)[0] == text and P.replace(text, b"other")[0] != new
    pseudo = [s[3] for s in spans]
    assert pseudo[0].endswith(pseudo[1]) and pseudo[2].replace(" ", "") == pseudo[3] and P.luhn(pseudo[3]) == 0
    for same in ("999.1.1.1", "2021-02-29", "4111111111111112", "000-12-3456", "v1.2.3.4.5"):
        assert P.replace(same)[0] == same
    out = P.pseudonymise(frame([(1, None), (2, ""), (3, text), (3, text)]), b"k").orderBy("doc_id").collect()
    assert [r._text for r in out] == [None, "", new, new] and out[0]._values == []
    with pytest.raises(ValueError):
        P.pseudonymise(frame([]), b"")


def plain_feistel(key, tweak, x, size):
    """Ten rounds on two halves, walked until the value is in the range, with nothing shared but the hash."""
    bits = 1
    while 4**bits < size:
        bits += 1
    n_bytes = -(-bits // 8)
    while True:
        left, right = divmod(x, 2**bits)
        for r in range(10):
            digest = hashlib.blake2b(bytes([r]) + right.to_bytes(n_bytes, "big") + tweak.encode(), key=key, digest_size=max(8, n_bytes)).digest()
            left, right = right, left ^ int.from_bytes(digest, "big") % 2**bits
        x = left * 2**bits + right
        if x < size:
            return x


def brute_pseudonyms(text, key):
    """The text with pseudonyms, by trying every place of it alone."""
    import re

    patterns = [
        ("date", r"\d{4}([-/.])\d{1,2}\1\d{1,2}|\d{1,2}([-/.])\d{1,2}\2\d{4}"), ("ip", r"\d{1,3}(?:\.\d{1,3}){3}"), ("ssn", r"\d{3}-\d{2}-\d{4}"),
        ("phone", r"\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){2,3}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}([-.])\d{3}\1\d{4}"),
        ("card", r"\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5}"),
    ]
    found, at = [], 0
    for s in range(len(text)):
        if s < at or not (text[s].isdigit() or text[s] in "+("):
            continue
        e = s
        while e < len(text) and (text[e] in "-+( )./" or "0" <= text[e] <= "9"):
            e += 1
        for kind, pattern in patterns:
            m = re.compile(pattern).match(text, s, e)
            if not m:
                continue
            a, b = text[: m.start()], text[m.end() :]
            free = not (a and a[-1].isalnum()) and not (len(a) > 1 and a[-1] == "." and a[-2].isdigit()) and not (b and b[0].isalnum()) and not (len(b) > 1 and b[0] in ".-/" and b[1].isdigit())
            value = P._READ[kind](m[0]) if free else None
            if value:
                found.append((s, m.end(), value))
                at = m.end()
            break
    mails = []
    for k, c in enumerate(text):
        if c == "@":
            s = k
            while s and re.match(r"[A-Za-z0-9._%+-]", text[s - 1]):
                s -= 1
            while s < k and not re.match(r"[A-Za-z0-9]", text[s]):
                s += 1
            e = k + 1
            while e < len(text) and re.match(r"[A-Za-z0-9.-]", text[e]):
                e += 1
            while e > k + 1 and not re.match(r"[A-Za-z0-9]", text[e - 1]):
                e -= 1
            if s < k and e > k + 2 and (not mails or mails[-1][1] <= s) and (value := P._email(text[s:e])):
                mails.append((s, e, value))
    found = [x for x in found if all(x[1] <= s or x[0] >= e for s, e, _ in mails)] + mails
    out, at = [], 0
    for s, e, v in sorted(found, key=lambda x: x[0]):
        x = plain_feistel(key, v.tweak, v.number, v.size)
        while not v.write(x):
            x = plain_feistel(key, v.tweak, x, v.size)
        out += [text[at:s], v.write(x)]
        at = e
    return "".join([*out, text[at:]]), len(found)


def test_pseudonyms_against_plain_loops(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.text, r.n_values) for r in P.op2_pseudonyms(spark, data).collect()}
    want = {r.doc_id: (None, 0) if r.text is None else brute_pseudonyms(r.text, P.KEY) for r in docs}
    assert got == want and sum(n for _, n in want.values()) > 20


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["2020-02-29", "1/12/1999", "47.129.145.209", "123-45-6789", "4111111111111111", "+1 (017) 555-7713", "555-0102-0103", "a.b1c@x.com", "..q1q@m-n.co.uk", "@", "-", ".", " ", "9", "x", "555-555-5555@abc.de"]), max_size=9))
def test_pseudonyms_of_odd_neighbours(parts):
    text = "".join(parts)
    new, spans = P.replace(text)
    assert (new, len(spans)) == brute_pseudonyms(text, P.KEY)


def test_pseudonyms_take_linear_time():
    import time

    texts = [" ".join(f"user{k}@mail{k % 9}.example.com 10.0.{k % 250}.7" for k in range(50_000)), "a" * 2_000_000 + " x@y.zz", "1" * 2_000_000, "(" * 1_000_000 + "@", "." * 1_000_000 + "a@b.cc"]
    start = time.process_time()
    counts = [len(P.replace(t)[1]) for t in texts]
    assert counts[0] == 100_000 and time.process_time() - start < 60
    assert P.replace("a" * 65 + "@b.cc")[1] == [] and len(P.replace("a" * 64 + "@b.cc")[1]) == 1


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 10**6), st.integers(0, 10**6))
def test_permutation(size, x):
    x %= size
    y = P.permute(b"key", "t", x, size)
    assert 0 <= y < size and P.permute(b"key", "t", y, size, back=True) == x


def plain_targets(sizes: dict) -> dict:
    """Targets by resharing what is above the cap until nothing is."""
    names = sorted(sizes)
    weights = {n: M.WEIGHTS[k % 3] for k, n in enumerate(names)}
    total, out, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        share = (total - sum(out.values())) / sum(weights[n] for n in open_)
        over = {n for n in open_ if share * weights[n] > 3 * sizes[n]}
        if not over:
            return out | {n: share * weights[n] for n in open_}
        out |= {n: 3.0 * sizes[n] for n in over}
        open_ -= over
    return out


def test_pipeline_against_plain_loops(spark, data, tmp_path):
    from sparkloom.llm import decontaminate as D, neardup as N

    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, results = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, data).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert k == 4 or docs.columns == columns
        results.append(docs.collect())
    everything = spark.read.parquet(f"{data}/documents.parquet")
    scores = {r.doc_id: r._score for r in Q.score_quality(everything, Q.fit(everything, spark.read.parquet(f"{data}/labels.parquet"))).collect()}
    assert {r.doc_id for r in results[0]} == {d for d, x in scores.items() if x >= 0.5}
    groups = N.brute([(r.doc_id, r.text) for r in results[0]])
    assert {r.doc_id for r in results[1]} == {d for d, (_, _, kept) in groups.items() if kept}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    assert {r.doc_id for r in results[2]} == {w[0] for w in D.brute([(r.doc_id, r.text) for r in results[1]], items) if not w[5]}
    size = {r.doc_id: len(r.text.encode().split()) for r in results[2]}
    source = {r.doc_id: r.source for r in results[2]}
    sizes: dict = {}
    for d, n in size.items():
        sizes[source[d]] = sizes.get(source[d], 0) + n
    targets = plain_targets(sizes)
    times: dict = {}
    for r in results[3]:
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    for name, target in targets.items():
        own = [d for d in size if source[d] == name]
        whole = int(target // sizes[name]) if sizes[name] else 0
        assert all(whole <= times.get(d, 0) <= whole + 1 for d in own if size[d])
        words = sum(times.get(d, 0) * size[d] for d in own)
        assert target - 1 <= words <= target + max(size[d] for d in own) + 1  # the last row counts as a whole
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, start = [], 0
    for r in sorted(results[3], key=lambda r: r.doc_id):
        ids = t.encode(r.text, add_special_tokens=False).ids + [1]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((tuple(r) for r in results[4]), key=lambda r: r[1]) == want
    assert corpus_pipeline.run(spark, data).count() == len(want)


def test_added_tokens_are_the_librarys(spark, frame):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    texts = [
        "one <|endoftext|> two", "One<|endoftext|>Two's", "<|endoftext|>", "<|startoftext|><|endoftext|> x <|startoftext|>", "<|ENDOFTEXT|> Shout", "<|endoftext|><|ENDOFTEXT|>A\u0301",
        "<|endoftext|", "plain", "", "A<|endoftext|>\u0301 E\u0301", "<|<|endoftext|>|> <|endoftext|>\n", "größe<|endoftext|>ÄÖ",
    ]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert want[0] == [637, 49407, 1237]
    e = K.WordEncoder(path)
    got = [np.frombuffer(x, "<u4" if e.wide else "<u2").tolist() for x in e.encode([x.encode() for x in texts])]
    assert got == want
    rows = K.token_records(frame(list(enumerate(texts)))).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_crc32) for r in rows} == {k: (len(w) + 1, zlib.crc32(np.array(w + [1], "<u4").tobytes())) for k, w in enumerate(want)}


def _labelled(n):
    """Ids that a fit may look at, and their labels by turns."""
    ids = [d for d in range(1, 10 * n) if zlib.crc32(str(d).encode()) % 3 != 1][:n]
    return [(d, k % 2) for k, d in enumerate(ids)]


def test_quality_is_fitted_on_whole_texts(spark, frame):
    """Both classes begin alike for 20 KB; what tells them apart comes behind that."""
    rng = np.random.default_rng(7)
    words = [["".join(map(chr, rng.integers(97, 123, 6))) for _ in range(60)] for _ in range(3)]
    text = lambda k, n: " ".join(rng.choice(words[k], n))
    known = _labelled(80)
    rows = [(d, text(2, 3000) + " " + text(y, 3000)) for d, y in known]
    model = Q.fit(frame(rows), spark.createDataFrame(known, "doc_id long, quality int"))
    score = Q.Scorer(model).score
    assert all(score((text(2, 3000) + " " + text(1, 3000)).encode()) > 0.5 > score((text(2, 3000) + " " + text(0, 3000)).encode()) for _ in range(10))


def test_quality_counts_a_repeated_row_once(spark, frame):
    known = _labelled(40)
    rows = [(d, f"{'good words here' if y else 'BAD %%% 000'} {d}") for d, y in known]
    labels = spark.createDataFrame(known, "doc_id long, quality int")
    want = Q.fit(frame(rows), labels, sample_rows=20)
    assert want.weights
    assert Q.fit(frame(rows[:1] * 3000 + rows), labels, sample_rows=20) == want
    # longer rows make for fewer of them, never for none
    lengths = [(y, k, k, 0, 100) for y in (True, False) for k in range(50)]
    assert len(Q._whole_rows(lengths, 1000)) == 20 and len(Q._whole_rows(lengths, 1)) == 16


@pytest.mark.parametrize("line", ["a line that comes up again and again\n", "another rather longer line, with a few more words in it, that comes up again and again, too\n"])
def test_fingerprints_reach_behind_repeated_lines(line):
    rng = np.random.default_rng(11)
    word = lambda: "".join(map(chr, rng.integers(97, 123, 6)))
    tail, other = (" ".join(word() for _ in range(800)) for _ in range(2))
    f = lambda t: H.fingerprint((line * 400 + t).encode())
    changed = tail[:2000] + "xyz" + tail[2000:]
    assert H.likeness(f(tail), f(changed)) > 0.8 > 0.5 > H.likeness(f(tail), f(other))
    assert len(f(tail).split(":")[1]) > 2 * 4


def test_rounds_count_three_times():
    for period in (1, 2, 5):
        code = np.arange(period, dtype=np.uint32)
        assert H._fourth(np.concatenate([np.tile(code, 6), [99]]), period).tolist() == [False] * (4 * period - 1) + [True] * (2 * period + 1) + [False]
    assert not H._fourth(np.arange(9), 2).any() and not H._fourth(np.zeros(3), 1).any()


CLASHING = ("_score", "_key", "_d", "_h", "_x", "_n", "_u", "_m", "_words", "_ranges", "_items", "_n_words", "_n_hit", "_spans", "_size", "_row", "_s", "_b", "_at", "_taken", "_target", "_positions", "_source_size", "_text", "_values", "node", "extra0", "rank", "a b")


@pytest.mark.parametrize("which", range(4))
def test_stages_keep_rows_whole(spark, data, odd, which, tmp_path):
    """Null ids, null, empty and long texts, repeated rows, columns of any name: what stays is unchanged, and an empty table stays empty."""
    name, stage = corpus_pipeline.STAGES[which]
    rows = [(*r, "s" if k % 2 else None) for k, r in enumerate([*odd, (None, "null id text"), (None, None), (6, "one"), (6, "two"), (1, odd[0][1]), (40, "w " * 200_000)])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    df = df.select("*", *(M.F.concat(M.F.lit(c), M.F.col("doc_id").cast("string")).alias(c) for c in CLASHING))
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    df = spark.read.parquet(f"{tmp_path}/in")
    out = stage(spark, df, data)
    assert out.columns == df.columns
    known = {tuple(r) for r in df.collect()}
    got = [tuple(r) for r in out.collect()]
    assert got and set(got) <= known
    assert stage(spark, df.limit(0), data).count() == 0
    if name == "near-duplicates":
        assert len(got) == len(set(got))
        kept = sorted((r[0], r[1]) for r in got if r[0] is not None and r[1] and r[1].split())
        assert (1, odd[0][1]) in kept and (2, odd[1][1]) not in kept and (6, "one") in kept and (6, "two") in kept
        assert sum(r[1] is None for r in got) == 2
    if name == "mixing":
        assert not any(r[1] is None or not r[1].split() for r in got)
    if name == "decontamination":
        assert len(got) == len(rows)


def test_near_duplicate_stage_judges_rows_not_ids(spark, tmp_path):
    a, b = (" ".join(f"{x}{k}" for k in range(40)) for x in "ab")
    rows = [(3, a, "p"), (5, b, "p"), (5, a, "q"), (5, b, "q"), (5, b, "q"), (9, b, "r")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/in")
    got = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, spark.read.parquet(f"{tmp_path}/in"), "").collect()]
    assert len(got) == 2 and got.count((3, a, "p")) == 1 and sum(r[:2] == (5, b) for r in got) == 1


def test_mixing_stage_takes_repeated_rows_one_by_one(spark, tmp_path):
    rows = [(1, "w w w", "s")] * 30 + [(2, "w w w", "t")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/in")
    got = [tuple(r) for r in corpus_pipeline.mixed(spark, spark.read.parquet(f"{tmp_path}/in"), "").collect()]
    # two sources, 93 words: t is held at 9 words, its three passes; s takes the other 84, 28 rows
    assert got.count((2, "w w w", "t")) == 3 and got.count((1, "w w w", "s")) == 28


def test_operators_replace_clashing_columns(spark):
    df = spark.createDataFrame([(1, "one two", "s", "old", "old", "old")], "doc_id long, text string, source string, _score string, _text string, _target string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    scored = Q.score_quality(df, Q.fit(df, labels))
    assert scored.columns == ["doc_id", "text", "source", "_text", "_target", "_score"] and scored.first()._score != "old"
    named = P.pseudonymise(df)
    assert named.columns == ["doc_id", "text", "source", "_score", "_target", "_text", "_values"] and named.first()._text == "one two"
    placed = M.mix_sources(df.withColumn("n", M.words("text")), "n")
    assert placed.columns == ["doc_id", "text", "source", "_score", "_text", "n", "_source_size", "_target", "_taken", "_positions"] and placed.first()._target == 2.0


def plain_fingerprint(data: bytes) -> str:
    """The fingerprint with one loop over bytes, and nothing shared with the operator but its constants' values."""
    if not data:
        return "0::"
    m32 = 0xFFFFFFFF
    sums, levels, total = [], [], 0
    for i in range(len(data)):
        h = 1
        for j in range(7):
            k = i - 6 + j
            x = data[k] if k >= 0 else 0
            h = x + 1 if j == 0 else (h * 0x01000193 + x) & m32
        for shift, factor in ((15, 0x2C1B3C6D), (12, 0x297A2D39)):
            h = ((h ^ h >> shift) * factor) & m32
        h ^= h >> 15
        total = (total + h) & m32
        if h % 4 == 0:
            zeros = 0
            while zeros < 30 and not h >> zeros & 1:
                zeros += 1
            levels.append(zeros)
            sums.append(total)
    level = max([2] + [k for k in range(2, 31) if sum(x >= k for x in levels) >= 32])

    def code(x):
        x = ((x ^ x >> 16) * 0x85EBCA6B) & m32
        return (x ^ x >> 13) >> 20

    def signature(least):
        ends = [s for s, x in zip(sums, levels) if x >= least] + [total]
        codes = [code((b - a) & m32) for a, b in zip([0] + ends, ends)]
        for period in range(1, 17):
            if period > 1 and len(codes) <= 64:
                break
            stay = [k for k in range(len(codes)) if k < 4 * period - 1 or any(codes[j] != codes[j - period] for j in range(k - 3 * period + 1, k + 1))]
            codes, ends = [codes[k] for k in stay], [ends[k] for k in stay]
        if len(codes) > 64:
            codes = codes[:63] + [code((total - ends[62]) & m32)]
        digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
        return "".join(digits[c >> 6] + digits[c & 63] for c in codes)

    return f"{level}:{signature(level)}:{signature(level + 1)}"


def plain_likeness(f: str, g: str) -> float:
    """By the table of an edit distance of insertions and deletions."""
    if f == g:
        return 1.0
    (k, *a), (j, *b) = f.split(":"), g.split(":")
    best = 0.0
    for x, own in ((int(k), a[0]), (int(k) + 1, a[1])):
        for y, other in ((int(j), b[0]), (int(j) + 1, b[1])):
            if x == y and own and other:
                p, q = ([t[i : i + 2] for i in range(0, len(t), 2)] for t in (own, other))
                row = list(range(len(q) + 1))
                for i, c in enumerate(p, 1):
                    last, row[0] = row[0], i
                    for n, d in enumerate(q, 1):
                        last, row[n] = row[n], last if c == d else 1 + min(row[n], row[n - 1])
                best = max(best, 1 - row[-1] / (len(p) + len(q)))
    return best


def test_fingerprints_by_plain_loops(spark, data):
    rng = np.random.default_rng(12)
    texts = [r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").limit(40).collect()]
    texts = [t[:6000] for t in texts] + ["a", "ab" * 900, "line again\n" * 300 + texts[0][:2000], "".join(map(chr, rng.integers(97, 123, 3000))), "abcdefghij klmnop\n" * 100]
    prints = [H.fingerprint(t.encode()) for t in texts]
    assert prints == [plain_fingerprint(t.encode()) for t in texts]
    pairs = [*zip(prints, prints[1:]), *((f, H.fingerprint(H.edited(t, "x" * 400).encode())) for f, t in zip(prints, texts))]
    assert all(abs(H.likeness(f, g) - plain_likeness(f, g)) < 1e-12 for f, g in pairs) and any(0 < H.likeness(f, g) < 1 for f, g in pairs)


def test_mix_by_plain_loops(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "source", "text", M.F.xxhash64("doc_id", "text").alias("h")).collect()
    got = {r.doc_id: (r.size, r.source_size, r.target, r.taken) for r in M.op4_mix_sources(spark, data).collect()}
    import re

    size = {r.doc_id: len(re.findall("[^\\x20\\x09-\\x0d]+", r.text or "")) for r in docs}
    groups: dict = {}
    for r in docs:
        groups.setdefault(r.source, []).append(r)
    sizes = {s: sum(size[r.doc_id] for r in rows) for s, rows in groups.items()}
    named = {("0" + s if s is not None else "1"): n for s, n in sizes.items()}  # null last
    targets = plain_targets(named)
    want = {}
    for s, rows in groups.items():
        target = targets["0" + s if s is not None else "1"]
        left = round(target)
        order = sorted(rows, key=lambda r: (r.h % 4096, r.h))
        taken = {r.doc_id: 0 for r in rows}
        while left > 0 and sizes[s]:
            for r in order:
                part = min(left, size[r.doc_id])
                taken[r.doc_id] += part
                left -= part
        for r in rows:
            want[r.doc_id] = (size[r.doc_id], sizes[s], target, taken[r.doc_id])
    assert {d: (w[0], w[1], w[3]) for d, w in want.items()} == {d: (g[0], g[1], g[3]) for d, g in got.items()}
    assert all(abs(got[d][2] - w[2]) < 1e-6 * w[2] + 1e-9 for d, w in want.items())


def test_scores_by_plain_loops(spark, data):
    """Each score from the model by its formula, with compressors of the test's own."""
    import math

    import zstandard as z

    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    model = Q.fit(docs, spark.read.parquet(f"{data}/labels.parquet"))
    got = {r.doc_id: r.score for r in Q.op5_quality(spark, data).collect()}
    sizes = {}
    for name, raw in (("good", model.good), ("bad", model.bad)):
        c = z.ZstdCompressor(level=Q.LEVEL, dict_data=z.ZstdCompressionDict(raw), write_content_size=False, write_dict_id=False, write_checksum=False)
        sizes[name] = lambda t, c=c: sum(len(c.compress(t[k : k + Q.PIECE])) for k in range(0, len(t), Q.PIECE))
    for r in docs.collect():
        t = (r.text or "").encode()
        g, b = sizes["good"](t), sizes["bad"](t)
        x, y = ((b - g) / (b + g), g / len(t)) if t else (0.0, 0.5)
        a = model.weights
        want = 1 / (1 + math.exp(-max(-40.0, min(40.0, a[0] + a[1] * x + a[2] * y + a[3] * y * y))))
        assert abs(got[r.doc_id] - want) < 1e-9


def test_fingerprints_of_null_and_repeated_ids(spark, frame):
    rows = [(None, "null id"), (None, None), (3, "c c c c"), (3, "d d d d"), (3, "c c c c"), (1, ""), (2, "x" * 700_000)]
    df = frame(rows)
    h = {(r.doc_id, r.text): r.h for r in df.select("doc_id", "text", M.F.xxhash64(M.F.coalesce("text", M.F.lit(""))).alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), h[r], r[1] or ""))
    want = []
    for (d, t), (_, u) in zip(order, order[1:] + order[:1]):
        e = H.edited(t or "", u or "")
        f, g, n = (H.fingerprint(x.encode()) for x in (t or "", e, u or ""))
        want.append((d, len(t or ""), hashlib.sha256(e.encode()).hexdigest(), f, g, H.likeness(f, g), H.likeness(f, n)))
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted((tuple(r) for r in H.compare_with_next(df).collect()), key=key) == sorted(want, key=key)


def test_scores_of_repeated_and_long_rows(spark, frame):
    model = Q.Model(b"good words " * 50, b"bad %%% " * 50, (0.1, 5.0, -1.0, 0.2), 0.5)
    rows = [(1, "good words"), (1, "good words"), (2, "bad %%% " * 100_000), (None, "good words"), (3, None)]
    got = sorted((r.doc_id or 0, r._score) for r in Q.score_quality(frame(rows), model).collect())
    assert got[1][1] == got[2][1] == got[0][1] == Q.Scorer(model).score(b"good words") and len(got) == 5
    assert got[3][1] == Q.Scorer(model).score(b"bad %%% " * 100_000)


def test_mix_of_a_very_long_text(spark):
    df = spark.createDataFrame([(1, "w " * 300_000, "a"), (2, "v", "a"), (3, "u u", "b")], "doc_id long, text string, source string").withColumn("n", M.words("text"))
    got = {r.doc_id: r for r in M.mix_sources(df, "n").collect()}
    # b is held at three times its two words; a takes the rest
    assert got[1].n == 300_000 and got[3]._taken == 6 and abs(got[1]._taken + got[2]._taken - (300_003 - 6)) <= 1
