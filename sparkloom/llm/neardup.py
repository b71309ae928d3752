"""Near-duplicate documents by HyperMinHash: compressed registers, banding, corrected estimates, exact verification.

The k-th register of a text holds, of the least of its shingles' k-th hashes, the number of
leading zeros (6 bits) and the bits after the leading one (10 bits). Bands of registers give
candidates; an estimate from equal registers, less their chance collisions, discards most
of the false ones; the rest are compared on their full shingle sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import blocks_of_rows, drop, gram_hashes, hot_keys, hot_least, join_salted, keep, mix, release, settled, ship, slice_texts, utf8, word_hashes, word_spans, work_dir

#: Words of a shingle, and the least similarity of a link, in hundredths.
SHINGLE, PERCENT = 5, 75
#: Registers, and registers of a band: a pair at the threshold misses all bands once in 190,000.
REGISTERS, ROWS = 128, 4
#: Standard deviations that an estimate may lie below the threshold.
SLACK = 5.0
#: Texts on each side of a block that is compared in one go, and their shingles, about, at most.
BLOCK_ROWS, BLOCK_SHINGLES = 128, 1 << 20
#: Parts that the members of one bucket are dealt in when they are compared with its least one.
PARTS = 64
_A = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64)) | np.uint64(1)
_B = mix(np.arange(1001, REGISTERS + 1001, dtype=np.uint64))


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE, other: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of the rows, repeats included, and the offsets of the rows in them."""
    starts, ends, first = word_spans(data, offsets)
    h = word_hashes(data, starts, ends, lower=True, other=other)
    n = np.diff(first)
    counts = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    out, to = np.empty(int(counts.sum()), np.uint64), np.concatenate([[0], np.cumsum(counts)])
    grams = gram_hashes(h, size)
    own = np.repeat(first[:-1] - to[:-1], counts) + np.arange(len(out))
    long = np.repeat(n >= size, counts)
    out[long] = grams[own[long]]
    for i in np.flatnonzero((n > 0) & (n < size)):
        out[to[i]] = gram_hashes(h[first[i] : first[i + 1]], int(n[i]))[0]
    return out, to


def registers(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One row of registers for each non-empty run of shingle hashes that begins at ``starts``."""
    out = np.empty((REGISTERS, len(starts)), np.uint64)
    t = np.empty_like(x)
    for k in range(REGISTERS):
        np.multiply(x, _A[k], out=t)
        t += _B[k]
        np.minimum.reduceat(t, starts, out=out[k])
    return pack(out.T)


def pack(least: np.ndarray) -> np.ndarray:
    """Leading zeros and the ten bits after the leading one, in 16 bits."""
    top = np.frexp(np.maximum(least, np.uint64(1)).astype(np.float64))[1].astype(np.uint64)
    zeros = np.uint64(64) - np.minimum(top, np.uint64(64))
    return (zeros << np.uint64(10) | (least << np.minimum(zeros + np.uint64(1), np.uint64(63))) >> np.uint64(54)).astype(np.uint16)


def collisions(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Chance that two registers of disjoint sets of n and m shingles are equal."""
    z = np.arange(64)[:, None]
    width, low = 2.0 ** -(z + 11), 2.0 ** -(z + 1)
    return n * m / (n + m) * (width * (np.exp(-(n + m) * low) - np.exp(-(n + m) * 2 * low))).sum(0)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Similarity from rows of registers: the share of equal ones, corrected for chance collisions."""
    c = collisions(n.astype(float), m.astype(float))
    return np.clip(((a == b).mean(1) - c) / (1 - c), 0, 1)


def _signatures(batches):
    """Of batches (doc_id, h, text): number of shingles, 128 bits that stand for their set, registers.

    The 128 bits digest the hashes of all shingles in two families.
    """
    shape = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("n_shingles", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("regs", pa.binary())])
    for b in batches:
        data, offsets = utf8(b.column(2))
        for i, j in blocks_of_rows(offsets, 1 << 17):
            part = offsets[i : j + 1]
            some = data[part[0] : part[-1]], part - part[0]
            (x, to), (y, _) = shingle_hashes(*some), shingle_hashes(*some, other=True)
            full = np.flatnonzero(np.diff(to))
            regs = registers(x, to[full]) if len(full) else np.zeros((0, REGISTERS), np.uint16)
            counts, keys, packed = np.zeros(j - i, np.int64), np.zeros((j - i, 2), np.int64), [None] * (j - i)
            for k, r in zip(full.tolist(), regs):
                u, at = np.unique(x[to[k] : to[k + 1]], return_index=True)
                digest = xxhash.xxh3_128_digest(u.tobytes() + y[to[k] + at].tobytes())
                counts[k], keys[k], packed[k] = len(u), np.frombuffer(digest, np.int64), r.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(counts), *map(pa.array, keys.T.copy()), pa.array(packed, pa.binary())], schema=shape)


def _bands(batches):
    """Of batches (node, n_shingles, regs): a row for each band."""
    salt = mix(np.arange(5001, 5001 + REGISTERS // ROWS, dtype=np.uint64))
    for b in batches:
        data, _ = utf8(b.column(2))
        key = data.view(np.uint16).reshape(len(b), -1, ROWS).astype(np.uint64)
        h = sum((key[:, :, k] << np.uint64(16 * k) for k in range(ROWS)), np.uint64(0))
        h = mix(h + salt)
        each = lambda k: pa.array(np.repeat(b.column(k).to_numpy(zero_copy_only=False), len(salt)), pa.int64())
        yield pa.RecordBatch.from_arrays([each(0), each(1), pa.array(h.reshape(-1).view(np.int64))], ["node", "n", "band"])


def shingle_set(text: bytes, size: int = SHINGLE) -> set[bytes]:
    """The distinct shingles themselves."""
    words = text.lower().split()
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def linked(a: set, b: set, percent: int = PERCENT) -> bool:
    if not a or not b:
        return False
    both = len(a & b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def components(edges: DataFrame, out: str) -> DataFrame:
    """(node, comp): the least node that each node of ``edges`` (a, b) reaches, by alternating large and small stars.

    Each round is written to ``out``, so a lost executor costs one round at most.
    """
    spark = edges.sparkSession
    turned = lambda e: e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now = keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b"), f"{out}/0")
    n, before, k = now.count(), None, 0
    many = hot_least(2 * n)
    while True:
        degrees = turned(now).groupBy("a").agg(F.count(F.lit(1)).alias("k"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31))).alias("s"))
        *after, hot = degrees.agg(F.sum("k"), F.sum("s"), F.collect_list(F.when(F.col("k") >= many, F.col("a")))).first()  # a few thousand hot nodes at most
        if after == before or not after[0]:
            break
        before, k = after, k + 1
        both = turned(now)
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = join_salted(both, least, ["a"], hot, F.col("b")).where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = join_salted(large, least, ["a"], hot, F.col("b")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b"))).distinct()
        now = keep(small, f"{out}/{k}", 2 * n)
        drop(spark, f"{out}/{k - 1}")
    return keep(now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("comp")), f"{out}/done", 2 * n)


def _shingles(batches):
    """Of batches (node, text, c): the hash of each distinct shingle."""
    for b in batches:
        data, offsets = utf8(b.column(1))
        nodes, comps = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
        for i, j in blocks_of_rows(offsets, 1 << 17):
            part = offsets[i : j + 1]
            x, to = shingle_hashes(data[part[0] : part[-1]], part - part[0])
            found = [np.unique(x[to[k] : to[k + 1]]) for k in range(j - i)]
            each = [len(u) for u in found]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(nodes[i:j], each)), pa.array(np.concatenate(found).view(np.int64)), pa.array(np.repeat(comps[i:j], each))], ["node", "shingle", "c"])


def _promising(members: DataFrame, hot: list[int], comp: DataFrame, texts: DataFrame, percent: int, out: str, n: int) -> DataFrame:
    """Of buckets that aren't connected, the members that can have a link to another one at all: (band, node, n, c).

    A new link joins two components, so a shingle that only one component has is in no
    intersection that counts. With n shingles, u of them such ones, and partners of at least
    m, a link needs n - u >= p / (1 + p) * (n + m). The test is exact: it spares comparing
    loose copies of a text, which share bands with all others but are linked with none.
    """
    now = members.join(comp, "node", "left").select("band", "pivot", "node", "n", F.coalesce("comp", "node").alias("c"))
    opened = now.groupBy("band").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min("n").alias("floor")).where("lo <> hi").select("band", "floor")
    now = keep(join_salted(now, opened, ["band"], hot, F.col("node")), f"{out}/open", n)
    nodes = now.groupBy("node").agg(F.first("n").alias("n"), F.first("c").alias("c"), F.min("floor").alias("floor"))
    shingles = texts.join(nodes.select("node", "c"), "node").select("node", "text", "c").mapInArrow(settled(_shingles), "node long, shingle long, c long")
    lone = shingles.groupBy("shingle").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo = hi").select("shingle")
    lone = shingles.join(lone, "shingle").groupBy("node").agg(F.count(F.lit(1)).alias("u"))
    least = F.greatest(F.col("floor"), F.ceil(F.col("n") * percent / 100))
    able = (100 + percent) * (F.col("n") - F.coalesce("u", F.lit(0))) >= percent * (F.col("n") + least)
    alive = nodes.join(lone, "node", "left").where(able).select("node")
    return now.select("band", "node", "n", "c").join(alive, "node")


def _compared(percent: int):
    """Of one block (node, c, text, query): links between its queries and its other texts, of different components c.

    Of a pair of components one link is enough. Overlaps are counted on hashes, as bits of
    the shingles that more than one text has; what passes is confirmed on the shingles.
    """

    def run(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        query = t.column("query").to_numpy(zero_copy_only=False).astype(bool)
        nodes, comps = (t.column(k).to_numpy() for k in ("node", "c"))
        data, offsets = utf8(t.column("text"))
        x, to = shingle_hashes(data, offsets)
        sets = [np.unique(x[a:b]) for a, b in zip(to[:-1].tolist(), to[1:].tolist())]
        sizes = np.array([len(u) for u in sets], np.int64)
        values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = np.cumsum(counts > 1) - 1
        owner = np.repeat(np.arange(len(sets)), sizes)
        on = counts[inverse] > 1
        bits = np.zeros((len(sets), (int(shared[-1]) + 64) // 64 * 8 + 8), np.uint8)
        column = shared[inverse[on]]
        np.bitwise_or.at(bits, (owner[on], column >> 3), np.left_shift(1, column & 7).astype(np.uint8))
        words = bits.view(np.uint64)
        up: dict[int, int] = {}

        def top(c: int) -> int:
            while (n := up.get(c, c)) != c:
                c = n
            return c

        texts, made, found = list(slice_texts(data, offsets)), {}, []
        of = lambda k: made[k] if k in made else made.setdefault(k, shingle_set(texts[k]))
        rest = np.flatnonzero(~query)
        for q in np.flatnonzero(query).tolist():
            both = np.bitwise_count(words[rest] & words[q]).sum(1, dtype=np.int64)
            close = rest[(100 * both >= percent * (sizes[rest] + sizes[q] - both)) & (comps[rest] != comps[q])]
            for k in close.tolist():
                a, b = top(int(comps[q])), top(int(comps[k]))
                if a != b and linked(of(q), of(k), percent):
                    up[max(a, b)] = min(a, b)
                    found.append((int(nodes[q]), int(nodes[k])))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return run


def _blocks(members: DataFrame, hot: list[int], texts: DataFrame, out: str, n: int) -> DataFrame:
    """(h, r, q, node, c, text, query): blocks in which all pairs of different components in one bucket meet.

    A node's home h is the component that is largest in a bucket of its. In each bucket the nodes outside its
    largest component are queries to the homes of all its nodes. A home's nodes and queries
    are dealt over blocks of about BLOCK_ROWS texts or BLOCK_SHINGLES shingles each.
    """
    sizes = members.groupBy("band", "c").agg(F.count(F.lit(1)).alias("k"))
    sizes = sizes.groupBy("band").agg(F.max(F.struct("k", "c")).alias("top"), F.sum("k").alias("all")).where("all > top.k").select("band", F.col("top.c").alias("largest"))
    placed = join_salted(members, sizes, ["band"], hot, F.col("node"))
    placed = keep(placed.withColumn("inside", F.col("c") == F.col("largest")), f"{out}/placed", n)
    home = placed.groupBy("node").agg(F.first("c").alias("c"), F.first("n").alias("n"), F.max("inside").alias("inside"), F.min("largest").alias("m"))
    home = keep(home.select("node", "n", "c", F.when(F.col("inside"), F.col("c")).otherwise(F.col("m")).alias("h")), f"{out}/home", n)
    homes = placed.select("band", "node").join(home.select("node", "h"), "node").select("band", "h").distinct()
    asked = placed.where("not inside").select("band", "node", "n", "c").join(homes, "band").select("node", "n", "c", "h").distinct()
    asked = keep(asked, f"{out}/asked", n)
    per = lambda df, c: df.groupBy("h").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias(c))
    counts = per(home, "nr").join(per(asked, "nq"), "h")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    rows = home.join(counts, "h").select("h", own("nr").alias("r"), each("nq").alias("q"), "node", "c", F.lit(False).alias("query"))
    queries = asked.join(counts, "h").select("h", each("nr").alias("r"), own("nq").alias("q"), "node", "c", F.lit(True).alias("query"))
    return rows.unionAll(queries).join(texts, "node")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """For each row of ``docs``: doc_id, n_shingles, component_id, kept, node, h and first.

    Links join documents whose sets of distinct shingles have a similarity of at least
    ``percent`` hundredths. Texts without words (null ones too) are linked with nothing.
    Repeated rows and equal sets (128 bits that digest the whole set) share a class, the
    node. The component's id is its smallest doc_id, null only where all of its ids are;
    kept tells whether the row has this id. Of rows with one id and different texts, first
    is true for one alone: a component's first row is the least by doc_id (null last) and
    hash h of the text. An empty table stays empty; other columns aren't read.

    Only one row of a class goes on. In a band's bucket all members are compared with
    the least one. In a bucket that isn't all connected then, members whose shingles
    rule out any link are put aside, and those outside its largest component are
    compared, in blocks, with all that share a bucket with them. So copies cost no
    pairs, no pair is lost, and only links are given out.
    """
    spark = ship(docs.sparkSession)
    out = work_dir(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    sig = keep(rows.mapInArrow(settled(_signatures), "doc_id long, h long, n_shingles long, k1 long, k2 long, regs binary"), f"{out}/signatures")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("u"), "doc_id", "h", "n_shingles", "regs")).alias("f")
    n_rows = sig.count()
    reps = sig.where("n_shingles > 0").groupBy("k1", "k2").agg(least, F.count(F.lit(1)).alias("copies"))
    # the number of a class holds once it is written
    reps = keep(reps.select(F.monotonically_increasing_id().alias("node"), "k1", "k2", "f.doc_id", "f.h", "f.n_shingles", "f.regs", "copies"), f"{out}/classes", n_rows, 1 << 16)
    n_classes = reps.count()

    bands = reps.select("node", "n_shingles", "regs").mapInArrow(_bands, "node long, n long, band long")
    n_bands = n_classes * REGISTERS // ROWS
    shared = keep(bands.groupBy("band").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("c")).where("c > 1"), f"{out}/shared", n_bands)
    hot = hot_keys(shared, "band", "c", shared.agg(F.sum("c")).first()[0] or 0)
    members = keep(join_salted(bands, shared.select("band", "pivot"), ["band"], hot, F.col("node")), f"{out}/members", n_bands)
    n_members = members.count()
    release(spark)
    chosen = reps.join(members.select("node"), "node", "left_semi")
    wanted = chosen.select("node", F.col("doc_id").alias("d"), F.col("h").alias("g"))
    texts = rows.join(wanted, F.expr("h = g and doc_id <=> d")).dropDuplicates(["g", "node"])
    texts = keep(texts.select("node", "text"), f"{out}/texts", n_classes, 1 << 12)
    light = keep(chosen.select("node", "n_shingles", "regs"), f"{out}/involved", n_classes, 1 << 16)
    release(spark)

    def likely(batches):
        low = percent / 100 - SLACK * (percent / 100 * (1 - percent / 100) / REGISTERS) ** 0.5
        for b in batches:
            c = {n: b.column(k) for k, n in enumerate(b.schema.names)}
            n, m = (c[x].to_numpy(zero_copy_only=False) for x in ("n", "m"))
            r, s = (utf8(c[x])[0].view(np.uint16).reshape(-1, REGISTERS) for x in ("r", "s"))
            ok = (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (estimate(r, s, n, m) >= low)
            yield pa.RecordBatch.from_arrays([c["a"], c["b"]], ["a", "b"]).filter(pa.array(ok))

    def exact(batches):
        """Of batches (b, part, a, text) in order: after a bucket's least text (a is null) its members, each compared with it."""
        kept = set()
        for batch in batches:
            ok, ours = [], batch.column(2).to_pylist()
            for a, t in zip(ours, slice_texts(*utf8(batch.column(3)))):
                if a is None:
                    kept = shingle_set(t)
                ok.append(a is not None and linked(shingle_set(t), kept, percent))
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(0)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    pairs = keep(members.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct(), f"{out}/pairs", n_members)
    n_pairs = pairs.count()
    left, right = (light.select(F.col("node").alias(x), F.col("n_shingles").alias(n), F.col("regs").alias(r)) for x, n, r in (("a", "n", "r"), ("b", "m", "s")))
    pivots = hot_keys(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("k")), "b", "k", n_pairs)
    some = join_salted(pairs.join(left, "a"), right, ["b"], pivots, F.col("a")).mapInArrow(settled(likely), "a long, b long")
    some = keep(some.withColumn("part", F.pmod(F.xxhash64("a"), F.lit(PARTS))), f"{out}/likely", n_pairs, 1 << 16)
    # a bucket's least text goes once to each of its parts, ahead of the members there
    ahead = some.select("b", "part").distinct().join(texts, F.col("b") == F.col("node")).select("b", "part", F.lit(None).cast("long").alias("a"), "text")
    after = some.join(texts, F.col("a") == F.col("node")).select("b", "part", "a", "text")
    dealt = ahead.unionAll(after).repartition("b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())
    links = keep(dealt.mapInArrow(settled(exact), "a long, b long"), f"{out}/links-0", n_pairs, 1 << 12)

    comp = components(links, f"{out}/components-0")
    able = keep(_promising(members, hot, comp, texts, percent, out, n_members), f"{out}/promising", n_members)
    more = _blocks(able, hot, texts, out, n_members).groupBy("h", "r", "q").applyInArrow(_compared(percent), "a long, b long")
    more = keep(more, f"{out}/links-1")
    if not more.isEmpty():
        comp = components(links.unionAll(more), f"{out}/components-1")
    release(spark)
    # each class's component is told by its first row
    classes = reps.select("node", "k1", "k2", "copies", F.struct(F.col("doc_id").isNull().alias("u"), "doc_id", "h").alias("own"))
    classes = classes.join(comp, "node", "left").withColumn("c", F.coalesce("comp", "node")).drop("comp")
    large = hot_keys(comp.groupBy("comp").agg(F.count(F.lit(1)).alias("k")), "comp", "k", n_classes)
    named = join_salted(classes, classes.groupBy("c").agg(F.min("own").alias("f")), ["c"], large, F.col("node"))
    copied = hot_keys(reps, "k1", "copies", n_rows)
    found = join_salted(sig.drop("regs"), named.select("k1", "k2", "node", "f"), ["k1", "k2"], copied, F.monotonically_increasing_id(), "left")
    lone = F.col("n_shingles") == 0
    found = found.withColumn("component_id", F.when(lone, F.col("doc_id")).otherwise(F.col("f.doc_id")))
    first = lone | (F.col("doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("h") == F.col("f.h")))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "node", "h", first.alias("first"))


def op10_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id", "kept")


def brute(rows: list[tuple], percent: int = PERCENT) -> dict:
    """doc_id: (n_shingles, component_id, kept), by comparing all pairs, for tests."""
    sets = {d: shingle_set((t or "").encode()) for d, t in rows}
    up = {d: d for d in sets}

    def top(d):
        while up[d] != d:
            d = up[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if 4 * min(len(sets[a]), len(sets[b])) >= 3 * max(len(sets[a]), len(sets[b])) and linked(sets[a], sets[b], percent):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), top(d), top(d) == d) for d in ids}
