"""Finding repeated windows across a corpus: what the substring and the suffix-array operators share.

A window is ``k`` consecutive units (words or bytes) of one text. Its key is the least hash of
its grams of ``m`` units, so equal windows have equal keys and consecutive windows mostly share
one; a run of windows with one key is a segment. Only segments whose key comes up in another
text (or again in their own) can hold a repeated window. These alone, with each different
content once, go to shards by key, where an index tells which of their windows
also start earlier. Everything of a shard is decided there; nothing is sampled or capped.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass
from typing import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import blocks_of_rows, drop, gram_hashes, hot_keys, hot_least, join_salted, keep, keep_bucketed, mix, release, ship, slide_min, utf8, word_hashes, word_spans, work_dir

#: Windows that are looked at in one go, and the most of one segment.
PIECE, LONGEST = 1 << 18, 1 << 12
#: Segments of a key, in all texts, beyond which its windows go to shards one by one.
HOT = 20_000
#: Bytes of different contents in a shard.
SHARD_BYTES = 2 << 20
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _geometric(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_R = _geometric(0x9FB21C651E98DF25, PIECE + LONGEST + 256)
_R_INVERSE = _geometric(pow(0x9FB21C651E98DF25, -1, 1 << 64), PIECE + 1)


@dataclass(frozen=True)
class Kind:
    """Units: 'word' or 'byte'; k units of a window; m of a gram; own: whether an earlier start in the same document counts."""

    unit: str
    k: int
    m: int
    own: bool


class Units:
    """The units of some texts."""

    def __init__(self, kind: Kind, data: np.ndarray, offsets: np.ndarray, hashed: bool = True):
        self.kind, self.data = kind, data
        if kind.unit == "word":
            self.starts, self.ends, self.first = word_spans(data, offsets)
            if hashed:
                self.h = word_hashes(data, self.starts, self.ends)
        else:
            self.first = offsets

    def grams(self, a: int, b: int) -> np.ndarray:
        """Hashes of the grams that start at units a to b - 1."""
        m = self.kind.m
        if self.kind.unit == "word":
            return gram_hashes(self.h[a : b + m - 1], m)
        part = np.concatenate([self.data[a : b + m - 1], np.zeros(8, np.uint8)])
        n = len(part) - 8
        eight = np.empty(n + 8, np.uint64)
        for k in range(8):
            x = part[k : k + (len(part) - k) // 8 * 8].view("<u8")
            eight[k : k + 8 * len(x) : 8] = x[: len(range(k, n + 8, 8))]
        out = eight[: b - a] * _C1
        for j in range(8, m - 7, 8):
            out = (out ^ (out >> np.uint64(29))) * _C2 + eight[j : j + b - a] * _C1
        if m % 8:
            out = (out ^ (out >> np.uint64(29))) * _C2 + eight[m - 8 : m - 8 + b - a] * _C1
        return mix(out)

    def segments(self):
        """Yields (rows, starts, windows, keys, times each key comes up in the segment's grams)."""
        k, first = self.kind.k, self.first
        w = k - self.kind.m + 1
        total = int(first[-1]) - k + 1
        if total <= 0:
            return
        ends = first[1:]
        close = np.zeros(int(first[-1]) + 1, np.int8)
        from_ = np.maximum(first[:-1], ends - k + 1)
        some = from_ < ends
        close[from_[some]] += 1
        np.subtract.at(close, ends[some], 1)
        valid = np.cumsum(close, dtype=np.int8)[:total] == 0
        for a in range(0, total, PIECE):
            b = min(a + PIECE, total)
            ok = valid[a:b]
            if not ok.any():
                continue
            g = self.grams(a, b + w - 1)
            least = slide_min(g, w)
            cut = np.ones(b - a + 1, bool)
            cut[1:-1] = (least[1:] != least[:-1]) | (ok[1:] != ok[:-1])
            at = np.flatnonzero(cut)
            s, e = at[:-1], at[1:]
            good = ok[s]
            s, e = s[good], e[good]
            if len(s) and (e - s).max() > LONGEST:
                parts = -(-(e - s) // LONGEST)
                k0 = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                s, e = np.repeat(s, parts) + k0 * LONGEST, np.minimum(np.repeat(s, parts) + (k0 + 1) * LONGEST, np.repeat(e, parts))
            key, n = least[s], e - s
            times = np.ones(len(s), np.int64)
            if self.kind.own:
                span = n + w - 1
                to = np.cumsum(span)
                same = g[np.arange(int(to[-1]) if len(to) else 0) + np.repeat(s - (to - span), span)] == np.repeat(key, span)
                times = np.add.reduceat(same, to - span, dtype=np.int64) if len(s) else times
            yield np.searchsorted(first, s + a, "right") - 1, s + a, n, key, times

    def content(self, start: int, windows: int) -> bytes:
        end = start + windows + self.kind.k - 1
        if self.kind.unit == "byte":
            return self.data[start:end].tobytes()
        whole = self.data[self.starts[start] : self.ends[end - 1]].tobytes()
        return b" ".join(whole.split())

    def hashes(self, starts: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """A hash of what each of some segments, in order, spells; with the segment's key it identifies the content."""
        out = np.empty(len(starts), np.uint64)
        word = self.kind.unit == "word"
        length = windows + self.kind.k - 1 - (0 if word else self.kind.m - 1)
        i = 0
        while i < len(starts):
            base = int(starts[i])
            j = max(i + 1, int(np.searchsorted(starts, base + PIECE, "right")))
            end = int((starts[i:j] + length[i:j]).max())
            x = self.h[base:end] if word else self.grams(base, end)
            sums = np.concatenate([[np.uint64(0)], np.cumsum(x * _R[: len(x)], dtype=np.uint64)])
            s = starts[i:j] - base
            out[i:j] = (sums[s + length[i:j]] - sums[s]) * _R_INVERSE[s]
            i = j
        return mix(out + windows.astype(np.uint64))


def _keys(kind: Kind):
    """Of batches (tid, text): the keys of each text, once, with their segments in it (a segment longer than any of
    one gram counts for several), and whether each comes up again in it."""
    w = kind.k - kind.m + 1

    def run(batches):
        for b in batches:
            data, offsets = utf8(b.column(1))
            tids = b.column(0).to_numpy(zero_copy_only=False)
            for i, j in blocks_of_rows(offsets):
                part = offsets[i : j + 1]
                found = [(r, key, -(-n // w), t) for r, _, n, key, t in Units(kind, data[part[0] : part[-1]], part - part[0]).segments()]
                if not found:
                    continue
                rows, keys, parts, times = (np.concatenate(x) for x in zip(*found))
                order = np.lexsort((keys, rows))
                rows, keys, parts, times = rows[order], keys[order], parts[order], times[order]
                new = np.ones(len(rows), bool)
                new[1:] = (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])
                at = np.flatnonzero(new)
                columns = [pa.array(keys[at].view(np.int64)), pa.array(tids[i + rows[at]]), pa.array(np.add.reduceat(parts, at))]
                if kind.own:
                    columns.append(pa.array((np.add.reduceat(times, at) > 1)))
                yield pa.RecordBatch.from_arrays(columns, ["key", "tid", "n", "again"][: len(columns)])

    return run


_INSTANCES = "tid long, d long, start long, n long, key long, c long, more array<long>"


def _instances(kind: Kind):
    """Of batches (tid, d, text, keys, hot): the segments with these keys, by place and hash of content; those of hot keys window by window.

    A window that comes up many times in a text (runs and periodic lines have few different ones) is one row,
    with its first place and the ``more`` ones.
    """
    shape = pa.schema([*((c, pa.int64()) for c in ("tid", "d", "start", "n", "key", "c")), ("more", pa.list_(pa.int64()))])
    salt = np.uint64(0xA0761D6478BD642F)

    def chosen(lists, i: int, j: int, rows: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Which (row, key) are in the rows' lists; a chance hit is one candidate more."""
        some = lists.slice(i, j - i)
        owner = np.repeat(np.arange(j - i), np.diff(some.offsets.to_numpy()))
        wanted = some.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        return np.isin(mix(keys + rows.astype(np.uint64) * salt), mix(wanted + owner.astype(np.uint64) * salt))

    def run(batches):
        for b in batches:
            tids, ds = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            data, offsets = utf8(b.column(2))
            any_hot = len(b.column(4).flatten()) > 0
            for i, j in blocks_of_rows(offsets):
                part = offsets[i : j + 1]
                u = Units(kind, data[part[0] : part[-1]], part - part[0])
                for rows, starts, n, keys, _ in u.segments():
                    on = chosen(b.column(3), i, j, rows, keys)
                    rows, starts, n, keys = rows[on], starts[on], n[on], keys[on]
                    hot = chosen(b.column(4), i, j, rows, keys) if any_hot else np.zeros(len(rows), bool)
                    if hot.any():
                        many = np.where(hot, n, 1)
                        step = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
                        rows, starts, keys, hot = np.repeat(rows, many), np.repeat(starts, many) + step, np.repeat(keys, many), np.repeat(hot, many)
                        n = np.where(hot, 1, np.repeat(n, many))
                    if not len(rows):
                        continue
                    c = u.hashes(starts, n)
                    keys = np.where(hot, mix(c + keys * salt), keys)  # with c it still tells the key: 128 bits
                    at = starts - u.first[rows]
                    counts, more = np.ones(len(rows), np.int64), at[:0]
                    if hot.any():
                        # the others first, each alone; then the windows of hot keys by text and content, by place
                        alone = np.flatnonzero(~hot)
                        order = np.flatnonzero(hot)
                        order = order[np.lexsort((at[order], keys[order], c[order], rows[order]))]
                        new = np.ones(len(order), bool)
                        new[1:] = (rows[order[1:]] != rows[order[:-1]]) | (c[order[1:]] != c[order[:-1]]) | (keys[order[1:]] != keys[order[:-1]])
                        firsts, more = np.flatnonzero(new), at[order[~new]]
                        counts = np.concatenate([counts[alone], np.diff(np.append(firsts, len(order)))])
                        on = np.concatenate([alone, order[firsts]])
                        rows, at, n, keys, c = rows[on], at[on], n[on], keys[on], c[on]
                    columns = (tids[i + rows], ds[i + rows], at, n.astype(np.int64), keys.view(np.int64), c.view(np.int64))
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts - 1)]).astype(np.int32)), pa.array(more, pa.int64()))
                    yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in columns), lists], schema=shape)

    return run


def _contents(kind: Kind):
    """Of batches (d, text, places): what the segments at these places spell."""
    shape = pa.schema([("key", pa.int64()), ("c", pa.int64()), ("d", pa.int64()), ("start", pa.int64()), ("content", pa.binary())])

    def run(batches):
        for b in batches:
            ds = b.column(0).to_numpy(zero_copy_only=False)
            data, offsets = utf8(b.column(1))
            lists = b.column(2)
            bounds, flat = lists.offsets.to_numpy(), lists.values
            start, n, key, c = (flat.field(x).to_numpy(zero_copy_only=False) for x in ("start", "n", "key", "c"))
            for i, j in blocks_of_rows(offsets):
                part, out = offsets[i : j + 1], []
                u = Units(kind, data[part[0] : part[-1]], part - part[0], hashed=False)
                for r in range(i, j):
                    base = int(u.first[r - i])
                    out += [u.content(base + int(start[k]), int(n[k])) for k in range(bounds[r], bounds[r + 1])]
                some = slice(bounds[i], bounds[j])
                owner = np.repeat(ds[i:j], np.diff(bounds[i : j + 1]))
                yield pa.RecordBatch.from_arrays([pa.array(key[some]), pa.array(c[some]), pa.array(owner), pa.array(start[some]), pa.array(out, pa.binary())], schema=shape)

    return run


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """(start, length) of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), (edge[1::2] - edge[::2]).tolist()))


def repeated_somewhere(contents: list[bytes], kind: Kind) -> np.ndarray:
    """Which contents hold a window that, by its hash, comes up twice among them all. Only these need an index."""
    offsets = np.cumsum([0, *map(len, contents)])
    hashes, owners = [], []
    data = np.frombuffer(b"".join(contents), np.uint8)
    for i, j in blocks_of_rows(offsets):
        u = Units(kind, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        n = np.diff(u.first) - kind.k + 1
        n = np.maximum(n, 0)
        starts = np.repeat(u.first[:-1] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        hashes.append(u.hashes(starts, np.ones(len(starts), np.int64)))
        owners.append(np.repeat(np.arange(i, j), n))
    h, owner = np.concatenate(hashes), np.concatenate(owners)
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    out = np.zeros(len(contents), bool)
    out[owner[order[1:][same]]] = True
    out[owner[order[:-1][same]]] = True
    return out


def _shard(decide: Callable, kind: Kind):
    """Of one shard's different contents, with their first places: the runs of windows that also start earlier."""
    shape = pa.schema([("key", pa.int64()), ("c", pa.int64()), ("d", pa.int64()), ("start", pa.int64()), ("runs", pa.list_(pa.int64()))])

    def run(table: pa.Table) -> pa.Table:
        t = table.sort_by([("d", "ascending"), ("start", "ascending")])
        contents, d, start = t.column("content").to_pylist(), t.column("d").to_numpy(), t.column("start").to_numpy()
        on = np.flatnonzero(repeated_somewhere(contents, kind))
        counts, values = np.zeros(len(contents), np.int64), np.zeros(0, np.int64)
        if len(on):
            found = decide([contents[k] for k in on.tolist()], d[on], start[on], kind)
            lengths = np.array([len(f) for f in found], np.int64)
            # all flags in a row with a gap after each content, so that no run crosses two
            first = np.cumsum(lengths + 1) - lengths - 1
            flags = np.zeros(int((lengths + 1).sum()) + 1, np.int8)
            flags[np.repeat(first - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))] = np.concatenate(found)
            edge = np.flatnonzero(np.diff(np.concatenate([[0], flags])))
            begin, n = edge[::2], edge[1::2] - edge[::2]
            owner = np.searchsorted(first, begin, "right") - 1
            values = np.stack([begin - first[owner], n], 1).reshape(-1)
            counts[on] = 2 * np.bincount(owner, minlength=len(on))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values, pa.int64()))
        return pa.Table.from_arrays([t.column("key"), t.column("c"), t.column("d"), t.column("start"), lists], schema=shape)

    return run


def _cut(kind: Kind):
    """Of batches (tid, text, removed): what is left of each text."""
    shape = pa.schema([("tid", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.int64())), ("kept_text", pa.string())])

    def run(batches):
        for b in batches:
            out, size = [], 0
            data, offsets = utf8(b.column(1))
            lists = b.column(2)
            bounds, flat = lists.offsets.to_numpy(), lists.values
            at, many = (flat.field(x).to_numpy(zero_copy_only=False) for x in ("at", "n"))
            for r, tid in enumerate(b.column(0).to_pylist()):
                text = data[offsets[r] : offsets[r + 1]]
                if kind.unit == "word":
                    starts, ends, _ = word_spans(text, np.array([0, len(text)]))
                    n = len(starts)
                else:
                    n = len(text)
                gone = np.zeros(n + 1, np.int32)
                some = slice(bounds[r], bounds[r + 1])
                np.add.at(gone, at[some], 1)
                np.subtract.at(gone, at[some] + many[some] + kind.k - 1, 1)
                gone = np.cumsum(gone[:-1]) > 0
                spans = runs(gone)
                if kind.unit == "word":
                    raw = text.tobytes()
                    left = b" ".join(raw[s:e] for s, e in zip(starts[~gone].tolist(), ends[~gone].tolist()))
                else:
                    left = text[~gone].tobytes()
                out.append((tid, int(gone.sum()), len(spans), hashlib.sha256(left).hexdigest(), [x for s in spans for x in s], left.decode("utf-8", "replace")))
                size += len(left)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_pylist([dict(zip(shape.names, o)) for o in out], shape)
                    out, size = [], 0
            yield pa.RecordBatch.from_pylist([dict(zip(shape.names, o)) for o in out], shape)

    return run


def _whole(kind: Kind):
    """Of batches (doc_id, tid, text): units of each text, and the hash of all of it."""

    def run(batches):
        for b in batches:
            data, offsets = utf8(b.column(2))
            raw = data.tobytes()
            n, sha = [], []
            for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                if kind.unit == "word":
                    words = raw[s:e].split()
                    n.append(len(words))
                    sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
                else:
                    n.append(e - s)
                    sha.append(hashlib.sha256(raw[s:e]).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(sha)], ["doc_id", "tid", "n_units", "whole_sha256"])

    return run


def _identity(light: DataFrame) -> Column:
    """A number for each text, from its two hashes h and g: h, unless another text has it too.

    Such texts are 10**-11 of all pairs in 10**4 million texts, so their hashes are a handful.
    """
    twice = [r.h for r in light.groupBy("h").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo <> hi").limit(10_001).collect()]
    if len(twice) > 10_000:
        raise ValueError("the texts' hashes don't tell them apart")
    return F.when(F.col("h").isin(twice), F.xxhash64("h", "g")).otherwise(F.col("h")) if twice else F.col("h")


def _wanted(rows: DataFrame, kind: Kind) -> DataFrame:
    """(tid, keys, hot): of each text, the keys that come up in another text, or again where that counts."""
    w = W.partitionBy("key")
    keys = rows.select("tid", "text").mapInArrow(_keys(kind), "key long, tid long, n long" + ", again boolean" * kind.own)
    keys = keys.withColumns({"lo": F.min("tid").over(w), "hi": F.max("tid").over(w), "c": F.sum("n").over(w)} | ({"twice": F.max("again").over(w)} if kind.own else {}))
    keys = keys.where("lo <> hi" + " or twice" * kind.own).select("tid", "key", (F.col("c") > HOT).alias("hot"))
    return keys.groupBy("tid").agg(F.collect_set("key").alias("keys"), F.collect_set(F.when(F.col("hot"), F.col("key"))).alias("hot"))


def _ranges(made: DataFrame, decided: DataFrame, kind: Kind) -> DataFrame:
    """(tid, removed): of each text the windows to remove, as (first window, number).

    All windows of a content's later places start earlier too; at its first place, those that its shard found.
    """
    first = [F.col("d").alias("fd"), *([F.col("start").alias("fs")] if kind.own else [])]
    found = made.join(decided.select("key", "c", *first, F.when(F.size("runs") > 0, F.col("runs")).alias("runs")), ["key", "c"])
    starts, whole = F.concat(F.array("start"), "more"), lambda at: F.struct(at.alias("at"), F.col("n").alias("n"))

    def each(at: Column) -> Column:
        """Of a content's place in its first document."""
        pairs = F.transform(F.sequence(F.lit(0), (F.size("runs") / 2).cast("int") - 1), lambda i: F.struct((at + F.get("runs", 2 * i)).alias("at"), F.get("runs", 2 * i + 1).alias("n")))
        pairs = F.when(F.size("runs") > 0, pairs).otherwise(F.array().cast("array<struct<at:bigint,n:bigint>>"))
        return F.when(at > F.col("fs"), F.array(whole(at))).otherwise(pairs) if kind.own else pairs

    found = found.where("d > fd or size(runs) > 0" + " or d = fd and (start > fs or size(more) > 0)" * kind.own)
    found = found.withColumn("r", F.when(F.expr("d > fd"), F.transform(starts, whole)).otherwise(F.flatten(F.transform(starts, each))))
    return found.groupBy("tid").agg(F.flatten(F.collect_list("r")).alias("removed"))


def without_repeats(docs: DataFrame, kind: Kind, decide: Callable, doc_id: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """Removes from each text the units in windows that also start earlier.

    Returns per row doc_id, n_units, n_removed, n_spans (runs of removed units) and
    kept_sha256 (of the units left; words joined by a space), and with ``with_text``
    kept_text (the text left; null where all of it is) and spans (first unit and number
    of each run, one after another). ``decide`` judges the contents of one shard. Null texts are empty;
    null ids count as the greatest; rows with one id are one document in the comparison,
    and repeated rows get equal results. Texts of fewer than k units stay whole. An
    empty table stays empty; other columns aren't read.
    """
    spark, name = ship(docs.sparkSession), f"sparkloom_{uuid.uuid4().hex}"
    try:
        return _without_repeats(docs, kind, decide, doc_id, text, with_text, name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def _without_repeats(docs: DataFrame, kind: Kind, decide: Callable, doc_id: str, text: str, with_text: bool, name: str) -> DataFrame:
    """The same, with the name of the one catalogue table that is made on the way."""
    spark = docs.sparkSession
    out = work_dir(spark)
    last, content = F.lit((1 << 63) - 1), F.coalesce(F.col(text), F.lit(""))
    hashed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), last).alias("d"), F.xxhash64(content).alias("h"), F.xxhash64(F.lit(7), content).alias("g"), content.alias("text"))
    light = keep(hashed.select("d", "h", "g"), f"{out}/hashes")
    tid, n_rows = _identity(light), light.count()
    firsts = keep(light.groupBy(tid.alias("tid")).agg(F.min("d").alias("first"), F.count(F.lit(1)).alias("copies")), f"{out}/firsts", n_rows)
    rows = hashed.select("doc_id", "d", tid.alias("tid"), "text")
    # of texts with very many copies (a thousand texts at most) only the first rows go on
    many = F.broadcast(firsts.where(F.col("copies") >= hot_least(n_rows)).select("tid", F.col("first").alias("_first")))
    few = rows.join(many, "tid", "left").where("_first is null or d = _first").select(*rows.columns)
    sets = keep(_wanted(few, kind).join(firsts.select("tid", "first"), "tid"), f"{out}/keys", n_rows, 1 << 14)
    release(spark)
    # texts move once, into buckets: the first row of each (repeated rows stay), with its keys
    chosen = few.join(sets, "tid").where("d = first")
    chosen = keep_bucketed(chosen.select("tid", "d", "text", "keys", "hot"), f"{out}/chosen", "tid", name)
    del sets
    drop(spark, f"{out}/keys")
    release(spark)
    made = keep(chosen.mapInArrow(_instances(kind), _INSTANCES), f"{out}/instances")
    places = made.groupBy("key", "c").agg(F.min(F.struct("d", "start", "tid", "n")).alias("f")).select("key", "c", "f.*")
    places = keep(places.groupBy("tid").agg(F.collect_list(F.struct("start", "n", "key", "c")).alias("places")), f"{out}/places", n_rows, 1 << 14)
    release(spark)
    contents = chosen.select("tid", "d", "text").join(places, "tid").select("d", "text", "places")
    contents = keep(contents.mapInArrow(_contents(kind), "key long, c long, d long, start long, content binary"), f"{out}/contents")
    del places
    drop(spark, f"{out}/places")
    release(spark)
    size = contents.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    sharded = contents.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    decided = keep(sharded.groupBy("shard").applyInArrow(_shard(decide, kind), "key long, c long, d long, start long, runs array<bigint>"), f"{out}/decided")
    del contents, sharded
    drop(spark, f"{out}/contents")
    release(spark)
    ranges = keep(_ranges(made, decided, kind), f"{out}/ranges", n_rows, 1 << 14)
    del made, decided
    drop(spark, f"{out}/instances", f"{out}/decided")
    release(spark)
    cut = "tid long, n_removed long, n_spans long, kept_sha256 string, spans array<bigint>, kept_text string"
    changed = chosen.select("tid", "text").join(ranges, "tid").mapInArrow(_cut(kind), cut)
    changed = keep((changed if with_text else changed.drop("kept_text", "spans")).dropDuplicates(["tid"]), f"{out}/changed", n_rows, 1 << 13)
    del chosen, ranges
    drop(spark, f"{out}/chosen", f"{out}/ranges")
    release(spark)
    whole = rows.select("doc_id", "tid", "text").mapInArrow(_whole(kind), "doc_id long, tid long, n_units long, whole_sha256 string")
    whole = join_salted(whole, firsts.select("tid", "first"), ["tid"], hot_keys(firsts, "tid", "copies", n_rows), F.monotonically_increasing_id())
    whole = keep(whole.withColumn("copy", (F.coalesce("doc_id", last) > F.col("first")) & (F.col("n_units") >= kind.k)), f"{out}/whole", n_rows, 1 << 14)
    # later copies go as a whole, and short texts stay: only others need what was found
    known = F.col("copy") | (F.col("n_units") < kind.k)
    none, zero = F.lit(hashlib.sha256(b"").hexdigest()), F.lit(0).cast("long")
    alike = whole.where(known).select(
        "doc_id", "n_units", F.when(F.col("copy"), F.col("n_units")).otherwise(zero).alias("n_removed"), F.when(F.col("copy"), 1).otherwise(0).cast("long").alias("n_spans"),
        F.when(F.col("copy"), none).otherwise(F.col("whole_sha256")).alias("kept_sha256"),
        *([F.when(F.col("copy"), F.lit("")).alias("kept_text"), F.when(F.col("copy"), F.array(zero, F.col("n_units"))).otherwise(F.array().cast("array<bigint>")).alias("spans")] if with_text else []),
    )
    others = whole.where(~known).join(changed, "tid", "left").select(
        "doc_id", "n_units", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"),
        *(["kept_text", F.coalesce("spans", F.array().cast("array<bigint>")).alias("spans")] if with_text else []),
    )
    return alike.unionAll(others)
