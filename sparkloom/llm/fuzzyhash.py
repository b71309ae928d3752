"""Context-triggered piecewise hashing: rolling-hash boundaries cut a text into chunks, whose hashes form a signature."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import input_bytes, keep, partitions_for, ship, slice_texts, utf8, work_dir

#: Bytes of the rolling window.
ROLL = 7
#: Block sizes are 4, 8, 16, ... bytes; the one taken gives about 32 to 64 chunks.
LEAST_LEVEL, WANTED, MOST = 2, 32, 64
#: Bytes that are hashed in one go: bounds memory on long texts.
STEP = 1 << 20
_BASE = np.uint32(0x01000193)
_DIGITS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)


def _boundaries(text: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Levels of the boundaries (those of block size 2**LEAST_LEVEL and up), the sum of window hashes up to each, and the whole sum.

    A boundary of block size 2**k is one of all smaller block sizes.
    """
    levels, sums, total = [], [], 0
    data = np.frombuffer(bytes(ROLL - 1) + text, np.uint8)
    for k in range(0, len(text), STEP):
        part = data[k : k + STEP + ROLL - 1].astype(np.uint32)
        n = len(part) - ROLL + 1
        h = part[:n] + np.uint32(1)
        for j in range(1, ROLL):
            h *= _BASE
            h += part[j : j + n]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(12)
        h *= np.uint32(0x297A2D39)
        h ^= h >> np.uint32(15)
        at = np.flatnonzero((h & np.uint32((1 << LEAST_LEVEL) - 1)) == 0)
        run = np.cumsum(h, dtype=np.uint32)
        low = h[at] | np.uint32(1 << 30)
        levels.append(np.bitwise_count((low & (~low + np.uint32(1))) - np.uint32(1)))
        sums.append(run[at] + np.uint32(total))
        total = (total + int(run[-1])) & 0xFFFFFFFF if n else total
    return np.concatenate(levels), np.concatenate(sums), total


def _codes(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
    return (h ^ h >> np.uint32(13)) >> np.uint32(20)


def _fourth(code: np.ndarray, period: int) -> np.ndarray:
    """Which chunks end a fourth or later round of the same ``period`` chunks."""
    out = np.zeros(len(code), bool)
    if len(code) > 3 * period:
        differ = np.concatenate([[0], np.cumsum(code[period:] != code[:-period])])
        out[4 * period - 1 :] = differ[3 * period :] == differ[: -3 * period]
    return out


def _signature(sums: np.ndarray, total: int) -> str:
    """Two characters for each chunk; a run of equal chunks counts three times at most.

    Where more than MOST are left, so do rounds of several chunks; of what is left then, the last of MOST chunks is all the rest.
    """
    ends = np.append(sums, np.uint32(total))
    code = _codes(np.diff(ends, prepend=np.uint32(0)).astype(np.uint32))
    for period in range(1, MOST // 4 + 1):
        if period > 1 and len(code) <= MOST:
            break
        gone = _fourth(code, period)
        code, ends = code[~gone], ends[~gone]
    if len(code) > MOST:
        code = np.append(code[: MOST - 1], _codes(np.array([total], np.uint32) - ends[MOST - 2 : MOST - 1]))
    return _DIGITS[np.stack([code >> np.uint32(6), code & np.uint32(63)], 1).reshape(-1)].tobytes().decode()


def fingerprint(text: bytes) -> str:
    """``level:signature:signature`` at block sizes 2**level and twice that. The empty text has ``0::``."""
    if not text:
        return "0::"
    levels, sums, total = _boundaries(text)
    counts = np.bincount(levels, minlength=LEAST_LEVEL + 2)[::-1].cumsum()[::-1]  # boundaries of each level or above
    enough = np.flatnonzero(counts >= WANTED)
    k = max(LEAST_LEVEL, int(enough[-1])) if len(enough) else LEAST_LEVEL
    return f"{k}:{_signature(sums[levels >= k], total)}:{_signature(sums[levels > k], total)}"


def _common(a: str, b: str) -> int:
    """Length, in chunks, of the longest common subsequence of two signatures, by bit-parallel rows."""
    xs = [a[i : i + 2] for i in range(0, len(a), 2)]
    at: dict[str, int] = {}
    for i, x in enumerate(xs):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(xs)) - 1
    v = full
    for i in range(0, len(b), 2):
        if m := at.get(b[i : i + 2]):
            u = v & m
            v = (v + u | v - u) & full
    return len(xs) - v.bit_count()


def likeness(f: str, g: str) -> float:
    """1 less the edit distance (insertions and deletions) over both lengths, at the block sizes that both have; 0 if none is."""
    if f == g:
        return 1.0
    k, a1, a2 = f.split(":")
    j, b1, b2 = g.split(":")
    k, j = int(k), int(j)
    pairs = {0: [(a1, b1), (a2, b2)], 1: [(a2, b1)], -1: [(a1, b2)]}.get(j - k, [])
    return max((4 * _common(a, b) / (len(a) + len(b)) for a, b in pairs if a and b), default=0.0)


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many (or all) of the next text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def compare_with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints each text and its edited text, in descending doc_id order (equal ids by text, null ids last).

    Null texts are empty. The one document of a one-row table follows itself; an empty
    table gives no rows; other columns aren't returned. Rows are range-partitioned, so
    each task meets neighbours; only a task's first and last row wait for the task
    beside it, in a small second job over the written table.
    """
    spark = ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    n = partitions_for(spark, input_bytes(docs))
    order = [F.col("doc_id").desc_nulls_last(), F.col("t").asc()]
    ordered = rows.repartitionByRange(n, F.col("doc_id").desc_nulls_last(), F.xxhash64("t")).sortWithinPartitions(F.col("doc_id").desc_nulls_last(), F.xxhash64("t"), order[1])
    columns = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
    shape = pa.schema([*columns, ("part", pa.int64()), ("head", pa.bool_()), ("tail", pa.bool_()), ("text", pa.string())])

    def pair(d, text, mine, following, after):
        e = edited(text, following).encode()
        f = fingerprint(e)
        return (d, len(text), hashlib.sha256(e).hexdigest(), mine, f, likeness(mine, f), likeness(mine, after))

    def run(batches):
        from pyspark import TaskContext

        part, before, out, first = TaskContext.get().partitionId(), None, [], True
        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), slice_texts(*utf8(b.column(1)))):
                now = (d, t.decode("utf-8", "replace"), fingerprint(t))
                if before:
                    out.append((*pair(*before, now[1], now[2]), part, False, False, None))
                if first:
                    out.append((d, None, None, now[2], None, None, None, part, True, False, now[1]))
                first, before = False, now
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist([dict(zip(shape.names, r)) for r in out], shape)
                out = []
        if before:
            out.append((before[0], None, None, before[2], None, None, None, part, False, True, before[1]))
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(shape.names, r)) for r in out], shape)

    kinds = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    made = keep(ordered.mapInArrow(run, f"{kinds}, part long, head boolean, tail boolean, text string"), f"{work_dir(spark)}/pairs")
    parts = sorted(r.part for r in made.where("head").select("part").collect())  # one number for each task
    following = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part long, next long")
    heads = made.where("head").select(F.col("part").alias("next"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_print"))
    ends = made.where("tail").select("part", "doc_id", "text", "fingerprint").join(following, "part").join(heads, "next").select("doc_id", "text", "fingerprint", "next_text", "next_print")

    def finish(batches):
        for b in batches:
            out = [pair(*r) for r in zip(*(c.to_pylist() for c in b.columns))]
            yield pa.RecordBatch.from_pylist([dict(zip(shape.names[:7], r)) for r in out], pa.schema(columns))

    return made.where("not head and not tail").select(*[c for c, _ in columns]).unionAll(ends.mapInArrow(finish, kinds))


def op3_fuzzy_hash(spark, sf_dir: str) -> DataFrame:
    return compare_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def brute(rows: list[tuple]) -> dict:
    """What compare_with_next gives, by one loop over (doc_id, text) pairs with different ids, for tests."""
    rows = sorted(((d, t or "") for d, t in rows), reverse=True)
    out = {}
    for (d, t), (_, u) in zip(rows, rows[1:] + rows[:1]):
        f, g, h = (fingerprint(x.encode()) for x in (t, edited(t, u), u))
        out[d] = (len(t), hashlib.sha256(edited(t, u).encode()).hexdigest(), f, g, likeness(f, g), likeness(f, h))
    return out
