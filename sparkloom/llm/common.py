"""What the operators of this package share: the shared folder, code shipping, word spans and hashes.

Executors may be lost at any time, so anything that a later job reads again is a
table or file in the folder that ``spark.checkpoint.dir`` names, never executor-local state.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import session

#: Rows and bytes of an Arrow batch: they bound a Python worker's memory when texts are long.
BATCH_ROWS, BATCH_BYTES = 1000, "4m"
#: Bytes that the vectorised word functions look at in one go.
BLOCK = 1 << 19


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors' Python workers, and sets how much they get at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return session.ship(spark)


def work_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; Spark deletes it when the application ends.

    Where that setting is unset, as in tests, a folder of the driver's machine is set.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or _own_dir(spark)
    path = f"{top.rstrip('/')}/sparkloom-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return str(fs.makeQualified(p).toString()).replace("file:/", "file:///", 1).replace("file://///", "file:///")


def _own_dir(spark: SparkSession) -> str:
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    top = spark.conf.get("sparkloom.work.dir", None)
    if not top:
        spark.conf.set("sparkloom.work.dir", top := "file://" + tempfile.mkdtemp(prefix="sparkloom-"))
    return top


#: For tables that are soon read and deleted: where the shared folder is on a mounted file system, Hadoop
#: starts some five processes for each file that it writes (its mode, a checksum file, that one's mode), so.
LEAN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true", "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}


def keep(df: DataFrame, path: str, rows: int | None = None, each: int = 1 << 19) -> DataFrame:
    """Writes a table and reads it back: cuts lineage so that lost executors cost no recomputation.

    Where the table has ``rows`` rows at most, it is written in no more files than there are
    cores, or than these rows need at ``each``, however many partitions its making has.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-int(rows) // each)))
    df.write.mode("overwrite").options(**LEAN).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep_bucketed(df: DataFrame, path: str, key: str, name: str) -> DataFrame:
    """Writes a table in buckets of ``key``, so that later joins on it don't move its rows, under a name that the caller drops."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").options(**LEAN).option("path", path).bucketBy(n, key).saveAsTable(name)
    return spark.table(name)


#: Parts that the rows of a hot key are dealt in, and a number that stands for no hot key at all.
SALTS, NO_KEY = 64, -(1 << 63)


def hot_least(total: int) -> int:
    """Rows from which on a key is hot: a thousandth of all, so that a thousand keys are at most."""
    return max(100, -(-int(total) // 1000))


def hot_keys(counts: DataFrame, key: str, n: str, total: int) -> list[int]:
    """The keys with a thousandth of all rows or more, from a table with one row of each: a thousand at most."""
    return [r[0] for r in counts.where(F.col(n) >= hot_least(total)).select(key).limit(1000).collect()]


def join_salted(left: DataFrame, right: DataFrame, keys: list[str], hot: list[int], spread: Column, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has one row of each key.

    Rows of ``left`` whose first key is ``hot`` are dealt by ``spread`` over SALTS parts,
    and ``right``'s row goes to each part; so no key is one task. What is in ``hot`` has
    no effect on the result. The values of ``spread`` mustn't depend on a run.
    """
    on = F.col(keys[0]).isin([*hot, NO_KEY])
    dealt = left.withColumn("_salt", F.when(on, F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(F.lit(0)))
    each = right.withColumn("_salt", F.explode(F.when(on, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(each, [*keys, "_salt"], how).select(*left.columns, *[c for c in right.columns if c not in keys])


def drop(spark: SparkSession, *paths: str) -> None:
    """Deletes written tables that no later step reads."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of plans that nothing refers to any more.

    It acts on the driver's garbage collection, which a large heap may put off for hours
    while executors' disks fill.
    """
    for _ in range(2):  # what the first frees may hold the last reference to more
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def settled(run):
    """A task's function that gives memory back when the task ends: its worker goes on to serve other operators."""

    @wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return whole


def file_system(uri: str):
    """The pyarrow file system of a URI and the path on it; works for local, HDFS and object stores."""
    from pyarrow import fs

    return fs.FileSystem.from_uri("s3" + uri[3:] if uri.startswith(("s3a:", "s3n:")) else uri)


def write_once(uri: str, chunks) -> int:
    """Writes bytes under a temporary name, then renames: a task that runs twice leaves one whole file."""
    store, path = file_system(uri)
    temp, n = f"{path}.{uuid.uuid4().hex}.tmp", 0
    with store.open_output_stream(temp, compression=None) as out:
        for c in chunks:
            out.write(c)
            n += len(c)
    store.move(temp, path)
    return n


def read_bytes(uri: str) -> bytes:
    store, path = file_system(uri)
    with store.open_input_stream(path, compression=None) as f:
        return f.read()


def partitions_for(spark: SparkSession, n_bytes: float, each: int = 8 << 20) -> int:
    """Tasks so that each gets about ``each`` bytes; at least the session's parallelism."""
    return int(max(spark.sparkContext.defaultParallelism, min(200_000, -(-n_bytes // each))))


def input_bytes(df: DataFrame) -> float:
    """Catalyst's estimate of a plan's size."""
    n = float(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return n if n < 1 << 60 else 0.0


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column (null: empty) and the offsets of its rows in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, o, d = column.buffers()
    offsets = np.frombuffer(o, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = np.frombuffer(d, np.uint8) if d is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


#: True for bytes that are no white space: not \x20 and not \x09-\x0D.
WORD_BYTE = np.ones(256, bool)
WORD_BYTE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Bytes with A-Z in lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (byte positions) of all words, and for each row the index of its first word (one more at the end)."""
    word = WORD_BYTE[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0], edge[-1] = len(data) > 0 and word[0], len(data) > 0 and word[-1]
    edge[1:-1] = word[1:] != word[:-1]
    # a row's end parts two words that touch there
    cut = offsets[1:-1]
    cut = np.unique(cut[(cut > 0) & (cut < len(data))])
    cut = cut[word[cut] & word[cut - 1]] if len(cut) else cut
    at = np.flatnonzero(edge)
    if len(cut):
        at = np.sort(np.concatenate([at, cut, cut]))
    starts, ends = at[::2], at[1::2]
    return starts, ends, np.searchsorted(starts, offsets)


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, in place."""
    t = x >> np.uint64(30)
    x ^= t
    x *= _M1
    np.right_shift(x, np.uint64(27), out=t)
    x ^= t
    x *= _M2
    np.right_shift(x, np.uint64(31), out=t)
    x ^= t
    return x


def _powers(n: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = _powers(1 << 12)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, other: bool = False) -> np.ndarray:
    """A 64-bit hash of each word, of one of two families. Works in blocks, so that memory doesn't grow with a text's length."""
    by_place = _LOOSE if other else _POW
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, "right")))
        s, e = starts[i:j], ends[i:j]
        if j == i + 1 and e[0] - s[0] > BLOCK:
            h = 0
            for k in range(int(s[0]), int(e[0]), BLOCK):  # one huge word
                part = data[k : min(k + BLOCK, int(e[0]))]
                part = LOWER[part] if lower else part
                h = (h * 0xD6E8FEB86659FD93 + int(mix(np.array([int((part * by_place[np.arange(len(part)) & 4095]).sum(dtype=np.uint64))], np.uint64))[0])) % (1 << 64)
            out[i] = h
        else:
            part = data[s[0] : e[-1]]
            part = LOWER[part] if lower else part
            rel, length = s - s[0], e - s
            gap = np.append(rel[1:], len(part)) - rel
            pos = np.arange(len(part)) - np.repeat(rel, gap)
            v = (part.astype(np.uint64) + np.uint64(1)) * by_place[pos & 4095]
            v[pos >= np.repeat(length, gap)] = 0
            out[i:j] = np.add.reduceat(v, rel) + length.astype(np.uint64) * np.uint64(_GOLD)
        i = j
    return mix(out)


#: Coefficients by position without any structure, so that what collides in one family of hashes doesn't in the other.
_LOOSE = mix(np.arange(1, 4097, dtype=np.uint64)) | np.uint64(1)

_STEP = [np.uint64((_GOLD * (2 * k + 1) * 0x2545F4914F6CDD1D + 2 * k) % (1 << 64) | 1) for k in range(64)]


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each n consecutive words; there are len(h) - n + 1."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = h[:m] * _STEP[0]
    for k in range(1, n):
        out += h[k : k + m] * _STEP[k]
    return mix(out)


def slide_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values."""
    have, out = 1, x
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(x) - w + 1], out[w - have : len(x) - have + 1]) if have < w else out


def blocks_of_rows(offsets: np.ndarray, size: int = BLOCK):
    """(first, last + 1) of consecutive rows of about ``size`` bytes; a longer row comes alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = j


def slice_texts(data: np.ndarray, offsets: np.ndarray):
    """The bytes of each row."""
    whole = data.tobytes()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield whole[a:b]
