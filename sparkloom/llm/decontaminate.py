"""Benchmark decontamination with one Aho-Corasick automaton over normalised test texts.

The automaton's symbols are words, so that it finds whole words only, and it is held in plain
arrays: some twenty bytes a state. Many places of the texts go through it side by side.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from .common import drop, file_system, keep, settled, ship, slice_texts, utf8, work_dir

#: Words of a window.
WINDOW = 10
#: States that one automaton has, about, at most: some 20 bytes each, and as much again while it is made.
STATES = 4_000_000
#: Words of an item that are dealt together; a longer item is dealt in parts that overlap.
CHUNK = 20_000
#: Bytes of texts that go through the automaton in one go, and how many places of them side by side.
PIECE, LANES = 2 << 20, 4096
#: ASCII letters in lower case, all else that is ASCII and no digit as a space.
_TABLE = bytes(c + 32 if 65 <= c < 91 else c if c >= 128 or chr(c).isdigit() or 97 <= c < 123 else 32 for c in range(256))
_BYTES = np.frombuffer(_TABLE, np.uint8)


def words_of(text: bytes) -> list[bytes]:
    """Lower-cases A-Z and takes the words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``."""
    return text.translate(_TABLE).split()


class Automaton:
    """Aho-Corasick over words: patterns are all windows of the items, and whole items that are shorter.

    State 0 is the root. Most states have one way on, which two arrays hold; the ways of
    the few that branch are in a sorted table, the root's are an array by word.
    """

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        names = sorted({i for i, _ in items})
        number = {i: k for k, i in enumerate(names)}
        ids: dict[bytes, int] = {}
        texts, owners = [], []
        for i, text in items:
            if words := words_of(text):
                texts.append(np.array([ids.setdefault(w, len(ids) + 1) for w in words], np.int32))
                owners.append(number[i])
        self.names, self.window = names, window
        self.vocabulary = pa.array(list(ids), pa.binary())
        del ids
        n = np.array([len(t) for t in texts], np.int64)
        flat = np.concatenate([*texts, np.zeros(window, np.int32)]) if texts else np.zeros(window, np.int32)
        many = np.maximum(n - window + 1, 1)
        first = np.repeat(np.cumsum(n) - n - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        length, owner = np.minimum(np.repeat(n, many), window), np.repeat(np.array(owners, np.int64), many)
        del texts
        self._grow(flat, first, length)
        at = self._end(flat, first, length)
        self._items(at, owner)
        self._link()

    def _grow(self, flat: np.ndarray, first: np.ndarray, length: np.ndarray) -> None:
        """The states, level by level: a state is a pair of the one before and a word."""
        before, word, state, total = [np.zeros(1, np.int32)], [np.zeros(1, np.int32)], np.zeros(len(first), np.int32), 1
        self.levels = [0, 1]
        wide = len(self.vocabulary) + 1
        for k in range(int(length.max(initial=0))):
            on = np.flatnonzero(length > k)
            pairs, which = np.unique(state[on].astype(np.int64) * wide + flat[first[on] + k], return_inverse=True)
            before.append((pairs // wide).astype(np.int32))
            word.append((pairs % wide).astype(np.int32))
            state[on] = total + which
            total += len(pairs)
            self.levels.append(total)
        self.n = total
        self.before, self.word = np.concatenate(before), np.concatenate(word)
        self.root = np.zeros(wide, np.int32)
        if total > 1:
            self.root[self.word[1 : self.levels[2]]] = np.arange(1, self.levels[2])
        children = np.bincount(self.before[1:], minlength=total)
        children[0] = 0
        self.only_word, self.only = np.full(total, -1, np.int32), np.zeros(total, np.int32)
        deep = np.arange(self.levels[2] if total > 1 else total, total)
        single = deep[children[self.before[deep]] == 1]
        self.only_word[self.before[single]], self.only[self.before[single]] = self.word[single], single
        branch = deep[children[self.before[deep]] > 1]
        self.branches = children > 1
        self.keys = self.before[branch].astype(np.int64) * wide + self.word[branch]  # ascending, as states of a level are
        self.to = branch.astype(np.int32)
        self.wide = wide

    def _end(self, flat: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        state = np.zeros(len(first), np.int32)
        for k in range(int(length.max(initial=0))):
            on = np.flatnonzero(length > k)
            state[on] = self._child(state[on], flat[first[on] + k])
        return state

    def _items(self, at: np.ndarray, owner: np.ndarray) -> None:
        """The items of each state that ends a pattern."""
        pairs = np.unique(at.astype(np.int64) * max(1, len(self.names)) + owner)
        ends = pairs // max(1, len(self.names))
        self.item = (pairs % max(1, len(self.names))).astype(np.int32)
        self.ends, first = np.unique(ends, return_index=True)
        self.bounds = np.append(first, len(pairs))

    def _link(self) -> None:
        """Failure links by level, and from each state to the longest pattern that it ends in."""
        self.fail = np.zeros(self.n, np.int32)
        self.out = np.zeros(self.n, np.int32)
        terminal = np.zeros(self.n, bool)
        terminal[self.ends] = True
        self.depth = np.zeros(self.n, np.uint8)
        for k, (a, b) in enumerate(zip(self.levels[1:], self.levels[2:]), 1):
            self.depth[a:b] = k
            if k > 1:
                self.fail[a:b] = self.step(self.fail[self.before[a:b]], self.word[a:b])
            self.out[a:b] = np.where(terminal[a:b], np.arange(a, b), self.out[self.fail[a:b]])
        del self.before, self.word

    def _child(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The state after ``word``; 0 where there is none (from the root too, where the word begins nothing)."""
        out = np.where(self.only_word[state] == word, self.only[state], 0)
        at = state == 0
        out[at] = self.root[word[at]]
        on = np.flatnonzero(self.branches[state])
        if len(on):
            key = state[on].astype(np.int64) * self.wide + word[on]
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out[on] = np.where(self.keys[k] == key, self.to[k], 0)
        return out

    def step(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """One word on, by way of failure links where a state has no way on. Changes ``state``."""
        out = self._child(state, word)
        left = np.flatnonzero((out == 0) & (state != 0))
        while len(left):
            state[left] = self.fail[state[left]]
            out[left] = self._child(state[left], word[left])
            left = left[(out[left] == 0) & (state[left] != 0)]
        return out

    def scan(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of word numbers (0: none of the vocabulary): ends (positions) of all occurrences, and the states that end them."""
        n = len(words)
        if not n or self.n == 1:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        each = max(8 * self.window, -(-n // LANES))
        lanes = -(-n // each)
        ahead = self.window - 1  # a lane begins earlier by what a state may depend on
        padded = np.concatenate([np.zeros(ahead, words.dtype), words, np.zeros(lanes * each - n, words.dtype)])
        columns = np.lib.stride_tricks.sliding_window_view(padded, each + ahead)[::each].T
        state, found = np.zeros(lanes, np.int32), []
        for k in range(each + ahead):
            state = self.step(state, np.ascontiguousarray(columns[k]))
            if k >= ahead:
                hit = self.out[state]
                on = np.flatnonzero(hit)
                while len(on):
                    found.append((on * each + (k - ahead), hit[on]))
                    hit = self.out[self.fail[hit]]
                    on = np.flatnonzero(hit)
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        return tuple(np.concatenate(x) for x in zip(*found))

    def size(self) -> int:
        """Bytes of all arrays."""
        return sum(x.nbytes for x in vars(self).values() if hasattr(x, "nbytes"))

    def judge(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of some texts: words of each; row, first word and word after the last of each occurrence; row and number of each item found."""
        normal = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(_BYTES[data])])
        split = pc.ascii_split_whitespace(normal)
        flat, bounds = split.values, split.offsets.to_numpy().astype(np.int64)
        some = np.flatnonzero(pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0)  # white space at an end makes empty ones
        first = np.searchsorted(some, bounds)
        numbers = pc.index_in(flat.take(pa.array(some)).view(pa.large_binary()), value_set=self.vocabulary.cast(pa.large_binary()))
        numbers = pc.fill_null(numbers, -1).to_numpy(zero_copy_only=False).astype(np.int32) + 1
        rows = len(offsets) - 1
        row = np.repeat(np.arange(rows), np.diff(first))
        spaced = np.zeros(len(numbers) + rows, np.int32)  # a word of no vocabulary between texts
        spaced[np.arange(len(numbers)) + row] = numbers
        end, state = self.scan(spaced)
        base = first + np.arange(rows + 1)
        row = np.searchsorted(base, end, "right") - 1
        end = end - base[row] + 1
        which = np.searchsorted(self.ends, state)
        many = self.bounds[which + 1] - self.bounds[which]
        item = self.item[np.repeat(self.bounds[which] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
        pairs = np.unique(np.repeat(row, many) * max(1, len(self.names)) + item)
        return np.diff(first), row, end - self.depth[state], end, pairs // max(1, len(self.names)), pairs % max(1, len(self.names))


def merged(ranges) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def spans_of(text: bytes, ranges) -> list[tuple[int, int]]:
    """Word ranges as code point ranges of the original text."""
    data = np.frombuffer(text, np.uint8)
    word = np.concatenate([[False], _BYTES[data] != 32, [False]])
    edge = np.flatnonzero(word[1:] != word[:-1])
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
    return [(int(before[edge[2 * a]]), int(before[edge[2 * b - 1]])) for a, b in ranges]


_RESIDENT: dict[str, Automaton] = {}


def resident(path: str, window: int) -> Automaton:
    """The automaton of the items in a folder; a worker holds one."""
    from pyarrow import fs, parquet

    if path not in _RESIDENT:
        _RESIDENT.clear()
        store, at = file_system(path)
        files = sorted(f.path for f in store.get_file_info(fs.FileSelector(at, allow_not_found=True)) if f.path.endswith(".parquet"))
        tables = [parquet.read_table(f, columns=["i", "t"], filesystem=store) for f in files]
        items = [x for t in tables for x in zip(t.column("i").to_pylist(), t.column("t").to_pylist())]
        _RESIDENT[path] = Automaton(items, window)
    return _RESIDENT[path]


def _chunks(window: int):
    """Of batches (item, text): normalised parts of at most CHUNK words that hold all windows."""

    def run(batches):
        for b in batches:
            out = {"i": [], "k": [], "n": [], "t": []}
            for i, t in zip(b.column(0).to_pylist(), slice_texts(*utf8(b.column(1)))):
                words = words_of(t)
                for s in range(0, len(words), CHUNK):
                    part = words[s : s + CHUNK + window - 1]
                    if s == 0 or len(part) >= window:
                        for c, v in zip(out.values(), (i, s, len(part), b" ".join(part))):
                            c.append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("i", pa.string()), ("k", pa.int64()), ("n", pa.int64()), ("t", pa.binary())]))

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", item_id: str = "item_id", item_text: str = "text", states: int = STATES) -> DataFrame:
    """Marks the words of ``docs`` that lie in an occurrence of a benchmark window.

    Adds _n_words, _n_hit (long), _spans (hit code point ranges of the original text)
    and _items (ids, as strings, of the items with occurring windows, sorted); a column
    of ``docs`` with such a name is replaced, others pass through. A window is ``window``
    consecutive words of an item, or a whole shorter item. Null or empty texts have no
    words. Items without id or words never match; an empty benchmark hits nothing; an empty
    table stays empty. Repeated rows are kept and judged alike, and so are repeated items.

    One automaton has at most about ``states`` states, and a worker holds one. The items
    reach the workers by the shared folder, never by the driver. A benchmark for which
    that is too little is dealt over several automata, one pass over the texts each.
    """
    spark = ship(docs.sparkSession)
    out = work_dir(spark)
    items = benchmark.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t"))
    parts = keep(items.mapInArrow(_chunks(window), "i string, k long, n long, t binary"), f"{out}/parts")
    total = parts.agg(F.sum("n")).first()[0] or 0
    # half full on average, so that chance puts none above
    blocks = 1 if total * window <= states else -(-2 * total * window // states)
    if blocks > 1:
        parts.repartition(F.pmod(F.xxhash64("i", "k"), F.lit(blocks))).withColumn("block", F.pmod(F.xxhash64("i", "k"), F.lit(blocks))).write.partitionBy("block").parquet(f"{out}/blocks")
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    added = [T.StructField("_n_words", T.LongType()), T.StructField("_n_hit", T.LongType()), T.StructField("_spans", span), T.StructField("_items", T.ArrayType(T.StringType()))]
    rest = docs.drop(*(f.name for f in added))
    through, schema = rest.columns, T.StructType([*rest.schema.fields, *added])

    def passed(path: str, first: bool, last: bool):
        """One pass; between passes _spans holds ranges of words."""

        def run(batches):
            a = resident(path, window)
            for b in batches:
                data, offsets = utf8(b.column(text))
                old = ([[] for _ in range(len(b))], [[] for _ in range(len(b))]) if first else ([[(x["start"], x["end"]) for x in r] for r in b.column("_spans").to_pylist()], b.column("_items").to_pylist())
                ranges, names, n_words = [set(x) for x in old[0]], [set(x) for x in old[1]], np.zeros(len(b), np.int64)
                i = 0
                while i < len(b):
                    j = min(len(b), max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE, "right")) - 1))
                    part = offsets[i : j + 1]
                    n_words[i:j], row, start, end, of, item = a.judge(data[part[0] : part[-1]], part - part[0])
                    for r, s, e in zip(row.tolist(), start.tolist(), end.tolist()):
                        ranges[i + r].add((s, e))
                    for r, k in zip(of.tolist(), item.tolist()):
                        names[i + r].add(a.names[k])
                    i = j
                ranges = [merged(r) for r in ranges]
                n_hit = [sum(y - x for x, y in r) for r in ranges]
                if last:
                    ranges = [spans_of(data[offsets[k] : offsets[k + 1]].tobytes(), r) if r else [] for k, r in enumerate(ranges)]
                spans = pa.array([[{"start": x, "end": y} for x, y in r] for r in ranges], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
                columns = [pa.array(n_words), pa.array(n_hit, pa.int64()), spans, pa.array([sorted(x) for x in names], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in through), *columns], schema.names)

        return settled(run)

    paths = [f"{out}/parts"] if blocks == 1 else [f"{out}/blocks/block={k}" for k in range(blocks)]
    now = rest
    for k, path in enumerate(paths):
        now = now.mapInArrow(passed(path, k == 0, k == len(paths) - 1), schema)
        if k < len(paths) - 1:  # a stage of its own, so that one automaton is in memory at a time
            now = keep(now, f"{out}/pass-{k}")
            if k:
                drop(spark, f"{out}/pass-{k - 1}")
    return now


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", F.col("_n_words").alias("n_words"), F.col("_n_hit").alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"), (F.col("_n_hit") > 0).alias("contaminated"),
    )


def brute(docs: list[tuple], items: list[tuple], window: int = WINDOW) -> list[tuple]:
    """The rows of op6 by plain loops, for tests."""
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    norm = lambda t: word.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    grams = [(str(i), [w[k : k + window] for k in range(max(1, len(w) - window + 1))]) for i, t in items if (w := norm(t))]
    out = []
    for d, t in docs:
        w = norm(t)
        hit, ids = set(), set()
        for i, gs in grams:
            for g in gs:
                for k in range(len(w) - len(g) + 1):
                    if w[k : k + len(g)] == g:
                        hit.update(range(k, k + len(g)))
                        ids.add(i)
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out
