"""Suffix-array dedup by external induced sorting.

Suffixes are sorted as eSAIS does: the suffixes that begin at leftmost S-type positions are
ordered by their substrings' names, recursively; from them the L-type and then the S-type suffixes are
induced by queues with one lane for each first byte, taken in order. What goes through a
queue is a tuple of a suffix and the length of its common prefix with the one before it;
the prefixes of induced suffixes follow from range minima over those that induce them. A
queue beyond its share of memory writes its lanes to files and reads them when their turn comes.
In the recursion symbols are names, of which there are many: there a lane holds a range of them.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import partial

import numpy as np
from pyspark.sql import DataFrame

from .common import work_dir
from .repeats import Kind, without_repeats

#: Bytes of a window, and of the grams that choose shards.
WINDOW, GRAM = 50, 20
#: Bytes of queued tuples that stay in memory.
QUEUE_BYTES = 96 << 20
#: Suffixes that a lane of the recursion holds, about, unless one symbol has more.
RANGE = 1 << 16


class Lanes:
    """A monotone priority queue: one first-in first-out lane for each first symbol."""

    def __init__(self, budget: int, spill_to: str | None):
        self.budget, self.spill_to, self.size = budget, spill_to, 0
        self.memory: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.files: dict[int, list[tuple[str, int, int]]] = {}
        self.written: list[str] = []

    def push(self, symbol: int, at: np.ndarray, common: np.ndarray) -> None:
        self.memory.setdefault(symbol, []).append((at.astype(np.int32), common.astype(np.uint8)))
        self.size += 5 * len(at)
        if self.size > self.budget and self.spill_to:
            self._spill()

    def _spill(self) -> None:
        from .common import file_system

        uri, place = f"{self.spill_to}/lanes-{uuid.uuid4().hex}", 0
        store, path = file_system(uri)
        self.written.append(uri)
        with store.open_output_stream(path, compression=None) as f:
            for symbol, parts in self.memory.items():
                at, common = (np.concatenate(x) for x in zip(*parts))
                f.write(at.tobytes() + common.tobytes())
                self.files.setdefault(symbol, []).append((uri, place, len(at)))
                place += 5 * len(at)
        self.memory, self.size = {}, 0

    def has(self, symbol: int) -> bool:
        return symbol in self.memory or symbol in self.files

    def pop(self, symbol: int) -> tuple[np.ndarray, np.ndarray]:
        from .common import file_system

        parts = []
        for uri, place, n in self.files.pop(symbol, []):
            store, path = file_system(uri)
            with store.open_input_file(path) as f:
                raw = f.read_at(5 * n, place)
            parts.append((np.frombuffer(raw, np.int32, n), np.frombuffer(raw, np.uint8, n, 4 * n)))
        held = self.memory.pop(symbol, [])
        self.size -= sum(5 * len(a) for a, _ in held)
        parts += held
        if not parts:
            return np.zeros(0, np.int32), np.zeros(0, np.uint8)
        return tuple(np.concatenate(x) for x in zip(*parts))

    def close(self) -> None:
        from .common import file_system

        for uri in self.written:
            store, path = file_system(uri)
            store.delete_file(path)


def _types(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each suffix is S-type, and how long the run of its first symbol is. The last symbol is the single least one."""
    n = len(text)
    differ = text[:-1] != text[1:]
    last = np.where(differ, np.arange(n - 1), n - 1)
    last = np.minimum.accumulate(last[::-1])[::-1]
    small = np.ones(n, bool)
    small[:-1] = text[last] < text[np.minimum(last + 1, n - 1)]
    run = np.ones(n, np.int64)
    run[:-1] = last - np.arange(n - 1) + 1
    return small, run


def _names(text: np.ndarray, small: np.ndarray, lms: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the substrings from each leftmost S position to the next, looking at ``depth`` symbols at most."""
    n = len(text)
    length = np.append(np.diff(lms) + 1, 1)
    bits = (2 * int(text.max(initial=0)) + 1).bit_length()
    per = max(1, 60 // bits)
    name, active = np.zeros(len(lms), np.int64), np.arange(len(lms))  # how many are less, as far as they were looked at
    for done in range(0, depth, per):
        active = active[length[active] > done]
        if not len(active):
            break
        key = np.zeros(len(active), np.int64)
        for q in range(done, done + per):
            at = np.minimum(lms[active] + q, n - 1)
            code = np.where(length[active] > q, text[at].astype(np.int64) * 2 + small[at], 0)
            key = key << bits | code
        name[active] = _refined(name[active], key)
    return _dense(name)


def _refined(name: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Names told apart by keys. Each counts those that are less, so that names elsewhere, which aren't looked at any more, keep their order."""
    order = np.lexsort((key, name))
    a, b = name[order], key[order]
    other = np.concatenate([[True], a[1:] != a[:-1]])
    at = np.arange(len(order))
    out = np.empty(len(order), np.int64)
    out[order] = a + np.maximum.accumulate(np.where(other | np.concatenate([[True], b[1:] != b[:-1]]), at, 0)) - np.maximum.accumulate(np.where(other, at, 0))
    return out


def _dense(key: np.ndarray) -> np.ndarray:
    """Ranks of integers, from 0; equal ones share a rank."""
    order = np.argsort(key, kind="stable")
    x = key[order]
    out = np.empty(len(key), np.int64)
    out[order] = np.concatenate([[0], np.cumsum(x[1:] != x[:-1])]) if len(x) else 0
    return out


def reduced_sort(text: np.ndarray, depth: int, queue_bytes: int, spill_to: str | None, level: int = 1) -> np.ndarray:
    """Suffixes of a text of names in order, exact to ``depth`` symbols at least. ``text`` ends in 0, which comes up nowhere else."""
    n = len(text)
    many = np.bincount(text)
    if depth <= 1 or many.max() == 1:
        return np.argsort(text, kind="stable")
    small, _ = _types(text)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    seeds = lms[_seed_order(text, small, lms, depth, queue_bytes, spill_to, level)]
    lane_of = ((np.cumsum(many) - many) // RANGE)[text]  # of each position
    by_lane = np.argsort(lane_of, kind="stable")
    bounds = np.searchsorted(lane_of[by_lane], np.arange(int(lane_of.max()) + 2))
    seed_lane = lane_of[seeds]
    seed_bounds = np.searchsorted(seed_lane, np.arange(len(bounds)))
    place = np.zeros(n, np.int64)  # where a position stands among those of its lane
    larger, out = [], []
    lanes = Lanes(queue_bytes, spill_to)
    for j in range(len(bounds) - 1):
        own = by_lane[bounds[j] : bounds[j + 1]]
        more = seeds[seed_bounds[j] : seed_bounds[j + 1]]
        large = own[~small[own]]
        done = _emitted(text, lane_of, place, large, lanes.pop(j)[0], more, j)
        larger.append(done[~small[done]])
        _send(lane_of, small, j, done, lanes, False)
    lanes.close()
    lanes = Lanes(queue_bytes, spill_to)
    for j in range(len(bounds) - 2, -1, -1):
        own = by_lane[bounds[j] : bounds[j + 1]]
        popped = lanes.pop(j)[0] if j or lanes.has(0) else np.zeros(0, np.int64)
        if j == 0:  # the end comes last of all
            popped = np.append(popped, n - 1)
        done = _emitted(text, lane_of, place, own[small[own]], popped, larger[j][::-1], j, down=True)
        out.append(done)
        _send(lane_of, small, j, done, lanes, True)
    lanes.close()
    return np.concatenate(out)[::-1]


def _emitted(text, lane_of, place, members, popped, given, lane: int, down: bool = False) -> np.ndarray:
    """A lane's suffixes in the order of emission (descending, ``down``).

    ``members`` are to be ordered: by symbol, and under one symbol those from the queue
    (``popped``, in order) before those that suffixes of this lane itself induce, which
    follow their inducers. ``given`` are those of the other type, in order, which come
    after the members of their symbol. Chains of inducers are followed by doubling.
    """
    popped = popped.astype(np.int64)
    whole = np.concatenate([members, given])
    m = len(whole)
    if not m:
        return whole
    place[whole] = np.arange(m)
    symbol = text[whole].astype(np.int64)
    symbol = _dense(-symbol if down else symbol)
    given_rank = np.concatenate([np.zeros(len(members), np.int64), np.arange(1, len(given) + 1)])
    local = np.full(m, len(popped) + 1, np.int64)  # those that this lane induces follow all popped ones
    local[place[popped]] = np.arange(1, len(popped) + 1)
    local[len(members) :] = len(popped) + 1 + given_rank[len(members) :]
    rank = _dense(symbol * (int(local.max()) + 1) + local)
    after = np.minimum(whole + 1, len(text) - 1)
    before = np.where(lane_of[after] == lane, place[after], -1)
    before[len(members) :] = -1
    before[place[popped]] = -1
    while (before >= 0).any():
        rank = _dense(rank * (m + 1) + np.where(before >= 0, rank[before] + 1, 0))
        before = np.where(before >= 0, before[before], -1)
    out = np.empty(m, np.int64)
    out[rank] = whole
    return out


def _send(lane_of, small, j: int, at, lanes: Lanes, kind: bool) -> None:
    """Sends the suffixes one symbol longer, where of the wanted type and of a lane still to come, to their lanes."""
    before = at[at > 0] - 1
    to = lane_of[before]
    on = (small[before] == kind) & ((to < j) if kind else (to > j))
    before, to = before[on], to[on]
    order = np.argsort(to, kind="stable")
    before, to = before[order], to[order]
    cuts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1], [True]])) if len(to) else []
    for a, b in zip(cuts[:-1], cuts[1:]):
        lanes.push(int(to[a]), before[a:b], np.zeros(b - a, np.uint8))


def _seed_order(text, small, lms, depth: int, queue_bytes: int, spill_to: str | None, level: int) -> np.ndarray:
    """The order of the suffixes at leftmost S positions: by name, where names differ, or else by the sorted text of names.

    Names stand for two symbols at least, so half as many of them tell as much.
    """
    names = _names(text, small, lms, depth + 8)
    if int(names.max()) == len(lms) - 1:
        return np.argsort(names, kind="stable")
    return reduced_sort(np.append(names + 1, 0), depth // 2 + 1, queue_bytes, spill_to, level + 1)[1:]


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Lengths of the common prefixes of the suffixes a and b, up to ``depth``."""
    n = len(text)
    out = np.zeros(len(a), np.int64)
    if text.dtype == np.uint8:
        padded = np.concatenate([text, np.zeros(16, np.uint8)])
        eight = np.empty(n + 8, np.uint64)
        for k in range(8):
            x = padded[k : k + (len(padded) - k) // 8 * 8].view("<u8")
            x = x[: len(range(k, n + 8, 8))]
            eight[k : k + 8 * len(x) : 8] = x
        on = np.arange(len(a))
        for k in range(0, depth, 8):
            x, y = a[on] + k, b[on] + k
            inside = np.maximum(x, y) < n
            on, x, y = on[inside], x[inside], y[inside]
            d = eight[x] ^ eight[y]
            same = np.where(d == 0, 8, np.bitwise_count((d & (~d + np.uint64(1))) - np.uint64(1)) >> 3)
            out[on] += same
            on = on[same == 8]
            if not len(on):
                break
    else:
        on = np.arange(len(a))
        for k in range(depth):
            x, y = a[on] + k, b[on] + k
            inside = np.maximum(x, y) < n
            on, x, y = on[inside], x[inside], y[inside]
            on = on[text[x] == text[y]]
            out[on] += 1
            if not len(on):
                break
    return np.minimum(out, depth)


def suffix_sort(text: np.ndarray, depth: int, queue_bytes: int = QUEUE_BYTES, spill_to: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order (exact to ``depth`` symbols at least) and each one's common prefix, up to ``depth``, with the one before it.

    ``text`` ends in 0, which comes up nowhere else.
    """
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64), np.zeros(1, np.int64)
    sigma = int(text.max()) + 1
    small, run = _types(text)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    seeds = lms[_seed_order(text, small, lms, depth, queue_bytes, spill_to, 0)]
    common = np.zeros(len(seeds), np.int64)
    common[1:] = _common(text, seeds[:-1], seeds[1:], depth)
    symbols = text[seeds]
    bounds = np.searchsorted(symbols, np.arange(sigma + 1))

    lanes = Lanes(queue_bytes, spill_to)
    larger: list = [None] * sigma  # the L-type suffixes of each symbol, kept for the end
    for c in range(sigma):
        at, lcp = _grown(text, small, c, *lanes.pop(c), depth, False)
        larger[c] = (at, lcp)
        more, more_lcp = seeds[bounds[c] : bounds[c + 1]], common[bounds[c] : bounds[c + 1]].copy()
        if len(more):
            more_lcp[0] = min(run[at[-1]], run[more[0]]) if len(at) else 0
        _induce(text, small, c, np.concatenate([at, more]), np.concatenate([lcp, more_lcp]), depth, lanes, False)
    out, out_lcp = [], []
    for c in range(sigma - 1, -1, -1):
        at, lcp = (np.array([n - 1]), np.zeros(1, np.int64)) if c == 0 else _grown(text, small, c, *lanes.pop(c), depth, True)
        low, low_lcp = larger[c]
        larger[c] = None
        # from the greatest down: S-type suffixes, then L-type ones
        down, down_lcp = low[::-1], np.concatenate([[0], low_lcp[1:][::-1]])[: len(low)]
        border = min(depth, int(min(run[at[-1]], run[down[0]]))) if len(at) and len(down) else 0
        if len(down):
            down_lcp = down_lcp.copy()
            down_lcp[0] = border
        whole, whole_lcp = np.concatenate([at, down]), np.concatenate([lcp, down_lcp])
        _induce(text, small, c, whole, whole_lcp, depth, lanes, True)
        if len(whole):
            out.append(whole)
            out_lcp.append(np.concatenate([[0], whole_lcp[1:]]))
    lanes.close()
    down, down_lcp = np.concatenate(out), np.concatenate(out_lcp)
    return down[::-1].astype(np.int64), np.concatenate([[0], down_lcp[1:][::-1]]).astype(np.int64)


def _grown(text, small, c: int, at, lcp, depth: int, kind: bool):
    """A lane's suffixes with those that they induce into the same lane: one more leading c each round."""
    at, lcp = at.astype(np.int64), lcp.astype(np.int64)
    if len(lcp):
        lcp[0] = 0
    parts, commons, k = [at], [lcp], 1
    while len(at):
        before = at - 1
        on = np.flatnonzero((at > 0) & (text[before] == c) & (small[before] == kind))
        if not len(on):
            break
        least = np.minimum.reduceat(np.append(lcp, 0), on + 1)
        at = before[on]
        lcp = np.minimum(np.concatenate([[k], least[:-1] + 1]), depth)
        parts.append(at)
        commons.append(lcp)
        k += 1
    return np.concatenate(parts), np.concatenate(commons)


def _induce(text, small, c: int, at, lcp, depth: int, lanes: Lanes, kind: bool) -> None:
    """Sends the suffixes one symbol longer, where of the wanted type, to their lanes."""
    before = at - 1
    symbol = text[before]
    on = np.flatnonzero((at > 0) & (small[before] == kind) & ((symbol < c) if kind else (symbol > c)))
    if not len(on):
        return
    on = on[np.argsort(symbol[on], kind="stable")]
    target = symbol[on]
    least = np.minimum.reduceat(np.append(lcp, 0), on + 1)  # from each to the next of its lane
    common = np.minimum(np.concatenate([[1], least[:-1] + 1]), depth)
    cuts = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1], [True]]))
    moved = before[on]
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        t = int(target[a])
        part = common[a:b].copy()
        part[0] = 1 if lanes.has(t) else 0  # the one before begins with t too, then differs
        lanes.push(t, moved[a:b], part)


def decide(contents: list[bytes], d: np.ndarray, start: np.ndarray, kind: Kind, queue_bytes: int = QUEUE_BYTES, spill_to: str | None = None) -> list[np.ndarray]:
    """For each content (sorted by place) which of its windows also start in a document with a smaller id."""
    lengths = np.array([len(c) for c in contents], np.int64)
    raw = np.frombuffer(b"".join(x for c in contents for x in (c, b"\xfe")) + b"\xff", np.uint8)
    text = raw + np.uint8(1)  # 0xfe becomes the separator, 0xff the end
    order, common = suffix_sort(text, kind.k, queue_bytes, spill_to)
    begin = np.cumsum(lengths + 1) - lengths - 1
    windows = np.maximum(lengths - kind.k + 1, 0)
    doc = np.unique(d, return_inverse=True)[1]
    owner = np.full(len(text), np.iinfo(np.int64).max)
    where = np.repeat(begin - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
    owner[where] = np.repeat(doc, windows)
    starts = np.flatnonzero(common < kind.k)
    least = np.minimum.reduceat(owner[order], starts)
    group = np.cumsum(common < kind.k) - 1
    earlier = np.zeros(len(text), bool)
    earlier[order] = least[group] < owner[order]
    return [earlier[b : b + w] for b, w in zip(begin.tolist(), windows.tolist())]


def suffix_dedup(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", with_text: bool = False, queue_bytes: int = QUEUE_BYTES) -> DataFrame:
    """Removes each byte in a string of ``window`` bytes that also starts in a document with a smaller id; see without_repeats.

    With ``with_text``, bytes of cut characters appear as replacement characters in the text left.
    A shard's queues hold ``queue_bytes`` in memory; what is more goes to files in the shared folder.
    """
    if window < 20 or window > 250:
        raise ValueError("a window has 20 to 250 bytes")
    spilling = partial(decide, queue_bytes=queue_bytes, spill_to=work_dir(docs.sparkSession))
    return without_repeats(docs, Kind("byte", window, min(GRAM, window), False), spilling, doc_id, text, with_text)


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    found = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", found.n_units.alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")


def brute(rows: list[tuple], window: int = WINDOW) -> dict:
    """doc_id: (n_bytes, n_removed, n_spans, kept_sha256), by a table of all windows, for tests; ids differ."""
    seen, out = set(), {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        own = [b[i : i + window] for i in range(len(b) - window + 1)]
        for i, x in enumerate(own):
            if x in seen:
                gone[i : i + window] = b"\1" * window
        seen.update(own)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out
