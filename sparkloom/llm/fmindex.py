"""Substring dedup with a compressed FM-index: backward search over a wavelet matrix computes matching statistics."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from .repeats import Kind, without_repeats

#: Words of a window, and of the grams that choose shards.
WINDOW, GRAM = 20, 5


class Bits:
    """A bit vector in words of 64, with the ones before each word."""

    def __init__(self, b: np.ndarray):
        self.words = np.packbits(np.concatenate([b.astype(np.uint8), np.zeros(-len(b) % 64 + 64, np.uint8)]), bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int32)]).astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """The ones before position i."""
        word = i >> 6
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))

    def select(self, k: np.ndarray) -> np.ndarray:
        """The position of the k-th one, from 0."""
        word = np.searchsorted(self.before, k, "right") - 1
        left, x, at = k - self.before[word], self.words[word], word.astype(np.int64) << 6
        for step in (32, 16, 8, 4, 2, 1):
            low = np.bitwise_count(x & np.uint64((1 << step) - 1))
            on = left >= low
            left = np.where(on, left - low, left)
            at = np.where(on, at + step, at)
            x = np.where(on, x >> np.uint64(step), x)
        return at

    @property
    def nbytes(self) -> int:
        return self.words.nbytes + self.before.nbytes


class Wavelet:
    """A sequence of small integers as one bit vector per binary digit."""

    def __init__(self, x: np.ndarray, bits: int):
        self.bits, self.levels = bits, []
        for k in range(bits - 1, -1, -1):
            b = x >> k & 1
            self.levels.append((Bits(b), int(np.count_nonzero(b == 0))))
            x = np.concatenate([x[b == 0], x[b == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each c comes up before position i, plus a start that depends on c alone."""
        for k, (b, zeros) in zip(range(self.bits - 1, -1, -1), self.levels):
            ones = b.rank(i)
            i = np.where(c >> k & 1, zeros + ones, i - ones)
        return i


class FMIndex:
    """The index of a text of integers from 1 up with separators 0, exact for patterns of up to ``depth`` units.

    What it keeps is compressed: the wavelet matrix of the transformed text, where each unit's
    suffixes begin, a bit for each suffix that tells whether it begins a group (of those with
    one prefix of ``depth`` units), and the least ``place`` of the groups of several suffixes.
    The order of suffixes is gone when it is made: what a text matches is found by backward search.
    """

    def __init__(self, text: np.ndarray, depth: int, place: np.ndarray):
        n = len(text)
        self.depth, self.n = depth, n
        order, new = _sorted(text, depth)
        starts = np.flatnonzero(new)
        several = np.diff(np.append(starts, n)) > 1
        self.groups, self.several = Bits(np.append(new, True)), Bits(several)
        self.least = np.minimum.reduceat(place[order], starts)[several]
        sigma = int(text.max(initial=0)) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.wavelet = Wavelet(text[order - 1].astype(np.int64), max(1, (sigma - 1).bit_length()))
        self.zero = self.wavelet.rank(np.arange(sigma), np.zeros(sigma, np.int64))

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the suffixes that begin with c and then with what those of [lo, hi) begin with."""
        base = self.first[c] - self.zero[c]
        return base + self.wavelet.rank(c, lo), base + self.wavelet.rank(c, hi)

    def earliest(self, lo: np.ndarray) -> np.ndarray:
        """The least place of the group that suffix lo begins; the greatest integer where it is alone."""
        g = self.groups.rank(lo + 1) - 1
        k = self.several.rank(g)
        many = self.several.rank(g + 1) > k
        out = np.full(len(lo), np.iinfo(np.int64).max)
        out[many] = self.least[k[many]]
        return out

    def nbytes(self) -> int:
        return self.groups.nbytes + self.several.nbytes + self.least.nbytes + self.first.nbytes + self.zero.nbytes + sum(b.nbytes for b, _ in self.wavelet.levels)

    def matches(self, texts: list[np.ndarray]):
        """Streams texts of the index's units through it, from their ends, all side by side.

        Yields (numbers of texts, position, lo, hi) for each position with a match of
        ``depth`` units or more: the suffixes that share these units. The length of a match
        is kept at ``depth`` by going from the suffixes to their group.
        """
        order = np.argsort([-len(t) for t in texts], kind="stable")
        lengths = np.array([len(texts[k]) for k in order], np.int64)
        flat = np.concatenate([texts[k][::-1] for k in order]) if len(order) else np.zeros(0, np.int64)
        at = np.cumsum(lengths) - lengths
        lo, hi, have = np.zeros(len(order), np.int64), np.full(len(order), self.n, np.int64), np.zeros(len(order), np.int64)
        for t in range(int(lengths.max(initial=0))):
            m = int(np.searchsorted(-lengths, -t, "left"))
            c = flat[at[:m] + t]
            a, b = self.extend(c, lo[:m], hi[:m])
            gone = a >= b  # no such match: begin anew with this unit alone
            if gone.any():
                a, b = np.where(gone, self.first[c], a), np.where(gone, self.first[c + 1], b)
            have = np.where(gone, 1, np.minimum(have[:m] + 1, self.depth + 1))
            over = np.flatnonzero(have > self.depth)
            if len(over):
                g = self.groups.rank(a[over] + 1) - 1
                a[over], b[over] = self.groups.select(g), self.groups.select(g + 1)
                have[over] = self.depth
            lo, hi = a, b
            full = np.flatnonzero(have >= self.depth)
            if len(full):
                yield order[full], lengths[full] - 1 - t, lo[full], hi[full]


def _sorted(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in order of their first ``depth`` units at least, and which differ in these from the one before."""
    n = len(text)
    rank, have = text.astype(np.int64), 1
    order = part = None
    while have <= depth:
        if have <= depth < 2 * have:
            part = (rank, have)
        after = np.zeros(n, np.int64)
        after[: max(0, n - have)] = rank[have:] + 1
        key = rank * (int(after.max(initial=0)) + 1) + after
        order = np.argsort(key, kind="stable")
        s = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])
        have *= 2
    base, span = part
    tail = np.zeros(n, np.int64)
    tail[: max(0, n - depth + span)] = base[depth - span :] + 1
    a, b = base[order], tail[order]
    new = np.ones(n, bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, new


def decide(contents: list[bytes], d: np.ndarray, start: np.ndarray, kind: Kind) -> list[np.ndarray]:
    """For each content (words joined by spaces; sorted by place) which of its windows also start earlier."""
    ids: dict[bytes, int] = {}
    texts = []
    for c in contents:
        texts.append(np.array([ids.setdefault(w, len(ids) + 1) for w in c.split(b" ")], np.int64))
    lengths = np.array([len(t) for t in texts], np.int64)
    whole = np.concatenate([x for t in texts for x in (t, [0])]).astype(np.int64)
    begin = np.cumsum(lengths + 1) - lengths - 1
    # a place is the document's number and the word's in it, as one integer
    doc = np.unique(d, return_inverse=True)[1].astype(np.int64)
    windows = np.maximum(lengths - kind.k + 1, 0)
    place = np.full(len(whole), np.iinfo(np.int64).max)
    where = np.repeat(begin - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
    place[where] = np.repeat(doc << 40, windows) + np.repeat(start - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
    index = FMIndex(whole, kind.k, place)
    earlier = np.zeros(len(whole), bool)
    for k, at, lo, _ in index.matches(texts):
        here = begin[k] + at
        earlier[here] = index.earliest(lo) < place[here]
    return [earlier[b : b + w] for b, w in zip(begin.tolist(), windows.tolist())]


def substring_dedup(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """Removes each word in a window of ``window`` words that also starts earlier; see without_repeats for rows of every kind."""
    if window < 2:
        raise ValueError("a window has two words at least")
    return without_repeats(docs, Kind("word", window, min(GRAM, window), True), decide, doc_id, text, with_text)


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    found = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", found.n_units.alias("n_words"), "n_removed", "kept_sha256")


def brute(rows: list[tuple], window: int = WINDOW) -> dict:
    """doc_id: (n_words, n_removed, kept_sha256), by a table of all windows, for tests; ids differ."""
    seen, out = set(), {}
    for d, t in sorted(rows):
        words = (t or "").encode().split()
        gone = set()
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            if w in seen:
                gone.update(range(i, i + window))
            seen.add(w)
        out[d] = (len(words), len(gone), hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest())
    return out
