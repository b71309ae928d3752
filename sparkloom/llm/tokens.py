"""Token-ID output: length-delimited binary records with masked checksums and an offset index.

A record file is a sequence of frames: length of the payload (u64), masked CRC-32C of
these eight bytes (u32), payload, masked CRC-32C of the payload (u32); all little-endian.
A payload is a flag byte (width of an id, 2 or 4; 128 is added for a null doc_id),
doc_id (i64) and the ids. The index beside a file holds each frame's offset (u64),
so that a reader can fetch records in any order.
"""

from __future__ import annotations

import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import file_system, input_bytes, partitions_for, read_bytes, settled, ship, slice_texts, utf8, work_dir
from .crc32c import crc32c, masked

#: Bytes that a worker's remembered words and their ids take, at most about; what looks them up takes as much again.
CACHE_BYTES = 8 << 20
#: Bytes of records that are read in one go.
READ_BYTES = 4 << 20
#: Punctuation that makes one piece after letters.
_TAIL = b",.!?;:*$%&#"
#: Bytes of text that are encoded in one go.
PIECE = 2 << 20


class WordEncoder:
    """Encodes texts word by word, remembering words.

    Exact for tokenizers whose pre-tokenizer never joins text across ASCII white space
    and drops it. It remembers words and their ids as arrays; when these pass CACHE_BYTES,
    it goes on with the last words alone. Added tokens, such as the end of a text, are
    found in a text as the tokenizer finds them by default.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = {t.content.encode(): k for k, t in added.items()}
        self.contents = list(self.added)
        # added tokens that are found in the raw text and take nothing beside them part a text; others are left to the tokenizer
        self.parting = all(t.special and not (t.normalized or t.lstrip or t.rstrip or t.single_word or t.content.split() != [t.content]) for t in added.values())
        self.parts = re.compile(b"(%s)" % b"|".join(re.escape(c) for c in sorted(self.contents, key=len, reverse=True))) if added else None
        self.tokenizer.encode_special_tokens = self.parting  # between added tokens, lower case mustn't make one
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        mark = self.tokenizer.encode("\x01", add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None  # a lone control character parts the words of a line
        ends = [t.endswith("</w>") for t, _ in sorted(self.tokenizer.get_vocab().items(), key=lambda x: x[1])]
        self.ends = np.array(ends)
        self.split = self._splitter(path) if any(ends) else None
        self.kind = "<u4" if self.wide else "<u2"
        self.words, self.n, self.flat = pa.array([b""], pa.binary()), np.zeros(1, np.int32), np.zeros(0, self.kind)

    def _splitter(self, path: str):
        """The same vocabulary for text that is normalised and whose pre-tokens are parted by spaces; None where that isn't the same thing."""
        from tokenizers import Tokenizer, pre_tokenizers as p

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        t.normalizer = None
        t.pre_tokenizer = p.Sequence([p.WhitespaceSplit(), p.ByteLevel(add_prefix_space=False, use_regex=False)])
        probe = "the theta été ,,. größe ! ab , zyzzyva *** señor ; x"
        return t if t.encode(probe, add_special_tokens=False).ids == self.tokenizer.encode(probe, add_special_tokens=False).ids else None

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian integers of 2 or 4 bytes."""
        if self.added and not self.parting:
            return [self._ids(self.tokenizer.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids) for t in texts]
        with_added = [k for k, t in enumerate(texts) if any(c in t for c in self.contents)]
        if not with_added:
            return self._words(texts)
        parts = {k: self.parts.split(texts[k]) for k in with_added}  # what is between, and the tokens, in turn
        out = self._words([b"" if k in parts else t for k, t in enumerate(texts)])
        between = iter(self._words([x for p in parts.values() for x in p[::2]]))
        for k, p in parts.items():
            out[k] = b"".join(self._ids([self.added[x]]) if n % 2 else next(between) for n, x in enumerate(p))
        return out

    def _ids(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def _words(self, texts: list[bytes]) -> list[bytes]:
        out, group, size = [], [], 0
        for t in texts:
            if size + len(t) > PIECE and group:
                out += self._batch(group)
                group, size = [], 0
            if len(t) > PIECE:
                out.append(b"".join(x for p in _pieces(t) for x in self._batch([p])))
            else:
                group.append(t)
                size += len(t)
        return out + self._batch(group) if group else out

    def _batch(self, texts: list[bytes]) -> list[bytes]:
        # ASCII letters in lower case, unless a mark of U+0300 to U+033F might compose with one of them
        column = pa.array([t if b"\xcc" in t else t.lower() for t in texts], pa.binary()).view(pa.string())
        split = pc.ascii_split_whitespace(column)
        words = split.values.dictionary_encode()
        each = words.dictionary.view(pa.binary())
        which = self._known(each)
        missing = np.flatnonzero(which < 0)
        if len(missing):
            new = each.take(pa.array(missing))
            ids = self._learn(new.to_pylist())
            which[missing] = len(self.n) + np.arange(len(missing), dtype=np.int32)
            width = 4 if self.wide else 2
            self.words = pa.concat_arrays([self.words, new])
            self.n = np.concatenate([self.n, np.array([len(x) // width for x in ids], np.int32)])
            self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(ids), self.kind)])
        first = np.cumsum(self.n, dtype=np.int32) - self.n
        at = which[words.indices.to_numpy()]
        n = self.n[at]
        to = np.zeros(len(n) + 1, np.int32)
        np.cumsum(n, dtype=np.int32, out=to[1:])
        place = np.repeat(first[at] - to[:-1], n)
        place += np.arange(len(place), dtype=np.int32)
        out = self.flat[place].tobytes()
        bounds = (to[split.offsets.to_numpy()] * (4 if self.wide else 2)).tolist()
        if self.words.nbytes + self.n.nbytes + self.flat.nbytes > CACHE_BYTES:  # go on with the words of these texts
            n = self.n[which]
            place = np.repeat(first[which] - (np.cumsum(n, dtype=np.int32) - n), n)
            self.flat = self.flat[place + np.arange(len(place), dtype=np.int32)]
            self.words, self.n = each, n
        return [out[x:y] for x, y in zip(bounds, bounds[1:])]

    def _known(self, words: pa.Array) -> np.ndarray:
        """The number of each word among those remembered, or -1."""
        return pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).copy()

    def _learn(self, missing: list[bytes]) -> list[bytes]:
        """The ids of words: the pre-tokens of plain ones each alone, others many to a line, parted by a lone control character."""
        known: dict[bytes, bytes] = {b"": b""}
        parts = [_plain(w) for w in missing] if self.split is not None else [None] * len(missing)
        cores = list({x for p in parts if p for x in p if x})
        at = self._known(pa.array(cores, pa.binary()))
        first = np.cumsum(self.n, dtype=np.int64) - self.n
        some = np.flatnonzero(at >= 0)
        a, n = first[at[some]].tolist(), self.n[at[some]].tolist()
        known.update((cores[k], self.flat[x : x + m].tobytes()) for k, x, m in zip(some.tolist(), a, n))
        self._lines([cores[k] for k in np.flatnonzero(at < 0).tolist()], self.split, b" ", known)
        rest = [w for w, p in zip(missing, parts) if not p]
        for w in rest if self.mark is None else [w for w in rest if b"\x01" in w]:
            known[w] = self._ids(self.tokenizer.encode(w.decode("utf-8", "replace"), add_special_tokens=False).ids)
        if self.mark is not None:
            self._lines([w for w in rest if b"\x01" not in w], self.tokenizer, b" \x01 ", known)
        return [known[p[0]] + known[p[1]] if p else known[w] for w, p in zip(missing, parts)]

    def _lines(self, words: list[bytes], tokenizer, between: bytes, known: dict[bytes, bytes]) -> None:
        width = 4 if self.wide else 2
        lines = [words[k : k + 256] for k in range(0, len(words), 256)]
        for k in range(0, len(lines), 64):
            some = lines[k : k + 64]
            texts = [between.join(x).decode("utf-8", "replace") for x in some]
            plain = between == b" "
            for line, e in zip(some, tokenizer.encode_batch_fast([t.lower() for t in texts] if plain else texts, add_special_tokens=False)):
                ids = np.array(e.ids, self.kind)
                if plain:  # pre-tokens: each ends in an id that ends a word
                    ends = ((np.flatnonzero(self.ends[ids]) + 1) * width).tolist()
                    starts = [0, *ends[:-1]]
                else:
                    at = np.flatnonzero(ids == self.mark)
                    starts, ends = [0, *((at + 1) * width).tolist()], [*(at * width).tolist(), len(ids) * width]
                if len(ends) != len(line) or ends[-1] != len(ids) * width:
                    raise ValueError("the tokenizer joins words")
                ids = ids.tobytes()
                known.update(zip(line, [ids[x:y] for x, y in zip(starts, ends)]))


def _plain(word: bytes) -> tuple[bytes, bytes] | None:
    """A word's pre-tokens, where they are plain to see: letters, which compose with nothing, then perhaps punctuation."""
    if word.isalpha():
        return word, b""
    core = word.rstrip(_TAIL)
    if not core.isalpha():
        text = core.decode("utf-8", "replace")
        if not text.isalpha() or max(text) >= "\u0130":
            return None
    return core, word[len(core) :]


def _pieces(text: bytes):
    """A long text cut at white space."""
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and text[end] not in b" \t\n\v\f\r":
            end += 1
        yield text[at:end]
        at = end


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def frames(payloads: list[bytes]) -> list[bytes]:
    lengths = [struct.pack("<Q", len(p)) for p in payloads]
    heads, bodies = masked(crc32c(lengths)).tolist(), masked(crc32c(payloads)).tolist()
    return [b"".join((n, struct.pack("<I", h), p, struct.pack("<I", b))) for n, h, p, b in zip(lengths, heads, payloads, bodies)]


def read_frames(data: bytes, offsets) -> list[bytes]:
    """The payloads at the given offsets; raises ValueError where a checksum doesn't hold."""
    offsets = [int(x) for x in offsets]
    heads = [struct.unpack_from("<QI", data, o) for o in offsets]
    payloads = [data[o + 12 : o + 12 + n] for o, (n, _) in zip(offsets, heads)]
    ends = [struct.unpack_from("<I", data, o + 12 + n)[0] for o, (n, _) in zip(offsets, heads)]
    lengths = [data[o : o + 8] for o in offsets]
    if (np.array([h for _, h in heads], np.uint32) != masked(crc32c(lengths))).any() or (np.array(ends, np.uint32) != masked(crc32c(payloads))).any():
        raise ValueError("a record's checksum doesn't hold")
    return payloads


def write_tokens(docs: DataFrame, out: str, vocabulary: str, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> list[dict]:
    """Encodes all texts, each followed by ``end_id``, and writes record files in ascending doc_id order (null first, equal ids by their texts' hashes, then by text).

    Returns one row per file in order: part, path, index, docs, tokens. A null or empty
    text is the end id alone; an empty table writes nothing. Other columns aren't read.
    File names follow the partition, and a file appears only when whole, so that tasks
    may run again.
    """
    spark = ship(docs.sparkSession)
    sized = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t"))
    n = partitions_for(spark, input_bytes(docs))
    ordered = sized.repartitionByRange(n, "d", F.xxhash64("t")).sortWithinPartitions("d", F.xxhash64("t"), "t")

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        e = encoder(vocabulary)
        end = np.array([end_id], "<u4" if e.wide else "<u2").tobytes()
        width = 4 if e.wide else 2
        path = f"{out}/part-{part:06d}.rec"
        store, at = file_system(path)
        temp = f"{at}.{TaskContext.get().taskAttemptId()}.tmp"
        offsets, tokens, place, f = [], 0, 0, None
        for b in batches:
            ids = b.column(0).to_pylist()
            texts = list(slice_texts(*utf8(b.column(1))))
            for k in range(0, len(ids), 1000):
                rows = [x + end for x in e.encode(texts[k : k + 1000])]
                f = f or store.open_output_stream(temp, compression=None)
                made = frames([struct.pack("<Bq", width | (128 if d is None else 0), d or 0) + x for d, x in zip(ids[k : k + 1000], rows)])
                for x, y in zip(rows, made):
                    offsets.append(place)
                    place += len(y)
                    tokens += len(x) // width
                f.write(b"".join(made))
        if f is None:
            return
        f.close()
        with store.open_output_stream(f"{temp}i", compression=None) as i:
            i.write(np.array(offsets, "<u8").tobytes())
        store.move(f"{temp}i", f"{at}.idx")
        store.move(temp, at)
        yield pa.RecordBatch.from_pydict({"part": [part], "path": [path], "index": [f"{path}.idx"], "docs": [len(offsets)], "tokens": [tokens]})

    rows = ordered.mapInArrow(settled(run), "part long, path string, index string, docs long, tokens long").collect()
    return [r.asDict() for r in sorted(rows, key=lambda r: r.part)]


def read_tokens(spark, files: list[dict]) -> DataFrame:
    """Reads record files back: doc_id, start (ids in all records before), n_tokens, ids_crc32 and ids for each record."""
    ship(spark)
    base, rows = 0, []
    for f in files:
        rows.append((f["path"], f["index"], base))
        base += f["tokens"]
    listed = spark.createDataFrame(rows, "path string, index string, base long")
    tasks = partitions_for(spark, 4 * base, 64 << 20)
    listed = listed.repartition(min(len(rows), tasks)) if rows else listed

    def run(batches):
        for b in batches:
            for path, index, base in zip(*(c.to_pylist() for c in b.columns)):
                store, at = file_system(path)
                offsets = np.frombuffer(read_bytes(index), "<u8").astype(np.int64)  # eight bytes a record
                with store.open_input_file(at) as f:
                    bounds, k = np.append(offsets, f.size()), 0
                    while k < len(offsets):
                        j = max(k + 1, min(k + 1000, int(np.searchsorted(bounds, bounds[k] + READ_BYTES, "right")) - 1))
                        data = f.read_at(int(bounds[j] - bounds[k]), int(bounds[k]))
                        out = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
                        for p in read_frames(data, offsets[k:j] - offsets[k]):
                            flag, d = struct.unpack_from("<Bq", p)
                            ids = np.frombuffer(p, "<u2" if flag & 127 == 2 else "<u4", offset=9).astype("<u4")
                            for c, v in zip(out.values(), (None if flag & 128 else d, base, len(ids), zlib.crc32(ids.tobytes()))):
                                c.append(v)
                            base += len(ids)
                        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(c, pa.int64()) for c in out]))
                        k = j

    return listed.mapInArrow(settled(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_records(docs: DataFrame, vocabulary: str | None = None, end_id: int = 1) -> DataFrame:
    """Writes the records of ``docs`` to the shared folder and reads them back."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    spark = docs.sparkSession
    return read_tokens(spark, write_tokens(docs, work_dir(spark), vocabulary, end_id))


def op7_token_records(spark, sf_dir: str) -> DataFrame:
    return token_records(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
