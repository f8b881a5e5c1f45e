r"""Packing along a Hilbert curve.

Each document is tokenized once; its token counts, hashed to rows of a fixed random matrix, give a vector of `dims` numbers, its
Hilbert key the place on a curve through that space. Documents are range-sorted by key and laid behind each other; the
stream is cut every `length` tokens, wherever that falls. So neighbours on the curve share sequences, and only the last
sequence has padding. Only keys and lengths are sorted; tokens are shuffled once, to meet their places.

Places are running sums within range partitions plus the partitions' totals, of which there is one per partition.

Defined cases: a null text is empty, and an empty document is its end mark alone; repeated rows are packed each; equal keys are ordered
by row; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import materialize
from .textbytes import freeing, text_slices

LENGTH, END = 4096, 2
DIMS, BITS = 4, 8
#: Words whose ids a worker holds, about 150 bytes each; fewer take more time, not other results.
CACHED_WORDS = 800_000


class WordCache:
    """Token ids of whole texts, word by word: white space never lies within a token of this kind of tokenizer, so a text's
    ids are those of its words in turn. A plain word with one point or comma behind it has the ids of both. Texts within
    Latin-1 are lower-cased first, as the tokenizer would. Once more than `most` words are held, the next texts start afresh."""

    def __init__(self, path: str, most: int = CACHED_WORDS):
        self.most = most
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.place = Places()
        self.flat, self.start, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.marks = [np.array(self.ids([m])[0], np.uint32) for m in ".,"]

    def ids(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def hold(self, at: np.ndarray, flat: np.ndarray, bounds: np.ndarray) -> None:
        """Keeps the ids of the words numbered at: flat up to each of bounds."""
        size = np.diff(bounds, prepend=0)
        self.start[at], self.size[at] = bounds - size + len(self.flat), size
        self.flat = np.concatenate([self.flat, flat])

    def add(self, words: list[str]) -> None:
        """Ids of new words, numbered from len(self.start). Words of letters only are encoded many at a time: each is one unit of the
        tokenizer, so its last id is one that ends a word."""
        place, n = self.place, len(self.start)
        marked = [i for i, w in enumerate(words) if w[-1:] in (".", ",") and w[:-1].isalpha()]
        base = np.fromiter((place[words[i][:-1]] for i in marked), np.int64, len(marked))  # numbers what is new among them
        self.start, self.size = (np.concatenate([x, np.zeros(len(words), np.int64)]) for x in (self.start, self.size))
        skip = set(marked)
        plain = [i for i, w in enumerate(words) if w.isalpha()]
        other = [i for i, w in enumerate(words) if i not in skip and not w.isalpha()]
        lines = [plain[i : i + 1000] for i in range(0, len(plain), 1000)]
        parts, numbers, total = [], [], 0
        for line, ids in zip(lines, self.ids([" ".join([words[i] for i in x]) for x in lines]), strict=True):
            ids = np.array(ids, np.uint32)
            bounds = np.flatnonzero(self.ends[ids]) + 1
            if len(bounds) == len(line):
                parts.append((ids, bounds + total))
                numbers += line
                total += len(ids)
            else:
                other += line
        if parts:
            self.hold(np.array(numbers) + n, np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        if other:
            ids = self.ids([words[i] for i in other])
            bounds = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
            self.hold(np.array(other) + n, np.fromiter(chain.from_iterable(ids), np.uint32, bounds[-1]), bounds)
        if marked:
            kind = np.fromiter((words[i][-1] == "," for i in marked), np.int64, len(marked))
            size, extra = self.size[base], np.array([len(m) for m in self.marks])[kind]
            bounds = np.cumsum(size + extra)
            begin = bounds - size - extra
            flat = np.zeros(bounds[-1], np.uint32)
            flat[spread(begin, size)] = self.flat[spread(self.start[base], size)]
            for k, mark in enumerate(self.marks):
                for j, x in enumerate(mark):
                    flat[(begin + size)[kind == k] + j] = x
            self.hold(np.array(marked) + n, flat, bounds)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        lists = [(t.lower() if t.isascii() or latin1(t) else t).replace("\n", " ").split(" ") for t in texts]
        if len(self.place) > self.most:
            self.clear()
        at = np.fromiter(map(self.place.__getitem__, chain.from_iterable(lists)), np.int64)
        if self.place.fresh:
            self.add(self.place.fresh)
            self.place.fresh = []
        size = self.size[at]
        ids = self.flat[spread(self.start[at], size)]
        stop = np.concatenate([[0], np.cumsum(size)])[np.cumsum([0, *map(len, lists)])]
        return [ids[a:b] for a, b in zip(stop[:-1], stop[1:], strict=True)]


class Places(dict):
    """Numbers words in the order in which they are first asked for, and remembers the new ones."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


def latin1(t: str) -> bool:
    try:
        t.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All of begin[i] .. begin[i] + size[i] - 1, in order."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)


_caches: dict[str, WordCache] = {}


def word_cache(path: str, most: int = CACHED_WORDS) -> WordCache:
    """A worker's cache outlives its tasks."""
    if path not in _caches:
        _caches[path] = WordCache(path)
    _caches[path].most = most
    return _caches[path]


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of integer points (rows) with `bits` bits per coordinate."""
    x = points.astype(np.int64).T.copy()
    dims, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap if i else 0
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), top
    while q > 1:
        turn ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(turn)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def projection(dims: int) -> np.ndarray:
    return np.random.default_rng(11).standard_normal((1 << 16, dims)).astype(np.float32)


def _tokenize(path: str, end: int, dims: int, bits: int, cached_words: int):
    def run(batches):
        cache, rows = word_cache(path, cached_words), projection(dims)
        for batch in batches:
            for lo, hi, _, _ in text_slices(batch.column("t"), 1 << 20):
                part = batch.slice(lo, hi - lo)
                ids = [np.append(x, np.uint32(end)) for x in cache.encode([t or "" for t in part.column("t").to_pylist()])]
                size = np.fromiter(map(len, ids), np.int64, len(ids))
                mean = np.add.reduceat(rows[np.concatenate(ids) & 0xFFFF], np.cumsum(size) - size, axis=0) / size[:, None]
                points = ((np.tanh(mean * 2) + 1) / 2 * ((1 << bits) - 1)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"), part.column("row"), pa.array([len(x) for x in ids], pa.int64()), pa.array(hilbert_key(points, bits)),
                        pa.array([x.astype("<u2" if x.max() < 1 << 16 else "<u4").tobytes() for x in ids], pa.binary()),
                    ],
                    names=["id", "row", "n", "key", "ids"],
                )

    return run


def _cut(length: int):
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                out = []
                for doc, n, pos, raw in zip(*(part.column(c).to_pylist() for c in ("id", "n", "pos", "ids")), strict=True):
                    ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
                    at = 0
                    while at < n:
                        take = min(n - at, length - (pos + at) % length)
                        out.append((doc, at, take, n, (pos + at) // length, (pos + at) % length, ids[at : at + take].tobytes()))
                        at += take
                names = ["id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
                kinds = [part.schema.field("id").type, *[pa.int64()] * 5, pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    return run


def pack(documents: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end: int = END, dims: int = DIMS, bits: int = BITS, cached_words: int = CACHED_WORDS) -> DataFrame:
    """Pieces: id_col, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit)."""
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).withColumn("row", F.monotonically_increasing_id())
    kind = docs.schema["id"].dataType.simpleString()
    tokens = materialize(docs.mapInArrow(freeing(_tokenize(tokenizer_path, end, dims, bits, cached_words)), f"id {kind}, row long, n long, key long, ids binary"), )
    order = tokens.select("key", "row", "n").repartitionByRange("key", "row").withColumn("part", F.spark_partition_id())
    order = materialize(order)
    totals = {r.part: r.n for r in order.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    before, rows = 0, []
    for part in sorted(totals):
        rows.append((part, before))
        before += totals[part]
    begins = documents.sparkSession.createDataFrame(rows, "part int, begin long")
    run = W.partitionBy("part").orderBy("key", "row").rowsBetween(W.unboundedPreceding, W.currentRow)
    places = order.join(F.broadcast(begins), "part").select("row", (F.col("begin") + F.sum("n").over(run) - F.col("n")).alias("pos"))
    out = tokens.join(places, "row").select("id", "n", "pos", "ids").mapInArrow(_cut(length), f"id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
    return out.withColumnRenamed("id", id_col)
