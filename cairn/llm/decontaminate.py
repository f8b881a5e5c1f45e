"""Benchmark decontamination over training suffix arrays.

Documents stay where they are: each slice of a partition is a shard. Over the words of a shard that occur in
the benchmark at all, a suffix array is made by prefix doubling, a suffix ending before the next other word; every test
suffix is then looked up in it by binary search over its first `window` words, and found windows that follow each other in both texts are the
longest verbatim match of each item in each document, with its place.

The benchmark is the only thing that is sent around: it is cut into blocks of `block_bytes` at most (an item is not cut), one pass over the
documents each. A pass returns the rows that hold a window of its block, with what they hold, and nothing of the others; that is written before the next block is read, so that driver and workers
hold one block at a time. With several blocks the texts are written once, so that rows have lasting numbers by which the passes' finds meet; they are not carried from pass to pass.

Words: A-Z lower-cased, then runs of 0-9, a-z and everything beyond ASCII. A window is `window` consecutive words
of an item; a shorter item is one window as a whole.

Defined cases: null or word-less texts have no words and no hits; null or word-less items have no windows;
a null item id counts as the string "null"; repeated items count once per id; repeated documents are
reported each; an empty benchmark or empty documents give rows without hits, or none; other columns of either
table are carried or ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize
from .textbytes import ALNUM_WORD, LOWER, text_slices, word_hashes

WINDOW = 10
BLOCK_BYTES = 16 << 20

MATCH = T.StructType(
    [T.StructField("item_id", T.StringType()), T.StructField("doc_word", T.LongType()), T.StructField("item_word", T.LongType()), T.StructField("n_words", T.LongType())]
)
SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


class TestSuffixes:
    """The windows of a block of benchmark items: vocabulary, and for each window length the distinct windows."""

    def __init__(self, ids: list[str], texts: list[str], window: int):
        words = []
        for _, _, data, offsets in text_slices(pa.array(texts, pa.large_string())):
            h, _, first = word_hashes(LOWER[data], offsets, ALNUM_WORD)
            words += [h[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        self.vocabulary = np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint64)
        self.ids = np.array(ids, object)
        rows: dict[int, list] = {}
        for k, w in enumerate(words):
            if len(w):
                size = min(window, len(w))
                code = (np.searchsorted(self.vocabulary, w) + 1).astype(">u4")
                at = np.arange(len(w) - size + 1)
                rows.setdefault(size, []).append((code[at[:, None] + np.arange(size)], np.full(len(at), k), at))
        #: length -> (keys sorted, item, place in the item), several rows where items share a window
        self.windows = {}
        for size, parts in rows.items():
            keys = as_keys(np.concatenate([p[0] for p in parts]))
            order = np.argsort(keys, kind="stable")
            self.windows[size] = keys[order], np.concatenate([p[1] for p in parts])[order], np.concatenate([p[2] for p in parts])[order]


def as_keys(rows: np.ndarray) -> np.ndarray:
    """Rows of big-endian 32-bit codes as byte strings that sort the same way."""
    return np.ascontiguousarray(rows, ">u4").view(f"S{rows.shape[1] * 4}").ravel()


def suffix_order(code: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Places with a known word, in the order of the suffixes of `room` words that begin there: prefix doubling."""
    at = np.flatnonzero(room > 0)
    rank = np.append(code, 0).astype(np.int64)
    step, longest = 1, int(room.max(initial=0))
    while True:
        follow = np.where(room[at] > step, rank[np.minimum(at + step, len(code))], 0)
        names, own = np.unique(rank[at] * (len(code) + int(code.max(initial=0)) + 2) + follow, return_inverse=True)
        rank = np.zeros(len(code) + 1, np.int64)
        rank[at] = own + 1
        step *= 2
        if len(names) == len(at) or step >= longest:
            return at[np.argsort(own, kind="stable")]


def search_shard(data: np.ndarray, offsets: np.ndarray, test: TestSuffixes):
    """For a shard's documents: word counts, and found windows as (document, word, length, item, item word)."""
    h, doc, first = word_hashes(LOWER[data], offsets, ALNUM_WORD)
    none = np.zeros(0, np.int64)
    found = [(none, none, none, none, none)]
    if len(h) and len(test.vocabulary):
        place = np.searchsorted(test.vocabulary, h)
        place[place == len(test.vocabulary)] = 0
        code = np.where(test.vocabulary[place] == h, place + 1, 0)
        # room[p]: known words from p on within the document
        stop = np.flatnonzero(np.append(code == 0, True))
        room = np.minimum(stop[np.searchsorted(stop, np.arange(len(h)))], first[doc + 1]) - np.arange(len(h))
        # a shard without room for any window needs no array
        order = suffix_order(code, room) if room.max() >= min(test.windows) else none
        for size, (keys, item, at) in test.windows.items():
            suffix = order[room[order] >= size]
            if not len(suffix):
                continue
            own = as_keys(code[suffix[:, None] + np.arange(size)])
            lo, hi = np.searchsorted(own, keys, "left"), np.searchsorted(own, keys, "right")
            n = hi - lo
            if not n.any():
                continue
            which = np.repeat(np.arange(len(keys)), n)
            p = suffix[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
            found.append((doc[p], p - first[doc[p]], np.full(len(p), size), item[which], at[which]))
    return np.diff(first), [np.concatenate(x) for x in zip(*found, strict=True)]


def summarize(words: np.ndarray, found, test: TestSuffixes) -> list[dict]:
    """One dict per document: word count, hit ranges, items, and the longest match per item."""
    doc, word, size, item, at = found
    out = [{"n_words": int(n), "hits": [], "matches": []} for n in words]
    order = np.lexsort((word, word - at, item, doc))
    doc, word, size, item, at = (x[order] for x in (doc, word, size, item, at))
    if not len(doc):
        return out
    follows = np.zeros(len(doc), bool)
    follows[1:] = (doc[1:] == doc[:-1]) & (item[1:] == item[:-1]) & (word[1:] - at[1:] == word[:-1] - at[:-1]) & (word[1:] == word[:-1] + 1)
    begin = np.flatnonzero(~follows)
    last = np.append(begin[1:], len(doc)) - 1
    length = word[last] + size[last] - word[begin]
    best: dict[tuple[int, str], tuple] = {}
    for d, i, w, a, n in zip(doc[begin], item[begin], word[begin], at[begin], length, strict=True):
        key = int(d), test.ids[i]
        if key not in best or (-best[key][2], best[key][0], best[key][1]) > (-n, w, a):
            best[key] = int(w), int(a), int(n)
    for (d, i), (w, a, n) in sorted(best.items()):
        out[d]["matches"].append({"item_id": i, "doc_word": w, "item_word": a, "n_words": n})
    spans = np.lexsort((word[begin], doc[begin]))
    for d, w, n in zip(doc[begin][spans], word[begin][spans], length[spans], strict=True):
        hits = out[d]["hits"]
        if hits and w <= hits[-1]["end"]:
            hits[-1]["end"] = max(hits[-1]["end"], int(w + n))
        else:
            hits.append({"start": int(w), "end": int(w + n)})
    return out


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int, window: int) -> tuple[int, Iterator[TestSuffixes]]:
    """How many blocks there are, and the blocks; a block is read to the driver only when it is used, and is about block_bytes at most."""
    b = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("i"), F.col(text_col).cast("string").alias("t")).filter("t is not null")
    total = b.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = 1 + total // block_bytes

    def read() -> Iterator[TestSuffixes]:
        for k in range(n):
            rows = b.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).distinct().orderBy("i", "t").collect()
            yield TestSuffixes([r.i for r in rows], [r.t for r in rows], window)

    return n, read()


def _passes(docs: DataFrame, blocks: Iterator[TestSuffixes], step: Callable) -> DataFrame:
    """The union of step(docs, broadcast block) over the blocks, each written before the next block is read."""
    out = None
    for test in blocks:
        block = docs.sparkSession.sparkContext.broadcast(test)
        found = materialize(step(docs, block))
        block.unpersist(blocking=False)
        out = found if out is None else out.unionByName(found)
    return out


def _scan(text_col: str, test, finish: Callable):
    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(batch.schema.get_field_index(text_col))):
                yield finish(batch.slice(lo, hi - lo), summarize(*search_shard(data, offsets, test.value), test.value))

    return run


def _merge(spans: list) -> list:
    """Hit ranges of several blocks as disjoint ones."""
    out: list = []
    for s in sorted(spans, key=lambda x: (x["start"], x["end"])):
        if out and s["start"] <= out[-1]["end"]:
            out[-1] = {"start": out[-1]["start"], "end": max(out[-1]["end"], s["end"])}
        else:
            out.append(dict(s))
    return out


def _longest(matches: list) -> list:
    """The longest match per item, of several blocks."""
    best: dict = {}
    for m in matches:
        b = best.get(m["item_id"])
        if b is None or (-b["n_words"], b["doc_word"], b["item_word"]) > (-m["n_words"], m["doc_word"], m["item_word"]):
            best[m["item_id"]] = m
    return [best[i] for i in sorted(best)]


def find_contamination(
    documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """id_col, n_words, hits (disjoint word ranges), matches (the longest per item): a row per document."""
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    hits, matches = (pa.list_(pa.struct([(f.name, pa.string() if f.name == "item_id" else pa.int64()) for f in k.fields])) for k in (SPAN, MATCH))
    fields = [T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(SPAN)), T.StructField("matches", T.ArrayType(MATCH))]
    columns = lambda rows: [pa.array([r["n_words"] for r in rows], pa.int64()), pa.array([r["hits"] for r in rows], hits), pa.array([r["matches"] for r in rows], matches)]
    names = [f.name for f in fields]
    n, blocks = benchmark_blocks(benchmark, item_col, item_text_col, block_bytes, window)
    if n == 1:
        finish = lambda part, rows: pa.RecordBatch.from_arrays([part.column("id"), *columns(rows)], names=["id", *names])
        block = docs.sparkSession.sparkContext.broadcast(next(blocks))
        return docs.mapInArrow(_scan("t", block, finish), T.StructType([docs.schema["id"], *fields])).select(F.col("id").alias(id_col), *names)
    rows = materialize(docs.withColumn("row", F.monotonically_increasing_id()))

    def found(part, out):
        some = [i for i, r in enumerate(out) if r["hits"]]
        return pa.RecordBatch.from_arrays([part.column("row").take(pa.array(some, pa.int64())), *columns([out[i] for i in some])], names=["row", *names])

    each = _passes(rows.select("row", "t"), blocks, lambda d, test: d.mapInArrow(_scan("t", test, found), T.StructType([T.StructField("row", T.LongType()), *fields])))
    # a row has one list from each block at most
    met = each.groupBy("row").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.flatten(F.collect_list("matches")).alias("matches"))

    def merge(batches):
        for batch in batches:
            h, m = ([list_ or [] for list_ in batch.column(c).to_pylist()] for c in ("hits", "matches"))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([_merge(x) for x in h], hits), pa.array([_longest(x) for x in m], matches)], names=["row", "hits", "matches"])

    merged = met.mapInArrow(merge, T.StructType([T.StructField("row", T.LongType()), *fields[1:]]))
    counted = rows.select("row", "id", "t").mapInArrow(_count_words, T.StructType([T.StructField("row", T.LongType()), docs.schema["id"], fields[0]]))
    none = (F.array().cast(f.dataType) for f in fields[1:])
    out = counted.join(merged, "row", "left").withColumns(dict(zip(names[1:], (F.coalesce(c, z) for c, z in zip(names[1:], none, strict=True)), strict=True)))
    return out.select(F.col("id").alias(id_col), *names)


def _count_words(batches):
    for batch in batches:
        for lo, hi, data, offsets in text_slices(batch.column("t")):
            _, _, first = word_hashes(LOWER[data], offsets, ALNUM_WORD)
            yield pa.RecordBatch.from_arrays([batch.column("row").slice(lo, hi - lo), batch.column("id").slice(lo, hi - lo), pa.array(np.diff(first))], names=["row", "id", "n_words"])


def decontaminate(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, with all their columns, in which no window of the benchmark occurs. No shuffle with one block."""
    n, blocks = benchmark_blocks(benchmark, item_col, item_text_col, block_bytes, window)
    if n == 1:
        clean = lambda part, rows: part.filter(pa.array([not r["hits"] for r in rows], pa.bool_()))
        block = documents.sparkSession.sparkContext.broadcast(next(blocks))
        return documents.mapInArrow(_scan(text_col, block, clean), documents.schema)
    own = [f"c{i}" for i in range(len(documents.columns))]
    rows = materialize(documents.toDF(*own).withColumn("row", F.monotonically_increasing_id()))
    hit = lambda part, out: pa.RecordBatch.from_arrays([part.column("row").filter(pa.array([bool(r["hits"]) for r in out], pa.bool_()))], names=["row"])
    gone = _passes(rows.select("row", F.col(own[documents.columns.index(text_col)]).alias("t")), blocks, lambda d, test: d.mapInArrow(_scan("t", test, hit), "row long")).distinct()
    return rows.join(gone, "row", "left_anti").select(*own).toDF(*documents.columns)
