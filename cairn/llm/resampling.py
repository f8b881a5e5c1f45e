r"""Importance resampling towards a target distribution.

Texts become bags of hashed runs of one and two words. A bucket's gain is the log of its share in the target over its share in the raw corpus, in
thousandths. A document's weight is the mean gain of its features, its score that weight plus Gumbel noise from a hash of its id; the documents of highest
score are drawn, which is a draw without replacement by weight.

Each task sums what its texts hold into an array over the buckets and sends that; the gains are an array of the same fixed length, sent to the tasks, in
which features look up their gain. Scores are integers, so nothing is sorted as a whole: counts per score, summed from the highest down, tell how many
documents stand before each score, and so the score at which the draw ends. Ranks within a score are row numbers by id. Only counts per score go to the
driver's side of a broadcast: there are as many as scores, which differ by the spread of gains and noise, never by rows.

Words: A-Z lower-cased, then runs of 0-9, a-z and everything beyond ASCII. Features: every run of 1 to 2 words, joined by a blank; the bucket is the
unsigned crc32 of its UTF-8 bytes modulo `buckets`.

Defined cases: a null or word-less text has no features and weight 0; a null id is hashed as an empty one and comes before all others; repeated rows are
scored, counted and ranked each, in no fixed order among themselves; without documents there are no rows, and an empty target leaves gains that only count
how rare a bucket is; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .common import materialize
from .textbytes import ALNUM_WORD, LOWER, text_slices, word_spans

BUCKETS = 10_000
#: Words up to so many bytes go through tables; longer ones are hashed one by one.
TABLED = 32

_tables: list[np.ndarray] = []


def _crc_table() -> np.ndarray:
    """crc32 state after each byte from state 0."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


def crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """The byte table, and for each length up to TABLED what that many zero bytes do to each of a state's four bytes: the state is linear in them."""
    if not _tables:
        byte = _crc_table()
        shift = np.zeros((TABLED + 1, 4, 256), np.uint32)
        for k in range(4):
            shift[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
        for n in range(1, TABLED + 1):
            shift[n] = byte[shift[n - 1] & 0xFF] ^ (shift[n - 1] >> np.uint32(8))
        _tables.extend((byte, shift))
    return _tables[0], _tables[1]


def crc_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """crc32 of each data[start:end], byte by byte over all spans at once, the longest first so that those at their end drop out."""
    byte, _ = crc_tables()
    size = end - start
    order = np.argsort(-np.minimum(size, TABLED + 1), kind="stable")
    s, n = start[order], size[order]
    short = int(np.searchsorted(-n, -TABLED, "left")) if len(n) else 0
    state = np.full(len(n), 0xFFFFFFFF, np.uint32)
    live = len(n)
    for k in range(int(n[short]) if short < len(n) else 0):
        live = int(np.searchsorted(-n[short:live], -k, "left")) + short
        state[short:live] = byte[(state[short:live] ^ data[s[short:live] + k]) & 0xFF] ^ (state[short:live] >> np.uint32(8))
    out = np.empty(len(n), np.uint32)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    whole = data.tobytes() if short else b""
    for i in order[:short]:
        out[i] = zlib.crc32(whole[start[i] : end[i]])
    return out


def crc_joined(data: np.ndarray, start: np.ndarray, end: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """crc32 of each word, a blank and the next word, from the words' own: the first part's state moved on by the second's length, plus the second's."""
    byte, shift = crc_tables()
    left = crc[:-1]
    # the blank
    left = byte[(left ^ np.uint32(0xFFFFFFFF) ^ np.uint32(0x20)) & 0xFF] ^ ((left ^ np.uint32(0xFFFFFFFF)) >> np.uint32(8)) ^ np.uint32(0xFFFFFFFF)
    size = (end - start)[1:]
    n = np.minimum(size, TABLED)
    moved = shift[n, 0, left & 0xFF]
    for k in range(1, 4):
        moved ^= shift[n, k, (left >> np.uint32(8 * k)) & 0xFF]
    out = moved ^ crc[1:]
    if (far := np.flatnonzero(size > TABLED)).size:
        whole = data.tobytes()
        for i in far:
            out[i] = zlib.crc32(whole[start[i + 1] : end[i + 1]], int(left[i]))
    return out


def feature_buckets(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, document) of every feature, and the words of each document."""
    data = LOWER[data]
    start, end, doc = word_spans(data, offsets, ALNUM_WORD)
    crc = crc_spans(data, start, end)
    two = np.flatnonzero(doc[1:] == doc[:-1])
    pairs = crc_joined(data, start, end, crc)[two] if len(two) else np.zeros(0, np.uint32)
    return (np.concatenate([crc, pairs]) % np.uint32(buckets)).astype(np.int64), np.concatenate([doc, doc[two]]), np.bincount(doc, minlength=len(offsets) - 1)


def _sums(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(0)):
                total += np.bincount(feature_buckets(data, offsets, buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, buckets: int) -> DataFrame:
    """texts(t) -> bucket, n: features per bucket; a task sends one number per bucket at most."""
    return texts.mapInArrow(_sums(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int) -> list[int]:
    """The gain of each bucket, in thousandths: an array of fixed length."""
    both = raw.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    rows = both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect()
    s, t = np.zeros(buckets), np.zeros(buckets)
    for r in rows:
        s[r.bucket], t[r.bucket] = r.s, r.t
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64).tolist()


def _weights(gain: list[int], buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = np.array(gain, np.int64)
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                bucket, doc, words = feature_buckets(data, offsets, buckets)
                n = np.bincount(doc, minlength=hi - lo)
                total = np.zeros(hi - lo, np.int64)
                np.add.at(total, doc, of[bucket])
                weight = np.where(n > 0, total // np.maximum(n, 1), 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(words), pa.array(n), pa.array(weight)], names=["id", "words", "n_features", "weight"])

    return run


def noise(doc_id, seed: int):
    """Gumbel noise in thousandths, from the first 8 hex digits of sha256 of `seed:id`."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def draw(scored: DataFrame, percent: int, min_words: int) -> DataFrame:
    """scored(id, words, n_features, weight, score), a written table, with rank: 1, 2, 3... by score downwards, then id, for the drawn; null for the rest.
    What is broadcast has a row per score: at most the range of gains and noise in thousandths, whatever the number of rows."""
    fit = F.col("words") >= min_words
    counts = scored.filter(fit).groupBy("score").agg(F.count("*").alias("n"))
    w = W.orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, W.currentRow)
    counts = counts.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(W.partitionBy()))
    # before: documents of higher scores; no score below the cutoff has any that are drawn
    ahead = counts.select("score", (F.col("upto") - F.col("n")).alias("before"), F.floor(F.col("total") * percent / F.lit(100)).cast("long").alias("quota")).filter(F.col("before") < F.col("quota"))
    d = scored.join(F.broadcast(ahead), "score", "left")
    surviving = fit & F.col("before").isNotNull()
    place = F.col("before") + F.row_number().over(W.partitionBy("score").orderBy(F.col("id").asc_nulls_first()))
    drawn = d.filter(surviving).withColumn("rank", place).withColumn("rank", F.when(F.col("rank") <= F.col("quota"), F.col("rank")).cast("long"))
    rest = d.filter(~surviving).withColumn("rank", F.lit(None).cast("long"))
    own = ["id", "words", "n_features", "weight", "score", "rank"]
    return drawn.select(*own).unionByName(rest.select(*own))


def resample(
    documents: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", percent: int = 25, min_words: int = 20, seed: int = 7, buckets: int = BUCKETS
) -> DataFrame:
    """id_col, n_features, weight, score, rank: a row per document, rank null for those that are not drawn."""
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    gain = gains(bucket_counts(docs.select("t"), buckets), bucket_counts(target.select(F.col(target_text_col).cast("string").alias("t")), buckets), buckets)
    schema = T.StructType([docs.schema["id"], *(T.StructField(c, T.LongType()) for c in ("words", "n_features", "weight"))])
    scored = docs.mapInArrow(_weights(gain, buckets), schema).withColumn("score", F.col("weight") + noise(F.col("id"), seed))
    return draw(materialize(scored), percent, min_words).select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
