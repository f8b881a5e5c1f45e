"""Importance resampling and fill-in-the-middle against plain Python, with nulls, empty and long texts, ties and repeats."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairn.llm import fill_middle, resampling
from cairn.llm.textbytes import ALNUM_WORD, LOWER, text_slices, word_spans

from . import brute
from .test_operators import texts

MORE = [*texts(), "word " * 30, "é" * 40 + " " + "x" * 90 + " b", "a<P>b c d", "<", "  lead and trail \t\n", "<S <M> x", "Ωμέγα straße 10% λ" * 9, "tab\tonly\x0b\x0cx\xa0y z"]
DOC = "doc_id long, text string"


def rows(n=3):
    return [(i, MORE[i % len(MORE)]) for i in range(n * len(MORE))]


def test_crc_of_spans():
    text = "a bc def " + "y" * 31 + " " + "z" * 32 + " " + "w" * 33 + " " + "v" * 500 + " é end " + "u" * 64
    for _, _, data, offsets in text_slices(pa.array([text, "", None, "next one"])):
        start, end, _ = word_spans(LOWER[data], offsets, ALNUM_WORD)
        raw = data.tobytes()
        words = [raw[a:b] for a, b in zip(start, end, strict=True)]
        crc = resampling.crc_spans(data, start, end)
        assert crc.tolist() == [zlib.crc32(w) for w in words]
        assert resampling.crc_joined(data, start, end, crc).tolist() == [zlib.crc32(a + b" " + b) for a, b in zip(words, words[1:], strict=False)]
    assert len(resampling.crc_spans(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64))) == 0


def test_resampling(spark):
    items = [texts()[6], None, "", "word words " + texts()[7]]
    docs = spark.createDataFrame(rows(), DOC).withColumns({c: F.lit(1) for c in ("score", "rank", "words", "t", "id", "before", "weight")}).repartition(3)
    target = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    got = {r.doc_id: (r.n_features, r.weight, r.score, r.rank) for r in resampling.resample(docs, target).collect()}
    assert got == brute.op11(rows(), items)
    none = resampling.resample(docs.limit(0), target)
    assert none.count() == 0 and none.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    bare = resampling.resample(docs, target.limit(0)).filter("rank is not null").count()
    assert bare == len([v for v in brute.op11(rows(), []).values() if v[3]])


def test_resampling_ties(spark):
    """Equal scores go by id; a repeated row and a null id are ranked each; a draw that ends within a score."""
    long_ = "same words of a text " * 10
    d = spark.createDataFrame([(i, 25, 49, 5, 100 + i // 10) for i in (*range(40), 7)] + [(None, 25, 49, 5, 103), (99, 3, 5, 9, 900)], "id long, words long, n_features long, weight long, score long")
    got = sorted((r.rank, -1 if r.id is None else r.id, r.score) for r in resampling.draw(d, 30, 20).filter("rank is not null").collect())
    assert got == [(k + 1, i, 103 if k < 11 else 102) for k, i in enumerate([-1, *range(30, 40), 20])]
    twice = spark.createDataFrame([(1, long_), (1, long_), (None, long_), (2, None)], DOC)
    assert resampling.resample(twice, twice.select(F.lit(1).alias("item_id"), "text"), percent=100).filter("rank is not null").count() == 3


@pytest.mark.parametrize("part", [1 << 15, 5])
def test_fill_middle(spark, part):
    docs = spark.createDataFrame(rows(), DOC).withColumns({c: F.lit(1) for c in ("n", "t", "cut", "form", "prefix", "id", "h1", "output")}).repartition(3)
    d = fill_middle.transform(docs, part_chars=part)
    d = d.withColumn("back", fill_middle.restore(F.col("output"), F.col("form")))
    got = {r.doc_id: (r.n, r.form, None if r.prefix is None else len(r.prefix), None if r.middle is None else len(r.middle), brute.sha(r.output), brute.sha(r.back)) for r in d.collect()}
    assert got == {i: brute.op12(i, t) for i, t in rows()}
    assert {v[1] for v in got.values()} == {"plain", "psm", "spm"}


def test_fill_middle_cases(spark):
    long_ = "wörter und\tmehr " * 70_000
    d = spark.createDataFrame([(None, "x y z"), (None, "x y z"), (3, None), (4, long_), (5, "y" * 1_100_000), (6, " " * 1_000)], DOC)
    got = [(r.doc_id, r.n, r.form, r.ok) for r in fill_middle.transform(d, fim_percent=100).join(d.distinct().withColumnRenamed("doc_id", "i"), F.col("doc_id").eqNullSafe(F.col("i"))).select("doc_id", "n", "form", (fill_middle.restore(F.col("output"), F.col("form")) == F.coalesce("text", F.lit(""))).alias("ok")).collect()]
    assert sorted((i or 0, n) for i, n, _, _ in got) == [(0, 3), (0, 3), (3, 0), (4, 210_001), (5, 1), (6, 1)] and all(x[3] for x in got)
    assert {i: f for i, _, f, _ in got}[3] == "plain" and fill_middle.transform(d.limit(0)).count() == 0


def test_parts_cut_no_unit():
    s, whole = fill_middle.Splitter(4), fill_middle.Splitter()
    for t in [*filter(None, MORE), "  a  b", "a  ", "   ", "aaaaaaaa bbbbbbbbbb  c"]:
        assert s.ends(t).tolist() == whole.ends(t).tolist() and "".join(p for _, p in fill_middle.parts(t, 4)) == t
