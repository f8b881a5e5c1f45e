"""Clashing column names, empty tables, ties, repeated rows and texts of more than a megabyte, for every operator."""

import pytest
from pyspark.sql import functions as F

from cairn.llm import chat, decontaminate, fixity, jaccard, langid, packing, quality, secret_scan, suffix_dedup, token_counts

from . import brute
from .test_operators import texts

P = pytest.importorskip("public_tokenizers")
ITEMS = "item_id long, text string"
LABELS = "doc_id long, quality int, toxic int"
CLASHES = ("_spans", "_key", "_gone", "_bad", "_hit", "_w", "_t", "h", "id", "key", "words", "spans", "hits", "kept", "n", "row", "part", "start", "length", "size", "count", "value", "score", "lang_pred", "component_id", "class_id", "sequence_id")


def results(docs, items, labels):
    word, piece = P.path("word_bpe_49k.json"), P.path("piece_bpe_32k.model")
    return {
        "pack": lambda: packing.pack(docs, word).select("doc_id", "start", "length", "doc_tokens"),
        "assess": lambda: quality.assess(docs, labels).select("doc_id", "n_words", "n_repeat_words", "base_failed"),
        "remove_repeats": lambda: suffix_dedup.remove_repeats(docs).select("doc_id", "n_bytes", F.size("spans")),
        "find_contamination": lambda: decontaminate.find_contamination(docs, items).select("doc_id", "n_words", F.size("hits")),
        "decontaminate": lambda: decontaminate.decontaminate(docs, items).select("doc_id"),
        "scan_secrets": lambda: secret_scan.scan_secrets(docs).select("doc_id", F.size("spans")),
        "redact": lambda: secret_scan.redact(docs).select("doc_id", "text"),
        "identify": lambda: langid.identify(docs).select("doc_id", "lang_pred"),
        "keep_identified": lambda: langid.keep_identified(docs).select("doc_id"),
        "jaccard_classes": lambda: jaccard.jaccard_classes(docs).select("doc_id", "n_shingles", "component_id"),
        "keep_one": lambda: jaccard.keep_one(docs).select("doc_id"),
        "count_pieces": lambda: token_counts.count_pieces(docs, piece).select("doc_id", "n_pieces"),
    }


def plain(df):
    return sorted(map(repr, map(tuple, df.collect())))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 5 == 0 else "ab"[i % 2], f"s{i % 3}") for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame([(1, " ".join(texts()[6].split(" ")[3:30]))], ITEMS), spark.createDataFrame([(5, 1, 0), (6, 1, 0)], LABELS)


def test_clashing_names(docs, tables):
    more = docs.withColumns({c: F.lit(c) for c in CLASHES})
    want, got = results(docs, *tables), results(more, *tables)
    for name, f in got.items():
        assert plain(f()) == plain(want[name]()), name


def test_empty(spark, docs, tables):
    """Without documents there are no rows; without items or labels every document keeps its row."""
    none = docs.limit(0)
    for name, f in results(none, *tables).items():
        assert f().count() == 0, name
    bare = results(docs, spark.createDataFrame([], ITEMS), spark.createDataFrame([], LABELS))
    n = len(texts())
    assert bare["decontaminate"]().count() == bare["find_contamination"]().count() == bare["assess"]().count() == n
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], "conv_id long, seq long, kind string, message_id string, role string, text string"))).count() == 0
    pages = fixity.records(spark.createDataFrame([], "page_id long, url string, html string"))
    assert fixity.audit(pages, pages).count() == 0


def test_long_texts(spark):
    """Two texts of 1 MB that share all but their ends, one word of 1 MB, and a short one."""
    body = " ".join(f"w{i * 7919 % 1000003}" for i in range(130000))
    rows = [(1, body + " left", "a", "s"), (2, body + " right", "a", "s"), (3, "y" * (1 << 20), "b", "s"), (4, "short text of words", "b", "s")]
    long_, whole = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), [r[1] for r in rows]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(long_).collect()} == brute.op7([r[:2] for r in rows])
    left = {r.doc_id: r.kept for r in suffix_dedup.remove_repeats(long_).select("doc_id", F.decode("kept", "UTF-8").alias("kept")).collect()}
    # all of a text of one letter starts again at its next byte
    assert left[3] == "" and left[4] == whole[3] and left[1].strip() == "left" and left[2].strip() == "right"
    sizes = {r.doc_id: (r.n, r.m) for r in packing.pack(long_, P.path("word_bpe_49k.json")).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()}
    assert all(n == m for n, m in sizes.values()) and sizes[1][0] > 130000
    pieces = {r.doc_id: r.n_pieces for r in token_counts.count_pieces(long_, P.path("piece_bpe_32k.model")).collect()}
    assert pieces[1] > 130000 and pieces[4] < 10
    item = spark.createDataFrame([(1, " ".join(body.split(" ")[-40:-20]))], ITEMS)
    assert {r.doc_id for r in decontaminate.decontaminate(long_, item).collect()} == {3, 4}
    assert langid.identify(long_).count() == secret_scan.scan_secrets(long_).count() == quality.assess(long_, spark.createDataFrame([(1, 1, 0)], LABELS)).count() == 4


def test_repeats_and_ties(spark, docs):
    """A row that comes twice gives two equal rows; null ids are kept."""
    rows = [(1, "the same words here", "a"), (1, "the same words here", "a"), (None, "other words there", "b"), (None, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("source", F.lit("s"))
    assert langid.identify(d).count() == token_counts.count_pieces(d, P.path("piece_bpe_32k.model")).count() == 4
    assert decontaminate.find_contamination(d, spark.createDataFrame([(None, "the same words here"), (2, "the same words here")], ITEMS)).filter(F.size("hits") > 0).count() == 2
    e = [(1, 0, "message", None, "user", "b"), (1, 0, "message", None, "user", "a"), (1, 0, "message", None, "user", "a"), (1, 1, "message", "m", "assistant", "x"), (1, 2, "edit", "m", None, "y"), (None, 0, "message", None, "user", "n")]
    got = {r.conv_id: r.texts for r in chat.read_back(chat.format_conversations(spark.createDataFrame(e, "conv_id long, seq long, kind string, message_id string, role string, text string"))).collect()}
    assert got == {1: ["a", "a", "b", "y"], None: ["n"]}
