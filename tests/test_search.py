"""Containment, pages and ranking of many queries against plain Python."""

import random

import pytest

from cairn.operators import search

from .test_project import rows


def test_containing(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 6)))
    texts = [(rng.choice("rq"), i, " ".join(word() for _ in range(rng.randint(0, 12)))) for i in range(60)] + [("r", 100, None), ("r", 101, "")]
    terms = [(rng.choice("rq"), i, word() + rng.choice(("", " " + word()))) for i in range(60)] + [("r", 100, None), ("r", 101, "")]
    t, k = spark.createDataFrame(texts, "repo string, text_id int, text string"), spark.createDataFrame(terms, "repo string, term_id int, term string")
    for size in (2, 3):
        want = {(i, j) for a, i, x in texts for b, j, y in terms if a == b and x and y and len(y) >= size and y in x}
        assert set(rows(search.containing(t, k, size), "text_id", "term_id")) == want


def test_containing_meets_long_texts_once(spark):
    """A text of a megabyte travels to its terms once: no plan node holds it more often than there are texts."""
    rng = random.Random(1)
    long_ = "".join(rng.choice("abcdefghij ") for _ in range(1 << 20))
    t = spark.createDataFrame([("r", 1, long_), ("r", 2, long_[:1000] + "needle")], "repo string, text_id int, text string")
    terms = [("r", i, long_[i * 5000 : i * 5000 + 12]) for i in range(100)] + [("r", 200, "needle"), ("r", 201, "no such term")]
    got = search.containing(t, spark.createDataFrame(terms, "repo string, term_id int, term string"), 6)
    assert set(rows(got, "text_id", "term_id")) == {(1, i) for i in range(100)} | {(2, 0), (2, 200)}


@pytest.mark.parametrize(("offset", "size"), [(0, 3), (7, 4), (95, 10), (200, 5), (0, 1000)])
def test_pages(spark, offset, size):
    values = [(i * 37) % 101 for i in range(101)]
    df = spark.createDataFrame([(v, v % 3) for v in values], "v int, w int").repartition(5)
    want = sorted((v % 3, v) for v in values)
    got = search.page(df, ["w", "v"], offset, size).orderBy("ord").collect()
    size = min(size, 200)
    assert [(r.w, r.v, r.ord) for r in got] == [(*x, offset + i) for i, x in enumerate(want[offset : offset + size])]
    assert all(r.total == 101 and r.next_offset == (offset + size if offset + size < 101 else None) for r in got)


def test_ordinals_of_ties_and_nothing(spark):
    got, n = search.ordinals(spark.createDataFrame([(1,)] * 50 + [(0,)] * 3 + [(None,)], "v int").repartition(7), ["v"])
    assert n == 54 and sorted(r.ord for r in got.collect()) == list(range(54)) and rows(got.filter("ord < 4").fillna(-1), "v") == [(-1,), (0,), (0,), (0,)]
    none, n = search.ordinals(spark.createDataFrame([], "v int"), ["v"])
    assert n == 0 and none.count() == 0


def test_rank_batch(spark):
    items = spark.createDataFrame([("shop-1", "Order", "takes orders"), ("shop-2", "OrderLine", "a line"), ("line-3", None, "of order"), ("x", "y", None)], "id string, title string, text string")
    q = spark.createDataFrame([(1, "order"), (2, "line shop"), (3, "nothing here"), (4, None), (5, "ORDER order")], "query_id int, query string")
    got = {k: [(r.item, r.score) for r in sorted((r for r in search.rank_batch(items, q).collect() if r.query_id == k), key=lambda r: r.place)] for k in range(1, 6)}
    assert got == {1: [("shop-1", 27), ("shop-2", 15), ("line-3", 7)], 2: [("shop-2", 24), ("line-3", 7), ("shop-1", 7)], 3: [], 4: [], 5: [("shop-1", 27), ("shop-2", 15), ("line-3", 7)]}
    assert [r.item for r in search.rank_batch(items, q, 1).filter("query_id = 2").collect()] == ["shop-2"]


def test_records_of_a_file(spark):
    r = spark.createDataFrame([(i, "f" if i % 2 else "g", "Some Text") for i in range(300)], "i int, file string, t string")
    got = search.search_records(r, "some t", file="f").collect()
    assert len(got) == 100 and all(x.truncated and x.file == "f" for x in got) and [x.i for x in got[:2]] == [1, 3]
    assert [x.truncated for x in search.search_records(r.filter("i < 5"), "TEXT", file="g").collect()] == [False] * 3 and search.search_records(r, "none").count() == 0
