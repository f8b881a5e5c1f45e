"""The toxicity network: its windows and gradients against plain versions, and what it learns."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairn.llm import toxicity as tox
from cairn.llm.textbytes import text_slices

from .test_operators import texts


def words_of(items):
    ((_, _, data, offsets),) = text_slices(pa.array(items, pa.large_string()), 1 << 62)
    return tox.Words(data, offsets), data, offsets


def plain_windows(text):
    w = re.findall(r"[0-9a-zA-Z\x80-\U0010ffff]+", text or "")
    if not w:
        return []
    starts = [*range(0, max(len(w) - tox.WINDOW, 0) + 1, tox.STRIDE)]
    if len(w) > tox.WINDOW and starts[-1] + tox.WINDOW < len(w):
        starts.append(len(w) - tox.WINDOW)
    return [len(w[s : s + tox.WINDOW]) for s in starts], len(w)


def test_windows():
    items = [*texts(), *(" ".join("ab" for _ in range(n)) for n in (1, 15, 16, 17, 23, 24, 25, 40))]
    words, _, _ = words_of(items)
    windows, owner = words.windows()
    for i, t in enumerate(items):
        own = windows[owner == i]
        want = plain_windows(t)
        assert (own < len(words.hash)).sum(1).tolist() == (want[0] if want else [])
        if want and len(own):
            # every word stands in a window, in order
            first = words.which[words.first[i] : words.first[i + 1]]
            assert own[0][: min(tox.WINDOW, want[1])].tolist() == first[: tox.WINDOW].tolist() and own[-1][own[-1] < len(words.hash)].tolist() == first[-min(tox.WINDOW, want[1]) :].tolist()


def test_gradients():
    words, _, _ = words_of(["some words of a text that is long enough to have more than one window of its own here " * 2, "short é"])
    windows, _ = words.windows()
    net = tox.Network(np.sort(words.hash[::2]))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    known = net.known(words.hash)
    loss = lambda: float((net.forward(net.table(net.inputs(known, words.grams, words.sizes)), windows) ** 2).sum())
    g = net.gradients(known, words.grams, words.sizes, windows, lambda z: 2 * z)
    rng = np.random.default_rng(0)
    for name, x in net.p.items():
        for at in [np.unravel_index(np.argmax(np.abs(g[name])), x.shape), *(tuple(rng.integers(0, n) for n in x.shape) for _ in range(2))]:
            was, step, sides = x[at], 1e-2, []
            for d in (step, -step):
                x[at] = was + d
                sides.append(loss())
            x[at] = was
            assert g[name][at] == pytest.approx((sides[0] - sides[1]) / (2 * step), rel=2e-2, abs=2e-3), name


def test_long_texts_in_parts():
    rng = random.Random(5)
    text = " ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(1, 9))) for _ in range(3000)) + " " + "x" * 3000
    words, data, offsets = words_of([text])
    net = tox.Network(np.sort(words.hash[:50]))
    windows, _ = words.windows()
    whole = net.logits(words, windows).max()
    for most in (200, 999, 5000):
        assert tox.text_logits(net, data, offsets, most)[0] == pytest.approx(whole, abs=1e-5)
    again = tox.Network.from_bytes(net.to_bytes())
    assert tox.text_logits(again, data, offsets)[0] == pytest.approx(whole, abs=1e-5)


def corpus(n=400):
    """Texts of random words; toxic ones hold some words with a stem of their own, at any place."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice(("an", "re", "ti", "on", "sh", "ou")) for _ in range(rng.randint(1, 4)))
    rows = []
    for i in range(n):
        w = [word() for _ in range(rng.randint(5, 120))]
        if y := int(i % 4 == 0):
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(("grumpf", "zorg" + word()))
        rows.append((i, " ".join(w), y))
    return rows


DOC, LABEL = "doc_id long, text string", "doc_id long, toxic int, quality int"


def test_toxicity(spark):
    rows = corpus()
    more = [(1000, None), (1001, ""), (1002, " .,! "), (1003, rows[0][1]), (1003, rows[0][1]), (None, rows[1][1]), (1004, rows[1][1] + " " + "an re ti " * 60_000 + " " + rows[4][1])]
    docs = spark.createDataFrame([r[:2] for r in rows] + more, DOC).withColumns({c: F.lit(c) for c in ("id", "t", "y", "k", "score", "held_out", "net", "toxic")}).repartition(3)
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows] + [(0, 0, 1), (None, 1, 1), (1000, 1, 1), (2, None, 1)], LABEL).withColumn("t", F.lit(1))
    got = tox.score_toxicity(docs, labels, F.col("doc_id") % 5 == 2)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    out = got.collect()
    assert len(out) == len(rows) + len(more) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    held = [(by[i][0].predicted, y) for i, _, y in rows if by[i][0].held_out]
    assert len(held) == 80 and np.mean([p == y for p, y in held]) >= 0.95
    assert by[1000][0].score == by[1001][0].score == by[1002][0].score < 0.3
    assert len(by[1003]) == 2 and by[1003][0].score == pytest.approx(by[1003][1].score, abs=1e-6) and by[1003][0].score == pytest.approx(by[0][0].score, abs=1e-4)
    assert by[1004][0].predicted == 1 and by[None][0].score == pytest.approx(by[1][0].score, abs=1e-4)


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([r[:2] for r in corpus(12)], DOC)
    for labels, want in (([], 0.0), ([(i, 0, 1) for i in range(6)], 0.0), ([(i, 1, 1) for i in range(6)], 1.0)):
        got = tox.score_toxicity(docs, spark.createDataFrame(labels, LABEL)).collect()
        assert len(got) == 12 and {r.score for r in got} == {want}
    assert tox.score_toxicity(docs.limit(0), spark.createDataFrame([(1, 1, 1), (2, 0, 1)], LABEL)).count() == 0
