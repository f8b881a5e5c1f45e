r"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A text's words (A-Z lower-cased, then runs of 0-9, a-z and everything beyond ASCII) are read in windows of `WINDOW` words that begin every `STRIDE` words, so that
each word stands in two windows; the last window ends with the text, and shorter texts are filled up with blanks that attention leaves out. A word is given to the network by its own
embedding (of the words that several training texts hold; others share one) and by the embeddings of its character grams, summed: three and five bytes
around each of its bytes, ends marked. Two gated recurrent layers read a
window from both ends, attention pools their states, and a logistic unit scores the window. A text's logit is the highest of its windows, made a
probability by Platt's scaling on training texts that the network was not fitted on.

The network is trained in numpy, in one task, on a bounded sample: of each label the `max_training` labelled rows of smallest id hash, as far as their texts have no
more than `max_bytes` bytes. Labels belong to texts, not windows: of toxic texts the windows are learned that score highest, at first by the log odds of
their words and grams, then by the network itself; of others those that score highest and some more. What is broadcast is the network, of fixed size. Scoring is
one pass over the documents, without a shuffle, over all windows of whole texts.

Defined cases: null and word-less texts get the score of a text whose windows all score as low as the lowest of the sample; without labels the score is 0, with labels of one kind only
that kind's; null labels and null ids of labels are not learned, and a label that is given twice counts as its highest; repeated rows are
scored each; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textbytes import ALNUM_WORD, LOWER, prefix_hash, span_hash, text_slices, word_spans

WINDOW, STRIDE = 16, 8
MAX_TRAINING = 1200
MAX_BYTES = 1 << 13
MAX_VOCABULARY = 1 << 15
MIN_TEXTS = 3
HIDDEN, WORD_DIM, CHAR_DIM, ATTENTION = 8, 8, 8, 8
GRAM_BITS = 15
#: Bytes of text and windows that are scored at once.
SLICE, CHUNK = 1 << 20, 2048
UNKNOWN, BLANK = 0, 1


class Words:
    """The distinct words of a slice of bytes: their hashes and character grams, and which of them each word is."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        data = LOWER[data]
        self.start, self.end, self.doc = word_spans(data, offsets, ALNUM_WORD)
        self.first = np.zeros(len(offsets), np.int64)
        np.cumsum(np.bincount(self.doc, minlength=len(offsets) - 1), out=self.first[1:])
        h = span_hash(prefix_hash(data), self.start, self.end)
        self.hash, at, self.which = np.unique(h, return_index=True, return_inverse=True)
        size = (self.end - self.start)[at]
        #: Character grams of each distinct word, those around its first byte first: two per byte.
        self.sizes = 2 * size
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        left = np.repeat(size, size) - 1 - place
        byte = np.repeat(self.start[at], size) + place
        wide = np.concatenate([data, [0, 0]]).astype(np.uint64)
        # beyond a word's ends stand bytes that no word holds
        around = [np.where(place < -k, 0, np.where(left < k, 1, wide[byte + k])).astype(np.uint64) for k in range(-2, 3)]
        three, five = np.uint64(0), np.uint64(1)
        for k, b in enumerate(around):
            five = five << np.uint64(8) | b
            three = three << np.uint64(8) | b if 1 <= k <= 3 else three
        self.grams = (np.stack([three, five], 1).ravel() * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - GRAM_BITS)).astype(np.int64)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(windows x WINDOW) of distinct words, blank where there is none, and each window's document."""
        n = np.diff(self.first)
        count = np.where(n == 0, 0, np.where(n <= WINDOW, 1, -(-(n - WINDOW) // STRIDE) + 1))
        doc = np.repeat(np.arange(len(n)), count)
        k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        start = np.minimum(k * STRIDE, np.maximum(n[doc] - WINDOW, 0))
        place = start[:, None] + np.arange(WINDOW)
        there = place < n[doc][:, None]
        blank = len(self.hash)
        return np.where(there, np.append(self.which, blank)[np.minimum(self.first[doc][:, None] + place, len(self.which))], blank), doc


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    x = np.sort(x)
    return x[np.append(np.ones(min(1, len(x)), bool), x[1:] != x[:-1])]


def added(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """n rows, with the values added to those that they are for."""
    return np.stack([np.bincount(rows, values[:, c], n) for c in range(values.shape[1])], 1)


class Network:
    """Parameters by name; forward and backward passes over windows."""

    def __init__(self, vocabulary: np.ndarray, seed: int = 13):
        rng = np.random.default_rng(seed)
        some = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.vocabulary = vocabulary
        self.p = {
            "word": some(len(vocabulary) + 2, WORD_DIM, scale=0.3), "char": some(1 << GRAM_BITS, CHAR_DIM, scale=0.3), "enter": some(WORD_DIM + CHAR_DIM, 6 * HIDDEN, scale=0.3), "bias": np.zeros(6 * HIDDEN, np.float32),
            "turn": some(2, HIDDEN, 3 * HIDDEN, scale=0.3), "look": some(2 * HIDDEN, ATTENTION, scale=0.3), "look_bias": np.zeros(ATTENTION, np.float32), "see": some(ATTENTION, scale=0.3),
            "say": some(2 * HIDDEN, scale=0.3), "say_bias": np.zeros(1, np.float32),
        }
        self.calibration = np.array([1.0, 0.0, 0.0])

    def known(self, h: np.ndarray) -> np.ndarray:
        """Rows of the word embedding."""
        if not len(self.vocabulary):
            return np.full(len(h), UNKNOWN)
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == h, at + 2, UNKNOWN)

    def inputs(self, known: np.ndarray, grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """What the distinct words and the blank, which is last, are to the network: word and character parts."""
        out = np.zeros((len(known) + 1, WORD_DIM + CHAR_DIM), np.float32)
        out[:-1, :WORD_DIM] = self.p["word"][known]
        out[-1, :WORD_DIM] = self.p["word"][BLANK]
        if len(known):
            out[:-1, WORD_DIM:] = np.add.reduceat(self.p["char"][grams], np.cumsum(sizes) - sizes, axis=0) / np.sqrt(sizes)[:, None]
        return out

    def table(self, inputs: np.ndarray) -> np.ndarray:
        return inputs @ self.p["enter"] + self.p["bias"]

    def forward(self, table: np.ndarray, windows: np.ndarray, kept: list | None = None) -> np.ndarray:
        """The windows' logits. kept gets what the way back needs."""
        blank, n, half = len(table) - 1, len(windows), 3 * HIDDEN
        ahead, back = np.ascontiguousarray(table[:, :half]), np.ascontiguousarray(table[:, half:])
        columns = np.ascontiguousarray(windows.T)
        state, turn = np.zeros((2, n, HIDDEN), np.float32), self.p["turn"]
        states = np.empty((WINDOW, n, 2 * HIDDEN), np.float32)
        x, steps = np.empty((2, n, half), np.float32), []
        for k in range(WINDOW):
            np.take(ahead, columns[k], axis=0, out=x[0])
            np.take(back, columns[WINDOW - 1 - k], axis=0, out=x[1])
            moved = np.matmul(state, turn)
            gates = x[..., : 2 * HIDDEN] + moved[..., : 2 * HIDDEN]
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            update, reset = gates[..., :HIDDEN], gates[..., HIDDEN:]
            new = moved[..., 2 * HIDDEN :] * reset
            new += x[..., 2 * HIDDEN :]
            np.tanh(new, out=new)
            if kept is not None:
                steps.append((state, update, reset, new, moved[..., 2 * HIDDEN :]))
            state = update * (state - new)
            state += new
            states[k, :, :HIDDEN] = state[0]
            states[WINDOW - 1 - k, :, HIDDEN:] = state[1]
        seen = np.tanh(states @ self.p["look"] + self.p["look_bias"])
        weight = seen @ self.p["see"]
        weight[columns == blank] = -1e9
        weight -= weight.max(0)
        np.exp(weight, out=weight)
        weight /= weight.sum(0)
        pooled = np.einsum("tn,tnh->nh", weight, states)
        if kept is not None:
            kept.extend((steps, states, seen, weight, pooled))
        return pooled @ self.p["say"] + self.p["say_bias"][0]

    def backward(self, kept: list, d_logit: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the parameters behind the table, and of the table's row at each place: (windows x WINDOW x 6 HIDDEN)."""
        steps, states, seen, weight, pooled = kept
        n, half = len(d_logit), 3 * HIDDEN
        g = {"say": pooled.T @ d_logit, "say_bias": np.array([d_logit.sum()], np.float32)}
        d_pooled = d_logit[:, None] * self.p["say"]
        d_states = weight[..., None] * d_pooled
        d_weight = np.einsum("nh,tnh->tn", d_pooled, states)
        d_score = weight * (d_weight - (weight * d_weight).sum(0))
        g["see"] = np.einsum("tn,tna->a", d_score, seen)
        d_seen = d_score[..., None] * self.p["see"] * (1 - seen * seen)
        g["look"], g["look_bias"] = np.einsum("tnh,tna->ha", states, d_seen), d_seen.sum((0, 1))
        d_states += d_seen @ self.p["look"].T
        d_x, d_state, g["turn"] = np.empty((WINDOW, n, 2 * half), np.float32), np.zeros((2, n, HIDDEN), np.float32), np.zeros_like(self.p["turn"])
        for k in range(WINDOW - 1, -1, -1):
            before, update, reset, new, moved = steps[k]
            d_state[0] += d_states[k, :, :HIDDEN]
            d_state[1] += d_states[WINDOW - 1 - k, :, HIDDEN:]
            d_new = d_state * (1 - update) * (1 - new * new)
            d_update = d_state * (before - new) * update * (1 - update)
            d_reset = d_new * moved * reset * (1 - reset)
            d_moved = np.concatenate([d_update, d_reset, d_new * reset], -1)
            d_in = np.concatenate([d_update, d_reset, d_new], -1)
            d_x[k, :, :half], d_x[WINDOW - 1 - k, :, half:] = d_in[0], d_in[1]
            g["turn"] += np.matmul(before.transpose(0, 2, 1), d_moved)
            d_state = d_state * update + np.matmul(d_moved, self.p["turn"].transpose(0, 2, 1))
        return g, d_x.transpose(1, 0, 2)

    def gradients(self, known, grams, sizes, windows, d_logit_of) -> dict[str, np.ndarray]:
        """Gradients of all parameters; d_logit_of turns logits into the loss's gradient."""
        x, kept = self.inputs(known, grams, sizes), []
        logit = self.forward(self.table(x), windows, kept)
        g, d_place = self.backward(kept, d_logit_of(logit).astype(np.float32))
        flat = windows.ravel()
        order = np.argsort(flat, kind="stable")
        rows, begin = np.unique(flat[order], return_index=True)
        d_table = np.zeros((len(x), 6 * HIDDEN), np.float32)
        d_table[rows] = np.add.reduceat(d_place.reshape(len(flat), -1)[order], begin, axis=0)
        g["enter"], g["bias"] = x.T @ d_table, d_table.sum(0)
        d_input = d_table @ self.p["enter"].T
        g["word"] = added(np.append(known, BLANK), d_input[:, :WORD_DIM], len(self.p["word"]))
        g["char"] = added(grams, np.repeat(d_input[:-1, WORD_DIM:] / np.sqrt(sizes)[:, None], sizes, axis=0), len(self.p["char"]))
        return g

    def logits(self, words: Words, windows: np.ndarray) -> np.ndarray:
        table = self.table(self.inputs(self.known(words.hash), words.grams, words.sizes))
        return np.concatenate([np.zeros(0, np.float32), *(self.forward(table, windows[lo : lo + CHUNK]) for lo in range(0, len(windows), CHUNK))])

    def probability(self, logit: np.ndarray) -> np.ndarray:
        slope, shift, _ = self.calibration
        return 1 / (1 + np.exp(-np.clip(slope * logit + shift, -60, 60)))

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, vocabulary=self.vocabulary, calibration=self.calibration, **self.p)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Network:
        with np.load(io.BytesIO(raw)) as f:
            net = cls(np.zeros(0, np.uint64))
            net.vocabulary, net.calibration = f["vocabulary"], f["calibration"]
            net.p = {k: f[k] for k in net.p}
        return net


class Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float = 0.01, decay: float = 1e-4):
        self.p, self.rate, self.decay, self.t = p, rate, decay, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def step(self, g: dict[str, np.ndarray]) -> None:
        self.t += 1
        rate = self.rate * (1 - 0.999**self.t) ** 0.5 / (1 - 0.9**self.t)
        for k, x in self.p.items():
            self.m[k] += 0.1 * (g[k] - self.m[k])
            self.v[k] += 0.001 * (g[k] * g[k] - self.v[k])
            x -= rate * self.m[k] / (np.sqrt(self.v[k]) + 1e-7) + self.rate * self.decay * x


def platt(logit: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through the labels, with a slight pull towards slope 1: Newton's method."""
    a, b = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * logit + b, -60, 60)))
        s, e = weight * p * (1 - p), weight * (p - label)
        grad = np.array([e @ logit + (a - 1), e.sum() + 0.01 * b])
        curve = np.array([[s @ (logit * logit) + 1, s @ logit], [s @ logit, s.sum() + 0.01]])
        move = np.linalg.solve(curve, grad)
        a, b = a - float(np.clip(move[0], -1, 1)), b - float(np.clip(move[1], -2, 2))
    return max(a, 0.05), b


def train(texts: list[str], labels: np.ndarray, share: float, rounds: int = 3, epochs: int = 3, batch: int = 256, least_steps: int = 100, seed: int = 13) -> Network:
    """A network for texts with labels 0 and 1, both of which occur. share: of all labelled rows, those of label 1. Every fifth text of each label
    is kept for the calibration (all, where a label has fewer than ten)."""
    rng = np.random.default_rng(seed)
    data = pa.array(texts, pa.large_string())
    (_, _, raw, offsets), = text_slices(data, 1 << 62)
    words = Words(raw, offsets)
    windows, owner = words.windows()
    nth = np.zeros(len(texts), np.int64)
    for y in (0, 1):
        nth[labels == y] = np.arange((labels == y).sum())
    apart = (nth % 5 == 4) & (min((labels == 0).sum(), (labels == 1).sum()) >= 10)
    fitted = ~apart
    n = [(fitted & (labels == y)).sum() for y in (0, 1)]

    def log_odds(text: np.ndarray, thing: np.ndarray, things: int) -> tuple[np.ndarray, np.ndarray]:
        """How much likelier a fitted text of label 1 holds a thing (0 for what few hold), and how many hold it."""
        pair = distinct(text * max(1, things) + thing)
        text, thing = pair // max(1, things), pair % max(1, things)
        held = [np.bincount(thing[fitted[text] & (labels[text] == y)], minlength=things) for y in (0, 1)]
        odds = np.log((held[1] + 0.5) / (n[1] + 1)) - np.log((held[0] + 0.5) / (n[0] + 1))
        return np.where(held[0] + held[1] >= MIN_TEXTS, odds, 0.0), held[0] + held[1]

    odds, common = log_odds(words.doc, words.which, len(words.hash))
    ends = np.cumsum(words.sizes)
    if len(words.hash):
        in_text = distinct(words.doc * len(words.hash) + words.which)
        used, size = in_text % len(words.hash), words.sizes[in_text % len(words.hash)]
        at = np.repeat(ends[used] - size, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        of_grams, _ = log_odds(np.repeat(in_text // len(words.hash), size), words.grams[at], 1 << GRAM_BITS)
        odds = odds + np.maximum.reduceat(of_grams[words.grams], ends - words.sizes)
    odds = np.append(odds, -np.inf)
    often = np.flatnonzero(common >= MIN_TEXTS)
    often = often[np.lexsort((words.hash[often], -common[often]))][:MAX_VOCABULARY]
    net = Network(np.sort(words.hash[often]), seed)
    adam, score = Adam(net.p), odds[windows].max(1) if len(windows) else np.zeros(0)
    known = net.known(words.hash)
    of_label = labels[owner] if len(owner) else owner
    for _ in range(rounds if len(windows) else 0):
        # place of each window among those of its text, by score downwards
        order = np.lexsort((-score, owner))
        first = np.searchsorted(owner[order], owner[order], "left")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order)) - first
        chosen = np.flatnonzero(fitted[owner] & np.where(of_label == 1, place < 2, (place < 4) | (rng.random(len(owner)) < 0.2)))
        y = of_label[chosen]
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
        per_epoch = -(-len(chosen) // batch)
        for _ in range(max(epochs, -(-least_steps // max(1, per_epoch)))):
            mixed = rng.permutation(len(chosen))
            for lo in range(0, len(chosen), batch):
                own = mixed[lo : lo + batch]
                used, local = np.unique(windows[chosen[own]], return_inverse=True)
                local = local.reshape(len(own), WINDOW)
                if used[-1] == len(words.hash):
                    used = used[:-1]
                sizes = words.sizes[used]
                at = np.repeat(ends[used] - sizes, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                target, w = y[own], weight[own]
                adam.step(net.gradients(known[used], words.grams[at], sizes, local, lambda z, target=target, w=w: w * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / len(w)))
        score = net.logits(words, windows)
    low = float(score.min()) if len(windows) else 0.0
    best = np.full(len(texts), low)
    np.maximum.at(best, owner, score)
    held_back = apart if apart.any() else np.ones(len(texts), bool)
    y = labels[held_back]
    weight = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum())) * len(y)
    net.calibration = np.array([*platt(best[held_back], y, weight), low])
    return net


def _fit(share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r["k"], r["y"], r["t"]) for b in batches for r in b.to_pylist())
        labels = np.array([r[1] for r in rows], np.int64)
        if len(set(labels.tolist())) == 2:
            yield pa.RecordBatch.from_arrays([pa.array([train([r[2] for r in rows], labels, share).to_bytes()], pa.binary())], names=["net"])

    return run


def sample(docs: DataFrame, labels: DataFrame, max_training: int, max_bytes: int) -> DataFrame:
    """docs(id, held_out, t) and labels(id, y) -> k, y, t: the bounded training sample. Ids are broadcast, at most twice max_training of them; texts are not shuffled but for the
    sample itself, which meets in one task."""
    key = F.xxhash64("id")
    ids = None
    for y in (0, 1):
        one = labels.filter(F.col("y") == y).orderBy(key, "id").limit(max_training)
        ids = one if ids is None else ids.unionByName(one)
    fit = docs.filter(~F.col("held_out") & (F.octet_length("t") <= max_bytes))
    return fit.join(F.broadcast(ids), "id").select(F.xxhash64("id", "t").alias("k"), "y", "t").dropDuplicates(["k", "y"]).repartition(1)


def _score(net, blank: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = Network.from_bytes(net.value) if net is not None else None
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1), SLICE):
                out = np.full(hi - lo, blank)
                if n is not None:
                    out = n.probability(text_logits(n, data, offsets))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(out, pa.float64())], names=["id", "score"])

    return run


def text_logits(net: Network, data: np.ndarray, offsets: np.ndarray, most: int = 4 * SLICE) -> np.ndarray:
    """The highest logit among the windows of each text. A text of more than `most` bytes is read in parts that begin where a window does and end behind a word."""
    best = np.full(len(offsets) - 1, net.calibration[2])
    if len(data) <= most:
        words = Words(data, offsets)
        windows, owner = words.windows()
        np.maximum.at(best, owner, net.logits(words, windows))
        return best
    lo, n = 0, len(data)
    while lo < n:
        hi = min(lo + most, n)
        while hi < n and ALNUM_WORD[LOWER[data[hi]]]:
            hi += 1
        words = Words(data[lo:hi], np.array([0, hi - lo]))
        windows, _ = words.windows()
        full = max(0, (len(words.which) - WINDOW) // STRIDE + 1)
        if hi < n and full > 1:
            # whole windows only; the next part begins with the last of them, so that the text's last window is whole too
            windows, lo = windows[:full], lo + int(words.start[(full - 1) * STRIDE])
        elif hi < n:
            most, hi = 2 * most, lo
            continue
        else:
            lo = n
        best[0] = max(best[0], net.logits(words, windows).max(initial=-np.inf))
    return best


def score_toxicity(
    documents: DataFrame, labels: DataFrame, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.3, max_training: int = MAX_TRAINING, max_bytes: int = MAX_BYTES
) -> DataFrame:
    """id_col, held_out, score, predicted: a row per document. Rows for which held_out is true are not learned from."""
    spark = documents.sparkSession
    held = F.coalesce(held_out, F.lit(False)) if held_out is not None else F.lit(False)
    docs = documents.select(F.col(id_col).alias("id"), held.alias("held_out"), F.col(text_col).cast("string").alias("t"))
    told = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    # ids only
    told = told.join(docs.filter("not held_out").select("id").distinct(), "id", "left_semi")
    counts = {r.y: r.n for r in told.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    rows = sample(docs, told, max_training, max_bytes).mapInArrow(_fit(share), "net binary").collect()
    net = spark.sparkContext.broadcast(bytes(rows[0].net)) if rows else None
    key = T.StructType([docs.schema["id"], docs.schema["held_out"]])
    out = docs.select(F.struct("id", "held_out").alias("id"), "t").mapInArrow(_score(net, float(share)), T.StructType([T.StructField("id", key), T.StructField("score", T.DoubleType())]))
    return out.select(F.col("id.id").alias(id_col), "id.held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
