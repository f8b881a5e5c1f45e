r"""Language identification by interpolated Kneser-Ney character models.

Texts are lower-cased and every run of non-letters becomes one space. Per language the `order`-grams of all training
texts are counted (each task sends sums, not grams). The highest order uses those counts, the lower ones continuation
counts, with one absolute discount per order from the counts of counts. Models live in arrays sorted by the
grams' 64-bit hash, with a probability per language and order; a text's score per language is its
cross-entropy per character, and the lowest wins.

Calibration: on the training texts that a language has won, the mean of the cross-entropy, its deviation between texts and that of one
character; a text more than `reject_sigmas` of both, the latter over the root of its length, above the mean is rejected (as is `und`). The score is the winner's
posterior over `evidence` characters at most.

The models are fitted on about `max_training` labelled documents of each language, those of smallest hash, with whole texts and all their grams, and none
applies to a language with fewer. Where the grams of these make a model of more than `MODEL_NUMBERS` numbers (many languages, or scripts of many signs), the half of smaller hash is counted instead, as
often as it takes: the sample is bounded by the size of the model too, and no gram of a sampled text is left out.

Defined cases: null texts and texts without a letter are `und` with score 0, and rejected; null languages are not learned; with no
training texts at all everything is `und`; equal cross-entropies go to the first language in string order; repeated rows count and
are answered each; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize
from .textbytes import freeing, mix

ORDER = 4
MAX_TRAINING = 100_000
#: Numbers of four bytes that a broadcast model may have: grams times languages, twice. Four times fewer grams of all languages come to the driver.
MODEL_NUMBERS = 1 << 25
SLICE_CHARS = 1 << 18
SPACE = 32

_fold: list[np.ndarray] = []


def fold_table() -> np.ndarray:
    """Code point -> lower-case letter (a single code point), or space."""
    if not _fold:
        t = np.full(0x110000, SPACE, np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                t[c] = ord(low) if len(low) == 1 else c
        _fold.append(t)
    return _fold[0]


def letter_runs(texts: list[str | None]):
    """Folded code points of all texts behind each other, each text between two spaces, and where each begins."""
    table, parts, sizes = fold_table(), [], []
    for t in texts:
        c = table[np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), np.uint32)]
        space = c == SPACE
        keep = np.ones(len(c), bool)
        keep[1:] = ~(space[1:] & space[:-1])
        c = c[keep]
        if len(c) and c[0] == SPACE:
            c = c[1:]
        if len(c) and c[-1] == SPACE:
            c = c[:-1]
        if len(c):
            c = np.concatenate([[SPACE], c, [SPACE]]).astype(np.uint32)
        parts.append(c)
        sizes.append(len(c))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32), np.cumsum([0, *sizes])


def gram_hash(codes: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of the n code points that end at each place (the first n - 1 places are meaningless)."""
    h = np.zeros(len(codes), np.uint64)
    for k in range(n):
        h *= np.uint64(0x100000001B3)
        h[k:] += codes[: len(codes) - k].astype(np.uint64) * np.uint64(pow(1_000_003, k, 1 << 64)) if k else codes.astype(np.uint64)
    return mix(h + np.uint64(n))


def windows(codes: np.ndarray, begin: np.ndarray, n: int) -> np.ndarray:
    """Places at which a whole n-gram of one text ends."""
    at = np.arange(len(codes))
    first = np.repeat(begin[:-1], np.diff(begin))
    return at[at - first >= n - 1]


def _slices(batches, size: int = SLICE_CHARS):
    for batch in batches:
        lo, seen = 0, 0
        lengths = pc.fill_null(pc.utf8_length(batch.column("t")), 0).to_pylist()
        for i, n in enumerate(lengths):
            seen += n
            if seen >= size or i + 1 == len(lengths):
                yield batch.slice(lo, i + 1 - lo)
                lo, seen = i + 1, 0


def _count(order: int):
    def run(batches):
        for part in _slices(batches):
            langs = np.array(part.column("lang").to_pylist(), object)
            texts = part.column("t").to_pylist()
            for lang in sorted(set(langs)):
                codes, begin = letter_runs([t for t, x in zip(texts, langs, strict=True) if x == lang])
                at = windows(codes, begin, order)
                if not len(at):
                    continue
                _, first, n = np.unique(gram_hash(codes, order)[at], return_index=True, return_counts=True)
                gram = codes[at[first][:, None] + np.arange(1 - order, 1)].astype("<u4").view(f"<U{order}").ravel()
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram)), pa.array(gram.tolist(), pa.string()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    return run


def training_sample(docs: DataFrame, most: int) -> DataFrame:
    """Of docs(id, lang, t) those with text and language, about `most` of each language: rows under a bar on the hash of id and text."""
    rows = docs.filter("lang is not null and t is not null")
    share = {r.lang: most / r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect() if r.n > most}
    if not share:
        return rows
    bar = F.coalesce(F.create_map(*(F.lit(x) for kv in sorted(share.items()) for x in kv))[F.col("lang")], F.lit(1.0))
    return rows.filter(F.pmod(F.xxhash64("id", "t"), F.lit(1 << 30)) < bar * (1 << 30))


def count_grams(training: DataFrame, order: int) -> DataFrame:
    """training(lang, t) -> lang, gram, n."""
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("gram", T.StringType()), T.StructField("n", T.LongType())])
    return training.select("lang", "t").mapInArrow(freeing(_count(order)), schema).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Interpolated Kneser-Ney probabilities of several languages over the same sorted hash arrays."""

    def __init__(self, rows: dict[str, tuple[np.ndarray, np.ndarray]], order: int):
        self.langs, self.order = sorted(rows), order
        self.hash: list[np.ndarray] = []
        self.logp: list[np.ndarray] = []
        self.backoff: list[np.ndarray] = []
        self.floor = np.zeros(0, np.float32)
        if not rows:
            return
        grams: list[dict] = []  # per language: length -> (codes matrix, counts)
        for lang in self.langs:
            gram, n = rows[lang]
            codes = np.frombuffer("".join(gram).encode("utf-32-le"), np.uint32).reshape(-1, order)
            levels = {order: (codes, n.astype(float))}
            for size in range(order - 1, 0, -1):
                below, count = np.unique(levels[size + 1][0][:, 1:], axis=0, return_counts=True)
                levels[size] = below, count.astype(float)
            grams.append(levels)
        keys = {n: np.unique(np.concatenate([matrix_hash(g[n][0]) for g in grams])) for n in range(1, order + 1)}
        lower: list[np.ndarray] = []  # probability per language of every key of the order below
        alphabet = max(1, len(keys[1]))
        for n in range(1, order + 1):
            p = np.zeros((len(keys[n]), len(self.langs)))
            held = np.zeros((len(keys[n - 1]) if n > 1 else 1, len(self.langs)))
            lower_now = []
            for k, levels in enumerate(grams):
                codes, count = levels[n]
                ones, twos = (count == 1).sum(), (count == 2).sum()
                d = ones / (ones + 2 * twos) if ones and twos else 0.5
                here = np.searchsorted(keys[n], matrix_hash(codes))
                if n == 1:
                    total = count.sum()
                    rest = d * len(count) / total if total else 1.0
                    held[0, k] = rest
                    p[:, k] = rest / (alphabet + 1)
                    p[here, k] += (count - d) / max(total, 1)
                else:
                    context = matrix_hash(codes[:, :-1])
                    names, inverse = np.unique(context, return_inverse=True)
                    total = np.bincount(inverse, count)
                    weight = d * np.bincount(inverse) / total
                    own = np.searchsorted(keys[n - 1], names)
                    found = keys[n - 1][np.minimum(own, len(keys[n - 1]) - 1)] == names
                    column = np.ones(len(keys[n - 1]))
                    column[own[found]] = weight[found]
                    held[:, k] = column
                    lower_now.append((here, (count - d) / total[inverse], weight[inverse]))
            if n > 1:
                # each key's suffix and context in the order below, known to some language as both are parts of a seen gram
                codes = np.concatenate([g[n][0] for g in grams])
                _, first = np.unique(matrix_hash(codes), return_index=True)
                suffix = np.minimum(np.searchsorted(keys[n - 1], matrix_hash(codes[first][:, 1:])), len(keys[n - 1]) - 1)
                prefix_hash = matrix_hash(codes[first][:, :-1])
                prefix = np.minimum(np.searchsorted(keys[n - 1], prefix_hash), len(keys[n - 1]) - 1)
                known = (keys[n - 1][prefix] == prefix_hash)[:, None]
                p = np.where(known, held[prefix], 1.0) * lower[-1][suffix]
                for k, (here, extra, weight) in enumerate(lower_now):
                    p[here, k] = extra + weight * lower[-1][suffix[here], k]
            lower.append(p)
            self.hash.append(keys[n])
            self.logp.append(np.log(np.maximum(p, 1e-12)).astype(np.float32))
            self.backoff.append(np.log(np.maximum(held, 1e-12)).astype(np.float32))
        self.floor = self.backoff[0][0] - np.log(alphabet + 1)

    def _find(self, n: int, h: np.ndarray) -> np.ndarray:
        """Place in the sorted hashes of order n, -1 where absent."""
        keys = self.hash[n - 1]
        if not len(keys):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where(keys[at] == h, at, -1)

    def log_probabilities(self, codes: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """log p of each code point given those before it in its text, per language."""
        room = np.arange(len(codes)) - np.repeat(begin[:-1], np.diff(begin))
        out = np.zeros((len(codes), len(self.langs)), np.float32)
        left = np.arange(len(codes))
        for n in range(self.order, 0, -1):
            fits = room[left] >= n - 1
            at = np.full(len(left), -1)
            h = gram_hash(codes, n)
            at[fits] = self._find(n, h[left[fits]])
            hit = at >= 0
            out[left[hit]] += self.logp[n - 1][at[hit]]
            left, fits = left[~hit], fits[~hit]
            if n > 1 and len(left):
                # back off: weight of the context, where it is known
                back = fits & (left > 0)
                context = np.full(len(left), -1)
                context[back] = self._find(n - 1, gram_hash(codes, n - 1)[left[back] - 1])
                known = context >= 0
                out[left[known]] += self.backoff[n - 1][context[known]]
        out[left] += self.floor
        return out

    def cross_entropy(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages) nats per character; characters per text, 0 where it has no letter."""
        codes, begin = letter_runs(texts)
        n = np.diff(begin)
        out = np.zeros((len(texts), len(self.langs)))
        some = n > 0
        if some.any() and self.langs:
            out[some] = -np.add.reduceat(self.log_probabilities(codes, begin).astype(np.float64), begin[:-1][some], axis=0) / n[some, None]
        return out, n


def matrix_hash(codes: np.ndarray) -> np.ndarray:
    """gram_hash of each row."""
    n = codes.shape[1]
    h = np.zeros(len(codes), np.uint64)
    for k in range(n):
        h *= np.uint64(0x100000001B3)
        h += codes[:, n - 1 - k].astype(np.uint64) * np.uint64(pow(1_000_003, k, 1 << 64)) if k else codes[:, n - 1].astype(np.uint64)
    return mix(h + np.uint64(n))


def train(training: DataFrame, order: int = ORDER, numbers: int = MODEL_NUMBERS) -> Model:
    """training(lang, t) -> model of `numbers` numbers at most, from all of the texts or from a half, a quarter... of them, by hash."""
    for halvings in range(40):
        share = training if not halvings else training.filter(F.shiftrightunsigned(F.xxhash64("t", F.lit("sample")), 64 - halvings) == 0)
        counts = materialize(count_grams(share, order))
        size = counts.agg(F.count("*").alias("n"), F.count_distinct("lang").alias("langs"), F.count_distinct("gram").alias("grams")).first()
        if max(4 * size.n, 2 * size.grams * size.langs) <= numbers:
            break
        discard(counts)
    rows = counts.toPandas()
    discard(counts)
    return Model({lang: (g["gram"].to_numpy(), g["n"].to_numpy()) for lang, g in rows.groupby("lang")}, order)


ADDED = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("cross_entropy", T.DoubleType()), T.StructField("n_letters", T.LongType())]


def _predict(model, evidence: int, carried: list[str]):
    def run(batches):
        m = model.value
        for part in _slices(batches):
            ce, n = m.cross_entropy(part.column("t").to_pylist())
            some = (n > 0) & bool(m.langs)
            rows = np.arange(len(n))
            best = ce.argmin(1) if m.langs else np.zeros(len(n), int)
            low = ce[rows, best] if m.langs else np.zeros(len(n))
            score = 1 / np.exp(-(ce - low[:, None]) * np.minimum(n, evidence)[:, None]).sum(1) if m.langs else np.zeros(len(n))
            pred = [m.langs[b] if s else "und" for b, s in zip(best, some, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(x) for x in carried), pa.array(pred, pa.string()), pa.array(np.where(some, score, 0.0)), pa.array(low, pa.float64(), mask=~some), pa.array(n, pa.int64())],
                names=[*carried, *(f.name for f in ADDED)],
            )

    return run


def judge(docs: DataFrame, carried: list[str], order: int, max_training: int, evidence: int, reject_sigmas: float) -> DataFrame:
    """docs(id, lang, held_out, t, ...) -> the carried columns, the prediction and whether it is rejected. Two passes over the texts: to count, and to predict."""
    spark = docs.sparkSession
    model = train(training_sample(docs.filter("not held_out"), max_training), order)
    kept = [*carried, *(c for c in ("lang", "held_out") if c not in carried)]
    schema = T.StructType([*(docs.schema[c] for c in kept), *ADDED])
    found = materialize(docs.mapInArrow(freeing(_predict(spark.sparkContext.broadcast(model), evidence, kept)), schema))
    won = found.filter("not held_out and lang = lang_pred").groupBy("lang")
    x, n = F.col("cross_entropy"), F.col("n_letters")
    stats = won.agg(F.avg(x).alias("m"), F.coalesce(F.stddev_pop(x), F.lit(0.0)).alias("s"), F.avg(n * x * x).alias("nxx"), F.avg(n * x).alias("nx"), F.avg(n).alias("n")).collect()
    # spread between texts, and that of one character, which short texts average less of
    fixed = {r.lang: r.m + reject_sigmas * r.s for r in stats}
    per_root = {r.lang: reject_sigmas * max(r.nxx - 2 * r.m * r.nx + r.m**2 * r.n, 0.0) ** 0.5 for r in stats}
    of = lambda d: F.create_map(*(F.lit(v) for kv in sorted(d.items()) for v in kv))[F.col("lang_pred")] if d else F.lit(None).cast("double")
    limit = of(fixed) + of(per_root) / F.sqrt(n)
    return found.withColumn("rejected", (F.col("lang_pred") == "und") | F.coalesce(F.col("cross_entropy") > limit, F.lit(False)))


def identify(
    documents: DataFrame, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    order: int = ORDER, max_training: int = MAX_TRAINING, evidence: int = 20, reject_sigmas: float = 6.0,
) -> DataFrame:
    """id_col, held_out, lang_pred, score, cross_entropy, rejected: a row per document. Rows for which held_out is
    true are not learned from."""
    held = F.coalesce(held_out, F.lit(False)) if held_out is not None else F.lit(False)
    docs = documents.select(F.col(id_col).alias("id"), held.alias("held_out"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("t"))
    found = judge(docs, ["id"], order, max_training, evidence, reject_sigmas)
    return found.select(F.col("id").alias(id_col), "held_out", "lang_pred", "score", "cross_entropy", "rejected")


def keep_identified(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, max_training: int = MAX_TRAINING, evidence: int = 20, reject_sigmas: float = 6.0
) -> DataFrame:
    """The documents, with all their columns, whose language is not rejected. The prediction is written beside the rows, which so need not be
    shuffled to meet their verdict."""
    own = [f"c{i}" for i in range(len(documents.columns))]
    at = dict(zip(documents.columns, own, strict=True))
    docs = documents.toDF(*own).select("*", F.col(at[id_col]).alias("id"), F.col(at[lang_col]).cast("string").alias("lang"), F.lit(False).alias("held_out"), F.col(at[text_col]).cast("string").alias("t"))
    return judge(docs, own, order, max_training, evidence, reject_sigmas).filter("not rejected").select(*own).toDF(*documents.columns)
