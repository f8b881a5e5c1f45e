r"""Quality rules by a hashed n-gram log-likelihood ratio, in DataFrame functions only.

Every word and word pair of a text is hashed into a bin. Two multinomials are estimated over the bins: the
trusted target (documents that `labels` call good and not toxic) and the raw corpus (all documents). A document's
score is the mean over its n-grams of log(target share / raw share). The threshold is fixed by a rule, not by hand: the score under
which `trim` of the documents lie that the target is estimated on, less `slack` times the distance from there to their median. Every
document is kept or dropped by comparing its score with that one number.

The number of bins grows with the corpus, as the square root of its bytes (vocabularies grow about so): 2^15 for 2 MB, 2^19 for 0.8 GB, 2^28
for 100 TB. A task sends one count per bin it meets. The ratios are one array of four bytes a bin, made of blocks of `BLOCK` bins and sent to every task with the plan (2 MB for 0.8 GB, 16 MB for 30 GB, 1 GB for
100 TB); n-grams look theirs up by place, within the row, so that no n-gram is shuffled at any size. The target is estimated on all trusted documents: up to
`BROADCAST_IDS` of their ids are sent to every task; where there are more, the texts are shuffled once, to meet them by id.

Words are `[^\x20\x09-\x0D]+`. Defined cases: a null text has no words; texts with fewer than `min_words` words
fail the base rules; repeated rows are each judged and counted; without labels no document is trusted, all
ratios are 0 and only the base rules decide; null labels are not trusted; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import discard, materialize

#: Bins whose ratios are gathered into one array in one group.
BLOCK = 1 << 12
#: Up to so many trusted ids are sent to every task to mark documents; beyond, the documents are joined by id.
BROADCAST_IDS = 500_000
SPACES = r"[\x20\x09-\x0D]+"
#: Windows are packed as 40 bits of hash and 24 of position; longer texts take the slower exact way.
PACKED = 1 << 24


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def base_columns(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds w (words), h (their hashes) and the base counts n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words to docs, all computed within the row."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.withColumn("w", word_array(F.col(text_col)))
    d = d.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    # A window's hash stands at its first word; the last two places have none.
    d = d.withColumn(
        "g",
        F.when(
            F.size("h") >= 3,
            F.slice(F.transform("h", lambda x, i: F.coalesce(F.xxhash64(x, F.get("h", i + 1), F.get("h", i + 2)), F.lit(0))), F.lit(1), F.greatest(F.size("h") - 2, F.lit(0))),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(x, F.lit(" \t\n\x0b\f\r")) != "")
    d = d.withColumn("lines", lines)
    repeats = F.size(F.array_distinct("g")) < F.size("g")
    d = d.withColumn("packed", F.when(repeats, F.when(F.size("g") < PACKED, _packed_windows()).otherwise(_sorted_windows())))
    d = d.withColumn("packed", F.when(_mixed(), _sorted_windows()).otherwise(F.col("packed"))).withColumn("at", F.when(repeats, _repeated()))
    steps = F.aggregate(
        "at", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(3).cast("long"), p - a["last"])).alias("n"), p.alias("last")),
    )["n"]
    return d.withColumns(
        {
            "n_words": F.size("w").cast("long"),
            "word_chars": F.length(F.concat_ws("", "w")).cast("long"),
            "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "n_repeat_words": F.coalesce(steps, F.lit(0).cast("long")),
        }
    )


def _packed_windows() -> Column:
    """(hash, position) of every window in the order of 40 bits of the hash: as sorted longs, then taken apart."""
    return F.transform(
        F.sort_array(F.transform("g", lambda x, i: F.shiftleft(x, 24).bitwiseOR(i.cast("long")))),
        lambda v: F.struct(F.get("g", v.bitwiseAND(F.lit(PACKED - 1)).cast("int")).alias("g"), v.bitwiseAND(F.lit(PACKED - 1)).alias("i")),
    )


def _sorted_windows() -> Column:
    """The same in the order of the whole hash."""
    return F.sort_array(F.transform("g", lambda x, i: F.struct(x.alias("g"), i.cast("long").alias("i"))))


def _mixed() -> Column:
    """Whether windows with other hashes share the 40 bits of a neighbour, so that equal ones may not be neighbours."""
    rest = F.size("packed") - 1
    two = F.zip_with(F.slice("packed", F.lit(1), rest), F.slice("packed", F.lit(2), rest), lambda x, y: (F.shiftleft(x["g"], 24) == F.shiftleft(y["g"], 24)) & (x["g"] != y["g"]))
    return F.col("packed").isNotNull() & F.exists(two, lambda x: x)


def _repeated() -> Column:
    """Positions, ascending, of windows whose hash occurs at another position too."""
    same = lambda x, i, d: F.coalesce(F.get("packed", i + d)["g"] == x["g"], F.lit(False))
    return F.sort_array(F.transform(F.filter("packed", lambda x, i: same(x, i, -1) | same(x, i, 1)), lambda x: x["i"]))


def bins(docs: DataFrame) -> int:
    """A power of two, about 24 times the root of the bytes of text."""
    size = docs.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    return 1 << (-(-max(size, 1).bit_length() // 2) + 4)


def grams(docs: DataFrame, n_bins: int) -> DataFrame:
    """Adds b: the bins of all words (h) and word pairs."""
    words = F.transform("h", lambda x: F.pmod(x, F.lit(n_bins)))
    pairs = F.transform("h", lambda x, i: F.coalesce(F.pmod(F.xxhash64(x, F.get("h", i + 1)), F.lit(n_bins)), F.lit(0)))
    return docs.withColumn("b", F.concat(words, F.slice(pairs, F.lit(1), F.greatest(F.size("h") - 1, F.lit(0)))))


def with_good(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """Adds good: 1 where id is one of the trusted documents, which the target is estimated on. Few ids are broadcast, so that no text is
    shuffled to meet its label."""
    good = trusted.withColumn("good", F.lit(1))
    good = F.broadcast(good) if trusted.count() <= BROADCAST_IDS else good
    return docs.join(good, "id", "left").withColumn("good", F.coalesce("good", F.lit(0)))


def counts(docs: DataFrame, n_bins: int) -> DataFrame:
    """b, raw, target: n-grams of all documents and of the good ones by bin, a row for every bin."""
    d = docs.select(F.transform(word_array(F.col("t")), lambda x: F.xxhash64(x)).alias("h"), "good")
    # outer: an inner explode adds a filter on b, which is then pushed below and evaluates the arrays anew per element
    met = grams(d, n_bins).select("good", F.explode_outer("b").alias("b")).groupBy("b").agg(F.count("*").alias("raw"), F.sum("good").alias("target")).filter("b is not null")
    every = docs.sparkSession.range(n_bins).select(F.col("id").alias("b"))
    return materialize(every.join(met, "b", "left").select("b", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target")))


def ratios(found: DataFrame, n_bins: int) -> DataFrame:
    """r: one row with an array over the bins: log of the target's share of a bin over the raw corpus's, both with one added to every bin; zeros without a target."""
    total = found.agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).first()
    r = F.lit(0.0)
    if total.target:
        r = F.log((F.col("target") + 1) / F.lit(float(total.target + n_bins))) - F.log((F.col("raw") + 1) / F.lit(float(total.raw + n_bins)))
    one = found.select(F.shiftright("b", BLOCK.bit_length() - 1).alias("block"), F.struct("b", r.cast("float").alias("r")).alias("x"))
    blocks = one.groupBy("block").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["r"]).alias("r"))
    return blocks.agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("block", "r"))), lambda x: x["r"])).alias("r"))


def mean_ratio(docs: DataFrame, ratio: DataFrame) -> DataFrame:
    """docs(b, ...) with llr: the mean ratio over the bins b of each row, null without any. The array is a variable of the session, which the plan takes over as a constant."""
    spark, name = docs.sparkSession, f"cairn_ratio_{uuid.uuid4().hex}"
    ratio.createOrReplaceTempView(name)
    spark.sql(f"DECLARE VARIABLE {name}_v ARRAY<FLOAT>")
    spark.sql(f"SET VAR {name}_v = (SELECT r FROM {name})")
    out = docs.withColumn("llr", F.expr(f"CASE WHEN size(b) > 0 THEN aggregate(b, 0D, (a, x) -> a + get({name}_v, CAST(x AS INT))) / size(b) END"))
    spark.sql(f"DROP TEMPORARY VARIABLE {name}_v")
    spark.catalog.dropTempView(name)
    return out


def percentiles(values: DataFrame, name: str, shares: list[float]) -> list[float] | None:
    """The exact percentiles of a column without nulls, linear between neighbours; None without rows. Distinct values are range-sorted, and only
    those next to a percentile come to the driver, with one total per partition."""
    order = values.groupBy(F.col(name).alias("x")).agg(F.count("*").alias("n")).repartitionByRange("x").withColumn("part", F.spark_partition_id())
    order = materialize(order)
    begin, total = {}, 0
    for r in order.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():
        begin[r.part] = total
        total += r.n
    if not total:
        discard(order)
        return None
    at = [share * (total - 1) for share in shares]
    found = {}
    for rank in {f(p) for p in at for f in (math.floor, math.ceil)}:
        part = max((p for p in begin if begin[p] <= rank), key=begin.get)
        run = F.sum("n").over(W.partitionBy("part").orderBy("x").rowsBetween(W.unboundedPreceding, W.currentRow))
        upto = order.filter(F.col("part") == part).withColumn("end", F.lit(begin[part]) + run)
        found[rank] = upto.filter(F.col("end") > rank).agg(F.min("x")).first()[0]
    discard(order)
    # at a rank itself the two neighbours are one
    return [found[lo] if lo == hi else (hi - p) * found[lo] + (p - lo) * found[hi] for p in at for lo, hi in [(math.floor(p), math.ceil(p))]]


def assess(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, trim: float = 0.005, slack: float = 1.0) -> DataFrame:
    """id_col, the base counts, base_failed, llr (mean log ratio, null without words), threshold, kept: a row per document."""
    trusted = materialize(labels.filter("quality = 1 and coalesce(toxic, 0) = 0").select(F.col(id_col).alias("id")).distinct())
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    n_bins = bins(docs)
    found = counts(with_good(docs, trusted), n_bins)
    ratio = ratios(found, n_bins)
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    d = grams(base_columns(docs, "t"), n_bins)
    scored = materialize(mean_ratio(d, ratio).select("id", *base, "llr"))
    discard(found)
    # one score per trusted id
    low_mid = percentiles(scored.filter("llr is not null").join(trusted, "id", "left_semi").groupBy("id").agg(F.min("llr").alias("llr")), "llr", [trim, 0.5])
    cut = low_mid[0] - slack * (low_mid[1] - low_mid[0]) if low_mid else None
    discard(trusted)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return scored.select(
        F.col("id").alias(id_col), *base, failed.alias("base_failed"), "llr", F.lit(cut).cast("double").alias("threshold"),
        (~failed & (F.coalesce(F.col("llr") >= F.lit(cut), F.lit(True)))).alias("kept"),
    )
