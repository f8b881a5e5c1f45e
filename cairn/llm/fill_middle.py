r"""Fill-in-the-middle transformation.

The tokenizers library's Split pre-tokenizer with isolated regex matches cuts a text into units and gives their code-point offsets; nothing is trained.
The length of the offset array is n; two ranks, drawn from a hash of the document's id, pick the offsets at which prefix and middle end. Slices, output and
digests are column functions, so that texts stay in the JVM and only two offsets a row come back from Python.

Units are `[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+`. A unit always ends where a blank follows a word, so long texts are handed to the library in parts
that end there: no unit is cut and memory is bounded by a part or the longest unit.

Defined cases: a null text is empty; a null id is hashed as an empty one; empty texts and texts that hold a marker are plain, whatever the hash says; repeated
rows are answered each and alike; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Code points of a text that are handed to the library at once, unless one unit is longer.
PART = 1 << 15

CUTS = T.StructType([T.StructField(c, T.LongType()) for c in ("n", "first", "second")])


def parts(text: str, most: int = PART) -> Iterator[tuple[int, str]]:
    """(place, part) of a text; a part ends where a blank follows a word, or with the text."""
    lo, n = 0, len(text)
    while n - lo > most:
        hi = lo + most
        while hi < n and (text[hi] not in BLANKS or text[hi - 1] in BLANKS):
            hi += 1
        yield lo, text[lo:hi]
        lo = hi
    if lo < n:
        yield lo, text[lo:]


class Splitter:
    """Ends of a text's units in code points."""

    def __init__(self, most: int = PART):
        from tokenizers import Regex, pre_tokenizers

        self.split, self.most = pre_tokenizers.Split(Regex(UNIT), behavior="isolated"), most

    def ends(self, text: str) -> np.ndarray:
        out = [np.zeros(0, np.int64)]
        for lo, part in parts(text, self.most):
            out.append(np.fromiter((end for _, (_, end) in self.split.pre_tokenize_str(part)), np.int64) + lo)
        return np.concatenate(out)


def _cuts(part_chars: int):
    @F.pandas_udf(CUTS)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        splitter = Splitter(part_chars)
        for texts, one, two in batches:
            rows = []
            for text, a, b in zip(texts, one, two, strict=True):
                ends = splitter.ends(text)
                n = len(ends)
                low, high = sorted((int(a) % (n + 1), int(b) % (n + 1)))
                place = lambda rank: int(ends[rank - 1]) if rank else 0
                rows.append((n, place(low), place(high)))
            yield pd.DataFrame(rows, columns=CUTS.fieldNames())

    return run


def hashes(doc_id: Column, seed: int) -> tuple[Column, ...]:
    """The first four 8-digit groups of the hex sha256 of `seed:id`, as unsigned integers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return tuple(F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4))


def transform(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, fim_percent: int = 50, spm_percent: int = 80, part_chars: int = PART
) -> DataFrame:
    """id_col, n (units), form (plain, psm or spm), prefix, middle, suffix (null if plain), output: a row per document, without a shuffle."""
    h = dict(zip(("h1", "h2", "h3", "h4"), hashes(F.col(id_col), seed), strict=True))
    d = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"), *(c.alias(k) for k, c in h.items()))
    d = d.withColumn("cut", _cuts(part_chars)("t", "h1", "h2"))
    marked = F.contains("t", F.lit(PREFIX)) | F.contains("t", F.lit(SUFFIX)) | F.contains("t", F.lit(MIDDLE))
    plain = (F.col("t") == "") | marked | (F.col("h3") % 100 >= fim_percent)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm")
    a, b = (F.col(f"cut.{c}").cast("int") for c in ("first", "second"))
    piece = lambda start, length: F.when(F.col("form") != "plain", F.substr("t", start + 1, length))
    d = d.select("id", "t", "cut", form.alias("form"))
    d = d.select("id", "t", F.col("cut.n").alias("n"), "form", piece(F.lit(0), a).alias("prefix"), piece(a, b - a).alias("middle"), piece(b, F.length("t") - b).alias("suffix"))
    said = F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle"))
    said = said.when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")).otherwise(F.col("t"))
    return d.select(F.col("id").alias(id_col), "n", "form", "prefix", "middle", "suffix", said.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text that output and form came from. No piece holds a marker and none can arise where pieces meet markers, so the first of each is its own."""
    first, second = F.when(form == "psm", PREFIX).otherwise(SUFFIX), F.when(form == "psm", SUFFIX).otherwise(PREFIX)
    size = len(PREFIX)
    body = F.substr(output, F.lit(size + 1), F.length(output))
    at = F.position(second, body)
    rest = F.substr(body, at + size, F.length(output))
    end = F.position(F.lit(MIDDLE), rest)
    one, two, middle = F.substr(body, F.lit(1), at - 1), F.substr(rest, F.lit(1), end - 1), F.substr(rest, end + size, F.length(output))
    return F.when(form == "psm", F.concat(one, middle, two)).when(form == "spm", F.concat(two, middle, one)).otherwise(output)
