"""Column functions over paths, names and text; built-in expressions but for NFKC, which Spark lacks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T



def normalize_path(path: Column) -> Column:
    """Leading slash, no double slashes, every placeholder as {param}, no trailing slash. Braces may hold slashes, so they go first."""
    p = path
    for opening, closing in ((r"\$?\{", r"\}"), (r"\[", r"\]")):
        p = F.regexp_replace(p, f"{opening}[^{closing}]*{closing}", "\u0001")
    p = F.regexp_replace(p, r":[A-Za-z_]\w*", "\u0001")
    parts = F.filter(F.split(p, "/"), lambda x: x != "")
    return F.replace(F.concat(F.lit("/"), F.array_join(parts, "/")), F.lit("\u0001"), F.lit("{param}"))


def join_path(*parts: Column) -> Column:
    return normalize_path(F.concat_ws("/", *parts))


def simple_name(name: Column) -> Column:
    """What follows the last point."""
    return F.element_at(F.split(name, r"\."), -1)


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.str.normalize("NFKC")


def tokens(text: Column) -> Column:
    """Distinct lower-case tokens of more than one character: whole words (letters and digits of all scripts, with _ . $ -) and their camelCase and
    snake_case parts. Forms are unified by NFKC first."""
    t = nfkc(text)
    split = lambda c, extra: F.split(F.lower(F.regexp_replace(c, rf"[^\p{{L}}\p{{N}}{extra}]+", " ")), " ")
    both = F.concat(split(t, "_.$-"), split(F.regexp_replace(t, r"([\p{Ll}\p{N}])(\p{Lu})", "$1 $2"), ""))
    return F.array_distinct(F.filter(both, lambda x: F.length(x) > 1))


def spans(text: Column, pattern: str, groups: int) -> Column:
    """array<struct<whole, line, last, a, b, ...>>: each match with its first and last line and its groups. Matches are marked, and the marks counted per
    line, so a text is searched twice however many matches it has."""
    breaks = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    marked = F.split(F.regexp_replace(text, pattern, "\u0001$0"), "\n")
    line = F.flatten(F.transform(marked, lambda x, i: F.array_repeat(i + 1, F.length(x) - F.length(F.replace(x, F.lit("\u0001"), F.lit(""))))))
    parts = lambda w: (F.regexp_extract(w, pattern, g + 1).alias("abcdefgh"[g]) for g in range(groups))
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda w, i: F.struct(w.alias("whole"), F.get(line, i).alias("line"), (F.get(line, i) + breaks(w)).alias("last"), *parts(w)))


def slugify(text: Column, fallback: str = "page") -> Column:
    """Letters and digits joined by hyphens, 80 characters at most; the fallback where nothing is left."""
    slug = F.substring(F.trim(F.regexp_replace(F.lower(nfkc(text)), r"[^\p{L}\p{N}]+", "-"), F.lit("-")), 1, 80)
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit(fallback))
