"""Column functions over the lines of Markdown texts: front matter, inline marks, and what a line begins with."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Links, tags and what lies between them.
INLINE = r"!?\[[^\[\]]*\]\([^()\s]*\)|<[^<>]*>|[^\[<!]+|."
#: Signs that a line of a list, quote or heading begins with.
LEADS = "#>*+- \t"


def body_lines(text: Column) -> Column:
    """The lines of a text without its front matter: what stands between a first line of three hyphens and the next such line."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.rtrim(x, F.lit("\r")))
    rest = F.slice(lines, F.lit(2), F.size(lines))
    end = F.array_position(F.transform(rest, lambda x: F.rtrim(x)), F.lit("---")).cast("int")
    return F.when((F.rtrim(lines[0]) == "---") & (end > 0), F.slice(rest, end + 1, F.size(rest))).otherwise(lines)


def spoken(line: Column, targets: bool) -> Column:
    """A line as it is read: links by their text (and target, if asked for), tags as blanks, marks of emphasis and code left out."""
    pieces = F.regexp_extract_all(line, F.lit(INLINE), F.lit(0))
    link = lambda x: F.translate(F.ltrim(x, F.lit("!")), "[]()", "  ") if targets else F.translate(F.substring_index(F.ltrim(x, F.lit("!")), "](", 1), "[]", "")
    said = F.transform(pieces, lambda x: F.when(x.endswith(")") & F.contains(x, F.lit("](")), F.replace(link(F.replace(x, F.lit("]("), F.lit(" ]("))), F.lit("  "), F.lit(" "))).when(x.startswith("<") & x.endswith(">"), " ").otherwise(x))
    return F.translate(F.array_join(said, ""), "`*~", "")


def one_line(text: Column) -> Column:
    """Words joined by single blanks."""
    return F.array_join(F.filter(F.split(text, r"\s+"), lambda w: w != ""), " ")


def is_item(line: Column) -> Column:
    """Whether a line begins a bullet or a numbered point."""
    t = F.ltrim(line)
    first = F.substring_index(t, " ", 1)
    return (t != first) & (first.isin("-", "*", "+") | (F.rtrim(first, F.lit(".)")) != first) & F.translate(F.rtrim(first, F.lit(".)")), "0123456789", "").eqNullSafe("") & (F.rtrim(first, F.lit(".)")) != ""))


def is_row(line: Column) -> Column:
    t = F.trim(line)
    return (F.length(t) > 1) & t.startswith("|") & t.endswith("|")


def is_rule(line: Column) -> Column:
    """A line of a table that only parts its head from its rows."""
    t = F.trim(line)
    return F.contains(t, F.lit("---")) & (F.translate(t, "|:- ", "") == "")


def cells(line: Column) -> Column:
    return F.transform(F.split(F.trim(F.trim(line), F.lit("|")), r"\|"), lambda x: F.trim(x))
