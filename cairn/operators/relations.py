"""Tables, keys and relations with their cardinality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: What SQL is made of: comments, literals, quoted names, words, and single signs.
TOKEN = r"--[^\n]*|(?s:/\*.*?\*/)|'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|\[[^\]\n]*\]|[\w$]+|\S"


def tokens(files: DataFrame) -> DataFrame:
    """repo, file, statement, pos, t, depth, entry, head: the tokens of statements that begin with CREATE, without comments; names lose their quotes, literals keep theirs.

    Statements, brackets and the entries of a table's list are islands of running counts: semicolons and commas count only where no literal and, for commas, no further bracket holds them. depth: brackets that are
    open before the token; entry: null outside of the first list; head: tokens of the statement before that list."""
    every = F.filter(F.regexp_extract_all("content", F.lit(TOKEN), F.lit(0)), lambda t: ~t.startswith("--") & ~t.startswith("/*"))
    t = files.select("repo", F.col("path").alias("file"), F.posexplode(every).alias("pos", "t"))
    name = F.when(F.col("t").rlike('^["`\\[].'), F.substr("t", F.lit(2), F.length("t") - 2)).otherwise(F.col("t"))
    before = W.partitionBy("repo", "file").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    t = t.withColumn("statement", F.coalesce(F.count_if(F.col("t") == ";").over(before), F.lit(0))).filter("t <> ';'").withColumn("t", name)
    one = W.partitionBy("repo", "file", "statement").orderBy("pos")
    so_far = one.rowsBetween(W.unboundedPreceding, -1)
    t = t.withColumn("_first", F.lower(F.first("t").over(one.rowsBetween(W.unboundedPreceding, W.currentRow)))).filter("_first = 'create'")
    turn = F.when(F.col("t") == "(", 1).when(F.col("t") == ")", -1).otherwise(0)
    t = t.withColumn("depth", F.coalesce(F.sum(turn).over(so_far), F.lit(0)))
    opened = F.coalesce(F.count_if((F.col("t") == "(") & (F.col("depth") == 0)).over(so_far), F.lit(0))
    commas = F.coalesce(F.count_if((F.col("t") == ",") & (F.col("depth") == 1)).over(so_far), F.lit(0))
    t = t.withColumns({"_o": opened, "_n": commas})
    ends = (F.col("depth") == 1) & F.col("t").isin(",", ")")
    return t.select("repo", "file", "statement", "pos", "t", "depth", F.when((F.col("_o") == 1) & (F.col("depth") > 0) & ~ends, F.col("_n")).alias("entry"), (F.col("_o") == 0).alias("head"))


def statements(files: DataFrame) -> DataFrame:
    """repo, file, statement, head, entries: CREATE statements; head: the words before the first list; entries: what stands between its commas, in order, each an array of tokens with their depth within the entry."""
    t = tokens(files)
    keys = ["repo", "file", "statement"]
    head = F.transform(F.sort_array(F.collect_list(F.when(F.col("head") & (F.col("t") != "("), F.struct("pos", "t")))), lambda x: x["t"])
    e = t.filter("entry is not null").groupBy(*keys, "entry").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "t", "depth"))), lambda x: F.struct(x["t"].alias("t"), (x["depth"] - 1).alias("d"))).alias("e"))
    e = e.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("entry", "e"))), lambda x: x["e"]).alias("entries"))
    return t.groupBy(*keys).agg(head.alias("head")).join(e, keys)


def _dotted(words: Column) -> Column:
    """How many of the first words are one name: every second is a point."""
    ends = F.array_position(F.transform(words, lambda x, i: (i % 2 == 1) & (x != ".")), F.lit(True)).cast("int") - 1
    return F.when(ends < 0, F.size(words)).otherwise(ends)


def _named(head: Column, after: str) -> Column:
    """The dotted name behind a word of a head (and IF NOT EXISTS); null without the word."""
    at = F.array_position(F.transform(head, F.lower), F.lit(after)).cast("int")
    rest = F.slice(head, at + 1, F.size(head))
    rest = F.when(F.lower(F.get(rest, 0)) == "if", F.slice(rest, F.lit(4), F.size(rest))).otherwise(rest)
    return F.when((at > 0) & (F.size(rest) > 0), F.array_join(F.slice(rest, F.lit(1), _dotted(rest)), ""))


def extract_ddl(files: DataFrame) -> DataFrame:
    """repo, file, table, entries: one row per CREATE TABLE."""
    s = statements(files)
    at = F.array_position(F.transform("head", F.lower), F.lit("table"))
    return s.filter(at.between(2, 4)).select("repo", "file", _named(F.col("head"), "table").alias("table"), "entries").filter("table is not null")


def extract_indexes(files: DataFrame) -> DataFrame:
    """repo, file, index, table, unique, columns: one row per CREATE INDEX."""
    low = F.transform("head", F.lower)
    s = statements(files).filter((F.get(low, 1) == "index") | ((F.get(low, 1) == "unique") & (F.get(low, 2) == "index")))
    return s.select("repo", "file", _named(F.col("head"), "index").alias("index"), _named(F.col("head"), "on").alias("table"), (F.get(low, 1) == "unique").alias("unique"), F.transform("entries", lambda e: e[0]["t"]).alias("columns")).filter("table is not null")


def attach_indexes(tables: DataFrame, indexes: DataFrame) -> DataFrame:
    """Indexes with the table of the same file that they are on, told by its full or its simple name."""
    simple = lambda c: F.lower(F.substring_index(c, ".", -1))
    t = tables.select("repo", "file", F.col("table").alias("_t"), simple(F.col("table")).alias("_s")).distinct()
    j = indexes.withColumn("_s", simple(F.col("table"))).join(t, ["repo", "file", "_s"])
    j = j.filter((F.lower("table") == F.lower("_t")) | ~F.contains("table", F.lit(".")) | ~F.contains("_t", F.lit(".")))
    return j.select("repo", "file", "index", F.col("_t").alias("table"), "unique", "columns")


def _list(e: Column, at: Column) -> Column:
    """Names of the list that opens at a place of an entry: what stands behind its bracket and its commas; empty if none opens there."""
    inner = F.slice(e, at + 2, F.size(e))
    end = F.array_position(F.transform(inner, lambda x: (x["t"] == ")") & (x["d"] == 1)), F.lit(True)).cast("int")
    inner = F.slice(inner, F.lit(1), F.greatest(end - 1, F.lit(0)))
    names = F.transform(F.filter(inner, lambda x, i: (x["d"] == 1) & (x["t"] != ",") & ((i == 0) | (F.get(inner, i - 1)["t"] == ","))), lambda x: x["t"])
    return F.when(F.coalesce(F.get(e, at)["t"] == "(", F.lit(False)), names).otherwise(F.array().cast("array<string>"))


def _place(e: Column, word: str) -> Column:
    """Place of a word outside of brackets, from 0; -1 if it is not there."""
    return F.array_position(F.transform(e, lambda x: F.when(x["d"] == 0, F.lower(x["t"])).otherwise("")), F.lit(word)).cast("int") - 1


def _first_list(e: Column) -> Column:
    return F.array_position(F.transform(e, lambda x: (x["t"] == "(") & (x["d"] == 0)), F.lit(True)).cast("int") - 1


def entries(tables: DataFrame) -> DataFrame:
    """repo, file, table, ord, kind, own, to, theirs, e: the entries of tables. kind: column, or of keys of the table primary, foreign, unique, or other; own: the columns that it is about; to, theirs: what it refers to."""
    d = tables.select("repo", "file", "table", F.posexplode("entries").alias("ord", "e"))
    bare = F.when(F.lower(F.col("e")[0]["t"]) == "constraint", F.slice("e", F.lit(3), F.size("e"))).otherwise(F.col("e"))
    d = d.withColumn("k", bare).filter("size(k) > 0")
    word = F.lower(F.col("k")[0]["t"])
    list_ = _list(F.col("k"), _first_list(F.col("k")))
    is_key = (F.size(list_) > 0) & F.when(word.isin("primary", "foreign"), F.lower(F.get("k", 1)["t"]) == "key").otherwise(word.isin("unique", "key", "index", "fulltext", "spatial"))
    kind = F.when(is_key & word.isin("primary", "foreign", "unique"), word).when(is_key | word.isin("check", "exclude", "like", "period") | (F.size("k") < F.size("e")), "other").otherwise("column")
    refers = _place(F.col("k"), "references")
    rest = F.slice("k", refers + 2, F.size("k"))
    words = F.transform(rest, lambda x: x["t"])
    to = F.when(refers >= 0, F.array_join(F.slice(words, F.lit(1), _dotted(words)), ""))
    theirs = F.when(refers >= 0, _list(rest, _dotted(words)))
    return d.withColumn("kind", kind).select("repo", "file", "table", "ord", "kind", F.when(F.col("kind") == "column", F.array(F.col("k")[0]["t"])).otherwise(list_).alias("own"), to.alias("to"), theirs.alias("theirs"), "e")


def columns(tables: DataFrame) -> DataFrame:
    """repo, table, column, type, nullable, primary_key, unique (alone: its own key, or the only column of one), ref_table, ref_column (of the first key that it is in)."""
    e = entries(tables)
    place = lambda w: _place(F.col("e"), w)
    typed = F.concat(F.col("e")[1]["t"], F.when(F.get("e", 2)["t"] == "(", F.concat(F.lit("("), F.array_join(_list(F.col("e"), F.lit(2)), ","), F.lit(")"))).otherwise(""))
    primary = (place("primary") > 0) & (F.lower(F.get("e", place("primary") + 1)["t"]) == "key")
    c = e.filter("kind = 'column'").select("repo", "file", "table", "ord", F.col("own")[0].alias("column"), typed.alias("type"), (~((place("not") > 0) & (F.lower(F.get("e", place("not") + 1)["t"]) == "null"))).alias("nullable"), primary.alias("_p"), (place("unique") > 0).alias("_u"), F.col("to").alias("_to"), F.get("theirs", 0).alias("_theirs"))
    k = e.filter("kind in ('primary', 'foreign', 'unique')").select("repo", "file", "table", "ord", "kind", F.size("own").alias("n"), "to", "theirs", F.posexplode("own").alias("i", "_c"))
    k = k.withColumn("_c", F.lower("_c")).groupBy("repo", "file", "table", "_c").agg(
        F.bool_or(F.col("kind") == "primary").alias("_kp"), F.bool_or((F.col("kind") != "foreign") & (F.col("n") == 1)).alias("_ku"), F.min(F.when(F.col("kind") == "foreign", F.struct("ord", "to", F.get("theirs", F.col("i")).alias("c")))).alias("_kf")
    )
    j = c.withColumn("_c", F.lower("column")).join(k, ["repo", "file", "table", "_c"], "left")
    return j.select(
        "repo", "table", "column", "type", "nullable", (F.col("_p") | F.coalesce("_kp", F.lit(False))).alias("primary_key"), (F.col("_p") | F.col("_u") | F.coalesce("_ku", F.lit(False))).alias("unique"),
        F.coalesce("_to", "_kf.to").alias("ref_table"), F.coalesce("_theirs", "_kf.c").alias("ref_column"),
    )


def foreign_keys(tables: DataFrame) -> DataFrame:
    """repo, table, ord, from_columns, ref_table, to_columns: each foreign key of a table, of its own or of a column, as it is written; two to the same table are two."""
    return entries(tables).filter("to is not null and kind in ('column', 'foreign')").select("repo", "table", "ord", F.col("own").alias("from_columns"), F.col("to").alias("ref_table"), F.col("theirs").alias("to_columns"))


def relations(cols: DataFrame) -> DataFrame:
    """Foreign keys: 1:1 where the child's column is unique by itself, else N:1."""
    fk = cols.filter("ref_table is not null")
    return fk.select("repo", F.col("table").alias("from_table"), F.col("column").alias("from_column"), F.col("ref_table").alias("to_table"), F.col("ref_column").alias("to_column"), F.when(F.col("unique"), "1:1").otherwise("N:1").alias("cardinality"))


def column_key(columns):
    """Column names as one comparable text: lower case, sorted."""
    return F.array_join(F.array_sort(F.transform(columns, F.lower)), ",")


def uniqueness(keys: DataFrame) -> DataFrame:
    """keys(repo, table, basis, columns), basis one of primary_key, unique_constraint, unique_index, unique_column -> repo, table, colkey, basis: the strongest."""
    rank = F.array_position(F.array(*map(F.lit, ("primary_key", "unique_constraint", "unique_index", "unique_column"))), F.col("basis"))
    return keys.groupBy("repo", F.lower("table").alias("table"), column_key("columns").alias("colkey")).agg(F.min_by("basis", rank).alias("basis"))


def cardinality(rels: DataFrame, tables: DataFrame, unique: DataFrame) -> DataFrame:
    """rels(repo, type, from_table, from_columns, to_table, to_columns) with cardinality. Foreign keys: 1:1 where the child's columns are unique, else
    N:1, unknown without the child's definition. Joins: by both sides, unknown where one is not defined."""
    out = rels
    for side in ("from", "to"):
        t, k = f"{side}_table", f"_{side}_key"
        out = out.withColumn(f"_{t}", F.lower(t)).withColumn(k, column_key(f"{side}_columns"))
        u = unique.select("repo", F.col("table").alias(f"_{t}"), F.col("colkey").alias(k), F.lit(True).alias(f"_{side}_one"))
        known = tables.select("repo", F.lower("table").alias(f"_{t}"), F.lit(True).alias(f"_{side}_known")).distinct()
        out = out.join(u, ["repo", f"_{t}", k], "left").join(known, ["repo", f"_{t}"], "left")
    one, other, fk = F.col("_from_one").isNotNull(), F.col("_to_one").isNotNull(), F.col("type") == "foreign_key"
    unknown = F.col("_from_known").isNull() | (~fk & F.col("_to_known").isNull())
    c = F.when(unknown, "unknown").when(fk, F.when(one, "1:1").otherwise("N:1")).when(one & other, "1:1").when(one, "1:N").when(other, "N:1").otherwise("N:M")
    return out.select(*rels.columns, c.alias("cardinality"))


def many_to_many(foreign_keys: DataFrame, unique: DataFrame) -> DataFrame:
    """foreign_keys(repo, table, ord, columns, ref_table) -> repo, via_table, from_table, to_table: all pairs of keys of a table whose key columns together are unique.
    Keys go by ord, then columns and target. The keys of one table fit in a row; pairs are made within it."""
    g = foreign_keys.groupBy("repo", F.lower("table").alias("table")).agg(F.sort_array(F.collect_list(F.struct("ord", "columns", "ref_table"))).alias("k"))
    g = g.filter(F.size("k") > 1).withColumn("colkey", column_key(F.flatten(F.transform("k", lambda x: x["columns"]))))
    j = g.join(unique.select("repo", "table", "colkey"), ["repo", "table", "colkey"], "left_semi").select("repo", F.col("table").alias("via_table"), "k", F.posexplode("k").alias("_i", "a"))
    rest = F.slice("k", F.col("_i") + 2, F.size("k"))
    return j.select("repo", "via_table", F.col("a.ref_table").alias("from_table"), F.explode(rest).alias("b")).select("repo", "via_table", "from_table", F.col("b.ref_table").alias("to_table"))


#: What tells relations apart.
RELATION = ["repo", "type", "from_table", "from_columns", "to_table", "to_columns", "file", "line"]


def union_relations(*kinds: DataFrame) -> DataFrame:
    """Foreign keys, joins of queries and mappings as one table; rows that agree in all of RELATION whatever their case count once, the first kind's and the
    least first. Each is (repo, type, from_table, from_columns, to_table, to_columns, file, line)."""
    rows = None
    for i, k in enumerate(kinds):
        k = k.select(*RELATION).filter("from_table is not null and to_table is not null").withColumn("_i", F.lit(i))
        rows = k if rows is None else rows.unionByName(k)
    low = lambda c: F.lower(F.array_join(c, ",") if c.endswith("columns") else F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(f"_{c}")
    g = rows.groupBy(*(low(c) for c in RELATION)).agg(F.min(F.struct("_i", *RELATION)).alias("_w"))
    return g.select(*(f"_w.{c}" for c in RELATION))


def resolve_entities(rels: DataFrame, entities: DataFrame) -> DataFrame:
    """rels(repo, from_entity, to_entity, framework, to_is_table) with from_table and to_table: the table of the entity(repo, name, table, framework, ord) of
    that name whatever its case, of the same framework if there is one, else the first; what is no entity, or a table already, stays as it is."""
    same = entities.groupBy("repo", F.lower("name").alias("_k"), "framework").agg(F.min_by("table", "ord").alias("_same"))
    any_ = entities.groupBy("repo", F.lower("name").alias("_k")).agg(F.min_by("table", "ord").alias("_any"))
    out = rels
    for side in ("from", "to"):
        out = out.withColumn("_k", F.lower(f"{side}_entity")).join(same, ["repo", "_k", "framework"], "left").join(any_, ["repo", "_k"], "left")
        found = F.coalesce("_same", "_any", f"{side}_entity")
        if side == "to":
            found = F.when(F.coalesce("to_is_table", F.lit(False)), F.col("to_entity")).otherwise(found)
        out = out.withColumn(f"{side}_table", found).drop("_k", "_same", "_any")
    return out.select(*rels.columns, "from_table", "to_table")
