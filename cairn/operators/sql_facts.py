"""Statements of mapper files and string literals, their uses, the joins written in them, and the tables they mean.

A statement is taken apart within its row by walks over its words; only names are shuffled, never contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import spans
from ..sources.corpus import extension
from .contracts import lines
from .facts import ENDS_LIST, extract_methods, sql_tables, with_next_method

#: Calls whose first argument is a statement's id, and how much of a statement is shown.
CALLS = ("selectOne", "selectList", "insert", "update", "delete", "queryForObject", "queryForList")
PREVIEW = 240
SHORTEST, LONGEST = 8, 1000

ELEMENT = r"(?is)<(select|insert|update|delete)(\s[^>]*)>(.*?)</\1\s*>"
#: A literal of each kind of quote; plain ones end with their line, so that an apostrophe in a remark costs one line at most.
LITERAL = "|".join([r'(?s:"""(.*?)""")', *(rf"{q}([^{q}\\{end}]*+(?:\\.[^{q}\\{end}]*+)*){q}" for q, end in (('"', "\\n"), ("'", "\\n"), ("`", "")))])


def _line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?:\\[nrt]|\s)+", " "))


def _statement(sql: Column) -> tuple[Column, ...]:
    return sql_tables(sql).alias("tables"), F.substring(_line(sql), 1, PREVIEW).alias("text_preview")


def mapper_statements(files: DataFrame) -> DataFrame:
    """repo, file, line, id, type, sql, tables, text_preview, namespace: statement elements of mapper files, named within their namespace."""
    of = lambda text, name: F.regexp_extract(text, rf"(?i)\s{name}\s*=\s*[\"']([^\"']+)", 1)
    xml = files.filter(extension(F.col("path")) == "xml")
    head = F.regexp_extract("content", r"(?i)<mapper(\s[^>]*)>", 1)
    d = xml.select("repo", F.col("path").alias("file"), of(head, "namespace").alias("namespace"), F.explode(spans(F.col("content"), ELEMENT, 3)).alias("_s"))
    name = of(F.col("_s.b"), "id")
    full = F.concat_ws(".", F.nullif("namespace", F.lit("")), name)
    return d.filter(name != "").select("repo", "file", F.col("_s.line").alias("line"), full.alias("id"), F.lower("_s.a").alias("type"), F.col("_s.c").alias("sql"), *_statement(F.col("_s.c")), "namespace")


def statement_type(sql: Column) -> Column:
    """select, insert, update or delete where the text is a whole statement, else null: told by the words at its head."""
    w = F.split(F.lower(_line(sql)), " ")
    at = F.array_position(w, F.lit("from"))
    first, second, third = (F.get(w, F.lit(i)) for i in range(3))
    return (
        F.when((first == "select") & (at > 2) & (F.size(w) > at), "select")
        .when((first == "insert") & (second == "into") & ((F.size(w) > 3) | F.contains(third, F.lit("("))), "insert")
        .when((first == "update") & (third == "set") & (F.size(w) > 3), "update")
        .when((first == "delete") & (second == "from") & (F.size(w) > 2), "delete")
    )


def literal_statements(files: DataFrame) -> DataFrame:
    """repo, file, line, id, type, sql, tables, text_preview: string literals that are whole statements."""
    d = files.select("repo", F.col("path").alias("file"), F.explode(spans(F.col("content"), LITERAL, 4)).alias("_s"))
    d = d.select("repo", "file", F.col("_s.line").alias("line"), F.concat("_s.a", "_s.b", "_s.c", "_s.d").alias("sql")).filter(F.length("sql").between(SHORTEST, LONGEST))
    d = d.withColumn("type", statement_type(F.col("sql"))).filter("type is not null")
    return d.select("repo", "file", "line", F.concat_ws(":", "file", "line", F.lit("raw")).alias("id"), "type", "sql", *_statement(F.col("sql")))


def statement_uses(files: DataFrame, mapped: DataFrame) -> DataFrame:
    """repo, file, line, sql_id, method: calls that name a statement, with the next method of their file (`unknown` without one); statements of a
    namespace are used by the method of their own name."""
    said = rf"\b(?:{'|'.join(CALLS)})\s*\(\s*[\"']([^\"']+)[\"']"
    marked = lines(files).select("repo", "path", "line", F.explode(F.regexp_extract_all("text", F.lit(said), F.lit(1))).alias("sql_id"))
    called = with_next_method(marked, extract_methods(files)).select("repo", F.col("path").alias("file"), "line", "sql_id", F.coalesce("method", F.lit("unknown")).alias("method"))
    return called.unionByName(mapped.filter("namespace <> ''").select("repo", "file", "line", F.col("id").alias("sql_id"), F.col("id").alias("method")))


def _aliases(words: Column) -> Column:
    """array<struct<name, table>>: what each table of FROM and JOIN is called, by its alias, its simple and its full name."""
    pair = lambda name, table: F.struct(F.lower(name).alias("name"), table.alias("table"))
    none = F.lit(None).cast("string")
    state = F.struct(F.lit(False).alias("due"), F.lit(False).alias("list"), none.alias("last"), F.array().cast("array<struct<name:string,table:string>>").alias("names"))

    def step(s: Column, w: Column) -> Column:
        low = F.lower(w)
        keyword = low.isin("from", "join")
        word = ~low.isin(",", "(", ")", "=") & ~keyword & ~low.isin(*ENDS_LIST)
        table, alias = s["due"] & word, s["last"].isNotNull() & word & (low != "as")
        names = F.when(table, F.concat(s["names"], F.array(pair(F.substring_index(w, ".", -1), w), pair(w, w)))).when(alias, F.concat(s["names"], F.array(pair(w, s["last"])))).otherwise(s["names"])
        listed = F.when(low == "from", True).when((low == "join") | low.isin(*ENDS_LIST, "(", ")"), False).otherwise(s["list"])
        last = F.when(table, w).when(low == "as", s["last"]).otherwise(none)
        return F.struct((keyword | ((low == ",") & s["list"])).alias("due"), listed.alias("list"), last.alias("last"), names.alias("names"))

    return F.aggregate(words, state, step, lambda s: s["names"])


def statement_joins(statements: DataFrame) -> DataFrame:
    """repo, file, line, sql_id, from_table, from_column, to_table, to_column of statements(repo, file, line, id, sql): equalities between columns of two
    names that the statement gives to tables."""
    words = F.regexp_extract_all(F.regexp_replace("sql", "[\"`\\[\\]]", ""), F.lit(r"[\p{L}\p{N}_.$]+|[,()=]"), F.lit(0))
    d = statements.select("repo", "file", "line", F.col("id").alias("sql_id"), words.alias("_w")).filter(F.array_contains("_w", "=")).withColumn("_a", _aliases(F.col("_w")))
    three = F.transform("_w", lambda w, i: F.struct(w.alias("op"), F.split(F.get("_w", i - 1), r"\.").alias("l"), F.split(F.get("_w", i + 1), r"\.").alias("r")))
    d = d.select("*", F.explode(F.filter(three, lambda t: (t["op"] == "=") & (F.size(t["l"]) == 2) & (F.size(t["r"]) == 2))).alias("_e"))
    # the last meaning of a name counts
    table = lambda side: F.try_element_at(F.filter("_a", lambda a: a["name"] == F.lower(F.col(f"_e.{side}")[0])), F.lit(-1))["table"]
    out = d.select("repo", "file", "line", "sql_id", table("l").alias("from_table"), F.col("_e.l")[1].alias("from_column"), table("r").alias("to_table"), F.col("_e.r")[1].alias("to_column"))
    return out.filter("from_table is not null and to_table is not null")


def canonical_tables(named: DataFrame, tables: DataFrame, column: str = "table") -> DataFrame:
    """named with `column` as the schema spells it: the table of the same name whatever its case, else the first of tables(repo, name, ord) with the same
    simple name, else as it is. The schema is reduced to one row a name before it is joined."""
    simple = lambda c: F.lower(F.substring_index(c, ".", -1))
    one = lambda key, out: tables.groupBy("repo", key.alias("_k")).agg(F.min_by("name", F.struct("ord", "name")).alias(out))
    d = named.withColumn("_k", F.lower(column)).join(one(F.lower("name"), "_exact"), ["repo", "_k"], "left").drop("_k")
    d = d.withColumn("_k", simple(F.col(column))).join(one(simple(F.col("name")), "_near"), ["repo", "_k"], "left").drop("_k")
    return d.withColumn(column, F.coalesce("_exact", "_near", column)).select(*named.columns)


def table_edges(uses: DataFrame, statements: DataFrame, tables: DataFrame) -> DataFrame:
    """repo, method, table: methods with the tables of the statements they use, each once."""
    j = uses.select("repo", "sql_id", "method").join(statements.select("repo", F.col("id").alias("sql_id"), F.explode("tables").alias("table")), ["repo", "sql_id"])
    return canonical_tables(j.select("repo", "method", "table").distinct(), tables).distinct()


def unused_statements(statements: DataFrame, uses: DataFrame) -> DataFrame:
    return statements.join(uses.select("repo", F.col("sql_id").alias("id")), ["repo", "id"], "left_anti")
