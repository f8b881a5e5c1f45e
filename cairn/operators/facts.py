"""Statements, transactions, external calls and environment reads of source files.

Each extractor explodes files into lines, keeps the lines that match before anything is shuffled, and works on those only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.corpus import extension
from . import symbols
from .contracts import lines

METHOD = r"^\s*(?!return\b|new\b|else\b|throw\b)(?:(?:public|protected|private|static|final)\s+)*[A-Za-z][A-Za-z0-9_<>\[\], ]*\s+([A-Za-z_][A-Za-z0-9_]*)\s*\([^)]*\)\s*[{;]"
#: Annotations that hold a statement.
STATEMENTS = ("Query", "Select", "Insert", "Update", "Delete")
#: A literal: a block of text, or between quotes.
PIECE = r'(?s)""".*?"""|"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])*\''
ENVIRONMENT = r"(?:System\.getenv\(\s*[\"']|process\.env\.|os\.environ\[\s*[\"'])([A-Za-z_][A-Za-z0-9_]*)"
#: Kinds of external calls with the words that tell them, in any case; annotations that do, with their kind; and calls that do.
EXTERNAL = {
    "http": "resttemplate webclient httpclient restsharp axios fetch httpx requests".split(), "kafka_producer": "kafkatemplate kafkaproducer".split(), "redis": "redistemplate stringredistemplate ioredis createclient".split(),
    "mail": "javamailsender mailsender smtplib nodemailer".split(), "rabbit": "rabbittemplate".split(),
}
LISTENERS = {"KafkaListener": "kafka_consumer", "RabbitListener": "rabbit"}
FILE_CALLS = "FileInputStream FileOutputStream readFile writeFile open".split()


#: Words after which a table is named, and words that end a list of tables.
NAMES_TABLE = ("from", "join", "update", "into", "table")
ENDS_LIST = ("where", "group", "order", "having", "on", "set", "select", "values", "limit", "union", "left", "right", "inner", "outer", "full", "cross", "natural", "using")


def sql_tables(sql: Column) -> Column:
    """Distinct table names in order of first mention: a walk over words, commas and brackets, quotes left out. A table is the word after FROM, JOIN, UPDATE,
    INTO or TABLE, and after each comma of a list that FROM began."""
    words = F.regexp_extract_all(F.regexp_replace(sql, "[\"`\\[\\]]", ""), F.lit(r"[\p{L}\p{N}_.$]+|[,()]"), F.lit(0))
    state = F.struct(F.lit(False).alias("due"), F.lit(False).alias("list"), F.array().cast("array<string>").alias("names"))

    def step(s: Column, w: Column) -> Column:
        low = F.lower(w)
        names = low.isin(*NAMES_TABLE)
        word = ~low.isin(",", "(", ")")
        # of IF NOT EXISTS behind TABLE nothing is a name
        skip = low.isin("if", "not", "exists", "only")
        due = F.when(names, True).when(s["due"] & skip, True).when(low == ",", s["list"]).otherwise(False)
        listed = F.when(low == "from", True).when(names | low.isin(*ENDS_LIST, "(", ")"), False).otherwise(s["list"])
        found = F.when(s["due"] & word & ~skip & ~names & ~low.isin(*ENDS_LIST), F.concat(s["names"], F.array(w))).otherwise(s["names"])
        return F.struct(due.alias("due"), listed.alias("list"), found.alias("names"))

    return F.array_distinct(F.aggregate(words, state, step, lambda s: s["names"]))


def extract_statements(files: DataFrame) -> DataFrame:
    """repo, file, line, type, sql, tables: statements in annotations, which may run over lines, be put together from several literals, or stand in a block of text; type is the first keyword."""
    u = symbols.parse(files.filter(extension(F.col("path")).isin("java", "kt")), STATEMENTS).select("repo", "file", F.inline(F.filter("uses", lambda u: (u["mark"] == "@") & u["name"].isin(*STATEMENTS) & u["args"].isNotNull())))
    # the value itself, named or first, up to what is set by another name
    value = F.when(F.col("args").rlike("^\\s*[\"']"), F.col("args")).otherwise(F.regexp_extract("args", r"(?s)\bvalue\s*=\s*(.*)", 1))
    value = F.split(value, r",\s*\w+\s*=")[0]
    pieces = F.transform(F.regexp_extract_all(value, F.lit(PIECE), F.lit(0)), lambda x: F.trim(x, F.lit("\"'")))
    sql = F.replace(F.array_join(pieces, ""), F.lit("\\\""), F.lit("\""))
    d = u.withColumn("sql", sql).filter(F.trim("sql", F.lit(" \n\t\r")) != "")
    return d.select("repo", "file", "line", F.upper(F.regexp_extract("sql", r"^\s*([A-Za-z]+)", 1)).alias("type"), "sql", sql_tables(F.col("sql")).alias("tables"))


def with_next_method(marked: DataFrame, methods: DataFrame) -> DataFrame:
    """As-of join: each marked (repo, path, line) with the first method of its file at or after it. A window per file over marked and method lines."""
    both = marked.withColumn("_m", F.lit(None).cast("string")).unionByName(methods.withColumnRenamed("name", "_m"), allowMissingColumns=True)
    w = W.partitionBy("repo", "path").orderBy("line", F.col("_m").isNull().desc()).rowsBetween(W.currentRow, W.unboundedFollowing)
    return both.withColumn("method", F.first("_m", ignorenulls=True).over(w)).filter("_m is null").drop("_m")


def extract_methods(files: DataFrame) -> DataFrame:
    """repo, path, line, name."""
    return lines(files.filter(extension(F.col("path")).isin("java", "kt"))).filter(F.col("text").rlike(METHOD)).select("repo", "path", "line", F.regexp_extract("text", METHOD, 1).alias("name"))


def _set_to(args: Column, name: str) -> Column:
    """The last part of what an option is set to; null if it is not."""
    said = F.regexp_extract(args, rf"\b{name}\s*=\s*([\w.]+)", 1)
    return F.nullif(F.element_at(F.split(said, r"\."), -1), F.lit(""))


def extract_transactions(files: DataFrame) -> DataFrame:
    """repo, file, line, marker, entry_method, propagation (REQUIRED if unsaid), isolation: annotations, and calls that begin a transaction, with the next method of their file; a mark without a method behind it is dropped."""
    begins = lambda u: ((u["mark"] == "@") & (u["name"] == "Transactional")) | ((u["mark"] == "") & ((u["name"] == "$transaction") | ((u["name"] == "begin") & (F.element_at(F.split(u["owner"], r"\."), -1) == "session"))))
    u = symbols.parse(files, ("Transactional",)).select("repo", "file", F.inline(F.filter("uses", lambda u: begins(u) & u["next_method"].isNotNull())))
    marker = F.concat(F.col("mark"), F.concat_ws(".", F.nullif("owner", F.lit("")), "name"))
    return u.select("repo", "file", "line", marker.alias("marker"), F.col("next_method").alias("entry_method"), F.coalesce(_set_to(F.col("args"), "propagation"), F.lit("REQUIRED")).alias("propagation"), _set_to(F.col("args"), "isolation").alias("isolation"))


def extract_external(files: DataFrame) -> DataFrame:
    """repo, file, line, type, method, target: external calls with the first method at or after them, null where there is none. Clients are told by their words wherever they stand outside of comments, each kind once a line;
    listeners and file calls by what is used, and a listener's target is the text that it is given."""
    p = symbols.parse(files, tuple(LISTENERS))
    kinds = F.create_map(*(F.lit(x) for pair in LISTENERS.items() for x in pair))
    last = lambda u: F.element_at(F.split(u["owner"], r"\."), -1)
    is_file = lambda u: (u["mark"] == "") & ~u["declares"] & (u["name"].isin(*FILE_CALLS) | ((last(u) == "Files") & u["name"].rlike("^(read|write)")))
    row = lambda u, kind, target: F.struct(u["line"].alias("line"), kind.alias("type"), u["next_method"].alias("method"), target.alias("target"))
    none = F.lit(None).cast("string")
    listens = F.transform(F.filter("uses", lambda u: (u["mark"] == "@") & u["name"].isin(*LISTENERS)), lambda u: row(u, kinds[u["name"]], F.nullif(F.regexp_extract(u["args"], "[\"']([^\"']*)[\"']", 1), F.lit(""))))
    reads = F.transform(F.filter("uses", is_file), lambda u: row(u, F.lit("file_io"), none))
    used = p.select("repo", "file", F.inline(F.concat(listens, reads)))
    plain = files.withColumn("content", symbols.without_comments(F.coalesce("content", F.lit("")), extension(F.col("path"))))
    words = F.split(F.lower("text"), r"[^\w$]+")
    told = F.array_compact(F.array(*(F.when(F.arrays_overlap(words, F.array(*map(F.lit, w))), F.lit(k)) for k, w in EXTERNAL.items())))
    marked = lines(plain).select("repo", "path", "line", F.explode(told).alias("type"))
    methods = p.select("repo", F.col("file").alias("path"), F.inline(F.transform("methods", lambda m: F.struct(m["line"].alias("line"), m["name"].alias("name")))))
    clients = with_next_method(marked, methods).select("repo", F.col("path").alias("file"), "line", "type", "method", none.alias("target"))
    return clients.unionByName(used).distinct()


def environment_branches(files: DataFrame) -> DataFrame:
    """repo, file, line, type, marker, profile: configuration files of a profile, annotations that ask for one or for a property, and lines that read the environment."""
    name = F.element_at(F.split("path", "/"), -1)
    of_name = F.regexp_extract(name, r"^application-(.+)\.(?:yml|yaml|properties)$", 1)
    config = files.filter(of_name != "").select("repo", F.col("path").alias("file"), F.lit(1).alias("line"), F.lit("config_file").alias("type"), of_name.alias("marker"), of_name.alias("profile"))
    u = symbols.parse(files, ("Profile", "ConditionalOnProperty")).select("repo", "file", F.inline(F.filter("uses", lambda u: (u["mark"] == "@") & u["name"].isin("Profile", "ConditionalOnProperty"))))
    said = F.concat(F.lit("@"), "name", F.lit("("), F.coalesce("args", F.lit("")), F.lit(")"))
    none = F.lit(None).cast("string")
    marks = u.select("repo", "file", "line", F.lit("annotation").alias("type"), F.substring(said, 1, 240).alias("marker"), F.when(F.col("name") == "Profile", F.nullif(F.regexp_extract("args", "[\"']([^\"']*)[\"']", 1), F.lit(""))).alias("profile"))
    reads = extract_environment(files).select("repo", "file", "line", F.lit("code_if").alias("type"), "marker", none.alias("profile"))
    return config.unionByName(marks).unionByName(reads)


def extract_environment(files: DataFrame) -> DataFrame:
    """repo, file, line, marker: reads of environment variables."""
    return lines(files).select("repo", F.col("path").alias("file"), "line", F.explode(F.regexp_extract_all("text", F.lit(ENVIRONMENT), F.lit(1))).alias("marker"))


def table_usage(statements: DataFrame) -> DataFrame:
    """repo, table, statements, files: exact counts per table."""
    t = statements.select("repo", "file", "line", F.explode("tables").alias("table"))
    return t.groupBy("repo", "table").agg(F.count("*").alias("statements"), F.countDistinct("file").alias("files"))
