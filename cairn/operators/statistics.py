"""Counts of an index per repository. Fact tables meet as (repo, kind) rows, so that one shuffle of partial counts serves all of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: How many files are listed as evidence.
EVIDENCE, PATTERN_EVIDENCE, LISTED = 50, 20, 5
#: Kinds of code with words that tell them, anywhere in an id or a path.
PATTERNS = {
    "controller": ("controller", "action", "router", "handler", "endpoint"),
    "service": ("service", "usecase", "use_case", "interactor", "facade", "application"),
    "data_access": ("dao", "repository", "mapper", "store", "gateway"),
    "data_model": ("dto", "entity", "model", "request", "response", "command"),
}
#: Kinds of code told by a format, and by the facts found in a file.
FORMATS = {"frontend_component": ("vue", "jsx", "tsx"), "client": ("jsp", "jspx", "asp", "aspx", "htm", "html", "cshtml")}
FACTS = {
    "endpoints": "controller", "transactions": "service", "sqls": "data_access", "usages": "data_access", "consumers": "frontend_api_client", "communications": "integration_client", "branches": "configuration",
}
TESTS = ("test", "tests", "spec", "specs")


def _kinds(tables: dict[str, DataFrame], *columns: str) -> DataFrame:
    return reduce(DataFrame.unionByName, (t.select("repo", *columns, F.lit(k).alias("_kind")) for k, t in tables.items()))


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """repo and one count per fact table; a repo that no table knows has no row."""
    return _kinds(tables).groupBy("repo").agg(*(F.count_if(F.col("_kind") == k).alias(k) for k in tables))


def index_summary(tables: dict[tuple[str, str], DataFrame]) -> DataFrame:
    """repo, index, collection, records: counts of each collection of each index, with a row of collection null for an index and of both null for the repo."""
    rows = reduce(DataFrame.unionByName, (t.select("repo", F.lit(i).alias("index"), F.lit(c).alias("collection")) for (i, c), t in tables.items()))
    flat = rows.groupBy("repo", "index", "collection").agg(F.count("*").alias("_n"))
    return flat.rollup("repo", "index", "collection").agg(F.sum("_n").alias("records"), F.grouping("repo").alias("_all")).filter("_all = 0").drop("_all")


def index_status(present: DataFrame, declared: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """repo, index, status of all given indexes of repos that either table(repo, index) knows: LOADED, MISSING (declared only) or NO SIGNAL."""
    have, said = present.select("repo", "index", F.lit(1).alias("_h"), F.lit(0).alias("_d")), declared.select("repo", "index", F.lit(0).alias("_h"), F.lit(1).alias("_d"))
    both = have.unionByName(said)
    every = both.select("repo", F.explode(F.array(*map(F.lit, names))).alias("index"), F.lit(0).alias("_h"), F.lit(0).alias("_d"))
    g = both.unionByName(every).groupBy("repo", "index").agg(F.max("_h").alias("_h"), F.max("_d").alias("_d"))
    return g.select("repo", "index", F.when(F.col("_h") == 1, "LOADED").when(F.col("_d") == 1, "MISSING").otherwise("NO SIGNAL").alias("status"))


def first_few(rows: DataFrame, keys: list[str], value: str, n: int) -> DataFrame:
    """keys, n_all, first: how many distinct values a key has, and its n least in order. Ranks above n go before the shuffle."""
    d = rows.select(*keys, value).distinct()
    w = W.partitionBy(*keys).orderBy(value)
    low = d.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("first"))
    return d.groupBy(*keys).agg(F.count("*").alias("n_all")).join(low, keys)


def evidence(tables: dict[str, DataFrame]) -> DataFrame:
    """repo, evidence_files, representative, truncated: distinct files that facts name, the first of them, and how many are left out."""
    f = first_few(_kinds(tables, "file").filter("file is not null"), ["repo"], "file", EVIDENCE)
    return f.select("repo", F.col("n_all").alias("evidence_files"), F.col("first").alias("representative"), F.greatest(F.lit(0), F.col("n_all") - EVIDENCE).alias("truncated"))


def is_test(file: Column) -> Column:
    """A part of the path is a word for tests, or the file's name ends in one."""
    parts = F.split(F.lower(file), r"[\\/_.-]+")
    name = F.regexp_extract(file, r"([A-Za-z0-9]+)\.[A-Za-z0-9]+$", 1)
    words = F.array(*map(F.lit, TESTS))
    return F.arrays_overlap(parts, words) | F.exists(words, lambda t: F.endswith(name, F.initcap(t)))


def pattern_candidates(symbols: DataFrame, facts: dict[str, DataFrame]) -> DataFrame:
    """repo, slug, signal_count, evidence_files (20 at most): kinds of code that symbols(repo, id, file) and fact tables(repo, file) show; `common` for repos
    that show none but have symbols outside tests."""
    told = F.lower(F.concat_ws(" ", "id", "file"))
    words = F.split(told, "[^a-z0-9]+")
    ext = F.regexp_extract(F.lower("file"), r"\.([a-z0-9]+)$", 1)
    has = {s: F.exists(F.array(*map(F.lit, ws)), lambda w: F.contains(told, w)) for s, ws in PATTERNS.items()}
    has["data_access"] |= F.array_contains(words, "repo")
    has["data_model"] |= F.array_contains(words, "vo")
    has |= {"frontend_component": ext.isin(*FORMATS["frontend_component"]) & ~is_test(F.col("file")), "client": ext.isin(*FORMATS["client"]), "test": is_test(F.col("file"))}
    s = symbols.filter("file is not null")
    shown = s.select("repo", "file", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in has.items())))).alias("slug"))
    for name, table in facts.items():
        shown = shown.unionByName(table.filter("file is not null").select("repo", "file", F.lit(FACTS[name]).alias("slug")))
    other = s.filter(~is_test(F.col("file"))).join(shown.select("repo").distinct(), "repo", "left_anti").select("repo", "file", F.lit("common").alias("slug"))
    f = first_few(shown.unionByName(other), ["repo", "slug"], "file", PATTERN_EVIDENCE)
    return f.select("repo", "slug", F.least("n_all", F.lit(PATTERN_EVIDENCE)).alias("signal_count"), F.col("first").alias("evidence_files"))


def relation_stats(tables: DataFrame, relations: DataFrame, many: DataFrame) -> DataFrame:
    """repo, tables, foreign_keys, orm_mappings, inferred_joins, many_to_many, resolved, relations, isolated of tables(repo, name), relations(repo, type,
    from_table, to_table, cardinality) and derived many(repo, from_table, to_table). Tables are told apart whatever their case."""
    ends = lambda d: d.select("repo", F.explode(F.array("from_table", "to_table")).alias("_n"))
    linked = ends(relations).union(ends(many)).select("repo", F.lower("_n").alias("_n"), F.lit(1).alias("_l"))
    t = tables.select("repo", F.lower("name").alias("_n"), F.lit(0).alias("_l")).union(linked).groupBy("repo", "_n").agg(F.max("_l").alias("_l"))
    per = t.groupBy("repo").agg(F.count("*").alias("tables"), F.count_if(F.col("_l") == 0).alias("isolated"))
    of = lambda k: F.count_if(F.col("type") == k)
    r = relations.groupBy("repo").agg(
        of("foreign_key").alias("foreign_keys"), of("orm_relation").alias("orm_mappings"), of("query_join").alias("inferred_joins"), F.count_if(F.col("cardinality") != "unknown").alias("resolved"), F.count("*").alias("relations")
    )
    m = many.groupBy("repo").agg(F.count("*").alias("many_to_many"))
    return per.join(r, "repo", "left").join(m, "repo", "left").na.fill(0)


def contract_status(projects: DataFrame, api: DataFrame) -> DataFrame:
    """system, contract_status, coverage_status, overall_status of projects(system, repo, coverage) and api(system, endpoints, consumers, unmatched_consumers,
    edges); systems without an api row have no contracts to hold."""
    any_of = lambda s: F.bool_or(F.coalesce(F.col("coverage"), F.lit("UNKNOWN")) == s)
    full = F.bool_and(F.coalesce(F.col("coverage"), F.lit("UNKNOWN")) == "FULL")
    p = projects.groupBy("system").agg(F.when(any_of("WARN"), "WARN").when(any_of("PARTIAL"), "PARTIAL").when(full, "FULL").otherwise("UNKNOWN").alias("coverage_status"))
    holds = (F.col("endpoints") > 0) & (F.col("consumers") > 0) & (F.col("unmatched_consumers") == 0) & (F.col("edges") > 0)
    d = p.join(api.select("system", F.when(holds, "PASS").otherwise("WARN").alias("contract_status")), "system", "left").na.fill("NOT_APPLICABLE", ["contract_status"])
    return d.withColumn("overall_status", F.when((F.col("contract_status") == "WARN") | F.col("coverage_status").isin("PARTIAL", "WARN"), "WARN").otherwise("PASS"))


def document_inventory(docs: DataFrame) -> DataFrame:
    """repo, category, documents, paths (the first five)."""
    return first_few(docs, ["repo", "category"], "path", LISTED).select("repo", "category", F.col("n_all").alias("documents"), F.col("first").alias("paths"))


def profiles(branches: DataFrame) -> DataFrame:
    return branches.filter("profile is not null").select("repo", "profile").distinct()
