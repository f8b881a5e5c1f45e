"""HTTP endpoints and consumers: matching, drift, partners. `web` finds them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def lines(files: DataFrame) -> DataFrame:
    """repo, path, line, text: one row per line; contents go no further."""
    return files.select("repo", "path", F.posexplode(F.split("content", "\n")).alias("_n", "text")).select("repo", "path", (F.col("_n") + 1).alias("line"), "text")


def match_api(endpoints: DataFrame, consumers: DataFrame) -> DataFrame:
    """Pairs with the same pattern, the method equal or the endpoint's ANY: an equi-join on the pattern."""
    e = endpoints.select(*(F.col(c).alias(f"endpoint_{c}") for c in ("repo", "file", "method")), "path_pattern")
    c = consumers.select(*(F.col(c).alias(f"consumer_{c}") for c in ("repo", "file", "method")), "path_pattern")
    return e.join(c, "path_pattern").filter((F.col("endpoint_method") == F.col("consumer_method")) | (F.col("endpoint_method") == "ANY"))


def unmatched_consumers(consumers: DataFrame, matches: DataFrame) -> DataFrame:
    hit = matches.select(F.col("consumer_repo").alias("repo"), F.col("consumer_file").alias("file"), "path_pattern").distinct()
    return consumers.join(hit, ["repo", "file", "path_pattern"], "left_anti")


def unmatched_endpoints(endpoints: DataFrame, matches: DataFrame) -> DataFrame:
    hit = matches.select(F.col("endpoint_repo").alias("repo"), F.col("endpoint_file").alias("file"), "path_pattern").distinct()
    return endpoints.join(hit, ["repo", "file", "path_pattern"], "left_anti")


def api_drift(consumers: DataFrame, matches: DataFrame) -> DataFrame:
    """Per client repo: consumers, unmatched, status."""
    lost = unmatched_consumers(consumers, matches).withColumn("lost", F.lit(1))
    all_ = consumers.join(lost.select("repo", "file", "path_pattern", "lost").distinct(), ["repo", "file", "path_pattern"], "left")
    return all_.groupBy("repo").agg(F.count("*").alias("consumers"), F.count("lost").alias("unmatched"), F.when(F.count("lost") > 0, "WARN").otherwise("PASS").alias("status"))


def merge_partners(local: DataFrame, partners: DataFrame) -> DataFrame:
    """Contracts of a repo with those of its partners: local(repo, id, ...) and partners(repo, partner, id, ...), which are marked external; the local one of
    an id wins, then the first partner's. A grouped minimum."""
    rest = [c for c in local.columns if c not in ("repo", "id")]
    own = local.select("repo", "id", F.lit(None).cast("string").alias("partner"), F.lit("local").alias("source"), *rest)
    theirs = partners.select("repo", "id", "partner", F.lit("external").alias("source"), *rest)
    w = F.min(F.struct(F.col("source") != "local", "partner", "source", *rest)).alias("_w")
    return own.unionByName(theirs).groupBy("repo", "id").agg(w).select("repo", "id", "_w.source", "_w.partner", *(f"_w.{c}" for c in rest))


def match_across(endpoints: DataFrame, consumers: DataFrame) -> DataFrame:
    """Pairs within a system: endpoints(system, repo, id, method, path_pattern, prefix_resolved) and consumers(system, repo, id, method, path_pattern) with the
    same pattern; ANY on either side meets every method. Endpoints whose prefix is not resolved are left out."""
    e = endpoints.filter(F.coalesce("prefix_resolved", F.lit(True))).select("system", "path_pattern", F.col("repo").alias("endpoint_repo"), F.col("id").alias("endpoint_id"), F.col("method").alias("_e"))
    c = consumers.select("system", "path_pattern", F.col("repo").alias("consumer_repo"), F.col("id").alias("consumer_id"), F.col("method").alias("_c"))
    hit = (F.col("_e") == F.col("_c")) | (F.col("_e") == "ANY") | (F.col("_c") == "ANY")
    return e.join(c, ["system", "path_pattern"]).filter(hit).drop("_e", "_c")


def owners(items: DataFrame, clients: DataFrame) -> DataFrame:
    """items(system, repo, id, source, external_path, external_id) with the repo they belong to: their own, or for external ones the client(system, id, root,
    ord) of that root, else of that id, else the system's first, else their own."""
    c = clients.groupBy("system", F.lower("root").alias("_root")).agg(F.min_by("id", "ord").alias("_by_root"))
    d = items.withColumn("_root", F.lower("external_path")).join(c, ["system", "_root"], "left")
    d = d.join(clients.select("system", F.col("id").alias("external_id"), F.col("id").alias("_by_id")).distinct(), ["system", "external_id"], "left")
    d = d.join(clients.groupBy("system").agg(F.min_by("id", "ord").alias("_first")), "system", "left")
    owner = F.when(F.col("source") == "external", F.coalesce("_by_root", "_by_id", "_first", "repo")).otherwise(F.col("repo"))
    return d.select(*items.columns, owner.alias("owner"))


def drift_summary(drift: DataFrame, declared: DataFrame) -> DataFrame:
    """Per backend of drift(backend, client, consumers, unmatched): clients, topology, totals, clients that it does not declare (where it declares any), and WARN
    if a call is unmatched or a client undeclared."""
    said = declared.select("backend", "client", F.lit(1).alias("_said")).distinct()
    some = said.select("backend", F.lit(1).alias("_some")).distinct()
    d = drift.join(said, ["backend", "client"], "left").join(some, "backend", "left")
    lost = F.count_if(F.col("_some").isNotNull() & F.col("_said").isNull())
    g = d.groupBy("backend").agg(F.count("*").alias("clients"), F.sum("consumers").alias("consumers"), F.sum(F.col("consumers") - F.col("unmatched")).alias("matched"), F.sum("unmatched").alias("unmatched"), lost.alias("undeclared"))
    return g.withColumn("topology", F.when(F.col("clients") > 1, "one-to-many").otherwise("one-to-one")).withColumn("status", F.when((F.col("unmatched") > 0) | (F.col("undeclared") > 0), "WARN").otherwise("PASS"))
