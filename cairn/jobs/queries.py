"""The registered queries of the library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import contracts, dedupe, facts, graph, relations, search, web
from ..sources.corpus import dao_corpus, in_scope, star_corpus
from . import catalog_queries as catalog
from . import fact_queries as parsed
from . import framework_queries as frameworks
from . import project_queries as project
from . import router_queries as routing
from . import source_queries as stored


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api_drift(spark, sf_dir)


def _api(spark, sf_dir):
    files = in_scope(star_corpus(spark, sf_dir))
    e, c = web.endpoints(files), web.consumers(files)
    return e, c, contracts.match_api(e, c)


def api_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _api(spark, sf_dir)[2].select("endpoint_file", "consumer_file", "path_pattern")


def api_unmatched_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, _, m = _api(spark, sf_dir)
    return contracts.unmatched_endpoints(e, m).select("repo", "file", "method", "path_pattern", F.col("line").cast("long").alias("line"))


def api_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, c, m = _api(spark, sf_dir)
    return contracts.api_drift(c, m)


def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    return dedupe.first_wins(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


def next_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event of the least type with the user's next event of the greatest type."""
    e = _t(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    out = dedupe.next_of(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "click", F.col("event_type") == "view", "event_id", "next_id")
    return out.select("user_id", "event_id", "next_id")


def _files_of_documents(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    files = d.select(F.col("source").alias("repo"), F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"), "doc_id")
    old = files.filter("doc_id % 10 <> 0").select("repo", "path", F.when(F.col("doc_id") % 7 == 0, "stale").otherwise(F.sha2(F.col("content"), 256)).alias("hash"), F.lit("1").alias("indexer_version"), F.lit("c").alias("config_hash"))
    return files.filter("doc_id % 13 <> 0"), old


def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, old = _files_of_documents(spark, sf_dir)
    return dedupe.file_status(files, old, "1", "c").select("repo", "path", "status")


def refresh_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, old = _files_of_documents(spark, sf_dir)
    return dedupe.refresh_counts(dedupe.file_status(files, old, "1", "c"))


def _star_graph(spark, sf_dir):
    edges = _t(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("from"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("to")).distinct()
    nodes = _t(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"))
    return nodes, edges


def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(*_star_graph(spark, sf_dir))


def dead_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that no label points to."""
    text = F.col("doc_id").cast("string")
    edges = _t(spark, sf_dir, "labels").select(F.concat(F.lit("label"), text).alias("from"), text.alias("to"))
    return graph.dead(_t(spark, sf_dir, "documents").select(text.alias("id")), edges)


def dangling_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _star_graph(spark, sf_dir)
    return graph.dangling(nodes.filter("id not like '%7'").union(edges.select("from").distinct()), edges).withColumnsRenamed({"from": "source_id", "to": "target_id"})


def resolve_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders call parts by brand within a size's repo; a part's node is Type.Brand."""
    part = _t(spark, sf_dir, "part")
    repo = F.concat(F.lit("r"), F.col("p_size").cast("string"))
    nodes = part.select(repo.alias("repo"), F.concat(F.lit("T"), (F.col("p_partkey") % 40).cast("string"), F.lit("."), F.regexp_replace("p_brand", "[^A-Za-z0-9]", "_")).alias("id"))
    calls = part.select(repo.alias("repo"), F.concat(F.lit("K"), F.col("p_partkey").cast("string")).alias("caller"), F.regexp_replace("p_brand", "[^A-Za-z0-9]", "_").alias("name"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("t"), (F.col("p_partkey") % 40).cast("string"), F.lit("."))).alias("qualifier"))
    return graph.resolve_calls(calls, graph.candidate_index(nodes)).select("repo", "caller", "target", "kind", "confidence")


def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.document_frequency(search.inverted_index(_t(spark, sf_dir, "documents"), "doc_id", "text"))


def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.rank(_t(spark, sf_dir, "documents"), ["the", "nd", "der", "que"], "doc_id", "text")


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In-degree of link targets over all pages."""
    p = _t(spark, sf_dir, "pages").select(F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))).alias("target"))
    return p.groupBy("target").agg(F.count("*").alias("in_degree"))


def _ddl(spark, sf_dir):
    s = _t(spark, sf_dir, "supplier")
    k = F.col("s_suppkey").cast("string")
    key = F.when(F.col("s_suppkey") % 3 == 0, " UNIQUE").otherwise("")
    text = F.concat(
        F.lit("CREATE TABLE n"), F.col("s_nationkey").cast("string"), F.lit(" (\n  id INT PRIMARY KEY,\n  price DECIMAL(10, 2)\n);\nCREATE TABLE s"), k,
        F.lit(" (\n  id INT PRIMARY KEY,\n  nation_id INT"), key, F.lit(" REFERENCES n"), F.col("s_nationkey").cast("string"), F.lit("(id)\n);\n"),
    )
    return s.select(F.concat(F.lit("db"), (F.col("s_suppkey") % 5).cast("string")).alias("repo"), F.concat(F.lit("s"), k, F.lit(".sql")).alias("path"), text.alias("content"))


def table_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.relations(relations.columns(relations.extract_ddl(_ddl(spark, sf_dir))))


def sql_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = facts.extract_statements(in_scope(dao_corpus(spark, sf_dir)))
    return s.select("repo", "file", F.col("line").cast("long").alias("line"), "type", F.array_join("tables", ",").alias("tables"))


def table_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.table_usage(facts.extract_statements(in_scope(dao_corpus(spark, sf_dir)))).withColumnRenamed("table", "table_name")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = facts.extract_transactions(in_scope(dao_corpus(spark, sf_dir)))
    return t.select("repo", "file", F.col("line").cast("long").alias("line"), "entry_method", "propagation")


def external_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = facts.extract_external(in_scope(dao_corpus(spark, sf_dir)))
    return x.select("repo", "file", F.col("line").cast("long").alias("line"), "type", "method")


def environment_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = facts.extract_environment(in_scope(dao_corpus(spark, sf_dir)))
    return e.groupBy("marker").agg(F.count("*").alias("reads"), F.countDistinct("repo").alias("repos"))


_QUERIES = (
    api_match, api_unmatched_endpoints, api_drift, first_wins, next_method, changed_files, refresh_counts, degrees, dead_nodes, dangling_edges, resolve_calls, document_frequency, ranked_search,
    page_links, table_relations, sql_statements, table_usage, transactions, external_calls, environment_reads,
)


_PARTS = (project, parsed, catalog, frameworks, routing, stored)


def merged(*parts: dict) -> dict:
    """One dictionary of all; a name that comes twice is a mistake."""
    out: dict = {}
    for p in parts:
        if twice := out.keys() & p.keys():
            raise ValueError(f"registered twice: {sorted(twice)}")
        out |= p
    return out


def queries() -> dict:
    return merged({f.__name__: f for f in _QUERIES}, *(m.queries() for m in _PARTS))


_E = """e AS (SELECT 'api' || (p_partkey % 50) AS repo, 'src/C' || p_partkey || '.java' AS file, '/shop/s' || p_size || '/items/{param}/p' || p_partkey AS path_pattern FROM part)"""
_C = """c AS (SELECT 'web' || (c_custkey % 50) AS repo, 'app/c' || c_custkey || '.ts' AS file,
 '/shop/s' || (c_custkey % 50 + 1) || '/items/{param}/p' || c_custkey || CASE WHEN c_nationkey = 7 THEN '/old' ELSE '' END AS path_pattern FROM customer)"""
_G = "g AS (SELECT DISTINCT 'o' || l_orderkey AS f, 'p' || l_partkey AS t FROM lineitem), n AS (SELECT 'p' || p_partkey AS id FROM part)"
_S = """f AS (SELECT source AS repo, CAST(doc_id AS VARCHAR) AS path, sha256(text) AS hash FROM documents WHERE doc_id % 13 <> 0),
m AS (SELECT source AS repo, CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 7 = 0 THEN 'stale' ELSE sha256(text) END AS old FROM documents WHERE doc_id % 10 <> 0),
s AS (SELECT coalesce(f.repo, m.repo) AS repo, coalesce(f.path, m.path) AS path, CASE WHEN f.path IS NULL THEN 'removed' WHEN f.hash = m.old THEN 'reused' ELSE 'analyze' END AS status
 FROM f FULL OUTER JOIN m ON f.repo = m.repo AND f.path = m.path)"""
_TOK = """tok AS (SELECT DISTINCT doc_id, unnest(list_concat(
 string_split(lower(regexp_replace(text, '[^\\p{L}\\p{N}_.$-]+', ' ', 'g')), ' '),
 string_split(lower(regexp_replace(regexp_replace(text, '([\\p{Ll}\\p{N}])(\\p{Lu})', '\\1 \\2', 'g'), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '))) AS token FROM documents)"""

ORACLE = {
    "api_match": f"WITH {_E}, {_C} SELECT e.file AS endpoint_file, c.file AS consumer_file, path_pattern FROM e JOIN c USING (path_pattern)",
    "api_unmatched_endpoints": f"WITH {_E}, {_C} SELECT repo, file, 'GET' AS method, path_pattern, CAST(6 AS BIGINT) AS line FROM e WHERE path_pattern NOT IN (SELECT path_pattern FROM c)",
    "api_drift": f"""WITH {_E}, {_C} SELECT repo, count(*) AS consumers, count(*) FILTER (WHERE NOT ok) AS unmatched, CASE WHEN bool_and(ok) THEN 'PASS' ELSE 'WARN' END AS status
 FROM (SELECT repo, path_pattern IN (SELECT path_pattern FROM e) AS ok FROM c) GROUP BY repo""",
    "first_wins": "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1",
    "next_method": """SELECT user_id, event_id, next_id FROM (SELECT user_id, event_id, event_type, first_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS)
 OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_id FROM events) WHERE event_type = 'click'""",
    "changed_files": f"WITH {_S} SELECT repo, path, status FROM s",
    "refresh_counts": f"""WITH {_S} SELECT repo, count(*) FILTER (WHERE status <> 'removed') AS files, count(*) FILTER (WHERE status = 'analyze') AS analyzed,
 count(*) FILTER (WHERE status = 'reused') AS reused, count(*) FILTER (WHERE status = 'removed') AS removed FROM s GROUP BY repo""",
    "degrees": f"""WITH {_G} SELECT id, (SELECT count(*) FROM g WHERE t = id) AS in_degree, (SELECT count(*) FROM g WHERE f = id) AS out_degree FROM n""",
    "dead_nodes": "SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "dangling_edges": f"""WITH {_G} SELECT f AS source_id, t AS target_id, 'to' AS side FROM g WHERE t LIKE '%7' OR t NOT IN (SELECT id FROM n)""",
    "resolve_calls": """WITH n AS (SELECT DISTINCT 'r' || p_size AS repo, regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g') AS name, 'T' || (p_partkey % 40) AS own FROM part),
c AS (SELECT p_partkey AS k, 'r' || p_size AS repo, regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g') AS name, CASE WHEN p_partkey % 2 = 0 THEN 't' || (p_partkey % 40) END AS q FROM part),
j AS (SELECT k, c.repo, c.name, q, count(*) AS all_n, min(own) AS one FROM c JOIN n ON c.repo = n.repo AND c.name = n.name GROUP BY ALL)
SELECT repo, 'K' || k AS caller, CASE WHEN q IS NOT NULL THEN upper(q) || '.' || name WHEN all_n = 1 THEN one || '.' || name END AS target,
 CASE WHEN q IS NOT NULL OR all_n = 1 THEN 'edge' ELSE 'ambiguous' END AS kind, CASE WHEN q IS NOT NULL THEN 'HIGH' WHEN all_n = 1 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM j""",
    "document_frequency": f"WITH {_TOK} SELECT token, count(*) AS df FROM tok WHERE length(token) > 1 GROUP BY token",
    "ranked_search": f"""WITH {_TOK}, q AS (SELECT unnest(['the', 'nd', 'der', 'que']) AS q)
SELECT doc_id AS item, CAST(sum(CASE WHEN EXISTS (SELECT 1 FROM tok WHERE tok.doc_id = d.doc_id AND tok.token = q.q) THEN 5 ELSE 0 END + CASE WHEN contains(lower(text), q.q) THEN 2 ELSE 0 END) AS INTEGER) AS score
FROM documents d, q GROUP BY doc_id HAVING sum(CASE WHEN contains(lower(text), q.q) THEN 2 ELSE 0 END) > 0 ORDER BY score DESC, item LIMIT 200""",
    "page_links": """SELECT target, count(*) AS in_degree FROM (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages) GROUP BY target""",
    "table_relations": """SELECT 'db' || (s_suppkey % 5) AS repo, 's' || s_suppkey AS from_table, 'nation_id' AS from_column, 'n' || s_nationkey AS to_table, 'id' AS to_column,
 CASE WHEN s_suppkey % 3 = 0 THEN '1:1' ELSE 'N:1' END AS cardinality FROM supplier""",
}

_D = """d AS (SELECT s_suppkey AS k, s_nationkey AS n, 'dao' || (s_suppkey % 20) AS repo, 'src/D' || s_suppkey || '.java' AS file FROM supplier)"""
ORACLE |= {
    "sql_statements": f"WITH {_D} SELECT repo, file, CAST(3 AS BIGINT) AS line, 'SELECT' AS type, 't' || n || ',u' || (k % 7) AS tables FROM d",
    "table_usage": f"""WITH {_D} SELECT repo, table_name, count(*) AS statements, count(DISTINCT file) AS files
 FROM (SELECT repo, file, 't' || n AS table_name FROM d UNION ALL SELECT repo, file, 'u' || (k % 7) FROM d) GROUP BY repo, table_name""",
    "transactions": f"WITH {_D} SELECT repo, file, CAST(5 AS BIGINT) AS line, 'save' || k AS entry_method, CASE WHEN k % 3 = 0 THEN 'REQUIRES_NEW' ELSE 'REQUIRED' END AS propagation FROM d",
    "external_calls": f"WITH {_D} SELECT repo, file, CAST(7 AS BIGINT) AS line, 'kafka_producer' AS type, 'after' || k AS method FROM d",
    "environment_reads": f"WITH {_D} SELECT 'KEY_' || (k % 5) AS marker, count(*) AS reads, count(DISTINCT repo) AS repos FROM d GROUP BY k % 5",
}


def oracle_sql() -> dict:
    return merged(ORACLE, *(m.oracle_sql() for m in _PARTS))
