"""Registered queries over symbols, inventories, relations, closures, checks and reports, each with its oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks, closure, graph, inventory, markdown, relations, search, symbols
from ..sources.corpus import dao_corpus, extension, in_scope, report_corpus, service_corpus

EXTENSIONS = ("java", "ts", "py", "sql", "rpt", "xml", "jsp", "md")


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(column):
    return F.col(column).cast("string")


def _facts(spark, sf_dir):
    """Types, methods and uses of the corpus, written once: nodes, calls and injections read them."""
    return symbols.facts(in_scope(service_corpus(spark, sf_dir)), symbols.INJECTS)


def symbol_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = symbols.nodes(symbols.parse(in_scope(service_corpus(spark, sf_dir))))
    return n.select("repo", "id", "kind", "file", F.col("line").cast("long").alias("line"), "visibility")


def _call_edges(parsed):
    return graph.resolve_calls(symbols.call_sites(parsed), graph.candidate_index(symbols.nodes(parsed)))


def call_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _call_edges(_facts(spark, sf_dir)).select("repo", "caller", "target", "kind", "confidence", F.col("line").cast("long").alias("line"))


def injection_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _facts(spark, sf_dir)
    return graph.resolve_calls(symbols.injections(p), graph.candidate_index(symbols.nodes(p))).select("repo", "caller", "target", "kind")


def dead_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods, not private, that nothing calls."""
    p = _facts(spark, sf_dir)
    m = symbols.nodes(p).filter("kind = 'method' and visibility <> 'private'").select("repo", "id").distinct()
    called = _call_edges(p).filter("kind = 'edge'").select("repo", F.col("target").alias("id"))
    return m.join(called, ["repo", "id"], "left_anti")


def _listing(spark, sf_dir):
    """A listing with paths over several folders and formats."""
    d, i = _t(spark, sf_dir, "documents"), F.col("doc_id")
    path = F.concat(F.lit("m"), (i % 3).cast("string"), F.lit("/n"), (i % 5).cast("string"), F.lit("/f"), _text("doc_id"), F.lit("."), F.element_at(F.array(*map(F.lit, EXTENSIONS)), (i % 8 + 1).cast("int")))
    return d.select(F.col("source").alias("repo"), path.alias("path"), "doc_id")


def unsupported_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.unsupported_files(_listing(spark, sf_dir))


def adapter_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.adapter_coverage(_listing(spark, sf_dir))


def adapter_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Python files of sources that end in 7 have Flask endpoints."""
    f = _listing(spark, sf_dir)
    e = f.filter("repo like '%7'").select("repo", F.col("path").alias("file"), F.lit("flask").alias("framework"))
    return inventory.adapter_extensions(f, e)


def complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _listing(spark, sf_dir)
    return inventory.complexity(f, f.select("repo", F.col("path").endswith(".sql").alias("has_db"), (F.col("doc_id") % 97 == 0).alias("has_external")))


def workspace_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _listing(spark, sf_dir)
    w = f.select("repo").distinct().select("repo", F.inline(F.expr("array(named_struct('seq', 1, 'id', 'all', 'path', 'm0'), named_struct('seq', 2, 'id', 'deep', 'path', 'm0/n1'), named_struct('seq', 3, 'id', 'other', 'path', 'm2'))")))
    return inventory.assign_workspace(f, w).groupBy("repo", "workspace").agg(F.count("*").alias("files"))


def _mounts(spark, sf_dir):
    k = F.col("s_suppkey")
    s = _t(spark, sf_dir, "supplier").select(F.lit("r").alias("repo"), F.floor(k / 2).cast("long").cast("string").alias("owner"), _text("s_suppkey").alias("target"), F.concat(F.lit("/p"), (k % 7).cast("string"), F.lit("/")).alias("prefix"))
    return s.filter("owner <> '0'")


def router_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _mounts(spark, sf_dir)
    back = m.filter("target = '1000'").select("repo", F.col("target").alias("owner"), F.lit("1").alias("target"), F.lit("/loop").alias("prefix"))
    roots = _t(spark, sf_dir, "supplier").filter("s_suppkey = 1").select(F.lit("r").alias("repo"), F.lit("1").alias("module"))
    return closure.mount_prefixes(m.unionByName(back), roots)


def _scopes(spark, sf_dir):
    k = F.col("s_suppkey")
    s = _t(spark, sf_dir, "supplier").withColumn("repo", (k % 1).cast("string"))
    edges = s.select("repo", _text("s_suppkey").alias("from"), F.explode(F.array(F.floor(k / 2).cast("string"), F.floor(k / 3).cast("string"), F.when(k == 1, "5").otherwise("0"))).alias("to"))
    return closure.scope(s.select("repo", _text("s_suppkey").alias("entry")), edges.filter("to <> '0'"))


def transaction_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scopes(spark, sf_dir).select("entry", "method")


def external_in_transaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "supplier").select(F.lit("0").alias("repo"), _text("s_suppkey").alias("method"))
    return closure.in_transaction(c, _scopes(spark, sf_dir)).select("method", "in_transaction")


def _star(spark, sf_dir):
    edges = _t(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), _text("l_suppkey")).alias("from"), F.concat(F.lit("p"), _text("l_partkey")).alias("to"), F.lit("call").alias("type")).distinct()
    p = _t(spark, sf_dir, "part").select(F.concat(F.lit("p"), _text("p_partkey")).alias("id"), F.col("p_type").alias("file"))
    s = _t(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), _text("s_suppkey")).alias("id"), F.lit(None).cast("string").alias("file"))
    return p.unionByName(s), edges


def hub_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and their market segments."""
    c = _t(spark, sf_dir, "customer").select(F.concat(F.lit("c"), _text("c_custkey")).alias("from"), F.col("c_mktsegment").alias("to"))
    nodes = c.select(F.col("from").alias("id")).union(c.select("to").distinct())
    return graph.hubs(graph.degrees(nodes, c)).select("id", "in_degree")


def top_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.top_hubs(graph.degrees(*_star(spark, sf_dir)))


def visible_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _star(spark, sf_dir)
    return graph.visible_edges(nodes.filter("id not like '%4'"), edges).select(F.col("from").alias("source_id"), F.col("to").alias("target_id"))


def edge_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _star(spark, sf_dir)
    k = F.col("l_partkey")
    patch = _t(spark, sf_dir, "lineitem").select(
        F.when(k % 11 == 0, "drop_edge").otherwise("add_edge").alias("op"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("from"), F.concat(F.lit("p"), (k * 2).cast("string")).alias("to"), F.when(k % 5 == 0, "imports").otherwise("call").alias("type")
    )
    return graph.apply_patch(edges, nodes, patch).groupBy("status").agg(F.count("*").alias("n"))


def layer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.element_at(F.array(*map(F.lit, ("ShopController", "ItemDao", "UserDto", "Clock", "LoginForm", "x.jsp"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    n = _t(spark, sf_dir, "part").select(F.col("p_brand").alias("repo"), graph.classify(words, F.lit(""), F.when(F.col("p_partkey") % 10 == 0, "trigger").otherwise("class")).alias("layer"))
    return n.groupBy("repo", "layer").agg(F.count("*").alias("nodes"))


def merged_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    rows = e.select(F.lit("r").alias("repo"), F.col("user_id").alias("id"), F.struct("ts", "event_id").alias("seq"), F.when(F.col("event_type") == "click", "").otherwise(F.col("event_type")).alias("label"), F.when(F.col("event_id") % 3 == 0, F.col("event_id")).alias("line"))
    return graph.merge_nodes(rows, "seq").select(F.col("id").alias("user_id"), "label", "line")


def relation_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    k = F.col("c_custkey")
    name = lambda p, x=k: F.concat(F.lit(p), x.cast("string"))
    tables = c.filter(k % 10 != 0).select(F.lit("r").alias("repo"), name("C").alias("table")).union(c.select(F.lit("r"), name("n", F.col("c_nationkey"))).distinct())
    keys = c.filter(k % 3 == 0).select(F.lit("r").alias("repo"), name("c").alias("table"), F.lit("unique_index").alias("basis"), F.array(F.lit("B"), F.lit("a")).alias("columns"))
    keys = keys.unionByName(c.filter(F.col("c_nationkey") > 9).select(F.lit("r").alias("repo"), name("N", F.col("c_nationkey")).alias("table"), F.lit("primary_key").alias("basis"), F.array(F.lit("x"), F.lit("y")).alias("columns")))
    rel = c.select(F.lit("r").alias("repo"), F.when(k % 2 == 0, "foreign_key").otherwise("query_join").alias("type"), name("c").alias("from_table"), F.array(F.lit("a"), F.lit("b")).alias("from_columns"), name("n", F.col("c_nationkey")).alias("to_table"), F.array(F.lit("y"), F.lit("x")).alias("to_columns"))
    return relations.cardinality(rel, tables, relations.uniqueness(keys)).select("from_table", "to_table", "type", "cardinality")


def join_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = _t(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 40).cast("string").alias("repo"), F.concat(F.lit("t"), _text("l_orderkey")).alias("table"), F.col("l_linenumber").alias("ord"), F.concat(F.lit("k"), _text("l_linenumber")).alias("c"), F.concat(F.lit("p"), _text("l_partkey")).alias("ref_table"))
    fk = l.select("repo", "table", "ord", F.array("c").alias("columns"), "ref_table")
    keys = l.groupBy("repo", "table").agg(F.collect_list(F.upper("c")).alias("columns")).filter("size(columns) <= 3").withColumn("basis", F.lit("primary_key"))
    return relations.many_to_many(fk, relations.uniqueness(keys)).select("via_table", "from_table", "to_table")


def schema_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders").withColumn("o_orderstatus", F.expr("nullif(o_orderstatus, 'P')"))
    return checks.check_schema(o, ["o_orderkey"], [("o_orderstatus", "required"), ("o_orderstatus", "enum", ("F",)), ("o_totalprice", "minimum", 50000)])


def evidence_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _t(spark, sf_dir, "supplier")
    facts = s.select(F.concat(F.lit("dao"), (F.col("s_suppkey") % 20).cast("string")).alias("repo"), F.concat(F.when(F.col("s_suppkey") % 9 == 0, "../").otherwise(""), F.lit("src/D"), ((F.col("s_suppkey") * 2) - F.col("s_suppkey") % 2 * F.col("s_suppkey")).cast("string"), F.lit(".java")).alias("file"))
    return checks.check_evidence_paths(facts, dao_corpus(spark, sf_dir))


def line_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = checks.source_references(report_corpus(spark, sf_dir))
    return checks.check_line_references(r, dao_corpus(spark, sf_dir)).select("repo", "doc", "file", "line", "status")


def evidence_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.evidence_density(checks.source_references(report_corpus(spark, sf_dir)), dao_corpus(spark, sf_dir))


def report_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing files fail, lines out of range warn."""
    r = checks.check_line_references(checks.source_references(report_corpus(spark, sf_dir)), dao_corpus(spark, sf_dir))
    return checks.score(r.select("repo", F.when(F.col("status") == "MISSING", "FAIL").when(F.col("status") == "OUT_OF_RANGE", "WARN").otherwise("OK").alias("level")))


def report_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.sections(report_corpus(spark, sf_dir)).select("repo", "path", "level", "title", F.length("body").cast("long").alias("chars"))


def report_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.risks(report_corpus(spark, sf_dir))


def search_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types and their second and third letters as query over names: what is no token falls back to substrings."""
    part = _t(spark, sf_dir, "part")
    index = search.inverted_index(part, "p_partkey", "p_name")
    query = part.select(F.explode(F.array(F.lower("p_type"), F.lower(F.substring("p_type", 2, 2)))).alias("token")).distinct()
    return search.candidates(index, query)


def record_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_records(_t(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_mktsegment").alias("file")), "BUILD", file="BUILDING").withColumnRenamed("file", "c_mktsegment")


def unresolved_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.page(_t(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_orderkey"), ["o_orderkey"], 100, 1000).select("o_orderkey", "ord", "total", "next_offset")


def sorted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing with its place in the order of extension and path."""
    f = _listing(spark, sf_dir).select("repo", "path", extension(F.col("path")).alias("ext"))
    return search.ordinals(f, ["ext", "path", "repo"])[0].select("repo", "path", "ord")


def batch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations, market segments and part types as queries over parts and customers: a table of queries at once."""
    p = _t(spark, sf_dir, "part").select(F.concat(F.lit("part-"), _text("p_partkey")).alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("text"))
    c = _t(spark, sf_dir, "customer").select(F.concat(F.lit("customer-"), _text("c_custkey")).alias("id"), F.col("c_mktsegment").alias("title"), F.col("c_name").alias("text"))
    q = _t(spark, sf_dir, "part").select(F.lower("p_type").alias("query")).union(_t(spark, sf_dir, "customer").select("c_mktsegment")).union(_t(spark, sf_dir, "nation").select(F.concat(F.lit("part customer-"), _text("n_nationkey")))).distinct()
    return search.rank_batch(p.unionByName(c), q.select(F.col("query").alias("query_id"), "query"), 50).select("query_id", "item", "score", "place")


_QUERIES = (
    symbol_nodes, call_graph, injection_edges, dead_methods, unsupported_files, adapter_coverage, adapter_extensions, complexity, workspace_files, router_prefixes, transaction_scope, external_in_transaction, hub_nodes, top_hubs, visible_edges,
    edge_patch, layer_counts, merged_nodes, relation_cardinality, join_tables, schema_violations, evidence_paths, line_references, evidence_density, report_score, report_sections, report_risks, search_candidates, record_search, unresolved_page, sorted_files, batch_search,
)


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


_P = "p AS (SELECT p_partkey AS k, 'svc' || (p_partkey % 40) AS repo FROM part)"
_F = "f AS (SELECT source AS repo, doc_id, 'm' || (doc_id % 3) || '/n' || (doc_id % 5) || '/f' || doc_id || '.' || ['java','ts','py','sql','rpt','xml','jsp','md'][doc_id % 8 + 1] AS path, doc_id % 8 AS e FROM documents)"
_SC = """s AS (SELECT s_suppkey AS k FROM supplier), g AS (SELECT * FROM (SELECT k AS f, unnest([k // 2, k // 3, CASE WHEN k = 1 THEN 5 ELSE 0 END]) AS t FROM s) WHERE t > 0),
r AS (SELECT k AS entry, k AS m FROM s UNION SELECT entry, t FROM r JOIN g ON g.f = r.m)"""
_G = "g AS (SELECT DISTINCT 's' || l_suppkey AS f, 'p' || l_partkey AS t FROM lineitem), n AS (SELECT 'p' || p_partkey AS id FROM part UNION ALL SELECT 's' || s_suppkey FROM supplier)"
_R = """s AS (SELECT s_suppkey AS k, 'dao' || (s_suppkey % 20) AS repo, 'docs/r' || s_suppkey || '.md' AS doc FROM supplier),
r AS (SELECT repo, doc, 'src/D' || k || '.java' AS file, 3 AS line, 'OK' AS status FROM s UNION ALL SELECT repo, doc, 'src/D' || k || '.java', 400, 'OUT_OF_RANGE' FROM s UNION ALL SELECT repo, doc, 'src/X' || k || '.java', 1, 'MISSING' FROM s)"""

ORACLE = {
    "symbol_nodes": f"""WITH {_P} SELECT repo, 'svc.S' || k AS id, 'class' AS kind, 'src/S' || k || '.java' AS file, CAST(3 AS BIGINT) AS line, '' AS visibility FROM p
 UNION ALL SELECT repo, 'svc.S' || k || '.run' || k, 'method', 'src/S' || k || '.java', 7, 'public' FROM p UNION ALL SELECT repo, 'svc.S' || k || '.help' || k, 'method', 'src/S' || k || '.java', 12, 'private' FROM p""",
    "call_graph": f"""WITH {_P} SELECT repo, 'svc.S' || k || '.run' || k AS caller, 'svc.S' || k || '.help' || k AS target, 'edge' AS kind, 'MEDIUM' AS confidence, CAST(9 AS BIGINT) AS line FROM p
 UNION ALL SELECT repo, 'svc.S' || k || '.help' || k, 'svc.S' || (k + 40) || '.run' || (k + 40), 'edge', 'HIGH', 12 FROM p WHERE k + 40 IN (SELECT k FROM p)""",
    "injection_edges": f"WITH {_P} SELECT repo, 'svc.S' || k AS caller, 'svc.S' || (k + 40) AS target, 'edge' AS kind FROM p WHERE k + 40 IN (SELECT k FROM p)",
    "dead_methods": f"WITH {_P} SELECT repo, 'svc.S' || k || '.run' || k AS id FROM p WHERE k - 40 NOT IN (SELECT k FROM p)",
    "unsupported_files": f"WITH {_F} SELECT repo, path FROM f WHERE e = 4",
    "adapter_coverage": f"""WITH {_F}, g AS (SELECT repo, count(*) FILTER (WHERE e < 4) AS full_files, count(*) FILTER (WHERE e > 4) AS partial_files, count(*) FILTER (WHERE e = 4) AS unsupported_files FROM f GROUP BY repo)
 SELECT *, CASE WHEN unsupported_files > 0 THEN 'WARN' WHEN partial_files > 0 THEN 'PARTIAL' ELSE 'FULL' END AS status FROM g""",
    "adapter_extensions": f"""WITH {_F}, x AS (SELECT repo, e, ['java','ts','py','sql','rpt','xml','jsp','md'][e + 1] AS extension FROM f)
 SELECT repo, extension, CASE WHEN e = 4 THEN 'UNSUPPORTED' WHEN e > 4 OR (e = 2 AND repo LIKE '%7') THEN 'PARTIAL' ELSE 'FULL' END AS level, count(*) AS files FROM x GROUP BY ALL""",
    "complexity": f"""WITH {_F}, g AS (SELECT repo, count(*) + CASE WHEN bool_or(e = 3) THEN 30 ELSE 0 END + CASE WHEN count(*) FILTER (WHERE e = 6) >= 50 THEN 40 ELSE 0 END + CASE WHEN bool_or(doc_id % 97 = 0) THEN 20 ELSE 0 END AS score FROM f GROUP BY repo)
 SELECT repo, score, CASE WHEN score <= 50 THEN 'Lite' WHEN score <= 120 THEN 'Standard' ELSE 'Full' END AS tier FROM g""",
    "workspace_files": f"WITH {_F} SELECT repo, CASE WHEN doc_id % 3 = 0 AND doc_id % 5 = 1 THEN 'deep' WHEN doc_id % 3 = 2 THEN 'other' ELSE 'all' END AS workspace, count(*) AS files FROM f GROUP BY ALL",
    "router_prefixes": """WITH RECURSIVE r AS (SELECT s_suppkey AS k, '' AS prefix FROM supplier WHERE s_suppkey = 1 UNION ALL SELECT s_suppkey, r.prefix || '/p' || (s_suppkey % 7) FROM supplier JOIN r ON s_suppkey // 2 = r.k)
 SELECT 'r' AS repo, CAST(k AS VARCHAR) AS module, CASE WHEN prefix = '' THEN '/' ELSE prefix END AS prefix FROM r""",
    "transaction_scope": f"WITH RECURSIVE {_SC} SELECT CAST(entry AS VARCHAR) AS entry, CAST(m AS VARCHAR) AS method FROM r",
    "external_in_transaction": f"WITH RECURSIVE {_SC} SELECT CAST(k AS VARCHAR) AS method, k IN (SELECT m FROM r) AS in_transaction FROM s",
    "hub_nodes": "SELECT c_mktsegment AS id, count(*) AS in_degree FROM customer GROUP BY c_mktsegment HAVING count(*) >= (SELECT greatest(5, ceil((count(*) + count(DISTINCT c_mktsegment)) * 15 / 100.0)) FROM customer)",
    "top_hubs": f"WITH {_G} SELECT id, count(t) AS in_degree FROM n LEFT JOIN g ON g.t = id GROUP BY id ORDER BY in_degree DESC, id LIMIT 15",
    "visible_edges": f"WITH {_G}, v AS (SELECT id FROM n WHERE id NOT LIKE '%4') SELECT f AS source_id, t AS target_id FROM g WHERE f IN (SELECT id FROM v) AND t IN (SELECT id FROM v)",
    "edge_patch": f"""WITH {_G}, a AS (SELECT l_partkey AS k, 's' || l_suppkey AS f, 'p' || (l_partkey * 2) AS t FROM lineitem),
b AS (SELECT f, t, k % 11 <> 0 AND k % 5 <> 0 AND f IN (SELECT id FROM n) AND t IN (SELECT id FROM n) AS ok FROM a), c AS (SELECT f, t, ok, row_number() OVER (PARTITION BY f, t, ok) AS i FROM b)
SELECT CASE WHEN NOT ok THEN 'rejected' WHEN i > 1 OR (f, t) IN (SELECT (f, t) FROM g) THEN 'duplicate' ELSE 'applied' END AS status, count(*) AS n FROM c GROUP BY ALL""",
    "layer_counts": "SELECT p_brand AS repo, CASE WHEN p_partkey % 10 = 0 THEN 'view' ELSE ['endpoint', 'dao', 'util', 'function', 'view', 'view'][p_partkey % 6 + 1] END AS layer, count(*) AS nodes FROM part GROUP BY ALL",
    "merged_nodes": """SELECT user_id, arg_max(event_type, (ts, event_id)) FILTER (WHERE event_type <> 'click') AS label, arg_max(event_id, (ts, event_id)) FILTER (WHERE event_id % 3 = 0) AS line FROM events GROUP BY user_id""",
    "relation_cardinality": """SELECT 'c' || c_custkey AS from_table, 'n' || c_nationkey AS to_table, CASE WHEN c_custkey % 2 = 0 THEN 'foreign_key' ELSE 'query_join' END AS type,
 CASE WHEN c_custkey % 10 = 0 THEN 'unknown' WHEN c_custkey % 2 = 0 THEN CASE WHEN c_custkey % 3 = 0 THEN '1:1' ELSE 'N:1' END
 ELSE CASE WHEN c_custkey % 3 = 0 THEN '1' ELSE 'N' END || ':' || CASE WHEN c_nationkey > 9 THEN '1' WHEN c_custkey % 3 = 0 THEN 'N' ELSE 'M' END END AS cardinality FROM customer""",
    "join_tables": """WITH o AS (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) <= 3), l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, 'p' || l_partkey) AS i FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM o))
 SELECT 't' || a.l_orderkey AS via_table, 'p' || a.l_partkey AS from_table, 'p' || b.l_partkey AS to_table FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.i < b.i""",
    "schema_violations": """SELECT o_orderkey, 'o_orderstatus' AS column, 'required' AS rule FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_orderkey, 'o_orderstatus', 'enum' FROM orders WHERE o_orderstatus NOT IN ('F', 'P')
 UNION ALL SELECT o_orderkey, 'o_totalprice', 'minimum' FROM orders WHERE o_totalprice < 50000""",
    "evidence_paths": """WITH s AS (SELECT s_suppkey AS k, 'dao' || (s_suppkey % 20) AS repo, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey * 2 ELSE s_suppkey END AS x FROM supplier)
 SELECT repo, CASE WHEN k % 9 = 0 THEN '../' ELSE '' END || 'src/D' || x || '.java' AS file, CASE WHEN k % 9 = 0 THEN 'UNSAFE' ELSE 'MISSING' END AS problem FROM s
 WHERE k % 9 = 0 OR (repo, x) NOT IN (SELECT ('dao' || (s_suppkey % 20), s_suppkey) FROM supplier)""",
    "line_references": f"WITH {_R} SELECT repo, doc, file, CAST(line AS BIGINT) AS line, status FROM r",
    "evidence_density": f"""WITH {_R}, n AS (SELECT repo, least(20, greatest(5, ceil(count(*) / 5))) AS needed FROM s GROUP BY repo), g AS (SELECT repo, count(*) AS refs FROM r GROUP BY repo)
 SELECT repo, CAST(needed AS BIGINT) AS needed, refs, refs >= needed AS enough FROM n JOIN g USING (repo)""",
    "report_score": "SELECT 'dao' || (s_suppkey % 20) AS repo, greatest(0, 100 - 15 * count(*)) AS score, 'FAIL' AS status FROM supplier GROUP BY ALL",
    "report_sections": """WITH s AS (SELECT 'dao' || (s_suppkey % 20) AS repo, 'docs/r' || s_suppkey || '.md' AS path, length(CAST(s_suppkey AS VARCHAR)) AS n FROM supplier)
 SELECT repo, path, 2 AS level, 'Known Issues and risk' AS title, CAST(length('- HIGH leak in `src/D.java:3`#- shared remark#### Detail#* medium case (src/D.java:400)') + 2 * n AS BIGINT) AS chars FROM s
 UNION ALL SELECT repo, path, 3, 'Detail', length('* medium case (src/D.java:400)') + n FROM s UNION ALL SELECT repo, path, 2, 'Usage', length('See src/X.java:1 and src/D.java:3.') + 2 * n FROM s""",
    "report_risks": """WITH s AS (SELECT 'dao' || (s_suppkey % 20) AS repo, s_suppkey AS k FROM supplier) SELECT repo, 'HIGH' AS severity, '- HIGH leak in `src/D' || k || '.java:3`' AS text FROM s WHERE false
 UNION ALL SELECT repo, 'HIGH', 'HIGH leak in `src/D' || k || '.java:3`' FROM s UNION ALL SELECT repo, 'MEDIUM', 'medium case (src/D' || k || '.java:400)' FROM s UNION ALL SELECT DISTINCT repo, 'INFO', 'shared remark' FROM s""",
    "search_candidates": """WITH tok AS (SELECT DISTINCT p_partkey AS item, lower(unnest(regexp_split_to_array(p_name, '[^A-Za-z0-9]+'))) AS token FROM part), i AS (SELECT * FROM tok WHERE length(token) > 1), q AS (SELECT DISTINCT lower(unnest([p_type, substr(p_type, 2, 2)])) AS query FROM part)
 SELECT DISTINCT query, item FROM q JOIN i ON CASE WHEN query IN (SELECT token FROM i) THEN token = query ELSE contains(token, query) OR contains(query, token) END""",
    "record_search": """SELECT c_custkey, c_name, c_mktsegment, count(*) OVER () > 100 AS truncated FROM customer WHERE c_mktsegment = 'BUILDING' QUALIFY row_number() OVER (ORDER BY c_custkey) <= 100""",
    "unresolved_page": """WITH f AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS ord, count(*) OVER () AS total FROM orders WHERE o_orderstatus = 'F')
 SELECT *, CASE WHEN total > 300 THEN CAST(300 AS BIGINT) END AS next_offset FROM f WHERE ord BETWEEN 100 AND 299""",
    "sorted_files": f"WITH {_F} SELECT repo, path, row_number() OVER (ORDER BY ['java','ts','py','sql','rpt','xml','jsp','md'][e + 1], path, repo) - 1 AS ord FROM f",
    "batch_search": r"""WITH i AS (SELECT 'part-' || p_partkey AS id, p_name AS title, p_type AS txt FROM part UNION ALL SELECT 'customer-' || c_custkey, c_mktsegment, c_name FROM customer),
t AS (SELECT DISTINCT id, unnest(list_concat(string_split(lower(regexp_replace(title || ' ' || txt, '[^\p{L}\p{N}_.$-]+', ' ', 'g')), ' '), string_split(lower(regexp_replace(regexp_replace(title || ' ' || txt, '([\p{Ll}\p{N}])(\p{Lu})', '\1 \2', 'g'), '[^\p{L}\p{N}]+', ' ', 'g')), ' '))) AS token FROM i),
q AS (SELECT lower(p_type) AS q FROM part UNION SELECT c_mktsegment FROM customer UNION SELECT 'part customer-' || n_nationkey FROM nation),
w AS (SELECT DISTINCT q, unnest(list_concat(string_split(lower(regexp_replace(q, '[^\p{L}\p{N}_.$-]+', ' ', 'g')), ' '), string_split(lower(regexp_replace(regexp_replace(q, '([\p{Ll}\p{N}])(\p{Lu})', '\1 \2', 'g'), '[^\p{L}\p{N}]+', ' ', 'g')), ' '))) AS token FROM q),
u AS (SELECT DISTINCT token FROM w WHERE length(token) > 1),
h AS (SELECT u.token, i.id, i.title, CASE WHEN lower(title) = u.token THEN 20 WHEN contains(lower(title), u.token) THEN 10 ELSE 0 END + CASE WHEN contains(lower(i.id), u.token) THEN 7 ELSE 0 END + CASE WHEN contains(lower(txt), u.token) THEN 2 ELSE 0 END
  + CASE WHEN (i.id, u.token) IN (SELECT (id, token) FROM t) THEN 5 ELSE 0 END AS s FROM u, i)
SELECT q AS query_id, id AS item, CAST(score AS BIGINT) AS score, CAST(place AS INTEGER) AS place FROM (SELECT q, id, sum(s) AS score, row_number() OVER (PARTITION BY q ORDER BY sum(s) DESC, lower(any_value(title)), id) AS place FROM w JOIN h USING (token) WHERE s > 0 GROUP BY q, id) WHERE place <= 50""",
}


def oracle_sql() -> dict:
    return dict(ORACLE)
