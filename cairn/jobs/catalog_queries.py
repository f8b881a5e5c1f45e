"""Queries over statements, contracts, counts, documents and checks, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks, contracts, documents, graph, markdown, relations, search, sql_facts, statistics
from ..sources.corpus import in_scope, report_corpus


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _s(*parts: str | Column) -> Column:
    """Text of literals and columns; a string that begins with @ names a column."""
    return F.concat(*(p.cast("string") if isinstance(p, Column) else F.col(p[1:]).cast("string") if p.startswith("@") else F.lit(p) for p in parts))


def _files(rows: DataFrame, repo: Column, path: Column, content: Column) -> DataFrame:
    f = rows.select(repo.alias("repo"), path.alias("path"), content.alias("content"))
    return f.withColumn("size", F.octet_length("content").cast("long")).withColumn("mtime", F.timestamp_seconds(F.lit(0)))


def _mappers(spark, sf_dir):
    """A mapper and a class per supplier: statements in elements and in a literal, and a call of one of them."""
    s = _t(spark, sf_dir, "supplier")
    repo, seven = _s("db", F.col("s_suppkey") % 20), F.col("s_suppkey") % 7
    xml = _s(
        '<mapper namespace="shop.D', "@s_suppkey", '">\n<select id="find">\nSELECT a.id FROM t', "@s_nationkey", " a JOIN u", seven, ' AS b ON a.id = b.ref\n</select>\n<update parameterType="int" id="set">UPDATE t', "@s_nationkey", " SET x = 1</update>\n</mapper>\n"
    )
    java = _s(
        "class D", "@s_suppkey", ' {\n  void run(Session s) {\n    String q = "DELETE FROM w', "@s_nationkey", ' WHERE id = 1";\n    String no = "select a word";\n    s.selectOne("shop.D', "@s_suppkey", '.find");\n  }\n  void later', "@s_suppkey", "() {\n  }\n}\n"
    )
    files = in_scope(_files(s, repo, _s("m/D", "@s_suppkey", ".xml"), xml).unionByName(_files(s, repo, _s("src/D", "@s_suppkey", ".java"), java)))
    mapped = sql_facts.mapper_statements(files)
    every = mapped.drop("namespace").unionByName(sql_facts.literal_statements(files))
    return every, sql_facts.statement_uses(files, mapped)


def stored_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _mappers(spark, sf_dir)[0]
    return s.select("repo", "file", F.col("line").cast("long").alias("line"), "id", "type", F.array_join("tables", ",").alias("table_names"), "text_preview")


def statement_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mappers(spark, sf_dir)[1].select("repo", "file", F.col("line").cast("long").alias("line"), "sql_id", "method")


def statement_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql_facts.statement_joins(_mappers(spark, sf_dir)[0]).select("repo", "sql_id", "from_table", "from_column", "to_table", "to_column")


def method_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of the schema are written in upper case, within a schema."""
    s = _t(spark, sf_dir, "supplier")
    schema = s.select(_s("db", F.col("s_suppkey") % 20).alias("repo"), _s("SHOP.T", "@s_nationkey").alias("name"), F.col("s_suppkey").alias("ord"))
    every, uses = _mappers(spark, sf_dir)
    return sql_facts.table_edges(uses, every, schema).withColumnRenamed("table", "table_name")


def unused_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql_facts.unused_statements(*_mappers(spark, sf_dir)).select("repo", "id")


def _nations(spark, sf_dir):
    of = lambda t, key: _t(spark, sf_dir, t).select(_s("n", f"@{key}").alias("repo"))
    return of("customer", "c_nationkey"), of("supplier", "s_nationkey"), of("nation", "n_nationkey")


def project_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s, n = _nations(spark, sf_dir)
    return statistics.counts({"symbols": c, "tables": s, "endpoints": n})


def index_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s, _ = _nations(spark, sf_dir)
    return statistics.index_summary({("symbols", "symbols"): c, ("schema", "tables"): s, ("schema", "relations"): s}).withColumnRenamed("index", "index_name")


def index_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s, n = _nations(spark, sf_dir)
    present = s.distinct().withColumn("index", F.lit("schema"))
    declared = n.withColumn("index", F.lit("schema")).unionByName(c.distinct().withColumn("index", F.lit("symbols")))
    return statistics.index_status(present, declared, ("schema", "symbols", "dead_code")).withColumnRenamed("index", "index_name")


def evidence_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as facts of their priority's repo, in a file per customer; parts by brand."""
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("repo"), _s("f", "@o_custkey").alias("file"))
    p = _t(spark, sf_dir, "part").select(F.col("p_brand").alias("repo"), F.col("p_type").alias("file"))
    e = statistics.evidence({"sqls": o, "symbols": p})
    return e.select("repo", "evidence_files", F.array_join("representative", ",").alias("first_files"), "truncated")


def pattern_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repos of parts, each with names of one kind; suppliers add statements."""
    p, five = _t(spark, sf_dir, "part"), F.col("p_partkey") % 5
    name = F.element_at(F.array(*map(F.lit, ("a.OrderController", "b.UserFacade", "c.ItemDao", "d.Plain", "e.Cart"))), (five + 1).cast("int"))
    file = F.concat(F.when(five == 4, "tests/").otherwise("src/"), _s("F", F.col("p_partkey") % 150, ".java"))
    s = _t(spark, sf_dir, "supplier").select(_s("r", F.col("s_suppkey") % 2).alias("repo"), _s("m/", "@s_suppkey", ".xml").alias("file"))
    c = statistics.pattern_candidates(p.select(_s("r", five).alias("repo"), name.alias("id"), file.alias("file")), {"sqls": s})
    return c.select("repo", "slug", F.col("signal_count").cast("long").alias("signal_count"), F.array_join("evidence_files", ",").alias("files"))


def _foreign(spark, sf_dir):
    """Suppliers as tables whose keys refer to their nation's table."""
    s = _t(spark, sf_dir, "supplier")
    row = lambda type_, a, b: s.select(
        _s("db", F.col("s_suppkey") % 5).alias("repo"), F.lit(type_).alias("type"), a.alias("from_table"), F.array(F.lit("id")).alias("from_columns"), b.alias("to_table"), F.array(F.lit("id")).alias("to_columns"),
        F.lit("a.sql").alias("file"), F.lit(None).cast("int").alias("line"),
    )
    return s, row


def all_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of nations in two cases, which are one, and joins of the same tables, which are others."""
    _, row = _foreign(spark, sf_dir)
    up, low = row("foreign_key", _s("N", "@s_nationkey"), F.lit("R")), row("foreign_key", _s("n", "@s_nationkey"), F.lit("r"))
    u = relations.union_relations(up, low, row("query_join", _s("n", "@s_nationkey"), F.lit("r")))
    return u.select("repo", "type", "from_table", "to_table", F.array_join("from_columns", ",").alias("from_columns"))


def relation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, row = _foreign(spark, sf_dir)
    repo = _s("db", F.col("s_suppkey") % 5).alias("repo")
    tables = s.select(repo, _s("S", "@s_suppkey").alias("name")).unionByName(s.select(repo, F.lit("alone").alias("name")).distinct())
    known = row("foreign_key", _s("s", "@s_suppkey"), _s("n", "@s_nationkey")).withColumn("cardinality", F.lit("N:1"))
    joins = row("query_join", _s("s", "@s_suppkey"), F.lit("log")).withColumn("cardinality", F.lit("unknown"))
    return statistics.relation_stats(tables, known.unionByName(joins), s.filter("s_suppkey >= 5").select(repo, F.lit("a").alias("from_table"), F.lit("b").alias("to_table")))


def entity_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers refer to the entity of their nation: of their own framework for even nations, of another for odd ones, whatever its case."""
    n = _t(spark, sf_dir, "nation")
    own = F.when(F.col("n_nationkey") % 2 == 0, "jpa").otherwise("django")
    e = n.select(F.lit("r").alias("repo"), F.col("n_name").alias("name"), _s("t_", own, "_", "@n_nationkey").alias("table"), own.alias("framework"), F.col("n_nationkey").alias("ord"))
    e = e.unionByName(n.select(F.lit("r").alias("repo"), F.col("n_name").alias("name"), _s("z_", "@n_nationkey").alias("table"), F.lit("typeorm").alias("framework"), (F.col("n_nationkey") + 1000).alias("ord")))
    c = _t(spark, sf_dir, "customer").select(
        F.lit("r").alias("repo"), F.col("c_custkey").alias("k"), _s("nation_", "@c_nationkey").alias("from_entity"), _s("NATION_", "@c_nationkey").alias("to_entity"), F.lit("jpa").alias("framework"), (F.col("c_custkey") % 3 == 0).alias("to_is_table")
    )
    return relations.resolve_entities(c, e).select("k", "from_table", "to_table")


def _across(spark, sf_dir):
    """Nations as endpoints and customers as calls, in the system of a region."""
    n = _t(spark, sf_dir, "nation")
    nine = F.col("n_nationkey") % 3
    e = n.select(
        _s("sys", "@n_regionkey").alias("system"), F.lit("api").alias("repo"), _s("e", "@n_nationkey").alias("id"), F.when(nine == 0, "ANY").otherwise("GET").alias("method"), _s("/n/", "@n_nationkey").alias("path_pattern"),
        F.when(nine == 2, False).alias("prefix_resolved"),
    )
    c = _t(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    calls = c.select(
        _s("sys", "@n_regionkey").alias("system"), _s("web", F.col("c_custkey") % 3).alias("repo"), _s("c", "@c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, "POST").otherwise("GET").alias("method"),
        _s("/n/", "@c_nationkey").alias("path_pattern"),
    )
    return e, calls


def matches_across(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.match_across(*_across(spark, sf_dir)).select("system", "endpoint_id", "consumer_repo", "consumer_id")


def backend_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients are the suppliers' nations; those below 20 are declared."""
    c = _t(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("consumers"), F.count_if(F.col("c_acctbal") < 0).alias("unmatched"))
    d = c.join(_t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(_s("b", "@n_regionkey").alias("backend"), _s("w", "@n_nationkey").alias("client"), "consumers", "unmatched")
    said = _t(spark, sf_dir, "nation").filter("n_nationkey < 20").select(_s("b", "@n_regionkey").alias("backend"), _s("w", "@n_nationkey").alias("client"))
    return contracts.drift_summary(d, said)


def partner_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' nations are a backend's own endpoints; customers' nations those of its partners, by market segment."""
    own = _t(spark, sf_dir, "supplier").select(F.lit("api").alias("repo"), _s("e", "@s_nationkey").alias("id"), F.lit("GET").alias("method")).distinct()
    theirs = _t(spark, sf_dir, "customer").select(F.lit("api").alias("repo"), F.col("c_mktsegment").alias("partner"), _s("e", "@c_nationkey").alias("id"), F.lit("POST").alias("method"))
    return contracts.merge_partners(own, theirs).select("id", "source", "partner", "method")


def external_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers belong to the client of their nation's root (nations below 10), else of its id (below 20), else to the first client."""
    n = _t(spark, sf_dir, "nation").select(F.lit("s").alias("system"), _s("w", "@n_nationkey").alias("id"), _s("/R/", "@n_nationkey").alias("root"), F.col("n_nationkey").alias("ord")).filter("ord < 20")
    c, k = _t(spark, sf_dir, "customer"), F.col("c_nationkey")
    items = c.select(
        F.lit("s").alias("system"), F.lit("api").alias("repo"), F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 4 == 0, "local").otherwise("external").alias("source"),
        F.when(k < 10, _s("/r/", "@c_nationkey")).alias("external_path"), F.when(k >= 5, _s("w", "@c_nationkey")).alias("external_id"),
    )
    return contracts.owners(items, n).select("id", "owner")


def contract_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _t(spark, sf_dir, "nation")
    p = n.select(_s("sys", "@n_regionkey").alias("system"), _s("n", "@n_nationkey").alias("repo"), F.when(F.col("n_nationkey") == 7, "PARTIAL").when(F.col("n_nationkey") == 8, None).otherwise("FULL").alias("coverage"))
    e, c = _across(spark, sf_dir)
    m = contracts.match_across(e, c)
    lost = c.join(m.select("system", F.col("consumer_id").alias("id")), ["system", "id"], "left_anti")
    api = statistics.counts({k: d.select(F.col("system").alias("repo")) for k, d in {"endpoints": e, "consumers": c, "unmatched_consumers": lost, "edges": m}.items()})
    return statistics.contract_status(p, api.withColumnRenamed("repo", "system"))


def markdown_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.markdown_documents(report_corpus(spark, sf_dir)).select("repo", "path", "title", "category", "slug")


def document_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents.markdown_documents(report_corpus(spark, sf_dir).unionByName(_notes(spark, sf_dir)))
    return statistics.document_inventory(d).select("repo", "category", "documents", F.array_join("paths", ",").alias("paths"))


def _notes(spark, sf_dir):
    """A note per supplier with a glossary, a section on limits and a credential."""
    s = _t(spark, sf_dir, "supplier")
    text = _s(
        "---\nowner: me\n---\n# Note ", "@s_suppkey", "\n\n## Glossary\n| Term | Text |\n|---|---|\n| Supplier", "@s_suppkey", " | sells | things |\n- Ledger: what is owed\n\n## Stock of goods\nKept in t", "@s_suppkey",
        " and counted daily.\n\n## 분석\nThe indexer misses nothing.\n\nThe call graph of src/D", "@s_suppkey", ".java 누락 is likely.\n- dead code 위험 in it\n", F.when(F.col("s_suppkey") % 2 == 0, "password: hunter2hunter2\n").otherwise("password: <yours-to-set>\n"),
    )
    return s.select(_s("dao", F.col("s_suppkey") % 20).alias("repo"), _s("docs/api/n", "@s_suppkey", ".md").alias("path"), text.alias("content"))


def glossary_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.domains(_notes(spark, sf_dir)).select("repo", "name", "slug")


def limit_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.limit_notes(_notes(spark, sf_dir))


def noted_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes on limits with the classes whose file they name."""
    s = _t(spark, sf_dir, "supplier")
    nodes = s.select(_s("dao", F.col("s_suppkey") % 20).alias("repo"), _s("dao.D", "@s_suppkey").alias("id"), _s("D", "@s_suppkey").alias("label"), _s("src/D", "@s_suppkey", ".java").alias("file"))
    notes = documents.limit_notes(_notes(spark, sf_dir)).withColumn("note_id", F.col("text"))
    return documents.notes_of_nodes(notes, nodes)


def related_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as domains, named by a type; parts of the same size whose name or type holds its word."""
    p = _t(spark, sf_dir, "part")
    d = p.select(_s("r", "@p_size").alias("repo"), F.col("p_type").alias("name"), F.lit("").alias("summary")).distinct()
    items = p.select(_s("r", "@p_size").alias("repo"), F.lit("symbol").alias("kind"), F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    return documents.related_items(d, items).groupBy("repo", "name").agg(F.count("*").alias("items"), F.max("id").alias("last_id"))


def document_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.document_findings(_notes(spark, sf_dir))


def test_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three test files per part, one that is none, and a file of many cases."""
    # keys are dealt out before files are made of them: a table of one small file would else be read by one task
    p = _t(spark, sf_dir, "part").select("p_partkey").repartition(4 * spark.sparkContext.defaultParallelism)
    repo = _s("t", F.col("p_partkey") % 10)
    py = _files(p, repo, _s("tests/test_a", "@p_partkey", ".py"), _s("def test_a", "@p_partkey", "():\n    pass\n\ndef helper():\n    pass\n"))
    ts = _files(p, repo, _s("src/a", "@p_partkey", ".spec.ts"), _s('describe("part ', "@p_partkey", '", () => {\n  it("works", run);\n  it("works", run);\n});\n'))
    java = _files(p, repo, _s("src/Part", "@p_partkey", "Test.java"), _s("class T {\n  @Test\n  public void sells", "@p_partkey", "() {\n  }\n}\n"))
    no = _files(p, repo, _s("src/b", "@p_partkey", ".ts"), F.lit('it("is no test", run);\n'))
    many = _files(p, repo, _s("spec/m", "@p_partkey", ".py"), F.array_join(F.transform(F.sequence(F.lit(1000), F.lit(1120)), lambda i: F.concat(F.lit("def test_"), i.cast("string"), F.lit("(): pass"))), "\n"))
    c = documents.test_cases(py.unionByName(ts).unionByName(java).unionByName(no).unionByName(many))
    return c.groupBy("repo", "file").agg(F.count("*").alias("cases"), F.min("name").alias("first_name"), F.max("name").alias("last_name"))


def quality_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _t(spark, sf_dir, "supplier")
    npm = _files(s, _s("q", "@s_suppkey"), F.lit("package.json"), F.lit('{"name": "a", "scripts": {"test": "x", "build": "y", "lint:all": "z"}}'))
    nested = _files(s, _s("q", "@s_suppkey"), F.lit("sub/pom.xml"), F.lit("<project/>"))
    tool = _files(s, _s("q", "@s_suppkey"), F.when(F.col("s_suppkey") % 2 == 0, "pom.xml").otherwise("App.sln"), F.lit(""))
    return documents.quality_commands(npm.unionByName(nested).unionByName(tool))


def ai_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as edges of the enrichment where their source is the first; languages stand for evidence."""
    d = _t(spark, sf_dir, "documents")
    e = d.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 2 == 0, "ai-enrichment").otherwise("deterministic-indexer").alias("origin"), F.col("lang").alias("evidence"), F.when(F.col("doc_id") % 3 > 0, F.col("source")).alias("file"), F.col("n_chars").alias("line"))
    return checks.check_ai_evidence(e).select("id")


def required_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market segments that each nation must have."""
    present = _t(spark, sf_dir, "customer").select(_s("n", "@c_nationkey").alias("repo"), F.col("c_mktsegment").alias("path")).distinct()
    repos = _t(spark, sf_dir, "nation").select(_s("n", "@n_nationkey").alias("repo"))
    return checks.check_required(repos, ("FURNITURE", "BUILDING", "NONE"), present, "FILE_MISSING").select("repo", "path", "code")


def declared_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents declare an index of labels; those that have any are present."""
    of = lambda t: _t(spark, sf_dir, t).select(_s("d", "@doc_id").alias("repo"), F.lit("labels").alias("index"))
    return checks.check_declared(of("documents"), of("labels")).withColumnRenamed("index", "index_name")


def unresolved_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, _, _ = _nations(spark, sf_dir)
    meta = _t(spark, sf_dir, "nation").select(_s("n", "@n_nationkey").alias("repo"), (F.col("n_nationkey") % 9).alias("unresolved_count"))
    return checks.check_unresolved(meta, c)


def report_section_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = report_corpus(spark, sf_dir)
    reports = r.select(_s("@repo", "/", "@path").alias("repo"), F.lit("Lite").alias("tier"), "content")
    s = markdown.sections(r).select(_s("@repo", "/", "@path").alias("repo"), "level", "title", "body")
    return checks.check_sections(reports, s, ("Known Issues", "Usage", "Detail", "근거 원장"))


def pattern_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types of a size are candidates; brands that name one are documented; even sizes hold PROMO."""
    p = _t(spark, sf_dir, "part")
    repo = _s("r", "@p_size").alias("repo")
    c = p.select(repo, F.when(F.col("p_size") % 2 == 0, "Lite").otherwise("Full").alias("tier"), F.col("p_type").alias("slug"))
    d = p.filter("p_retailprice > 950").select(repo, F.concat_ws(" ", F.lit("the"), F.lower("p_type"), F.lit("pattern")).alias("title")).distinct()
    return checks.pattern_coverage(c, d, p.filter("p_size % 2 = 0").select(repo, F.lit("PROMO").alias("slug")))


def stale_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files of their customer's index, made at the end of 1997."""
    files = _t(spark, sf_dir, "orders").select(_s("c", "@o_custkey").alias("repo"), F.col("o_orderdate").alias("mtime"))
    meta = _t(spark, sf_dir, "customer").select(_s("c", "@c_custkey").alias("repo"), F.lit("1997-12-31").cast("timestamp").alias("generated_at"))
    return checks.stale(files, meta).select("repo", "stale")


def _graph(spark, sf_dir):
    n, s = _t(spark, sf_dir, "nation"), _t(spark, sf_dir, "supplier")
    nodes = n.select(_s("r", "@n_regionkey").alias("repo"), _s("n", "@n_nationkey").alias("id"))
    calls = n.select(_s("r", "@n_regionkey").alias("repo"), _s("n", "@n_nationkey").alias("from"), _s("n", F.floor(F.col("n_nationkey") / 2)).alias("to"))
    api = s.select(F.lit("web").alias("repo"), _s("s", "@s_suppkey").alias("from"), F.lit("r0").alias("to_repo"), _s("n", "@s_nationkey").alias("to"))
    table = s.select(F.lit("db").alias("repo"), _s("t", "@s_nationkey").alias("from"), _s("t", F.col("s_nationkey")).alias("to"))
    return graph.project_graph(nodes, {"call": calls, "api_contract": api, "table_relation": table})


def project_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir)[1].select(F.col("from").alias("source_id"), F.col("to").alias("target_id"), "type")


def project_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir)[0]


def item_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part").select(F.col("p_brand").alias("repo"), F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("text"))
    s = _t(spark, sf_dir, "supplier").select(_s("n", "@s_nationkey").alias("repo"), F.col("s_suppkey").alias("id"), F.lit(None).cast("string").alias("title"), F.col("s_name").alias("text"))
    return search.search_items({"symbol": p, "table": s})


_QUERIES = (
    stored_statements, statement_uses, statement_joins, method_tables, unused_statements, project_counts, index_summary, index_status, evidence_files, pattern_candidates, all_relations, relation_stats,
    entity_tables, matches_across, backend_drift, partner_contracts, external_owners, contract_status, markdown_documents, document_inventory, glossary_domains, limit_notes, noted_nodes, related_items, document_findings,
    test_cases, quality_commands, ai_evidence, required_files, declared_indexes, unresolved_counts, report_section_checks, pattern_coverage, stale_indexes, project_edges, project_nodes, item_table,
)

_M = "d AS (SELECT s_suppkey AS k, s_nationkey AS n, s_suppkey % 7 AS u, 'db' || (s_suppkey % 20) AS repo FROM supplier)"
_N = "c AS (SELECT 'n' || c_nationkey AS repo FROM customer), s AS (SELECT 'n' || s_nationkey AS repo FROM supplier), n AS (SELECT 'n' || n_nationkey AS repo FROM nation)"
_X = """e AS (SELECT 'sys' || n_regionkey AS system, 'e' || n_nationkey AS id, n_nationkey AS k, CASE WHEN n_nationkey % 3 = 0 THEN 'ANY' ELSE 'GET' END AS method, n_nationkey % 3 <> 2 AS ok FROM nation),
c AS (SELECT 'sys' || n_regionkey AS system, 'web' || (c_custkey % 3) AS repo, 'c' || c_custkey AS id, c_nationkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'POST' ELSE 'GET' END AS method FROM customer JOIN nation ON c_nationkey = n_nationkey),
m AS (SELECT e.system, e.id AS endpoint_id, c.repo AS consumer_repo, c.id AS consumer_id FROM e JOIN c ON e.system = c.system AND e.k = c.k WHERE ok AND (e.method = 'ANY' OR e.method = c.method))"""
_R = "f AS (SELECT s_suppkey AS k, s_nationkey AS n, 'db' || (s_suppkey % 5) AS repo FROM supplier)"
_W = "w AS (SELECT s_suppkey AS k, 'dao' || (s_suppkey % 20) AS repo FROM supplier)"
_P = """x AS (SELECT 'r' || n_regionkey || '::n' || n_nationkey AS source_id, 'r' || n_regionkey || '::n' || (n_nationkey // 2) AS target_id, 'call' AS type FROM nation WHERE n_nationkey <> n_nationkey // 2
UNION SELECT 'web::s' || s_suppkey, 'r0::n' || s_nationkey, 'api_contract' FROM supplier UNION SELECT 'db::t' || s_nationkey, 'db::t' || s_nationkey, 'table_relation' FROM supplier)"""

ORACLE = {
    "stored_statements": f"""WITH {_M} SELECT repo, 'm/D' || k || '.xml' AS file, CAST(2 AS BIGINT) AS line, 'shop.D' || k || '.find' AS id, 'select' AS type, 't' || n || ',u' || u AS table_names,
 'SELECT a.id FROM t' || n || ' a JOIN u' || u || ' AS b ON a.id = b.ref' AS text_preview FROM d
 UNION ALL SELECT repo, 'm/D' || k || '.xml', 5, 'shop.D' || k || '.set', 'update', 't' || n, 'UPDATE t' || n || ' SET x = 1' FROM d
 UNION ALL SELECT repo, 'src/D' || k || '.java', 3, 'src/D' || k || '.java:3:raw', 'delete', 'w' || n, 'DELETE FROM w' || n || ' WHERE id = 1' FROM d""",
    "statement_uses": f"""WITH {_M} SELECT repo, 'src/D' || k || '.java' AS file, CAST(5 AS BIGINT) AS line, 'shop.D' || k || '.find' AS sql_id, 'later' || k AS method FROM d
 UNION ALL SELECT repo, 'm/D' || k || '.xml', 2, 'shop.D' || k || '.find', 'shop.D' || k || '.find' FROM d UNION ALL SELECT repo, 'm/D' || k || '.xml', 5, 'shop.D' || k || '.set', 'shop.D' || k || '.set' FROM d""",
    "statement_joins": f"WITH {_M} SELECT repo, 'shop.D' || k || '.find' AS sql_id, 't' || n AS from_table, 'id' AS from_column, 'u' || u AS to_table, 'ref' AS to_column FROM d",
    "method_tables": f"""WITH {_M}, x AS (SELECT repo, unnest(['later' || k, 'shop.D' || k || '.find']) AS method, 'SHOP.T' || n AS t, 'u' || u AS u FROM d)
 SELECT DISTINCT repo, method, t AS table_name FROM x UNION SELECT repo, method, u FROM x UNION SELECT repo, 'shop.D' || k || '.set', 'SHOP.T' || n FROM d""",
    "unused_statements": f"WITH {_M} SELECT repo, 'src/D' || k || '.java:3:raw' AS id FROM d",
    "project_counts": f"WITH {_N} SELECT repo, (SELECT count(*) FROM c WHERE c.repo = n.repo) AS symbols, (SELECT count(*) FROM s WHERE s.repo = n.repo) AS tables, CAST(1 AS BIGINT) AS endpoints FROM n",
    "index_summary": f"""WITH {_N}, x AS (SELECT repo, 'symbols' AS index_name, 'symbols' AS collection FROM c UNION ALL SELECT repo, 'schema', 'tables' FROM s UNION ALL SELECT repo, 'schema', 'relations' FROM s)
 SELECT repo, index_name, collection, count(*) AS records FROM x GROUP BY GROUPING SETS ((repo), (repo, index_name), (repo, index_name, collection))""",
    "index_status": f"""WITH {_N}, i AS (SELECT unnest(['schema', 'symbols', 'dead_code']) AS index_name) SELECT repo, index_name,
 CASE WHEN index_name = 'schema' AND repo IN (SELECT repo FROM s) THEN 'LOADED' WHEN index_name = 'schema' OR (index_name = 'symbols' AND repo IN (SELECT repo FROM c)) THEN 'MISSING' ELSE 'NO SIGNAL' END AS status FROM n, i""",
    "evidence_files": """WITH x AS (SELECT DISTINCT o_orderpriority AS repo, 'f' || o_custkey AS file FROM orders UNION SELECT p_brand, p_type FROM part), g AS (SELECT repo, list_sort(list(file)) AS l FROM x GROUP BY repo)
 SELECT repo, CAST(len(l) AS BIGINT) AS evidence_files, array_to_string(l[1:50], ',') AS first_files, CAST(greatest(0, len(l) - 50) AS BIGINT) AS truncated FROM g""",
    "pattern_candidates": """WITH x AS (SELECT 'r' || (p_partkey % 5) AS repo, ['controller', 'service', 'data_access', 'common', 'test'][CAST(p_partkey % 5 + 1 AS INTEGER)] AS slug,
 CASE WHEN p_partkey % 5 = 4 THEN 'tests/' ELSE 'src/' END || 'F' || (p_partkey % 150) || '.java' AS file FROM part UNION SELECT 'r' || (s_suppkey % 2), 'data_access', 'm/' || s_suppkey || '.xml' FROM supplier),
 g AS (SELECT repo, slug, list_sort(list(DISTINCT file)) AS l FROM x GROUP BY ALL) SELECT repo, slug, CAST(least(20, len(l)) AS BIGINT) AS signal_count, array_to_string(l[1:20], ',') AS files FROM g""",
    "all_relations": f"""WITH {_R} SELECT DISTINCT repo, 'foreign_key' AS type, 'N' || n AS from_table, 'R' AS to_table, 'id' AS from_columns FROM f UNION SELECT repo, 'query_join', 'n' || n, 'r', 'id' FROM f""",
    "relation_stats": f"""WITH {_R} SELECT repo, count(*) + count(DISTINCT n) + 2 + CASE WHEN max(k) >= 5 THEN 2 ELSE 0 END AS tables, count(*) AS foreign_keys, CAST(0 AS BIGINT) AS orm_mappings, count(*) AS inferred_joins,
 count(*) FILTER (WHERE k >= 5) AS many_to_many, count(*) AS resolved, 2 * count(*) AS relations, CAST(1 AS BIGINT) AS isolated FROM f GROUP BY repo""",
    "entity_tables": """SELECT c_custkey AS k, CASE WHEN c_nationkey % 2 = 0 THEN 't_jpa_' ELSE 't_django_' END || c_nationkey AS from_table,
 CASE WHEN c_custkey % 3 = 0 THEN 'NATION_' WHEN c_nationkey % 2 = 0 THEN 't_jpa_' ELSE 't_django_' END || c_nationkey AS to_table FROM customer""",
    "matches_across": f"WITH {_X} SELECT * FROM m",
    "backend_drift": """WITH d AS (SELECT n_regionkey AS r, n_nationkey AS n, count(*) AS a, count(*) FILTER (WHERE c_acctbal < 0) AS b FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
 g AS (SELECT 'b' || r AS backend, count(*) AS clients, CAST(sum(a) AS BIGINT) AS consumers, CAST(sum(a - b) AS BIGINT) AS matched, CAST(sum(b) AS BIGINT) AS unmatched,
 count(*) FILTER (WHERE n >= 20 AND r IN (SELECT n_regionkey FROM nation WHERE n_nationkey < 20)) AS undeclared FROM d GROUP BY r)
 SELECT *, CASE WHEN clients > 1 THEN 'one-to-many' ELSE 'one-to-one' END AS topology, CASE WHEN unmatched > 0 OR undeclared > 0 THEN 'WARN' ELSE 'PASS' END AS status FROM g""",
    "partner_contracts": """SELECT DISTINCT 'e' || s_nationkey AS id, 'local' AS source, NULL AS partner, 'GET' AS method FROM supplier
 UNION ALL SELECT 'e' || c_nationkey, 'external', min(c_mktsegment), 'POST' FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier) GROUP BY c_nationkey""",
    "external_owners": "SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'api' WHEN c_nationkey < 20 THEN 'w' || c_nationkey ELSE 'w0' END AS owner FROM customer",
    "contract_status": f"""WITH {_X}, a AS (SELECT DISTINCT system, (SELECT count(*) FROM c WHERE c.system = e.system) AS calls, (SELECT count(*) FROM m WHERE m.system = e.system) AS edges,
 (SELECT count(*) FROM c WHERE c.system = e.system AND (c.system, c.id) NOT IN (SELECT (system, consumer_id) FROM m)) AS lost FROM e),
 p AS (SELECT 'sys' || n_regionkey AS system, CASE WHEN bool_or(n_nationkey = 7) THEN 'PARTIAL' WHEN bool_or(n_nationkey = 8) THEN 'UNKNOWN' ELSE 'FULL' END AS coverage_status FROM nation GROUP BY n_regionkey),
 s AS (SELECT system, coverage_status, CASE WHEN calls > 0 AND edges > 0 AND lost = 0 THEN 'PASS' ELSE 'WARN' END AS contract_status FROM p JOIN a USING (system))
 SELECT *, CASE WHEN contract_status = 'WARN' OR coverage_status = 'PARTIAL' THEN 'WARN' ELSE 'PASS' END AS overall_status FROM s""",
    "markdown_documents": f"WITH {_W} SELECT repo, 'docs/r' || k || '.md' AS path, 'Report' AS title, 'Project documents' AS category, 'docs-r' || k || '-' || sha1(repo || chr(0) || 'docs/r' || k || '.md')[1:10] AS slug FROM w",
    "document_inventory": f"""WITH {_W}, g AS (SELECT repo, unnest(['Project documents', 'API']) AS category, unnest(['docs/r', 'docs/api/n']) AS p, list(CAST(k AS VARCHAR)) AS l FROM w GROUP BY repo)
 SELECT repo, category, CAST(len(l) AS BIGINT) AS documents, array_to_string(list_sort(list_transform(l, lambda x: p || x || '.md'))[1:5], ',') AS paths FROM g""",
    "glossary_domains": f"""WITH {_W} SELECT repo, 'Supplier' || k AS name, repo || '-supplier' || k AS slug FROM w UNION SELECT repo, 'Ledger', repo || '-ledger' FROM w
 UNION SELECT repo, 'Stock of goods', repo || '-stock-of-goods' FROM w UNION SELECT repo, '분석', repo || '-분석' FROM w UNION SELECT repo, 'Glossary', repo || '-glossary' FROM w""",
    "limit_notes": f"""WITH {_W} SELECT repo, '분석' AS title, 'The call graph of src/D' || k || '.java 누락 is likely.' AS text FROM w
 UNION SELECT repo, '분석', 'dead code 위험 in it password:' || CASE WHEN k % 2 = 0 THEN ' hunter2hunter2' ELSE '' END FROM w""",
    "noted_nodes": f"WITH {_W} SELECT repo, 'The call graph of src/D' || k || '.java 누락 is likely.' AS note_id, 'dao.D' || k AS node_id FROM w",
    "related_items": """WITH d AS (SELECT DISTINCT p_size, p_type FROM part) SELECT 'r' || p_size AS repo, d.p_type AS name, count(*) AS items, max(p_partkey) AS last_id FROM
 (SELECT d.p_size, d.p_type, p.p_partkey FROM d JOIN part p ON d.p_size = p.p_size AND contains(lower(p.p_name || ' ' || p.p_type), lower(d.p_type)) QUALIFY row_number() OVER (PARTITION BY d.p_size, d.p_type ORDER BY p.p_partkey) <= 100) d GROUP BY ALL""",
    "document_findings": f"WITH {_W} SELECT repo, 'docs/api/n' || k || '.md' AS path, false AS placeholder, true AS secret FROM w WHERE k % 2 = 0",
    "test_cases": """WITH p AS (SELECT p_partkey AS k, 't' || (p_partkey % 10) AS repo FROM part) SELECT repo, 'tests/test_a' || k || '.py' AS file, CAST(1 AS BIGINT) AS cases, 'test_a' || k AS first_name, 'test_a' || k AS last_name FROM p
 UNION ALL SELECT repo, 'src/a' || k || '.spec.ts', 2, 'part ' || k, 'works' FROM p UNION ALL SELECT repo, 'src/Part' || k || 'Test.java', 1, 'sells' || k, 'sells' || k FROM p
 UNION ALL SELECT repo, 'spec/m' || k || '.py', 100, 'test_1000', 'test_1099' FROM p""",
    "quality_commands": """SELECT 'q' || s_suppkey AS repo, unnest(['npm test', 'npm run lint:all', CASE WHEN s_suppkey % 2 = 0 THEN 'mvn test' ELSE 'dotnet test' END]) AS command FROM supplier""",
    "ai_evidence": "SELECT doc_id AS id FROM documents WHERE doc_id % 2 = 0 AND (coalesce(trim(lang), '') = '' OR doc_id % 3 = 0 OR coalesce(trim(source), '') = '' OR n_chars IS NULL)",
    "required_files": """SELECT 'n' || n_nationkey AS repo, path, 'FILE_MISSING' AS code FROM nation, (SELECT unnest(['FURNITURE', 'BUILDING', 'NONE']) AS path)
 WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_mktsegment = path)""",
    "declared_indexes": "SELECT DISTINCT 'd' || doc_id AS repo, 'labels' AS index_name FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)",
    "unresolved_counts": f"WITH {_N}, x AS (SELECT n_nationkey AS k, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS found FROM nation) SELECT 'n' || k AS repo, CAST(k % 9 AS BIGINT) AS said, found FROM x WHERE k % 9 <> found",
    "report_section_checks": f"""WITH {_W} SELECT repo || '/docs/r' || k || '.md' AS repo, unnest(['ANALYZER_SECTION', 'ANALYZER_SECTION', 'ANALYZER_LANGUAGE', 'ANALYZER_DETAIL']) AS code, unnest(['Detail', '근거 원장', NULL, NULL]) AS what FROM w""",
    "pattern_coverage": """WITH c AS (SELECT DISTINCT p_size AS s, p_type AS t FROM part), d AS (SELECT DISTINCT p_size AS s, p_type AS t FROM part WHERE p_retailprice > 950),
 h AS (SELECT s, t FROM c WHERE s % 2 = 0 AND t = 'PROMO' AND (s, t) NOT IN (SELECT (s, t) FROM d)),
 g AS (SELECT s, count(*) AS n, (SELECT count(*) FROM d WHERE d.s = c.s) + (SELECT count(*) FROM h WHERE h.s = c.s) AS satisfied FROM c GROUP BY s)
 SELECT 'r' || s AS repo, CASE WHEN n > 1 AND s % 2 = 0 THEN CAST(2 AS BIGINT) ELSE n END AS required, satisfied, (n = 1 OR satisfied >= CASE WHEN s % 2 = 0 THEN 2 ELSE n END) AS enough FROM g""",
    "stale_indexes": "SELECT 'c' || c_custkey AS repo, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate > TIMESTAMP '1997-12-31') AS stale FROM customer",
    "project_edges": f"WITH {_P} SELECT * FROM x",
    "project_nodes": f"""WITH {_P}, n AS (SELECT 'r' || n_regionkey || '::n' || n_nationkey AS id FROM nation) SELECT id, id IN (SELECT id FROM n) AS known FROM (SELECT id FROM n UNION SELECT source_id FROM x UNION SELECT target_id FROM x)""",
    "item_table": """SELECT 'symbol' AS kind, 'symbol:' || p_brand || '::' || p_partkey AS id, p_brand AS repo, p_name AS title, p_type AS text FROM part
 UNION ALL SELECT 'table', 'table:n' || s_nationkey || '::' || s_suppkey, 'n' || s_nationkey, CAST(s_suppkey AS VARCHAR), s_name FROM supplier""",
}


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict:
    return dict(ORACLE)
