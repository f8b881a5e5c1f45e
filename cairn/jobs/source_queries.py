"""Queries over source trees, stored indexes, transactions, external calls, environments and JSON documents, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import checks, dedupe, documents, facts, statistics, symbols
from ..sources import index
from ..sources.corpus import dao_corpus, in_scope, read_source_tree, report_corpus
from ..sources.tables import shared_folder, written


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _key(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def source_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as JSON files of one repo, in a source folder and in skipped ones, and as text; read back: lines in scope by nation."""
    root = f"{shared_folder(spark)}/tree"
    c = _t(spark, sf_dir, "customer").withColumn("n", _key("", "c_nationkey"))
    for rest, folder in enumerate(("node_modules", "build", "src")):
        c.filter(F.least(F.col("c_custkey") % 5, F.lit(2)) == rest).select("n", "c_custkey", "c_name").repartition("n").write.partitionBy("n").json(f"{root}/shop/{folder}")
    c.select("n", "c_name").repartition("n").write.partitionBy("n").text(f"{root}/shop/notes")
    files = read_source_tree(spark, root)
    line = files.select("repo", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"), F.explode(F.filter(F.split("content", "\n"), lambda x: x != "")).alias("l"))
    return line.groupBy("repo", "folder").agg(F.count("*").alias("lines"), F.sum(F.get_json_object("l", "$.c_custkey").cast("long")).alias("keys"))


def scoped_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of documents under the include paths of their source, where it has any."""
    i = F.col("doc_id")
    path = F.element_at(F.array(*map(F.lit, ("src/a/x.java", "src/ab/y.py", "lib/z.ts", "vendor/v.go", "lib/big.sql", "pom.xml", "img/p.png", "lib/deep/q.VUE"))), (i % 8 + 1).cast("int"))
    f = _t(spark, sf_dir, "documents").select(F.col("source").alias("repo"), path.alias("path"), F.when(i % 8 == 4, (4 << 20) + 1).otherwise(10).cast("long").alias("size"), "doc_id")
    include = f.select("repo").distinct().filter("repo in ('src1', 'src2')").select("repo", F.explode(F.array(F.lit("./src/a/"), F.when(F.col("repo") == "src1", "lib").otherwise("../no"))).alias("path"))
    return in_scope(f, include).select("doc_id", "repo", "path")


def index_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of a corpus of which an older state is stored: changed files are analyzed anew, repos that vanished and repos without statements go. Equal to what a full rebuild gives."""
    now = in_scope(dao_corpus(spark, sf_dir))
    k = F.regexp_extract("path", r"(\d+)", 1).cast("long")
    analyze = lambda files: facts.extract_statements(files).select("repo", "file", "line", "type", F.array_join("tables", ",").alias("tables"))
    gone = now.filter("repo = 'dao3'").withColumn("repo", F.lit("gone"))
    then = now.withColumn("content", F.when(k % 4 == 0, F.replace("content", F.lit("SELECT"), F.lit("DELETE"))).otherwise(F.col("content"))).filter(k % 7 != 0).unionByName(gone)
    root = f"{shared_folder(spark)}/index"
    index.write_index({"statements": analyze(then), "files": then.select("repo", F.col("path").alias("file"), F.sha2(F.col("content"), 256).alias("hash"))}, root)
    old = index.read_index(spark, root, "files").select("repo", F.col("file").alias("path"), "hash", F.lit("1").alias("indexer_version"), F.lit("c").alias("config_hash"))
    # one repo's statements are all commented out by now
    now = now.withColumn("content", F.when(F.col("repo") == "dao5", F.regexp_replace("content", "(?m)^  @Query", "  // @Query")).otherwise(F.col("content")))
    status = written(dedupe.file_status(now, old, "1", "c"))
    changed = status.filter("status <> 'reused'").select("repo").distinct()
    fresh = analyze(now.join(status.filter("status = 'analyze'").select("repo", "path"), ["repo", "path"], "left_semi"))
    stored = index.read_index(spark, root, "statements").select("repo", "file", "line", "type", "tables")
    index.commit({"statements": index.refresh(stored, status, fresh)}, root, changed, now.select("repo").distinct())
    return index.read_index(spark, root, "statements").select("repo", "file", F.col("line").cast("long").alias("line"), "type", "tables")


def stored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as items of a JSON document per nation, written and read back."""
    root = f"{shared_folder(spark)}/documents"
    s = _t(spark, sf_dir, "supplier").groupBy(_key("n", "s_nationkey").alias("repo")).agg(F.collect_list(F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))).alias("tables"))
    s.repartition("repo").write.partitionBy("repo").json(root)
    item = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])
    return index.read_documents(spark, root, "tables", item).select("repo", "id", "name")


def quality_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports, of which those of every third supplier are on tests."""
    r = report_corpus(spark, sf_dir)
    k = F.regexp_extract("path", r"(\d+)", 1).cast("long")
    d = documents.markdown_documents(r.withColumn("path", F.when(k % 3 == 0, F.replace("path", F.lit("docs/"), F.lit("docs/test-"))).when(k % 3 == 1, F.replace("path", F.lit("docs/"), F.lit(".claude/patterns/test-"))).otherwise(F.col("path"))))
    return documents.quality_reports(d).select("repo", "path", "category", "origin")


def plain_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as remarks in two languages: their texts are blanked, code, literals and line ends stay."""
    d = _t(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    line = F.regexp_replace(F.translate("t", "\n\r", ""), r"\*/", "")
    text = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('a = "#";\n# '), line, F.lit("\nb"))).otherwise(F.concat(F.lit('a = "//"; /* '), line, F.lit("\n*/ b // "), line))
    ext = F.when(F.col("doc_id") % 2 == 0, "py").otherwise("java")
    clean = symbols.without_comments(text, ext)
    return d.select("doc_id", F.length(clean).cast("long").alias("chars"), F.array_join(F.filter(F.split(clean, r"\s+"), lambda w: w != ""), " ").alias("left"))


#: Code per part, of a kind that follows from its key; # is the key.
CODE = (
    ("src/T#.java", 'class T# {\n  @Transactional(\n    isolation = Isolation.SERIALIZABLE,\n    propagation = Propagation.NESTED\n  )\n  public void put#() {\n    Files.readString(p);\n  }\n  @KafkaListener(topics = "t#")\n  void hear#() {\n  }\n}\n'),
    ("src/t#.ts", "// axios in a remark\nasync function go#() {\n  await prisma.$transaction(work);\n}\nfunction send#() {\n  axios.post('/x');\n}\n"),
    ("src/t#.py", "import requests\n\ndef save#():\n    session.begin()\n    open('f')\n\ndef last#():\n    pass\n"),
    ("conf/application-p#.yml", "a: b\n"),
    ("src/P#.java", '@Profile("q#")\nclass P# {\n  @ConditionalOnProperty(name = "x.#")\n  Bean one() {\n    return System.getenv("HOME#");\n  }\n}\n'),
)


def _code(spark, sf_dir):
    k = F.col("p_partkey")
    text = k.cast("string")
    at = lambda i: F.replace(F.get(F.array(*(F.lit(c[i]) for c in CODE)), (k % len(CODE)).cast("int")), F.lit("#"), text)
    return _t(spark, sf_dir, "part").select(F.concat(F.lit("r"), (k % 20).cast("string")).alias("repo"), at(0).alias("path"), at(1).alias("content"))


def transaction_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = facts.extract_transactions(_code(spark, sf_dir))
    return x.select("repo", "file", F.col("line").cast("long").alias("line"), "marker", "entry_method", "propagation", "isolation")


def external_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = facts.extract_external(_code(spark, sf_dir))
    return x.select("repo", "file", F.col("line").cast("long").alias("line"), "type", "method", "target")


def environment_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = facts.environment_branches(_code(spark, sf_dir))
    return x.select("repo", "file", F.col("line").cast("long").alias("line"), "type", "marker")


def environment_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.profiles(facts.environment_branches(_code(spark, sf_dir)))


RULES = {
    "type": "object", "required": ["k", "tags"],
    "properties": {"k": {"type": "integer", "minimum": 10}, "tags": {"type": "array", "items": {"type": "object", "required": ["n"], "properties": {"n": {"type": "string", "enum": ["a", "b"]}}}}, "v": {"type": ["number", "null"]}},
}


def document_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON documents with values of wrong types, missing fields and nested items that break rules, by their key."""
    i = F.col("event_id")
    k = F.when(i % 7 == 0, F.lit('"x"')).when(i % 7 == 1, F.lit("5")).otherwise(F.lit("12"))
    tags = F.when(i % 5 == 0, F.lit('[{"n":"a"},{"n":"c"},{}]')).when(i % 5 == 1, F.lit('["a"]')).when(i % 5 == 2, F.lit('{"n":"a"}')).otherwise(F.lit('[{"n":"b"}]'))
    v = F.when(i % 3 == 0, F.lit("null")).when(i % 3 == 1, F.lit("1.5")).otherwise(F.lit("true"))
    text = F.when(i % 11 == 0, F.lit("{no")).when(i % 11 == 1, F.concat(F.lit('{"k":'), k, F.lit("}"))).otherwise(F.concat(F.lit('{"k":'), k, F.lit(',"tags":'), tags, F.lit(',"v":'), v, F.lit("}")))
    return checks.check_documents(_t(spark, sf_dir, "events").select("event_id", text.alias("doc")), ["event_id"], "doc", RULES)


_QUERIES = (
    source_tree, scoped_files, index_refresh, stored_documents, quality_documents, plain_sources, transaction_marks, external_uses, environment_branches, environment_profiles, document_violations,
)

_P = "p AS (SELECT p_partkey AS k, 'r' || (p_partkey % 20) AS repo, p_partkey % 5 AS c FROM part)"
ORACLE = {
    "source_tree": "SELECT 'shop' AS repo, 'src/n=' || c_nationkey AS folder, count(*) AS lines, CAST(sum(c_custkey) AS BIGINT) AS keys FROM customer WHERE c_custkey % 5 > 1 GROUP BY c_nationkey",
    "scoped_files": """WITH f AS (SELECT doc_id, source AS repo, ['src/a/x.java', 'src/ab/y.py', 'lib/z.ts', 'vendor/v.go', 'lib/big.sql', 'pom.xml', 'img/p.png', 'lib/deep/q.VUE'][doc_id % 8 + 1] AS path FROM documents WHERE doc_id % 8 NOT IN (3, 4, 6))
 SELECT * FROM f WHERE repo NOT IN ('src1', 'src2') OR path LIKE 'src/a/%' OR (repo = 'src1' AND path LIKE 'lib/%')""",
    "index_refresh": """WITH d AS (SELECT s_suppkey AS k, s_nationkey AS n, 'dao' || (s_suppkey % 20) AS repo, 'src/D' || s_suppkey || '.java' AS file FROM supplier)
 SELECT repo, file, CAST(3 AS BIGINT) AS line, 'SELECT' AS type, 't' || n || ',u' || (k % 7) AS tables FROM d WHERE repo <> 'dao5'""",
    "stored_documents": "SELECT 'n' || s_nationkey AS repo, s_suppkey AS id, s_name AS name FROM supplier",
    "quality_documents": "SELECT 'dao' || (s_suppkey % 20) AS repo, 'docs/test-r' || s_suppkey || '.md' AS path, 'Project documents' AS category, 'source' AS origin FROM supplier WHERE s_suppkey % 3 = 0",
    "plain_sources": r"""WITH d AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '[\n\r]', '', 'g'), '\*/', '', 'g') AS t FROM documents)
 SELECT doc_id, CAST(CASE WHEN doc_id % 2 = 0 THEN length(t) + 13 ELSE 2 * length(t) + 22 END AS BIGINT) AS chars, CASE WHEN doc_id % 2 = 0 THEN 'a = "#"; b' ELSE 'a = "//"; b' END AS left FROM d""",
    "transaction_marks": f"""WITH {_P} SELECT repo, 'src/T' || k || '.java' AS file, CAST(2 AS BIGINT) AS line, '@Transactional' AS marker, 'put' || k AS entry_method, 'NESTED' AS propagation, 'SERIALIZABLE' AS isolation FROM p WHERE c = 0
 UNION ALL SELECT repo, 'src/t' || k || '.ts', 3, 'prisma.$transaction', 'send' || k, 'REQUIRED', NULL FROM p WHERE c = 1 UNION ALL SELECT repo, 'src/t' || k || '.py', 4, 'session.begin', 'last' || k, 'REQUIRED', NULL FROM p WHERE c = 2""",
    "external_uses": f"""WITH {_P} SELECT repo, 'src/T' || k || '.java' AS file, CAST(7 AS BIGINT) AS line, 'file_io' AS type, 'hear' || k AS method, NULL AS target FROM p WHERE c = 0 UNION ALL SELECT repo, 'src/T' || k || '.java', 9, 'kafka_consumer', 'hear' || k, 't' || k FROM p WHERE c = 0
 UNION ALL SELECT repo, 'src/t' || k || '.ts', 6, 'http', NULL, NULL FROM p WHERE c = 1 UNION ALL SELECT repo, 'src/t' || k || '.py', 1, 'http', 'save' || k, NULL FROM p WHERE c = 2 UNION ALL SELECT repo, 'src/t' || k || '.py', 5, 'file_io', 'last' || k, NULL FROM p WHERE c = 2""",
    "environment_branches": f"""WITH {_P} SELECT repo, 'conf/application-p' || k || '.yml' AS file, CAST(1 AS BIGINT) AS line, 'config_file' AS type, 'p' || k AS marker FROM p WHERE c = 3 UNION ALL SELECT repo, 'src/P' || k || '.java', 1, 'annotation', '@Profile("q' || k || '")' FROM p WHERE c = 4
 UNION ALL SELECT repo, 'src/P' || k || '.java', 3, 'annotation', '@ConditionalOnProperty(name = "x.' || k || '")' FROM p WHERE c = 4 UNION ALL SELECT repo, 'src/P' || k || '.java', 5, 'code_if', 'HOME' || k FROM p WHERE c = 4""",
    "environment_profiles": f"WITH {_P} SELECT repo, 'p' || k AS profile FROM p WHERE c = 3 UNION SELECT repo, 'q' || k FROM p WHERE c = 4",
    "document_violations": """WITH e AS (SELECT event_id, event_id % 7 AS a, event_id % 5 AS b, event_id % 3 AS c, event_id % 11 AS d FROM events)
 SELECT event_id, '$' AS path, 'invalid' AS rule FROM e WHERE d = 0 UNION ALL SELECT event_id, '$.k', CASE WHEN a = 0 THEN 'type' ELSE 'minimum' END FROM e WHERE d > 0 AND a < 2 UNION ALL SELECT event_id, '$.tags', 'required' FROM e WHERE d = 1
 UNION ALL SELECT event_id, '$.tags[1].n', 'enum' FROM e WHERE d > 1 AND b = 0 UNION ALL SELECT event_id, '$.tags[2].n', 'required' FROM e WHERE d > 1 AND b = 0 UNION ALL SELECT event_id, '$.tags[0]', 'type' FROM e WHERE d > 1 AND b = 1
 UNION ALL SELECT event_id, '$.tags', 'type' FROM e WHERE d > 1 AND b = 2 UNION ALL SELECT event_id, '$.v', 'type' FROM e WHERE d > 1 AND c = 2""",
}


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict:
    return dict(ORACLE)
