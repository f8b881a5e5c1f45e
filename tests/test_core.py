"""Core operators on small hand-made tables."""

from pyspark.sql import functions as F

from cairn.functions.text import normalize_path
from cairn.operators import contracts, dedupe, facts, graph, relations, web


def test_paths(spark):
    df = spark.createDataFrame([("a//b/${x}/",), ("/a/:id",), ("",), ("/u/{id}/[k]",)], "p string").select(normalize_path(F.col("p")).alias("n"))
    assert [r.n for r in df.collect()] == ["/a/b/{param}", "/a/{param}", "/", "/u/{param}/{param}"]


def test_calls_do_not_cross_repositories(spark):
    nodes = spark.createDataFrame([("a", "x.One.run"), ("a", "x.Two.run"), ("b", "y.Go.stop"), ("a", "x.One.run")], "repo string, id string")
    calls = spark.createDataFrame([("a", "c", "run", "one"), ("a", "c", "run", None), ("a", "c", "stop", None), ("b", "y.Go.stop", "stop", None), ("b", "c", "stop", "zz")], "repo string, caller string, name string, qualifier string")
    got = sorted((r.repo, r.qualifier or "", r.kind, r.target or "", r.confidence) for r in graph.resolve_calls(calls, graph.candidate_index(nodes)).collect())
    assert got == [("a", "", "ambiguous", "", "LOW"), ("a", "one", "edge", "x.One.run", "HIGH"), ("b", "zz", "edge", "y.Go.stop", "HIGH")]


def test_drift(spark):
    files = spark.createDataFrame(
        [("api", "C.java", '@RequestMapping("/v1")\nclass C {\n @PostMapping("/o/{id}")\n void f() {}\n}'), ("web", "a.ts", "axios.post(`/v1/o/${id}`)"), ("app", "b.ts", 'fetch("/gone")')], "repo string, path string, content string"
    )
    e, c = web.endpoints(files), web.consumers(files)
    m = contracts.match_api(e, c)
    assert m.count() == 1 and {(r.repo, r.status) for r in contracts.api_drift(c, m).collect()} == {("web", "PASS"), ("app", "WARN")}


def test_refresh(spark):
    files = spark.createDataFrame([("r", "a", "1"), ("r", "b", "2"), ("r", "c", "3")], "repo string, path string, content string")
    old = files.select("repo", "path", F.sha2("content", 256).alias("hash"), F.lit("1").alias("indexer_version"), F.lit("c").alias("config_hash"))
    assert dedupe.refresh_counts(dedupe.file_status(files, old, "1", "c")).first()["analyzed"] == 0
    assert dedupe.refresh_counts(dedupe.file_status(files, old, "2", "c")).first()["analyzed"] == 3


def test_cardinality(spark):
    sql = "create table p (id int primary key, x decimal(3, 2));\nCREATE TABLE c (id INT PRIMARY KEY REFERENCES p(id), o INT REFERENCES p(id));"
    rel = relations.relations(relations.columns(relations.extract_ddl(spark.createDataFrame([("r", "a.sql", sql)], "repo string, path string, content string"))))
    assert sorted((r.from_column, r.cardinality) for r in rel.collect()) == [("id", "1:1"), ("o", "N:1")]


def test_sql_tables(spark):
    df = spark.createDataFrame([("select * from a x, b y where x.i = y.i",), ("insert into s.t values (1)",), ("update q set v = 1",), ("nothing",), (None,)], "s string")
    assert [r.t for r in df.select(facts.sql_tables(F.col("s")).alias("t")).collect()] == [["a", "b"], ["s.t"], ["q"], [], None]


def test_transactions_take_the_next_method_of_their_file(spark):
    files = spark.createDataFrame(
        [("r", "A.java", "@Transactional\npublic void one() {\n return two();\n}\n@Transactional\n"), ("r", "B.java", "void other() {\n}"), ("r", "C.java", None)], "repo string, path string, content string"
    )
    assert [(r.file, r.line, r.entry_method, r.propagation) for r in facts.extract_transactions(files).collect()] == [("A.java", 1, "one", "REQUIRED")]
