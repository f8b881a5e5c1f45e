"""Source trees, stored indexes, statements and marks of code, and nested checks on small hand-made inputs."""

import pytest
from pyspark.sql import functions as F

from cairn.operators import checks, dedupe, facts, inventory
from cairn.sources import index
from cairn.sources.corpus import in_scope, listing, read_source_tree

from .test_project import FILES, rows


def test_source_tree(spark, tmp_path):
    for name, text in {
        "r/src/A.java": "class A {}", "r/src/b.txt": "no", "r/node_modules/x.js": "no", "r/pom.xml": "<p/>", "r/deep/er/C.KT": "é", "q/go.mod": "m", "q/build": "a file of that name", "r/src/big.sql": "x" * (4 * 1024 * 1024 + 1), "q/empty.py": "", "q/.git/h.py": "no",
    }.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = read_source_tree(spark, str(tmp_path))
    assert rows(got, "repo", "path", "size", "content") == [("q", "go.mod", 1, "m"), ("r", "deep/er/C.KT", 2, "é"), ("r", "pom.xml", 4, "<p/>"), ("r", "src/A.java", 10, "class A {}")]
    assert listing(spark, str(tmp_path)).count() == 8 and "content" not in listing(spark, str(tmp_path)).columns
    (tmp_path / "none" / "x").mkdir(parents=True)
    assert read_source_tree(spark, str(tmp_path / "none")).count() == 0


def test_scope(spark):
    f = spark.createDataFrame([("r", p, s) for p, s in (("a/b.py", 1), ("a/c/b.ts", 1), ("ab/c.py", 1), ("a.bin", 1), ("dist/a.py", 1), ("a/dist", 1), ("big.py", 1 << 30), ("Cargo.toml", 1))] + [("q", "z.go", 1)], "repo string, path string, size long")
    assert rows(in_scope(f), "path") == [(p,) for p in ("Cargo.toml", "a/b.py", "a/c/b.ts", "ab/c.py", "z.go")]
    for include, want in ((["./a/"], ["a/b.py", "a/c/b.ts", "z.go"]), (["."], ["Cargo.toml", "a/b.py", "a/c/b.ts", "ab/c.py", "z.go"]), (["../x", "a/c"], ["a/c/b.ts", "z.go"])):
        assert rows(in_scope(f, spark.createDataFrame([("r", p) for p in include], "repo string, path string")), "path") == [(p,) for p in want]


def test_index_versions(spark, tmp_path):
    path, t = str(tmp_path / "i"), lambda *r: spark.createDataFrame(r, "repo string, n int")
    repos = lambda *r: spark.createDataFrame([(x,) for x in r], "repo string")
    empty = spark.createDataFrame([], "repo string, n int")
    assert index.version(spark, path) == 0 and index.manifest(spark, path).count() == 0
    index.commit({"a": t(("x", 1), ("y", 2), ("z", 3)), "b": t(("x", 9))}, path, repos("x", "y", "z"))
    # x is renewed and has no b any more; z has vanished; y stays
    index.commit({"a": t(("x", 5), ("y", 7)), "b": empty}, path, repos("x"), repos("x", "y"))
    assert rows(index.read_index(spark, path, "a"), "repo", "n") == [("x", 5), ("y", 2)]
    with pytest.raises(FileNotFoundError):
        index.read_index(spark, path, "b")
    assert rows(index.read_index(spark, path, "a", at=1), "repo", "n") == [("x", 1), ("y", 2), ("z", 3)] and rows(index.read_index(spark, path, "b", at=1), "n") == [(9,)]
    # a commit that broke off before its manifest was whole is not seen
    (tmp_path / "i" / "_manifest" / "v3").mkdir()
    assert index.version(spark, path) == 2
    assert index.commit({"a": t(("w", 1))}, path, repos("w")) == 3 and rows(index.read_index(spark, path, "a"), "repo") == [("w",), ("x",), ("y",)]
    assert index.vacuum(spark, path) == ["_manifest/v1", "_manifest/v2", "b/v1", "b/v2"]
    assert rows(index.read_index(spark, path, "a"), "repo") == [("w",), ("x",), ("y",)]


def test_refresh_equals_rebuild(spark):
    analyze = lambda f: f.select("repo", F.col("path").alias("file"), F.length("content").alias("n"))
    then = spark.createDataFrame([("r", "a", "1"), ("r", "b", "22"), ("r", "gone", "3")], FILES)
    now = spark.createDataFrame([("r", "a", "1"), ("r", "b", "222"), ("r", "new", "")], FILES)
    old = then.select("repo", "path", F.sha2("content", 256).alias("hash"), F.lit("1").alias("indexer_version"), F.lit("c").alias("config_hash"))
    status = dedupe.file_status(now, old, "1", "c")
    fresh = analyze(now.join(status.filter("status = 'analyze'"), ["repo", "path"], "left_semi"))
    assert rows(index.refresh(analyze(then), status, fresh), "file", "n") == rows(analyze(now), "file", "n")


def test_statements_of_annotations(spark):
    java = (
        '@Query("select a from t1")\nvoid a();\n@Select(\n  "SELECT b "\n  + "FROM t2 WHERE x = \\"y\\""\n)\nvoid b();\n@Query(value = """\n  delete from\n  t3\n""", nativeQuery = true)\nvoid c();\n// @Query("select no from no")\n@Query(name = "named")\nvoid d();\n@Update(\'update t4 set a = 1\')\nvoid e();\n@Query\nvoid f();\n@Query(nativeQuery = true, value = "select 1 from t5")\nvoid g();\n'
    )
    s = facts.extract_statements(spark.createDataFrame([("r", "A.java", java), ("r", "b.py", '@Query("select 1 from x")\n'), ("r", "n.java", None)], FILES))
    assert rows(s, "line", "type", "tables") == [(1, "SELECT", ["t1"]), (3, "SELECT", ["t2"]), (8, "DELETE", ["t3"]), (16, "UPDATE", ["t4"]), (20, "SELECT", ["t5"])]


def test_marks(spark):
    f = spark.createDataFrame([
        ("r", "A.java", '@Transactional(isolation = Isolation.READ_COMMITTED)\nclass X {\n  // KafkaTemplate\n  @RabbitListener(queues = "q")\n  void a() { new FileOutputStream(x); Files.write(p); }\n  private RestTemplate http;\n  void b() {}\n}\n@Transactional\n'),
        ("r", "src/application-dev.yml", ""), ("r", "application.yml", ""), ("r", "b.ts", "const x = process.env.HOME;\nfunction f() { redis.createClient(); }\n"), ("r", "n.java", None),
    ], FILES)
    assert rows(facts.extract_transactions(f).fillna(""), "line", "marker", "entry_method", "propagation", "isolation") == [(1, "@Transactional", "a", "REQUIRED", "READ_COMMITTED")]
    assert rows(facts.extract_external(f).fillna(""), "file", "line", "type", "method", "target") == [
        ("A.java", 4, "rabbit", "a", "q"), ("A.java", 5, "file_io", "a", ""), ("A.java", 6, "http", "b", ""), ("b.ts", 2, "redis", "f", ""),
    ]
    assert rows(facts.environment_branches(f).fillna(""), "file", "type", "marker", "profile") == [("b.ts", "code_if", "HOME", ""), ("src/application-dev.yml", "config_file", "dev", "dev")]


def test_nested_rules(spark):
    rules = {"type": "object", "required": ["a", "b"], "properties": {"a": {"type": ["integer", "null"], "minimum": 1}, "b": {"type": "array", "items": {"type": "array", "items": {"enum": ["x", 2]}}}, "c": {"type": "object", "properties": {"d": {"type": "boolean"}}}, "e": {"type": "number"}}}
    docs = ['{"a":1,"b":[],"e":1}', '{"a":0,"b":[["x",2],["y"],[],3],"c":{"d":"true"},"e":1.5}', '{"a":null,"b":null,"c":[]}', "[]", "7", "nope", None, '{"a":1.5}', '{"a":2.0,"b":[]}', "{}"]
    got = checks.check_documents(spark.createDataFrame(list(enumerate(docs)), "i int, doc string"), ["i"], "doc", rules)
    assert rows(got, "i", "path", "rule") == [
        (1, "$.a", "minimum"), (1, "$.b[1][0]", "enum"), (1, "$.b[3]", "type"), (1, "$.c.d", "type"), (2, "$.b", "type"), (2, "$.c", "type"), (3, "$", "type"), (4, "$", "type"), (5, "$", "invalid"), (6, "$", "invalid"),
        (7, "$.a", "type"), (7, "$.b", "required"), (9, "$.a", "required"), (9, "$.b", "required"),
    ]


def test_references_to_other_repos(spark):
    docs = spark.createDataFrame([("r", "d.md", "see lib::a.ts:2 and a.ts:1, lib::a.ts:9 x::b.ts:1")], FILES)
    files = spark.createDataFrame([("lib", "a.ts", "1\n2\n3"), ("r", "a.ts", "1")], FILES)
    got = checks.check_line_references(checks.source_references(docs), files)
    assert rows(got, "file", "line", "status") == [("a.ts", 1, "OK"), ("lib::a.ts", 2, "OK"), ("lib::a.ts", 9, "OUT_OF_RANGE"), ("x::b.ts", 1, "MISSING")]


def test_coverage(spark):
    f = spark.createDataFrame([("r", p) for p in ("a.py", "b.py", "c.ts", "d.rpt", "Makefile")] + [("q", "a.py")], "repo string, path string")
    e = spark.createDataFrame([("r", "a.py", "flask"), ("r", "c.ts", "django")], "repo string, file string, framework string")
    assert rows(inventory.adapter_extensions(f, e), "repo", "extension", "level", "files") == [("q", "py", "FULL", 1), ("r", "Makefile", "PARTIAL", 1), ("r", "py", "PARTIAL", 2), ("r", "rpt", "UNSUPPORTED", 1), ("r", "ts", "FULL", 1)]
    assert rows(inventory.adapter_coverage(f, e), "repo", "full_files", "partial_files", "unsupported_files", "status") == [("q", 1, 0, 0, "FULL"), ("r", 1, 3, 1, "WARN")]
