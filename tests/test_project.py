"""Symbols, closures, inventories, checks and reports on small hand-made tables."""

from cairn.operators import checks, closure, graph, inventory, markdown, relations, search, symbols

FILES = "repo string, path string, content string"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_symbols_skip_comments_strings_and_keywords(spark):
    java = 'package a.b;\nclass Out {\n  class In {\n    @Inject Dao dao;\n    void f() { g("x{"); }\n  }\n  // void no() {\n  /* class No {\n  } */\n  void g() {\n    if (x) { dao.save(1); }\n  }\n}\n'
    files = spark.createDataFrame([("r", "A.java", java), ("r", "b.ts", "export function load(id) {\n  return find(id);\n}\n"), ("r", "c.go", "func (s *S) Run() error {\n  s.stop()\n}"), ("r", "d.java", None), ("r", "e.java", ""), ("r", "f.md", "class X {")], FILES)
    p = symbols.facts(files, symbols.INJECTS)
    assert rows(symbols.nodes(p), "id", "kind", "line") == [
        ("Run", "method", 1), ("a.b.In", "class", 3), ("a.b.In.f", "method", 5), ("a.b.Out", "class", 2), ("a.b.Out.g", "method", 10), ("b.load", "method", 1),
    ]
    assert rows(symbols.call_sites(p), "caller", "name", "line") == [("Run", "stop", 2), ("a.b.In.f", "g", 5), ("a.b.Out.g", "save", 11), ("b.load", "find", 2)]
    assert rows(symbols.injections(p), "caller", "name") == [("a.b.In", "Dao")]


def test_mount_cycles_end(spark):
    mounts = spark.createDataFrame([("r", "app", "x", "/v1"), ("r", "x", "y", "y/"), ("r", "y", "x", "/again"), ("r", "app", "y", None), ("s", "app", "z", "/z")], "repo string, owner string, target string, prefix string")
    got = closure.mount_prefixes(mounts, spark.createDataFrame([("r", "app")], "repo string, module string"))
    assert rows(got, "module", "prefix") == [("app", "/"), ("x", "/v1"), ("y", "/v1/y")]


def test_scope_and_flag(spark):
    edges = spark.createDataFrame([("r", "a", "b"), ("r", "b", "a"), ("r", "b", "c"), ("q", "c", "d")], "repo string, from string, to string")
    s = closure.scope(spark.createDataFrame([("r", "a")], "repo string, entry string"), edges)
    assert rows(s, "entry", "method") == [("a", "a"), ("a", "b"), ("a", "c")]
    calls = spark.createDataFrame([("r", "c"), ("q", "c"), ("r", None)], "repo string, method string")
    assert [r.in_transaction for r in closure.in_transaction(calls, s).orderBy("repo", "method").collect()] == [False, False, True]


def test_workspace(spark):
    files = spark.createDataFrame([("r", "a/b/c.java"), ("r", "ab/c.java"), ("r", "a/x.java"), ("q", "a/x.java")], "repo string, path string")
    w = spark.createDataFrame([("r", 1, "one", "z"), ("r", 2, "a", "a"), ("r", 3, "ab", "a/b")], "repo string, seq int, id string, path string")
    assert rows(inventory.assign_workspace(files, w).na.fill("-"), "repo", "path", "workspace") == [("q", "a/x.java", "-"), ("r", "a/b/c.java", "ab"), ("r", "a/x.java", "a"), ("r", "ab/c.java", "one")]


def test_patch(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("b",)], "id string")
    edges = spark.createDataFrame([("a", "b", "call")], "from string, to string, type string")
    patch = spark.createDataFrame([("add_edge", "a", "b", "call"), ("add_edge", "b", "a", "inject"), ("add_edge", "b", "a", "inject"), ("add_edge", "a", "z", "call"), ("add_edge", "a", "b", "odd"), (None, "a", "b", "call")], "op string, from string, to string, type string")
    assert [r.status for r in graph.apply_patch(edges, nodes, patch).orderBy("status").collect()] == ["applied", "duplicate", "duplicate", "rejected", "rejected", "rejected"]


def test_join_table_needs_unique_keys(spark):
    fk = spark.createDataFrame([("r", "AB", 1, ["a"], "A"), ("r", "AB", 2, ["b"], "B"), ("r", "AC", 1, ["a"], "A"), ("r", "AC", 2, ["c"], "C")], "repo string, table string, ord int, columns array<string>, ref_table string")
    keys = spark.createDataFrame([("r", "ab", "unique_index", ["B", "A"]), ("r", "ab", "primary_key", ["a", "b"]), ("r", "ac", "primary_key", ["a"])], "repo string, table string, basis string, columns array<string>")
    u = relations.uniqueness(keys)
    assert rows(u, "table", "colkey", "basis") == [("ab", "a,b", "primary_key"), ("ac", "a", "primary_key")]
    assert rows(relations.many_to_many(fk, u), "via_table", "from_table", "to_table") == [("ab", "A", "B")]


def test_sections_nest(spark):
    text = "## One\na\n### Two\nb\n## Risk\n- Medium thing\n- medium THING\n* HIGH one\nplain\n"
    docs = spark.createDataFrame([("r", "a.md", text), ("r", "b.md", None), ("r", "c.md", "no heading")], FILES)
    assert rows(markdown.sections(docs), "title", "body") == [("One", "a\n### Two\nb"), ("Risk", "- Medium thing\n- medium THING\n* HIGH one\nplain"), ("Two", "b")]
    assert rows(markdown.risks(docs), "severity", "text") == [("HIGH", "HIGH one"), ("MEDIUM", "Medium thing")]


def test_references(spark):
    docs = spark.createDataFrame([("r", "d.md", "see `a.ts:2`, (a.ts:9) a.ts:2 b.ts:1 http://x.y:1"), ("r", "e.md", None)], FILES)
    files = spark.createDataFrame([("r", "a.ts", "1\n2\n3")], FILES)
    ref = checks.source_references(docs).filter("file not like '%x.y'")
    assert rows(checks.check_line_references(ref, files), "file", "line", "status") == [("a.ts", 2, "OK"), ("a.ts", 9, "OUT_OF_RANGE"), ("b.ts", 1, "MISSING")]
    assert rows(checks.evidence_density(ref, files), "refs", "needed", "enough") == [(3, 5, False)]


def test_candidates_fall_back_to_substrings(spark):
    index = spark.createDataFrame([("order", 1), ("orders", 2), ("user", 3)], "token string, item long")
    query = spark.createDataFrame([("order",), ("use",), ("superuser",), ("zz",)], "token string")
    assert rows(search.candidates(index, query), "query", "item") == [("order", 1), ("superuser", 3), ("use", 3)]
