"""Statements, documents, contracts and checks over shapes that the corpora made from the star tables do not have."""

import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.operators import checks, contracts, documents, markdown, relations, sql_facts, statistics
from cairn.sources import index

from .test_project import FILES, rows


def test_statements(spark):
    xml = "<mapper\n namespace='a.B'>\n<SELECT resultType='x'\n id='q'>select * from t\n</select>\n<insert>nameless</insert></mapper>"
    py = 'a = """select b\n  from \'c\' where d"""\nb = \'it\'\nc = "don\'t select"\nd = "UPDATE t SET a = \\"x\\" WHERE b"\ne = "insert into u(a) values (1)"\nf = "delete"\ng = `delete\nfrom v`\nh = "selection from x y"\n'
    files = spark.createDataFrame([("r", "m.xml", xml), ("r", "b.py", py), ("r", "n.xml", None), ("r", "e.ts", "")], FILES)
    m = sql_facts.mapper_statements(files)
    assert rows(m, "id", "type", "line", "tables", "text_preview") == [("a.B.q", "select", 3, ["t"], "select * from t")]
    assert rows(sql_facts.literal_statements(files), "line", "type", "tables") == [(1, "select", ["c"]), (5, "update", ["t"]), (6, "insert", ["u"]), (8, "delete", ["v"])]
    sql = "select 1 from s.a x, b as y left join `c` on x.i = c.j and y.k = A.l where x.i = 3 and nobody.z = x.i and x.i = (select m from n o where o.p = x.q)"
    s = spark.createDataFrame([("r", "f", 1, "i", sql), ("r", "f", 2, "j", None), ("r", "f", 3, "k", "")], "repo string, file string, line int, id string, sql string")
    assert rows(sql_facts.statement_joins(s), "from_table", "from_column", "to_table", "to_column") == [("b", "k", "s.a", "l"), ("n", "p", "s.a", "q"), ("s.a", "i", "c", "j")]
    t = spark.createDataFrame([("r", "S.T", 1), ("r", "x.t", 2), ("q", "T", 1)], "repo string, name string, ord int")
    named = spark.createDataFrame([("r", "X.T"), ("r", "t"), ("r", "none"), ("q", "a.t")], "repo string, table string")
    assert rows(sql_facts.canonical_tables(named, t), "repo", "table") == [("q", "T"), ("r", "S.T"), ("r", "none"), ("r", "x.t")]


def test_documents(spark):
    md = "---\na: b\n---\nIntro\n\n#  Big *title*\n- point [x](y.md) <b>z</b>\n"
    files = spark.createDataFrame([("r", p, md) for p in ("docs/a.md", "README.md", "x/adr/1.mdx", "dist/no.md", "a.txt", "CLAUDE.md", "deploy.md")] + [("r", "e.md", ""), ("r", "n.md", None)], FILES)
    d = documents.markdown_documents(files)
    assert rows(d, "path", "category") == [
        ("CLAUDE.md", "Harness knowledge"), ("README.md", "README"), ("deploy.md", "Operations"), ("docs/a.md", "Project documents"), ("e.md", "Project documents"), ("n.md", "Project documents"), ("x/adr/1.mdx", "ADR / decisions"),
    ]
    got = {r.path: (r.title, r.plain) for r in d.collect()}
    assert got["docs/a.md"] == ("Big *title*", "Intro Big title point x y.md z") and got["e.md"] == ("e", "")
    assert d.select("slug").distinct().count() == 7
    one = documents.quality_reports(spark.createDataFrame([("docs/QA.md", "t"), ("a.md", "Coverage"), (".claude/patterns/test.md", "t"), ("b.md", "None")], "path string, title string"))
    assert rows(one, "path") == [("a.md",), ("docs/QA.md",)]
    found = spark.createDataFrame([("r", "a", "api_key: '12345678'"), ("r", "b", "userPassword = 123456789"), ("r", "c", "secret = unknown-yet TBD"), ("r", "d", None), ("r", "e", "token none")], FILES)
    assert rows(documents.document_findings(found), "path", "placeholder", "secret") == [("a", False, True), ("c", True, False)]
    notes = spark.createDataFrame([("r", 1, "see src\\A.java and shop.Cart.add"), ("q", 2, "src/a.java"), ("r", 3, None), ("r", 4, "")], "repo string, note_id int, text string")
    nodes = spark.createDataFrame([("r", "x", "X", "src/a.java"), ("r", "org.shop.Cart.add", "add", None), ("r", "get", "get", "")], "repo string, id string, label string, file string")
    assert rows(documents.notes_of_nodes(notes, nodes), "note_id", "node_id") == [(1, "org.shop.Cart.add"), (1, "x")]


def test_test_files(spark):
    f = spark.createDataFrame([(p,) for p in ("a/tests/b.py", "FooTest.java", "FooSpecs.cs", "a.spec.ts", "src/contest.py", "latest.js", "x_test.go")], "p string")
    assert [r.t for r in f.select(statistics.is_test(F.col("p")).alias("t")).collect()] == [True, True, True, True, False, False, True]


@pytest.mark.parametrize(("text", "lines", "code"), [("# a\n\nb\n|---|\n```\nx = 1\n```\n", 2, True), ("```\n...\n```", 1, False), ("```py\n[code here]\n```", 1, False), ("", 0, False), ("   said  ", 1, False)])
def test_content(spark, text, lines, code):
    assert spark.range(1).select(checks.content_lines(F.lit(text)).alias("n"), checks.has_code(F.lit(text)).alias("c")).first()[:] == (lines, code)


def test_checks(spark):
    text = "# R\n## One\nsaid " + "가" * 300 + "\n" + "line\n" * 20 + "## Two\n\n## Bare\n"
    r = spark.createDataFrame([("r", "Lite", text), ("f", "Full", text)], "repo string, tier string, content string")
    s = markdown.sections(r.select("repo", F.lit("p").alias("path"), "content"))
    got = rows(checks.check_sections(r, s, ("One", "Two", "Bare", "Three"), ("Bare",)).fillna(""), "repo", "code", "what")
    assert got == sorted([(x, "ANALYZER_SECTION", "Three") for x in "rf"] + [(x, "ANALYZER_SECTION_DETAIL", "Two") for x in "rf"] + [("f", "ANALYZER_LANGUAGE", ""), ("f", "ANALYZER_DETAIL", "")])
    at = lambda y: datetime.datetime(y, 1, 1)
    files, meta = spark.createDataFrame([("a", at(2020)), ("a", at(2022))], "repo string, mtime timestamp"), spark.createDataFrame([("a", at(2021)), ("b", at(2021))], "repo string, generated_at timestamp")
    assert rows(checks.stale(files, meta), "repo", "stale") == [("a", True), ("b", False)]
    e = spark.createDataFrame([("ai-enrichment", "e", "f", 1), ("ai-enrichment", " ", "f", 2), ("ai-enrichment", "e", None, 3), ("other", None, None, 4), ("ai-enrichment", "e", "f", None)], "origin string, evidence string, file string, line int")
    assert rows(checks.check_ai_evidence(e).fillna(0), "line") == [(0,), (2,), (3,)]


def test_contracts(spark):
    c = "repo string, id string, partner string, method string"
    local, partners = spark.createDataFrame([("r", "a", None, "GET")], c).drop("partner"), spark.createDataFrame([("r", "a", "p", "PUT"), ("r", "b", "q", "PUT"), ("r", "b", "p", "POST")], c)
    assert rows(contracts.merge_partners(local, partners), "id", "source", "method") == [("a", "local", "GET"), ("b", "external", "POST")]
    d = spark.createDataFrame([("b", "x", 3, 0), ("c", "y", 2, 1), ("c", "z", 1, 0)], "backend string, client string, consumers long, unmatched long")
    said = spark.createDataFrame([("c", "y"), ("c", "y")], "backend string, client string")
    assert rows(contracts.drift_summary(d, said), "backend", "clients", "matched", "undeclared", "topology", "status") == [("b", 1, 3, 0, "one-to-one", "PASS"), ("c", 2, 2, 1, "one-to-many", "WARN")]


def test_foreign_keys(spark):
    files = spark.createDataFrame([("r", "a.sql", "create table a (x int references t (k), y int, foreign key (y) references b (id)); create table c (z int)")], FILES)
    fk = relations.foreign_keys(relations.extract_ddl(files))
    assert rows(fk, "table", "from_columns", "ref_table", "to_columns") == [("a", ["x"], "t", ["k"]), ("a", ["y"], "b", ["id"])]


def test_index(spark, tmp_path):
    t = spark.createDataFrame([("a", 1), ("b", 2)], "repo string, n int")
    index.write_index({"t": t}, str(tmp_path / "i"))
    index.write_index({"t": spark.createDataFrame([("b", 3), ("c", 4)], "repo string, n int")}, str(tmp_path / "i"))
    assert rows(index.read_index(spark, str(tmp_path / "i"), "t"), "repo", "n") == [("a", 1), ("b", 3), ("c", 4)]
    for repo, text in (("x", '{"nodes": [\n{"id": "p", "line": 1}, {"id": "q"}]}'), ("y", '{"other": []}')):
        (tmp_path / "j" / repo).mkdir(parents=True)
        (tmp_path / "j" / repo / "call_graph.json").write_text(text)
    item = T.StructType([T.StructField("id", T.StringType()), T.StructField("line", T.IntegerType())])
    assert rows(index.read_documents(spark, str(tmp_path / "j"), "nodes", item).fillna(0), "repo", "id", "line") == [("x", "p", 1), ("x", "q", 0)]
