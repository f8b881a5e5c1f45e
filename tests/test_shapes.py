"""Extraction over source shapes that the corpora made from the star tables do not have."""

import time

import pytest
from pyspark.sql import functions as F

from cairn.functions.source import Scan
from cairn.functions.text import slugify, tokens
from cairn.operators import facts, graph, relations, symbols

from .test_project import FILES, rows

TS = (
    "export const load = async (id: string, {a, b} = {}) => {\n  return api.get(id);\n};\nconst one = x => x + 1;\nexport class Shop extends Base implements A, B {\n"
    "  private async find(\n    id: string,\n    n = 3,\n  ): Promise<Item[]> {\n    if (id) { return this.repo.find(id); }\n  }\n  get name() { return 'f() {'; }\n}\nfoo(function () { bar(); });\n"
)
PY = "# class No:\nclass A(Base, mixins.M):\n    '''def no(): {'''\n    def f(self,\n          x):\n        return g(x)\n\n    async def h(self): pass\n\ndef top():\n    def inner(): return k()\n    a = A()\n"
JAVA = (
    'package p;\n@RestController\npublic class C extends D implements I, J {\n  @Autowired\n  private final Dao dao;\n  @Inject Foo foo;\n  @Autowired public C(Dao d) { this.d = d; }\n  @GetMapping("/x{y}")\n'
    '  public <T> List<T> all(@PathVariable("a") String a,\n      int b) throws IOException {\n    return run(new Runner(a)).list();\n  }\n  void plain() {}\n}\n'
)
GO = "package m\nfunc (s *S) Run(a int) (int, error) {\n  s.stop()\n}\nfunc Free() {\n}\n"


def test_shapes(spark):
    files = spark.createDataFrame([("r", "a.ts", TS), ("r", "src/pkg/b.py", PY), ("r", "C.java", JAVA), ("r", "d.go", GO)], FILES)
    p = symbols.facts(files, symbols.INJECTS)
    assert rows(symbols.nodes(p).filter("kind = 'method'"), "file", "line", "id", "visibility") == [
        ("C.java", 7, "p.C.C", "public"), ("C.java", 9, "p.C.all", "public"), ("C.java", 13, "p.C.plain", "package"), ("a.ts", 1, "a.load", "module"), ("a.ts", 4, "a.one", "module"),
        ("a.ts", 6, "a.Shop.find", "private"), ("a.ts", 12, "a.Shop.name", "unknown"), ("d.go", 2, "m.Run", "public"), ("d.go", 5, "m.Free", "public"),
        ("src/pkg/b.py", 4, "src.pkg.b.A.f", "public"), ("src/pkg/b.py", 8, "src.pkg.b.A.h", "public"), ("src/pkg/b.py", 10, "src.pkg.b.top", "public"), ("src/pkg/b.py", 11, "src.pkg.b.inner", "public"),
    ]
    assert rows(symbols.call_sites(p).fillna(""), "file", "line", "caller", "qualifier", "name") == [
        ("C.java", 11, "p.C.all", "", "Runner"), ("C.java", 11, "p.C.all", "", "list"), ("C.java", 11, "p.C.all", "", "run"), ("a.ts", 2, "a.load", "api", "get"), ("a.ts", 10, "a.Shop.find", "repo", "find"),
        ("d.go", 3, "m.Run", "s", "stop"), ("src/pkg/b.py", 6, "src.pkg.b.A.f", "", "g"), ("src/pkg/b.py", 11, "src.pkg.b.inner", "", "k"), ("src/pkg/b.py", 12, "src.pkg.b.top", "", "A"),
    ]
    assert rows(symbols.injections(p), "line", "caller", "name") == [(4, "p.C", "Dao"), (6, "p.C", "Foo")]
    got = {r.id: (r.type, r.extends, r.implements, [m.name for m in r.methods]) for r in symbols.build_symbols(p).collect()}
    assert got["a.Shop"] == ("class", ["Base"], ["A", "B"], ["find", "name"]) and got["src.pkg.b.A"] == ("class", ["Base", "mixins.M"], [], ["f", "h"])
    assert got["p.C"] == ("class", ["D"], ["I", "J"], ["C", "all", "plain"]) and got["a.load"] == ("function", [], [], [])


KT = """package k
@Service class Foo<T : Any>(val a: Int) : Bar(a), Baz {
  private fun short() = go(1)
  @Inject lateinit var dao: Dao
  fun <T> long(x: T): List<T> {
    items.forEach { run(it) }
    return x.map { y -> y.z() }
      .filter { ok(it) }
  }
  companion object { fun make(): Foo = Foo(1) }
}
fun top() { Foo(2).short() }
"""
NESTED = """package p;
class J<T> extends B<T, List<T>> implements I<A, B>, K {
  Runnable r = new Runnable() { public void run() { inner(); } };
  static class N { void one() { two(); } }
  enum E { A(1) { void z() { q(); } }, B(2); E(int i) { } }
  record P(int x, int y) implements Q { int sum() { return x + y; } }
  void last() { if (a) { b("}"); } else if (c()) { d('{'); } /* { */ }
}
"""
CS = "namespace n.m {\n  public class C : Base, IOne {\n    public C(int a) : base(a) { X(); }\n    int Two() => Three(1);\n    internal async Task Go()\n    {\n      await this.Two();\n    }\n  }\n}\n"
VIS = "def _hidden(): pass\nclass _A:\n    async def go(self): self._hidden()\n"


def test_nested_and_short_forms(spark):
    """Types in brackets and one-line bodies, generic heads, Kotlin's constructors and expression bodies, ids of script files, visibility by language."""
    files = spark.createDataFrame([("r", "K.kt", KT), ("r", "J.java", NESTED), ("r", "C.cs", CS), ("r", "s/v.py", VIS), ("r", "g.go", "package g\nfunc low() {}\nfunc Up() { low() }\n"), ("r", "a/x.ts", "function load() { go(); }"), ("r", "b/x.ts", "function load() {}\nclass Q { private m() {} n() {} }")], FILES)
    p = symbols.facts(files, symbols.INJECTS)
    got = {(r.file, r.id): (r.kind, r.visibility) for r in symbols.nodes(p).collect()}
    assert got == {
        ("K.kt", "k.Foo"): ("class", ""), ("K.kt", "k.Foo.short"): ("method", "private"), ("K.kt", "k.Foo.long"): ("method", "package"), ("K.kt", "k.Foo.make"): ("method", "package"), ("K.kt", "k.top"): ("method", "package"),
        ("J.java", "p.J"): ("class", ""), ("J.java", "p.J.run"): ("method", "public"), ("J.java", "p.N"): ("class", ""), ("J.java", "p.N.one"): ("method", "package"), ("J.java", "p.E"): ("enum", ""), ("J.java", "p.E.z"): ("method", "package"),
        ("J.java", "p.E.E"): ("method", "package"), ("J.java", "p.P"): ("record", ""), ("J.java", "p.P.sum"): ("method", "package"), ("J.java", "p.J.last"): ("method", "package"),
        ("C.cs", "n.m.C"): ("class", ""), ("C.cs", "n.m.C.C"): ("method", "public"), ("C.cs", "n.m.C.Two"): ("method", "package"), ("C.cs", "n.m.C.Go"): ("method", "internal"),
        ("s/v.py", "s.v._hidden"): ("method", "private"), ("s/v.py", "s.v._A"): ("class", ""), ("s/v.py", "s.v._A.go"): ("method", "public"), ("g.go", "g.low"): ("method", "private"), ("g.go", "g.Up"): ("method", "public"),
        ("a/x.ts", "a.x.load"): ("method", "module"), ("b/x.ts", "b.x.load"): ("method", "module"), ("b/x.ts", "b.x.Q"): ("class", ""), ("b/x.ts", "b.x.Q.m"): ("method", "private"), ("b/x.ts", "b.x.Q.n"): ("method", "unknown"),
    }
    assert rows(symbols.call_sites(p).fillna(""), "caller", "qualifier", "name") == sorted([
        ("k.Foo.short", "", "go"), ("k.Foo.long", "", "run"), ("k.Foo.long", "y", "z"), ("k.Foo.long", "", "ok"), ("k.Foo.make", "", "Foo"), ("k.top", "", "Foo"), ("k.top", "", "short"), ("p.J.run", "", "inner"), ("p.N.one", "", "two"),
        ("p.E.z", "", "q"), ("p.J.last", "", "b"), ("p.J.last", "", "c"), ("p.J.last", "", "d"), ("n.m.C.C", "", "X"), ("n.m.C.Two", "", "Three"), ("n.m.C.Go", "this", "Two"), ("s.v._A.go", "self", "_hidden"), ("g.Up", "", "low"), ("a.x.load", "", "go"),
    ])
    parents = {r.id: (r.extends, r.implements) for r in symbols.build_symbols(p).filter("type <> 'function'").collect()}
    assert parents["k.Foo"] == (["Bar", "Baz"], []) and parents["p.J"] == (["B"], ["I", "K"]) and parents["n.m.C"] == (["Base", "IOne"], []) and parents["p.P"] == ([], ["Q"])
    assert rows(symbols.injections(p), "caller", "name") == [("k.Foo", "Dao")]


def test_scan_is_linear():
    """Twenty thousand lines in seconds, and twice the lines in about twice the time."""
    body = lambda n: "class A {\n" + "".join(f'  @Get("/x")\n  public void f{i}(String a) {{\n    if (a.b()) {{ this.c.d(e({i})); }}\n  }}\n' for i in range(n)) + "}\n"
    took = []
    for n in (2500, 5000):
        began = time.process_time()
        s = Scan(body(n), "java", frozenset(["Get"]))
        took.append(time.process_time() - began)
        assert len(s.methods) == n and sum(u["mark"] == "@" for u in s.uses) == n and all(u["last"] >= u["line"] for u in s.uses)
    assert took[1] < 10 and took[1] < 3.5 * took[0] + 0.5


@pytest.mark.parametrize("text", ["", "}", ")", "{", "((([", "class", "class A {", "fun(", "a => ", "@", "'", '"""', "/*", "x = = => {", "def f(:", "} } ) ] {", "const f = ", "[Http", "func (", "@A @B("])
@pytest.mark.parametrize("ext", ["java", "kt", "cs", "ts", "py", "go"])
def test_broken_sources(text, ext):
    s = Scan(text, ext, frozenset(["A"]))
    assert all(0 <= t["start"] <= t["end"] <= len(text) for t in (*s.types, *s.methods, *s.uses))


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        ('select * from "a" x', ["a"]), ("select 1 from a x, `b` y, c where z in (select q from d.e)", ["a", "b", "c", "d.e"]), ("insert into t$1 (a) values (1)", ["t$1"]), ("update u set a = 1, b = 2", ["u"]),
        ("delete from v", ["v"]), ("create table if not exists w (a int)", ["w"]), ("select a from b left join c on b.x = c.x", ["b", "c"]), ("", []),
    ],
)
def test_sql_tables(spark, sql, want):
    assert spark.range(1).select(facts.sql_tables(F.lit(sql)).alias("t")).first().t == want


def test_ddl(spark):
    sql = (
        'CREATE TABLE IF NOT EXISTS "shop"."a" (id INT, b_id INT NOT NULL, c VARCHAR(20) UNIQUE, -- note; x\n x INT REFERENCES t, CONSTRAINT pk PRIMARY KEY (id), '
        "CONSTRAINT fk FOREIGN KEY (b_id, c) REFERENCES b (id, c2), UNIQUE KEY u (x, c), CHECK (id > 0)) ENGINE=InnoDB;\ncreate unique index ix on a (b_id, c desc);\nCREATE TABLE z (q INT PRIMARY KEY)"
    )
    files = spark.createDataFrame([("r", "a.sql", sql), ("r", "b.sql", "create index other on a (b_id)"), ("r", "c.sql", None)], FILES)
    tables = relations.extract_ddl(files)
    assert {r.column: tuple(r)[5:] for r in relations.columns(tables).collect()} == {
        "id": (True, True, None, None), "b_id": (False, False, "b", "id"), "c": (False, True, "b", "c2"), "x": (False, False, "t", None), "q": (True, True, None, None),
    }
    assert rows(relations.attach_indexes(tables, relations.extract_indexes(files)), "index", "table", "unique", "columns") == [("ix", "shop.a", True, ["b_id", "c"])]


def test_ddl_of_literals_and_brackets(spark):
    """Semicolons, commas and brackets in literals and defaults, comments, two keys to one table, quoted and dotted names."""
    sql = (
        "CREATE TABLE `a b`.\"t x\" (\n id BIGINT DEFAULT nextval('s;q') PRIMARY KEY, -- , (\n price DECIMAL(10, 2) DEFAULT (round(f(1, g(2)), 3)) NOT NULL, /* x INT, */\n note VARCHAR(20) DEFAULT 'it''s; (unique, references z(q)' UNIQUE,\n"
        " home_id INT REFERENCES addr(id), [work id] INT REFERENCES addr (id),\n CONSTRAINT two FOREIGN KEY (home_id, note) REFERENCES other.pair (a, b) ON DELETE CASCADE,\n CHECK (price > 0 AND note IN ('a', 'b')),\n PRIMARY KEY (id)\n) PARTITION BY HASH(id);\n"
        "INSERT INTO t VALUES ('create table no (x int);');\nCREATE TEMPORARY TABLE u (key_part INT, unique_id INT, index INT, UNIQUE INDEX i (key_part, unique_id));\nCREATE UNIQUE INDEX ix ON `a b`.\"t x\" USING btree (price DESC, lower(note))"
    )
    files = spark.createDataFrame([("r", "a.sql", sql), ("r", "n.sql", None), ("r", "e.sql", "create table"), ("q", "a.sql", "create table t (a int, a2 int references t)")], FILES)
    t = relations.extract_ddl(files)
    assert rows(t, "repo", "table") == [("q", "t"), ("r", "a b.t x"), ("r", "u")]
    got = {(r.table, r.column): (r.type, r.nullable, r.primary_key, r.unique, r.ref_table, r.ref_column) for r in relations.columns(t).collect()}
    assert got == {
        ("t", "a"): ("int", True, False, False, None, None), ("t", "a2"): ("int", True, False, False, "t", None), ("a b.t x", "id"): ("BIGINT", True, True, True, None, None), ("a b.t x", "price"): ("DECIMAL(10,2)", False, False, False, None, None),
        ("a b.t x", "note"): ("VARCHAR(20)", True, False, True, "other.pair", "b"), ("a b.t x", "home_id"): ("INT", True, False, False, "addr", "id"), ("a b.t x", "work id"): ("INT", True, False, False, "addr", "id"),
        ("u", "key_part"): ("INT", True, False, False, None, None), ("u", "unique_id"): ("INT", True, False, False, None, None), ("u", "index"): ("INT", True, False, False, None, None),
    }
    assert rows(relations.foreign_keys(t).filter("repo = 'r'"), "from_columns", "ref_table", "to_columns") == [(["home_id"], "addr", ["id"]), (["home_id", "note"], "other.pair", ["a", "b"]), (["work id"], "addr", ["id"])]
    assert rows(relations.attach_indexes(t, relations.extract_indexes(files)), "index", "table", "unique", "columns") == [("ix", "a b.t x", True, ["price", "lower"])]


def test_text(spark):
    one = spark.createDataFrame([("Größe naïve 東京タワー ﬁne getHTTPName snake_case",)], "t string")
    got = one.select(tokens(F.col("t")).alias("t")).first().t
    assert {"größe", "naïve", "東京タワー", "fine", "gethttpname", "snake_case", "snake", "case"} <= set(got) and "gr" not in got
    assert one.select(slugify(F.lit("  Über uns! ")).alias("a"), slugify(F.lit("!!")).alias("b")).first()[:] == ("über-uns", "page")


def test_nodes_at_hand(spark):
    edges = spark.createDataFrame([("a", "b", "call"), ("c", "a", "sql"), ("a", "a", "call")], "from string, to string, type string")
    got = rows(graph.neighbours(edges, spark.createDataFrame([("a",)], "id string")), "neighbour", "type", "direction")
    assert got == [("a", "call", "in"), ("a", "call", "out"), ("b", "call", "out"), ("c", "sql", "in")]
    nodes = spark.createDataFrame([("r", "x.Y", "Y", "src/y.ts", 2), ("r", "q", "Other", None, 1)], "repo string, id string, label string, file string, ord int")
    assert [r.id for r in graph.find_node(nodes, "SRC/Y").collect()] == ["x.Y"] and graph.find_node(nodes, "nothing").count() == 0
    records = spark.createDataFrame([("r", "q", "HIGH", "unused"), ("r", "x.Y", "HIGH", ""), ("r", "x.Y", "LOW", "maybe")], "repo string, id string, confidence string, evidence string")
    assert rows(graph.flag_dead(nodes, records), "id", "dead") == [("q", True), ("x.Y", False)]
