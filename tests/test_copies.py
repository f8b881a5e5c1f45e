"""copies of a file are read once in a task, and only uses that are asked for leave it."""

import pyarrow as pa

from cairn.operators import documents, symbols

from .test_project import FILES, rows


def test_copies_are_read_once(monkeypatch):
    read, scan = [], symbols.Scan
    monkeypatch.setattr(symbols, "Scan", lambda *a: read.append(a[0]) or scan(*a))
    texts = ["def test_a(): pass\nother(1)\n", "describe('x', f)\n", "def test_a(): pass\nother(1)\n"] * 50
    ext = ["py", "ts", "py"] * 49 + ["py", "ts", "ts"]
    batch = pa.RecordBatch.from_arrays([pa.array(["r"] * 150), pa.array([f"f{i}" for i in range(150)]), pa.array(ext), pa.array(texts)], names=["repo", "file", "ext", "content"])
    got = [r for b in symbols._scan(frozenset(["describe"]), frozenset(["describe"]))([batch]) for r in b.to_pylist()]
    assert len(read) == 3 and [r["file"] for r in got] == [f"f{i}" for i in range(150)]
    assert all([m["name"] for m in r["methods"]] == ["test_a"] * (t[0] == "d" and t[1:3] == "ef") or e == "ts" for r, t, e in zip(got, texts, ext, strict=True))
    assert [[(u["name"], u["args"]) for u in r["uses"]] for r in got[:2]] == [[], [("describe", "'x', f")]]
    monkeypatch.setattr(symbols, "REPEATED", 0)
    assert [r for b in symbols._scan(frozenset(["describe"]), frozenset(["describe"]))([batch]) for r in b.to_pylist()] == got


def test_cases_in_order(spark):
    """Each name where it comes first, the first hundred of them; a path that comes twice is one file."""
    many = "def test_z(): pass\n" + "".join(f"def test_{i}(): pass\ndef test_{i - i % 2}(): pass\n" for i in range(150))
    files = [
        ("r", "tests/a.py", many), ("r", "tests/b.py", "# def test_no(): pass\nx = 'def test_no'\n"), ("r", "tests/n.py", None), ("r", "tests/c.ts", "it(`one thing`, () => {\n  test(name);\n  describe(\n    'two', f);\n});\n"),
        ("r", "a_test.go", "package a\nfunc TestA(t *T) {\n}\nfunc helper() {\n}\n"), ("r", "XTest.java", "class XTest {\n  @Test\n  void sells() { it(\"no\"); }\n  void other() { }\n}\n"), ("q", "tests/t.py", "def test_1(): pass\n"), ("q", "tests/t.py", "def test_2(): pass\ndef test_1(): pass\n"),
    ]
    got = rows(documents.test_cases(spark.createDataFrame(files, FILES)), "repo", "file", "name")
    first = ["test_z", *dict.fromkeys(f"test_{x}" for i in range(150) for x in (i, i - i % 2))][:100]
    assert [n for _, f, n in got if f == "tests/a.py"] == sorted(first)
    assert [x for x in got if x[1] != "tests/a.py"] == [("q", "tests/t.py", "test_1"), ("q", "tests/t.py", "test_2"), ("r", "XTest.java", "no"), ("r", "XTest.java", "sells"), ("r", "a_test.go", "TestA"), ("r", "tests/c.ts", "one thing"), ("r", "tests/c.ts", "two")]
