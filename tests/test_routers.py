"""Router modules, static strings and closures on small hand-made tables."""

import pytest

from cairn.operators import closure, routers, web
from cairn.sources.tables import written

from .test_project import FILES, rows

EDGES = "repo string, from string, to string"


def test_static_strings(spark):
    c = [("r", "A", "/a"), ("r", "B", "")]
    e = ['"/x"', "'/y/{id}'", 'f"{A}/z"', "A", "settings.A", 'f"{conf.A}{B}/{A}"', 'f"{NO}/z"', "NO", "call()", "3", '""', "f''", "B", None]
    got = routers.static_strings(spark.createDataFrame([("r", x) for x in e] + [("q", "A")], "repo string, expression string"), spark.createDataFrame(c, "repo string, name string, value string"))
    assert {(r.repo, r.expression): r.value for r in got.collect()} == {
        ("r", '"/x"'): "/x", ("r", "'/y/{id}'"): "/y/{id}", ("r", 'f"{A}/z"'): "/a/z", ("r", "A"): "/a", ("r", "settings.A"): "/a", ("r", 'f"{conf.A}{B}/{A}"'): "/a//a", ("r", 'f"{NO}/z"'): None, ("r", "NO"): None, ("r", "call()"): None,
        ("r", "3"): None, ("r", '""'): "", ("r", "f''"): "", ("r", "B"): "", ("r", None): None, ("q", "A"): None,
    }


def test_constants_to_a_fixpoint(spark):
    text = 'A = "/a"\nB = f"{A}/b"\nC: str = f"{B}/{A}/c"\nD = C\nE = f"{F}"\nF = f"{E}"\nG = f"{NO}"\nlower = "x"\nTWO = "1"\n# H = "no"\n'
    mods = written(routers.modules(spark.createDataFrame([("r", "a.py", text), ("r", "b.py", 'TWO = "2"\nA = "/a"\n'), ("q", "a.py", 'TWO = "2"\n'), ("r", "n.py", None)], FILES)))
    assert rows(routers.constant_values(mods), "repo", "name", "value") == [("q", "TWO", "2"), ("r", "A", "/a"), ("r", "B", "/a/b"), ("r", "C", "/a/b//a/c"), ("r", "D", "/a/b//a/c")]


def test_imports(spark):
    text = "from .x import a, b as c\nfrom ..y.z import (d,\n  e as f)\nimport os, p.q as r\nfrom . import here\nfrom w import v\nimport j.k\n"
    mods = routers.modules(spark.createDataFrame([("r", "m/n/o.py", text), ("r", "m/n/__init__.py", "from .x import a\n"), ("r", "top.py", "from .x import a\n")], FILES))
    got = {r.file: {i.name: i.target for i in r.imports} for r in mods.collect()}
    assert got["m/n/o.py"] == {"a": "m.n.x.a", "c": "m.n.x.b", "d": "m.y.z.d", "f": "m.y.z.e", "os": "os", "r": "p.q", "here": "m.n.here", "v": "w.v", "j.k": "j.k"}
    assert got["m/n/__init__.py"] == {"a": "m.n.x.a"} and got["top.py"] == {"a": "x.a"}
    assert rows(mods, "file", "module") == [("m/n/__init__.py", "m.n"), ("m/n/o.py", "m.n.o"), ("top.py", "top")]


def test_prefixes_of_endpoints(spark):
    files = [
        ("main.py", 'app = FastAPI()\nfrom a import router as ra\nfrom b.c import router\napp.include_router(ra, prefix="/one")\napp.include_router(ra, prefix="/two/")\napp.include_router(router)\napp.include_router(lost.router, prefix=env("X"))\n'),
        ("a.py", 'router = APIRouter(prefix="/r")\nother = APIRouter()\n@router.get("/p")\ndef p(): pass\n@other.get("/q")\ndef q(): pass\n'), ("b/c.py", '@router.get("/{x}")\ndef c(x): pass\n'), ("lost.py", '@router.get("/l")\ndef l(): pass\n'), ("free.py", '@router.get("/f")\ndef f(): pass\n'),
    ]
    f = spark.createDataFrame([("r", *x) for x in files], FILES)
    got = routers.compose(written(routers.modules(f)), web.endpoints(f))
    assert rows(got, "file", "path_pattern", "prefix_resolved") == [
        ("a.py", "/one/q", True), ("a.py", "/one/r/p", True), ("a.py", "/two/q", True), ("a.py", "/two/r/p", True), ("b/c.py", "/{param}", True), ("free.py", "/f", True), ("lost.py", "/l", False),
    ]


def test_chains_take_few_rounds(spark, monkeypatch):
    """A chain of sixty mounts and one of sixty calls: rounds grow as the logarithm."""
    calls = []
    monkeypatch.setattr(closure, "written", lambda df: calls.append(1) or written(df))
    mounts = spark.createDataFrame([("r", f"m{i}", f"m{i + 1}", "/x") for i in range(60)] + [("r", "m60", "m5", "/back"), ("r", "m1", "m1", "/self")], "repo string, owner string, target string, prefix string")
    got = {r.module: r.prefix for r in closure.mount_prefixes(mounts, spark.createDataFrame([("r", "m0")], "repo string, module string")).collect()}
    assert got == {f"m{i}": "/x" * i or "/" for i in range(61)} and len(calls) <= 2 + 2 * 8
    calls.clear()
    edges = spark.createDataFrame([("r", f"m{i}", f"m{i + 1}") for i in range(60)] + [("r", "m60", "m40"), ("q", "m0", "z"), ("r", None, "m0"), ("r", "m3", None)], EDGES)
    got = rows(closure.scope(spark.createDataFrame([("r", "m0"), ("r", "m50"), ("r", None), ("r", "m0")], "repo string, entry string"), edges), "entry", "method")
    assert got == sorted([("m0", f"m{i}") for i in range(61)] + [("m50", f"m{i}") for i in range(40, 61)]) and len(calls) <= 2 + 4 * 8


@pytest.mark.parametrize("doubling", [0, 8, 10**6])
def test_scope_of_any_graph(spark, monkeypatch, doubling):
    """Steps doubled never, where cheap, or always: the same pairs."""
    monkeypatch.setattr(closure, "DOUBLING", doubling)
    pairs = [(i, (i * 7 + 3) % 23) for i in range(23)] + [(i, (i * 5) % 23) for i in range(0, 23, 2)]
    want = set()
    for e in (1, 4, 9):
        seen, todo = {e}, [e]
        while todo:
            todo = [t for f in todo for a, t in pairs if a == f and t not in seen and not seen.add(t)]
        want |= {(str(e), str(x)) for x in seen}
    got = closure.scope(spark.createDataFrame([("r", str(e)) for e in (1, 4, 9)], "repo string, entry string"), spark.createDataFrame([("r", str(a), str(b)) for a, b in pairs], EDGES))
    assert set(rows(got, "entry", "method")) == want
