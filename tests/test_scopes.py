"""Transaction scopes of graphs of all kinds: against a plain walk, and how many rows they take."""

import random

import pytest

from cairn.operators import closure
from cairn.sources.tables import written

from .test_project import rows

EDGES = "repo string, from string, to string"


def _walk(entries, edges):
    """repo, entry, method by following single edges."""
    to = {}
    for r, a, b in edges:
        if a is not None and b is not None:
            to.setdefault((r, a), set()).add(b)
    out = set()
    for r, e in entries:
        if e is None:
            continue
        seen, todo = {e}, [e]
        while todo:
            for t in to.get((r, todo.pop()), ()):
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        out |= {(r, e, x) for x in seen}
    return sorted(out)


def _scope(spark, entries, edges):
    return closure.scope(spark.createDataFrame(entries, "repo string, entry string"), spark.createDataFrame(edges, EDGES))


def _graph(kind):
    rnd = random.Random(kind)
    entries, edges = [], []
    for repo in ("a", "b"):
        n = 40 if repo == "a" else 12
        edges += [(repo, f"m{rnd.randrange(n)}", f"m{rnd.randrange(n)}") for _ in range(n * (1 + kind % 3) // 2 + 3)]
        # a chain that hangs, a tail below it, a ring without a way in, and one that only leads out
        edges += [(repo, f"c{i}", f"c{i + 1}") for i in range(9)] + [(repo, "m1", "c0"), (repo, "c4", "d"), (repo, "c9", "m2")]
        edges += [(repo, "x", "y"), (repo, "y", "z"), (repo, "z", "x"), (repo, "z", "m3"), (repo, "y", "w"), (repo, "m0", "m0"), (repo, "m0", None), (repo, None, "m0")]
        entries += [(repo, f"m{i}") for i in range(0, n, 1 + kind % 4)] + [(repo, "c6"), (repo, None), (repo, "lone"), (repo, "m0")] + [(repo, "y")] * (kind % 2)
    return entries + [("c", "only")], edges + edges[:7] + [("d", "u", "v")]


@pytest.mark.parametrize(("kind", "many"), [(0, -1), (1, 0), (2, 16), (5, 0)])
def test_any_graph(spark, monkeypatch, kind, many):
    """Classes at once, soon, or where many pairs come out; blocks of a few: the same pairs, each once."""
    monkeypatch.setattr(closure, "MANY", many)
    monkeypatch.setattr(closure, "BLOCK", 3)
    entries, edges = _graph(kind)
    assert rows(_scope(spark, entries, edges), "repo", "entry", "method") == _walk(entries, edges)


def _counted(monkeypatch):
    n = []

    def count(df):
        out = written(df)
        n.append(out.count())
        return out

    monkeypatch.setattr(closure, "written", count)
    return n


def test_methods_that_reach_each_other(spark, monkeypatch):
    """three hundred methods that all reach each other make 90,000 pairs; far fewer rows are followed."""
    monkeypatch.setattr(closure, "CHEAP", 0, raising=False)
    n = _counted(monkeypatch)
    edges = [("r", f"m{i}", f"m{t % 300}") for i in range(300) for t in (i + 1, 2 * i, 3 * i)]
    got = _scope(spark, [("r", f"m{i}") for i in range(300)], edges)
    assert got.count() == got.distinct().count() == 90_000 and sum(n) < 200_000


def test_chains_hang(spark, monkeypatch):
    """a hundred chains of sixty with one entry each are not followed: seven rounds over their methods at most."""
    n = _counted(monkeypatch)
    edges = [("r", f"m{i}", f"m{i + 1}") for i in range(6000) if i % 60 != 59]
    got = rows(_scope(spark, [("r", f"m{i}") for i in range(0, 6000, 60)], edges), "entry", "method")
    assert got == sorted((f"m{i - i % 60}", f"m{i}") for i in range(6000)) and sum(n) < 9 * 6000
