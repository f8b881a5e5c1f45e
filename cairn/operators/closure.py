"""Fixpoints over edges: router prefixes and transaction scopes. Scopes count methods that reach each other as one, and let hang what is called from one place. Steps are doubled from round to round, so that the rounds grow as the logarithm of the depth and not as the depth; each round is written
to the shared folder, so lineage stays short and a lost executor costs one round at most."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import join_path
from ..sources.tables import discard, written

#: Steps are doubled only while the pairs that this passes through are no more than so many times the edges and the finds so far.
DOUBLING = 8
#: As many edges are cheap to double in any graph.
CHEAP = 1 << 15
#: Pairs of a scope that are more than so many times its edges and entries tell that many methods reach each other.
MANY = 16
#: So many entries, and so many methods, of a class are dealt out together.
BLOCK = 1024


def mount_prefixes(mounts: DataFrame, roots: DataFrame) -> DataFrame:
    """mounts(repo, owner, target, prefix) and roots(repo, module) -> repo, module, prefix: every prefix under which a module is reached.
    A module is passed once along a chain, so mount cycles end; mounts without a known prefix (null) lead nowhere.

    Round j joins the chains of less than 2^j mounts from a root with all chains of exactly 2^j mounts: each chain is made once."""
    step = mounts.filter("prefix is not null and owner <> target").select("repo", "owner", "target", "prefix", F.array("target").alias("chain")).distinct()
    step = written(step)
    done = written(roots.select("repo", "module", F.lit("/").alias("prefix"), F.array("module").alias("chain")).distinct())
    while not step.isEmpty():
        s = step.select("repo", F.col("owner").alias("module"), F.col("target").alias("_t"), F.col("prefix").alias("_p"), F.col("chain").alias("_c"))
        found = done.join(s, ["repo", "module"]).filter(~F.arrays_overlap("chain", "_c"))
        found = found.select("repo", F.col("_t").alias("module"), join_path(F.col("prefix"), F.col("_p")).alias("prefix"), F.concat("chain", "_c").alias("chain"))
        grown = written(done.unionByName(found))
        a, b = step.alias("a"), step.alias("b")
        twice = a.join(b, (F.col("a.repo") == F.col("b.repo")) & (F.col("a.target") == F.col("b.owner"))).filter(~F.arrays_overlap("a.chain", "b.chain") & ~F.array_contains("b.chain", F.col("a.owner")))
        twice = written(twice.select("a.repo", "a.owner", "b.target", join_path(F.col("a.prefix"), F.col("b.prefix")).alias("prefix"), F.concat("a.chain", "b.chain").alias("chain")))
        discard(done, step)
        done, step = grown, twice
    discard(step)
    return done.select("repo", "module", "prefix").distinct()


def _read(parts: list[DataFrame]) -> DataFrame:
    """Tables of one kind as one."""
    return parts[0].sparkSession.read.schema(parts[0].schema).parquet(*(p.written_at for p in parts))


def _hung(parents: DataFrame) -> DataFrame:
    """parents(repo, method, parent) -> repo, method, root: the first above that has no parent here. Pointers are doubled: a chain of sixty takes seven rounds, and each round looks at what is still open
    only. Rings without a way in have no root and are left out."""
    told, todo = [], parents.select("repo", "method", "parent", F.lit(False).alias("ended"))
    while True:
        known = todo if not told else todo.unionByName(_read(told).filter("ended"))
        k = known.select("repo", F.col("method").alias("parent"), F.col("parent").alias("_p"), F.col("ended").alias("_e"))
        ended = F.col("_p").isNull() | F.col("_e")
        told.append(written(todo.drop("ended").join(k, ["repo", "parent"], "left").select("repo", "method", F.coalesce("_p", "parent").alias("parent"), ended.alias("ended"))))
        todo = told[-1].filter("not ended")
        if todo.isEmpty() or told[-1].filter("ended").isEmpty():
            return _read(told).filter("ended").select("repo", "method", F.col("parent").alias("root"))


def _reached(parts: list[DataFrame], step: DataFrame, most: int | None = None) -> tuple[list[DataFrame], DataFrame, bool]:
    """Goes on from tables(repo, entry, method), of which the last is new, by steps(repo, method, to). The tables with what was found, the steps as they are by then, and whether nothing is left to find: not so if it
    ended because there were more pairs than `most`.

    A round takes what the last one found by steps of up to h edges, and doubles h where that is cheap: long chains take a logarithm of their length. Where all reach all, steps stay short, and few
    rounds are left anyway."""
    first, far, n_edges, parts = step, step, step.count(), list(parts)  # far: by walks of exactly h edges
    n_done, doubles = _read(parts).count(), True
    while most is None or n_done <= most:
        found = parts[-1].join(step, ["repo", "method"]).select("repo", "entry", F.col("to").alias("method")).distinct()
        new = written(found.join(_read(parts), ["repo", "entry", "method"], "left_anti"))
        n = new.count()
        if not n:
            discard(new, far if far is not step else None, step if step is not first else None)
            return parts, step, True
        parts, n_done = [*parts, new], n_done + n
        if not doubles:
            continue
        ends = far.groupBy("repo", F.col("to").alias("method")).agg(F.count("*").alias("i"))
        begins = step.groupBy("repo", "method").agg(F.count("*").alias("o"))
        doubles = (ends.join(begins, ["repo", "method"]).agg(F.sum(F.col("i") * F.col("o"))).first()[0] or 0) <= DOUBLING * max(n_edges + n_done, CHEAP)
        if doubles:
            on = far.select("repo", F.col("method").alias("_m"), F.col("to").alias("method"))
            by = lambda s: on.join(s, ["repo", "method"]).select("repo", F.col("_m").alias("method"), "to").filter("method <> to").distinct()
            longer, twice = written(step.unionByName(by(step)).distinct()), written(by(far))
            discard(far if far is not first else None, step if step is not first and step is not far else None)
            step, far = longer, twice
    return parts, step, False


def _cores(edges: DataFrame, step: DataFrame) -> DataFrame:
    """repo, cls, method: of each repository the methods that reach the one with the most ways through it and are reached from it, that one being cls; itself included. step: edges, or walks along them."""
    i, o = edges.groupBy("repo", F.col("to").alias("method")).agg(F.count("*").alias("_i")), edges.groupBy("repo", "method").agg(F.count("*").alias("_o"))
    pivot = i.join(o, ["repo", "method"]).groupBy("repo").agg(F.max_by("method", F.struct(F.col("_i") * F.col("_o"), F.col("method"))).alias("method"))
    start = written(pivot.select("repo", F.col("method").alias("entry"), "method"))
    ahead, behind = (_read(_reached([start], s)[0]) for s in (step, step.select("repo", F.col("to").alias("method"), F.col("method").alias("to"))))
    return written(ahead.join(behind, ["repo", "entry", "method"]).select("repo", F.col("entry").alias("cls"), "method"))


def _of_class(df: DataFrame, column: str, cores: DataFrame) -> DataFrame:
    """df with the class of a column in its place, for methods of the cores."""
    c = cores.select("repo", F.col("method").alias(column), "cls")
    return df.join(c, ["repo", column], "left").withColumn(column, F.coalesce("cls", column)).drop("cls")


def _blocks(df: DataFrame, column: str) -> DataFrame:
    """df(repo, cls, column) -> repo, cls, column: arrays of about BLOCK at most."""
    large = df.groupBy("repo", "cls").agg(F.ceil(F.count("*") / BLOCK).alias("_n")).filter("_n > 1")
    part = F.pmod(F.xxhash64(column), F.coalesce("_n", F.lit(1)))
    return df.join(large, ["repo", "cls"], "left").groupBy("repo", "cls", part.alias("_b")).agg(F.collect_list(column).alias(column)).drop("_b")


def _all_with_all(entries: DataFrame, methods: DataFrame) -> DataFrame:
    """entries(repo, cls, entry) and methods(repo, cls, method) -> repo, entry, method of the same class: blocks are met and dealt out before they are taken apart, so that a large class is no single task."""
    n = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = _blocks(entries, "entry").join(_blocks(methods, "method"), ["repo", "cls"]).select("repo", "entry", "method").repartition(n)
    return met.select("repo", F.explode("entry").alias("entry"), "method").select("repo", "entry", F.explode("method").alias("method"))


def scope(entries: DataFrame, edges: DataFrame) -> DataFrame:
    """entries(repo, entry) and edges(repo, from, to) -> repo, entry, method: all methods reached from an entry, itself included.

    Only what must be is followed pair by pair. A method that is no entry and is called from one place is reached from what reaches that place: it hangs there, and chains are not followed at all. Where many pairs
    come out all the same, methods that reach each other count as one. Both are put in again at the end."""
    entries = written(entries.filter("entry is not null").select("repo", "entry").distinct())
    given = written(edges.filter("from is not null and to is not null and from <> to").select("repo", "from", "to"))
    called = given.groupBy("repo", F.col("to").alias("method")).agg(F.min("from").alias("parent"), F.max("from").alias("_q"))
    is_entry = entries.select("repo", F.col("entry").alias("method"), F.lit(True).alias("_e"))
    called = written(called.join(is_entry, ["repo", "method"], "left").select("repo", "method", "parent", (F.col("_e").isNull() & (F.col("parent") == F.col("_q"))).alias("hangs")))
    hung = None if (h := called.filter("hangs")).isEmpty() else _hung(h.drop("hangs"))
    start = written(entries.select("repo", "entry", F.col("entry").alias("method")))
    if (left := called.filter("not hangs")).isEmpty():
        return start if hung is None else _put_in(start, None, entries, hung)
    step = given.join(left.select("repo", F.col("method").alias("to")), ["repo", "to"], "left_semi")
    if hung is not None:
        step = step.join(hung.select("repo", F.col("method").alias("from"), "root"), ["repo", "from"], "left").withColumn("from", F.coalesce("root", "from"))
    step = written(step.select("repo", F.col("from").alias("method"), "to").filter("method <> to").distinct())
    discard(given, called)
    parts, longer, whole = _reached([start], step, MANY * (step.count() + entries.count()))
    cores = None if whole else _cores(step, longer)
    if cores is None or cores.filter("cls <> method").isEmpty():
        pairs = _read(parts if whole else _reached(parts, longer)[0])
        return pairs if hung is None else _put_in(pairs, None, entries, hung)
    discard(*parts, longer if longer is not step else None)
    by_class = written(_of_class(_of_class(step, "method", cores), "to", cores).filter("method <> to").distinct())
    start = written(_of_class(entries, "entry", cores).distinct().select("repo", "entry", F.col("entry").alias("method")))
    return _put_in(_read(_reached([start], by_class)[0]), cores, entries, hung)


def _put_in(pairs: DataFrame, cores: DataFrame | None, entries: DataFrame, hung: DataFrame | None) -> DataFrame:
    """pairs(repo, entry, method) of classes and roots -> pairs of all that they stand for."""
    if cores is None:
        hangs = hung.select("repo", F.col("root").alias("cls"), "method")
        return pairs.unionByName(_all_with_all(pairs.select("repo", F.col("method").alias("cls"), "entry"), hangs))
    more = cores.filter("cls <> method").select("repo", "cls", "method")
    if hung is not None:
        more = more.unionByName(_of_class(hung, "root", cores).select("repo", F.col("root").alias("cls"), "method"))
    own = cores.filter("cls = method").select("repo", F.col("cls").alias("entry"))
    of_core, other = pairs.join(own, ["repo", "entry"], "left_semi"), pairs.join(own, ["repo", "entry"], "left_anti")
    of_class = of_core.select("repo", F.col("entry").alias("_c"), F.col("method").alias("cls")).join(more, ["repo", "cls"]).select("repo", F.col("_c").alias("cls"), "method")
    methods = of_core.select("repo", F.col("entry").alias("cls"), "method").unionByName(of_class)
    inner = entries.join(cores.select("repo", F.col("method").alias("entry"), "cls"), ["repo", "entry"])
    to_class = other.select("repo", F.col("method").alias("cls"), "entry").join(more.select("repo", "cls").distinct(), ["repo", "cls"], "left_semi")
    return other.unionByName(_all_with_all(inner, methods)).unionByName(_all_with_all(to_class, more))


def in_transaction(calls: DataFrame, scopes: DataFrame) -> DataFrame:
    """External calls(repo, method, ...) with a flag: reached within a transaction."""
    hit = scopes.select("repo", "method").distinct().withColumn("_t", F.lit(True))
    return calls.join(hit, ["repo", "method"], "left").withColumn("in_transaction", F.coalesce("_t", F.lit(False))).drop("_t")
