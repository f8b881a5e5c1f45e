"""What the operators of this subpackage share: the shared folder, written tables, joins with hot keys, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key that holds more than this part of all rows is hot; there are at most so many of them, however the rows are spread.
HOT_KEYS = 10_000

#: Folders that `materialize` wrote, and in whose name.
_written: dict[str, str] = {}
_names = [""]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session gets a folder of its own;
    on a cluster no folder of one machine will do."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("cairn.shared.dir", None)
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="cairn-")
        spark.conf.set("cairn.shared.dir", where)
    return where.rstrip("/")


def materialize(df: DataFrame, codec: str = "lz4") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: later steps neither recompute it nor
    depend on the executors that made it. `discard` and `release` remove the files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cairn-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    _written[path] = _names[-1]
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that `materialize` returned, once nothing that is still to run reads them."""
    for t in tables:
        path = getattr(t, "written_at", None) if t is not None else None
        if path in _written:
            del _written[path]
            spark = t.sparkSession
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession, *keep: DataFrame, of: str | None = None) -> None:
    """Delete all that `materialize` wrote (in the name of `of`, if given) but `keep`. Call it after the results have been written."""
    kept = {getattr(t, "written_at", None) for t in keep}
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in [p for p, name in _written.items() if p not in kept and of in (None, name)]:
        del _written[path]
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


@contextmanager
def in_name_of(name: str) -> Iterator[None]:
    """Tables written within are `release`d by this name."""
    _names.append(name)
    try:
        yield
    finally:
        _names.pop()


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Tables written within reach Python in batches of so many rows at most. A batch stands in the memory of both sides, so where rows hold whole sets of shingles it must not hold ten thousand of them."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), rows) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def skew_join(left: DataFrame, right: DataFrame, on: list[str], n: str, how: str = "inner") -> DataFrame:
    """left joined (inner, left or left_anti) with right, which has each key once and in `n` how many rows of left have it.

    Keys with more than a HOT_KEYS-th of these rows are broadcast: there are at most HOT_KEYS of them. All other rows meet by a
    shuffle, in which no key can hold more than that share. left is read twice, so it should be a written table."""
    total = right.agg(F.sum(n)).first()[0] or 0
    is_hot = F.col(n) > total / HOT_KEYS
    hot, cold = (right.filter(c) for c in (is_hot, F.coalesce(~is_hot, F.lit(True))))
    rest = left.join(F.broadcast(hot.select(*on)), on, "left_anti")
    if how == "left_anti":
        return rest.join(cold.select(*on), on, "left_anti")
    return left.join(F.broadcast(hot), on).unionByName(rest.join(cold, on, how))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components: (a, b) pairs of long ids -> (id, root), root being the smallest id reachable.

    Alternates large-star and small-star steps, so that a hub never meets its neighbours' neighbours in
    one task and the number of rounds grows with the logarithm of the longest path. Every step is a
    grouped minimum (combined before the shuffle) and a join on the node. Ids that occur in no pair are
    absent from the result. Self-pairs and pairs with a null are ignored. What is a star per component already takes no round. Only the last
    round's table stays."""

    def settled(e: DataFrame) -> bool:
        """Whether every id has one smaller neighbour, which has none itself: a star per component."""
        ends = e.select(F.col("a").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("hit")).union(e.select("b", F.lit(0), F.lit(1)))
        return not ends.groupBy("n").agg(F.sum("out").alias("out"), F.max("hit").alias("hit")).filter("out > 1 or out > 0 and hit > 0").agg(F.count("*")).first()[0]

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        own = both if large else both.filter("b < a")
        low = own.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).select("n", F.least("n", "m").alias("m"))
        moved = own.filter("b > a") if large else own
        out = moved.join(low, moved.a == low.n).select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not large:
            out = out.union(low.select(F.col("n").alias("a"), F.col("m").alias("b")))
        return out.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    e = materialize(
        edges.filter("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    for _ in range(max_rounds):
        if settled(e):
            break
        last, e = e, materialize(star(star(e, True), False))
        discard(last)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    out = e.select(F.col("a").alias("id"), F.col("b").alias("root")).union(e.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
    out.written_at = e.written_at
    return out
