r"""Merkle fixity audit of WARC replicas.

A replica is a table of records (file, offset, length, digest), a record's digest being the SHA-256 of its bytes. Records in offset
order are dealt to leaves of `fanout` neighbours by offset range, leaves to nodes, up to one root per file; a node's hash is taken over
its children's offset ranges and hashes. Replicas are compared from the roots down, and only children of nodes that differ are
compared further, until records that differ, or exist once, are reached.

A node gathers at most `fanout` children; levels are added until every file has one root. Offsets are dealt to leaves by their
rank within the primary's file, as bounds that both replicas share, so a missing record does not shift its neighbours' leaves.

Defined cases: null payloads are empty, null urls the empty url; a file in one replica only differs as a whole; repeated
records (same file and offset) are one node entry each, in digest order; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import materialize

FANOUT = 16


def record_bytes(url: Column, payload: Column) -> Column:
    """A WARC/1.0 resource record as a string."""
    body = F.coalesce(payload, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", per_file: int = 4096, damaged: Column | None = None) -> DataFrame:
    """file, offset, length, digest, id: pages as records of files, per_file ids each, in id order. Where `damaged` holds, the record
    has another first byte of its payload (of what follows it, if it is empty)."""
    raw = record_bytes(F.col(url_col), F.col(body_col))
    if damaged is not None:
        raw = raw.cast("binary")
        at = (F.octet_length(raw) - F.octet_length(F.coalesce(F.col(body_col), F.lit(""))) - 3).cast("int")
        x, y = F.lit(b"x"), F.lit(b"y")
        raw = F.when(damaged, F.overlay(raw, F.when(F.substring(raw, at, F.lit(1)) == x, y).otherwise(x), at, F.lit(1))).otherwise(raw)
    r = pages.select(F.col(id_col).alias("id"), F.floor(F.coalesce(F.col(id_col), F.lit(-1)) / per_file).cast("long").alias("file"), F.octet_length(raw).cast("long").alias("length"), F.sha2(raw, 256).alias("digest"))
    run = W.partitionBy("file").orderBy("id", "digest").rowsBetween(W.unboundedPreceding, W.currentRow)
    return r.withColumn("offset", F.sum("length").over(run) - F.col("length")).select("file", "offset", "length", "digest", "id")


def tree(replica: DataFrame, bounds: DataFrame, fanout: int, levels: int) -> list[DataFrame]:
    """Levels from records up: node, parent, file, first, last, hash. bounds(file, offset, seq) deals offsets to leaves."""
    placed = bounds.select("file", "offset", "seq", F.lit(0).alias("own"))
    # as-of: a record takes the number of the last bound at or before its offset
    both = replica.select("file", "offset", "length", "digest", F.lit(1).alias("own"), F.lit(None).cast("long").alias("seq")).unionByName(placed, allowMissingColumns=True)
    w = W.partitionBy("file").orderBy("offset", "own").rowsBetween(W.unboundedPreceding, W.currentRow)
    r = both.withColumn("seq", F.coalesce(F.last("seq", True).over(w), F.lit(0))).filter("own = 1")
    level = r.select("file", F.col("seq").alias("node"), F.col("offset").alias("first"), (F.col("offset") + F.col("length")).alias("last"), F.col("digest").alias("hash"))
    out = []
    for _ in range(levels + 1):
        level = level.groupBy("file", "node").agg(
            F.min("first").alias("first"), F.max("last").alias("last"),
            F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first", "last", "hash"))), lambda c: F.concat_ws(":", c["first"], c["last"], c["hash"])), ","), 256).alias("hash"),
        )
        out.append(materialize(level))
        level = out[-1].withColumn("node", F.floor(F.col("node") / fanout))
    return out


def audit(primary: DataFrame, replica: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """file, offset, problem (changed, missing, added), length, replica_length: one row per record that differs."""
    seq = F.row_number().over(W.partitionBy("file").orderBy("offset")) - 1
    bounds = materialize(primary.select("file", "offset").distinct().withColumn("seq", seq.cast("long")))
    widest = (bounds.agg(F.max("seq")).first()[0] or 0) + 1
    levels = 0
    while fanout**levels < widest:
        levels += 1
    a, b = tree(primary, bounds, fanout, levels), tree(replica, bounds, fanout, levels)
    suspects = None
    for k in range(levels, -1, -1):
        x, y = (t[k].select("file", "node", F.col("hash").alias(h)) for t, h in ((a, "ha"), (b, "hb")))
        if suspects is not None:
            x, y = (t.withColumn("up", F.floor(F.col("node") / fanout)).join(suspects, ["file", "up"], "left_semi").drop("up") for t in (x, y))
        differs = x.join(y, ["file", "node"], "full_outer").filter(~F.col("ha").eqNullSafe(F.col("hb")))
        suspects = materialize(differs.select("file", F.col("node").alias("up")))
    spans = suspects.withColumnRenamed("up", "seq")
    w = W.partitionBy("file").orderBy("offset", "own").rowsBetween(W.unboundedPreceding, W.currentRow)

    def under(r: DataFrame, name: str) -> DataFrame:
        both = r.select("file", "offset", "length", "digest", F.lit(1).alias("own"), F.lit(None).cast("long").alias("seq")).unionByName(bounds.withColumn("own", F.lit(0)), allowMissingColumns=True)
        placed = both.withColumn("seq", F.coalesce(F.last("seq", True).over(w), F.lit(0))).filter("own = 1").join(spans, ["file", "seq"], "left_semi")
        return placed.groupBy("file", "offset").agg(F.sort_array(F.collect_list(F.struct("digest", "length"))).alias(name))

    x, y = under(primary, "p"), under(replica, "r")
    joined = x.join(y, ["file", "offset"], "full_outer").filter(~F.col("p").eqNullSafe(F.col("r")))
    problem = F.when(F.col("r").isNull(), "missing").when(F.col("p").isNull(), "added").otherwise("changed")
    return joined.select("file", "offset", problem.alias("problem"), F.col("p")[0]["length"].alias("length"), F.col("r")[0]["length"].alias("replica_length"))
