"""First-wins and change detection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order. A grouped minimum: combined before the shuffle, so a hot key costs nothing."""
    rest = [c for c in df.columns if c not in key and c not in order]
    low = df.groupBy(*key).agg(F.min(F.struct(*order, *rest)).alias("_w"))
    return low.select(*key, *(F.col("_w")[c].alias(c) for c in [*order, *rest])).select(*df.columns)


def next_of(df: DataFrame, keys: list[str], order: list[str], is_marker, is_target, value: str, name: str) -> DataFrame:
    """As-of join forwards: each marker row with the value of the first target row at or after it."""
    from pyspark.sql.window import Window as W

    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.currentRow, W.unboundedFollowing)
    return df.withColumn(name, F.first(F.when(is_target, F.col(value)), ignorenulls=True).over(w)).filter(is_marker)


def file_status(files: DataFrame, manifest: DataFrame, version: str, config_hash: str) -> DataFrame:
    """repo, path, hash, status: reused where hash, version and configuration agree, else analyze; removed where the file has vanished.
    Only hashes are shuffled, never contents."""
    now = files.select("repo", "path", F.sha2(F.col("content"), 256).alias("hash"))
    then = manifest.select("repo", "path", F.col("hash").alias("old"), "indexer_version", F.col("config_hash").alias("old_config"))
    same = F.col("hash").eqNullSafe(F.col("old")) & (F.col("indexer_version") == version) & (F.col("old_config") == config_hash)
    status = F.when(F.col("hash").isNull(), "removed").when(same, "reused").otherwise("analyze")
    return now.join(then, ["repo", "path"], "full_outer").select("repo", "path", "hash", status.alias("status"))


def refresh_counts(status: DataFrame) -> DataFrame:
    one = lambda s: F.count_if(F.col("status") == s)
    return status.groupBy("repo").agg((one("reused") + one("analyze")).alias("files"), one("analyze").alias("analyzed"), one("reused").alias("reused"), one("removed").alias("removed"))
