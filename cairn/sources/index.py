"""Stored indexes: tables by repository under a manifest. A commit writes what it brings into folders of its own version, then one manifest that says of every table and repository which version holds it. Readers go by
the newest manifest: a commit that breaks off before it is not seen, a repository that has vanished or a collection that has become empty is not named any more, and nothing that others may still read is overwritten."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import delete

MANIFEST = "table string, repo string, version long"


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def version(spark: SparkSession, path: str) -> int:
    """The newest committed version, 0 if there is none. A manifest counts once Spark's writer has marked it as whole."""
    at, fs = _files(spark, f"{path.rstrip('/')}/_manifest")
    if not fs.exists(at):
        return 0
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    whole = [int(n.removeprefix("v")) for n in names if n.startswith("v") and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_manifest/{n}/_SUCCESS"))]
    return max(whole, default=0)


def manifest(spark: SparkSession, path: str, at: int | None = None) -> DataFrame:
    """table, repo, version: where the rows of each table and repo are, as of a version (the newest)."""
    at = version(spark, path) if at is None else at
    return spark.read.schema(MANIFEST).parquet(f"{path.rstrip('/')}/_manifest/v{at}") if at else spark.createDataFrame([], MANIFEST)


def commit(tables: dict[str, DataFrame], path: str, repos: DataFrame, all_repos: DataFrame | None = None) -> int:
    """Write the rows of `repos`(repo) in each table(repo, ...) as the next version. What these repos had before is replaced, tables without rows of theirs included; other repos stay as they are, less those that `all_repos`
    lacks, where it is given. Returns the version."""
    spark, root = repos.sparkSession, path.rstrip("/")
    before, old = version(spark, path), manifest(spark, path)
    new = before + 1
    renewed = repos.select("repo").distinct()
    found = None
    for name, t in tables.items():
        out = f"{root}/{name}/v{new}"
        t.join(renewed, "repo", "left_semi").write.mode("overwrite").partitionBy("repo").parquet(out)
        named = spark.read.schema(t.schema).parquet(out).select("repo").distinct().select(F.lit(name).alias("table"), "repo", F.lit(new).cast("long").alias("version"))
        found = named if found is None else found.unionByName(named)
    kept = old.join(renewed, "repo", "left_anti")
    if all_repos is not None:
        kept = kept.join(all_repos.select("repo"), "repo", "left_semi")
    rows = kept.select("table", "repo", "version") if found is None else kept.select("table", "repo", "version").unionByName(found)
    rows.write.mode("overwrite").parquet(f"{root}/_manifest/v{new}")
    return new


def write_index(tables: dict[str, DataFrame], path: str) -> int:
    """`commit` of the repos that the tables name; all others stay."""
    repos = None
    for t in tables.values():
        repos = t.select("repo") if repos is None else repos.union(t.select("repo"))
    return commit(tables, path, repos.distinct())


def read_index(spark: SparkSession, path: str, name: str, at: int | None = None) -> DataFrame:
    """A table as of a version (the newest). Only folders that the manifest names are opened: there are as many as versions that still hold something."""
    m = manifest(spark, path, at).filter(F.col("table") == name)
    live, out = sorted(r.version for r in m.select("version").distinct().collect()), None
    for v in live:
        part = spark.read.parquet(f"{path.rstrip('/')}/{name}/v{v}").withColumn("repo", F.col("repo").cast("string"))
        part = part.join(m.filter(F.col("version") == v).select("repo"), "repo", "left_semi")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError(f"no rows of {name} at {path}")
    return out


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Delete the folders of versions that the newest manifest does not name, and older manifests; what was deleted. Nobody may read an older version then."""
    root, newest = path.rstrip("/"), version(spark, path)
    live = {(r.table, r.version) for r in manifest(spark, path).select("table", "version").distinct().collect()}
    at, fs = _files(spark, root)
    gone = []
    for table in (s.getPath() for s in fs.listStatus(at) if s.isDirectory()):
        for v in (s.getPath() for s in fs.listStatus(table)):
            number = int(v.getName().removeprefix("v"))
            keep = number == newest if table.getName() == "_manifest" else (table.getName(), number) in live
            if not keep:
                delete(spark, v.toString())
                gone.append(f"{table.getName()}/{v.getName()}")
    return sorted(gone)


def refresh(old: DataFrame, status: DataFrame, fresh: DataFrame) -> DataFrame:
    """Facts(repo, file, ...) after a refresh: those of files that are reused, and the fresh ones of files that were analyzed. status(repo, path, status) as `dedupe.file_status` gives it."""
    reused = status.filter("status = 'reused'").select("repo", F.col("path").alias("file"))
    return old.join(reused, ["repo", "file"], "left_semi").unionByName(fresh)


def read_documents(spark: SparkSession, path: str, collection: str, item: T.StructType) -> DataFrame:
    """repo and the fields of a collection's items: index documents, one JSON object a file, whose folder below `path` is the repo."""
    raw = spark.read.schema(T.StructType([T.StructField(collection, T.ArrayType(item))])).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return raw.select(F.regexp_replace(name, "^repo=", "").alias("repo"), F.explode(collection).alias("_i")).select("repo", "_i.*")
