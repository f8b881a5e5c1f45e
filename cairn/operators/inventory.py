"""What a repository holds: unsupported files, adapter coverage, complexity, workspaces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.corpus import extension

#: Formats that are reported only; formats read in full; manifests.
DISCOVERY_ONLY = ("fmb", "mmb", "olb", "pbl", "pbw", "rpt")
FULL = ("java", "kt", "kts", "js", "jsx", "ts", "tsx", "vue", "py", "cs", "go", "sql")
MANIFEST = r"(?i)(^|/)(pom\.xml|build\.gradle|package\.json)$"


def unsupported_files(files: DataFrame) -> DataFrame:
    return files.filter(extension(F.col("path")).isin(*DISCOVERY_ONLY)).select("repo", "path")


def adapter_extensions(files: DataFrame, endpoints: DataFrame | None = None) -> DataFrame:
    """repo, extension, level, files: how far each format is read: FULL, PARTIAL or, for formats that are only found, UNSUPPORTED. A Python file with Django or Flask endpoints(repo, file, framework), whose routes may be nested
    elsewhere, makes its format partial. A file without an extension goes by its name."""
    ext = F.coalesce(F.nullif(extension(F.col("path")), F.lit("")), F.element_at(F.split("path", "/"), -1))
    f = files.select("repo", "path", ext.alias("extension"))
    nested = F.lit(False)
    if endpoints is not None:
        some = endpoints.filter(F.col("framework").isin("django", "flask")).select("repo", F.col("file").alias("path"), F.lit(True).alias("_nested")).distinct()
        f, nested = f.join(some, ["repo", "path"], "left"), F.coalesce("_nested", F.lit(False)) & (F.col("extension") == "py")
    g = f.groupBy("repo", "extension").agg(F.count("*").alias("files"), F.bool_or(nested).alias("_n"))
    level = F.when(F.col("extension").isin(*DISCOVERY_ONLY), "UNSUPPORTED").when(F.col("extension").isin(*FULL) & ~F.col("_n"), "FULL").otherwise("PARTIAL")
    return g.select("repo", "extension", level.alias("level"), "files")


def adapter_coverage(files: DataFrame, endpoints: DataFrame | None = None) -> DataFrame:
    """repo, full_files, partial_files, unsupported_files, status. Formats that are only found count as unsupported and make the status WARN."""
    of = lambda level: F.coalesce(F.sum(F.when(F.col("level") == level, F.col("files"))), F.lit(0))
    g = adapter_extensions(files, endpoints).groupBy("repo").agg(of("FULL").alias("full_files"), of("PARTIAL").alias("partial_files"), of("UNSUPPORTED").alias("unsupported_files"))
    return g.withColumn("status", F.when(F.col("unsupported_files") > 0, "WARN").when(F.col("partial_files") > 0, "PARTIAL").otherwise("FULL"))


def complexity(files: DataFrame, signals: DataFrame) -> DataFrame:
    """repo, score, tier: file count and signals(repo, has_db, has_external), legacy and several modules told from paths."""
    p = F.col("path")
    g = files.groupBy("repo").agg(
        F.count("*").alias("n"), F.count_if(p.rlike(MANIFEST)).alias("manifests"), (F.coalesce(F.bool_or(p.rlike(r"(?i)(^|/)WEB-INF/web\.xml$")), F.lit(False)) | (F.count_if(p.rlike(r"(?i)\.jsp$")) >= 50)).alias("legacy")
    )
    s = signals.groupBy("repo").agg(F.bool_or("has_db").alias("db"), F.bool_or("has_external").alias("external"))
    bonus = lambda c, k: F.when(c, k).otherwise(0)
    score = F.col("n") + bonus(F.col("db"), 30) + bonus(F.col("legacy"), 40) + bonus(F.col("manifests") >= 2, 20) + bonus(F.col("external"), 20)
    out = g.join(s, "repo", "left").select("repo", score.alias("score"))
    return out.withColumn("tier", F.when(F.col("score") <= 50, "Lite").when(F.col("score") <= 120, "Standard").otherwise("Full"))


def assign_workspace(files: DataFrame, workspaces: DataFrame) -> DataFrame:
    """repo, path, workspace: the workspace(repo, seq, id, path) of longest matching path, else the repo's first, null where it has none.
    Each path is exploded into its prefixes, so that this is an equi-join."""
    parts = F.split("path", "/")
    prefixes = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))
    f = files.select("repo", "path", F.explode(prefixes).alias("prefix"))
    hit = f.join(workspaces.select("repo", F.col("path").alias("prefix"), "id", "seq"), ["repo", "prefix"], "left")
    best = hit.groupBy("repo", "path").agg(F.max_by("id", F.when(F.col("id").isNotNull(), F.struct(F.length("prefix"), -F.col("seq")))).alias("_best"))
    first = workspaces.groupBy("repo").agg(F.min_by("id", "seq").alias("_first"))
    return best.join(first, "repo", "left").select("repo", "path", F.coalesce("_best", "_first").alias("workspace"))
