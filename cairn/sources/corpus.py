"""Source trees as a files table, and a corpus made from the star tables whose facts are known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Formats that are read as text, manifests, folders that are skipped, the largest file.
EXTENSIONS = (
    "java kt kts js jsx ts tsx vue py cs go xml sql jsp jspx tag asp aspx ascx ashx asmx vb vbs xaml cshtml vbhtml razor php rb cbl cob cpy abap html htm properties yml yaml json".split()
)
MANIFESTS = "pom.xml go.mod package.json build.gradle build.gradle.kts Cargo.toml Gemfile composer.json".split()
EXCLUDED = (
    ".git node_modules vendor dist build target out .next .nuxt coverage _workspace _workspace_prev .claude .idea .vscode bin obj .venv venv env .tox site-packages __pycache__ .pytest_cache .mypy_cache".split()
)
LARGEST = 4 * 1024 * 1024


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def _relative(root: str) -> tuple[Column, Column]:
    """Repo and path of a file: the first folder under root, and what comes below it."""
    rel = F.substring_index("path", f"/{root.rstrip('/').rpartition('/')[2]}/", -1)
    return F.substring_index(rel, "/", 1).alias("repo"), F.regexp_extract(rel, "^[^/]+/(.*)$", 1).alias("path")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """repo, path, size, mtime, folder of every file below root; contents are not read. Files without a byte are left out, as Spark's readers do: they hold no facts."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return raw.select(*_relative(root), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"))


def read_source_tree(spark: SparkSession, root: str) -> DataFrame:
    """files(repo, path, size, mtime, content): what is in scope by name and size; the first folder under root is the repo.

    The listing is judged before any content is read: only folders that hold a file in scope are opened, by name patterns and a bound on size that reach the reader. The folders' names pass through the driver, which holds the whole
    listing anyway."""
    found = in_scope(listing(spark, root))
    folders = [r.folder for r in found.select("folder").distinct().collect()]
    schema = "repo string, path string, size long, mtime timestamp, content string"
    if not folders:
        return spark.createDataFrame([], schema)
    names = ",".join([*(f"*.{a}" for e in EXTENSIONS for a in (e, e.upper())), *MANIFESTS])
    raw = spark.read.format("binaryFile").option("pathGlobFilter", f"{{{names}}}").load(folders).filter(F.col("length") <= LARGEST)
    return raw.select(*_relative(root), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.decode("content", "UTF-8").alias("content"))


def in_scope(files: DataFrame, include: DataFrame | None = None) -> DataFrame:
    """Known format or a manifest, no excluded folder, not too large, and under one of the repo's include paths(repo, path), if it has any; paths may begin with ./ and end in /, and . is all."""
    parts = F.split("path", "/")
    kept = files.filter((extension(F.col("path")).isin(*EXTENSIONS) | F.element_at(parts, -1).isin(*MANIFESTS)) & ~F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(*map(F.lit, EXCLUDED))) & (F.col("size") <= LARGEST))
    if include is None:
        return kept
    plain = F.regexp_replace(F.regexp_replace(F.trim("path"), r"^\./", ""), "/$", "")
    paths = include.select("repo", F.when(plain == ".", "").otherwise(plain).alias("path")).filter(~F.startswith("path", F.lit(".."))).groupBy("repo").agg(F.collect_set("path").alias("_include"))
    under = F.exists("_include", lambda p: (p == "") | (F.col("path") == p) | F.startswith(F.col("path"), F.concat(p, F.lit("/"))))
    return kept.join(paths, "repo", "left").filter(F.col("_include").isNull() | under).drop("_include")


def star_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Java controller per part and one TypeScript client per customer; 50 repos of each kind."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey")
    k, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    java = part.select(
        F.concat(F.lit("api"), (F.col("p_partkey") % 50).cast("string")).alias("repo"),
        F.concat(F.lit("src/C"), k, F.lit(".java")).alias("path"),
        F.concat(
            F.lit("package shop;\n\n@RequestMapping(\"/shop/s"), size, F.lit("/\")\npublic class C"), k, F.lit(" {\n  // @GetMapping(\"/not/this\")\n  @GetMapping(\"/items/{id}/p"), k,
            F.lit("\")\n  public String read(String id) {\n    return id;\n  }\n}\n"),
        ).alias("content"),
    )
    c = F.col("c_custkey").cast("string")
    ts = customer.select(
        F.concat(F.lit("web"), (F.col("c_custkey") % 50).cast("string")).alias("repo"),
        F.concat(F.lit("app/c"), c, F.lit(".ts")).alias("path"),
        F.concat(
            F.lit("export async function load"), c, F.lit("(id) {\n  return axios.get(`/shop/s"), (F.col("c_custkey") % 50 + 1).cast("string"), F.lit("/items/${id}/p"), c,
            F.when(F.col("c_nationkey") == 7, F.lit("/old")).otherwise(F.lit("")), F.lit("`);\n}\n"),
        ).alias("content"),
    )
    both = java.unionByName(ts)
    return both.withColumn("size", F.octet_length("content").cast("long")).withColumn("mtime", F.timestamp_seconds(F.lit(0)))


def dao_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Java data access class per supplier, in 20 repos."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_nationkey")
    k, n = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    content = F.concat(
        F.lit("package dao;\npublic class D"), k, F.lit(" {\n  @Query(\"SELECT a.id FROM t"), n, F.lit(" a JOIN u"), (F.col("s_suppkey") % 7).cast("string"), F.lit(" b ON a.id = b.id\")\n  String find"), k,
        F.lit("(String id);\n  @Transactional"), F.when(F.col("s_suppkey") % 3 == 0, F.lit("(propagation = Propagation.REQUIRES_NEW)")).otherwise(F.lit("")), F.lit("\n  public void save"), k,
        F.lit("(String id) {\n    kafkaTemplate.send(System.getenv(\"KEY_"), (F.col("s_suppkey") % 5).cast("string"), F.lit("\"), id);\n  }\n  void after"), k, F.lit("() {\n  }\n}\n"),
    )
    files = s.select(F.concat(F.lit("dao"), (F.col("s_suppkey") % 20).cast("string")).alias("repo"), F.concat(F.lit("src/D"), k, F.lit(".java")).alias("path"), content.alias("content"))
    return files.withColumn("size", F.octet_length("content").cast("long")).withColumn("mtime", F.timestamp_seconds(F.lit(0)))


def service_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Java service per part, in 40 repos; each calls the service 40 keys on and has it injected."""
    k = F.col("p_partkey").cast("string")
    n = (F.col("p_partkey") + 40).cast("string")
    content = F.concat(
        F.lit("package svc;\n\npublic class S"), k, F.lit(" {\n  @Autowired private S"), n, F.lit(" next;\n  /* void gone"), k, F.lit("() {\n  } */\n  public void run"), k,
        F.lit("(String id) {\n    // never"), k, F.lit("();\n    help"), k, F.lit("(\"{ run0() \");\n    if (id.isEmpty()) { return; }\n  }\n  private void help"), k, F.lit("(String s) { s"), n, F.lit(".run"), n, F.lit("(s); }\n}\n"),
    )
    files = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("svc"), (F.col("p_partkey") % 40).cast("string")).alias("repo"), F.concat(F.lit("src/S"), k, F.lit(".java")).alias("path"), content.alias("content"))
    return files.withColumn("size", F.octet_length("content").cast("long")).withColumn("mtime", F.timestamp_seconds(F.lit(0)))


def report_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Markdown report per supplier, in 10 repos, that refers to files of dao_corpus."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    k = F.col("s_suppkey").cast("string")
    content = F.concat(
        F.lit("# Report\n\nIntro.\n\n## Known Issues and risk\n- HIGH leak in `src/D"), k, F.lit(".java:3`\n- shared remark\n### Detail\n* medium case (src/D"), k, F.lit(".java:400)\n\n## Usage\nSee src/X"), k, F.lit(".java:1 and src/D"), k, F.lit(".java:3.\n")
    )
    return s.select(F.concat(F.lit("dao"), (F.col("s_suppkey") % 20).cast("string")).alias("repo"), F.concat(F.lit("docs/r"), k, F.lit(".md")).alias("path"), content.alias("content"))
