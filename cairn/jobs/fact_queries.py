"""Queries over symbols, keys and indexes, and single nodes of a graph, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, relations, symbols
from ..sources.corpus import in_scope, service_corpus


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _key(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def class_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = symbols.build_symbols(symbols.facts(in_scope(service_corpus(spark, sf_dir))))
    return s.select("repo", "id", "type", F.array_join(F.transform("methods", lambda m: m["name"]), ",").alias("methods"))


def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One DDL file per supplier: quoted names, keys of the table, a key over two columns and an index."""
    s, k, n = _t(spark, sf_dir, "supplier"), _key("", "s_suppkey"), _key("", "s_nationkey")
    text = F.concat(
        F.lit('CREATE TABLE IF NOT EXISTS "shop"."s'), k, F.lit('" (\n  id INT NOT NULL, -- key; own\n  nation_id INT,\n  code VARCHAR(20),\n  CONSTRAINT pk PRIMARY KEY (id),\n  CONSTRAINT fk FOREIGN KEY (nation_id) REFERENCES n'),
        n, F.lit(" (id),\n  UNIQUE KEY both (nation_id, code)\n);\nCREATE "), F.when(F.col("s_suppkey") % 2 == 0, "UNIQUE ").otherwise(""), F.lit("INDEX ix"), k, F.lit(" ON s"), k, F.lit(" (code, id DESC)"),
    )
    return s.select(F.concat(F.lit("db"), (F.col("s_suppkey") % 5).cast("string")).alias("repo"), F.concat(F.lit("s"), k, F.lit(".sql")).alias("path"), text.alias("content"))


def table_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = relations.columns(relations.extract_ddl(_tables(spark, sf_dir)))
    return c.select("repo", F.col("table").alias("table_name"), F.col("column").alias("column_name"), "primary_key", F.col("unique").alias("is_unique"), "ref_table", "ref_column")


def table_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _tables(spark, sf_dir)
    x = relations.attach_indexes(relations.extract_ddl(files), relations.extract_indexes(files))
    return x.select("repo", F.col("table").alias("table_name"), F.col("index").alias("index_name"), F.col("unique").alias("is_unique"), F.array_join("columns", ",").alias("column_names"))


def node_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations between their suppliers and their region."""
    into = _t(spark, sf_dir, "supplier").select(_key("s", "s_suppkey").alias("from"), _key("n", "s_nationkey").alias("to"), F.lit("call").alias("type"))
    out = _t(spark, sf_dir, "nation").select(_key("n", "n_nationkey").alias("from"), _key("r", "n_regionkey").alias("to"), F.lit("sql").alias("type"))
    return graph.neighbours(into.union(out), out.select(F.col("from").alias("id")))


def dead_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, dead where a label of high confidence (toxic) has evidence (a quality)."""
    nodes = _t(spark, sf_dir, "documents").select(F.lit("r").alias("repo"), F.col("doc_id").alias("id"))
    records = _t(spark, sf_dir, "labels").select(F.lit("r").alias("repo"), F.col("doc_id").alias("id"), F.when(F.col("toxic") == 1, "HIGH").otherwise("LOW").alias("confidence"), F.col("quality").cast("string").alias("evidence"))
    return graph.flag_dead(nodes, records).select("id", "dead")


def found_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part").select(_key("p", "p_partkey").alias("id"), F.col("p_name").alias("label"), F.col("p_type").alias("file"), F.col("p_partkey").alias("ord"))
    return graph.find_node(p, "P42").select("id", "label")


_QUERIES = (class_symbols, table_columns, table_indexes, node_neighbours, dead_flags, found_node)

ORACLE = {
    "class_symbols": "SELECT 'svc' || (p_partkey % 40) AS repo, 'svc.S' || p_partkey AS id, 'class' AS type, 'run' || p_partkey || ',help' || p_partkey AS methods FROM part",
    "table_columns": """SELECT 'db' || (s_suppkey % 5) AS repo, 'shop.s' || s_suppkey AS table_name, c AS column_name, c = 'id' AS primary_key, c = 'id' AS is_unique,
 CASE WHEN c = 'nation_id' THEN 'n' || s_nationkey END AS ref_table, CASE WHEN c = 'nation_id' THEN 'id' END AS ref_column FROM (SELECT *, unnest(['id', 'nation_id', 'code']) AS c FROM supplier)""",
    "table_indexes": "SELECT 'db' || (s_suppkey % 5) AS repo, 'shop.s' || s_suppkey AS table_name, 'ix' || s_suppkey AS index_name, s_suppkey % 2 = 0 AS is_unique, 'code,id' AS column_names FROM supplier",
    "node_neighbours": """SELECT 'n' || n_nationkey AS id, 'r' || n_regionkey AS neighbour, 'sql' AS type, 'out' AS direction FROM nation
 UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 'call', 'in' FROM supplier""",
    "dead_flags": "SELECT doc_id AS id, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND quality IS NOT NULL) AS dead FROM documents",
    "found_node": """SELECT 'p' || p_partkey AS id, p_name AS label FROM part WHERE 'p' || p_partkey LIKE '%p42%' OR lower(p_name) LIKE '%p42%' OR lower(p_type) LIKE '%p42%' ORDER BY p_partkey LIMIT 1""",
}


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict:
    return dict(ORACLE)
