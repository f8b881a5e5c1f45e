"""Name resolution, degrees, hubs, dead nodes, bounded closure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import simple_name


def candidate_index(nodes: DataFrame) -> DataFrame:
    """repo, name, candidates: distinct node ids by the last part of their name."""
    return nodes.select("repo", "id").distinct().groupBy("repo", simple_name(F.col("id")).alias("name")).agg(F.sort_array(F.collect_list("id")).alias("candidates"))


def resolve_calls(calls: DataFrame, candidates: DataFrame) -> DataFrame:
    """calls(repo, caller, name, qualifier) -> with target, kind (edge, ambiguous) and confidence. A qualifier narrows the candidates if
    that leaves any; one candidate other than the caller is an edge; none, or the caller alone, drops the call. Candidates are grouped
    before the join, so every call stays one row."""
    j = calls.join(candidates, ["repo", "name"])
    narrowed = F.filter("candidates", lambda x: F.contains(F.lower(x), F.lower(F.col("qualifier"))))
    j = j.withColumn("_c", F.when(F.col("qualifier").isNotNull() & (F.size(narrowed) > 0), narrowed).otherwise(F.col("candidates")))
    one = F.size("_c") == 1
    return (
        j.filter(~one | (F.col("_c")[0] != F.col("caller")))
        .withColumn("target", F.when(one, F.col("_c")[0]))
        .withColumn("kind", F.when(one, "edge").otherwise("ambiguous"))
        .withColumn("confidence", F.when(one & F.col("qualifier").isNotNull(), "HIGH").when(one, "MEDIUM").otherwise("LOW"))
        .drop("_c", "candidates")
    )


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, in_degree, out_degree of every node."""
    into = edges.groupBy(F.col("to").alias("id")).agg(F.count("*").alias("in_degree"))
    out = edges.groupBy(F.col("from").alias("id")).agg(F.count("*").alias("out_degree"))
    return nodes.select("id").join(into, "id", "left").join(out, "id", "left").na.fill(0, ["in_degree", "out_degree"])


def hubs(degree: DataFrame) -> DataFrame:
    """Nodes whose in-degree is 5 or 15 % of all nodes at least, whichever is more."""
    bar = degree.agg(F.greatest(F.lit(5), F.ceil(F.count("*") * F.lit(15) / F.lit(100))).alias("_bar"))
    return degree.join(F.broadcast(bar), F.col("in_degree") >= F.col("_bar")).drop("_bar")


def dead(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.col("to").alias("id")).distinct(), "id", "left_anti")


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that is not a node."""
    ids = nodes.select("id")
    a = edges.join(ids, edges["from"] == ids["id"], "left_anti").withColumn("side", F.lit("from"))
    b = edges.join(ids, edges["to"] == ids["id"], "left_anti").withColumn("side", F.lit("to"))
    return a.unionByName(b)


#: Layers in the order in which they are tried, each with words that tell it, and the formats of pages.
LAYERS = (
    ("endpoint", ("controller", "router", "route", "endpoint", "action")),
    ("view", ("view", "component", "page", "screen", "activity", "fragment", "form", "jsp", "tsx", "vue")),
    ("dao", ("dao", "repository", "mapper", "persistence")),
    ("util", ("dto", "entity", "model", "config", "util", "helper", "constant", "filter", "middleware")),
)
PAGES = ("jsp", "jspx", "asp", "aspx", "ascx", "xaml", "razor", "cshtml", "vbhtml")


def classify(node_id, file, kind):
    """view, endpoint, dao, util or function: triggers and pages are views, else the first layer decides of which a word occurs in id, file or kind."""
    text = F.lower(F.concat_ws(" ", node_id, file, kind))
    told = [F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w)), layer) for layer, words in LAYERS]
    page = F.when((kind == "trigger") | F.substring_index(text, ".", -1).isin(*PAGES), "view")
    return F.coalesce(page, *told, F.lit("function"))


def neighbours(edges: DataFrame, node: DataFrame) -> DataFrame:
    """node(id) -> id, neighbour, type, direction (out or in): all edges at the nodes."""
    out = edges.join(node, edges["from"] == node["id"]).select("id", F.col("to").alias("neighbour"), "type", F.lit("out").alias("direction"))
    into = edges.join(node, edges["to"] == node["id"]).select("id", F.col("from").alias("neighbour"), "type", F.lit("in").alias("direction"))
    return out.unionByName(into)


def flag_dead(nodes: DataFrame, records: DataFrame) -> DataFrame:
    """nodes(repo, id, ...) with dead: whether a record(repo, id, confidence, evidence) of high confidence with evidence says so."""
    sure = records.filter("confidence = 'HIGH' and evidence is not null and evidence <> ''").select("repo", "id").distinct().withColumn("_d", F.lit(True))
    return nodes.join(sure, ["repo", "id"], "left").withColumn("dead", F.coalesce("_d", F.lit(False))).drop("_d")


def find_node(nodes: DataFrame, text: str) -> DataFrame:
    """The first node(id, label, file, ord) whose id equals the text, or whose label, file or id holds it, without regard to case."""
    low = text.lower()
    hit = (F.col("id") == text) | F.exists(F.array("label", "file", "id"), lambda x: F.contains(F.lower(x), F.lit(low)))
    return nodes.filter(hit).orderBy("ord").limit(1)


def top_hubs(degree: DataFrame, n: int = 15) -> DataFrame:
    """A report of the n nodes of highest in-degree, ties by id."""
    return degree.orderBy(F.desc("in_degree"), "id").limit(n).select("id", "in_degree")


def merge_nodes(rows: DataFrame, seq: str) -> DataFrame:
    """One row per (repo, id): of each attribute the last non-empty value in seq order."""
    rest = [c for c in rows.columns if c not in ("repo", "id", seq)]
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.col(seq)))
    return rows.groupBy("repo", "id").agg(*(last(c).alias(c) for c in rest))


def visible_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "from"), "from", "left_semi").join(ids.withColumnRenamed("id", "to"), "to", "left_semi")


def apply_patch(edges: DataFrame, nodes: DataFrame, patch: DataFrame) -> DataFrame:
    """patch(op, from, to, type) with a status: applied, duplicate (known already or repeated) or rejected (no add_edge, unknown end or type)."""
    ids = nodes.select("id").distinct().withColumn("_k", F.lit(True))
    p = patch.withColumn("_seq", F.monotonically_increasing_id()).join(ids.withColumnsRenamed({"id": "from", "_k": "_f"}), "from", "left").join(ids.withColumnsRenamed({"id": "to", "_k": "_t"}), "to", "left")
    p = p.join(edges.select("from", "to", "type", F.lit(True).alias("_e")).distinct(), ["from", "to", "type"], "left")
    fine = F.coalesce((F.col("op") == "add_edge") & F.col("_f") & F.col("_t") & F.col("type").isin("call", "inject", "inherit", "reflect"), F.lit(False))
    p = p.withColumn("_ok", fine)
    from pyspark.sql.window import Window as W

    nth = F.row_number().over(W.partitionBy("from", "to", "type", "_ok").orderBy("_seq"))
    return p.select(*patch.columns, F.when(~F.col("_ok"), "rejected").when(F.col("_e") | (nth > 1), "duplicate").otherwise("applied").alias("status"))


def project_graph(nodes: DataFrame, kinds: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """One graph of many projects. nodes(repo, id, ...) and edges by type (repo, from, to, and to_repo where an edge leaves its project) -> nodes with ids
    that carry their project, and edges (from, to, type), each once and none from a node to itself but between tables. Ends that are no nodes yet become ones."""
    name = lambda repo, c: F.concat_ws("::", repo, c)
    edges = None
    for kind, e in kinds.items():
        to_repo = F.coalesce("to_repo", "repo") if "to_repo" in e.columns else F.col("repo")
        e = e.select(name("repo", "from").alias("from"), name(to_repo, "to").alias("to"), F.lit(kind).alias("type"))
        e = e if kind == "table_relation" else e.filter(F.col("from") != F.col("to"))
        edges = e if edges is None else edges.unionByName(e)
    edges = edges.distinct()
    ends = edges.select(F.explode(F.array("from", "to")).alias("id"))
    all_ = nodes.select(name("repo", "id").alias("id"), F.lit(True).alias("known")).unionByName(ends.withColumn("known", F.lit(False)))
    return all_.groupBy("id").agg(F.bool_or("known").alias("known")), edges
