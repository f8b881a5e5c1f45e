"""Inverted index and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import tokens
from ..sources.tables import written


def inverted_index(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """token, item: one row each. Tokens are distinct within the row already, so nothing is shuffled."""
    return items.select(F.col(id_col).alias("item"), F.explode(tokens(F.col(text_col))).alias("token"))


def document_frequency(index: DataFrame) -> DataFrame:
    return index.groupBy("token").agg(F.count("*").alias("df"))


def rank(items: DataFrame, query: list[str], id_col: str, text_col: str, top: int = 200) -> DataFrame:
    """The best items by token hits (5 each) and substring hits (2 each)."""
    hit = lambda q: F.contains(F.lower(F.col(text_col)), F.lit(q.lower()))
    # A token is a stretch of the text, so a row without any substring hit scores nothing: those go before texts are split, and each other text is split once.
    found = items.filter(F.exists(F.array(*(hit(q) for q in query)), lambda x: x)).select(F.col(id_col).alias("item"), F.array(*(hit(q) for q in query)).alias("_hits"), tokens(F.col(text_col)).alias("_own"))
    score = sum((F.when(F.array_contains("_own", q), 5).otherwise(0) + F.when(F.col("_hits")[i], 2).otherwise(0) for i, q in enumerate(query)), F.lit(0))
    return found.select("item", score.alias("score")).orderBy(F.desc("score"), "item").limit(top)


def _grams(text: Column, size: int) -> Column:
    """Hashes of the distinct substrings of a size. The text is taken apart into characters once, so that this is linear in it."""
    begins = lambda c: F.sequence(F.lit(0), F.greatest(F.size(c) - size, F.lit(0)))
    of = lambda c: F.transform(begins(c), lambda i: F.xxhash64(*(F.get(c, i + k) for k in range(size))))
    return F.array_distinct(F.transform(F.array(F.split(text, "")), of)[0])


def containing(texts: DataFrame, terms: DataFrame, size: int) -> DataFrame:
    """repo, text_id, term_id: pairs of texts(repo, text_id, text) and terms(repo, term_id, term) where the text holds the term, of `size` characters or more.

    Substrings travel as hashes without their texts. A term stands under that of its substrings which the fewest texts hold (and is dropped if no text holds one of them), so that it meets few texts; each text then meets
    once the terms that are left for it, and they are compared in full."""
    terms = terms.filter(F.length("term") >= size)
    of_term = terms.select("repo", "term", F.explode(_grams(F.col("term"), size)).alias("_g")).distinct()
    of_text = texts.filter(F.length("text") >= size).select("repo", "text_id", F.explode(_grams(F.col("text"), size)).alias("_g"))
    met = written(of_text.join(of_term.select("repo", "_g").distinct(), ["repo", "_g"], "left_semi").distinct())
    held = met.groupBy("repo", "_g").agg(F.count("*").alias("_n"))
    rarest = of_term.join(held, ["repo", "_g"], "left").groupBy("repo", "term").agg(F.min(F.coalesce("_n", F.lit(0))).alias("_n"), F.min_by("_g", F.struct("_n", "_g")).alias("_g")).filter("_n > 0")
    few = met.join(rarest, ["repo", "_g"]).groupBy("repo", "text_id").agg(F.collect_set("term").alias("_terms"))
    hit = texts.join(few, ["repo", "text_id"]).select("repo", "text_id", F.explode(F.filter("_terms", lambda t: F.contains("text", t))).alias("term"))
    return hit.join(terms.select("repo", "term_id", "term"), ["repo", "term"]).select("repo", "text_id", "term_id").distinct()


def candidates(index: DataFrame, query: DataFrame) -> DataFrame:
    """index(token, item) and query(token) -> query token, item, distinct. A query token without postings falls back to all vocabulary that contains it or is contained in it, found by substrings of two characters in both
    directions; tokens have two at least."""
    vocabulary = index.select("token").distinct()
    exact = query.join(vocabulary, "token", "left_semi").select(F.col("token").alias("query"), "token")
    open_ = query.join(vocabulary, "token", "left_anti").distinct()
    row = lambda d, kind: d.select(F.lit("").alias("repo"), F.col("token").alias(f"{kind}_id"), F.col("token").alias(kind))
    holds = containing(row(vocabulary, "text"), row(open_, "term"), 2).select(F.col("term_id").alias("query"), F.col("text_id").alias("token"))
    held = containing(row(open_, "text"), row(vocabulary, "term"), 2).select(F.col("text_id").alias("query"), F.col("term_id").alias("token"))
    return exact.unionByName(holds).unionByName(held).join(index, "token").select("query", "item").distinct()


#: What a query's word counts for where it is the title, stands in the title, in the id, among the words, and in the text.
WEIGHTS = {"title_is": 20, "title": 10, "id": 7, "word": 5, "text": 2}


def rank_batch(items: DataFrame, queries: DataFrame, top: int = 200) -> DataFrame:
    """query_id, item, score, place: for every row of queries(query_id, query) the best of items(id, title, text), by the weights of its words, then title and id. All queries' words are looked for at once, each distinct one
    once; of a query, a task sends on no more than `top` items."""
    q = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("token")).distinct()
    words = q.select("token").distinct()
    terms = words.select(F.lit("").alias("repo"), F.col("token").alias("term_id"), F.col("token").alias("term"))
    i = items.select(F.col("id").cast("string").alias("id"), F.lower(F.coalesce("title", F.lit(""))).alias("title"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    inside = lambda c: containing(i.select(F.lit("").alias("repo"), F.col("id").alias("text_id"), F.lower(c).alias("text")), terms, 2).select(F.col("text_id").alias("id"), F.col("term_id").alias("token"), F.lit(WEIGHTS[c]).alias("w"))
    equal = i.select("id", F.col("title").alias("token")).join(words, "token", "left_semi").select("id", "token", F.lit(WEIGHTS["title_is"] - WEIGHTS["title"]).alias("w"))
    own = items.select(F.col("id").cast("string").alias("id"), F.explode(tokens(F.concat_ws(" ", "title", "text"))).alias("token")).join(words, "token", "left_semi").select("id", "token", F.lit(WEIGHTS["word"]).alias("w"))
    hits = inside("title").unionByName(inside("id")).unionByName(inside("text")).unionByName(equal).unionByName(own)
    score = hits.groupBy("token", "id").agg(F.sum("w").alias("w")).join(q, "token").groupBy("query_id", "id").agg(F.sum("w").alias("score"))
    d = score.join(i.select("id", "title"), "id")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "title", "id")
    return d.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top).select("query_id", F.col("id").alias("item"), "score", "place")


def search_records(records: DataFrame, text: str, limit: int = 100, file: str | None = None) -> DataFrame:
    """Records whose JSON form contains the text, without regard to case, and of one file if it is named (a filter that reaches the scan): a report of the first ones by all columns, 100 at most, and whether there are more."""
    limit = min(limit, 100)
    found = records if file is None else records.filter(F.col("file") == file)
    found = found.filter(F.contains(F.lower(F.to_json(F.struct(*records.columns))), F.lit(text.lower()))).orderBy(*records.columns).limit(limit + 1)
    w = W.orderBy(*records.columns)  # over limit + 1 rows
    return found.withColumn("_r", F.row_number().over(w)).withColumn("truncated", F.count("*").over(W.partitionBy()) > limit).filter(F.col("_r") <= limit).drop("_r")


def ordinals(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """df with ord, from 0 in the order of the columns, and how many rows there are. Rows are dealt out by ranges and sorted where they are; a partition's rows count on from those before it. No task sorts or numbers them all."""
    spark = df.sparkSession
    by = [F.col(c) for c in order]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = written(df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    # a row per partition
    sizes = placed.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_p", "_before")
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    return placed.join(F.broadcast(before), "_p").withColumn("ord", F.col("_before") + F.col("_i")).drop("_p", "_i", "_before"), total


def page(df: DataFrame, order: list[str], offset: int, size: int = 200) -> DataFrame:
    """One page, at most 200 rows, with ord, total, and next_offset (null behind the last page)."""
    size = min(size, 200)
    rows, total = ordinals(df, order)
    following = offset + size if offset + size < total else None
    return rows.filter(F.col("ord").between(offset, offset + size - 1)).withColumns({"total": F.lit(total).cast("long"), "next_offset": F.lit(following).cast("long")})


def search_items(kinds: dict[str, DataFrame]) -> DataFrame:
    """kind, id, repo, title, text: pages, symbols, statements, tables and endpoints as one table of items; ids are made unique by kind and repo."""
    rows = None
    for kind, t in kinds.items():
        own = F.concat_ws("::", "repo", F.col("id").cast("string"))
        one = t.select(F.lit(kind).alias("kind"), F.concat_ws(":", F.lit(kind), own).alias("id"), "repo", F.coalesce("title", F.col("id").cast("string")).alias("title"), F.coalesce("text", F.lit("")).alias("text"))
        rows = one if rows is None else rows.unionByName(one)
    return rows
