r"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Candidates are found per text by the base patterns (assign, access, hex) and by one broader pattern (`owned`: 32 or
more characters of a token with upper and lower case letters and digits). Each candidate's value is hashed; over
the whole corpus its distinct repositories and owners are counted. A value that `max_owners` owners and `max_repos` repositories at most
hold is owner-specific and looks live; one that more hold is a copied example. Base spans always stay in the report; broader
candidates are added only where they look live and touch no base span. `redact` cuts what looks live and leaves copied examples.

Offsets are code points. They come from lengths: the text between matches and the matches, in turn. Only rows with
candidates are shuffled, counts are combined before each shuffle, and values with very many uses meet their counts by a broadcast (`skew_join`),
so that one value or owner may hold any share of them.

Defined cases: a null text is empty; a null owner or repository is one more, unknown, owner or repository; repeated rows
are reported each and count once as an owner's; an empty table gives no rows; further columns are ignored or
carried, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import materialize, skew_join

#: kind: (order, cheap sign of a match, pattern, group of the value, least length of the value)
KINDS = {
    "assign": (0, r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]""", r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    "access": (1, r"AKIA[A-Z0-9]{16}", r"(AKIA[A-Z0-9]+)", 1, 20),
    "hex": (2, r"[0-9a-f]{24}", r"(?<![0-9a-f])([0-9a-f]{24,})", 1, 24),
    "owned": (3, r"[A-Za-z0-9_+/]{32}", r"(?<![A-Za-z0-9_+/])(?=[A-Za-z0-9_+/]*[A-Z])(?=[A-Za-z0-9_+/]*[a-z])(?=[A-Za-z0-9_+/]*[0-9])([A-Za-z0-9_+/]{32,})", 1, 32),
}
#: The kinds of the base report.
BASE = ("assign", "access", "hex")


def _found(text: Column, kind: str) -> Column:
    """array<struct<kind, i, gap, whole, value>>: matches in order, gap being the text before each."""
    order, sign, pattern, group, _ = KINDS[kind]
    gaps = F.transform(F.split(text, pattern), lambda x: F.length(x))
    whole = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.length(x))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    rows = F.transform(value, lambda v, i: F.struct(F.lit(order).alias("k"), i.alias("i"), F.get(gaps, i).alias("gap"), F.get(whole, i).alias("whole"), v.alias("value")))
    return F.when(F.rlike(text, F.lit(sign)), rows)


def candidates(documents: DataFrame, id_col: str, text_col: str, repo_col: str, owner_col: str) -> tuple[DataFrame, DataFrame]:
    """(row, id) of every document, and (row, repo, owner, k, start, end, value) of every candidate that is long enough."""
    t = F.coalesce(F.col("t"), F.lit(""))
    d = documents.select(
        F.col(id_col).alias("id"), F.col(repo_col).cast("string").alias("repo"), F.col(owner_col).cast("string").alias("owner"), F.col(text_col).cast("string").alias("t")
    ).withColumn("row", F.monotonically_increasing_id())
    none = F.array().cast("array<struct<k:int,i:int,gap:int,whole:int,value:string>>")
    found = F.concat(*(F.coalesce(_found(t, kind), none) for kind in KINDS))
    d = materialize(d.select("row", "id", "repo", "owner", found.alias("found")))
    run = W.partitionBy("row", "k").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    end = F.sum((F.col("gap") + F.col("whole")).cast("long")).over(run)
    spans = d.select("row", "repo", "owner", F.inline("found")).withColumn("end", end).withColumn("start", F.col("end") - F.col("whole"))
    least = F.create_map(*(F.lit(x) for kind in KINDS.values() for x in (kind[0], kind[4])))
    return d.select("row", "id"), spans.filter(F.length("value") >= least[F.col("k")]).select("row", "repo", "owner", "k", "start", "end", "value")


def ownership(spans: DataFrame) -> DataFrame:
    """h, n_owners, n_repos, n_uses for each candidate value's hash over the corpus."""
    one = spans.select("h", F.coalesce("owner", F.lit("\0")).alias("owner"), F.coalesce("repo", F.lit("\0")).alias("repo"))
    pairs = one.groupBy("h", "owner", "repo").agg(F.count("*").alias("n"))
    owners = pairs.groupBy("h", "owner").agg(F.sum("n").alias("n"))
    repos = pairs.groupBy("h", "repo").agg(F.lit(1).alias("one"))
    return (
        owners.groupBy("h").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_uses"))
        .join(repos.groupBy("h").agg(F.count("*").alias("n_repos")), "h")
    )


def scan_secrets(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str | None = None, owner_col: str = "source", max_owners: int = 1, max_repos: int = 20
) -> DataFrame:
    """id_col and spans: array<struct<start, k, kind, end, n_owners, n_repos, live>> by start, then kind; a row per
    document. Without repo_col each document is a repository of its own."""
    rows, spans = candidates(documents, id_col, text_col, repo_col or id_col, owner_col)
    spans = materialize(spans.withColumn("h", F.xxhash64("value", F.sha2("value", 256))).drop("value"))
    judged = skew_join(spans, ownership(spans), ["h"], "n_uses").withColumn("live", (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos))
    names = F.create_map(*(F.lit(x) for kind, v in KINDS.items() for x in (v[0], kind)))
    judged = judged.filter(F.col("live") | (F.col("k") < len(BASE)))
    per = judged.groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), "k", names[F.col("k")].alias("kind"), F.col("end").cast("long").alias("end"), "n_owners", "n_repos", "live"))).alias("spans")
    )
    # broader candidates that touch a base span tell nothing new
    base = lambda s: s["k"] < len(BASE)
    per = per.withColumn("base", F.filter("spans", base)).withColumn(
        "spans", F.filter("spans", lambda s: base(s) | ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    )
    empty = F.array().cast(per.schema["spans"].dataType)
    return rows.join(per, "row", "left").select(F.col("id").alias(id_col), F.coalesce("spans", empty).alias("spans"))


def _signed(text: Column) -> Column:
    """Whether a text has the sign of any kind; a plain search for the marks of an assignment spares most texts its pattern."""
    sign = (F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))) & F.rlike(text, F.lit(KINDS["assign"][1]))
    for kind in ("access", "hex", "owned"):
        sign |= F.rlike(text, F.lit(KINDS[kind][1]))
    return sign


def redact(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", mark: str = "[secret]", max_owners: int = 1, max_repos: int = 20) -> DataFrame:
    """The documents, with all their columns, in which every span that looks live is replaced by `mark`. Only texts with the sign of a secret are
    searched and shuffled to meet their spans, by the hash of id and text; all others pass in their place."""
    own = [f"c{i}" for i in range(len(documents.columns))]
    at = dict(zip(documents.columns, own, strict=True))
    docs, text = documents.toDF(*own), F.col(at[text_col])
    signed = F.coalesce(_signed(text), F.lit(False))
    hit = docs.filter(signed).withColumn("key", F.xxhash64(at[id_col], text))
    spans = scan_secrets(hit.select("key", F.col(at[id_col]).alias("repo"), F.col(at[owner_col]).alias("owner"), text.alias("t")), "key", "t", "repo", "owner", max_owners, max_repos)
    live = F.transform(F.filter("spans", lambda s: s["live"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    spans = spans.select("key", live.alias("spans")).filter(F.size("spans") > 0).groupBy("key").agg(F.max("spans").alias("spans"))
    # text kept before each span: from the furthest end so far to the start
    state = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    step = lambda a, s: F.when(s["start"] >= a["at"], F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit(mark)).alias("out"))).otherwise(
        F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))
    )
    cut = F.aggregate("spans", state, step, lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text))))
    changed = hit.join(spans, "key", "left").withColumn(at[text_col], F.when(F.col("spans").isNotNull(), cut).otherwise(text)).select(*own)
    return docs.filter(~signed).union(changed).toDF(*documents.columns)
