"""The registered queries of this subpackage: production parameters, whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, fill_middle, fixity, jaccard, langid, packing, quality, resampling, secret_scan, suffix_dedup, token_counts, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packing.pack(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))
    return p.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality.assess(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return q.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr", "threshold")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return r.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "n_shared")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    items = F.array_sort(F.transform("matches", lambda m: m["item_id"]))
    longest = F.coalesce(F.array_max(F.transform("matches", lambda m: m["n_words"])), F.lit(0))
    return found.withColumns({"n_hit": hit, "items": items}).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), longest.alias("longest_match"),
    )


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = secret_scan.scan_secrets(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["k"] < len(secret_scan.BASE))
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    number = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return s.select(
        "doc_id", number("assign").alias("n_assign"), number("access").alias("n_access"), number("hex").alias("n_hex"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda x: x["live"])).cast("long").alias("n_live"), F.size(F.filter("spans", lambda x: ~x["live"])).cast("long").alias("n_copied"),
    )


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    return langid.identify(_table(spark, sf_dir, "documents"), held_out).select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], rows.schema)
    none = F.lit(None).cast("string")
    events = rows.union(extra).select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), none.alias("message_id"), "role", "text")
    r = chat.read_back(chat.format_conversations(events))
    turns = F.array_join(F.zip_with("roles", "texts", lambda x, y: F.concat(x, F.lit("\n"), y, F.lit("\n"))), "")
    return r.select(
        "conv_id", F.size("texts").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op9_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits a replica of all pages in which every 11th record has one byte changed and every 17th is lost."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    primary = fixity.records(pages)
    replica = fixity.records(pages, damaged=F.coalesce(F.col("page_id") % 11 == 3, F.lit(False))).filter("id % 17 <> 5 or id is null")
    return _named(fixity.audit(primary, replica), primary)


def _named(problems: DataFrame, primary: DataFrame) -> DataFrame:
    """Problems with the primary's page_id, null for added records."""
    return problems.join(primary.select("file", "offset", "id"), ["file", "offset"], "left").select(F.col("id").alias("page_id"), "file", "offset", "problem", "length")


def op10_viterbi_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_pieces(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fill_middle.transform(_table(spark, sf_dir, "documents"))
    size = lambda c: F.length(c).cast("long").alias(f"{c}_chars")
    restored = fill_middle.restore(F.col("output"), F.col("form"))
    return d.select("doc_id", "n", "form", size("prefix"), size("middle"), F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), held_out)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    named = (
        op1_hilbert_packing, op2_quality_llr, op3_suffix_dedup, op4_decontamination, op5_secret_scan, op6_language_id, op7_jaccard_join, op8_chat_format, op9_merkle_fixity,
        op10_viterbi_counts, op11_importance_resampling, op12_fill_middle, op13_toxicity, pipeline,
    )
    return {f.__name__: f for f in named}


_ESCAPED = "replace(replace(replace(replace({0}, '~', '~0'), '<', '~1'), '[', '~2'), '|', '~3')"

ORACLE = {
    "op8_chat_format": f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS txt FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || txt || chr(10), '' ORDER BY turn, role, txt)) AS turns_sha256,
  CAST(coalesce(sum(length(txt)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(txt, '' ORDER BY turn, role, txt) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_ESCAPED.format("role")}) + length({_ESCAPED.format("txt")}) + 16) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id""",
    "op4_decontamination": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT *, row_number() OVER () AS x FROM (SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)),
g AS (SELECT item, x, p AS place, least(10, len(w)) AS k, array_to_string(w[p:p + least(10, len(w)) - 1], ' ') AS win FROM (SELECT item, x, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
k AS (SELECT DISTINCT k FROM g),
o AS (SELECT r, k, p, array_to_string(w[p:p + k - 1], ' ') AS win FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, k WHERE len(w) >= k)),
h AS (SELECT o.r, o.p, o.k, g.item, g.x, g.place FROM o JOIN g ON o.k = g.k AND o.win = g.win),
n AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS q FROM (SELECT DISTINCT r, p, k FROM h)) GROUP BY r),
y AS (SELECT r, max(n) AS longest_match FROM (SELECT r, k - 1 + count(*) AS n FROM (SELECT r, x, k, p - place AS diag, p - row_number() OVER (PARTITION BY r, x, k, p - place ORDER BY p) AS island FROM h) GROUP BY r, x, k, diag, island) GROUP BY r),
m AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated,
 CAST(coalesce(longest_match, 0) AS BIGINT) AS longest_match FROM d LEFT JOIN n USING (r) LEFT JOIN m USING (r) LEFT JOIN y USING (r)""",
    "op7_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS own FROM s GROUP BY doc_id),
l AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
 GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
c AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT c.a, l.b FROM c JOIN l ON l.a = c.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(c.b) FROM c WHERE c.a = d.doc_id) AS component_id,
 CASE WHEN n.n IS NULL THEN d.doc_id ELSE min(d.doc_id) OVER (PARTITION BY n.own) END AS class_id FROM d LEFT JOIN n USING (doc_id)""",
    "op11_importance_resampling": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
f AS (SELECT r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM d), e AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM q),
u AS (SELECT DISTINCT g FROM (SELECT g FROM f UNION ALL SELECT g FROM e)),
b AS MATERIALIZED (SELECT g, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, strlen(g)), lambda i: ('0x' || hex(encode(g))[2 * i + 1:2 * i + 2])::BIGINT)), lambda c, x: xor(@CRC@[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) % 10000 AS k FROM u),
s AS (SELECT k, count(*) AS s FROM f JOIN b USING (g) GROUP BY k), t AS (SELECT k, count(*) AS t FROM e JOIN b USING (g) GROUP BY k),
z AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS s, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE AS t),
a AS (SELECT s.k, CAST(floor(1000 * ln((coalesce(t.t, 0) + 1)::DOUBLE * (z.s + 10000) / ((s.s + 1)::DOUBLE * (z.t + 10000)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (k), z),
m AS (SELECT r, count(*) AS n_features, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM f JOIN b USING (g) JOIN a USING (k) GROUP BY r),
x AS (SELECT doc_id, len(w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
 coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || sha256('7:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN m USING (r)),
o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM x WHERE words >= 20)
SELECT x.doc_id, n_features, weight, score, CASE WHEN rank <= 25 * n // 100 THEN rank END AS rank FROM x LEFT JOIN o USING (doc_id)""".replace("@CRC@", str(resampling.crc_tables()[0].tolist())),
    "op12_fill_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id) AS x FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS us, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, len(us) AS n, least(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS a, greatest(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS b FROM u),
p AS (SELECT *, array_to_string(us[1:a], '') AS pre, array_to_string(us[a + 1:b], '') AS mid, array_to_string(us[b + 1:], '') AS suf,
 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""",
    "op9_merkle_fixity": """
WITH raw AS (
  SELECT page_id, CAST(floor(page_id / 4096) AS BIGINT) AS file,
    'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
    || 'Content-Length: ' || CAST(strlen(coalesce(html, '')) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS r
  FROM pages
), placed AS (
  SELECT page_id, file, strlen(r) AS length, sum(strlen(r)) OVER (PARTITION BY file ORDER BY page_id ROWS UNBOUNDED PRECEDING) - strlen(r) AS off FROM raw
)
SELECT page_id, file, CAST(off AS BIGINT) AS "offset", CASE WHEN page_id % 17 = 5 THEN 'missing' ELSE 'changed' END AS problem, length
FROM placed WHERE page_id % 17 = 5 OR page_id % 11 = 3""",
}


def oracle_sql() -> dict:
    return dict(ORACLE)
