"""Data-quality checks of an index; each returns its violations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.markup import is_rule


def check_schema(df: DataFrame, key: list[str], rules: list[tuple]) -> DataFrame:
    """key, column, rule for each broken rule; rules are (column, "required"), (column, "enum", values) or (column, "minimum", least). One pass, no shuffle."""

    def broken(column: str, rule: str, value=None):
        c = F.col(column)
        return c.isNull() if rule == "required" else ~c.isin(*value) if rule == "enum" else c < value

    found = F.array_compact(F.array(*(F.when(broken(*r), F.struct(F.lit(r[0]).alias("column"), F.lit(r[1]).alias("rule"))) for r in rules)))
    return df.select(*key, F.explode(found).alias("_v")).select(*key, "_v.column", "_v.rule")


#: JSON types by what a value's type is called.
KINDS = {"OBJECT": "object", "ARRAY": "array", "STRING": "string", "BOOLEAN": "boolean", "VOID": "null", "BIGINT": "integer"}


def _kind(value):
    """The JSON type of a value (variant): integer is also number."""
    name = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    kinds = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))
    return F.coalesce(kinds[name], F.when(name.isin("DECIMAL", "DOUBLE", "FLOAT"), F.when(F.try_variant_get(value, "$", "double") == F.floor(F.try_variant_get(value, "$", "double")), "integer").otherwise("number")), F.lit("other"))


def _let(value, body):
    """body(value), with the value worked out once however often the body uses it: nested rules would else repeat it at every level."""
    return F.transform(F.array(value), body)[0]


def _violations(value, rules: dict, path):
    """array<struct<path, rule>> of a value (variant) against rules: type, enum, minimum, required, properties, items. Deeper rules count only where the type is right."""
    return _let(value, lambda v: _let(_kind(v), lambda kind: _let(path, lambda at: _broken(v, kind, at, rules))))


def _within(rules: dict, path):
    return lambda value: _violations(value, rules, path)


def _broken(value, kind, path, rules: dict):
    none = F.array().cast("array<struct<path:string,rule:string>>")
    one = lambda at, rule: F.array(F.struct(at.alias("path"), F.lit(rule).alias("rule")))
    types = [rules["type"]] if isinstance(rules.get("type"), str) else list(rules.get("type", []))
    parts = []
    if "enum" in rules:
        parts.append(F.when(F.coalesce(F.try_variant_get(value, "$", "string").isin(*map(str, rules["enum"])), F.lit(False)), none).otherwise(one(path, "enum")))
    if "minimum" in rules:
        parts.append(F.when(kind.isin("integer", "number") & (F.try_variant_get(value, "$", "double") < rules["minimum"]), one(path, "minimum")).otherwise(none))
    child = lambda name: F.try_variant_get(value, f"$['{name}']", "variant")
    at = lambda name: F.concat(path, F.lit(f".{name}"))
    for name in rules.get("required", ()):
        parts.append(F.when((kind == "object") & child(name).isNull(), one(at(name), "required")).otherwise(none))
    for name, inner in rules.get("properties", {}).items():
        # no value, no element to look at
        there = F.filter(F.array(child(name)), lambda c: (kind == "object") & c.isNotNull())
        parts.append(F.flatten(F.transform(there, _within(inner, at(name)))))
    if "items" in rules:
        each = F.when(kind == "array", F.try_variant_get(value, "$", "array<variant>")).otherwise(F.array().cast("array<variant>"))
        parts.append(F.flatten(F.transform(each, lambda x, i: _violations(x, rules["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))))
    below = F.concat(*parts) if parts else none
    return F.when(kind.isin(*types) | (F.lit("number" in types) & (kind == "integer")), below).otherwise(one(path, "type")) if types else below


def check_documents(docs: DataFrame, key: list[str], column: str, rules: dict) -> DataFrame:
    """key, path, rule: what breaks the rules in JSON documents, with the place ($.a[2].b) of each value; `invalid` where a text is no JSON. Rules are nested as the documents are; one pass, no shuffle."""
    v = docs.select(*key, F.col(column).alias("_t"), F.try_parse_json(column).alias("_v"))
    broken = F.when(F.col("_v").isNull(), F.array(F.struct(F.lit("$").alias("path"), F.lit("invalid").alias("rule")))).otherwise(_violations(F.col("_v"), rules, F.lit("$")))
    return v.select(*key, F.explode(broken).alias("_b")).select(*key, "_b.path", "_b.rule")


def check_evidence_paths(facts: DataFrame, files: DataFrame) -> DataFrame:
    """repo, file, problem: files that facts name but the corpus lacks (MISSING), and absolute or climbing paths (UNSAFE)."""
    named = facts.select("repo", "file").filter("file is not null").distinct()
    unsafe = F.col("file").rlike(r"^/|^[A-Za-z]:|(^|/)\.\.(/|$)")
    lost = named.filter(~unsafe).join(files.select("repo", F.col("path").alias("file")), ["repo", "file"], "left_anti")
    return named.filter(unsafe).withColumn("problem", F.lit("UNSAFE")).unionByName(lost.withColumn("problem", F.lit("MISSING")))


def source_references(docs: DataFrame) -> DataFrame:
    """repo, doc, file, line: distinct references such as `src/a.ts:12` of each document (repo, path, content). Words between blanks, backticks and brackets
    are taken apart at colons: a file with an extension, then a number; before it, two colons and a repo may stand."""
    word = F.split("content", r"[\s`()\[\]<>,;\"']+")
    part = F.transform(word, lambda w: F.split(F.rtrim(w, F.lit(".")), ":"))
    is_ref = lambda p: (F.size(p) >= 2) & F.get(p, F.size(p) - 1).rlike(r"^[0-9]+$") & F.get(p, F.size(p) - 2).rlike(r"^[\w@+~./\\-]*\.[A-Za-z0-9]+$")
    found = F.transform(F.filter(part, is_ref), lambda p: F.struct(F.when((F.size(p) == 4) & (p[1] == "") & (p[0] != ""), F.concat(p[0], F.lit("::"), p[2])).otherwise(F.get(p, F.size(p) - 2)).alias("file"), F.get(p, F.size(p) - 1).try_cast("bigint").alias("line")))
    return docs.select("repo", F.col("path").alias("doc"), F.explode(F.array_distinct(found)).alias("_r")).select("repo", "doc", "_r.file", "_r.line")


def check_line_references(references: DataFrame, files: DataFrame) -> DataFrame:
    """References(repo, file, line, ...) with a status: OK, MISSING (no such file) or OUT_OF_RANGE. A file of another repo is named with it: `repo::path`. Only line counts are shuffled, never contents."""
    n = files.select(F.col("repo").alias("_repo"), F.col("path").alias("_file"), F.size(F.split("content", "\n")).alias("_n"))
    at = F.position(F.lit("::"), "file")
    d = references.withColumns({"_repo": F.when(at > 1, F.substr("file", F.lit(1), at - 1)).otherwise(F.col("repo")), "_file": F.when(at > 1, F.substr("file", at + 2, F.length("file"))).otherwise(F.col("file"))})
    j = d.join(n, ["_repo", "_file"], "left")
    return j.withColumn("status", F.when(F.col("_n").isNull(), "MISSING").when(F.col("line").between(1, F.col("_n")), "OK").otherwise("OUT_OF_RANGE")).select(*references.columns, "status")


def evidence_density(references: DataFrame, files: DataFrame) -> DataFrame:
    """repo, refs, needed, enough: distinct references against a fifth of the files, 5 at least and 20 at most."""
    need = files.groupBy("repo").agg(F.least(F.lit(20), F.greatest(F.lit(5), F.ceil(F.count("*") / 5))).alias("needed"))
    got = references.select("repo", "file", "line").distinct().groupBy("repo").agg(F.count("*").alias("refs"))
    return need.join(got, "repo", "left").na.fill(0, ["refs"]).withColumn("enough", F.col("refs") >= F.col("needed"))


def score(checks: DataFrame) -> DataFrame:
    """repo, score, status of checks(repo, level): 12 points off for each FAIL, 3 for each WARN."""
    g = checks.groupBy("repo").agg(F.count_if(F.col("level") == "FAIL").alias("fails"), F.count_if(F.col("level") == "WARN").alias("warns"))
    status = F.when(F.col("fails") > 0, "FAIL").when(F.col("warns") > 0, "WARN").otherwise("PASS")
    return g.select("repo", F.greatest(F.lit(0), 100 - 12 * F.col("fails") - 3 * F.col("warns")).alias("score"), status.alias("status"))


def check_ai_evidence(edges: DataFrame) -> DataFrame:
    """Edges of the enrichment that lack evidence, a file or a line."""
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return edges.filter((F.col("origin") == "ai-enrichment") & (empty("evidence") | empty("file") | F.col("line").isNull()))


def check_required(repos: DataFrame, required: tuple[str, ...], present: DataFrame, code: str) -> DataFrame:
    """repo, path, code: what each repo must have, by name, and does not."""
    need = repos.select("repo").distinct().select("repo", F.explode(F.array(*map(F.lit, required))).alias("path"))
    return need.join(present.select("repo", "path"), ["repo", "path"], "left_anti").withColumn("code", F.lit(code))


def check_declared(declared: DataFrame, present: DataFrame) -> DataFrame:
    """repo, index: indexes that a repo's metadata names and its folder lacks."""
    return declared.select("repo", "index").distinct().join(present.select("repo", "index"), ["repo", "index"], "left_anti")


def check_unresolved(meta: DataFrame, unresolved: DataFrame) -> DataFrame:
    """repo, said, found: repos whose count of unresolved relations differs from what is stored."""
    n = unresolved.groupBy("repo").agg(F.count("*").alias("found"))
    d = meta.select("repo", F.col("unresolved_count").cast("long").alias("said")).join(n, "repo", "left").na.fill(0, ["found"])
    return d.filter(~F.col("said").eqNullSafe(F.col("found")))


def content_lines(text):
    """How many lines say something: no blank lines, headings, fences or rules of tables."""
    line = F.transform(F.split(text, "\n"), lambda x: F.trim(x, F.lit(" \t\r")))
    mark = lambda x: F.substring_index(x, " ", 1)
    heading = lambda x: (x != mark(x)) & (F.translate(mark(x), "#", "") == "") & (F.length(mark(x)) <= 6)
    return F.size(F.filter(line, lambda x: (x != "") & ~heading(x) & ~x.startswith("```") & ~is_rule(x)))


def has_code(text):
    """A fenced block that holds more than dots or a bracketed stand-in: a walk over the lines that knows whether a fence is open and what it has held."""
    line = F.transform(F.split(text, "\n"), lambda x: F.trim(x, F.lit(" \t\r")))
    stand_in = lambda x: (x == "") | (x == "...") | (x.startswith("[") & x.endswith("]"))
    state = F.struct(F.lit(False).alias("open"), F.lit(False).alias("said"), F.lit(False).alias("found"))

    def step(s, x):
        fence = x.startswith("```")
        return F.struct((fence != s["open"]).alias("open"), (s["open"] & ~fence & (s["said"] | ~stand_in(x))).alias("said"), (s["found"] | (fence & s["open"] & s["said"])).alias("found"))

    return F.aggregate(line, state, step, lambda s: s["found"])


#: Least Hangul characters and least lines of a report by tier.
LEAST = {"Full": (500, 35), "Standard": (350, 25), "Lite": (250, 18)}


def check_sections(reports: DataFrame, sections: DataFrame, required: tuple[str, ...], may_be_bare: tuple[str, ...] = ()) -> DataFrame:
    """repo, code, what for reports(repo, tier, content) with their sections(repo, level, title, body): required sections of level 2 that are missing or say
    nothing, and reports of too few Hangul characters or lines for their tier. Sections are cut to flags before they are joined."""
    s = sections.filter("level = 2").select("repo", "title", (content_lines("body") > 0).alias("_said"))
    need = reports.select("repo", F.explode(F.array(*map(F.lit, required))).alias("what"))
    g = need.join(s, "repo", "left").groupBy("repo", "what").agg(F.count_if(F.contains("title", F.col("what"))).alias("_n"), F.coalesce(F.bool_or(F.col("_said") & F.contains("title", F.col("what"))), F.lit(False)).alias("_said"))
    code = F.when(F.col("_n") == 0, "ANALYZER_SECTION").when(~F.col("_said") & ~F.col("what").isin(*may_be_bare), "ANALYZER_SECTION_DETAIL")
    by_section = g.select("repo", code.alias("code"), "what").filter("code is not null")
    least = lambda i: F.when(F.col("tier") == "Full", LEAST["Full"][i]).when(F.col("tier") == "Standard", LEAST["Standard"][i]).otherwise(LEAST["Lite"][i])
    short = F.array_compact(F.array(F.when(F.regexp_count("content", F.lit("[가-힣]")) < least(0), F.lit("ANALYZER_LANGUAGE")), F.when(content_lines("content") < least(1), F.lit("ANALYZER_DETAIL"))))
    return by_section.unionByName(reports.select("repo", F.explode(short).alias("code"), F.lit(None).cast("string").alias("what")))


def pattern_coverage(candidates: DataFrame, documented: DataFrame, held: DataFrame) -> DataFrame:
    """repo, required, satisfied, enough of candidates(repo, tier, slug), documented(repo, title) and held(repo, slug): every candidate is required, of Lite two
    at most; documented categories count, and held candidates that no category names."""
    c = candidates.select("repo", "tier", "slug").distinct()
    n = c.groupBy("repo").agg(F.max("tier").alias("_t"), F.count("*").alias("_n"))
    required = F.when((F.col("_n") > 1) & (F.col("_t") == "Lite"), F.least(F.lit(2), "_n")).otherwise(F.col("_n"))
    titles = documented.groupBy("repo").agg(F.count("*").alias("_d"))
    # categories of one repo are few; their titles are compared with its slugs only
    named = c.join(documented.select("repo", F.lower("title").alias("_l")), "repo").filter(F.contains("_l", F.lower("slug"))).select("repo", "slug")
    kept = held.select("repo", "slug").distinct().join(c.select("repo", "slug"), ["repo", "slug"], "left_semi").join(named, ["repo", "slug"], "left_anti").groupBy("repo").agg(F.count("*").alias("_h"))
    d = n.join(titles, "repo", "left").join(kept, "repo", "left").na.fill(0, ["_d", "_h"])
    d = d.select("repo", required.alias("required"), (F.col("_d") + F.col("_h")).alias("satisfied"))
    return d.withColumn("enough", (F.col("required") <= 1) | (F.col("satisfied") >= F.col("required")))


def stale(files: DataFrame, meta: DataFrame) -> DataFrame:
    """repo, newest, generated_at, stale: a source is newer than the index."""
    m = files.groupBy("repo").agg(F.max("mtime").alias("newest"))
    return meta.select("repo", "generated_at").join(m, "repo", "left").withColumn("stale", F.coalesce(F.col("newest") > F.col("generated_at"), F.lit(False)))
