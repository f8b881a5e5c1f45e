"""What starts code: events, schedules and process entries, bound to methods by name; and the routines of languages without types. Lines are told by their words, elements by their attributes, code by its stored facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import spans
from ..sources.corpus import extension
from . import symbols
from .contracts import lines

#: Pages, and the attributes of their elements that name a handler.
PAGES = "jsp jspx tag aspx ascx ashx asmx xaml cshtml vbhtml razor html htm".split()
HANDLERS = "onclick click oncommand command".split()
#: Words that begin a routine, by format, and words that may stand before them.
ROUTINES = {"vb": "sub function", "vbs": "sub function", "asp": "sub function", "php": "function", "rb": "def", "abap": "form method function module"}
BEFORE = "public private protected friend static abstract final".split()
COBOL = "cbl cob cpy".split()
#: Divisions and ends of blocks of a COBOL program, which are no routines.
DIVISIONS = "IDENTIFICATION ENVIRONMENT DATA PROCEDURE WORKING-STORAGE LINKAGE END-IF END-PERFORM".split()


def _name(text: Column) -> Column:
    """The name that a text begins with, without `this.`; empty if it begins with none."""
    return F.regexp_extract(F.regexp_replace(F.ltrim(text), r"^this\.", ""), r"^[A-Za-z_]\w*", 0)


def _events(t: DataFrame) -> DataFrame:
    """C#: what stands on both sides of +=. On the left an object and its event, on the right a method, or a delegate made of one."""
    left = F.split(F.element_at(F.split(F.rtrim(F.substring_index("text", "+=", 1)), r"[\s(;{]"), -1), r"\.")
    right = F.ltrim(F.element_at(F.split("text", r"\+="), 2))
    handler = _name(F.when(right.startswith("new "), F.substr(right, F.position(F.lit("("), right) + 1, F.length(right))).otherwise(right))
    d = t.filter((extension(F.col("path")) == "cs") & F.contains("text", F.lit("+="))).select("repo", "path", "line", left.alias("l"), handler.alias("h"))
    return d.filter((F.size("l") > 1) & (F.col("h") != "")).select("repo", "path", "line", F.concat_ws(".", F.element_at("l", -2), F.element_at("l", -1)).alias("trigger"), F.col("h").alias("handler"), F.lit("ui_event").alias("type"))


def _elements(files: DataFrame) -> DataFrame:
    """Elements of pages with an attribute that names a handler, bare or in a binding; the first such attribute counts."""
    pair = r"([A-Za-z_][\w:.-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')"
    d = files.filter(extension(F.col("path")).isin(*PAGES)).select("repo", "path", F.explode(spans(F.col("content"), r"<([A-Za-z_][\w:.-]*)(\s[^>]*)>", 2)).alias("s"))
    of = lambda x, g: F.regexp_extract(x, pair, g)
    said = F.transform(F.filter(F.regexp_extract_all("s.b", F.lit(pair), F.lit(0)), lambda x: F.lower(of(x, 1)).isin(*HANDLERS)), lambda x: F.concat(of(x, 2), of(x, 3)))
    handler = _name(F.regexp_replace(F.get(said, 0), r"^\{Binding\s+", ""))
    d = d.select("repo", "path", F.col("s.line").alias("line"), F.col("s.a").alias("tag"), handler.alias("handler")).filter("handler <> ''")
    return d.select("repo", "path", "line", F.concat_ws(".", "tag", "handler").alias("trigger"), "handler", F.lit("markup_event").alias("type"))


def _started(files: DataFrame) -> DataFrame:
    """Schedules, bound to the method that they stand before, and the first `main` of a file."""
    p = symbols.parse(files, ("Scheduled",))
    row = lambda line, trigger, handler, kind: F.struct(line.alias("line"), trigger.alias("trigger"), handler.alias("handler"), F.lit(kind).alias("type"))
    when = lambda u: F.concat(F.lit("scheduled:"), F.substring(F.array_join(F.filter(F.split(u["args"], r"\s+"), lambda w: w != ""), " "), 1, 80))
    timed = F.transform(F.filter("uses", lambda u: (u["mark"] == "@") & (u["name"] == "Scheduled") & u["args"].isNotNull() & u["next_method"].isNotNull()), lambda u: row(u["line"], when(u), u["next_method"], "scheduler"))
    main = F.transform(F.slice(F.filter("methods", lambda m: F.lower(m["name"]) == "main"), F.lit(1), F.lit(1)), lambda m: row(m["line"], F.lit("process-entry"), m["name"], "process_entry"))
    return p.select("repo", F.col("file").alias("path"), F.inline(F.concat(timed, main)))


def extract_bindings(files: DataFrame) -> DataFrame:
    """repo, file, line, trigger, handler_name, type: C# events, handlers in pages, schedules (the next method) and the first `main` of a file."""
    every = _events(lines(files)).unionByName(_elements(files)).unionByName(_started(files))
    return every.select("repo", F.col("path").alias("file"), "line", F.concat_ws("#", "path", "trigger").alias("trigger"), F.col("handler").alias("handler_name"), "type")


def resolve_bindings(bindings: DataFrame, candidates: DataFrame) -> DataFrame:
    """Bindings with target and kind: an edge where exactly one node has the handler's name, else unresolved_trigger with its candidates."""
    d = bindings.withColumnRenamed("handler_name", "name").join(candidates, ["repo", "name"], "left").withColumn("candidates", F.coalesce("candidates", F.array().cast("array<string>")))
    one = F.size("candidates") == 1
    return d.select("repo", "file", "line", "trigger", F.col("name").alias("handler_name"), "type", F.when(one, F.col("candidates")[0]).alias("target"), F.when(one, "edge").otherwise("unresolved_trigger").alias("kind"), "candidates")


def _routine(text: Column, ext: Column) -> Column:
    """The routine that a line begins: the word behind the first word that begins one, where only modifiers (in PHP, anything) stand before it. In COBOL a line of one word in capitals and a point. Null: none."""
    words = F.filter(F.split(text, r"[^\w!?=]+"), lambda w: w != "")
    begins = F.create_map(*(F.lit(x) for k, v in ROUTINES.items() for x in (k, v)))[ext]
    known = F.split(begins, " ")
    at = F.array_position(F.transform(words, lambda w: F.array_contains(known, F.when(ext.isin("rb", "php"), w).otherwise(F.lower(w)))), F.lit(True)).cast("int") - 1
    free = F.forall(F.slice(words, F.lit(1), F.greatest(at, F.lit(0))), lambda w: F.lower(w).isin(*BEFORE) | (ext == "php"))
    name = F.when((at >= 0) & free, F.get(words, at + 1))
    name = F.when(ext == "php", F.when(F.contains(F.replace(text, F.lit(" "), F.lit("")), F.concat(F.lit("function"), name, F.lit("("))), name)).when(ext == "rb", F.regexp_extract(name, r"^\w+[!?=]?", 0)).otherwise(F.regexp_extract(name, r"^\w+", 0))
    line = F.rtrim(text)
    single = F.rtrim(F.trim(text), F.lit("."))
    cobol = F.when(line.endswith(".") & ~F.contains(single, F.lit(" ")) & (F.length(line) - F.length(F.ltrim(line)) <= 12) & (F.translate(single, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-", "") == "") & (F.length(single) > 1) & ~single.startswith("-"), single)
    return F.nullif(F.when(ext.isin(*COBOL), cobol).otherwise(name), F.lit(""))


def legacy_symbols(files: DataFrame) -> DataFrame:
    """repo, file, line, id, type: routines of Basic, PHP, Ruby, COBOL and ABAP, named by their path, the first of a name; and a view per page."""
    ext, path = extension(F.col("path")), F.col("path")
    found = lines(files.filter(ext.isin(*ROUTINES, *COBOL))).select("repo", "path", "line", _routine(F.col("text"), ext).alias("name")).filter(F.col("name").isNotNull() & ~F.upper("name").isin(*DIVISIONS))
    bare = F.substr(path, F.lit(1), F.length(path) - F.length(ext) - 1)
    id_ = F.concat_ws(".", F.replace(bare, F.lit("/"), F.lit(".")), "name")
    routines = found.groupBy("repo", path.alias("file"), id_.alias("id")).agg(F.min("line").alias("line")).select("repo", "file", "line", "id", F.lit("function").alias("type"))
    views = files.filter(ext.isin(*PAGES)).select("repo", path.alias("file"), F.lit(1).alias("line"), F.concat(F.lit("view:"), path).alias("id"), F.lit("view").alias("type"))
    return routines.unionByName(views)
