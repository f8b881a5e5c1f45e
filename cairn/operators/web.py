"""Endpoints and consumers of web frameworks. What can mean either is a use of a name: a call or an annotation with its owner, its arguments up to the bracket that closes them,
over as many lines as they take, and the declaration it stands before. What it means is told from these by column expressions; only named uses leave a file's row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.source import SCRIPT
from ..functions.text import join_path, normalize_path, spans
from ..sources.corpus import extension
from . import symbols

#: HTTP verbs, and the names of calls and annotations that serve or send requests.
VERBS = ("get", "post", "put", "delete", "patch")
ROUTES = (*VERBS, "use", "route", "path", "re_path")
MAPPINGS = ("RequestMapping", *(v.capitalize() + "Mapping" for v in VERBS), *("Http" + v.capitalize() for v in VERBS))
CALLS = ("fetch", "useFetch", "$fetch", "ajax", "RestRequest", *(v.capitalize() + "Async" for v in VERBS), *map(str.capitalize, VERBS), *map(str.upper, VERBS))
NAMES = (*ROUTES, *MAPPINGS, "Route", *CALLS)
QUOTED = r"[\"'`]([^\"'`]*)[\"'`]"
PAGE = ("html", "htm", "jsp", "cshtml", "vue", "aspx")
#: Formats that are routes by themselves.
ROUTED_FILES = {"asp": "classic-asp", "aspx": "aspnet-webforms", "ashx": "aspnet-webforms", "asmx": "aspnet-webforms"}


def uses(files: DataFrame) -> DataFrame:
    """repo, path, ext, mark, owner, name, args, line, type, method, next_method, ahead, ahead_name: uses of NAMES, one row each."""
    named = F.filter("uses", lambda u: u["name"].isin(*NAMES) & ~u["declares"])
    d = symbols.parse(files, NAMES, PAGE).select("repo", F.col("file").alias("path"), "ext", F.inline(named))
    return d.select("repo", "path", "ext", "mark", "owner", "name", F.coalesce("args", F.lit("")).alias("args"), "line", "start", "type", "method", "next_method", "ahead", "ahead_name")


def quoted(args: Column) -> Column:
    """The text that the arguments begin with, or that a named one gives as the path; empty if there is none."""
    named = F.regexp_extract(args, rf"\b(?:value|path|template|rule)\s*[=:]\s*[{{\[]?\s*{QUOTED}", 1)
    return F.when(args.rlike(r"^\s*[{\[$]?\s*[\"'`]"), F.regexp_extract(args, QUOTED, 1)).otherwise(named)


def key(text: Column, name: str) -> Column:
    """What an option is set to, in quotes; null if it is not."""
    return F.nullif(F.regexp_extract(text, rf"(?i)\b(?:{name})\s*[:=]\s*[\"']([^\"']+)", 1), F.lit(""))


def based(found: DataFrame) -> DataFrame:
    """Uses with the base path of the type that they stand in: the last route before it. [controller] is its name."""
    own = F.replace(quoted(F.col("args")), F.lit("[controller]"), F.regexp_replace(F.lower("ahead_name"), "controller$", ""))
    of_type = F.when((F.col("mark") != "") & (F.col("ahead") == "type") & F.col("name").isin("RequestMapping", "Route"), F.struct(F.col("ahead_name").alias("type"), own.alias("path")))
    w = W.partitionBy("repo", "path").orderBy("start").rowsBetween(W.unboundedPreceding, W.currentRow)
    d = found.withColumn("_b", F.last(of_type, ignorenulls=True).over(w))
    return d.withColumn("base", F.when(F.col("_b.type") == F.col("type"), F.col("_b.path")).otherwise("")).drop("_b")


def _annotated(found: DataFrame) -> DataFrame:
    """Spring and ASP.NET: mappings of methods, under the base of their type; without a path, the base itself."""
    name, args, java = F.col("name"), F.col("args"), F.col("ext").isin("java", "kt", "kts")
    d = based(found.filter(F.col("mark").isin("@", "[") & name.isin(*MAPPINGS, "Route"))).filter(name.isin(*MAPPINGS) & (F.coalesce("ahead", F.lit("")) != "type"))
    verb = F.when(name == "RequestMapping", F.coalesce(F.nullif(F.regexp_extract(args, r"RequestMethod\.(\w+)", 1), F.lit("")), F.lit("ANY"))).otherwise(F.upper(F.regexp_replace(name, "^Http|Mapping$", "")))
    handler = F.coalesce("ahead_name", F.element_at(F.split("path", "/"), -1))
    return d.select("repo", "path", "line", F.when(java, "spring").otherwise("aspnet").alias("framework"), verb.alias("method"), join_path(F.col("base"), quoted(args)).alias("path_pattern"), handler.alias("handler"), F.lit(None).cast("string").alias("router"))


def _decorated(found: DataFrame) -> DataFrame:
    """FastAPI and Flask: decorators of a router, a row per method."""
    name, args = F.col("name"), F.col("args")
    verb = name.isin(*VERBS)
    said = F.transform(F.regexp_extract_all(F.regexp_extract(args, r"\bmethods\s*=\s*[\[(]([^\])]*)", 1), F.lit(QUOTED), F.lit(1)), F.upper)
    methods = F.when(verb, F.array(F.upper(name))).when(F.size(said) > 0, said).otherwise(F.array(F.lit("GET")))
    d = found.filter((F.col("ext") == "py") & (F.col("mark") == "@") & (F.col("owner") != "") & (verb | (name == "route")))
    router = F.element_at(F.split("owner", r"\."), -1)
    return d.select("repo", "path", "line", F.when(verb, "fastapi").otherwise("flask").alias("framework"), F.explode(methods).alias("method"), normalize_path(quoted(args)).alias("path_pattern"), F.coalesce("ahead_name", "next_method").alias("handler"), router.alias("router"))


def _listed(found: DataFrame) -> DataFrame:
    """Django and Express: a path and, behind it, a handler."""
    name, args, py = F.col("name"), F.col("args"), F.col("ext") == "py"
    after = F.regexp_extract(args, rf"^\s*{QUOTED}\s*,\s*([\w.]+)", 2)
    express = F.col("ext").isin(*SCRIPT) & F.element_at(F.split("owner", r"\."), -1).isin("app", "router") & name.isin(*VERBS, "use")
    d = found.filter((F.col("mark") == "") & (after != "") & (express | (py & (F.col("owner") == "") & name.isin("path", "re_path"))))
    return d.select("repo", "path", "line", F.when(py, "django").otherwise("express").alias("framework"), F.when(py, "ANY").otherwise(F.upper(name)).alias("method"), normalize_path(quoted(args)).alias("path_pattern"), after.alias("handler"), F.lit(None).cast("string").alias("router"))


def _configured(files: DataFrame) -> DataFrame:
    """Struts actions and servlet mappings of XML files, and formats that are routes."""
    of = lambda text, name: F.nullif(F.trim(F.regexp_extract(text, rf"(?i)\b{name}\s*=\s*[\"']([^\"']+)", 1)), F.lit(""))
    tag = lambda text, name: F.nullif(F.trim(F.regexp_extract(text, rf"(?i)<{name}>([^<]+)<", 1)), F.lit(""))
    xml = files.filter(extension(F.col("path")) == "xml").select("repo", "path", F.explode(spans(F.col("content"), r"(?is)<(action\s[^>]*|servlet-mapping>.*?</servlet-mapping)>", 1)).alias("_s"))
    body, none = F.col("_s.a"), F.lit(None).cast("string").alias("router")
    configured = xml.select(
        "repo", "path", F.col("_s.line").alias("line"), F.when(body.rlike("(?i)^action"), "struts").otherwise("servlet").alias("framework"), F.lit("ANY").alias("method"),
        normalize_path(F.coalesce(of(body, "path"), tag(body, "url-pattern"))).alias("path_pattern"), F.coalesce(of(body, "type"), tag(body, "servlet-name")).alias("handler"), none,
    ).filter("path_pattern is not null and handler is not null")
    routed = F.create_map(*(F.lit(x) for pair in ROUTED_FILES.items() for x in pair))[extension(F.col("path"))]
    by_file = files.select("repo", "path", F.lit(1).alias("line"), routed.alias("framework"), F.lit("ANY").alias("method"), F.concat(F.lit("/"), "path").alias("path_pattern"), F.element_at(F.split("path", "/"), -1).alias("handler"), none)
    return configured.unionByName(by_file.filter("framework is not null"))


def endpoints(files: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """repo, file, line, framework, method, path_pattern, handler, router of Spring, ASP.NET, FastAPI, Flask, Django, Express, Struts, servlet mappings and routed files. found: `uses` of the files,
    where they are at hand; they are read three times, so a written table is best."""
    found = symbols.written(uses(files)) if found is None else found
    out = _annotated(found).unionByName(_decorated(found)).unionByName(_listed(found)).unionByName(_configured(files))
    return out.withColumnRenamed("path", "file")


def consumers(files: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """repo, file, line, call_type, method, path_pattern, function of axios, fetch, HttpClient, RestSharp, Refit, Retrofit, jQuery and HTML forms; GET if unsaid. function: the method that a call stands in,
    or that an annotation stands before."""
    found = uses(files) if found is None else found
    mark, name, args = (F.col(c) for c in ("mark", "name", "args"))
    last, plain = F.element_at(F.split("owner", r"\."), -1), mark == ""
    low, cap, up = (name.isin(*(f(v) for v in VERBS)) for f in (str.lower, str.capitalize, str.upper))
    is_async = name.rlike("^[A-Z][a-z]+Async$")
    kind = (
        F.when(plain & (last == "axios") & low, "axios").when(plain & name.isin("fetch", "useFetch", "$fetch"), name).when(plain & is_async, "HttpClient").when(plain & (name == "RestRequest"), "RestSharp")
        .when((mark == "[") & cap, "Refit").when((mark == "@") & up, "Retrofit").when(plain & (name == "ajax") & last.isin("$", "jQuery"), "jquery-ajax")
    )
    verb = F.when(low | cap | up, name).when(is_async, F.regexp_replace(name, "Async$", "")).when(name == "RestRequest", F.nullif(F.regexp_extract(args, r"\bMethod\.(\w+)", 1), F.lit(""))).otherwise(key(args, "method|type"))
    url = F.when(name == "ajax", key(args, "url")).otherwise(F.nullif(quoted(args), F.lit("")))
    calls = found.select("repo", "path", "line", kind.alias("call_type"), F.upper(F.coalesce(verb, F.lit("GET"))).alias("method"), url.alias("_p"), F.when(plain, F.col("method")).otherwise(F.coalesce("ahead_name", "next_method")).alias("function"))
    pages = files.filter(extension(F.col("path")).isin(*PAGE)).select("repo", "path", F.explode(spans(F.col("content"), r"(?i)<form(\s[^>]*)>", 1)).alias("_s"))
    forms = pages.select("repo", "path", F.col("_s.line").alias("line"), F.lit("html-form").alias("call_type"), F.upper(F.coalesce(key(F.col("_s.a"), "method"), F.lit("GET"))).alias("method"), key(F.col("_s.a"), "action").alias("_p"), F.lit(None).cast("string").alias("function"))
    out = calls.unionByName(forms).filter("call_type is not null and _p is not null")
    return out.select("repo", F.col("path").alias("file"), "line", "call_type", "method", normalize_path(F.col("_p")).alias("path_pattern"), "function")
