"""Routers of Python modules: constants, imports, routers and mounts of each module, static strings over the constants, and the prefixes that endpoints get from the chains of mounts above them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import join_path
from ..sources.corpus import extension
from ..sources.tables import discard, written
from . import symbols
from .closure import mount_prefixes

#: Calls that make a router, mount one and make an application.
MAKES, MOUNTS, APPLICATION = "APIRouter", "include_router", "FastAPI"
LITERAL = r"^([A-Za-z]*)([\"'])(.*)\2$"
#: A value that names are set to: a string with its prefix, or a dotted name.
VALUE = r"[A-Za-z]{0,2}\"[^\"\n]*\"|[A-Za-z]{0,2}'[^'\n]*'|[A-Za-z_][\w.]*"


def module_name(path: Column) -> Column:
    """a/b.py and a/b/__init__.py: a.b."""
    return F.replace(F.regexp_replace(path, r"(?:/__init__)?\.py$", ""), F.lit("/"), F.lit("."))


def import_target(path: Column, source: Column) -> Column:
    """The module that an import names: itself, or with leading points the folder of the file, one up for each further point, and the rest."""
    dots = F.length(F.regexp_extract(source, r"^\.+", 0))
    folders = F.filter(F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1), lambda x: x != "")
    above = F.slice(folders, F.lit(1), F.greatest(F.size(folders) - (dots - 1), F.lit(0)))
    rest = F.regexp_replace(source, r"^\.+", "")
    return F.when(dots == 0, source).otherwise(F.concat_ws(".", F.array_join(above, "."), F.nullif(rest, F.lit("")))).alias("target")


def _joined(text: Column) -> Column:
    return F.regexp_replace(text, r"^\.|\.$", "")


def modules(files: DataFrame) -> DataFrame:
    """repo, file, module, constants, imports, routers, mounts, app_root: a row per Python file.

    constants: array of name and value expression (names in capitals); imports: name -> what it stands for; routers: name -> prefix expression (null without one); mounts: what is mounted, as written, with its
    prefix expression."""
    py = files.filter(extension(F.col("path")) == "py")
    text = py.select("repo", F.col("path").alias("file"), symbols.without_comments(F.coalesce("content", F.lit("")), F.lit("py")).alias("text"))
    set_ = rf"(?m)^[ \t]*([A-Z][A-Z0-9_]*)[ \t]*(?::[^=\n]+)?=[ \t]*({VALUE})[ \t]*$"
    constants = F.transform(F.regexp_extract_all("text", F.lit(set_), F.lit(0)), lambda s: F.struct(F.regexp_extract(s, set_, 1).alias("name"), F.regexp_extract(s, set_, 2).alias("value")))
    from_ = r"(?m)^[ \t]*from[ \t]+([.\w]+)[ \t]+import[ \t]*(\([^)]*\)|[^\n]+)"
    item = r"^\s*(\w+)(?:\s+as\s+(\w+))?\s*$"
    named = F.flatten(
        F.transform(
            F.regexp_extract_all("text", F.lit(from_), F.lit(0)),
            lambda s: F.transform(F.split(F.regexp_replace(F.regexp_extract(s, from_, 2), r"[()]", ""), ","), lambda x: F.struct(F.coalesce(F.nullif(F.regexp_extract(x, item, 2), F.lit("")), F.regexp_extract(x, item, 1)).alias("name"), _joined(F.concat_ws(".", import_target(F.col("file"), F.regexp_extract(s, from_, 1)), F.regexp_extract(x, item, 1))).alias("target"))),
        )
    )
    whole = r"(?m)^[ \t]*import[ \t]+([^\n]+)"
    dotted = r"^\s*([\w.]+)(?:\s+as\s+(\w+))?\s*$"
    plain = F.flatten(F.transform(F.regexp_extract_all("text", F.lit(whole), F.lit(1)), lambda s: F.transform(F.split(s, ","), lambda x: F.struct(F.coalesce(F.nullif(F.regexp_extract(x, dotted, 2), F.lit("")), F.regexp_extract(x, dotted, 1)).alias("name"), F.regexp_extract(x, dotted, 1).alias("target")))))
    text = text.select("repo", "file", constants.alias("constants"), F.filter(F.concat(named, plain), lambda i: i["name"] != "").alias("imports"))
    prefix = lambda u: F.nullif(F.trim(F.regexp_extract(u["args"], rf"\bprefix\s*=\s*({VALUE})", 1)), F.lit(""))
    first = lambda u: F.regexp_extract(u["args"], r"^\s*([A-Za-z_][\w.]*)", 1)
    of = lambda name: F.filter("uses", lambda u: (u["name"] == name) & (u["mark"] == ""))
    p = symbols.parse(py, (MAKES, MOUNTS, APPLICATION)).select(
        "repo", "file", F.transform(F.filter(of(MAKES), lambda u: u["field"].isNotNull()), lambda u: F.struct(u["field"].alias("router"), prefix(u).alias("prefix"))).alias("routers"),
        F.transform(F.filter(of(MOUNTS), lambda u: first(u) != ""), lambda u: F.struct(first(u).alias("what"), F.coalesce(prefix(u), F.lit('""')).alias("prefix"))).alias("mounts"), (F.size(of(APPLICATION)) > 0).alias("app_root"),
    )
    return text.join(p, ["repo", "file"]).select("repo", "file", module_name(F.col("file")).alias("module"), "constants", "imports", "routers", "mounts", "app_root")


def _parts(expression: Column) -> Column:
    """array<struct<text, name>> of an expression: text as it is, and names whose values belong there. Null for what is neither a literal nor a name."""
    e = F.trim(expression)
    body, formatted = F.regexp_extract(e, LITERAL, 3), F.lower(F.regexp_extract(e, LITERAL, 1)).contains("f")
    part = lambda text, name: F.struct(text.alias("text"), name.alias("name"))
    none = F.lit(None).cast("string")
    pieces = F.transform(F.regexp_extract_all(body, F.lit(r"\{[^{}]*\}|[^{}]+"), F.lit(0)), lambda x: F.when(x.startswith("{"), part(none, F.element_at(F.split(F.trim(x, F.lit("{} ")), r"\."), -1))).otherwise(part(x, none)))
    literal = F.when(formatted, pieces).otherwise(F.array(part(body, none)))
    return F.when(e.rlike(LITERAL), literal).when(e.rlike(r"^[A-Za-z_][\w.]*$"), F.array(part(none, F.element_at(F.split(e, r"\."), -1))))


def _filled(open_: DataFrame, key: list[str], known: DataFrame) -> DataFrame:
    """key, value: of open_(repo, key, parts) those all of whose names known(repo, name, value) has."""
    # rows are told apart by a hash of what they are and hold, so that only names travel
    d = open_.select(*key, "parts", F.posexplode("parts").alias("i", "p")).drop("parts")
    j = d.join(known.select("repo", F.col("name").alias("_n"), F.col("value").alias("_v")), (d["repo"] == known["repo"]) & (F.col("p.name") == F.col("_n")), "left").select(*(d[k] for k in key), "i", F.coalesce("p.text", "_v").alias("_v"))
    g = j.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("i", "_v"))).alias("_l"), F.bool_and(F.col("_v").isNotNull()).alias("_all"))
    return g.filter("_all").select(*key, F.array_join(F.transform("_l", lambda x: x["_v"]), "").alias("value"))


def constant_values(mods: DataFrame) -> DataFrame:
    """repo, name, value: constants of a repo that have one meaning: those that are set to different things are left out, those that hold others are filled in as far as all of these are known,
    round by round; a round takes all whose names are known by then, and cycles and unknown names never are."""
    all_ = mods.select("repo", F.explode("constants").alias("c")).select("repo", "c.name", "c.value")
    one = all_.groupBy("repo", "name").agg(F.min("value").alias("value"), F.max("value").alias("_m")).filter("value = _m")
    open_ = written(one.select("repo", "name", _parts(F.col("value")).alias("parts")).filter("parts is not null"))
    bare = F.forall("parts", lambda p: p["name"].isNull())
    known = written(open_.filter(bare).select("repo", "name", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("value")))
    while True:
        left = open_.filter(~bare).join(known, ["repo", "name"], "left_anti")
        new = written(_filled(left, ["repo", "name"], known))
        if new.isEmpty():
            discard(new, open_)
            return known
        grown = written(known.unionByName(new))
        discard(new, known)
        known = grown


def static_strings(expressions: DataFrame, constants: DataFrame) -> DataFrame:
    """expressions(repo, expression) with value: a literal's text, with the constants that a formatted one names filled in, or a constant's value; null where one is unknown. Each distinct
    expression is worked out once."""
    each = expressions.select("repo", "expression").distinct().withColumn("parts", _parts(F.col("expression"))).filter("parts is not null and size(parts) > 0")
    found = _filled(each, ["repo", "expression"], constants).unionByName(expressions.select("repo", "expression").distinct().filter(F.regexp_extract(F.trim("expression"), LITERAL, 3).eqNullSafe("") & F.col("expression").rlike(LITERAL)).withColumn("value", F.lit("")))
    return expressions.join(found, ["repo", "expression"], "left")


def mounted(mods: DataFrame, constants: DataFrame) -> DataFrame:
    """repo, owner, target, prefix (null if it is not known) of every mount; the target is a module: what the name stands for by the imports of its module, less the router's own name."""
    m = mods.select("repo", F.col("module").alias("owner"), "imports", F.explode("mounts").alias("m"))
    head = F.substring_index("m.what", ".", 1)
    imported = F.try_element_at(F.filter("imports", lambda i: i["name"] == head), F.lit(-1))["target"]
    tail = F.substr("m.what", F.length(head) + 1, F.length("m.what"))
    own = F.coalesce(F.concat(imported, tail), F.col("m.what"))
    d = m.select("repo", "owner", own.alias("full"), F.col("m.prefix").alias("expression"))
    # a.b.router is of a.b, as a.b is itself where it is a module
    known = mods.select("repo", F.col("module").alias("full"), F.lit(True).alias("_k"))
    d = d.join(known, ["repo", "full"], "left").withColumn("target", F.when(F.col("_k") | ~F.contains("full", F.lit(".")), F.col("full")).otherwise(F.regexp_replace("full", r"\.[^.]*$", ""))).drop("_k", "full")
    return static_strings(d, constants).select("repo", "owner", "target", F.col("value").alias("prefix"))


def compose(mods: DataFrame, endpoints: DataFrame) -> DataFrame:
    """endpoints(repo, file, router, method, path_pattern, ...) with path_pattern under every prefix that its module is mounted at and its router has, a row each, and prefix_resolved: false, and the path as it is, where
    the router's prefix or the only mounts are not known. Chains begin at modules that make an application; in a repo without one, at modules that mount others and are not mounted. `mods` is read several times."""
    constants = constant_values(mods)
    mounts = written(mounted(mods, constants))
    apps = mods.filter("app_root").select("repo", "module").distinct()
    first = mounts.filter("prefix is not null").select("repo", F.col("owner").alias("module")).distinct().join(mounts.filter("prefix is not null").select("repo", F.col("target").alias("module")), ["repo", "module"], "left_anti")
    roots = apps.unionByName(first.join(apps.select("repo"), "repo", "left_anti")).distinct()
    prefixes = mount_prefixes(mounts, roots)
    lost = mounts.filter("prefix is null").select("repo", F.col("target").alias("module")).distinct().join(prefixes, ["repo", "module"], "left_anti").withColumn("_lost", F.lit(True))
    own = static_strings(mods.select("repo", "module", F.inline("routers")).filter("prefix is not null").withColumnRenamed("prefix", "expression"), constants)
    own = own.groupBy("repo", "module", "router").agg(F.last("value").alias("_own"), F.lit(True).alias("_has"))
    e = endpoints.withColumn("module", module_name(F.col("file"))).join(own, ["repo", "module", "router"], "left").join(lost, ["repo", "module"], "left")
    e = e.join(prefixes.withColumnRenamed("prefix", "_prefix"), ["repo", "module"], "left")
    fails = F.coalesce(F.col("_lost"), F.lit(False)) | (F.coalesce(F.col("_has"), F.lit(False)) & F.col("_own").isNull())
    path = F.when(fails, F.col("path_pattern")).otherwise(join_path(F.coalesce("_prefix", F.lit("")), F.coalesce("_own", F.lit("")), F.col("path_pattern")))
    out = e.withColumns({"path_pattern": path, "prefix_resolved": ~fails}).select(*endpoints.columns, "prefix_resolved")
    return out.distinct()
