"""Types, methods, uses of names, call sites and injections of source files.

A pass over each file, linear in its text, tells types, methods and uses with their owners (`functions.source`); they are columns of the file's row. `facts` writes these rows
once, so that symbols, calls, injections and whatever else is asked of them read a table and not the sources again."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.source import JVM, LANGUAGES, SCRIPT, Scan, strip_comments
from ..sources.corpus import extension
from ..sources.tables import written

#: Annotations that have a field injected, and words that may stand before its type.
INJECTS = ("Autowired", "Inject", "Resource")
MODIFIERS = ("public", "protected", "private", "internal", "final", "static", "readonly", "lateinit", "val", "var")
#: So many characters of texts does a task remember with what they told: copies of a file that come near each other, of which corpora are full, are read once.
REPEATED = 1 << 18

_S, _I, _B = T.StringType(), T.IntegerType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


TYPES = _struct(name=_S, kind=_S, line=_I, start=_I, end=_I, last=_I, outer=_S, extends=T.ArrayType(_S), implements=T.ArrayType(_S))
METHODS = _struct(name=_S, owner=_S, visibility=_S, line=_I, start=_I, end=_I, body=_I, last=_I)
#: mark: @ or [ of annotations, else empty. args: what stands in its brackets, of the names asked for; field: what its result is assigned to. method: what it stands in, with its type; ahead: the next declaration.
USES = _struct(mark=_S, owner=_S, name=_S, args=_S, line=_I, last=_I, start=_I, end=_I, type=_S, method_owner=_S, method=_S, declares=_B, next_method=_S, ahead=_S, ahead_name=_S, after=_S, field=_S)
PARSED = _struct(repo=_S, file=_S, ext=_S, types=T.ArrayType(TYPES), methods=T.ArrayType(METHODS), uses=T.ArrayType(USES))
_ARROW = {_S: pa.string(), _I: pa.int32(), _B: pa.bool_()}


def _arrow(t: T.DataType) -> pa.DataType:
    if isinstance(t, T.ArrayType):
        return pa.list_(_arrow(t.elementType))
    return pa.struct([(f.name, _arrow(f.dataType)) for f in t.fields]) if isinstance(t, T.StructType) else _ARROW[t]


def _scan(named: frozenset, only: frozenset | None = None):
    def told(content: str, ext: str) -> tuple[list, list, list]:
        s = Scan(content, ext if ext in LANGUAGES else "js", named)
        uses = s.uses if only is None else [u for u in s.uses if u["name"] in only]
        for u in uses:
            m = u["method"]
            u["method"], u["method_owner"] = (m["name"], m["owner"]) if m else (None, None)
        return s.types, s.methods, uses

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [_arrow(PARSED[c].dataType) for c in ("types", "methods", "uses")]
        seen, held = {}, 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                rows = []
                for key in zip(part.column("content").to_pylist(), part.column("ext").to_pylist(), strict=True):
                    if (row := seen.get(key)) is None:
                        row, held = told(*key), held + len(key[0])
                        if held > REPEATED:
                            seen, held = {}, len(key[0])
                        seen[key] = row
                    rows.append(row)
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("repo"), part.column("file"), part.column("ext"), *columns], names=PARSED.fieldNames())

    return run


@F.pandas_udf(T.StringType())
def without_comments(content, ext):
    """E1 for column expressions: comments as blanks; literals, line ends and offsets stay. Null: empty."""
    import pandas as pd

    return pd.Series([strip_comments(c, e) for c, e in zip(content, ext, strict=True)])


def parse(files: DataFrame, named: tuple[str, ...] = (), pages: tuple[str, ...] = (), only: tuple[str, ...] | None = None) -> DataFrame:
    """repo, file, ext, package, types, methods, uses: a row per file of a known language. named: names whose arguments are wanted; pages: further formats, read like scripts; only: names whose uses are wanted, if not all. The package is the one that is declared, or of Python and
    script files the dotted path. One evaluation of the sources: explode both of its columns at once, or write it (`facts`)."""
    ext = extension(F.col("path"))
    d = files.filter(ext.isin(*LANGUAGES, *pages)).select("repo", F.col("path").alias("file"), ext.alias("ext"), F.coalesce("content", F.lit("")).alias("content"))
    said = F.regexp_extract("content", r"(?m)^\s*(?:package|namespace)\s+([\w.]+)", 1)
    path = F.regexp_replace(F.regexp_replace("file", r"(?:(?:^|/)__init__)?\.py$", ""), rf"\.(?:{'|'.join(SCRIPT)})$", "")
    own = F.when(F.col("ext").isin(*JVM), said).when(F.col("ext") == "go", F.coalesce(F.nullif(said, F.lit("")), F.replace(F.regexp_extract("file", r"^(.*)/[^/]*$", 1), F.lit("/"), F.lit(".")))).otherwise(F.replace(path, F.lit("/"), F.lit(".")))
    # the package rides in the file's name through the pass: no second look at the content
    d = d.select("repo", F.concat_ws("\u0001", "file", own).alias("file"), "ext", "content")
    p = d.mapInArrow(_scan(frozenset(named), None if only is None else frozenset(only)), PARSED).withColumn("_f", F.split("file", "\u0001"))
    return p.select("repo", F.col("_f")[0].alias("file"), "ext", F.col("_f")[1].alias("package"), "types", "methods", "uses")


def facts(files: DataFrame, named: tuple[str, ...] = ()) -> DataFrame:
    """`parse`, written once."""
    return written(parse(files, named))


def symbol_id(*parts: Column) -> Column:
    return F.concat_ws(".", *(F.nullif(p, F.lit("")) for p in parts))


def nodes(parsed: DataFrame) -> DataFrame:
    """repo, id, kind, file, line, visibility: types and methods, of one explosion."""
    row = lambda id_, kind, line, visibility: F.struct(id_.alias("id"), kind.alias("kind"), line.alias("line"), visibility.alias("visibility"))
    types = F.transform("types", lambda t: row(symbol_id(F.col("package"), t["name"]), t["kind"], t["line"], F.lit("")))
    methods = F.transform("methods", lambda m: row(symbol_id(F.col("package"), m["owner"], m["name"]), F.lit("method"), m["line"], m["visibility"]))
    return parsed.select("repo", "file", F.inline(F.array_distinct(F.concat(types, methods)))).select("repo", "id", "kind", "file", "line", "visibility")


def build_symbols(parsed: DataFrame) -> DataFrame:
    """repo, file, id, type, line, extends, implements, methods: each type with its methods, and functions outside of types."""
    m = parsed.select("repo", "file", "package", F.explode("methods").alias("m")).select(
        "repo", "file", F.col("m.owner").alias("owner"), F.struct(F.col("m.line").alias("line"), F.col("m.name").alias("name"), symbol_id(F.col("package"), F.col("m.owner"), F.col("m.name")).alias("id"), F.col("m.visibility").alias("visibility")).alias("m")
    )
    own = m.groupBy("repo", "file", "owner").agg(F.transform(F.sort_array(F.collect_list("m")), lambda x: F.struct(x["name"].alias("name"), x["id"].alias("id"), x["line"].alias("line"), x["visibility"].alias("visibility"))).alias("methods"))
    t = parsed.select("repo", "file", "package", F.explode("types").alias("t")).select("repo", "file", F.col("t.name").alias("owner"), symbol_id(F.col("package"), F.col("t.name")).alias("id"), F.col("t.kind").alias("type"), "t.line", "t.extends", "t.implements")
    none, no_methods = F.array().cast("array<string>"), F.array().cast(own.schema["methods"].dataType)
    classes = t.join(own, ["repo", "file", "owner"], "left").withColumn("methods", F.coalesce("methods", no_methods)).drop("owner")
    free = m.filter("owner = ''").select("repo", "file", "m.id", F.lit("function").alias("type"), "m.line", none.alias("extends"), none.alias("implements"), no_methods.alias("methods"))
    return classes.unionByName(free)


def call_sites(parsed: DataFrame) -> DataFrame:
    """repo, file, line, caller, name, qualifier (null if none): calls in method bodies."""
    called = F.filter("uses", lambda u: (u["mark"] == "") & u["method"].isNotNull() & ~u["declares"])
    x = parsed.select("repo", "file", "package", F.explode(called).alias("u"))
    return x.select("repo", "file", F.col("u.line").alias("line"), symbol_id(F.col("package"), F.col("u.method_owner"), F.col("u.method")).alias("caller"), F.col("u.name").alias("name"), F.nullif(F.substring_index("u.owner", ".", -1), F.lit("")).alias("qualifier"))


def injections(parsed: DataFrame) -> DataFrame:
    """repo, file, line, caller (the type), name (the injected type), qualifier (null): injected fields, which are a type and a name, or a name, a colon and a type. `parsed` must be
    asked for INJECTS."""
    x = parsed.select("repo", "file", "package", F.explode(F.filter("uses", lambda u: (u["mark"] == "@") & u["name"].isin(*INJECTS) & (u["type"] != ""))).alias("u"))
    text = F.regexp_replace("u.after", r"<[^<>]*>", " ")
    words = F.filter(F.split(text, r"\s+"), lambda w: (w != "") & ~w.isin(*MODIFIERS))
    kind = F.when(F.contains(text, F.lit(":")), F.trim(F.element_at(F.split(text, ":"), -1))).when(F.size(words) == 2, words[0])
    name = F.element_at(F.split(kind, r"\."), -1)
    return x.select("repo", "file", F.col("u.line").alias("line"), symbol_id(F.col("package"), F.col("u.type")).alias("caller"), name.alias("name"), F.lit(None).cast("string").alias("qualifier")).filter(F.col("name").rlike("^[A-Z]"))
