"""Entities of object-relational mappers and the relations that they state: annotations, assigned fields and associations, which are uses of names with whole arguments, however many lines these
take. Each goes to the type it stands in, and annotations of a type to the one they stand before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import symbols

#: Names of mappings, by mapper.
SIDES = ("OneToOne", "ManyToOne", "OneToMany", "ManyToMany")
ASSOCIATIONS = {"hasOne": "one_to_one", "belongsTo": "many_to_one", "hasMany": "one_to_many", "belongsToMany": "many_to_many"}
FIELDS = {"ForeignKey": "many_to_one", "OneToOneField": "one_to_one", "ManyToManyField": "many_to_many"}
COLUMNS = ("Column", "mapped_column")
ALCHEMY, DJANGO = ("Base", "DeclarativeBase"), ("Model",)
NAMES = ("Entity", "Table", "JoinColumn", *SIDES, *ASSOCIATIONS, *FIELDS, *COLUMNS, "relationship")
JVM, SCRIPT = ("java", "kt"), ("ts", "tsx", "js")


def snake(name: Column) -> Column:
    """OneToMany: one_to_many."""
    return F.lower(F.regexp_replace(name, r"(?<=[a-z])([A-Z])", "_$1"))


def first_word(args: Column) -> Column:
    """The first name among the arguments: bare, in quotes, or what an arrow without a body returns; its last part."""
    return F.nullif(F.element_at(F.split(F.regexp_extract(args, r"^\s*(?:\(?\s*\w*\s*\)?\s*=>\s*)?[\"']?([A-Za-z_$][\w$.]*)", 1), r"\."), -1), F.lit(""))


def option(args: Column, name: str) -> Column:
    """What a named argument is set to; null if it is not."""
    return F.nullif(F.regexp_extract(args, rf"\b{name}\s*[=:]\s*[\"']?([\w$.]+)", 1), F.lit(""))


def uses(files: DataFrame) -> DataFrame:
    """repo, file, ext, type, and the struct u of uses of NAMES and of types: a row each."""
    p = symbols.parse(files, NAMES)
    named = F.filter("uses", lambda u: u["name"].isin(*NAMES) & ~u["declares"])
    field = lambda c, kind: F.lit(None).cast(kind).alias(c)
    of_use = lambda u: F.struct(u["mark"].alias("mark"), u["owner"].alias("owner"), u["name"].alias("name"), F.coalesce(u["args"], F.lit("")).alias("args"), u["line"].alias("line"), u["start"].alias("start"), u["type"].alias("type"), u["ahead"].alias("ahead"), u["ahead_name"].alias("ahead_name"), u["after"].alias("after"), u["field"].alias("field"), field("bases", "array<string>"))
    of_type = lambda t: F.struct(F.lit("type").alias("mark"), F.lit("").alias("owner"), t["name"].alias("name"), F.lit("").alias("args"), t["line"].alias("line"), t["start"].alias("start"), t["name"].alias("type"), field("ahead", "string"), field("ahead_name", "string"), field("after", "string"), field("field", "string"), t["extends"].alias("bases"))
    return p.filter(F.col("ext").isin(*JVM, *SCRIPT, "py")).select("repo", "file", "ext", F.inline(F.concat(F.transform(named, of_use), F.transform("types", of_type))))


def assigned_texts(files: DataFrame) -> DataFrame:
    """repo, file, line, field, text: Python fields that are set to a literal."""
    set_ = r"(?m)^[ \t]+(__tablename__|db_table)[ \t]*=[ \t]*[\"']([^\"']+)[\"']"
    from ..functions.text import spans
    from ..sources.corpus import extension

    s = files.filter(extension(F.col("path")) == "py").select("repo", F.col("path").alias("file"), F.explode(spans(F.col("content"), set_, 2)).alias("s"))
    return s.select("repo", "file", F.col("s.line").alias("line"), F.col("s.a").alias("field"), F.col("s.b").alias("text"))


def entities(files: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """repo, file, line, name, table, table_resolved, framework of JPA, TypeORM, SQLAlchemy and Django; an entity without a table of its own goes by its name."""
    u = symbols.written(uses(files)) if found is None else found
    types = u.filter("mark = 'type'").select("repo", "file", "ext", "line", "name", "bases")
    quoted = F.nullif(F.regexp_extract("args", r"[\"']([^\"']+)[\"']", 1), F.lit(""))
    marked = u.filter("mark = '@' and ahead = 'type' and name in ('Entity', 'Table')")
    own = F.when(F.col("ext").isin(*JVM), F.when(F.col("name") == "Table", F.nullif(F.regexp_extract("args", r"\bname\s*=\s*\"([^\"]+)", 1), F.lit("")))).otherwise(F.when(F.col("args").rlike(r"^\s*[\"']"), quoted).otherwise(F.nullif(F.regexp_extract("args", r"\bname\s*:\s*[\"']([^\"']+)", 1), F.lit(""))))
    marked = marked.groupBy("repo", "file", F.col("ahead_name").alias("name")).agg(F.max(own).alias("_t"), F.bool_or(F.col("name") == "Entity").alias("_e"))
    by_mark = types.filter("ext <> 'py'").join(marked.filter("_e"), ["repo", "file", "name"]).withColumn("framework", F.when(F.col("ext").isin(*JVM), "jpa").otherwise("typeorm"))
    # a field belongs to the last type that begins before it
    said = assigned_texts(files)
    both = types.filter("ext = 'py'").select("repo", "file", "line", F.col("name").alias("type"), "bases", F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("text")).unionByName(said.withColumn("type", F.lit(None).cast("string")).withColumn("bases", F.lit(None).cast("array<string>")))
    w = W.partitionBy("repo", "file").orderBy("line").rowsBetween(W.unboundedPreceding, W.currentRow)
    both = both.withColumn("_c", F.last(F.when(F.col("type").isNotNull(), F.struct("type", "line", "bases")), ignorenulls=True).over(w)).filter("_c is not null")
    g = both.groupBy("repo", "file", F.col("_c.line").alias("line"), F.col("_c.type").alias("name")).agg(F.first("_c.bases").alias("bases"), F.min("text").alias("_t"), F.coalesce(F.bool_or(F.col("field") == "__tablename__"), F.lit(False)).alias("_a"))
    last = F.transform("bases", lambda b: F.element_at(F.split(b, r"\."), -1))
    held = lambda names: F.arrays_overlap(last, F.array(*map(F.lit, names)))
    python = g.withColumn("framework", F.when(F.col("_a") | held(ALCHEMY), "sqlalchemy").when(held(DJANGO), "django")).filter("framework is not null")
    cols = ["repo", "file", "line", "name", "_t", "framework"]
    out = by_mark.select(*cols).unionByName(python.select(*cols))
    return out.select("repo", "file", "line", "name", F.coalesce("_t", "name").alias("table"), F.col("_t").isNotNull().alias("table_resolved"), "framework")


def entity_relations(files: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """repo, file, line, from_entity, to_entity, to_is_table, framework, cardinality, owning_side, field. A relationship alone does not tell how many: unknown."""
    u = symbols.written(uses(files)) if found is None else found
    name, args, py = F.col("name"), F.col("args"), F.col("ext") == "py"
    jvm, script = F.col("ext").isin(*JVM), F.col("ext").isin(*SCRIPT)
    # the type of the field behind an annotation: what a collection holds, or the word before the field's name (in Kotlin, behind its colon)
    words = F.filter(F.split(F.regexp_replace("after", r"<[^<>]*>", " "), r"[\s:]+"), lambda w: (w != "") & ~w.isin(*symbols.MODIFIERS))
    held = F.nullif(F.regexp_extract("after", r"<\s*(?:\w+\s+)*([A-Z][\w$]*)\s*\??\s*>", 1), F.lit(""))
    behind = F.when(F.contains("after", F.lit(":")), F.element_at(words, -1)).otherwise(F.get(words, F.size(words) - 2))
    behind = F.when(behind.rlike("^[A-Z]"), F.regexp_replace(behind, r"\?$", ""))
    row = lambda d, start, target, framework, many, owning=F.lit(True), is_table=F.lit(False): d.select(
        "repo", "file", "line", start.alias("from_entity"), target.alias("to_entity"), is_table.alias("to_is_table"), framework.alias("framework"), many.alias("cardinality"), owning.alias("owning_side"), "field"
    )
    marked = u.filter((F.col("mark") == "@") & name.isin(*SIDES))
    jpa = row(marked.filter(jvm), F.col("type"), F.coalesce(option(args, "targetEntity"), held, behind), F.lit("jpa"), snake(name), option(args, "mappedBy").isNull())
    jpa = jpa.withColumn("to_entity", F.regexp_replace("to_entity", r"(?:\.class|::class)$", ""))
    typed = row(marked.filter(script), F.col("type"), first_word(args), F.lit("typeorm"), snake(name))
    kinds = F.create_map(*(F.lit(x) for pair in {**ASSOCIATIONS, **FIELDS}.items() for x in pair))
    models = F.col("owner").rlike("^[A-Z]") & name.isin(*ASSOCIATIONS)
    sequelize = row(u.filter(script & (F.col("mark") == "") & models), F.element_at(F.split("owner", r"\."), -1), F.when(first_word(args).rlike("^[A-Z]"), first_word(args)), F.lit("sequelize"), kinds[name], name != "belongsTo")
    fields = u.filter(py & (F.col("mark") == "") & F.col("field").isNotNull() & (F.col("type") != ""))
    key = F.nullif(F.regexp_extract(args, r"ForeignKey\s*\(\s*[\"']([\w.]+)\.\w+[\"']", 1), F.lit(""))
    columns = row(fields.filter(name.isin(*COLUMNS)), F.col("type"), key, F.lit("sqlalchemy"), F.when(option(args, "unique") == "True", "one_to_one").otherwise("many_to_one"), is_table=F.lit(True))
    related = row(fields.filter(name == "relationship"), F.col("type"), first_word(args), F.lit("sqlalchemy"), F.when(option(args, "secondary").isNotNull(), "many_to_many").when(option(args, "uselist") == "False", "one_to_one").otherwise("unknown"))
    django = row(fields.filter(name.isin(*FIELDS) & (F.col("owner") != "")), F.col("type"), first_word(args), F.lit("django"), kinds[name])
    out = jpa
    for d in (typed, sequelize, columns, related, django):
        out = out.unionByName(d)
    return out.filter("from_entity <> '' and to_entity is not null")
