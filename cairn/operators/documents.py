"""Markdown documents of repositories, the tests and commands of their code, and what their sections say about domains and limits. Texts are read line by line (`functions.markup`), code by its stored facts (`symbols`)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.markup import body_lines, cells, is_item, is_row, is_rule, one_line, spoken
from ..functions.text import slugify, tokens
from ..sources.corpus import extension
from . import symbols
from .markdown import sections
from .search import containing
from .statistics import is_test

#: Folders that hold no documents of their own.
SKIPPED_FOLDERS = ".git .hg .svn .cache .codex .next .nuxt node_modules vendor dist build out target coverage site-packages .venv venv pods _workspace_prev".split()
#: Kinds of documents with the words of a path that tell them, in the order in which they are tried: of a folder's name, and anywhere.
CATEGORIES = (
    ("ADR / decisions", "adr decision decisions".split(), ()),
    ("API", "api apis openapi swagger".split(), ()),
    ("Architecture / design", (), "architecture architectural design diagram".split()),
    ("Operations", (), "runbook operation deploy release troubleshoot".split()),
    ("Specifications", (), "spec requirement".split()),
)
#: Further marks in a folder's or file's name; ^ is its beginning.
MARKED = {"ADR / decisions": ("^adr-", "^adr_"), "API": ("api-", "api_")}
#: Words of reports on quality, and of scripts that check something.
REPORT_WORDS = "qa quality test validator validation coverage 검증 테스트".split()
COMMAND_WORDS = "test lint check verify validate coverage quality".split()
#: Build tools by a file at the root of a repository.
TOOLS = {"pom.xml": "mvn test", "gradlew": "./gradlew test", "gradlew.bat": "./gradlew test", "pytest.ini": "pytest", "pyproject.toml": "pytest"}
#: Words of a note on the analysis, and words of caution, compared without blanks, hyphens and underscores.
LIMIT_WORDS = "인덱서 indexer 결정적분석 정적분석 호출그래프 callgraph 데드코드 deadcode indegree outdegree".split()
CAUTION_WORDS = "한계 제약 누락 미탐지 오탐 검증필요 자동제거금지 불완전 주의 위험 확인필요".split()
#: Titles of glossaries; titles that are no domains; heads of glossary tables.
GLOSSARY = "도메인 용어 glossary".split()
NO_DOMAIN = ("개요", "기술", "역할", "책임", "흐름", "위험", "불변", "용어", "주의", "워크스페이스", "프로젝트", "도메인 지식", "domain knowledge")
TABLE_HEADS = "용어 도메인 name term".split()
#: Names of credentials, and beginnings of stand-ins.
CREDENTIALS = "password passwd secret apikey api_key api-key accesstoken access_token access-token".split()
STAND_INS = ("[", "<", "*", "unknown", "null", "none", "미확인")
MOST_CASES = 100
MOST_RELATED = 100


def holds_any(text: Column, words) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(text), w))


def _close(text: Column) -> Column:
    return F.translate(F.lower(text), " _-\t", "")


def _category(path: Column) -> Column:
    """What the folders and words of a path say."""
    low = F.lower(path)
    parts = F.split(low, "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    name = F.element_at(parts, -1)
    out = F.when(parts[0] == "_workspace", "Harness reports").when((parts[0] == ".claude") | (low == "claude.md"), "Harness knowledge")
    for label, of_folder, of_any in CATEGORIES:
        told = F.arrays_overlap(folders, F.array(*map(F.lit, of_folder))) if of_folder else F.lit(False)
        told = told | F.exists(parts, lambda p: F.exists(F.array(*map(F.lit, MARKED.get(label, ("/",)))), lambda m: F.contains(F.concat(F.lit("^"), p), m)))
        out = out.when(told | holds_any(low, of_any) if of_any else told, label)
    return out.when(F.get(F.split(name, r"[._-]"), 0) == "readme", "README").otherwise("Project documents")


def markdown_documents(files: DataFrame, generated: tuple[str, ...] = ("CLAUDE.md", ".claude/", "_workspace/")) -> DataFrame:
    """repo, path, title, plain, category, origin, slug: the title is the first heading of level 1, else the file's name; the slug ends in ten digits of a hash of repo and path, so that it is stable and its own. origin:
    generated below the given paths, else source. Documents of skipped folders and a plug-in's own are left out."""
    parts = F.split(F.lower("path"), "/")
    own = F.exists(F.array(*map(F.lit, generated)), lambda g: F.when(g.endswith("/"), F.startswith("path", g)).otherwise(F.col("path") == g))
    kept = files.filter(extension(F.col("path")).isin("md", "mdx") & ~F.arrays_overlap(parts, F.array(*map(F.lit, SKIPPED_FOLDERS))))
    lines = body_lines(F.col("content"))
    heading = F.get(F.filter(lines, lambda x: x.startswith("# ") & (F.trim(F.substr(x, F.lit(2), F.length(x))) != "")), 0)
    plain = one_line(F.translate(F.array_join(F.transform(lines, lambda x: spoken(F.ltrim(x, F.lit("#>*+-")), True)), " "), "_", ""))
    name = F.element_at(F.split("path", "/"), -1)
    bare = F.substr(name, F.lit(1), F.length(name) - F.length(F.element_at(F.split(name, r"\."), -1)) - 1)
    digest = F.substring(F.sha1(F.concat_ws("\u0000", "repo", "path")), 1, 10)
    whole = F.substr("path", F.lit(1), F.length("path") - F.length(F.element_at(F.split("path", r"\."), -1)) - 1)
    return kept.select(
        "repo", "path", F.coalesce(F.trim(F.substr(heading, F.lit(2), F.length(heading))), bare).alias("title"), plain.alias("plain"), _category(F.col("path")).alias("category"), F.when(own, "generated").otherwise("source").alias("origin"),
        F.concat_ws("-", slugify(whole, "document"), digest).alias("slug"),
    )


def quality_reports(docs: DataFrame) -> DataFrame:
    """Documents whose path or title speaks of tests or quality, patterns left out."""
    return docs.filter(~F.startswith("path", F.lit(".claude/patterns/")) & holds_any(F.concat_ws(" ", "path", "title"), REPORT_WORDS))


def test_cases(files: DataFrame) -> DataFrame:
    """repo, file, name: the first hundred distinct cases of each test file: calls of test, it and describe by their title, functions and methods that are named as tests, and methods that are marked so."""
    p = symbols.parse(files.filter(is_test(F.col("path"))), ("test", "it", "describe"), only=("test", "it", "describe", "Test"))
    case = lambda name, line: F.struct(line.alias("line"), name.alias("name"))
    quote = F.array(*map(F.lit, ("'", '"', "`")))

    def title(u: Column) -> Column:
        """What stands between the quotes that the arguments begin with."""
        args = F.ltrim(F.coalesce(u["args"], F.lit("")), F.lit(" \t\r\n"))
        said = F.get(F.split(args, "[\"'`]"), 1)
        return F.when(F.array_contains(quote, F.substring(args, 1, 1)) & (F.length(said) >= 2), F.substring(said, 1, 160))

    called = F.transform(F.filter("uses", lambda u: (u["mark"] == "") & u["name"].isin("test", "it", "describe")), lambda u: case(title(u), u["line"]))
    named = F.transform(F.filter("methods", lambda m: ((F.col("ext") == "py") & m["name"].startswith("test_")) | ((F.col("ext") == "go") & m["name"].startswith("Test"))), lambda m: case(m["name"], m["line"]))
    marked = F.transform(F.filter("uses", lambda u: (u["mark"] == "@") & (u["name"] == "Test")), lambda u: case(F.when(u["ahead"] == "method", u["ahead_name"]), u["line"]))
    # a row per file all the way: its cases in order, each name where it comes first
    cases = F.filter(F.concat(called, named, marked), lambda c: c["name"].isNotNull())
    c = p.select("repo", "file", cases.alias("_c")).filter(F.size("_c") > 0).groupBy("repo", "file").agg(F.sort_array(F.flatten(F.collect_list("_c"))).alias("_c"))
    names = F.array_distinct(F.transform("_c", lambda c: c["name"]))
    return c.select("repo", "file", F.explode(F.slice(names, 1, MOST_CASES)).alias("name"))


def quality_commands(files: DataFrame) -> DataFrame:
    """repo, command: scripts of the root's package.json that check something, and what the build tools at the root run."""
    root = files.filter(~F.contains("path", F.lit("/")))
    scripts = F.map_keys(F.from_json("content", "scripts map<string,string>")["scripts"])
    npm = root.filter(F.col("path") == "package.json").select("repo", F.explode(scripts).alias("_s")).filter(holds_any(F.col("_s"), COMMAND_WORDS))
    npm = npm.select("repo", F.when(F.col("_s") == "test", "npm test").otherwise(F.concat(F.lit("npm run "), "_s")).alias("command"))
    tool = F.when(extension(F.col("path")).isin("sln", "csproj"), "dotnet test")
    for name, command in TOOLS.items():
        tool = tool.when(F.col("path") == name, command)
    return npm.unionByName(root.select("repo", tool.alias("command")).filter("command is not null")).distinct()


def document_findings(docs: DataFrame) -> DataFrame:
    """repo, path, placeholder, secret of documents (repo, path, content) that hold unfinished text, or a name of a credential with a value of 8 characters or more that is no stand-in. Words are looked at: a name, what
    sets it, and what follows."""
    low = F.lower("content")
    unfinished = F.contains(low, F.lit("[todo:")) | F.contains(low, F.lit("tbd")) | F.contains(_close(low), F.lit("작성예정"))
    words = F.filter(F.split(F.regexp_replace(F.replace("content", F.lit("="), F.lit(":")), ":", " : "), r"\s+"), lambda w: w != "")
    set_ = F.transform(words, lambda w, i: F.struct(F.lower(F.get(words, i - 1)).alias("name"), F.trim(F.coalesce(F.get(words, i + 1), F.lit("")), F.lit("\"'")).alias("value"), (w == ":").alias("sets")))
    ends = lambda n: F.exists(F.array(*map(F.lit, CREDENTIALS)), lambda c: F.endswith(n, c) & ~F.substr(n, F.length(n) - F.length(c), F.lit(1)).rlike("[a-z]"))
    value = lambda v: F.split(v, "[\"']")[0]
    real = F.exists(set_, lambda s: s["sets"] & ends(F.concat(F.lit(" "), F.rtrim(s["name"], F.lit("\"'")))) & (F.length(value(s["value"])) >= 8) & ~F.exists(F.array(*map(F.lit, STAND_INS)), lambda x: F.startswith(F.lower(s["value"]), x)))
    return docs.select("repo", "path", F.coalesce(unfinished, F.lit(False)).alias("placeholder"), F.coalesce(real, F.lit(False)).alias("secret")).filter("placeholder or secret")


def _first(rows: DataFrame, key: list[str], order: list[str], rest: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.min(F.struct(*order, *rest)).alias("_w")).select(*key, *(F.col("_w")[c].alias(c) for c in rest))


def domains(docs: DataFrame) -> DataFrame:
    """repo, name, summary, slug: terms of glossary tables and of `term: text` bullets, and other sections of 20 characters or more; the first of a name."""
    s = sections(docs)
    b = s.filter(holds_any(F.col("title"), GLOSSARY)).select("repo", "path", "ord", F.posexplode(F.split("body", "\n")).alias("n", "_l"))
    c = cells(F.col("_l"))
    table = b.filter(is_row(F.col("_l")) & ~is_rule(F.col("_l")) & (F.size(c) > 1) & ~holds_any(c[0], TABLE_HEADS))
    table = table.select("repo", "path", "ord", "n", c[0].alias("name"), F.array_join(F.slice(c, F.lit(2), F.size(c)), " · ").alias("summary"))
    line = F.replace(F.trim("_l"), F.lit("："), F.lit(":"))
    term = F.trim(F.substr(F.substring_index(line, ":", 1), F.lit(2), F.length(line)))
    text = F.trim(F.substr(line, F.length(F.substring_index(line, ":", 1)) + 2, F.length(line)))
    bullet = b.filter(F.substring(line, 1, 1).isin("-", "*") & F.contains(line, F.lit(":")) & F.length(term).between(2, 40) & (text != "")).select("repo", "path", "ord", "n", term.alias("name"), text.alias("summary"))
    other = s.filter(~holds_any(F.col("title"), NO_DOMAIN) & (F.length("body") >= 20)).select("repo", "path", "ord", F.lit(1 << 30).alias("n"), F.col("title").alias("name"), F.col("body").alias("summary"))
    one = _first(table.unionByName(bullet).unionByName(other).withColumn("summary", F.substring("summary", 1, 500)), ["repo", "name"], ["path", "ord", "n"], ["summary"])
    return one.withColumn("slug", F.concat_ws("-", slugify(F.col("repo")), slugify(F.col("name"), "domain")))


def limit_notes(docs: DataFrame) -> DataFrame:
    """repo, title, text: paragraphs, bullets and table rows that name a limit of the analysis and a caution, or stand in a section whose title does; each text once. A block begins behind an empty line and with each bullet and
    row; heads of tables are none."""
    both = lambda t: holds_any(_close(t), LIMIT_WORDS) & holds_any(_close(t), CAUTION_WORDS)
    s = sections(docs).select("repo", "path", "ord", "title", both(F.col("title")).alias("_all"), F.posexplode(F.split("body", "\n")).alias("n", "_l"))
    keys = ["repo", "path", "ord"]
    w = W.partitionBy(*keys).orderBy("n")
    line, last, next_ = F.col("_l"), F.lag("_l").over(w), F.lead("_l").over(w)
    heads = is_row(line) & F.coalesce(is_rule(next_), F.lit(False))
    begins = last.isNull() | (F.trim(last) == "") | is_item(line) | is_row(line)
    s = s.withColumns({"_b": begins, "_h": heads}).withColumn("_k", F.count_if("_b").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))).filter(~F.col("_h") & ~is_rule(line) & (F.trim(line) != ""))
    block = s.groupBy(*keys, "title", "_all", "_k").agg(F.sort_array(F.collect_list(F.struct("n", "_l"))).alias("_s"))
    bare = lambda x: F.when(is_row(x), F.array_join(cells(x), " · ")).when(F.ltrim(x).startswith(">") | (is_item(x) & F.substring(F.ltrim(x), 1, 1).isin("-", "*", "+")), F.substr(F.ltrim(x), F.lit(2), F.length(x))).otherwise(x)
    said = block.select(*keys, "title", "_all", F.col("_s")[0]["n"].alias("n"), one_line(F.array_join(F.transform("_s", lambda x: spoken(bare(x["_l"]), False)), " ")).alias("text"))
    said = said.filter((F.col("text") != "") & (F.col("_all") | both(F.col("text"))))
    return _first(said.withColumn("_k", F.lower("text")), ["repo", "_k"], ["path", "ord", "n"], ["title", "text"]).drop("_k")


#: Names too common to find a node by.
COMMON_NAMES = "call create delete execute get handle handler index init list main method operation post process run select service unknown update".split()


def notes_of_nodes(notes: DataFrame, nodes: DataFrame) -> DataFrame:
    """repo, text_id, term_id: notes(repo, note_id, text) with the nodes(repo, id, label, file) they speak of: by file, its name, the id or its last two or
    three parts, or the label; terms of six characters or more."""
    plain = lambda c: F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("\\"), F.lit("/"))
    file, label = plain(F.col("file")), F.lower(F.coalesce("label", F.lit("")))
    parts = F.filter(F.split(F.lower("id"), r"[.:/#]+"), lambda x: x != "")
    tail = lambda n: F.when(F.size(parts) >= n, F.array_join(F.slice(parts, F.greatest(F.size(parts) - (n - 1), F.lit(1)), F.lit(n)), "."))
    own = lambda c, n: F.when((F.length(c) > n) & ~c.isin(*COMMON_NAMES), c)
    terms = F.array_distinct(F.array_compact(F.array(file, F.element_at(F.split(file, "/"), -1), own(F.lower("id"), 5), tail(2), tail(3), own(label, 7))))
    k = nodes.select("repo", F.col("id").alias("term_id"), F.explode(terms).alias("term"))
    return containing(notes.select("repo", F.col("note_id").alias("text_id"), plain(F.col("text")).alias("text")), k, 6).withColumnsRenamed({"text_id": "note_id", "term_id": "node_id"})


def related_items(domain: DataFrame, items: DataFrame) -> DataFrame:
    """repo, name, kind, id: items(repo, kind, id, text) that hold one of the first twenty words (three characters or more) of a domain(repo, name, summary);
    the first hundred of each kind by id."""
    words = F.filter(tokens(F.concat_ws(" ", "name", "summary")), lambda w: (F.length(w) > 2) & ~w.isin("service", "system", "domain", "관리", "처리", "업무"))
    terms = domain.select("repo", F.col("name").alias("term_id"), F.explode(F.slice(words, 1, 20)).alias("term"))
    texts = items.select("repo", F.struct("kind", "id").alias("text_id"), F.lower("text").alias("text"))
    hit = containing(texts, terms, 3).select("repo", F.col("term_id").alias("name"), "text_id.kind", "text_id.id")
    w = W.partitionBy("repo", "name", "kind").orderBy("id")
    return hit.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= MOST_RELATED).drop("_r")
