"""Queries over web frameworks, mappers, bindings and routines, with their oracle SQL: a file per part, of a kind that follows from its key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bindings, graph, orm, web

#: Formats with a content in which # stands for the part's key.
WEB = (
    ("java", '@RequestMapping("/base")\nclass A {\n  @PutMapping("/j#/{id}")\n  public void put#(String id) {\n  }\n}\nclass B {\n  @RequestMapping(path = "/plain#")\n  public void any#() {\n  }\n}\n'),
    ("cs", '[Route("api/[controller]")]\npublic class ShopController {\n  [HttpPost("c#")]\n  public Item Add#() {\n    http.GetAsync("/far/#");\n  }\n}\n'),
    ("py", '@router.get("/f/{x}/#")\ndef read#(x):\n    pass\n\n@app.route("/g#", methods=["POST", "DELETE"])\ndef write#():\n    pass\nurls = [path("d#/", views.list)]\n'),
    ("ts", "router.delete('/e#', drop#);\n// axios.get('/no')\nfetch(`/k/${id}/#`, {method: 'PUT'});\naxios.post('/x#', y);\n"),
    ("html", '<p>#</p>\n<form method="post" action="/form#">\n</form>\n<button id="b" OnClick="Save#">\n'),
    ("xml", "<action path='/s#' type='a.S#'>\n<servlet-mapping><servlet-name>n#</servlet-name>\n<url-pattern>/t#</url-pattern></servlet-mapping>\n"),
)
MAPPED = (
    ("java", '@Entity\n@Table(name = "t#")\npublic class J# {\n  @ManyToOne\n  private Customer c;\n  @OneToMany(mappedBy = "j")\n  private List<Item> items;\n}\n'),
    ("ts", "@Entity({ name: \"s#\" })\nexport class T# {\n  @OneToOne(() => Item, i => i.t)\n  item: Item;\n}\nT#.hasMany(Role);\n"),
    ("py", 'class A#(Base):\n    __tablename__ = "a#"\n    b_id = Column(Integer, ForeignKey("b#.id"))\n    c = relationship("C", secondary=ac)\nclass D#(models.Model):\n    e = models.OneToOneField("app.E")\n'),
)
#: The same over several lines, with brackets in arguments, bare annotations and options before the path.
WEB_LONG = (
    ("java", '@RestController\n@RequestMapping(\n    value = "/long#",\n    produces = {"a/b", "c(d)"}\n)\npublic class L# {\n  @GetMapping\n  public List<Item> all#() {\n  }\n  @PostMapping(\n    consumes = "x/y",\n    path = "/new"\n  )\n  public void add#(@RequestBody(required = isTrue(")")) Item i) {\n  }\n  static class In {\n    @DeleteMapping("/in")\n    void drop#() {\n    }\n  }\n}\n'),
    ("py", '@router.put(\n    "/l#/{x}",\n    dependencies=[Depends(check("a)"))],\n)\nasync def put#(x):\n    pass\n\n@app.route(\n    "/m#",\n    methods=[\n        "PATCH",\n    ],\n)\ndef patch#():\n    pass\n'),
    ("ts", "class C# {\n  async load(id) {\n    const r = await axios.post(\n      `/n#/${id}`,\n      {a: f(1)},\n    );\n    return fetch('/o#', {\n      headers: h({x: 1}),\n      method: 'PUT',\n    });\n  }\n}\n"),
)
MAPPED_LONG = (
    ("java", '@Entity\n@Table(\n    name = "long_#",\n    indexes = {@Index(columnList = "a(b)")}\n)\npublic class L# {\n  @ManyToOne(\n    fetch = FetchType.LAZY,\n    cascade = {CascadeType.ALL}\n  )\n  @JoinColumn(\n    name = "c_id"\n  )\n  private Customer owner;\n  @OneToMany(\n    mappedBy = "l",\n    orphanRemoval = true\n  )\n  private final List<Item> items = new ArrayList<>();\n}\n@Entity\nclass Second# {\n  @OneToOne(targetEntity = Third.class)\n  private Object third;\n}\n'),
    ("ts", "@Entity(\n  'ts_#',\n  { orderBy: { id: 'ASC' } },\n)\nexport class T# {\n  @ManyToMany(\n    () => Tag,\n    (t) => t.items,\n  )\n  tags: Tag[];\n}\nT#.belongsToMany(\n  Role,\n  { through: 'x' },\n);\n"),
    ("py", 'class A#(Base):\n    __tablename__ = "py_#"\n    b_id = mapped_column(\n        Integer,\n        ForeignKey(\n            "b#.id",\n        ),\n        unique=True,\n    )\n    c = relationship(\n        "C",\n        uselist=False,\n    )\n'),
)
STARTED = (
    ("cs", "void Init() {\n  this.btn#.Click += new EventHandler(OnSave#);\n}\n"),
    ("java", "class J# {\n  @Scheduled(fixedRate = #)\n  public void nightly#() {\n  }\n  public static void main(String[] a) {\n  }\n}\n"),
    ("aspx", '<asp:Button id="b"\n OnClick="Save#" />\n'),
)
ROUTINES = (("vb", "Public Sub Go#()\nEnd Sub\n"), ("php", "<?php\nfunction f#($x) {}\n"), ("rb", "class X\n  def ok#?\n  end\nend\n"), ("cbl", "       DATA.\n       PART-#.\n"), ("abap", "form do#.\n"), ("jsp", "<p>#</p>"))


def _files(spark: SparkSession, sf_dir: str, kinds) -> DataFrame:
    k = F.col("p_partkey")
    text, ext = k.cast("string"), F.array(*(F.lit(e) for e, _ in kinds))
    i = k % len(kinds)
    body = F.array(*(F.lit(c) for _, c in kinds))
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    at = lambda a: F.get(a, i.cast("int"))
    return p.select(F.concat(F.lit("w"), (k % 30).cast("string")).alias("repo"), F.concat(F.lit("src/f"), text, F.lit("."), at(ext)).alias("path"), F.replace(at(body), F.lit("#"), text).alias("content"))


def web_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = web.endpoints(_files(spark, sf_dir, WEB))
    return e.select("repo", "file", F.col("line").cast("long").alias("line"), "framework", "method", "path_pattern", "handler")


def web_consumers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = web.consumers(_files(spark, sf_dir, WEB))
    return c.select("repo", "file", F.col("line").cast("long").alias("line"), "call_type", "method", "path_pattern")


def mapped_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = orm.entities(_files(spark, sf_dir, MAPPED))
    return e.select("repo", "file", F.col("line").cast("long").alias("line"), "name", F.col("table").alias("table_name"), "table_resolved", "framework")


def mapped_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = orm.entity_relations(_files(spark, sf_dir, MAPPED))
    return r.select("repo", "file", "from_entity", "to_entity", "to_is_table", "framework", "cardinality", "owning_side")


def web_endpoints_over_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = web.endpoints(_files(spark, sf_dir, WEB_LONG))
    return e.select("repo", "file", F.col("line").cast("long").alias("line"), "framework", "method", "path_pattern", "handler")


def web_consumers_over_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = web.consumers(_files(spark, sf_dir, WEB_LONG))
    return c.select("repo", "file", F.col("line").cast("long").alias("line"), "call_type", "method", "path_pattern", "function")


def mapped_entities_over_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = orm.entities(_files(spark, sf_dir, MAPPED_LONG))
    return e.select("repo", "file", "name", F.col("table").alias("table_name"), "table_resolved", "framework")


def mapped_relations_over_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = orm.entity_relations(_files(spark, sf_dir, MAPPED_LONG))
    return r.select("repo", "file", "from_entity", "to_entity", "to_is_table", "framework", "cardinality", "owning_side")


def trigger_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Handlers are nodes where the part's key is even; OnSave of keys that four divides are two."""
    b = bindings.extract_bindings(_files(spark, sf_dir, STARTED))
    p, k = spark.read.parquet(f"{sf_dir}/part.parquet").filter("p_partkey % 2 = 0"), F.col("p_partkey")
    repo, text = F.concat(F.lit("w"), (k % 30).cast("string")).alias("repo"), k.cast("string")
    names = F.explode(F.array(F.concat(F.lit("A.OnSave"), text), F.concat(F.lit("A.nightly"), text), F.concat(F.lit("A.Save"), text))).alias("id")
    nodes = p.select(repo, names).unionByName(p.filter("p_partkey % 4 = 0").select(repo, F.concat(F.lit("B.OnSave"), text).alias("id")))
    return bindings.resolve_bindings(b, graph.candidate_index(nodes)).select("repo", "trigger", "handler_name", "type", "kind", "target")


def legacy_routines(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = bindings.legacy_symbols(_files(spark, sf_dir, ROUTINES))
    return s.select("repo", "file", F.col("line").cast("long").alias("line"), "id", "type")


_QUERIES = (
    web_endpoints, web_consumers, mapped_entities, mapped_relations, web_endpoints_over_lines, web_consumers_over_lines, mapped_entities_over_lines, mapped_relations_over_lines, trigger_bindings, legacy_routines,
)


def _oracle(n: int, columns: str, *rows: tuple) -> str:
    """Rows for each kind of file: (kind, extension, values)."""
    parts = " UNION ALL ".join(f"SELECT repo, 'src/f' || k || '.{ext}' AS file, {values} FROM p WHERE k % {n} = {kind}" for kind, ext, values in rows)
    return f"WITH p AS (SELECT p_partkey AS k, 'w' || (p_partkey % 30) AS repo FROM part), x(repo, file, {columns}) AS ({parts}) SELECT * FROM x"


_LINE = "CAST({} AS BIGINT), "
ORACLE = {
    "web_endpoints": _oracle(
        6, "line, framework, method, path_pattern, handler",
        (0, "java", _LINE.format(3) + "'spring', 'PUT', '/base/j' || k || '/{param}', 'put' || k"), (0, "java", _LINE.format(8) + "'spring', 'ANY', '/plain' || k, 'any' || k"),
        (1, "cs", _LINE.format(3) + "'aspnet', 'POST', '/api/shop/c' || k, 'Add' || k"), (2, "py", _LINE.format(1) + "'fastapi', 'GET', '/f/{param}/' || k, 'read' || k"),
        (2, "py", _LINE.format(5) + "'flask', 'POST', '/g' || k, 'write' || k"), (2, "py", _LINE.format(5) + "'flask', 'DELETE', '/g' || k, 'write' || k"), (2, "py", _LINE.format(8) + "'django', 'ANY', '/d' || k, 'views.list'"),
        (3, "ts", _LINE.format(1) + "'express', 'DELETE', '/e' || k, 'drop' || k"), (5, "xml", _LINE.format(1) + "'struts', 'ANY', '/s' || k, 'a.S' || k"), (5, "xml", _LINE.format(2) + "'servlet', 'ANY', '/t' || k, 'n' || k"),
    ),
    "web_consumers": _oracle(
        6, "line, call_type, method, path_pattern", (1, "cs", _LINE.format(5) + "'HttpClient', 'GET', '/far/' || k"), (3, "ts", _LINE.format(3) + "'fetch', 'PUT', '/k/{param}/' || k"),
        (3, "ts", _LINE.format(4) + "'axios', 'POST', '/x' || k"), (4, "html", _LINE.format(2) + "'html-form', 'POST', '/form' || k"),
    ),
    "mapped_entities": _oracle(
        3, "line, name, table_name, table_resolved, framework", (0, "java", _LINE.format(3) + "'J' || k, 't' || k, true, 'jpa'"), (1, "ts", _LINE.format(2) + "'T' || k, 's' || k, true, 'typeorm'"),
        (2, "py", _LINE.format(1) + "'A' || k, 'a' || k, true, 'sqlalchemy'"), (2, "py", _LINE.format(5) + "'D' || k, 'D' || k, false, 'django'"),
    ),
    "mapped_relations": _oracle(
        3, "from_entity, to_entity, to_is_table, framework, cardinality, owning_side", (0, "java", "'J' || k, 'Customer', false, 'jpa', 'many_to_one', true"), (0, "java", "'J' || k, 'Item', false, 'jpa', 'one_to_many', false"),
        (1, "ts", "'T' || k, 'Item', false, 'typeorm', 'one_to_one', true"), (1, "ts", "'T' || k, 'Role', false, 'sequelize', 'one_to_many', true"), (2, "py", "'A' || k, 'b' || k, true, 'sqlalchemy', 'many_to_one', true"),
        (2, "py", "'A' || k, 'C', false, 'sqlalchemy', 'many_to_many', true"), (2, "py", "'D' || k, 'E', false, 'django', 'one_to_one', true"),
    ),
    "web_endpoints_over_lines": _oracle(
        3, "line, framework, method, path_pattern, handler", (0, "java", _LINE.format(7) + "'spring', 'GET', '/long' || k, 'all' || k"), (0, "java", _LINE.format(10) + "'spring', 'POST', '/long' || k || '/new', 'add' || k"),
        (0, "java", _LINE.format(17) + "'spring', 'DELETE', '/in', 'drop' || k"), (1, "py", _LINE.format(1) + "'fastapi', 'PUT', '/l' || k || '/{param}', 'put' || k"), (1, "py", _LINE.format(8) + "'flask', 'PATCH', '/m' || k, 'patch' || k"),
    ),
    "web_consumers_over_lines": _oracle(3, "line, call_type, method, path_pattern, function", (2, "ts", _LINE.format(3) + "'axios', 'POST', '/n' || k || '/{param}', 'load'"), (2, "ts", _LINE.format(7) + "'fetch', 'PUT', '/o' || k, 'load'")),
    "mapped_entities_over_lines": _oracle(
        3, "name, table_name, table_resolved, framework", (0, "java", "'L' || k, 'long_' || k, true, 'jpa'"), (0, "java", "'Second' || k, 'Second' || k, false, 'jpa'"), (1, "ts", "'T' || k, 'ts_' || k, true, 'typeorm'"), (2, "py", "'A' || k, 'py_' || k, true, 'sqlalchemy'"),
    ),
    "mapped_relations_over_lines": _oracle(
        3, "from_entity, to_entity, to_is_table, framework, cardinality, owning_side", (0, "java", "'L' || k, 'Customer', false, 'jpa', 'many_to_one', true"), (0, "java", "'L' || k, 'Item', false, 'jpa', 'one_to_many', false"),
        (0, "java", "'Second' || k, 'Third', false, 'jpa', 'one_to_one', true"), (1, "ts", "'T' || k, 'Tag', false, 'typeorm', 'many_to_many', true"), (1, "ts", "'T' || k, 'Role', false, 'sequelize', 'many_to_many', true"),
        (2, "py", "'A' || k, 'b' || k, true, 'sqlalchemy', 'one_to_one', true"), (2, "py", "'A' || k, 'C', false, 'sqlalchemy', 'one_to_one', true"),
    ),
    "trigger_bindings": """WITH p AS (SELECT p_partkey AS k, 'w' || (p_partkey % 30) AS repo FROM part), x AS (
 SELECT repo, k, 'src/f' || k || '.cs#btn' || k || '.Click' AS trigger, 'OnSave' || k AS handler_name, 'ui_event' AS type, k % 4 = 2 AS one FROM p WHERE k % 3 = 0
 UNION ALL SELECT repo, k, 'src/f' || k || '.java#scheduled:fixedRate = ' || k, 'nightly' || k, 'scheduler', k % 2 = 0 FROM p WHERE k % 3 = 1 UNION ALL SELECT repo, k, 'src/f' || k || '.java#process-entry', 'main', 'process_entry', false FROM p WHERE k % 3 = 1
 UNION ALL SELECT repo, k, 'src/f' || k || '.aspx#asp:Button.Save' || k, 'Save' || k, 'markup_event', k % 2 = 0 FROM p WHERE k % 3 = 2)
 SELECT repo, trigger, handler_name, type, CASE WHEN one THEN 'edge' ELSE 'unresolved_trigger' END AS kind, CASE WHEN one THEN 'A.' || handler_name END AS target FROM x""",
    "legacy_routines": _oracle(
        6, "line, id, type", (0, "vb", _LINE.format(1) + "'src.f' || k || '.Go' || k, 'function'"), (1, "php", _LINE.format(2) + "'src.f' || k || '.f' || k, 'function'"), (2, "rb", _LINE.format(2) + "'src.f' || k || '.ok' || k || '?', 'function'"),
        (3, "cbl", _LINE.format(2) + "'src.f' || k || '.PART-' || k, 'function'"), (4, "abap", _LINE.format(1) + "'src.f' || k || '.do' || k, 'function'"), (5, "jsp", _LINE.format(1) + "'view:src/f' || k || '.jsp', 'view'"),
    ),
}


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict:
    return dict(ORACLE)
