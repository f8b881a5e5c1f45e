"""Mappers, bindings and routines of each kind."""

from cairn.operators import bindings, graph, orm

from .test_project import FILES, rows

JAVA = '@Entity\n@Table(name = "orders")\npublic class Order {\n  @ManyToOne\n  @JoinColumn(name = "c_id")\n  private Customer customer;\n  @OneToMany(mappedBy = "order")\n  private List<Item> items;\n}\n'
TS = '@Entity({ name: "shops" })\nexport class Shop {\n  @OneToMany(() => Item, i => i.shop)\n  items: Item[];\n}\n@Entity()\nclass Bare {}\nUser.belongsTo(Company);\nUser.hasMany(Role, {});\n'
PY = 'class A(Base):\n    __tablename__ = "as"\n    b_id = Column(Integer, ForeignKey("s.bs.id"), unique=True)\n    bs = relationship("B", secondary=ab)\n    c = relationship("C")\nclass D(models.Model):\n    e = models.ForeignKey("app.E", on_delete=x)\n    f = models.ManyToManyField(F)\nclass Plain(object):\n    pass\n'


def test_entities(spark):
    f = spark.createDataFrame([("r", "O.java", JAVA), ("r", "s.ts", TS), ("r", "m.py", PY), ("r", "n.py", None)], FILES)
    assert rows(orm.entities(f), "name", "table", "table_resolved", "framework") == [
        ("A", "as", True, "sqlalchemy"), ("Bare", "Bare", False, "typeorm"), ("D", "D", False, "django"), ("Order", "orders", True, "jpa"), ("Shop", "shops", True, "typeorm"),
    ]
    assert rows(orm.entity_relations(f), "from_entity", "to_entity", "framework", "cardinality", "owning_side", "to_is_table") == [
        ("A", "B", "sqlalchemy", "many_to_many", True, False), ("A", "C", "sqlalchemy", "unknown", True, False), ("A", "s.bs", "sqlalchemy", "one_to_one", True, True), ("D", "E", "django", "many_to_one", True, False),
        ("D", "F", "django", "many_to_many", True, False), ("Order", "Customer", "jpa", "many_to_one", True, False), ("Order", "Item", "jpa", "one_to_many", False, False), ("Shop", "Item", "typeorm", "one_to_many", True, False),
        ("User", "Company", "sequelize", "many_to_one", False, False), ("User", "Role", "sequelize", "one_to_many", True, False),
    ]


def test_bindings(spark):
    f = spark.createDataFrame([
        ("r", "F.cs", "void Init() {\n  this.btn.Click += new EventHandler(OnSave);\n  list.Changed += this.OnList;\n}\n"), ("r", "p.aspx", '<asp:Button id="b"\n OnClick="Save_Click" />\n<a href="x">'),
        ("r", "J.java", 'class J {\n  @Scheduled(cron = "0 0")\n  public void nightly() {\n  }\n  public static void main(String[] a) {\n  }\n}\n'), ("r", "n.cs", None),
    ], FILES)
    b = bindings.extract_bindings(f)
    assert rows(b, "trigger", "handler_name", "type") == [
        ("F.cs#btn.Click", "OnSave", "ui_event"), ("F.cs#list.Changed", "OnList", "ui_event"), ('J.java#process-entry', "main", "process_entry"), ('J.java#scheduled:cron = "0 0"', "nightly", "scheduler"),
        ("p.aspx#asp:Button.Save_Click", "Save_Click", "markup_event"),
    ]
    nodes = spark.createDataFrame([("r", "J.main"), ("r", "A.OnSave"), ("r", "B.OnSave")], "repo string, id string")
    got = rows(bindings.resolve_bindings(b, graph.candidate_index(nodes)).fillna(""), "handler_name", "kind", "target")
    assert got == [("OnList", "unresolved_trigger", ""), ("OnSave", "unresolved_trigger", ""), ("Save_Click", "unresolved_trigger", ""), ("main", "edge", "J.main"), ("nightly", "unresolved_trigger", "")]


def test_routines(spark):
    f = spark.createDataFrame([
        ("r", "a/b.vb", "Public Sub Go()\nEnd Sub\n  function Back\n"), ("r", "c.php", "<?php function f($x) {}\nfunction f() {}"), ("r", "d.rb", "def ok?\nend"), ("r", "e.cbl", "       DATA.\n       MAIN-PART.\n"), ("r", "g.html", ""), ("r", "h.java", "def no"), ("r", "i.rb", None),
    ], FILES)
    assert rows(bindings.legacy_symbols(f), "id", "line", "type") == [
        ("a.b.Back", 3, "function"), ("a.b.Go", 1, "function"), ("c.f", 1, "function"), ("d.ok?", 1, "function"), ("e.MAIN-PART", 2, "function"), ("view:g.html", 1, "view"),
    ]
