"""Endpoints and consumers of each framework."""

from cairn.operators import web

from .test_project import FILES, rows

JAVA = (
    '@RequestMapping("/a")\npublic class A {\n  // @GetMapping("/no")\n  @GetMapping("/x/{id}")\n  public String x(String id) {\n  }\n  @RequestMapping(value = "/y", method = RequestMethod.POST)\n  public void y() {\n  }\n'
    '}\nclass B {\n  @RequestMapping("/z")\n  public void z() {\n  }\n}\n@RequestMapping("/c")\nclass C {\n  @DeleteMapping("/w")\n  void w() {\n  }\n}\n'
)
CS = '[Route("api/[controller]")]\npublic class ShopController {\n  [HttpGet]\n  public Item All() {\n  }\n  [HttpPost("new")]\n  public Item New() {\n    http.PutAsync("/put/" + id);\n    var r = new RestRequest("/rest", Method.Delete);\n  }\n  [Get("/refit")]\n  Task Get();\n}\n'
PY = '@router.get("/f/{id}")\nasync def f(id):\n    pass\n\n@app.route("/g", methods=["POST", "put"])\ndef g():\n    pass\n\n@app.route("/h")\ndef h():\n    pass\nurlpatterns = [path("d/<int:id>", views.d)]\n'
TS = "app.post('/e', save);\nrouter.use('/u', mw.check);\nmap.get('/no', x);\naxios.get(`/c/${id}`);\nwrap(fetch('/d', {method: 'PATCH'}));\nconst r = await $fetch('/e');\n$.ajax({url: '/j', type: 'POST'});\n"
XML = "<action path='/s' type='a.S'>\n<servlet-mapping><servlet-name>n</servlet-name>\n<url-pattern>/t</url-pattern></servlet-mapping>\n"


def test_frameworks(spark):
    files = [("A.java", JAVA), ("S.cs", CS), ("v.py", PY), ("e.ts", TS), ("w.xml", XML), ("p/l.asp", ""), ("f.html", '<form class="x" method="post" action="/form">\n<form>'), ("R.kt", '@GET("/retro")\nfun r()\n'), ("n.ts", None)]
    f = spark.createDataFrame([("r", *x) for x in files], FILES)
    assert rows(web.endpoints(f), "file", "framework", "method", "path_pattern", "handler") == sorted([
        ("A.java", "spring", "GET", "/a/x/{param}", "x"), ("A.java", "spring", "POST", "/a/y", "y"), ("A.java", "spring", "ANY", "/z", "z"), ("A.java", "spring", "DELETE", "/c/w", "w"),
        ("S.cs", "aspnet", "GET", "/api/shop", "All"), ("S.cs", "aspnet", "POST", "/api/shop/new", "New"), ("v.py", "fastapi", "GET", "/f/{param}", "f"), ("v.py", "flask", "POST", "/g", "g"), ("v.py", "flask", "PUT", "/g", "g"),
        ("v.py", "flask", "GET", "/h", "h"), ("v.py", "django", "ANY", "/d/<int{param}>", "views.d"), ("e.ts", "express", "POST", "/e", "save"), ("e.ts", "express", "USE", "/u", "mw.check"),
        ("w.xml", "struts", "ANY", "/s", "a.S"), ("w.xml", "servlet", "ANY", "/t", "n"), ("p/l.asp", "classic-asp", "ANY", "/p/l.asp", "l.asp"),
    ])
    assert rows(web.consumers(f), "file", "call_type", "method", "path_pattern") == sorted([
        ("S.cs", "HttpClient", "PUT", "/put"), ("S.cs", "RestSharp", "DELETE", "/rest"), ("S.cs", "Refit", "GET", "/refit"), ("e.ts", "axios", "GET", "/c/{param}"), ("e.ts", "fetch", "PATCH", "/d"), ("e.ts", "$fetch", "GET", "/e"),
        ("e.ts", "jquery-ajax", "POST", "/j"), ("f.html", "html-form", "POST", "/form"), ("R.kt", "Retrofit", "GET", "/retro"),
    ])
