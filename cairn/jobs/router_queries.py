"""Queries over routers of Python modules and over deep call graphs, with their oracle SQL: a repository per supplier, of one of three layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import closure, routers, web
from ..sources.tables import written

ITEM = 'from fastapi import APIRouter\nfrom app.core import BASE\nrouter = APIRouter(\n    prefix="/own#",\n    tags=["a", "b"],\n)\n\n@router.get(\n    "/{item_id}",\n    responses={404: {"description": "gone (for good)"}},\n)\nasync def read#(item_id: int):\n    return item_id\n'
#: Files of each layout; # stands for the supplier's key.
LAYOUTS = (
    # an application that mounts modules by relative imports, under constants that hold others
    (
        ("app/core.py", 'ROOT = "/api"\nBASE = f"{ROOT}/v#"\nLOOP = f"{POOL}/a"\nPOOL = f"{LOOP}/b"\n'),
        ("app/main.py", 'from fastapi import FastAPI\nfrom .core import BASE\nfrom .parts import items\nfrom .parts.users import router as users_router\napp = FastAPI()\napp.include_router(items.router, prefix=BASE)\napp.include_router(\n    users_router,\n    prefix=f"{BASE}/users",\n)\n'),
        ("app/parts/items.py", ITEM),
        ("app/parts/users.py", 'from fastapi import APIRouter\nrouter = APIRouter()\n\n@router.post("/")\ndef add#():\n    pass\n'),
    ),
    # packages that mount each other, and a module that is mounted twice
    (
        ("svc/__init__.py", 'from fastapi import FastAPI\nfrom svc.v1 import router as one\napp = FastAPI()\napp.include_router(one, prefix="/v1")\napp.include_router(one, prefix="/latest")\n'),
        ("svc/v1/__init__.py", 'from fastapi import APIRouter\nfrom . import orders\nfrom ..v2 import router as two\nrouter = APIRouter()\nrouter.include_router(orders.router, prefix="/orders#")\nrouter.include_router(two, prefix="/two")\n'),
        ("svc/v1/orders.py", 'from fastapi import APIRouter\nrouter = APIRouter()\n\n@router.delete("/x")\ndef drop#():\n    pass\n'),
        ("svc/v2/__init__.py", 'from fastapi import APIRouter\nimport svc.v1 as back\nrouter = APIRouter()\nrouter.include_router(back.router, prefix="/again")\n\n@router.get("/y")\ndef see#():\n    pass\n'),
    ),
    # no application: a module that mounts others is the root; a constant with two meanings, an unknown prefix
    (
        ("lib/a.py", 'PREFIX = "/a"\nKNOWN = "/k#"\n'),
        ("lib/b.py", 'PREFIX = "/b"\n'),
        ("lib/top.py", "from lib.shop import router as shop\nfrom lib.cart import router as cart\nfrom lib.calm import router as calm\nthing.include_router(shop, prefix=PREFIX)\nthing.include_router(cart, prefix=KNOWN)\nthing.include_router(calm, prefix=KNOWN)\n"),
        ("lib/shop.py", '@router.get("/s#")\ndef shop#():\n    pass\n'),
        ("lib/cart.py", '@router.get("/c#")\ndef cart#():\n    pass\n'),
        ("lib/calm.py", 'router = APIRouter(prefix=UNKNOWN)\n@router.get("/m#")\ndef calm#():\n    pass\n'),
    ),
)


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    text = k.cast("string")
    pair = lambda p, c: F.struct(F.lit(p).alias("path"), F.replace(F.lit(c), F.lit("#"), text).alias("content"))
    files = F.when(k % 3 == 0, F.array(*(pair(*f) for f in LAYOUTS[0]))).when(k % 3 == 1, F.array(*(pair(*f) for f in LAYOUTS[1]))).otherwise(F.array(*(pair(*f) for f in LAYOUTS[2])))
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("r"), text).alias("repo"), F.inline(files))


def router_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routers.constant_values(written(routers.modules(_files(spark, sf_dir)))).select("repo", "name", "value")


def router_mounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    mods = written(routers.modules(_files(spark, sf_dir)))
    return routers.mounted(mods, routers.constant_values(mods)).select("repo", "owner", "target", "prefix")


def router_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    e = routers.compose(written(routers.modules(files)), web.endpoints(files).filter("framework = 'fastapi'"))
    return e.select("repo", "file", "method", "path_pattern", "handler", "prefix_resolved")


def _deep(spark, sf_dir):
    """Suppliers call those of twice and three times their key, and of a quarter of it: about sixty steps deep, with cycles."""
    s, k = spark.read.parquet(f"{sf_dir}/supplier.parquet"), F.col("s_suppkey")
    to = F.explode(F.array(k * 2, k * 3, F.floor(k / 4).cast("long")))
    edges = s.select(F.lit("r").alias("repo"), k.alias("from"), to.alias("to")).join(s.select(k.alias("to")), "to", "left_semi").select("repo", "from", "to")
    return closure.scope(s.select(F.lit("r").alias("repo"), k.alias("entry")), edges)


def deep_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deep(spark, sf_dir).select("entry", "method")


def chain_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in a chain of sixty each; the first of every chain is an entry."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("long").alias("k"))
    edges = o.filter("k % 60 <> 59").select(F.lit("r").alias("repo"), F.col("k").alias("from"), (F.col("k") + 1).alias("to"))
    return closure.scope(o.filter("k % 60 = 0").select(F.lit("r").alias("repo"), F.col("k").alias("entry")), edges).select("entry", "method")


_QUERIES = (router_constants, router_mounts, router_endpoints, deep_scope, chain_scope)

_K = "k AS (SELECT s_suppkey AS k, 'r' || s_suppkey AS repo, s_suppkey % 3 AS l FROM supplier)"
ORACLE = {
    "router_constants": f"""WITH {_K} SELECT repo, 'ROOT' AS name, '/api' AS value FROM k WHERE l = 0 UNION ALL SELECT repo, 'BASE', '/api/v' || k FROM k WHERE l = 0 UNION ALL SELECT repo, 'KNOWN', '/k' || k FROM k WHERE l = 2""",
    "router_mounts": f"""WITH {_K} SELECT repo, 'app.main' AS owner, 'app.parts.items' AS target, '/api/v' || k AS prefix FROM k WHERE l = 0 UNION ALL SELECT repo, 'app.main', 'app.parts.users', '/api/v' || k || '/users' FROM k WHERE l = 0
 UNION ALL SELECT repo, 'svc', 'svc.v1', unnest(['/v1', '/latest']) FROM k WHERE l = 1 UNION ALL SELECT repo, 'svc.v1', 'svc.v1.orders', '/orders' || k FROM k WHERE l = 1 UNION ALL SELECT repo, 'svc.v1', 'svc.v2', '/two' FROM k WHERE l = 1
 UNION ALL SELECT repo, 'svc.v2', 'svc.v1', '/again' FROM k WHERE l = 1 UNION ALL SELECT repo, 'lib.top', 'lib.shop', NULL FROM k WHERE l = 2 UNION ALL SELECT repo, 'lib.top', unnest(['lib.cart', 'lib.calm']), '/k' || k FROM k WHERE l = 2""",
    "router_endpoints": f"""WITH {_K} SELECT repo, 'app/parts/items.py' AS file, 'GET' AS method, '/api/v' || k || '/own' || k || '/{{param}}' AS path_pattern, 'read' || k AS handler, true AS prefix_resolved FROM k WHERE l = 0
 UNION ALL SELECT repo, 'app/parts/users.py', 'POST', '/api/v' || k || '/users', 'add' || k, true FROM k WHERE l = 0
 UNION ALL SELECT repo, 'svc/v1/orders.py', 'DELETE', unnest(['/v1', '/latest']) || '/orders' || k || '/x', 'drop' || k, true FROM k WHERE l = 1
 UNION ALL SELECT repo, 'svc/v2/__init__.py', 'GET', unnest(['/v1', '/latest']) || '/two/y', 'see' || k, true FROM k WHERE l = 1
 UNION ALL SELECT repo, 'lib/shop.py', 'GET', '/s' || k, 'shop' || k, false FROM k WHERE l = 2 UNION ALL SELECT repo, 'lib/cart.py', 'GET', '/k' || k || '/c' || k, 'cart' || k, true FROM k WHERE l = 2
 UNION ALL SELECT repo, 'lib/calm.py', 'GET', '/m' || k, 'calm' || k, false FROM k WHERE l = 2""",
    "deep_scope": """WITH RECURSIVE s AS (SELECT s_suppkey AS k FROM supplier), g AS (SELECT f, t FROM (SELECT k AS f, unnest([k * 2, k * 3, k // 4]) AS t FROM s) WHERE t IN (SELECT k FROM s)),
 r AS (SELECT k AS entry, k AS method FROM s UNION SELECT entry, t FROM r JOIN g ON g.f = r.method) SELECT entry, method FROM r""",
    "chain_scope": """WITH RECURSIVE o AS (SELECT o_orderkey AS k FROM orders), r AS (SELECT k AS entry, k AS method FROM o WHERE k % 60 = 0 UNION SELECT entry, method + 1 FROM r JOIN o ON o.k = r.method WHERE method % 60 <> 59) SELECT entry, method FROM r""",
}


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict:
    return dict(ORACLE)
