"""Every core query against its oracle SQL in DuckDB, on the smallest tables."""

import datetime
import os

import duckdb
import pytest

from cairn.jobs import queries as core

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def _plain(v):
    return v.isoformat() if isinstance(v, datetime.datetime) else round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_oracle(spark, db, name):
    got = core.queries()[name](spark, SF)
    cols = sorted(got.columns)
    have = sorted((tuple(_plain(r[c]) for c in cols) for r in got.collect()), key=repr)
    cur = db.execute(core.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(_plain(v) for _, v in sorted(zip(names, r, strict=True))) for r in cur.fetchall()), key=repr)
    assert list(map(repr, have)) == list(map(repr, want)) and want  # repr tells 1 from 1.0 and True
