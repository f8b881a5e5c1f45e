"""Merkle audits against a plain comparison of the records."""

import hashlib

from pyspark.sql import functions as F

from cairn.llm import fixity, queries

SCHEMA = "page_id long, url string, html string, file string"


def plain(a, b):
    """Per (file, offset) the sorted (digest, length) of both sides, where they differ."""
    sides = [{}, {}]
    for side, rows in zip(sides, (a, b), strict=True):
        for r in rows:
            side.setdefault((r["file"], r["offset"]), []).append((r["digest"], r["length"]))
    p, q = ({k: sorted(v) for k, v in s.items()} for s in sides)
    return sorted((*k, "missing" if k not in q else "added" if k not in p else "changed") for k in p.keys() | q.keys() if p.get(k) != q.get(k))


def test_damage_is_located(spark):
    texts = [None, "", "short", "x" * 100_000, "short", "é\n"]
    pages = spark.createDataFrame([(i, None if i % 7 == 0 else f"http://h/{i}", texts[i % 6], "clash") for i in range(60)] + [(5, "http://h/5", texts[5], "clash")] * 2, SCHEMA)
    primary = fixity.records(pages, per_file=25)
    changed = primary.withColumn("digest", F.when(F.col("id") % 13 == 4, F.lit("0")).otherwise(F.col("digest"))).filter("id % 17 <> 3 and not (id between 25 and 49)")
    extra = primary.filter("id = 8").withColumn("offset", F.col("offset") + 1).union(primary.filter("id = 9").withColumn("file", F.lit(99).cast("long")))
    replica = changed.unionByName(extra)
    want = plain(primary.collect(), replica.collect())
    assert {w[2] for w in want} == {"missing", "added", "changed"}
    for fanout in (2, 16):
        got = fixity.audit(primary, replica, fanout)
        assert sorted((r.file, r.offset, r.problem) for r in got.collect()) == want


def test_equal_and_empty_replicas(spark):
    pages = spark.createDataFrame([(1, "u", "a", "f"), (None, None, None, None), (1, "u", "a", "f")], SCHEMA)
    primary = fixity.records(pages)
    assert fixity.audit(primary, primary.orderBy(F.desc("offset"))).count() == 0
    none = primary.filter("false")
    assert fixity.audit(none, none).count() == 0
    assert {r.problem for r in fixity.audit(none, primary).collect()} == {"added"}
    assert {r.problem for r in fixity.audit(primary, none).collect()} == {"missing"}


def test_replica_is_hashed_from_damaged_bytes(spark):
    bodies = ["xa", "é", "", None, "ab"]
    pages = spark.createDataFrame([(i, "u", b) for i, b in enumerate(bodies)], "page_id long, url string, html string")
    primary, replica = fixity.records(pages), fixity.records(pages, damaged=F.col("page_id") < 4)
    got = {r.id: (r.offset, r.length, r.digest) for r in replica.collect()}
    for r in primary.collect():
        body = (bodies[r.id] or "").encode()
        tail = body + b"\r\n\r\n"
        if r.id < 4:
            tail = (b"y" if tail[:1] == b"x" else b"x") + tail[1:]
        whole = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: u\r\nContent-Length: %d\r\n\r\n" % len(body) + tail
        assert got[r.id] == (r.offset, r.length, hashlib.sha256(whole).hexdigest())
    added = primary.filter("id = 4").withColumn("file", F.lit(9).cast("long"))
    rows = queries._named(fixity.audit(primary, replica.unionByName(added)), primary).collect()
    assert sorted((r.problem, r.page_id) for r in rows if r.problem == "changed") == [("changed", i) for i in range(4)]
    assert [(r.page_id, r.file) for r in rows if r.problem == "added"] == [(None, 9)]
