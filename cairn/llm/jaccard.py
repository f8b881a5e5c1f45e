r"""Exact Jaccard join over word shingles by grouped prefixes, down to connected classes of documents.

1. Documents with the same shingle set become one class, named by its smallest id.
2. Shingles get a global order: rarer first, as told by a sketch of `1 << SKETCH_BITS` counters over all documents, ties by hash.
   Any order is correct; this one keeps what many documents share out of the prefixes.
3. Classes with the same prefix and set size form a group; only groups are posted under the prefix's shingles.
4. A group pair counts under the first shingle that both prefixes share: it is left to an earlier one where the places of the shingle leave too
   little behind them, or where the last `EARLIER` open shingles before it have one in common. Group pairs are filtered by size, too. What is left is expanded to members, which are
   filtered by parity bitmaps, first of fixed length, then as long as the sets (all bounds are exact), and verified on the full sets.

Classes that are already connected are not compared again. Per shingle, a first round compares all groups with the group of the
smallest id, a second one all others with the smallest of another component. Only shingles that then still lie in several
components have their groups paired, and only where `HOT` groups at most are left. For the others a longer prefix decides: the i smallest
shingles that two similar sets share lie within the first prefix + i - 1 shingles of both, so a hot shingle is followed by each later one of
these, and chains of shingles that are still hot are followed further, up to `CHAIN` or to what similar sets that differ share at least. A thousand near
copies cost a thousand comparisons, and a shingle that many unlike documents hold is not paired in full.

Words: A-Z lower-cased, `[^\x20\x09-\x0D]+`. The set: distinct `k`-word shingles, or the whole sequence of fewer words.

Defined cases: null and empty texts have an empty set and are linked with nothing; a document without id has no
component (null); ids are taken as unique, rows that share one are answered each by its own text; repeated rows
are copies of each other; an empty table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import components, discard, materialize
from .textbytes import LOWER, SPACE_WORD, batch_parts, freeing, mix, text_slices, word_hashes

SKETCH_BITS = 17
MAPS = 8
#: Groups under one shingle that are paired directly; beyond, the shingle is followed by further ones.
HOT = 4000
#: Shingles before one that are compared, so that a pair which shares many of them is made under few.
EARLIER = 4
#: Longest chain of shingles, where the similarity allows it.
CHAIN = 5
#: Up to so many ids are sent to every task to pick documents; beyond, the documents are joined by id.
BROADCAST_IDS = 500_000

_weights = np.random.default_rng(7).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def chain_length(percent: int) -> int:
    """Shingles of the longest chain that is followed: no more than two different similar sets share at least. With i shared ones the union has
    i + 1 or more, so 100 i >= percent (i + 1): 6 at 85, 4 at 80."""
    return min(CHAIN, -(-percent // max(1, 100 - percent)))


def shingle_sets(column: pa.Array, k: int):
    """Per row: the sorted distinct 64-bit shingle hashes."""
    for _, _, data, offsets in text_slices(column):
        h, _, first = word_hashes(LOWER[data], offsets, SPACE_WORD)
        s = np.zeros(max(len(h) - k + 1, 0), np.uint64)
        for j in range(k):
            s += h[j : j + len(s)] * _weights[j]
        s = mix(s)
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= k:
                yield np.unique(s[a : b - k + 1])
            elif b > a:
                yield mix((h[a:b] * _weights[: b - a]).sum(dtype=np.uint64)[None] + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def _sketch(k: int):
    def run(batches):
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for part in batch_parts(batches, "t"):
            held = np.concatenate(list(shingle_sets(part.column("t"), k)))
            total += np.bincount((held & np.uint64(len(total) - 1)).astype(np.int64), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], names=["bin", "n"])

    return run


def rarity(docs: DataFrame, k: int) -> np.ndarray:
    """Class per counter, 0 rarest: quarter-octaves above the mean load."""
    rows = docs.select("t").mapInArrow(freeing(_sketch(k)), "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toPandas()
    load = np.zeros(1 << SKETCH_BITS)
    load[rows["bin"].to_numpy(np.int64)] = rows["n"].to_numpy(float)
    level = np.log2(np.maximum(load, 1) / max(load.mean(), 1)) * 4
    return np.clip(np.ceil(level), 0, 63).astype(np.uint8)


SIGNATURE = "id {id}, n long, d1 long, d2 long, take int, first array<long>, " + ", ".join(f"m{j} long" for j in range(MAPS))


def _signatures(k: int, percent: int, level):
    def run(batches):
        rare = level.value.astype(np.uint64)
        for batch in batch_parts(batches, "t"):
            n, d1, d2, takes, prefix, maps = [], [], [], [], [], []
            for s in shingle_sets(batch.column("t"), k):
                n.append(len(s))
                d1.append(s.sum(dtype=np.uint64))
                d2.append(mix(s * np.uint64(3) + np.uint64(1)).sum(dtype=np.uint64))
                key = (rare[(s & np.uint64(len(rare) - 1)).astype(np.int64)] << np.uint64(57)) | (s >> np.uint64(7))
                take = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
                most = take + chain_length(percent) - 1
                prefix.append(np.sort(np.partition(key, most - 1)[:most] if most < len(key) else key).view(np.int64))
                takes.append(take)
                bits = np.bincount((s >> np.uint64(64 - 9)).astype(np.int64), minlength=64 * MAPS) & 1
                maps.append(np.packbits(bits.astype(np.uint8)).view(np.int64))
            maps = np.array(maps, np.int64).reshape(-1, MAPS)
            offsets = np.cumsum([0, *map(len, prefix)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"), pa.array(n, pa.int64()), *(pa.array(np.array(d, np.uint64).view(np.int64)) for d in (d1, d2)), pa.array(takes, pa.int32()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(prefix) if prefix else np.zeros(0, np.int64))),
                    *(pa.array(maps[:, j].copy()) for j in range(MAPS)),
                ],
                names=["id", "n", "d1", "d2", "take", "first", *(f"m{j}" for j in range(MAPS))],
            )

    return run


def parity_map(s: np.ndarray) -> np.ndarray:
    """A bit per bin, about as many as there are shingles: whether an odd number of them falls into it. The map of half as many bins is the
    exclusive or of its halves; bits that differ between two maps are never more than the shingles in which the sets differ."""
    bins = 1 << max(9, int(len(s)).bit_length())
    return np.packbits((np.bincount((s & np.uint64(bins - 1)).astype(np.int64), minlength=bins) & 1).astype(np.uint8), bitorder="little")


def apart(x: np.ndarray, y: np.ndarray) -> int:
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _sets(k: int):
    def run(batches):
        for batch in batch_parts(batches, "t"):
            sets = list(shingle_sets(batch.column("t"), k))
            d1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(d1), pa.array([len(s) for s in sets], pa.int64()), pa.array([parity_map(s).tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["id", "d1", "n", "map", "set"],
            )

    return run


def _coarse(percent: int):
    def run(batches):
        for batch in batch_parts(batches, "ma", "mb"):
            ok = [
                (100 - percent) * (na.as_py() + nb.as_py()) >= (100 + percent) * apart(np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8))
                for na, nb, x, y in zip(*(batch.column(c) for c in ("na", "nb", "ma", "mb")), strict=True)
            ]
            ok = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], names=["a", "b"])

    return run


def _verify(percent: int):
    def run(batches):
        for batch in batch_parts(batches, "sa", "sb"):
            ok = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = np.concatenate([x, y])
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                ok.append(100 * same >= percent * (len(both) - same))
            ok = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], names=["a", "b"])

    return run


def _sizes(percent: int) -> Column:
    """Whether sizes na and nb allow the similarity."""
    return 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")


def _places(percent: int) -> Column:
    """Whether a shared shingle at places pa and pb of sets of na and nb does: what they share lies before it in both, or from it on."""
    return (100 + percent) * (F.least("pa", "pb") + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))) >= percent * (F.col("na") + F.col("nb"))


def _first_places(percent: int) -> Column:
    """Whether the first shingle that two prefixes share does, at such places: all they share lies from it on."""
    return (100 + percent) * F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= percent * (F.col("na") + F.col("nb"))


def _near(percent: int) -> Column:
    """Whether sizes na, nb and the parity maps allow the similarity: both are bounds, so nothing similar is dropped."""
    apart = sum((F.bit_count(F.col(f"ma{j}").bitwiseXOR(F.col(f"mb{j}"))) for j in range(1, MAPS)), F.bit_count(F.col("ma0").bitwiseXOR(F.col("mb0"))))
    return _sizes(percent) & ((100 - percent) * (F.col("na") + F.col("nb")) >= (100 + percent) * apart)


def _sided(df: DataFrame, key: str, side: str) -> DataFrame:
    """The columns of df but key, named for one side of a pair."""
    return df.select(key, *(F.col(c).alias(c + side) for c in df.columns if c != key))


class _Verifier:
    """Takes candidate pairs of classes and keeps the pairs already compared and the roots over all links found: an id's root has its links, so
    each comparison adds its own to the last roots."""

    def __init__(self, docs: DataFrame, classes: DataFrame, k: int, percent: int):
        self.docs, self.classes, self.k, self.percent = docs, classes, k, percent
        self.kind = docs.schema["id"].dataType.simpleString()
        self.tested: list[DataFrame] = []
        self.roots: DataFrame | None = None

    def side(self, s: str) -> DataFrame:
        return self.classes.select(F.col("rep").alias(s), F.col("n").alias(f"n{s}"), *(F.col(f"m{j}").alias(f"m{s}{j}") for j in range(MAPS)))

    def compare(self, pairs: DataFrame) -> DataFrame:
        """pairs(a, b) of classes -> roots(id, root) over all links found so far."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
        for t in self.tested:
            pairs = pairs.join(t, ["a", "b"], "left_anti")
        pairs = materialize(pairs.join(self.side("a"), "a").join(self.side("b"), "b").filter(_near(self.percent)).select("a", "b"))
        self.tested.append(pairs)
        if self.roots is not None and pairs.isEmpty():
            return self.roots
        need = pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep"))).distinct()
        need = materialize(self.classes.join(need, "rep", "left_semi").select(F.col("rep").alias("id"), "d1"))
        wanted = F.broadcast(need) if need.count() <= BROADCAST_IDS else need
        # by id and content: rows that share an id with other texts are not meant
        sets = self.docs.join(wanted.select("id"), "id", "left_semi").mapInArrow(freeing(_sets(self.k)), f"id {self.kind}, d1 long, n long, map binary, set binary")
        sets = materialize(sets.join(wanted, ["id", "d1"], "left_semi"))
        coarse = lambda s: sets.select(F.col("id").alias(s), F.col("n").alias(f"n{s}"), F.col("map").alias(f"m{s}"))
        own = lambda s: sets.select(F.col("id").alias(s), F.col("set").alias(f"s{s}"))
        two = f"a {self.kind}, b {self.kind}"
        close = materialize(pairs.join(coarse("a"), "a").join(coarse("b"), "b").mapInArrow(freeing(_coarse(self.percent)), two))
        links = materialize(close.join(own("a"), "a").join(own("b"), "b").mapInArrow(freeing(_verify(self.percent)), two))
        discard(need, sets, close)
        before = self.roots
        if before is None:
            self.roots = components(links)
        elif not links.isEmpty():
            self.roots = components(links.union(before.select("id", "root")))
            discard(before)
        discard(links)
        return self.roots


def _rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    """members(g, rep, n) with the root of each, itself where it has no link."""
    return members.join(roots.select(F.col("id").alias("rep"), "root"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))


def _open(rows: DataFrame, key: str) -> DataFrame:
    """Rows (key, low, high) of keys that lie in several components, with c, the rows of the key."""
    mixed = rows.groupBy(key).agg(F.min("low").alias("_low"), F.max("high").alias("_high"), F.count("*").alias("c")).filter("_low < _high").select(key, "c")
    return rows.join(mixed, key)


def _group_pairs(under: DataFrame, alone: DataFrame, percent: int) -> DataFrame:
    """Pairs (ga, gb) of groups that meet under shingles that are not hot, a pair as often as its first shared shingle can't be told.
    under(token, g, n, p, c), alone(g, low, high, parity maps)."""
    # a pair that shares an earlier shingle is found under the first of them, or by its chains if that one is hot
    earlier = F.collect_list("token").over(W.partitionBy("g").orderBy("p").rowsBetween(-EARLIER, -1))
    small = under.withColumn("e", earlier).filter(F.col("c") <= HOT).select("token", "g", "n", "p", "e").join(alone, "g")
    both = _sided(small, "token", "a").join(_sided(small, "token", "b"), "token").filter(F.col("ga") < F.col("gb"))
    both = both.withColumnsRenamed({f"m{j}{x}": f"m{x}{j}" for j in range(MAPS) for x in "ab"})
    both = both.filter(((F.col("lowa") < F.col("higha")) | (F.col("lowb") < F.col("highb")) | (F.col("lowa") != F.col("lowb"))) & _first_places(percent) & ~F.arrays_overlap("ea", "eb") & F.coalesce(_near(percent), _sizes(percent)))
    return both.select("ga", "gb")


def _remaining(posted: DataFrame, members: DataFrame, classes: DataFrame, roots: DataFrame, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """Pairs (a, b) of classes of different components that share a prefix shingle, and the tables they are read from."""
    rooted = materialize(_rooted(members, roots))
    groups = materialize(rooted.groupBy("g").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("m")))
    # the parity maps of a group of one class are known before it is expanded
    maps = [f"m{j}" for j in range(MAPS)]
    alone = groups.select("g", "low", "high", "m").join(classes.select(F.col("rep").alias("g"), *maps), "g").withColumns({m: F.when(F.col("m") == 1, F.col(m)) for m in maps}).drop("m")
    under = materialize(_open(posted.select("token", "g", "n", "p").join(groups, "g"), "token"))
    both = _group_pairs(under, alone, percent)
    both = both.union(groups.filter((F.col("low") < F.col("high")) & (F.col("m") <= HOT)).select(F.col("g").alias("ga"), F.col("g").alias("gb"))).distinct()
    side = lambda s: rooted.select(F.col("g").alias(f"g{s}"), F.col("rep").alias(s), F.col("root").alias(f"root{s}"))
    pairs = both.join(side("a"), "ga").join(side("b"), "gb").filter("roota <> rootb").select("a", "b")
    # shingles of many groups, and groups of many members, by chains
    hot = under.filter(F.col("c") > HOT).select(F.col("token").alias("key"), "g", "p")
    wide = groups.filter((F.col("low") < F.col("high")) & (F.col("m") > HOT)).select(F.xxhash64(F.lit("group"), "g").alias("key"), "g", F.lit(0).alias("p"))
    rows = materialize(hot.union(wide).join(rooted.select("g", "rep", "root"), "g").select("key", "p", "rep", "root"))
    tables = [rooted, groups, under, rows]
    longest = chain_length(percent)
    for length in range(2, longest + 1):
        if rows.isEmpty():
            break
        later = rows.join(classes.select("rep", "n", "take", "first"), "rep").select("key", "p", "rep", "root", "n", F.col("take") + length - 1, F.posexplode("first").alias("q", "token")).toDF("key", "p", "rep", "root", "n", "end", "q", "token")
        later = later.filter("q > p and q < end").select(F.xxhash64("key", "token").alias("key"), F.col("q").alias("p"), "rep", "root", "n", F.col("root").alias("low"), F.col("root").alias("high"))
        later = materialize(_open(later, "key").drop("low", "high"))
        tables.append(later)
        here = (later if length == longest else later.filter(F.col("c") <= HOT)).drop("c")
        met = _sided(here, "key", "a").join(_sided(here, "key", "b"), "key").filter((F.col("roota") < F.col("rootb")) & _sizes(percent) & _places(percent))
        pairs = pairs.union(met.select(F.col("repa").alias("a"), F.col("repb").alias("b")))
        rows = later.filter(F.col("c") > HOT).select("key", "p", "rep", "root")
    return pairs, tables


def jaccard_classes(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 85) -> DataFrame:
    """id_col, n_shingles, class_id (smallest id with the same set), component_id (smallest id reachable over links)."""
    if chain_length(percent) < 2:
        raise ValueError("hot shingles are followed by a second one, which sets of this similarity need not share")
    spark = documents.sparkSession
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    level = spark.sparkContext.broadcast(rarity(docs, k))
    kind = docs.schema["id"].dataType.simpleString()
    signed = materialize(docs.mapInArrow(freeing(_signatures(k, percent, level)), SIGNATURE.format(id=kind)))
    maps = [f"m{j}" for j in range(MAPS)]
    prefix = F.slice("first", F.lit(1), F.col("take"))
    classes = materialize(
        signed.filter("n > 0 and id is not null").groupBy("d1", "d2", "n").agg(F.min("id").alias("rep"), *(F.any_value(c).alias(c) for c in ("take", "first", *maps)))
        .withColumns({"p1": F.xxhash64(prefix), "p2": F.hash(prefix)})
    )
    groups = classes.groupBy("p1", "p2", "n").agg(F.min("rep").alias("g"), F.any_value(prefix).alias("prefix"))
    members = materialize(classes.select("rep", "p1", "p2", "n").join(groups.select("p1", "p2", "n", "g"), ["p1", "p2", "n"]).select("g", "rep", "n"))
    posted = groups.select("g", "n", F.posexplode("prefix").alias("p", "token"))
    shared = posted.groupBy("token").agg(F.count("*").alias("df"), F.min("g").alias("pivot")).filter("df > 1").select("token", "pivot")
    posted = materialize(posted.join(shared, "token").select("token", "g", "n", "p", "pivot"))
    check = _Verifier(docs, classes, k, percent)
    # group pairs: all with the group of the smallest id under each shingle; pairs within a group: each member with its first
    star = posted.filter("g <> pivot").select("g", F.col("n").alias("na"), F.col("pivot").alias("a")).distinct()
    star = star.join(members.filter("g = rep").select(F.col("g").alias("a"), F.col("n").alias("nb")), "a").filter(_sizes(percent))
    pairs = star.join(members.select("g", F.col("rep").alias("b")), "g").select("a", "b").union(members.filter("g <> rep").select(F.col("g").alias("a"), F.col("rep").alias("b")))
    roots = check.compare(pairs)
    # under each shingle that lies in several components: all others with the first of the component of the largest root
    rooted = materialize(_rooted(members, roots))
    several = rooted.groupBy("g").agg(F.count("*").alias("c")).filter("c > 1").select("g")
    own = rooted.join(several, "g", "left_semi").select(F.xxhash64(F.lit("group"), "g").alias("token"), "rep", "root")
    under = posted.select("token", "g").join(rooted, "g").select("token", "rep", "root").union(own)
    under = materialize(_open(under.withColumns({"low": F.col("root"), "high": F.col("root")}), "token").select("token", "rep", "root"))
    heads = under.groupBy("token", "root").agg(F.min("rep").alias("a")).groupBy("token").agg(F.max("root").alias("last"), F.max_by("a", "root").alias("a"))
    roots = check.compare(under.join(heads, "token").filter("root <> last").select("a", F.col("rep").alias("b")))
    discard(rooted, under)
    pairs, tables = _remaining(posted, members, classes, roots, percent)
    roots = check.compare(pairs)
    discard(*tables, posted, members, *check.tested)
    names = signed.select("id", "n", "d1", "d2").join(classes.select("d1", "d2", "n", "rep"), ["d1", "d2", "n"], "left")
    out = names.join(roots.select(F.col("id").alias("rep"), "root"), "rep", "left")
    alone = F.when(F.col("id").isNotNull(), F.coalesce("root", "rep", "id"))
    out = materialize(out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("rep", "id").alias("class_id"), alone.alias("component_id")))
    discard(roots, signed, classes)
    return out


def keep_one(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 85) -> DataFrame:
    """The documents, with all their columns, less those that a document of smaller id is linked to, over any number of links.
    Rows with a shared or no id all stay or go together."""
    gone = jaccard_classes(documents, id_col, text_col, k, percent).filter(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    # by name: the key is one column on either side, so no column of the documents can clash with it
    return documents.join(gone, id_col, "left_anti").select(*documents.columns)
