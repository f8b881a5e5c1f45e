r"""Removal of byte strings of `length` bytes that start at more than one place, by interval expansion on a BWT.

1. Every window of `length` bytes is filed under its anchor: the smallest (by hash) of its `gram`-byte substrings. Equal windows have
   equal anchors, so windows under different anchors are never compared. Neighbouring windows with the same anchor form a run; what is
   shuffled per run is its anchor hash, place and 128 bits of hash of its bytes, not the bytes.
2. Runs whose anchor occurs once hold nothing that repeats. Runs that are equal in full (equal in anchor and all hash bits, 192 in all)
   repeat in full, and one of each kind stands for all.
3. The different runs under an anchor are brought together, cut to what two of them can have in common around the anchor,
   concatenated and indexed: suffix array, Burrows-Wheeler transform, and breadth-first backward extension of
   intervals, which yields the common prefixes of neighbouring suffixes by increasing value. It stops at
   `length`: boundaries that are still open belong to suffixes that share that much, and these are the repeated windows.
4. Runs that are more than `group_bytes` under one anchor are dealt out first. A window is told by how many of its bytes lie before the anchor.
   The range of that number is quartered; windows of a quarter have more bytes around the anchor in common, and these bytes are the key of smaller
   groups, in which equal stretches are merged again. That goes on as long as a group is too large: a group for a single number holds one
   stretch. Every group is indexed as in 3, so no task gets more than about `group_bytes` of one anchor.

Rows of one key are joined by `skew_join`: keys with many rows are not brought into one task.

Defined cases: a null text is empty; texts shorter than `length` lose nothing; repeated rows are repeats of each other; rows without
id are documents too; an empty table gives no rows; further columns are ignored, whatever their names. Cuts are between bytes, so `kept` is binary.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, skew_join
from .textbytes import batch_parts, mix, powers, prefix_hash, span_hash, text_slices

LENGTH = 400
GRAM = 150
#: Bytes that one suffix array is built over, unless one anchor's runs have more; and at most of these are indexed together.
INDEX_BYTES = 1 << 18
GROUP_BYTES = 1 << 20
SLAB = 1 << 18

_low = np.uint64((1 << 24) - 1)


def window_runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """Runs of windows with one anchor: (document, anchor hash, anchor, first window, last window, two hashes of the bytes),
    places counted from the beginning of data. Windows lie within one document."""
    n = len(data)
    if n < length:
        none = np.zeros(0, np.int64)
        return none, none.view(np.uint64), none, none, none, none.view(np.uint64), none.view(np.uint64)
    p = prefix_hash(data)
    h = mix((p[gram:] - p[:-gram]) * powers(n, True)[: n - gram + 1])
    order = (h & ~_low) | np.arange(len(h), dtype=np.uint64)
    w = length - gram + 1
    blocks = np.concatenate([order, np.full(-len(order) % w, ~np.uint64(0))]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(blocks, 1).ravel()
    anchor = (np.minimum(ahead[: len(order) - w + 1], behind[w - 1 : len(order)]) & _low).astype(np.int64)
    start = np.arange(len(anchor))
    doc = np.searchsorted(offsets, start, "right") - 1
    whole = start + length <= offsets[doc + 1]
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (whole[1:] != whole[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(anchor)) - 1
    first, last = first[whole[first]], last[whole[first]]
    bodies = span_hash(p, first, last + length), span_hash(prefix_hash(data, 1), first, last + length, 1)
    return doc[first], h[anchor[first]], anchor[first], first, last, *bodies


def _slabs(column, length: int):
    """As text_slices, but texts beyond SLAB come in pieces that overlap by length - 1: (row, place of the piece in its text, ...)."""
    for lo, hi, data, offsets in text_slices(column, SLAB):
        if hi - lo > 1 or len(data) <= SLAB:
            yield lo, 0, data, offsets
        else:
            for at in range(0, len(data) - length + 1, SLAB - length + 1):
                piece = data[at : at + SLAB]
                yield lo, at, piece, np.array([0, len(piece)], np.int64)


RUN = "id {id}, th long, anchor long, at long, first long, last long, body long, body2 long"
KIND = ["anchor", "body", "body2"]


def _runs(length: int, gram: int):
    def run(batches):
        for batch in batches:
            for lo, base, data, offsets in _slabs(batch.column("t"), length):
                doc, key, anchor, first, last, body, body2 = window_runs(data, offsets, length, gram)
                shift = base - offsets[doc]
                rows = pa.array(doc + lo)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(rows), batch.column("th").take(rows), pa.array(key.view(np.int64)), pa.array(anchor + shift),
                        pa.array(first + shift), pa.array(last + shift), pa.array(body.view(np.int64)), pa.array(body2.view(np.int64)),
                    ],
                    names=["id", "th", "anchor", "at", "first", "last", "body", "body2"],
                )

    return run


def _pieces(length: int, gram: int):
    """Text and its runs -> units: key, u1, u2, lo, hi (the range of bytes before the anchor in its windows), at (of the anchor in bytes), bytes."""

    def run(batches):
        for batch in batch_parts(batches, "t"):
            for i in range(batch.num_rows):
                data = np.frombuffer(batch.column("t")[i].as_buffer(), np.uint8)
                runs = batch.column("runs")[i].as_py()
                for lo in range(0, len(runs), 4000):
                    part = runs[lo : lo + 4000]
                    rows = [(r["anchor"], r["body"], r["body2"], 0, length - gram, r["at"] - r["first"], data[r["first"] : r["last"] + length].tobytes()) for r in part]
                    yield _batch(rows)

    return run


UNIT = "key long, u1 long, u2 long, lo int, hi int, at int, bytes binary"


def _batch(rows: list[tuple], *more: tuple[str, pa.DataType]) -> pa.RecordBatch:
    fields = [("key", pa.int64()), ("u1", pa.int64()), ("u2", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("at", pa.int32()), ("bytes", pa.binary()), *more]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(fields)], names=[n for n, _ in fields])


def _quarters(length: int, gram: int):
    """Units -> for each quarter of lo..hi that a unit has windows in: the unit cut to them, under a key of what all of these share, with the
    unit it comes from."""
    span = length - gram

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for key, u1, u2, lo, hi, at, raw in zip(*(batch.column(c).to_pylist() for c in ("key", "u1", "u2", "lo", "hi", "at", "bytes")), strict=True):
                # places of the anchor within its windows: at most what lies before it, at least what the end leaves
                least, most = max(lo, length - (len(raw) - at)), min(hi, at)
                step = -(-(hi - lo + 1) // 4)
                for a in range(lo, hi + 1, step):
                    b = min(a + step - 1, hi)
                    x, y = max(a, least), min(b, most)
                    if x <= y:
                        shared = raw[at - a : at + gram + span - b]
                        piece = raw[at - y : at + gram + span - x]
                        # the same anchor and quarter only: both are part of the key
                        child = xxhash.xxh64_intdigest(shared, key & 0xFFFFFFFF) ^ (a * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
                        v = xxhash.xxh128_intdigest(piece, y)
                        rows.append((*(_signed(z) for z in (child, v >> 64, v & (1 << 64) - 1)), a, b, y, piece, key, u1, u2))
            yield _batch(rows, ("k0", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()))

    return run


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes of uint8 text, a suffix that is a prefix of another being smaller."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(7):
        key = (key << np.uint64(8)) | padded[k : k + n]
    # the end of the text comes before zeros within it
    key = (key << np.uint64(8)) | np.minimum(np.arange(n, 0, -1), 7).astype(np.uint64)
    order = np.argsort(key)
    rank = np.zeros(n + 1, np.int64)
    sorted_key = key[order]
    rank[order] = 1 + np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
    step = 7
    while rank[order[-1]] < n:
        follow = np.zeros(n, np.int64)
        follow[: max(n - step, 0)] = rank[step:n]
        size = np.bincount(rank[:n], minlength=n + 2)
        tied = np.flatnonzero(size[rank[:n]] > 1)
        key = rank[tied] * np.int64(n + 2) + follow[tied]
        by = np.argsort(key, kind="stable")
        tied, key = tied[by], key[by]
        # places of tied suffixes: within a rank's block they are re-sorted; new rank = place of the first of the equal ones
        begin = np.cumsum(size) - size
        block = rank[tied]
        fresh = np.ones(len(tied), bool)
        fresh[1:] = block[1:] != block[:-1]
        within = np.arange(len(tied)) - np.maximum.accumulate(np.where(fresh, np.arange(len(tied)), 0))
        order[begin[block] + within] = tied
        change = np.ones(n, bool)
        full = np.zeros(n, np.int64)
        full[tied] = follow[tied]
        ranked = rank[order]
        tail = full[order]
        change[1:] = (ranked[1:] != ranked[:-1]) | (tail[1:] != tail[:-1])
        new = np.cumsum(change)
        rank[order] = new
        step *= 2
    return order


def repeated_windows(text: np.ndarray, length: int) -> np.ndarray:
    """Mask of places at which a string of `length` symbols starts that starts elsewhere as well; text ends in a zero and has zeros
    only between pieces.

    Interval expansion: the interval of a string w of length l on the suffix array bounds the suffixes that begin with w. If the
    boundary after it is not yet set, its common prefix is l - 1, and the interval is extended backwards by each symbol
    that precedes it; if it is set already, so are the boundaries of all its extensions. Levels come in order of l; after
    level `length` the open boundaries are those of common prefixes of `length` or more."""
    n = len(text)
    order = suffix_array(text)
    before = text[order - 1]
    symbols, code = np.unique(before, return_inverse=True)
    # rows sorted by (symbol before, place): a search in it is the backward step
    steps = np.sort(code.astype(np.int64) * (n + 1) + np.arange(n))
    step = lambda c, i: np.searchsorted(steps, c * (n + 1) + i)
    closed = np.zeros(n + 1, bool)
    closed[[0, n]] = True
    lo = np.searchsorted(steps, np.arange(len(symbols)) * (n + 1))
    hi = np.append(lo[1:], n)
    for _ in range(length):
        # a level's intervals are disjoint: each boundary is reached once
        fresh = ~closed[hi] if len(hi) else np.zeros(0, bool)
        last = hi == n
        keep = fresh | last
        closed[hi[fresh]] = True
        lo, hi = lo[keep], hi[keep]
        if not len(lo):
            break
        size = hi - lo
        which = np.repeat(np.arange(len(lo)), size)
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + lo[which]
        pair = np.unique(which * np.int64(len(symbols)) + code[place])
        which, c = pair // len(symbols), pair % len(symbols)
        lo, hi = step(c, lo[which]), step(c, hi[which])
    open_ = ~closed[:n]
    mask = np.zeros(n, bool)
    mask[order[open_]] = True
    before_open = np.flatnonzero(open_) - 1
    mask[order[before_open[before_open >= 0]]] = True
    return mask


def trim(keys: np.ndarray, pieces: list[bytes], at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """How far each piece can agree with another one of the same key around the anchor: first and last place (exclusive)."""

    def reach(rows: list[bytes], most: int) -> np.ndarray:
        wide = np.zeros((len(rows), most + 9), np.uint8)
        wide[:, :8] = keys.astype(">u8").view(np.uint8).reshape(-1, 8)
        size = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.frombuffer(b"".join(rows), np.uint8)
        which = np.repeat(np.arange(len(rows)), size)
        wide[which, 8 + np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
        order = np.argsort(wide.view(f"S{most + 9}").ravel(), kind="stable")
        wide, size = wide[order], size[order]
        same = (wide[1:] != wide[:-1]).argmax(1)
        same[(wide[1:] == wide[:-1]).all(1)] = most + 8
        common = np.minimum(np.maximum(same - 8, 0), np.minimum(size[1:], size[:-1]))
        common[(wide[1:, :8] != wide[:-1, :8]).any(1)] = 0
        best = np.zeros(len(rows), np.int64)
        best[1:] = common
        best[:-1] = np.maximum(best[:-1], common)
        out = np.zeros(len(rows), np.int64)
        out[order] = best
        return out

    right = reach([b[a:] for b, a in zip(pieces, at, strict=True)], length)
    left = reach([b[:a][::-1] for b, a in zip(pieces, at, strict=True)], length)
    return at - left, at + right


WINDOWS = "array<struct<from: int, to: int>>"


def _search(length: int, index_bytes: int):
    """Units sorted by key -> (key, u1, u2, windows): the repeated windows of each unit, as ranges [from, to) of the bytes before the anchor."""

    def flush(held: list):
        keys = np.array([h[0] for h in held], np.int64)
        pieces, at = [h[4] for h in held], np.array([h[3] for h in held], np.int64)
        a, b = trim(keys, pieces, at, length)
        use = np.flatnonzero(b - a >= length)
        found: list[list] = [[] for _ in held]
        lo = 0
        while lo < len(use):
            # pieces of one key stay together
            hi, size = lo, 0
            while hi < len(use) and (size < index_bytes or keys[use[hi]] == keys[use[hi - 1]]):
                size += b[use[hi]] - a[use[hi]]
                hi += 1
            part = use[lo:hi]
            text = b"".join(pieces[i][a[i] : b[i]].replace(b"\0", b"\1") + b"\0" for i in part)
            zeros = any(b"\0" in pieces[i] for i in part)
            mask = repeated_windows(np.frombuffer(text, np.uint8), length)
            place = 0
            for i in part:
                m = b[i] - a[i] - length + 1
                w = mask[place : place + m]
                edge = np.flatnonzero(np.diff(np.concatenate([[0], w.view(np.int8), [0]])))
                found[i] = [(int(a[i] + x), int(a[i] + y)) for x, y in zip(edge[::2], edge[1::2], strict=True)]
                place += b[i] - a[i] + 1
            if zeros:  # a zero byte was read as a one: settle its windows by their bytes
                seen: dict[bytes, int] = {}
                for i in part:
                    for x, y in found[i]:
                        for j in range(x, y):
                            seen[pieces[i][j : j + length]] = seen.get(pieces[i][j : j + length], 0) + 1
                for i in part:
                    found[i] = [(j, j + 1) for x, y in found[i] for j in range(x, y) if seen[pieces[i][j : j + length]] > 1]
            lo = hi
        rows = [(*h[:3], [{"from": int(at[i]) - y + 1, "to": int(at[i]) - x + 1} for x, y in found[i]]) for i, h in enumerate(held) if found[i]]
        kinds = [*[pa.int64()] * 3, pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["key", "u1", "u2", "windows"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "u1", "u2", "at", "bytes")), strict=True):
                if size > 4 * index_bytes and row[0] != held[-1][0]:
                    yield flush(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield flush(held)

    return run


def _repeated(units: DataFrame, length: int, gram: int, index_bytes: int, group_bytes: int) -> DataFrame:
    """Units (a written table) -> key, u1, u2, windows of those that share windows with another unit of their key; several rows where a unit has been
    dealt out."""
    name, span = ["key", "u1", "u2"], length - gram
    tasks = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found: list[DataFrame] = []  # per level: what was found among its units
    cuts: list[DataFrame] = []  # per level: which units of the next one its units were cut into
    while True:
        size = units.groupBy("key").agg(F.sum(F.octet_length("bytes") + 8).alias("size"), F.count("*").alias("c"), F.max(F.col("hi") - F.col("lo")).alias("wide"))
        size = materialize(size.filter("c > 1").withColumn("large", (F.col("size") > group_bytes) & (F.col("wide") > 0)))
        small = skew_join(units, size.filter("not large").select("key", "c"), ["key"], "c").select(*name, "at", "bytes")
        here = materialize(small.repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(_search(length, index_bytes), f"key long, u1 long, u2 long, windows {WINDOWS}"))
        found.append(here if not cuts else here.unionByName(twice))
        large = size.filter("large").select("key", "c")
        if large.isEmpty():
            break
        cut = skew_join(units, large, ["key"], "c").select(*name, "lo", "hi", "at", "bytes")
        cut = materialize(cut.mapInArrow(_quarters(length, gram), f"{UNIT}, k0 long, s1 long, s2 long"))
        cuts.append(cut)
        # equal stretches are one unit; where it stands for several, all its windows repeat
        units = materialize(cut.groupBy(*name).agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("lo", "hi", "at", "bytes"))))
        least = F.greatest(F.col("lo"), F.col("at") + length - F.octet_length("bytes"))
        twice = units.filter("n > 1").select(*name, F.array(F.struct(least.alias("from"), (F.least("hi", "at") + 1).alias("to"))).cast(WINDOWS).alias("windows"))
    # back from the smallest groups to the units they were cut from
    out = found.pop()
    for cut, above in zip(reversed(cuts), reversed(found), strict=True):
        per = out.groupBy(*name).agg(F.flatten(F.collect_list("windows")).alias("windows"))
        judged = materialize(per.join(cut.groupBy(*name).agg(F.count("*").alias("n")), name))
        up = skew_join(cut.select(*name, "k0", "s1", "s2"), judged, name, "n").select("k0", "s1", "s2", "windows").toDF(*name, "windows")
        out = materialize(above.unionByName(up))
    return out


def _cut(length: int):
    def run(batches):
        for batch in batch_parts(batches, "t"):
            spans, kept, sizes = [], [], []
            for i in range(batch.num_rows):
                data = np.frombuffer(batch.column("t")[i].as_buffer(), np.uint8)
                ranges = batch.column("ranges")[i].values
                if ranges is None or not len(ranges):
                    spans.append([])
                    kept.append(data.tobytes())
                else:
                    edge = np.zeros(len(data) + 1, np.int32)
                    np.add.at(edge, ranges.field(0).to_numpy(), 1)
                    np.add.at(edge, ranges.field(1).to_numpy() + length - 1, -1)
                    gone = np.cumsum(edge)[:-1] > 0
                    turn = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                    spans.append([{"start": int(x), "end": int(y)} for x, y in zip(turn[::2], turn[1::2], strict=True)])
                    kept.append(data[~gone].tobytes())
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary()), batch.column("n_shared")],
                names=["id", "n_bytes", "spans", "kept", "n_shared"],
            )

    return run


def remove_repeats(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, index_bytes: int = INDEX_BYTES, group_bytes: int = GROUP_BYTES
) -> DataFrame:
    """id_col, n_bytes, spans (removed byte ranges), kept (the other bytes), n_shared (anchors of the document, strings of `gram` bytes, that occur
    elsewhere as well: it may share passages shorter than `length`): a row per document."""
    gram = min(gram, length)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = documents.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), text).alias("th"), text.alias("t"))
    kind = docs.schema["id"].dataType.simpleString()
    runs = materialize(docs.mapInArrow(_runs(length, gram), RUN.format(id=kind)))
    more = runs.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1")
    more = materialize(more)
    every = runs
    runs = materialize(skew_join(every, more, ["anchor"], "n").drop("n"))
    discard(every, more)
    # any copy stands for its kind: first values, all of one row, keep the aggregation in hash maps
    kinds = materialize(runs.groupBy(*KIND).agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("id", "th", "at", "first", "last"))))
    several = kinds.groupBy("anchor").agg(F.count("*").alias("m")).filter("m > 1")
    chosen = skew_join(kinds, several, ["anchor"], "m")
    per = chosen.groupBy("id", "th").agg(F.collect_list(F.struct(*KIND, "at", "first", "last")).alias("runs"))
    on = lambda x, y: x.id.eqNullSafe(y.id) & (x.th == y.th)
    found = docs.join(per, on(docs, per)).select(F.col("t").cast("binary").alias("t"), "runs")
    units = materialize(found.mapInArrow(_pieces(length, gram), UNIT))
    windows = _repeated(units, length, gram, index_bytes, group_bytes).toDF(*KIND, "windows")
    windows = windows.groupBy(*KIND).agg(F.flatten(F.collect_list("windows")).alias("windows"))
    # a kind that occurs twice repeats in full
    full = F.array(F.struct(F.lit(0).alias("from"), F.lit(length - gram + 1).alias("to"))).cast(WINDOWS)
    judged = materialize(kinds.select(*KIND, "n").join(windows, KIND, "left").select(*KIND, "n", F.when(F.col("n") > 1, full).otherwise(F.col("windows")).alias("windows")))
    # back to places: a window with r bytes before the anchor begins at - r, within its run
    begin, end = (lambda w: F.greatest(F.col("first"), F.col("at") - w["to"] + 1)), (lambda w: F.least(F.col("last"), F.col("at") - w["from"]) + 1)
    ranges = (
        skew_join(runs, judged, KIND, "n")
        .select("id", "th", F.transform("windows", lambda w: F.struct(begin(w).alias("from"), end(w).alias("to"))).alias("w"))
        .groupBy("id", "th")
        .agg(F.flatten(F.collect_list("w")).alias("ranges"), F.count("*").alias("n_shared"))
    )
    joined = docs.join(ranges, on(docs, ranges), "left").select(docs.id, F.col("t").cast("binary").alias("t"), "ranges", F.coalesce("n_shared", F.lit(0).cast("long")).alias("n_shared"))
    out = joined.mapInArrow(_cut(length), f"id {kind}, n_bytes long, spans array<struct<start: long, end: long>>, kept binary, n_shared long")
    return out.withColumnRenamed("id", id_col)
