"""Exact similarity join of texts in the Jaccard metric space of their word shingles.

A text's point is its set of distinct runs of ``K`` (5) words; the distance is
1 - |A n B| / |A u B|, a metric.  Two texts link when the distance is at most
1/4.  Equal sets are one point from the start.  The join finds the components
of the link graph without building groups of all pairs.

*Regions.*  Most texts are at distance 1 from each other, where documents as
first pivots would tell nothing apart.  The first pivots are the one-shingle
sets {s}: a text is nearer than 1 to the pivots of its own shingles alone, so
these are the regions it can lie in.  All pivots stand in one order, rare
shingles first (by document counts over the whole corpus, in ``SLOTS`` hashed
slots; any order is right).  A point within 1/4 of A lacks at most |A|/4 of
its shingles, so of A's first |A|/4 + s pivots it shares s: a text is
replicated to these regions, its window (s = |A|/16 + 1), and to no others.
Both texts of a link meet in at least min(s, s') regions, so a text that meets
others of fitting size in fewer regions than that has no link and leaves.

*Windows inside a region.*  With respect to the empty set, the triangle
inequality bounds the sizes of linked texts (3/4 to 4/3), so regions split
into cells of one size band, and a text is replicated to the next band's cell
only if its size and its place in the pivot order (how many of its shingles
come before the region's) leave enough in common.

*Recursion.*  Every text is first compared with the cells' pivot that it meets
most often, which joins most groups at once.  Then in each cell that still has
texts of different components the first texts become document pivots.  Their
exact distances to the cell's other texts give links.  Texts whose distances
to a pivot differ by more than 1/4 cannot link and are not compared again, nor
are texts of one component.  Pivots leave, cells with two or more components
left go on with more pivots, until none is left.

Bounded per task: one text's set, or two at a comparison.  Sets are compared
by 64-bit shingle hashes; equal sets by a 64-bit digest.

Inputs: null, empty and blank texts have no shingles and link with nothing,
not even each other.  Repeated rows link (their sets are equal).  Rows without
an id take part, but never name a component.  Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import (ASCII_LOWER, Words, bit_table, byte_class, column, key_text, maybe_in, mix, ngram_hashes, row_groups, row_hash, saved, signed,
                     text_buffer)
from .graph import components

K = 5
SLOTS = 1 << 18
FIRST_PIVOTS = 8  # document pivots of a cell in the first round; each round takes so many times more
IS_WORD = byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)


def shingle_sets(words: Words, rows: int, k: int = K) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    grams = ngram_hashes(words.hash, k, k)
    for i in range(rows):
        a, b = int(words.first[i]), int(words.first[i + 1])
        if b - a >= k:
            yield np.unique(grams[a:b - k + 1])
        else:
            yield ngram_hashes(words.hash[a:b], b - a, b - a) if b > a else np.zeros(0, np.uint64)


def _digest(s: np.ndarray) -> int:
    """Order-free 64-bit digest of a set."""
    total = np.add.reduce(mix(s ^ np.uint64(0x6A09E667F3BCC908))) if len(s) else np.uint64(0)
    return int(signed(mix(np.array([total + np.uint64(len(s))], np.uint64)))[0])


def _sets_of(column: pa.Array, k: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    data, offsets = text_buffer(column)
    for lo, hi in row_groups(offsets):
        a = int(offsets[lo])
        w = Words(ASCII_LOWER[data[a:int(offsets[hi])]], offsets[lo:hi + 1] - a, IS_WORD)
        yield lo, hi, list(shingle_sets(w, hi - lo, k))


_POINT_SQL = "key long, row long, n int, point long, slot int, docs long"


def _points(k: int):
    """Rows (key, text, row) -> one row per text, and the task's document counts by slot."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for lo, hi, sets in _sets_of(batch.column(1), k):
                for s in sets:
                    np.add.at(counts, (s & np.uint64(SLOTS - 1)).astype(np.int64), 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo),
                     pa.array([len(s) for s in sets], pa.int32()),
                     pa.array([_digest(s) for s in sets], pa.int64()), pa.nulls(hi - lo, pa.int32()),
                     pa.nulls(hi - lo, pa.int64())], ["key", "row", "n", "point", "slot", "docs"])
        full = np.flatnonzero(counts)
        for i in range(0, len(full), 1 << 16):
            part = full[i:i + (1 << 16)]
            none = pa.nulls(len(part), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [none, none, pa.nulls(len(part), pa.int32()), none, pa.array(part.astype(np.int32)),
                 pa.array(counts[part])], ["key", "row", "n", "point", "slot", "docs"])
    return run


def _shared(n: int) -> int:
    """Pivots beyond a quarter in the window of a set of ``n``."""
    return n // 16 + 1


def _windows(order: bytes, k: int):
    """Rows (key, text) -> point, size and the pivots of its window in pivot order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = np.frombuffer(order, np.uint16).astype(np.uint64) << np.uint64(48)
        for batch in batches:
            for _, _, sets in _sets_of(batch.column(1), k):
                sets = [s for s in sets if len(s)]
                first = [signed(s[np.argsort(rank[(s & np.uint64(SLOTS - 1)).astype(np.int64)] | (s >> np.uint64(16)),
                                             kind="stable")[:len(s) // 4 + _shared(len(s))]]) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_digest(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()),
                     pa.array(first, pa.list_(pa.int64()))], ["point", "n", "pivots"])
    return run


def _full_sets(wanted: bytes, k: int):
    """Rows (key, text) -> point and set of the texts whose point may be wanted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, sets in _sets_of(batch.column(1), k):
                ids = np.array([_digest(s) for s in sets], np.int64)
                keep = np.flatnonzero(maybe_in(wanted, ids.view(np.uint64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[keep]), pa.array([signed(sets[i]) for i in keep], pa.list_(pa.int64()))],
                    ["point", "set"])
    return run


def _pivot_order(counted: DataFrame) -> bytes:
    """Rank of each slot, rising with its document count (SLOTS rows at the driver)."""
    rows = counted.where("slot is not null").groupBy("slot").agg(F.sum("docs").alias("docs")).collect()
    counts = np.zeros(SLOTS)
    for r in rows:
        counts[r["slot"]] = r["docs"]
    return (np.log2(counts + 1) * 512).astype(np.uint16).tobytes()


def _meetings(texts: DataFrame, order: bytes, k: int) -> DataFrame:
    """Rows (pivot, point, n, pos): a text in a region with a text of fitting size, if it meets enough of them."""
    points = texts.mapInArrow(_windows(order, k), "point long, n int, pivots array<long>").groupBy("point").agg(
        F.first("n").alias("n"), F.first("pivots").alias("pivots"))
    members = points.select("point", "n", F.posexplode("pivots").alias("pos", "pivot"))
    by_size = Window.partitionBy("pivot").orderBy("n", "point")
    me = F.struct("n", "pos")
    rows = members.select("*", *[f(me, i).over(by_size).alias(f"{f.__name__}{i}") for f in (F.lag, F.lead) for i in (1, 2)])
    fits = (F.col("lag1.n") * 4 >= F.col("n") * 3) | (F.col("lead1.n") * 3 <= F.col("n") * 4)
    other = F.coalesce("lag1", "lead1")  # of two texts, the other one
    alone = F.col("lag2").isNull() & F.col("lead2").isNull() & (F.col("lag1").isNull() | F.col("lead1").isNull())
    before = F.floor(F.least(F.col("n"), other["n"]) / 16)  # all but the last of the meetings that count
    near = saved(rows.where(fits & (~alone | _enough(me, other, before))).select("pivot", "point", "n", "pos"), "meetings")
    # The partner may be smaller by a quarter; its share counts then.
    least = F.floor(F.col("n") * 3 / 64).cast("long") + 1
    live = near.groupBy("point").agg(F.count(F.lit(1)).alias("met"), F.first("n").alias("n")).where(F.col("met") >= least)
    return near.join(live.select("point"), "point", "left_semi")


def _enough(x: Column, y: Column, before: Column | None = None) -> Column:
    """Whether texts can have enough in common that meet at these places of their
    orders, and at ``before`` places (none if not given) earlier."""
    rest = F.least(x["n"] - x["pos"], y["n"] - y["pos"])
    return F.lit(3) * (x["n"] + y["n"]) <= F.lit(7) * (rest if before is None else rest + before)


def _cells(meetings: DataFrame) -> DataFrame:
    """Rows (pivot, band, home, point, n, pos, root, d): regions split by size."""
    band = F.floor(F.log(F.col("n")) / F.log(F.lit(4 / 3))).cast("int")
    edge = F.pow(F.lit(4 / 3), F.col("band") + 1)
    rows = meetings.withColumn("band", band)
    reach = F.lit(3) * (F.col("n") + F.floor(edge - 1e-6)) <= F.lit(7) * (F.col("n") - F.col("pos"))
    up = F.explode(F.when(reach, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.withColumn("up", up).select(
        "pivot", (F.col("band") + F.col("up")).alias("band"), (F.col("up") == 0).alias("home"), "point", "n", "pos",
        F.col("point").alias("root"), F.lit(None).cast("double").alias("d"))


def _compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Exact distances of (a, b): ``same`` and all shingles of both -> a, b, linked, d."""
    found = (pairs.join(sets.select(F.col("point").alias("b"), F.col("set").alias("set_b")), "b")
             .join(sets.select(F.col("point").alias("a"), F.col("set").alias("set_a")), "a")
             .select("a", "b", F.size(F.array_intersect("set_a", "set_b")).alias("same"),
                     (F.size("set_a") + F.size("set_b")).alias("both")))
    every = F.col("both") - F.col("same")
    return found.select("a", "b", (F.lit(100) * F.col("same") >= F.lit(75) * every).alias("linked"),
                        (F.lit(1.0) - F.col("same") / every).alias("d"))


def links(texts: DataFrame, order: bytes, k: int = K) -> DataFrame:
    """(a, b): links between points that connect every component of the link graph."""
    cells = _open(_cells(_meetings(texts, order, k)))
    wanted = bit_table(cells, "point")
    sets = saved(texts.mapInArrow(_full_sets(wanted, k), "point long, set array<long>").dropDuplicates(["point"])
                 .join(cells.select("point").distinct(), "point", "left_semi"), "sets")
    x, p = F.struct("n", "pos"), F.struct(F.col("p.n").alias("n"), F.col("p.pos").alias("pos"))
    # A first link for most texts: the pivot that they meet in most cells.
    heads = cells.where("home").groupBy("pivot", "band").agg(F.min(F.struct("n", "point", "pos")).alias("p"))
    often = (cells.join(heads, ["pivot", "band"]).where((F.col("point") != F.col("p.point")) & _enough(x, p))
             .groupBy("point", "p.point").agg(F.count(F.lit(1)).alias("n")).toDF("b", "a", "n"))
    pairs = often.groupBy("b").agg(F.max_by("a", F.struct("n", "a")).alias("a"))
    seen = saved(_compare(pairs, sets), "distances")
    found = seen.where("linked").select("a", "b")
    cells = _open(_relabel(cells, components(found)))
    pivots = FIRST_PIVOTS
    while not cells.isEmpty():
        ranked = cells.where("home").withColumn("at", F.row_number().over(
            Window.partitionBy("pivot", "band").orderBy("n", "point"))).where(F.col("at") <= pivots)
        chosen = ranked.select("pivot", "band", "at", F.struct("point", "n", "pos", "root", "d").alias("p"))
        later = ~F.col("home") | (F.struct("n", "point") > F.struct("p.n", "p.point"))
        apart = F.coalesce(F.abs(F.col("d") - F.col("p.d")) > 0.25 + 1e-9, F.lit(False))
        pairs = cells.join(chosen, ["pivot", "band"]).where(
            later & _enough(x, p) & ~apart & (F.col("root") != F.col("p.root"))).select(
            F.col("p.point").alias("a"), F.col("point").alias("b")).distinct().join(seen, ["a", "b"], "left_anti")
        now = saved(_compare(pairs, sets), "distances")
        seen = seen.unionByName(now)
        found = found.unionByName(now.where("linked").select("a", "b"))
        first = chosen.where("at = 1").select("pivot", "band", F.col("p.point").alias("a"))
        gone = ranked.select("pivot", "band", "point", "home")
        rest = (cells.drop("d").join(gone, ["pivot", "band", "point", "home"], "left_anti")
                .join(first, ["pivot", "band"])
                .join(seen.select("a", F.col("b").alias("point"), "d"), ["a", "point"], "left"))
        cells = _open(_relabel(rest, components(found)))
        pivots *= FIRST_PIVOTS
    return found


def _relabel(cells: DataFrame, roots: DataFrame) -> DataFrame:
    return saved(cells.drop("root").join(roots.withColumnRenamed("id", "point"), "point", "left").select(
        "pivot", "band", "home", "point", "n", "pos", F.coalesce("root", "point").alias("root"), "d"), "cells")


def _open(cells: DataFrame) -> DataFrame:
    """Cells with a home text and two components or more."""
    live = cells.groupBy("pivot", "band").agg(F.max("home").alias("any"), F.min("root").alias("lo"),
                                              F.max("root").alias("hi")).where("any and lo < hi")
    return saved(cells.join(live.select("pivot", "band"), ["pivot", "band"], "left_semi"), "open-cells")


def _rooted(docs: DataFrame, key_col: str, text_col: str, k: int) -> DataFrame:
    """One row per document row: ``key``, ``row`` (hash of key and text), ``n`` and
    ``root`` (equal in a component; null for a text without shingles)."""
    texts = key_text(docs, key_col, text_col)
    first = saved(texts.withColumn("row", row_hash("key", "text")).mapInArrow(_points(k), _POINT_SQL), "points")
    roots = components(links(texts, _pivot_order(first), k)).withColumnRenamed("id", "point")
    rows = first.where("slot is null").join(roots, "point", "left")
    return saved(rows.select("key", "row", "n", F.when(F.col("n") > 0, F.coalesce("root", "point")).alias("root")),
                 "rooted")


def group(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """One row per document row: ``key``, ``n`` (size of its set), ``component``
    (least key reachable by links; its own without links)."""
    rows = _rooted(docs, key_col, text_col, k)
    least = rows.where("n > 0").groupBy("root").agg(F.min("key").alias("least"))
    linked = rows.where("n > 0").join(least, "root").select("key", "n", F.col("least").alias("component"))
    return linked.unionByName(rows.where("n = 0").select("key", "n", F.col("key").alias("component")))


def deduplicate(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """The rows of ``docs`` of which one of each component stays: that of the least key
    (then the least row hash; a null key comes last).  Texts without shingles all stay."""
    rows = _rooted(docs, key_col, text_col, k)
    first = rows.where("n > 0").groupBy("root").agg(F.min(F.struct(F.col("key").isNull(), "key", "row")).alias("m"))
    keep = first.select(F.col("m.row").alias("row"), F.lit(True).alias("one")).unionByName(
        rows.where("n = 0").select("row", F.lit(False).alias("one")).distinct())
    kept = docs.select(row_hash(key_col, text_col).alias("row"), F.struct(*map(column, docs.columns)).alias("d")).join(keep, "row")
    # Rows equal in key and text: the one with the least hash of its columns.
    hashed = [F.col("d").getField(c) for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
    ranked = kept.where("one").select("row", "d", F.xxhash64(*hashed).alias("h"))
    once = ranked.groupBy("row").agg(F.min_by("d", "h").alias("d")).select("d").unionByName(kept.where("not one").select("d"))
    return once.select(*[F.col("d").getField(c).alias(c) for c in docs.columns])
