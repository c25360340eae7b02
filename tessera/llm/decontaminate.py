"""Benchmark decontamination by winnowing.

Words are runs of ``[0-9a-z]`` and non-ASCII characters after lower-casing
A-Z.  A window is ``window`` (10) consecutive words of a benchmark item; a
shorter item that has words is one window.

*Winnowing.*  Every run of ``K`` (5) words is hashed; in each run of
``window - K + 1`` such hashes the least (the first of equal ones) is the
fingerprint, and neighbouring windows that choose the same position are one
row: the words from the first such window's start to the last one's end.  The
fingerprint of a window depends on its own words alone, so a window that a
document shares with an item has the same fingerprint on both sides: every
shared span of ``window`` words or more is found, without exception.  Items of
m < window words use the hash of their whole m words, against all m-word runs.

*Join.*  Benchmark fingerprints set bits in a table of fixed size
(2**24 bits), the only thing sent to the tasks.  It can let too
much pass, never too little.  Document positions whose fingerprint may occur
become rows.  A position extends left and right by the windows of its row: an
equi-join on (fingerprint, window words) with the benchmark's distinct windows
confirms each word for word.  (A join on the fingerprint alone, extended
afterwards, would meet every document with every item for a common run of K
words.)  Windows with the same items share the number of that set of items, and
a document meets each set once.

Inputs: nulls and empty texts have no words.  Repeated documents each give
their own row; repeated items count once by ``item_id``; an item without an
id marks words but is not counted.  Empty tables give empty or clean results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import (ASCII_LOWER, Words, bit_table, byte_class, column, key_text, maybe_in, ngram_hashes, row_groups, row_hash, saved,
                     signed, text_buffer)

WINDOW = 10
K = 5
IS_WORD = byte_class(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)

_FOUND = pa.schema([("uid", pa.int64()), ("key", pa.int64()), ("n_words", pa.int64()), ("start", pa.int32()),
                    ("len", pa.int32()), ("fp", pa.int64()), ("win", pa.string())])


def _windows(words: Words, m: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start (word index), fingerprint and its position for each run of ``m`` words inside one row."""
    n = len(words.hash) - m + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.arange(n)
    if m == window and m >= K:
        grams = ngram_hashes(words.hash, K, window)
        fp = grams[:n].copy()
        for j in range(1, m - K + 1):
            less = grams[j:j + n] < fp
            fp[less] = grams[j:j + n][less]
            at[less] = np.flatnonzero(less) + j
    else:
        fp = ngram_hashes(words.hash, m, m)
    whole = np.flatnonzero(words.row[:n] == words.row[m - 1:m - 1 + n])
    return whole, fp[whole], at[whole]


def _texts(words: Words, starts: np.ndarray, stops: np.ndarray) -> list[str]:
    data = words.data
    return [b" ".join(data[words.start[i]:words.end[i]].tobytes() for i in range(s, e)).decode("utf-8", "replace")
            for s, e in zip(starts.tolist(), stops.tolist(), strict=True)]


def _scan(lengths: list[int], table: bytes | None, window: int):
    """Task: rows (key, text) -> one row per text, then its chosen positions.

    A position's row has the words of all its windows.  Without ``table`` every
    window of the text's own length class is kept (the benchmark side); with
    ``table`` those that may occur there.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        uid = (TaskContext.get().partitionId()) << 36
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            keys = batch.column(0)
            for lo, hi in row_groups(offsets):
                a, b = int(offsets[lo]), int(offsets[hi])
                w = Words(ASCII_LOWER[data[a:b]], offsets[lo:hi + 1] - a, IS_WORD)
                count = np.diff(w.first)
                ids = uid + np.arange(hi - lo)
                uid += hi - lo
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), keys.slice(lo, hi - lo), pa.array(count), *(pa.nulls(hi - lo, t) for t in
                     (pa.int32(), pa.int32(), pa.int64(), pa.string()))], schema=_FOUND)
                own = range(1, window + 1) if table is None else lengths
                for m in own:
                    start, fp, at = _windows(w, m, window)
                    if table is None:
                        keep = count[w.row[start]] >= window if m == window else count[w.row[start]] == m
                    else:
                        keep = maybe_in(table, fp)
                    start, fp, at = start[keep], fp[keep], at[keep]
                    head = np.flatnonzero((np.diff(start, prepend=-2) != 1) | (np.diff(at, prepend=-1) != 0))
                    stop = start[np.append(head[1:], len(start)) - 1] + m if len(start) else start
                    start, fp = start[head], fp[head]
                    for c in range(0, len(start), 20_000):
                        s, r = start[c:c + 20_000], w.row[start[c:c + 20_000]]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ids[r]), keys.take(pa.array(r + lo)), pa.nulls(len(s), pa.int64()),
                             pa.array((s - w.first[r]).astype(np.int32)), pa.array(np.full(len(s), m, np.int32)),
                             pa.array(signed(fp[c:c + 20_000])), pa.array(_texts(w, s, stop[c:c + 20_000]), pa.string())], schema=_FOUND)
    return run


_FOUND_SQL = "uid long, key long, n_words long, start int, len int, fp long, win string"


def _each_window(rows: DataFrame) -> DataFrame:
    """One row per window (``start``, ``win``) of the positions."""
    words = F.split("win", " ")
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - F.col("len")),
                          lambda i: F.array_join(F.slice(words, i + 1, F.col("len")), " "))
    return rows.where("fp is not null").select(
        "uid", "key", "start", "len", "fp", F.posexplode(windows).alias("i", "win")).withColumn(
        "start", F.col("start") + F.col("i")).drop("i")


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text",
                      window: int = WINDOW) -> DataFrame:
    """Distinct windows of the items: ``len``, ``fp``, ``win``, ``items`` (ids that have it), ``set`` (hash of ``items``)."""
    rows = benchmark.select(F.col(item_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(
        _scan([], None, window), _FOUND_SQL)
    found = _each_window(rows).groupBy("len", "fp", "win").agg(F.array_sort(F.collect_set("key")).alias("items"))
    return found.withColumn("set", F.sha2(F.array_join(F.transform("items", lambda x: x.cast("string")), ","), 256))


def covered(spans: str) -> Column:
    """Number of positions inside the union of ``array<struct<start, stop>>``."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("stop"))
    return F.aggregate(
        F.array_sort(F.col(spans)), zero,
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(acc["stop"], x["start"])).cast("long")).alias("n"),
            F.greatest(acc["stop"], x["stop"]).alias("stop")),
        lambda acc: acc["n"])


def find_contamination(docs: DataFrame, benchmark: DataFrame, key_col: str = "doc_id", text_col: str = "text",
                       item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document row: ``key``, ``n_words``, ``n_hit`` (words inside an
    occurrence of a window), ``spans`` (merged into word ranges by the caller if
    wanted; here all confirmed windows as start/stop) and ``items`` (ids found)."""
    items = saved(benchmark_windows(benchmark, item_col, item_text_col, window), "windows")
    lengths = [r[0] for r in items.select("len").distinct().collect()]  # at most `window` values
    scan = _scan(sorted(lengths), bit_table(items, "fp"), window)
    rows = saved(key_text(docs, key_col, text_col).mapInArrow(
        scan, _FOUND_SQL), "candidates")
    hits = (_each_window(rows).join(items.select("len", "fp", "win", "set"), ["fp", "win", "len"])
            .groupBy("uid").agg(
                F.collect_set(F.struct("start", (F.col("start") + F.col("len")).alias("stop"))).alias("spans"),
                F.collect_set("set").alias("sets")))
    hits = saved(hits, "hits")
    sets = items.select("set", "items").dropDuplicates(["set"])
    ids = (hits.select("uid", F.explode("sets").alias("set")).join(sets, "set")
           .groupBy("uid").agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")))
    hits = hits.select("uid", "spans").join(ids, "uid")
    return (rows.where("fp is null").select("uid", "key", "n_words").join(hits, "uid", "left")
            .select("key", "n_words", F.coalesce(covered("spans"), F.lit(0).cast("long")).alias("n_hit"),
                    F.coalesce("spans", F.array().cast("array<struct<start:int,stop:int>>")).alias("spans"),
                    F.coalesce("items", F.array().cast("array<long>")).alias("items")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, key_col: str = "doc_id", text_col: str = "text",
                      item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without an occurrence of a benchmark window, with all their columns."""
    key = row_hash(key_col, text_col).alias("row")
    found = find_contamination(docs.select(key, column(text_col).alias("text")), benchmark, "row", "text", item_col,
                               item_text_col, window)
    bad = found.where("n_hit > 0").select(F.col("key").alias("row"))
    clean = docs.select(key, F.struct(*map(column, docs.columns)).alias("d")).join(bad, "row", "left_anti")
    return clean.select(*[F.col("d").getField(c).alias(c) for c in docs.columns])
