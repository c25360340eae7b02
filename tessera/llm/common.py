"""Pieces shared by the operators: table access, scratch tables, text arrays.

The text helpers work on Arrow string columns as flat UTF-8 byte buffers.  A
batch is walked in groups of whole rows of about ``GROUP_BYTES``; a longer row
forms a group of its own and is hashed in pieces cut between words, so the
memory of a task follows the batch and not the square of anything.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

GROUP_BYTES = 1 << 20
_U = np.uint64
_MULT = 0x9E3779B97F4A7C15 | 1
_MULT_INV = pow(_MULT, -1, 1 << 64)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back.

    Cuts the lineage: what follows survives lost executors without repeating
    the work before it, and a table read twice is computed once.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def column(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def refuse_columns(df: DataFrame, *names: str) -> None:
    """Raise if ``df`` has a column that the result adds itself (in any case)."""
    taken = sorted(set(c.lower() for c in df.columns) & set(names))
    if taken:
        raise ValueError(f"columns {', '.join(taken)} are added by the operator: rename yours")


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: spreads every input bit over the whole word."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))
_powers = (np.ones(1, _U), np.ones(1, _U))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the hash multiplier and of its inverse modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, GROUP_BYTES + 4096)
        out = []
        for base in (_MULT, _MULT_INV):
            p = np.full(size, base & (2**64 - 1), _U)
            p[0] = 1
            out.append(np.cumprod(p))
        _powers = (out[0], out[1])
    return _powers[0][:n], _powers[1][:n]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    column = column.cast(pa.large_binary() if binary else pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if binary else "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bufs = column.buffers()
    offsets = np.frombuffer(bufs[1], np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def row_groups(offsets: np.ndarray, size: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows of about ``size`` bytes each."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield lo, hi
        lo = hi


def byte_class(keep) -> np.ndarray:
    """Lookup table: which byte values satisfy ``keep``."""
    return np.array([bool(keep(b)) for b in range(256)])


ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


class Words:
    """Words of a range of rows: byte starts and ends, row of each, 64-bit hash.

    ``first[i]:first[i + 1]`` are the words of the i-th row of the range.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray, is_word: np.ndarray,
                 heads: tuple[int, ...] = ()):
        self.data, self.bounds = data, bounds
        n = len(data)
        inside = is_word[data]
        cut = np.zeros(n + 1, bool)
        cut[bounds] = True
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | cut[:-1]))
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        self.end = np.flatnonzero(inside & (~after | cut[1:])) + 1
        self.first = np.searchsorted(self.start, bounds, "left")
        self.row = np.repeat(np.arange(len(bounds) - 1), np.diff(self.first))
        self.hash, self.heads = self._hashes(heads)

    def _hashes(self, heads: tuple[int, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Hash of every word, and of its first ``h`` bytes (whole code points) for each h of ``heads``."""
        full, head = np.empty(len(self.start), _U), [np.empty(len(self.start), _U) for _ in heads]
        i = 0
        while i < len(self.start):
            base = int(self.start[i])
            j = max(i + 1, int(np.searchsorted(self.end, base + GROUP_BYTES, "right")))
            size = int(self.end[j - 1]) - base
            up, down = powers(size + 1)
            total = np.zeros(size + 1, _U)
            np.cumsum(_BYTE[self.data[base:base + size]] * up[:size], out=total[1:])
            s, e = self.start[i:j] - base, self.end[i:j] - base
            full[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(_U) * _U(0xA24BAED4963EE407))
            for out, h in zip(head, heads, strict=True):
                stop = np.minimum(e, s + h)
                for _ in range(3):  # never cut inside a code point
                    stop = stop + ((stop < e) & ((self.data[base + np.minimum(stop, size - 1)] & 0xC0) == 0x80))
                out[i:j] = mix((total[stop] - total[s]) * down[s] + _U(h * 0x51ED270B27D4EB4F % 2**64))
            i = j
        return full, head


def ngram_hashes(word_hash: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive words (order matters); rows are not looked at."""
    n = max(0, len(word_hash) - k + 1)
    total = np.full(n, (seed * 0x9E3779B97F4A7C15) % 2**64, _U)
    for j in range(k):
        total = total * _U(0x9FB21C651E98DF25) + word_hash[j:j + n]
    return mix(total)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


BATCH_BYTES = 8 << 20


def key_text(docs: DataFrame, key_col: str, text_col: str) -> DataFrame:
    """(key, text) of documents, on their way to tasks in Arrow batches of at most BATCH_BYTES.

    Spark's own bound on a batch is 64 MB; a task holds a batch on both sides
    and what is made of it, so the session's bound is lowered to this one.
    """
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    conf = docs.sparkSession.conf
    now = re.fullmatch(r"([0-9]+)([km]?)b?", conf.get(bound, "64m").lower())
    if not now or not 0 < int(now[1]) << {"": 0, "k": 10, "m": 20}[now[2]] <= BATCH_BYTES:
        conf.set(bound, f"{BATCH_BYTES}b")
    return docs.select(F.col(key_col).cast("long").alias("key"), F.col(text_col).cast("string").alias("text"))


def row_hash(key_col: str, text_col: str) -> Column:
    """A hash that equal documents share, for joining back what follows from key and text."""
    return F.xxhash64(F.col(key_col).cast("long"), F.col(text_col).cast("string"))


def training_sample(labels: DataFrame, label_col: str, key_col: str, per_class: int) -> DataFrame:
    """(key, y): about ``per_class`` labelled keys of each class at most, by a hash of the key.

    Keys whose crc32 leaves 0 modulo 5 are held out.  Rows without key or
    label do not count; a key with several labels takes the largest.  The
    result has some 2 * per_class rows whatever the input.
    """
    known = (labels.select(F.col(key_col).cast("long").alias("key"), F.col(label_col).cast("int").alias("y"))
             .where("key is not null and y in (0, 1)").where(~held_out("key")).groupBy("key").agg(F.max("y").alias("y")))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    buckets = 1 << 20
    keep = F.lit(False)
    for y, n in counts.items():
        share = min(buckets, int(buckets * per_class / n))
        keep = keep | ((F.col("y") == y) & (F.pmod(F.xxhash64("key"), F.lit(buckets)) < share))
    return known.where(keep)


def held_out(key_col: str):
    """Whether a row belongs to the test fold; rows without a key do not."""
    return F.coalesce(F.crc32(F.col(key_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


BITS = 1 << 24


def bit_table(df: DataFrame, column: str) -> bytes:
    """A table of ``BITS`` bits in which the values of a long column are set.

    At most BITS / 64 rows reach the driver, whatever the input.  A test
    against it (:func:`maybe_in`) can say yes wrongly, never no.
    """
    slot = F.pmod(F.col(column), F.lit(BITS))
    rows = df.groupBy(F.shiftright(slot, 6).cast("int").alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))).alias("bits")
    ).collect()
    table = np.zeros(BITS // 64, np.int64)
    for r in rows:
        table[r["word"]] = r["bits"]
    return table.tobytes()


def maybe_in(table: bytes, values: np.ndarray) -> np.ndarray:
    """Which of the unsigned 64-bit ``values`` may be among those of :func:`bit_table`."""
    slot = values & _U(BITS - 1)
    return (np.frombuffer(table, _U)[(slot >> _U(6)).astype(np.int64)] >> (slot & _U(63))) & _U(1) > 0
