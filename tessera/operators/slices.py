"""Slicing, sampling, union and splits (SMP, SET, SPL, AGG-1).

Order is explicit: every function takes the sort key that defines "file order"
for its input (a unique key column for tables, ``order.FILE_ORDER`` for scans).
Random orders are seeded md5 ranks, so a slice or split is repeatable and
every row lands exactly once; the reference's Mersenne-Twister permutation is
sequential by nature and is not reproduced.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import SamplingError
from .order import hash_key, with_pos

SLICE_SEED = 42  # loaders' own seed: recipe seeds never reach slice shuffles
BLOCK_SIZE = 10_000  # sequential split block
BOUNDARY_ROWS = 100_000  # rows among which the cut of a split is looked up
PREFIX = 3  # hex digits of the hash that locate a rank


def _check_range(offset: int, limit: int | None) -> None:
    if offset is None or offset < 0:
        raise SamplingError("offset must be >= 0")
    if limit is not None and limit <= 0:
        raise SamplingError("limit must be > 0")


def _range(df: DataFrame, offset: int, limit: int | None, pos_col: str) -> DataFrame:
    cond = F.col(pos_col) >= offset
    if limit is not None:
        cond = cond & (F.col(pos_col) < offset + limit)
    return df.where(cond).withColumn(pos_col, F.col(pos_col) - F.lit(offset))


def slice_sequential(df: DataFrame, order: Sequence[str | Column], offset: int = 0,
                     limit: int | None = None, pos_col: str = "pos") -> DataFrame:
    """Skip ``offset`` rows of ``order``, keep at most ``limit``; ``pos`` re-based to 0."""
    _check_range(offset, limit)
    return _range(with_pos(df, order, pos_col), offset, limit, pos_col)


def slice_random(df: DataFrame, key: Sequence[str], offset: int = 0, limit: int | None = None,
                 seed: int = SLICE_SEED, pos_col: str = "pos") -> DataFrame:
    """Shuffle everything (seeded md5 rank of ``key``), then offset and limit.

    With a limit, counts of hash prefixes (at most 16**PREFIX rows at the
    driver) say which prefixes the wanted ranks lie in; only their rows are
    ordered."""
    _check_range(offset, limit)
    ranked = df.withColumn("_h", hash_key(seed, *key))
    base = 0
    if limit is not None:
        prefix = F.substring("_h", 1, PREFIX)
        counts = sorted(tuple(r) for r in ranked.groupBy(prefix).count().collect())
        keep, seen = [], 0
        for p, n in counts:
            if seen + n <= offset:
                base = seen + n
            elif seen < offset + limit:
                keep.append(p)
            seen += n
        if not keep:
            return with_pos(ranked.where(F.lit(False)), ["_h", *key], pos_col).drop("_h")
        ranked = ranked.where(prefix.between(keep[0], keep[-1]))
    return _range(with_pos(ranked, ["_h", *key], pos_col), offset - base, limit, pos_col).drop("_h")


def slice_legacy(df: DataFrame, order: Sequence[str | Column], key: Sequence[str], offset: int = 0,
                 limit: int | None = None, seed: int = SLICE_SEED, pos_col: str = "pos") -> DataFrame:
    """Legacy loader order: offset and limit first, then shuffle what is left."""
    first = slice_sequential(df, order, offset, limit, pos_col="_seq")
    shuffled = first.withColumn("_h", hash_key(seed, *key))
    return with_pos(shuffled, ["_h", *key], pos_col).drop("_h", "_seq")


Strategy = Callable[..., DataFrame]
_STRATEGIES: dict[str, Strategy] = {}


def register_sampling(name: str, strategy: Strategy) -> None:
    """A strategy is called as ``(df, order, key, offset, limit, seed)`` and returns the
    kept rows with a dense ``pos``."""
    _STRATEGIES[name.lower()] = strategy


def sampling_names() -> list[str]:
    return sorted(_STRATEGIES)


register_sampling("sequential", lambda df, order, key, offset, limit, seed: slice_sequential(df, order, offset, limit))
register_sampling("random", lambda df, order, key, offset, limit, seed: slice_random(df, key, offset, limit, seed))


def apply_sampling(df: DataFrame, sampling: str, order: Sequence[str | Column], key: Sequence[str],
                   offset: int = 0, limit: int | None = None, seed: int = SLICE_SEED,
                   slice_first: bool = False) -> DataFrame:
    """Strategy choice by (lower-cased) name."""
    name = (sampling or "").lower()
    if name not in _STRATEGIES:
        raise SamplingError(f"Unknown sampling strategy {sampling!r}; available: {', '.join(sampling_names())}")
    if name == "random" and slice_first:
        return slice_legacy(df, order, key, offset, limit, seed)
    return _STRATEGIES[name](df, order, key, offset, limit, seed)


def merge_slices(slices: Sequence[tuple[str, DataFrame]], pos_col: str = "pos") -> DataFrame:
    """Concatenate slices in recipe order; schemas may differ, duplicates kept.

    Each slice carries a dense ``pos``; the merged ``pos`` continues across
    slices (slice bases from one count per slice).
    """
    tagged = [df.withColumn("slice_ord", F.lit(i)).withColumn("slice_key", F.lit(k))
              for i, (k, df) in enumerate(slices)]
    merged = tagged[0]
    for t in tagged[1:]:
        merged = merged.unionByName(t, allowMissingColumns=True)
    counts = merged.groupBy("slice_ord").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("slice_ord").rowsBetween(Window.unboundedPreceding, -1)  # one row per slice
    bases = counts.select("slice_ord", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_base"))
    return (merged.join(F.broadcast(bases), "slice_ord")
            .withColumn(pos_col, F.col(pos_col) + F.col("_base")).drop("_base"))


# --- splits ------------------------------------------------------------------------
def train_count(n: int, train_split: float) -> int:
    """``int(n * train_split)`` with an IEEE double product (0.57 of 10,000 is 5,699)."""
    return int(math.floor(float(n) * float(train_split)))


def split_shuffled(df: DataFrame, key: Sequence[str], train_split: float = 0.8, seed: int = 42,
                   split_col: str = "split", buckets_hex: int = 3) -> DataFrame:
    """Exact-count shuffled split: the first ``int(n * train_split)`` rows of the
    seeded order go to ``train``, the rest to ``validation``.

    Bucketed rank selection, no global sort: rows are bucketed by the first hex
    digits of their md5 key (16^3 near-uniform buckets); one aggregate counts
    the buckets and whole buckets fall on either side of the cut.  The boundary
    bucket is refined until it is small; its row at the cut makes the split a
    plain comparison, without a shuffle of the rows.
    """
    h = df.withColumn("_h", hash_key(seed, *key))
    h = h.withColumn("_b", F.conv(F.substring("_h", 1, buckets_hex), 16, 10).cast("int"))
    counts = sorted((int(r[0]), int(r[1])) for r in
                    h.groupBy("_b").agg(F.count(F.lit(1))).collect())  # <= 16^buckets_hex rows
    n = sum(c for _, c in counts)
    cut = train_count(n, train_split)
    before, boundary, need = 0, None, 0
    for b, c in counts:
        if before + c > cut:
            boundary, need = b, cut - before
            break
        before += c
    if boundary is None:  # everything is train
        return h.withColumn(split_col, F.lit("train")).drop("_h", "_b")
    # Refine the boundary bucket by further hex digits until one step's rows are few, then name the cut row.
    low = f"{boundary:0{buckets_hex}x}"
    while need and len(low) < 32 - buckets_hex:
        inner = h.where(F.col("_h").startswith(low))
        step = sorted(tuple(r) for r in inner.groupBy(F.substring("_h", 1, len(low) + buckets_hex)).count().collect())
        if sum(n for _, n in step) <= BOUNDARY_ROWS:
            break
        for p, n in step:
            if n > need:
                low = p
                break
            need -= n
    cut = (h.where(F.col("_h").startswith(low)).select(F.struct("_h", *key).alias("k")).orderBy("k")
           .limit(need + 1).collect())[-1]["k"]
    me = F.struct("_h", *key)
    first_out = F.struct(*[F.lit(cut[f.name]).cast(f.dataType).alias(f.name)
                           for f in h.select(me.alias("k")).schema["k"].dataType.fields])
    return h.withColumn(split_col, F.when(me < first_out, "train").otherwise("validation")).drop("_h", "_b")


def split_blocks(df: DataFrame, train_split: float = 0.8, pos_col: str = "pos",
                 block_size: int = BLOCK_SIZE, split_col: str = "split") -> DataFrame:
    """Sequential block split: in every block of ``block_size`` rows of ``pos``
    order the first ``int(block_size * train_split)`` go to train.  Stateless
    per row, so it runs unchanged on a stream that carries ``pos``."""
    target = train_count(block_size, train_split)
    return df.withColumn(split_col, F.when(F.pmod(F.col(pos_col), F.lit(block_size)) < target, "train")
                         .otherwise("validation"))


def split_stats(split_df: DataFrame, dataset_name: str, dataset_key: str, train_split: float,
                validation_split: float, num_slices: int, split_strategy: str | None = None,
                split_col: str = "split") -> DataFrame:
    """One row of split statistics from a single aggregate."""
    agg = split_df.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count(F.when(F.col(split_col) == "train", 1)).alias("train_records"),
        F.count(F.when(F.col(split_col) == "validation", 1)).alias("validation_records"))
    cols = [F.lit(dataset_name).alias("dataset_name"), F.lit(dataset_key).alias("dataset_key"),
            "total_records", "train_records", "validation_records",
            F.lit(float(train_split)).alias("train_split"),
            F.lit(float(validation_split)).alias("validation_split"),
            F.lit(int(num_slices)).alias("num_slices")]
    if split_strategy is not None:
        cols.append(F.lit(split_strategy).alias("split_strategy"))
    return agg.select(*cols)
