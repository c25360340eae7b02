"""Order without a single partition.

A DataFrame has no row order, but almost every operator of the corpus tools is
defined on one (file order, document order, time order).  Two primitives carry
that order through Spark at scale:

``with_pos``
    dense 0-based position by a sort key.  The data is range-partitioned on the
    key (Spark samples the bounds, so a hot key range is split like any other),
    sorted inside each partition, numbered locally, and the per-partition counts
    (one row per partition) give each partition its base.  The numbered frame
    is written below the shared checkpoint folder, so the count job and the
    final job read one execution of the range exchange, nothing stays cached,
    and later reads of it are pruned to the columns they need.  Select the
    columns that matter before the call: the exchange carries what it is given.

``with_file_pos``
    dense position in file order for a file scan, without moving any row: the
    counts of the (file, split) pairs, one row per split, give each its base.
    The position depends on paths and contents alone, not on the splits.

``running_sum``
    prefix sum in two levels: ``shard = pos div S`` bounds every window task to
    S rows, the shard totals (rows / S of them) get an exclusive running sum and
    are joined back.  No ``Window`` without ``partitionBy`` ever runs on
    data-sized input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, scratch_path

# Rows per shard of a two-level prefix sum: bounds one window task.
DEFAULT_SHARD_ROWS = 1 << 20
_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row index in the low 33 bits


def _cols(cols: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def stable(df: DataFrame, eager: bool = True) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint directory and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` as a fresh table below the shared checkpoint folder: computed once
    for several jobs, safe against lost executors, and no cache outlives the call."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_pos(df: DataFrame, order: Sequence[str | Column], pos_col: str = "pos",
             num_partitions: int | None = None) -> DataFrame:
    """Add a dense 0-based position ``pos_col`` following ``order`` (ties: make
    the key unique, e.g. append an id column)."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    order_cols = _cols(order)
    numbered = (
        df.repartitionByRange(n, *order_cols)
        .sortWithinPartitions(*order_cols)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_loc", F.monotonically_increasing_id()
                    - F.shiftleft(F.col("_pid").cast("long"), _LOCAL_BITS))
    )
    numbered = written(numbered, "numbered")
    counts = numbered.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: a global window is bounded by the partition count
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_base"))
    return (numbered.join(F.broadcast(bases), "_pid")
            .withColumn(pos_col, (F.col("_base") + F.col("_loc")).cast("long"))
            .drop("_pid", "_loc", "_base"))


def running_sum(df: DataFrame, value: str | Column, out_col: str, pos_col: str = "pos",
                partition_by: Sequence[str] = (), inclusive: bool = True,
                shard_rows: int = DEFAULT_SHARD_ROWS) -> DataFrame:
    """Running sum of ``value`` in ``pos_col`` order (per ``partition_by`` group).

    ``pos_col`` must be a dense position (``with_pos``) so shards are balanced;
    any increasing long key works for correctness.
    """
    v = F.col(value) if isinstance(value, str) else value
    parts = list(partition_by)
    shard = F.floor(F.col(pos_col) / F.lit(shard_rows)).cast("long")
    base_df = df.withColumn("_v", v).withColumn("_shard", shard)
    frame = Window.partitionBy(*parts, "_shard").orderBy(pos_col)
    frame = frame.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = base_df.withColumn("_loc", F.coalesce(F.sum("_v").over(frame), F.lit(0)))
    totals = base_df.groupBy(*parts, "_shard").agg(F.sum("_v").alias("_tot"))
    # rows / shard_rows rows per group: small, so a window per group is cheap
    w2 = Window.partitionBy(*parts).orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*parts, "_shard", F.coalesce(F.sum("_tot").over(w2), F.lit(0)).alias("_sbase"))
    # shard totals are tiny without groups; with groups let AQE decide from runtime size
    bases = F.broadcast(bases) if not parts else bases
    return (local.join(bases, [*parts, "_shard"])
            .withColumn(out_col, F.col("_sbase") + F.col("_loc"))
            .drop("_v", "_shard", "_loc", "_sbase"))


def hash_key(seed: int | str, *cols: str | Column) -> Column:
    """Seeded, repeatable shuffle key: ``md5('<seed>:<c1>:<c2>...')``.

    The same expression in DuckDB: ``md5(concat_ws(':', '<seed>', c1, ...))``.
    """
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str)
                                                        else c.cast("string") for c in cols]))


def file_order(df: DataFrame) -> DataFrame:
    """Columns giving file order for a file scan: path, split start, row in split.

    Must be called directly on a file scan (before any shuffle): the row index
    comes from ``monotonically_increasing_id`` inside each input split.
    """
    return (df.withColumn("_file", F.col("_metadata.file_path"))
            .withColumn("_block", F.col("_metadata.file_block_start"))
            .withColumn("_row", F.monotonically_increasing_id()))


FILE_ORDER = ("_file", "_block", "_row")


def with_file_pos(scan: DataFrame, pos_col: str = "pos") -> DataFrame:
    """Dense 0-based position in file order of a scan with ``FILE_ORDER`` columns
    (dropped).  Rows of one (file, split) pair are contiguous in their task, so
    their least row number there is the pair's start."""
    per = scan.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    # one row per split of the scan: a global window over them is bounded, and they go to the rows, not the rows to them
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = per.select("_file", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    at = F.col("_base") + F.col("_row") - F.col("_first")
    checked = F.when(F.col("_base").isNull(), F.raise_error(F.lit("the scan changed while it was numbered"))).otherwise(at)
    return (scan.join(F.broadcast(bases), ["_file", "_block"], "left").withColumn(pos_col, checked.cast("long"))
            .drop("_base", "_first", *FILE_ORDER))


def with_group_pos(df: DataFrame, group: Sequence[str], order: Sequence[str | Column],
                   pos_col: str = "gpos", global_col: str = "_gp") -> DataFrame:
    """Dense 0-based position inside each group (keeps the global position in
    ``global_col``).  One global range sort, then each group's first position
    (one row per group) is subtracted: a hot group is split like any range."""
    g = list(group)
    numbered = with_pos(df, [*g, *order], global_col)
    firsts = numbered.groupBy(*g).agg(F.min(global_col).alias("_g0"))
    return numbered.join(firsts, g).withColumn(pos_col, F.col(global_col) - F.col("_g0")).drop("_g0")


def rolling(df: DataFrame, group: Sequence[str], gpos_col: str, value: str, n: int, out_col: str,
            fn=F.avg, shard_rows: int = DEFAULT_SHARD_ROWS) -> DataFrame:
    """``fn`` over the last ``n`` rows (current included) of each group, by the
    dense group position ``gpos_col``.  Rows are cut into shards of
    ``shard_rows``; the last ``n - 1`` rows of a shard are copied into the next
    shard as halo, so every frame is local and every task bounded."""
    g = list(group)
    shard = F.floor(F.col(gpos_col) / F.lit(shard_rows)).cast("long")
    own = df.withColumn("_sh", shard).withColumn("_own", F.lit(True))
    halo = (own.where(F.pmod(F.col(gpos_col), F.lit(shard_rows)) >= shard_rows - (n - 1))
            .withColumn("_sh", F.col("_sh") + 1).withColumn("_own", F.lit(False)))
    w = Window.partitionBy(*g, "_sh").orderBy(gpos_col).rowsBetween(-(n - 1), 0)
    return (own.unionByName(halo).withColumn(out_col, fn(value).over(w))
            .where(F.col("_own")).drop("_sh", "_own"))


def prev_in_group(df: DataFrame, group: Sequence[str], pos_col: str, cols: Sequence[str],
                  prefix: str = "prev_", shard_rows: int = DEFAULT_SHARD_ROWS) -> DataFrame:
    """``lag`` of ``cols`` inside each group in ``pos_col`` order (a dense
    position), computed per (group, shard): a hot group is cut into bounded
    tasks, and each shard's last row is handed to the next shard of its group
    through a table of one row per (group, shard)."""
    g = list(group)
    base = df.withColumn("_sh", F.floor(F.col(pos_col) / F.lit(shard_rows)).cast("long"))
    w = Window.partitionBy(*g, "_sh").orderBy(pos_col)
    lagged = base.withColumn("_first", F.row_number().over(w) == 1)
    for c in cols:
        lagged = lagged.withColumn(prefix + c, F.lag(c).over(w))
    last = base.groupBy(*g, "_sh").agg(F.max_by(F.struct(*cols), F.col(pos_col)).alias("_last"))
    carry = last.withColumn("_carry", F.lag("_last").over(Window.partitionBy(*g).orderBy("_sh")))
    out = lagged.join(carry.select(*g, "_sh", "_carry"), [*g, "_sh"], "left")
    for c in cols:
        out = out.withColumn(prefix + c, F.when(F.col("_first"), F.col("_carry")[c]).otherwise(F.col(prefix + c)))
    return out.drop("_sh", "_first", "_carry")
