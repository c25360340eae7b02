"""Event-log (profiler trace) analytics on a DataFrame of events.

Expected columns: ``event_index`` (file order), ``ts`` (microseconds),
``dur`` (microseconds), ``name``, ``cat``, ``ph``, ``args MAP<STRING,STRING>``,
plus the memory fields ``addr``, ``bytes``, ``device`` (null when absent).

* Aggregates are hash aggregates (partial + final); top-k is ``orderBy.limit``,
  planned as ``TakeOrderedAndProject`` (per-partition top-k, then merge).
* Free matching (as-of join): among memory events of one address in file
  order, a free matches exactly when the previous one is an allocation.
* Running balances use the two-level prefix sum of ``order.running_sum``; their
  peaks and ends compose from sums of stretches, without the running rows.
* Active operations: a sweep in time order for counts, aligned blocks of ranks for
  the earliest one; an interval join by levels of bucket widths where pairs are wanted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import prev_in_group, running_sum, with_pos, written

TOP_N = 20
MIB = 1024 * 1024
# --- fixed values: labelled training sections looked up by name ---------------
SECTION_NAMES = ("data_loading", "forward", "loss_computation", "backward",
                 "gradient_clipping", "optimizer_step")


def device_label(device: str | Column) -> Column:
    d = F.col(device) if isinstance(device, str) else device
    return F.when(d == -1, F.lit("CPU")).otherwise(F.concat(F.lit("GPU_"), d.cast("string")))


def _complete(trace: DataFrame) -> DataFrame:
    return trace.where(F.col("ph") == "X")


def category_summary(trace: DataFrame, top: int = TOP_N) -> DataFrame:
    agg = (_complete(trace).groupBy(F.coalesce("cat", F.lit("Unknown")).alias("cat"))
           .agg(F.count(F.lit(1)).alias("count"), F.sum(F.coalesce("dur", F.lit(0.0))).alias("total_dur")))
    agg = agg.withColumn("avg_dur", F.col("total_dur") / F.col("count"))
    return agg.orderBy(F.col("total_dur").desc(), "cat").limit(top)


def operation_stats(trace: DataFrame) -> DataFrame:
    ops = _complete(trace).where(F.col("dur") > 0)
    agg = (ops.groupBy(F.coalesce("name", F.lit("Unknown")).alias("name"))
           .agg(F.count(F.lit(1)).alias("count"), F.sum("dur").alias("total_dur")))
    return agg.withColumn("avg_dur", F.col("total_dur") / F.col("count"))


def top_total(trace: DataFrame, top: int = TOP_N) -> DataFrame:
    return operation_stats(trace).orderBy(F.col("total_dur").desc(), "name").limit(top)


def top_avg(trace: DataFrame, top: int = TOP_N) -> DataFrame:
    return operation_stats(trace).orderBy(F.col("avg_dur").desc(), "name").limit(top)


def sections(trace: DataFrame, names=SECTION_NAMES) -> DataFrame:
    return operation_stats(trace).where(F.col("name").isin(list(names)))


def device_class(trace: DataFrame) -> DataFrame:
    ops = _complete(trace).where(F.col("dur") > 0)
    lc = F.lower(F.coalesce("cat", F.lit("")))
    cls = F.when(lc.contains("cuda") | lc.contains("gpu"), "GPU").otherwise("CPU")
    return ops.groupBy(cls.alias("device_class")).agg(F.count(F.lit(1)).alias("count"),
                                                        F.sum("dur").alias("total_dur"))


def _is_alloc_named(name: Column) -> Column:
    return name.contains("[memory]") | name.contains("cudaMalloc") | name.contains("Allocated")


def _arg(key: str) -> Column:
    return F.element_at("args", F.lit(key))


def memory_classes(trace: DataFrame) -> DataFrame:
    """Allocations, frees, counter snapshots (classes may overlap)."""
    name = F.coalesce("name", F.lit(""))
    has_key = F.array_contains(F.map_keys("args"), "Addr") | F.array_contains(F.map_keys("args"), "Device Id")
    alloc = _is_alloc_named(name) & F.coalesce(has_key, F.lit(False))
    free = name.contains("cudaFree") | name.contains("Freed")
    counter = (F.col("ph") == "C") & F.lower(name).contains("memory")
    return trace.agg(F.count(F.when(alloc, 1)).alias("allocations"),
                     F.count(F.when(free, 1)).alias("frees"),
                     F.count(F.when(counter, 1)).alias("snapshots"))


def _sized_allocations(trace: DataFrame) -> DataFrame:
    """Allocations of a positive ``size``."""
    name = F.coalesce("name", F.lit(""))
    has_key = F.array_contains(F.map_keys("args"), "Addr") | F.array_contains(F.map_keys("args"), "Device Id")
    size = F.coalesce(_arg("Bytes").try_cast("double"), _arg("bytes").try_cast("double"), F.lit(0.0))
    return (trace.where(_is_alloc_named(name) & F.coalesce(has_key, F.lit(False))).withColumn("size", size)
            .where(F.col("size") > 0))


def largest_allocations(trace: DataFrame, top: int = TOP_N) -> DataFrame:
    """The largest allocations, ties in file order."""
    device = F.coalesce(_arg("Device Id"), _arg("device"), F.lit("N/A")).alias("device")
    return _sized_allocations(trace).select("event_index", "name", "size", device).orderBy(
        F.col("size").desc(), "event_index").limit(top)


def allocation_total(trace: DataFrame) -> DataFrame:
    """Total and number of the allocations of a positive size."""
    return _sized_allocations(trace).agg(F.sum("size").alias("total_bytes"), F.count(F.lit(1)).alias("allocations"))


def gauge_stats(trace: DataFrame) -> DataFrame:
    """Per memory counter: min / avg / max / samples over all numeric args; MB if max > 1 MiB."""
    counters = trace.where((F.col("ph") == "C") & F.lower(F.coalesce("name", F.lit(""))).contains("memory"))
    vals = counters.select("name", F.explode("args").alias("k", "v")).select(
        "name", F.col("v").try_cast("double").alias("x")).where(F.col("x").isNotNull())
    agg = vals.groupBy("name").agg(F.min("x").alias("min"), F.avg("x").alias("avg"),
                                   F.max("x").alias("max"), F.count(F.lit(1)).alias("samples"))
    big = F.col("max") > MIB
    scale = F.when(big, F.lit(float(MIB))).otherwise(F.lit(1.0))
    return agg.select("name", (F.col("min") / scale).alias("min"), (F.col("avg") / scale).alias("avg"),
                      (F.col("max") / scale).alias("max"), "samples",
                      F.when(big, "MB").otherwise("bytes").alias("unit"))


# --- memory balance ----------------------------------------------------------------
def memory_deltas(trace: DataFrame) -> DataFrame:
    """Signed memory deltas in file order: allocations (``[memory]`` events with a
    non-zero address and size, negative sizes kept) and frees (``free`` /
    ``dealloc`` in the name) matched to the open allocation of their address."""
    name = F.coalesce("name", F.lit(""))
    lname = F.lower(name)
    is_alloc = name.contains("[memory]") & F.coalesce(F.col("addr") != 0, F.lit(False)) \
        & F.coalesce(F.col("bytes") != 0, F.lit(False))
    is_free = (lname.contains("free") | lname.contains("dealloc")) & F.coalesce(F.col("addr") != 0, F.lit(False))
    mem = (trace.where(is_alloc | is_free)
           .select("event_index", "ts", "name", "addr", "bytes", "device",
                   F.when(is_alloc, "alloc").otherwise("free").alias("kind")))
    # previous memory event of the same address (a hot address is sharded)
    mem = prev_in_group(mem, ["addr"], "event_index", ["kind", "bytes", "device"], prefix="_p")
    mem = (mem.withColumnRenamed("_pkind", "_pk").withColumnRenamed("_pbytes", "_pb")
           .withColumnRenamed("_pdevice", "_pd"))
    matched_free = (F.col("kind") == "free") & (F.col("_pk") == "alloc")
    return (mem.where((F.col("kind") == "alloc") | matched_free)
            .select("event_index", "ts", "name", "addr", "kind",
                    F.when(F.col("kind") == "alloc", F.col("bytes")).otherwise(-F.col("_pb")).alias("delta"),
                    F.when(F.col("kind") == "alloc", F.col("device")).otherwise(F.col("_pd")).alias("device")))


def running_balance(deltas: DataFrame) -> DataFrame:
    """Per-device and total balance after every memory event, in (ts, file) order."""
    ordered = with_pos(deltas, ["ts", "event_index"], "seq")
    dev = running_sum(ordered, "delta", "device_balance", pos_col="seq", partition_by=["device"])
    return running_sum(dev, "delta", "total_balance", pos_col="seq")


def balance_sums(deltas: DataFrame) -> DataFrame:
    """(part, scope, total, peak, peak_ts): what each stretch of the events adds up to, per device and for ``total``.

    A running balance is a sum with its highest prefix and that prefix's first time; stretches compose.  Events are
    sorted inside ranges of (ts, file) order, and a range leaves one row per scope: no running row is ever written."""
    n = int(deltas.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ordered = deltas.select("ts", "event_index", F.col("device").cast("string").alias("scope"), "delta").repartitionByRange(
        n, "ts", "event_index").sortWithinPartitions("ts", "event_index")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, sums = TaskContext.get().partitionId(), {}
        for batch in batches:
            for ts, scope, delta in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for name in ((0, scope), (1, "total")):
                    s = sums.setdefault(name, [0, None, None])
                    s[0] += delta
                    if s[1] is None or s[0] > s[1]:
                        s[1:] = s[0], ts
        yield pa.RecordBatch.from_pylist(
            [{"part": part, "whole": bool(k), "scope": scope, "total": t, "peak": p, "peak_ts": ts}
             for (k, scope), (t, p, ts) in sums.items()], schema=pa.schema([
                 ("part", pa.int32()), ("whole", pa.bool_()), ("scope", pa.string()), ("total", pa.int64()),
                 ("peak", pa.int64()), ("peak_ts", pa.float64())]))
    return ordered.select(F.col("ts").cast("double"), "scope", F.col("delta").cast("long")).mapInArrow(
        run, "part int, whole boolean, scope string, total long, peak long, peak_ts double")


def peaks(sums: DataFrame) -> DataFrame:
    """First time each running balance reaches its maximum (only maxima above 0), from :func:`balance_sums`."""
    before = Window.partitionBy("whole", "scope").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    high = F.coalesce(F.sum("total").over(before), F.lit(0)) + F.col("peak")  # one row per range and scope
    return (sums.withColumn("high", high).groupBy("whole", "scope").agg(
        F.max("high").alias("peak_bytes"), F.min_by("peak_ts", F.struct(-F.col("high"), "part")).alias("peak_ts"))
        .where(F.col("peak_bytes") > 0).drop("whole"))


def end_balance(sums: DataFrame) -> DataFrame:
    """Balance of each scope after its last event, from :func:`balance_sums`."""
    return (sums.groupBy("whole", "scope").agg(F.sum("total").alias("end_bytes")).drop("whole")
            .withColumn("leak", F.col("end_bytes") > 0))


def counter_rows(trace: DataFrame) -> DataFrame:
    """Two counter events per allocation (device and total, MB); frees are ignored here."""
    name = F.coalesce("name", F.lit(""))
    allocs = trace.where(name.contains("[memory]") & F.coalesce(F.col("addr") != 0, F.lit(False))
                         & F.coalesce(F.col("bytes") != 0, F.lit(False)))
    allocs = allocs.select("event_index", "ts", F.coalesce("device", F.lit(-1)).alias("device"),
                           F.col("bytes").alias("delta"))
    ordered = with_pos(allocs, ["ts", "event_index"], "seq")
    dev = running_sum(ordered, "delta", "device_balance", pos_col="seq", partition_by=["device"])
    bal = running_sum(dev, "delta", "total_balance", pos_col="seq")
    rows = F.array(
        F.struct(F.concat(F.lit("Memory Usage ("), device_label("device"), F.lit(")")).alias("name"),
                 F.lit("Allocated (MB)").alias("arg"), (F.col("device_balance") / MIB).alias("value"),
                 F.lit(0).alias("k")),
        F.struct(F.lit("Total Memory Usage").alias("name"), F.lit("Total (MB)").alias("arg"),
                 (F.col("total_balance") / MIB).alias("value"), F.lit(1).alias("k")))
    return bal.select("seq", "ts", F.explode(rows).alias("c")).select(
        "seq", "ts", F.lit("C").alias("ph"), "c.name", "c.arg", "c.value", "c.k")


def with_counters(trace: DataFrame) -> DataFrame:
    """The trace with its generated counter events appended (two per allocation),
    numbered after the original events."""
    n = trace.agg(F.max("event_index")).first()[0]
    c = counter_rows(trace)
    extra = c.select((F.lit((n or 0) + 1) + F.col("seq") * 2 + F.col("k")).alias("event_index"), "ts",
                     F.lit(None).cast("double").alias("dur"), "name", F.lit("memory").alias("cat"), "ph",
                     F.create_map(F.col("arg"), F.col("value").cast("string")).alias("args"))
    return trace.unionByName(extra, allowMissingColumns=True)


# --- interval join ------------------------------------------------------------------
def active_ops(points: DataFrame, ops: DataFrame, min_dur: float, bucket: float = 1000.0) -> DataFrame:
    """Pairs (point, op) with ``start <= t <= end`` and ``end - start > min_dur``.

    An operation is filed under the level whose bucket width (``bucket`` times a
    power of two) is at least its length, so it touches two buckets at most; a
    point looks into its bucket of every level in use.  The result has every
    pair; :func:`activity` answers counts and the first operation without them.
    ``points``: ``pid, t``; ``ops``: ``op_index, start, end, op_name, op_cat``.
    """
    length = F.col("end") - F.col("start")
    level = F.ceil(F.log2(F.greatest(length / F.lit(float(bucket)), F.lit(1.0)))).cast("int")
    filed = ops.where(length > F.lit(float(min_dur))).withColumn("_level", level)
    levels = [r[0] for r in filed.select("_level").distinct().collect()]  # as many as bits of the longest length
    width = F.lit(float(bucket)) * F.pow(F.lit(2.0), F.col("_level"))
    filed = filed.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
    asked = (points.withColumn("_level", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>")))
             .withColumn("_b", F.floor(F.col("t") / width)))
    met = asked.join(filed, ["_level", "_b"]).where((F.col("start") <= F.col("t")) & (F.col("t") <= F.col("end")))
    return met.select("pid", "t", "op_index", "start", "end", "op_name", "op_cat")


def activity(points: DataFrame, ops: DataFrame, min_dur: float, wide_bits: int = 16) -> DataFrame:
    """``pid, n, first`` per point with an open operation longer than ``min_dur``: how many
    are open, and the one (``op_name``, ``op_cat``) that started first.

    One sweep in time order (starts, then points, then ends at equal times)
    gives the counts as a running sum, and the points' ranks that an operation
    spans.  A rank range splits into O(log n) aligned blocks, and the earliest
    operation of each block is an aggregate.  What the widest blocks say is pushed
    down to blocks of one size, ``2 ** wide_bits`` of them at most: their table
    (block, start, number of the operation) is broadcast.  A point asks its blocks
    of the sizes below through a shuffle join, whose keys hold a ``2 ** wide_bits``-th
    of the points at most.  Nothing grows with the number of operations open at once.
    """
    long_ = ops.where(F.col("end") - F.col("start") > F.lit(float(min_dur)))
    sweep = (long_.select(F.col("start").alias("t"), F.lit(0).alias("kind"), F.col("op_index").alias("id"))
             .unionByName(points.select("t", F.lit(1).alias("kind"), F.col("pid").alias("id")))
             .unionByName(long_.select(F.col("end").alias("t"), F.lit(2).alias("kind"), F.col("op_index").alias("id"))))
    sweep = with_pos(sweep, ["t", "kind", "id"], "_at").withColumn("_point", (F.col("kind") == 1).cast("long"))
    sweep = running_sum(sweep.withColumn("_open", F.lit(1) - F.col("kind")), "_open", "n", pos_col="_at")
    sweep = written(running_sum(sweep, "_point", "rank", pos_col="_at", inclusive=False).select(
        "t", "kind", "id", "rank", "n"), "sweep")
    asked = sweep.where("kind = 1 and n > 0").select(F.col("id").alias("pid"), "rank", "n")
    spans = (sweep.where("kind <> 1").groupBy(F.col("id").alias("op_index"))
             .agg(F.min("t").alias("start"), F.min("rank").alias("lo"), F.max("rank").alias("hi")).where("lo < hi"))
    top = max(1, int(sweep.where("kind = 1").count()).bit_length())

    def blocks(lv: Column) -> Column:
        size, wider = F.call_function("shiftleft", F.lit(1).cast("long"), lv), F.call_function(
            "shiftleft", F.lit(2).cast("long"), lv)
        a, b = F.ceil(F.col("lo") / size).cast("long"), F.floor(F.col("hi") / size).cast("long")
        wa, wb = F.ceil(F.col("lo") / wider).cast("long"), F.floor(F.col("hi") / wider).cast("long")
        ends = F.array(F.when(a < 2 * wa, a), F.when(b > 2 * wb, b - 1))
        inner = F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<long>"))
        return F.transform(F.when(wa < wb, ends).otherwise(inner), lambda i: F.struct(lv.alias("level"), i.alias("block")))
    cut = spans.select("op_index", "start", F.explode(F.flatten(F.transform(
        F.sequence(F.lit(0), F.lit(top)), blocks))).alias("p")).select("op_index", "start", "p.level", "p.block").where(
        F.col("block").isNotNull())
    earliest = cut.groupBy("level", "block").agg(F.min(F.struct("start", "op_index")).alias("first"))
    base = max(0, top - wide_bits)
    if base:
        earliest = written(earliest, "earliest")
    parts = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("level") - F.lit(base))
    wide = (earliest.where(F.col("level") >= base)
            .select("first", F.explode(F.sequence(F.col("block") * parts, F.col("block") * parts + parts - 1)).alias("block"))
            .groupBy("block").agg(F.min("first").alias("first")))
    found = asked.withColumn("block", F.shiftright("rank", base)).join(F.broadcast(wide), "block", "left").select(
        "pid", "n", "first")
    if base:
        looked = (asked.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(base - 1))))
                  .withColumn("block", F.call_function("shiftright", F.col("rank"), F.col("level"))))
        near = looked.join(earliest.where(F.col("level") < base), ["level", "block"]).select("pid", "n", "first")
        found = found.unionByName(near).groupBy("pid").agg(F.first("n").alias("n"), F.min("first").alias("first"))
    return (found.select("pid", "n", "first.op_index").join(long_, "op_index")
            .select("pid", "n", F.struct("start", "op_index", "op_name", "op_cat").alias("first")))


def operations(trace: DataFrame) -> DataFrame:
    ops = _complete(trace).where(F.col("dur") > 0)
    return ops.select(F.col("event_index").alias("op_index"), F.col("ts").alias("start"),
                      (F.col("ts") + F.col("dur")).alias("end"),
                      F.coalesce("name", F.lit("")).alias("op_name"), F.coalesce("cat", F.lit("")).alias("op_cat"))


def timeline(balance: DataFrame, trace: DataFrame, max_ops: int = 10, min_dur: float = 1000.0) -> DataFrame:
    """Timeline table (12 columns) with the operations active at each memory event
    (more than ``min_dur`` us long; count capped at ``max_ops``; top = earliest start)."""
    pts = balance.select(F.col("seq").alias("pid"), F.col("ts").alias("t"))
    act = activity(pts, operations(trace), min_dur).select(
        "pid", F.col("n").alias("_n"), F.col("first.op_name").alias("_top"), F.col("first.op_cat").alias("_cat"))
    t = balance.join(act, balance.seq == act.pid, "left")
    return t.select(
        "seq", F.col("ts").alias("timestamp_us"), (F.col("ts") / 1e6).alias("timestamp_sec"),
        F.col("total_balance").alias("memory_bytes"), (F.col("total_balance") / MIB).alias("memory_mb"),
        (F.col("total_balance") / (1024.0 * MIB)).alias("memory_gb"),
        device_label(F.coalesce("device", F.lit(-1))).alias("device"),
        (F.col("device_balance") / MIB).alias("device_memory_mb"), (F.col("delta") / MIB).alias("delta_mb"),
        F.substring("name", 1, 100).alias("operation"),
        F.least(F.coalesce("_n", F.lit(0)), F.lit(max_ops)).cast("int").alias("active_operations_count"),
        F.coalesce(F.substring("_top", 1, 100), F.lit("")).alias("top_active_op"),
        F.coalesce("_cat", F.lit("")).alias("top_active_cat"))


def peak_context(balance: DataFrame, trace: DataFrame, min_dur: float = 10000.0, first_n: int = 20,
                 per_cat: int = 5) -> DataFrame:
    """Operations covering the first total peak: first ``first_n`` by start, then
    up to ``per_cat`` names per category."""
    peak = balance.where(F.col("total_balance") > 0).agg(
        F.min_by("ts", F.struct(F.col("total_balance") * -1, "seq")).alias("t")).first()["t"]
    at = F.lit(peak).cast("double")  # null without a positive balance: no operations
    open_ = (F.col("start") <= at) & (at <= F.col("end")) & (F.col("end") - F.col("start") > F.lit(float(min_dur)))
    firsts = operations(trace).where(open_).orderBy("start", "op_index").limit(first_n)
    w = Window.partitionBy("op_cat").orderBy("start", "op_index")
    return (firsts.withColumn("rank_in_cat", F.row_number().over(w))
            .withColumn("ops_in_cat", F.count(F.lit(1)).over(Window.partitionBy("op_cat")))
            .where(F.col("rank_in_cat") <= per_cat)
            .select("op_cat", "rank_in_cat", "op_name", "start", "end", "ops_in_cat"))


def max_growth(tl: DataFrame) -> DataFrame:
    """Fastest growth between every (n div 100)-th timeline point (only when n > 100)."""
    n = tl.count()
    spark = tl.sparkSession
    if n <= 100:
        return spark.createDataFrame([], "rate_mb_per_sec double, from_sec double, to_sec double, "
                                         "from_mb double, to_mb double, top_active_op string")
    step = n // 100
    ordered = with_pos(tl.select("seq", "timestamp_sec", "memory_mb", "top_active_op"), ["seq"], "_p")
    sampled = ordered.where(F.pmod("_p", F.lit(step)) == 0)  # at most ~100 rows
    w = Window.orderBy("_p")
    s = (sampled.withColumn("_ps", F.lag("timestamp_sec").over(w)).withColumn("_pm", F.lag("memory_mb").over(w))
         .where(F.col("timestamp_sec") - F.col("_ps") > 0)
         .withColumn("rate", (F.col("memory_mb") - F.col("_pm")) / (F.col("timestamp_sec") - F.col("_ps")))
         .where(F.col("rate") > 0))
    best = s.orderBy(F.col("rate").desc(), "_p").limit(1)
    return best.select(F.col("rate").alias("rate_mb_per_sec"), F.col("_ps").alias("from_sec"),
                       F.col("timestamp_sec").alias("to_sec"), F.col("_pm").alias("from_mb"),
                       F.col("memory_mb").alias("to_mb"), "top_active_op")


def device_stats(tl: DataFrame) -> DataFrame:
    return tl.groupBy("device").agg(F.greatest(F.max("device_memory_mb"), F.lit(0.0)).alias("peak_mb"),
                                    F.avg("device_memory_mb").alias("avg_mb"), F.count(F.lit(1)).alias("samples"))
