"""Event-log queries (TRC, JON-3..5, SET-2, SRC-10, SRC-12) over ``events`` seen as a trace.

Fixed test mapping: event order = ``(ts, event_id)`` -> ``event_index``; ``ts`` in
microseconds; ``view`` / ``click`` are complete operations (``ph='X'``,
``dur = value * 1e6``; the name is a labelled section for six of forty user
classes, else the type and the class; the category has the type, one of twelve
classes, and ``gpu`` for every third user); ``purchase`` / ``signup`` allocate
(``[memory]``), ``error`` frees (``cudaFree`` or ``free``); address =
``user_id``, bytes = ``round(value * 1024)``, device = ``user_id % 3 - 1``.
Every event also emits a memory counter reading (``ph='C'``, name
``memory <type>``, arg ``k`` = ``props.k``, in MiB for purchases), appended
after the primary events.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import eventlog as ev
from ..operators.order import written, with_pos
from ..session import scratch_path
from ..sources.readers import latest_file, read_csv, read_trace
from ..sources.sinks import write_timeline
from .common import table
from .registry import query

_OPS = ("view", "click")
_ALLOC = ("purchase", "signup")
_FREE = "error"


def events_trace(spark: SparkSession, sf: str, indexed: bool = True):
    """The events as a trace; reports that never use ``event_index`` do without it, and without its sort."""
    e = table(spark, sf, "events")
    first = second = []
    if indexed:
        e = with_pos(e, ["ts", "event_id"], "event_index")
        first, second = ["event_index"], [(F.col("event_index") + F.lit(e.count())).alias("event_index")]
    et = F.col("event_type")
    is_op, is_alloc = et.isin(list(_OPS)), et.isin(list(_ALLOC))
    ts = F.unix_micros(F.col("ts").cast("timestamp")).cast("double")
    user = F.col("user_id")
    dev = user % 3 - 1
    k = F.get_json_object("props", "$.k")
    nbytes = F.round(F.col("value") * 1024).cast("long")
    mem_args = F.create_map(F.lit("Addr"), F.col("user_id").cast("string"), F.lit("Bytes"), nbytes.cast("string"),
                            F.lit("Device Id"), dev.cast("string"))
    primary = e.select(
        *first, ts.alias("ts"), F.when(is_op, F.col("value") * 1e6).alias("dur"),
        F.when(is_alloc, "[memory]").when(et == _FREE, F.when(user % 2 == 0, "cudaFree").otherwise("free"))
        .when(user % 40 < 6, F.element_at(F.array(*[F.lit(x) for x in ev.SECTION_NAMES]), (user % 40 + 1).cast("int")))
        .otherwise(F.concat_ws("_", et, (user % 40).cast("string"))).alias("name"),
        F.when(is_op, F.concat(F.when(user % 3 == 0, "gpu_").otherwise("cpu_"), et, F.lit("_"),
                               (user % 12).cast("string"))).otherwise("memory").alias("cat"),
        F.when(is_op, "X").otherwise("i").alias("ph"),
        F.when(is_op, F.create_map().cast("map<string,string>")).otherwise(mem_args).alias("args"),
        F.when(~is_op, F.col("user_id")).alias("addr"), F.when(~is_op, nbytes).alias("bytes"),
        F.when(~is_op, dev).alias("device"))
    counters = e.select(
        *second, ts.alias("ts"), F.lit(None).cast("double").alias("dur"),
        F.concat(F.lit("memory "), et).alias("name"), F.lit("counter").alias("cat"), F.lit("C").alias("ph"),
        F.create_map(F.lit("k"), F.when(et == "purchase", (k.cast("long") * ev.MIB).cast("string")).otherwise(k))
        .alias("args"),
        F.lit(None).cast("long").alias("addr"), F.lit(None).cast("long").alias("bytes"),
        F.lit(None).cast("long").alias("device"))
    return primary.unionByName(counters)


_SQL_TRACE = """
ev AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS event_index, CAST(epoch_us(ts) AS DOUBLE) AS ts,
              event_type, value, user_id, props FROM events),
tr AS (SELECT event_index, ts, CASE WHEN event_type IN ('view', 'click') THEN value * 1e6 END AS dur,
              CASE WHEN event_type IN ('purchase', 'signup') THEN '[memory]'
                   WHEN event_type = 'error' THEN CASE WHEN user_id % 2 = 0 THEN 'cudaFree' ELSE 'free' END
                   WHEN user_id % 40 < 6 THEN ['data_loading', 'forward', 'loss_computation', 'backward',
                                               'gradient_clipping', 'optimizer_step'][user_id % 40 + 1]
                   ELSE event_type || '_' || (user_id % 40) END AS name,
              CASE WHEN event_type NOT IN ('view', 'click') THEN 'memory'
                   ELSE CASE WHEN user_id % 3 = 0 THEN 'gpu_' ELSE 'cpu_' END || event_type || '_' || (user_id % 12) END
                   AS cat,
              CASE WHEN event_type IN ('view', 'click') THEN 'X' ELSE 'i' END AS ph,
              CASE WHEN event_type NOT IN ('view', 'click') THEN user_id END AS addr,
              CASE WHEN event_type NOT IN ('view', 'click') THEN CAST(round(value * 1024) AS BIGINT) END AS bytes,
              CASE WHEN event_type NOT IN ('view', 'click') THEN user_id % 3 - 1 END AS device,
              NULL AS k
       FROM ev
       UNION ALL
       SELECT event_index + (SELECT count(*) FROM ev), ts, NULL, 'memory ' || event_type, 'counter', 'C',
              NULL, NULL, NULL, CASE WHEN event_type = 'purchase'
                  THEN CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) * 1048576 AS VARCHAR)
                  ELSE json_extract_string(props, '$.k') END FROM ev)"""

_SQL_BAL = """
mem AS (SELECT event_index, ts, name, addr, bytes, device,
               CASE WHEN contains(name, '[memory]') THEN 'alloc' ELSE 'free' END AS kind FROM tr
        WHERE (contains(name, '[memory]') AND addr <> 0 AND bytes <> 0)
           OR ((contains(lower(name), 'free') OR contains(lower(name), 'dealloc')) AND addr <> 0)),
lagged AS (SELECT *, lag(kind) OVER w AS pk, lag(bytes) OVER w AS pb, lag(device) OVER w AS pd FROM mem
           WINDOW w AS (PARTITION BY addr ORDER BY event_index)),
deltas AS (SELECT event_index, ts, name, addr, kind, CASE WHEN kind = 'alloc' THEN bytes ELSE -pb END AS delta,
                  CASE WHEN kind = 'alloc' THEN device ELSE pd END AS device
           FROM lagged WHERE kind = 'alloc' OR pk = 'alloc'),
bal AS (SELECT *, row_number() OVER (ORDER BY ts, event_index) - 1 AS seq FROM deltas),
bal2 AS (SELECT *, CAST(sum(delta) OVER (PARTITION BY device ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT)
                   AS device_balance,
                CAST(sum(delta) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total_balance FROM bal)"""


def _w(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


def _r(c, name):
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name)


def _balance(trace):
    return written(ev.running_balance(ev.memory_deltas(trace)))


@query("scan_trace", _w(_SQL_TRACE) + """
SELECT name, ph, cat, ts, dur, CAST(addr AS VARCHAR) AS addr FROM tr""")
def scan_trace(spark: SparkSession, sf: str):
    """Trace files (``{"traceEvents": [...]}``, one bounded file per hash bucket) read back."""
    t = events_trace(spark, sf)
    n_files = max(1, -(-t.count() // 20000))
    obj = (t.withColumn("_f", F.pmod(F.col("event_index"), F.lit(n_files)))
           .groupBy("_f").agg(F.to_json(F.struct(F.collect_list(
               F.struct("name", "ph", "cat", "ts", "dur", "args")).alias("traceEvents"))).alias("value")))
    path = scratch_path(spark, "trace")
    obj.write.mode("overwrite").partitionBy("_f").text(path)
    back = read_trace(spark, path)
    return back.select("name", "ph", "cat", "ts", "dur", F.element_at("args", F.lit("Addr")).alias("addr"))


@query("trace_categories", _w(_SQL_TRACE) + """
SELECT cat, count(*) AS count, round(sum(coalesce(dur, 0)), 6) AS total_dur,
       round(sum(coalesce(dur, 0)) / count(*), 6) AS avg_dur
FROM tr WHERE ph = 'X' GROUP BY cat ORDER BY sum(coalesce(dur, 0)) DESC, cat LIMIT 20""")
def trace_categories(spark: SparkSession, sf: str):
    c = ev.category_summary(events_trace(spark, sf, indexed=False))
    return c.select("cat", "count", _r("total_dur", "total_dur"), _r("avg_dur", "avg_dur"))


_SQL_OPS = """
ops AS (SELECT name, count(*) AS count, sum(dur) AS total_dur, sum(dur) / count(*) AS avg_dur
        FROM tr WHERE ph = 'X' AND dur > 0 GROUP BY name)"""


@query("trace_top_total", _w(_SQL_TRACE, _SQL_OPS) + """
SELECT name, count, round(total_dur, 6) AS total_dur, round(avg_dur, 6) AS avg_dur FROM ops
ORDER BY total_dur DESC, name LIMIT 20""")
def trace_top_total(spark: SparkSession, sf: str):
    t = ev.top_total(events_trace(spark, sf, indexed=False))
    return t.select("name", "count", _r("total_dur", "total_dur"), _r("avg_dur", "avg_dur"))


@query("trace_top_avg", _w(_SQL_TRACE, _SQL_OPS) + """
SELECT name, count, round(total_dur, 6) AS total_dur, round(avg_dur, 6) AS avg_dur FROM ops
ORDER BY avg_dur DESC, name LIMIT 20""")
def trace_top_avg(spark: SparkSession, sf: str):
    t = ev.top_avg(events_trace(spark, sf, indexed=False))
    return t.select("name", "count", _r("total_dur", "total_dur"), _r("avg_dur", "avg_dur"))


@query("trace_sections", _w(_SQL_TRACE, _SQL_OPS) + f"""
SELECT name, count, round(total_dur, 6) AS total_dur, round(avg_dur, 6) AS avg_dur FROM ops
WHERE name IN ({", ".join(f"'{s}'" for s in ev.SECTION_NAMES)})""")
def trace_sections(spark: SparkSession, sf: str):
    t = ev.sections(events_trace(spark, sf, indexed=False))
    return t.select("name", "count", _r("total_dur", "total_dur"), _r("avg_dur", "avg_dur"))


@query("trace_device_class", _w(_SQL_TRACE) + """
SELECT CASE WHEN contains(lower(cat), 'cuda') OR contains(lower(cat), 'gpu') THEN 'GPU' ELSE 'CPU' END
       AS device_class, count(*) AS count, round(sum(dur), 6) AS total_dur
FROM tr WHERE ph = 'X' AND dur > 0 GROUP BY 1""")
def trace_device_class(spark: SparkSession, sf: str):
    d = ev.device_class(events_trace(spark, sf, indexed=False))
    return d.select("device_class", "count", _r("total_dur", "total_dur"))


@query("trace_mem_classes", _w(_SQL_TRACE) + """
SELECT count(*) FILTER (WHERE (contains(name, '[memory]') OR contains(name, 'cudaMalloc')
                               OR contains(name, 'Allocated')) AND addr IS NOT NULL) AS allocations,
       count(*) FILTER (WHERE contains(name, 'cudaFree') OR contains(name, 'Freed')) AS frees,
       count(*) FILTER (WHERE ph = 'C' AND contains(lower(name), 'memory')) AS snapshots FROM tr""")
def trace_mem_classes(spark: SparkSession, sf: str):
    return ev.memory_classes(events_trace(spark, sf, indexed=False))


_SQL_ALLOCS = """
allocs AS (SELECT event_index, name, CAST(bytes AS DOUBLE) AS size, CAST(device AS VARCHAR) AS device FROM tr
           WHERE (contains(name, '[memory]') OR contains(name, 'cudaMalloc') OR contains(name, 'Allocated'))
             AND addr IS NOT NULL AND bytes > 0)"""


@query("trace_large_allocs", _w(_SQL_TRACE, _SQL_ALLOCS) + """
SELECT event_index, name, size, device FROM allocs ORDER BY size DESC, event_index LIMIT 20""")
def trace_large_allocs(spark: SparkSession, sf: str):
    return ev.largest_allocations(events_trace(spark, sf))


@query("trace_alloc_total", _w(_SQL_TRACE, _SQL_ALLOCS) + """
SELECT sum(size) AS total_bytes, count(*) AS allocations FROM allocs""")
def trace_alloc_total(spark: SparkSession, sf: str):
    return ev.allocation_total(events_trace(spark, sf, indexed=False))


@query("gauge_stats", _w(_SQL_TRACE) + """
SELECT name, lo / scale AS min, round(mid / scale, 6) AS avg, hi / scale AS max, samples,
       CASE WHEN scale > 1 THEN 'MB' ELSE 'bytes' END AS unit
FROM (SELECT name, min(x) AS lo, avg(x) AS mid, max(x) AS hi, count(*) AS samples,
             CASE WHEN max(x) > 1048576 THEN 1048576.0::DOUBLE ELSE 1.0::DOUBLE END AS scale
      FROM (SELECT name, TRY_CAST(k AS DOUBLE) AS x FROM tr WHERE ph = 'C' AND contains(lower(name), 'memory'))
      WHERE x IS NOT NULL GROUP BY name)""")
def gauge_stats(spark: SparkSession, sf: str):
    g = ev.gauge_stats(events_trace(spark, sf, indexed=False))
    return g.select("name", "min", _r("avg", "avg"), "max", "samples", "unit")


@query("match_frees", _w(_SQL_TRACE, _SQL_BAL) + """
SELECT event_index, addr, delta, device FROM deltas WHERE kind = 'free'""")
def match_frees(spark: SparkSession, sf: str):
    d = ev.memory_deltas(events_trace(spark, sf))
    return d.where(F.col("kind") == "free").select("event_index", "addr", "delta", "device")


@query("running_balance", _w(_SQL_TRACE, _SQL_BAL) + """
SELECT seq, event_index, device, delta, device_balance, total_balance FROM bal2""")
def running_balance(spark: SparkSession, sf: str):
    return _balance(events_trace(spark, sf)).select("seq", "event_index", "device", "delta", "device_balance", "total_balance")


@query("peak_balance", _w(_SQL_TRACE, _SQL_BAL) + """
SELECT CAST(device AS VARCHAR) AS scope, max(device_balance) AS peak_bytes,
       arg_min(ts, (-device_balance, seq)) AS peak_ts FROM bal2 GROUP BY device HAVING max(device_balance) > 0
UNION ALL
SELECT 'total', max(total_balance), arg_min(ts, (-total_balance, seq)) FROM bal2 HAVING max(total_balance) > 0""")
def peak_balance(spark: SparkSession, sf: str):
    return ev.peaks(ev.balance_sums(ev.memory_deltas(events_trace(spark, sf))))


@query("end_balance", _w(_SQL_TRACE, _SQL_BAL) + """
SELECT CAST(device AS VARCHAR) AS scope, arg_max(device_balance, seq) AS end_bytes,
       arg_max(device_balance, seq) > 0 AS leak FROM bal2 GROUP BY device
UNION ALL
SELECT 'total', arg_max(total_balance, seq), arg_max(total_balance, seq) > 0 FROM bal2""")
def end_balance(spark: SparkSession, sf: str):
    return ev.end_balance(ev.balance_sums(ev.memory_deltas(events_trace(spark, sf))))


@query("mem_counters", _w(_SQL_TRACE) + """
, a AS (SELECT event_index, ts, coalesce(device, -1) AS device, bytes AS delta FROM tr
        WHERE contains(name, '[memory]') AND addr <> 0 AND bytes <> 0),
b AS (SELECT *, row_number() OVER (ORDER BY ts, event_index) - 1 AS seq FROM a),
c AS (SELECT *, sum(delta) OVER (PARTITION BY device ORDER BY seq ROWS UNBOUNDED PRECEDING) AS db,
             sum(delta) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) AS tb FROM b)
SELECT seq, 'Memory Usage (' || CASE WHEN device = -1 THEN 'CPU' ELSE 'GPU_' || device END || ')' AS name,
       round(db / 1048576, 6) AS value FROM c
UNION ALL SELECT seq, 'Total Memory Usage', round(tb / 1048576, 6) FROM c""")
def mem_counters(spark: SparkSession, sf: str):
    c = ev.counter_rows(events_trace(spark, sf))
    return c.select("seq", "name", _r("value", "value"))


_SQL_TL = """
ops AS (SELECT event_index AS op_index, ts AS start, ts + dur AS "end", name AS op_name, cat AS op_cat
        FROM tr WHERE ph = 'X' AND dur > 0),
act AS (SELECT b.seq, count(*) AS n, arg_min(o.op_name, (o.start, o.op_index)) AS top,
               arg_min(o.op_cat, (o.start, o.op_index)) AS tcat
        FROM bal2 b JOIN ops o ON o.start <= b.ts AND b.ts <= o."end" AND o."end" - o.start > 1000 GROUP BY b.seq),
tl AS (SELECT b.seq, b.ts AS timestamp_us, b.ts / 1e6 AS timestamp_sec, b.total_balance AS memory_bytes,
              b.total_balance / 1048576 AS memory_mb, b.total_balance / (1024.0 * 1048576) AS memory_gb,
              CASE WHEN coalesce(b.device, -1) = -1 THEN 'CPU' ELSE 'GPU_' || b.device END AS device,
              b.device_balance / 1048576 AS device_memory_mb, b.delta / 1048576 AS delta_mb,
              substr(b.name, 1, 100) AS operation, CAST(least(coalesce(a.n, 0), 10) AS INTEGER)
              AS active_operations_count, coalesce(substr(a.top, 1, 100), '') AS top_active_op,
              coalesce(a.tcat, '') AS top_active_cat
       FROM bal2 b LEFT JOIN act a USING (seq))"""


def _timeline(spark, sf):
    trace = events_trace(spark, sf)  # numbered once for both sides
    return written(ev.timeline(_balance(trace), trace))


@query("mem_timeline", _w(_SQL_TRACE, _SQL_BAL, _SQL_TL) + " SELECT * FROM tl")
def mem_timeline(spark: SparkSession, sf: str):
    return _timeline(spark, sf)


@query("timeline_csv", _w(_SQL_TRACE, _SQL_BAL, _SQL_TL) + """
SELECT seq, memory_bytes, device, operation, active_operations_count, top_active_op, top_active_cat FROM tl""")
def timeline_csv(spark: SparkSession, sf: str):
    """The timeline as a CSV report, read back."""
    path = scratch_path(spark, "timeline-csv")
    write_timeline(_timeline(spark, sf), path)
    back = read_csv(spark, path, "seq long, timestamp_us double, timestamp_sec double, memory_bytes long, "
                    "memory_mb double, memory_gb double, device string, device_memory_mb double, delta_mb double, "
                    "operation string, active_operations_count int, top_active_op string, top_active_cat string")
    return back.select("seq", "memory_bytes", "device", "operation", "active_operations_count",
                       F.coalesce("top_active_op", F.lit("")).alias("top_active_op"),
                       F.coalesce("top_active_cat", F.lit("")).alias("top_active_cat"))


@query("active_ops", _w(_SQL_TRACE, _SQL_BAL, _SQL_TL) + """
SELECT seq, active_operations_count, top_active_op, top_active_cat FROM tl""")
def active_ops_q(spark: SparkSession, sf: str):
    return _timeline(spark, sf).select("seq", "active_operations_count", "top_active_op", "top_active_cat")


@query("active_ops_at_peak", _w(_SQL_TRACE, _SQL_BAL) + """
, pk AS (SELECT arg_min(seq, (-total_balance, seq)) AS seq, arg_min(ts, (-total_balance, seq)) AS ts
         FROM bal2 WHERE total_balance > 0),
o AS (SELECT event_index AS op_index, ts AS start, ts + dur AS "end", name AS op_name, cat AS op_cat
      FROM tr WHERE ph = 'X' AND dur > 10000),
f AS (SELECT o.* FROM o, pk WHERE o.start <= pk.ts AND pk.ts <= o."end" ORDER BY o.start, o.op_index LIMIT 20),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY op_cat ORDER BY start, op_index) AS INTEGER) AS rank_in_cat,
             count(*) OVER (PARTITION BY op_cat) AS ops_in_cat FROM f)
SELECT op_cat, rank_in_cat, op_name, start, "end", ops_in_cat FROM r WHERE rank_in_cat <= 5""")
def active_ops_at_peak(spark: SparkSession, sf: str):
    trace = events_trace(spark, sf)
    return ev.peak_context(_balance(trace), trace)


@query("max_growth", _w(_SQL_TRACE, _SQL_BAL, _SQL_TL) + """
, s AS (SELECT * FROM tl WHERE (SELECT count(*) FROM tl) > 100 AND seq % ((SELECT count(*) FROM tl) // 100) = 0),
g AS (SELECT *, lag(timestamp_sec) OVER (ORDER BY seq) AS ps, lag(memory_mb) OVER (ORDER BY seq) AS pm FROM s),
r AS (SELECT *, (memory_mb - pm) / (timestamp_sec - ps) AS rate FROM g WHERE timestamp_sec - ps > 0)
SELECT round(rate, 6) AS rate_mb_per_sec, ps AS from_sec, timestamp_sec AS to_sec, pm AS from_mb, memory_mb AS to_mb,
       top_active_op FROM r WHERE rate > 0 ORDER BY rate DESC, seq LIMIT 1""")
def max_growth(spark: SparkSession, sf: str):
    g = ev.max_growth(_timeline(spark, sf))
    return g.select(_r("rate_mb_per_sec", "rate_mb_per_sec"), "from_sec", "to_sec", "from_mb", "to_mb",
                    "top_active_op")


@query("device_stats", _w(_SQL_TRACE, _SQL_BAL, _SQL_TL) + """
SELECT device, greatest(max(device_memory_mb), 0) AS peak_mb, round(avg(device_memory_mb), 6) AS avg_mb,
       count(*) AS samples FROM tl GROUP BY device""")
def device_stats(spark: SparkSession, sf: str):
    d = ev.device_stats(_timeline(spark, sf))
    return d.select("device", "peak_mb", _r("avg_mb", "avg_mb"), "samples")


@query("trace_with_counters", _w(_SQL_TRACE) + """
, a AS (SELECT count(*) AS n FROM tr WHERE contains(name, '[memory]') AND addr <> 0 AND bytes <> 0)
SELECT ph, count(*) AS events FROM (SELECT ph FROM tr UNION ALL
  SELECT 'C' FROM tr, (SELECT unnest([1, 2])) t(x) WHERE contains(name, '[memory]') AND addr <> 0 AND bytes <> 0)
GROUP BY ph""")
def trace_with_counters(spark: SparkSession, sf: str):
    t = ev.with_counters(events_trace(spark, sf))
    return t.groupBy("ph").agg(F.count(F.lit(1)).alias("events"))


@query("latest_file", _w(_SQL_TRACE) + " SELECT 'run_b.json' AS file, count(*) AS events FROM tr")
def latest_file_q(spark: SparkSession, sf: str):
    """Newest trace among several written ones (derived ``_with_memory`` names excluded), and its events."""
    base = scratch_path(spark, "traces")
    t = events_trace(spark, sf).select("event_index", "name", "ts")
    for name in ("run_a.json", "run_b.json", "run_b_with_memory.json"):
        t.where(F.lit(name != "run_a.json") | (F.col("event_index") % 2 == 0)).write.mode("overwrite").json(f"{base}/{name}")
    folder = F.element_at(F.split("path", "/"), -2)
    newest = latest_file(spark, f"{base}/*/*.json").select(folder.alias("file")).first()["file"]
    rows = spark.read.schema("event_index long").json(f"{base}/{newest}")
    return rows.agg(F.count(F.lit(1)).alias("events")).select(F.lit(newest).alias("file"), "events")
