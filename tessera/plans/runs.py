"""Run-log queries (MET, EVA, INF, RNK, JON-1, JON-7, SRC-9, SNK-5, SNK-6).

Test mapping over ``events`` (fixed for every query here):
series = ``event_type``; order = ``(ts, event_id)``; loss = ``value / 100``;
tokens seen = ``user_id``; batch = ``event_id``; recorded vs current loss = first
vs last point of a user.  Wide metric log: validation loss on ``error`` events,
train loss on the others.  Ranking: group = ``user_id``, item = ``event_id``,
score = ``value``.  Inference: prompts = user turns of ``conversations`` in
``(conv_id, turn)`` order, reply = the next turn of the conversation.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.text import pretoken_count
from ..operators import runlog as rl
from ..operators.order import rolling, with_group_pos, with_pos
from ..session import scratch_path
from ..sources.readers import read_csv, read_metrics
from ..sources.sinks import write_inference, write_metrics
from .common import SQL_PRETOK, table
from .registry import query

ORDER = ["ts", "event_id"]
LAST = 100
TOPK = 3
TOP_P = 0.9
TEMP = 10.0
PENALTY = 1.2
SAMPLES = 2
RUN_TS = "2024-02-01T00:00:00"
INF_PARAMS = dict(temperature=0.8, top_k=50, top_p=0.95, max_tokens=200, repetition_penalty=1.1)


def _points(spark: SparkSession, sf: str):
    e = table(spark, sf, "events")
    return e.select(F.col("event_type").alias("series"), "ts", "event_id",
                    F.col("event_id").alias("batch"), F.col("user_id").alias("tokens_seen"),
                    (F.col("value") / 100).alias("loss"))


def _r(c, name=None):
    return F.round(c if not isinstance(c, str) else F.col(c), 6).alias(name or (c if isinstance(c, str) else None))


@query("metrics_points", """
SELECT event_type AS series, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS step,
       event_id AS batch, user_id AS tokens_seen, value / 100 AS loss FROM events""")
def metrics_points(spark: SparkSession, sf: str):
    p = with_group_pos(_points(spark, sf), ["series"], ORDER, "step")
    return p.select("series", "step", "batch", "tokens_seen", "loss")


@query("best_loss", "SELECT event_type AS series, min(value / 100) AS best FROM events GROUP BY 1")
def best_loss(spark: SparkSession, sf: str):
    return rl.best_value(_points(spark, sf), ["series"], "loss")


@query("current_loss", """
SELECT event_type AS series, arg_max(value / 100, (ts, event_id)) AS current FROM events GROUP BY 1""")
def current_loss(spark: SparkSession, sf: str):
    return rl.current_value(_points(spark, sf), ["series"], "loss", ORDER)


@query("last_n_points", f"""
SELECT series, batch FROM (SELECT event_type AS series, event_id AS batch,
  row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events)
WHERE rn <= {rl.WINDOW_SIZE}""")
def last_n_points(spark: SparkSession, sf: str):
    return rl.last_n(_points(spark, sf), ["series"], ORDER, rl.WINDOW_SIZE, "loss").select("series", "batch")


@query("avg_last_n", f"""
SELECT series, round(avg(loss), 6) AS avg FROM (SELECT event_type AS series, value / 100 AS loss,
  row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events)
WHERE rn <= {LAST} GROUP BY series""")
def avg_last_n(spark: SparkSession, sf: str):
    a = rl.avg_last(_points(spark, sf), ["series"], "loss", ORDER, last=LAST)
    return a.select("series", _r("avg"))


@query("metric_stats", f"""
WITH p AS (SELECT event_type AS series, event_id AS batch, user_id AS tokens_seen, value / 100 AS loss, ts, event_id,
                  row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events)
SELECT series, max(batch) AS max_batch, max(tokens_seen) AS max_tokens, count(loss) AS points,
       min(loss) AS best, arg_max(loss, (ts, event_id)) AS current,
       round(avg(loss) FILTER (WHERE rn <= {rl.WINDOW_SIZE}), 6) AS avg_window,
       round(avg(loss) FILTER (WHERE rn <= {LAST}), 6) AS avg_last
FROM p GROUP BY series""")
def metric_stats(spark: SparkSession, sf: str):
    s = rl.metric_stats(_points(spark, sf), ["series"], "loss", ORDER, "batch", "tokens_seen", last=LAST)
    return s.select("series", "max_batch", "max_tokens", "points", "best", "current",
                    _r("avg_window"), _r("avg_last"))


# --- metric log files ------------------------------------------------------------------------
_SQL_METRICS = """
SELECT event_id AS batch, user_id AS tokens_seen,
       CASE WHEN event_type <> 'error' THEN value / 100 END AS train_loss,
       CASE WHEN event_type = 'error' THEN value / 100 END AS val_loss,
       0.001::DOUBLE AS learning_rate, epoch_us(ts) / 1e6 AS timestamp FROM events"""


def _metric_log(spark: SparkSession, sf: str):
    e = table(spark, sf, "events")
    return e.select(F.col("event_id").alias("batch"), F.col("user_id").alias("tokens_seen"),
                    F.when(F.col("event_type") != "error", F.col("value") / 100).alias("train_loss"),
                    F.when(F.col("event_type") == "error", F.col("value") / 100).alias("val_loss"),
                    F.lit(0.001).alias("learning_rate"),
                    (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("timestamp"))


@query("scan_metrics", _SQL_METRICS)
def scan_metrics(spark: SparkSession, sf: str):
    path = scratch_path(spark, "metrics")
    write_metrics(_metric_log(spark, sf), path, "overwrite")
    return read_metrics(spark, path)


@query("metrics_append", _SQL_METRICS)
def metrics_append(spark: SparkSession, sf: str):
    """Metric log written in two sessions (the second appends on resume), read back whole."""
    log = _metric_log(spark, sf)
    path = scratch_path(spark, "metrics-append")
    write_metrics(log.where(F.col("batch") % 2 == 0), path)
    write_metrics(log.where(F.col("batch") % 2 == 1), path)
    return read_metrics(spark, path)


@query("rolling_timing", f"""
SELECT event_id, event_type AS category, round(1000 * avg(value) OVER (PARTITION BY event_type
       ORDER BY ts, event_id ROWS BETWEEN {rl.TIMING_WINDOW - 1} PRECEDING AND CURRENT ROW), 6) AS rolling_ms
FROM events WHERE value > 0""")
def rolling_timing(spark: SparkSession, sf: str):
    e = table(spark, sf, "events").where(F.col("value") > 0).select("event_id", "ts", "event_type", "value")
    g = with_group_pos(e, ["event_type"], ORDER, "gpos")
    r = rolling(g, ["event_type"], "gpos", "value", rl.TIMING_WINDOW, "rolling")
    return r.select("event_id", F.col("event_type").alias("category"), _r(F.col("rolling") * 1000, "rolling_ms"))


# step timing: step = user, categories = event types; compute-only excludes the
# validation / inference / checkpoint / metrics categories (fixed mapping)
_TIMING_EXCLUDED = ("view", "click", "purchase", "signup")


@query("compute_only", f"""
SELECT user_id AS step, round(sum(value), 6) AS total,
       round(sum(value) - coalesce(sum(value) FILTER (WHERE event_type IN
             ({", ".join(f"'{c}'" for c in _TIMING_EXCLUDED)})), 0), 6) AS compute_only
FROM events GROUP BY user_id""")
def compute_only(spark: SparkSession, sf: str):
    e = table(spark, sf, "events")
    excl = F.when(F.col("event_type").isin(list(_TIMING_EXCLUDED)), F.col("value"))
    agg = e.groupBy(F.col("user_id").alias("step")).agg(F.sum("value").alias("t"),
                                                        F.coalesce(F.sum(excl), F.lit(0.0)).alias("x"))
    co = F.col("t") - F.col("x")
    return agg.select("step", _r("t", "total"), _r(co, "compute_only"))


# Event types as timing categories (fixed mapping): view = whole step, click = compute, purchase and error = its
# parts, signup = metrics, outside of compute.
_TIMING = {"total": "view", "compute": "click", "parts": ["purchase", "error"], "outside": ["signup"]}


@query("timing_breakdown", f"""
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS i
           FROM events WHERE value > 0),
m AS (SELECT event_type AS c, 1000 * avg(value) AS ms FROM r WHERE i <= {rl.TIMING_WINDOW} GROUP BY 1),
s AS (SELECT coalesce(sum(ms) FILTER (WHERE c = 'view'), 0) AS total, coalesce(sum(ms) FILTER (WHERE c = 'click'), 0)
             AS compute, coalesce(sum(ms) FILTER (WHERE c IN ('purchase', 'error')), 0) AS parts,
             coalesce(sum(ms) FILTER (WHERE c = 'signup'), 0) AS outside FROM m)
SELECT round(total, 6) AS total, round(compute, 6) AS compute,
       round(CASE WHEN compute > parts THEN compute - parts ELSE 0 END, 6) AS other,
       round(CASE WHEN total > parts + outside THEN total - (parts + outside) ELSE 0 END, 6) AS overhead FROM s""")
def timing_breakdown(spark: SparkSession, sf: str):
    recent = rl.recent_timing(table(spark, sf, "events"), "event_type", "value", ORDER)
    out = rl.timing_breakdown(recent, "event_type", **_TIMING)
    return out.select(*[_r(c) for c in ("total", "compute", "other", "overhead")])


@query("throughput", """
WITH s AS (SELECT user_id, min(epoch_us(ts) / 1e6) AS t0 FROM events GROUP BY user_id),
p AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t,
             100 * row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS tokens FROM events)
SELECT event_id, round(CASE WHEN t > t0 THEN (tokens - 100) / (t - t0) ELSE 0 END, 6) AS tokens_per_sec
FROM p JOIN s USING (user_id)""")
def throughput(spark: SparkSession, sf: str):
    """A session per user, 100 tokens per event: tokens a second since the session's first event."""
    e = table(spark, sf, "events").select("event_id", "user_id", "ts")
    p = with_group_pos(e, ["user_id"], ORDER, "n").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    start = p.groupBy("user_id").agg(F.min("t").alias("t0"))
    rate = rl.throughput((F.col("n") + 1) * 100, "t", F.lit(100), F.col("t0"))
    return p.join(start, "user_id").select("event_id", _r(rate, "tokens_per_sec"))


# --- evaluation ---------------------------------------------------------------------------------
def _batches(spark, sf):
    # losses summed exactly (values carry two decimals), then one double division
    e = table(spark, sf, "events")
    return e.groupBy(F.col("user_id").alias("batch_id")).agg(
        (F.sum(F.col("value").cast("decimal(20,2)")).cast("double") / 100).alias("loss_sum"),
        F.count(F.when(F.col("event_type") == "purchase", 1)).alias("n_tokens"))


_SQL_BATCHES = """
b AS (SELECT user_id AS batch_id, CAST(sum(CAST(value AS DECIMAL(20,2))) AS DOUBLE) / 100 AS loss_sum,
             count(*) FILTER (WHERE event_type = 'purchase') AS n_tokens FROM events GROUP BY user_id)"""


@query("weighted_loss", f"""
WITH {_SQL_BATCHES}
SELECT round(coalesce(sum(loss_sum) / nullif(sum(n_tokens), 0), 0), 6) AS loss,
       CAST(sum(n_tokens) AS BIGINT) AS total_tokens, count(*) AS num_batches,
       round(exp(coalesce(sum(loss_sum) / nullif(sum(n_tokens), 0), 0)), 6) AS perplexity FROM b""")
def weighted_loss(spark: SparkSession, sf: str):
    w = rl.weighted_loss(_batches(spark, sf))
    return w.select(_r("loss"), "total_tokens", "num_batches", _r("perplexity"))


@query("batch_losses", f"""
WITH {_SQL_BATCHES}
SELECT batch_id, CASE WHEN n_tokens > 0 THEN loss_sum / n_tokens ELSE 0 END AS batch_loss FROM b""")
def batch_losses(spark: SparkSession, sf: str):
    b = _batches(spark, sf)
    return b.select("batch_id", rl.batch_losses(b).alias("batch_loss"))


@query("mean_finite_loss", """
SELECT round(avg(m), 6) AS mean_loss, count(*) AS finite_points FROM (
  SELECT avg(value / 100) AS m FROM events GROUP BY user_id) WHERE isfinite(m)""")
def mean_finite_loss(spark: SparkSession, sf: str):
    means = table(spark, sf, "events").groupBy("user_id").agg(F.avg(F.col("value") / 100).alias("m"))
    r = rl.mean_finite(means, "m")
    return r.select(_r("mean_loss"), "finite_points")


@query("loss_compare", """
WITH f AS (SELECT user_id, arg_min(value / 100, (ts, event_id)) AS recorded,
                  arg_max(value / 100, (ts, event_id)) AS current FROM events GROUP BY user_id),
d AS (SELECT *, current - recorded AS difference,
             CASE WHEN recorded > 0 THEN (current - recorded) / recorded * 100 ELSE 0 END AS pct FROM f)
SELECT user_id, recorded, current, round(difference, 6) AS difference, round(pct, 6) AS percent_change,
       CASE WHEN abs(pct) < 1 THEN 'very_close' WHEN abs(pct) < 5 THEN 'small'
            WHEN abs(pct) < 20 THEN 'moderate' ELSE 'large' END AS verdict FROM d""")
def loss_compare(spark: SparkSession, sf: str):
    p = _points(spark, sf)
    key = F.struct(*ORDER)
    j = p.groupBy(F.col("tokens_seen").alias("user_id")).agg(  # both sides of a key in one aggregate
        F.min_by("loss", key).alias("recorded"), F.max_by("loss", key).alias("current"))
    diff, pct, verdict = rl.compare_loss("recorded", "current")
    return j.select("user_id", "recorded", "current", _r(diff, "difference"), _r(pct, "percent_change"), verdict)


# --- inference results ------------------------------------------------------------------------
_SQL_PROMPTS = """
pr AS (SELECT conv_id, turn, text AS prompt, row_number() OVER (ORDER BY conv_id, turn) - 1 AS prompt_idx
       FROM conversations WHERE role = 'user'),
grid AS (SELECT pr.*, s.sample_idx FROM pr, (SELECT unnest(range(2)) AS sample_idx) s),
res AS (SELECT g.prompt_idx * 2 + g.sample_idx + 1 AS inference_num, CAST(g.prompt_idx AS INTEGER) AS prompt_idx,
               CAST(g.sample_idx AS INTEGER) AS sample_idx, g.prompt,
               coalesce(r.text, '[Generation failed: no reply]') AS generated_text,
               CAST(CASE WHEN r.text IS NULL THEN 0 ELSE len(regexp_extract_all(r.text, '""" + \
    SQL_PRETOK.split("'")[1] + """')) END AS INTEGER) AS token_count,
               g.turn * 0.5::DOUBLE + g.sample_idx * 0.25::DOUBLE AS generation_time
        FROM grid g LEFT JOIN conversations r ON r.conv_id = g.conv_id AND r.turn = g.turn + 1)"""

_SQL_INF = f"""
SELECT inference_num, prompt_idx, sample_idx, prompt, generated_text, token_count, generation_time,
       round(CASE WHEN generation_time > 0 THEN token_count / generation_time ELSE 0 END, 6) AS tokens_per_sec,
       '{RUN_TS}' AS timestamp, 0.8::DOUBLE AS temperature, 50 AS top_k, 0.95::DOUBLE AS top_p,
       200 AS max_tokens, 1.1::DOUBLE AS repetition_penalty FROM res"""


def _prompt_grid(spark: SparkSession, sf: str):
    conv = table(spark, sf, "conversations")
    prompts = with_pos(conv.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prompt")),
                       ["conv_id", "turn"], "prompt_idx")
    # prompt x sample index without a join: a generator per prompt
    grid = prompts.withColumn("sample_idx", F.explode(F.sequence(F.lit(0), F.lit(SAMPLES - 1))))
    return grid.withColumn("inference_num", F.col("prompt_idx") * SAMPLES + F.col("sample_idx") + 1)


def inference_rows(spark: SparkSession, sf: str):
    conv = table(spark, sf, "conversations")
    grid = _prompt_grid(spark, sf)
    replies = conv.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    j = grid.join(replies, ["conv_id", "turn"], "left")
    gen_time = F.col("turn") * 0.5 + F.col("sample_idx") * 0.25
    count = F.when(F.col("reply").isNull(), F.lit(0)).otherwise(pretoken_count("reply")).cast("int")
    return j.select(
        F.col("inference_num").cast("long"), F.col("prompt_idx").cast("int"), F.col("sample_idx").cast("int"),
        "prompt", F.coalesce("reply", F.lit("[Generation failed: no reply]")).alias("generated_text"),
        count.alias("token_count"), gen_time.alias("generation_time"),
        _r(rl.tokens_per_sec(count, gen_time), "tokens_per_sec"),
        F.lit(RUN_TS).alias("timestamp"), F.lit(INF_PARAMS["temperature"]).alias("temperature"),
        F.lit(INF_PARAMS["top_k"]).alias("top_k"), F.lit(INF_PARAMS["top_p"]).alias("top_p"),
        F.lit(INF_PARAMS["max_tokens"]).alias("max_tokens"),
        F.lit(INF_PARAMS["repetition_penalty"]).alias("repetition_penalty"))


query("inference_rows", f"WITH {_SQL_PROMPTS} {_SQL_INF}")(inference_rows)


@query("prompt_grid", f"WITH {_SQL_PROMPTS} SELECT prompt_idx, sample_idx, inference_num FROM res")
def prompt_grid(spark: SparkSession, sf: str):
    g = _prompt_grid(spark, sf)
    return g.select(F.col("prompt_idx").cast("int"), F.col("sample_idx").cast("int"),
                    F.col("inference_num").cast("long"))


@query("inference_summary", f"""
WITH {_SQL_PROMPTS}, rows AS ({_SQL_INF})
SELECT count(*) AS generations, count(DISTINCT prompt_idx) AS prompts, round(avg(token_count), 6) AS avg_tokens,
       round(avg(generation_time), 6) AS avg_time, round(avg(tokens_per_sec), 6) AS avg_tokens_per_sec,
       round(avg(length(generated_text)), 6) AS avg_chars FROM rows""")
def inference_summary(spark: SparkSession, sf: str):
    s = rl.inference_summary(inference_rows(spark, sf))
    return s.select("generations", "prompts", _r("avg_tokens"), _r("avg_time"), _r("avg_tokens_per_sec"),
                    _r("avg_chars"))


_INF_SCHEMA = ("inference_num long, prompt_idx int, sample_idx int, prompt string, generated_text string, "
               "token_count int, generation_time double, tokens_per_sec double, timestamp string, "
               "temperature double, top_k int, top_p double, max_tokens int, repetition_penalty double")


@query("write_csv_roundtrip", f"WITH {_SQL_PROMPTS} {_SQL_INF}")
def write_csv_roundtrip(spark: SparkSession, sf: str):
    """Inference results CSV (14 fixed columns; an empty result writes nothing), read back."""
    rows = inference_rows(spark, sf)
    path = scratch_path(spark, "inference-csv")
    write_inference(rows, path)
    write_inference(rows.limit(0), path)
    return read_csv(spark, path, _INF_SCHEMA)


# --- ranking within groups ------------------------------------------------------------------
@query("topk_ties", f"""
SELECT user_id, event_id, value, rank FROM (SELECT user_id, event_id, value,
       CAST(rank() OVER (PARTITION BY user_id ORDER BY value DESC) AS INTEGER) AS rank FROM events)
WHERE rank <= {TOPK}""")
def topk_ties(spark: SparkSession, sf: str):
    e = table(spark, sf, "events").select("user_id", "event_id", "value")
    return rl.topk_ties(e, "user_id", "value", TOPK)


@query("share_cut", f"""
WITH s AS (SELECT user_id, event_id, value, exp(value / {TEMP} - max(value / {TEMP}) OVER (PARTITION BY user_id)) AS e
           FROM events),
t AS (SELECT *, e / sum(e) OVER (PARTITION BY user_id) AS share FROM s),
c AS (SELECT *, sum(share) OVER (PARTITION BY user_id ORDER BY value DESC, event_id
                 ROWS UNBOUNDED PRECEDING) AS cum_share,
             row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM t)
SELECT user_id, event_id, round(share, 6) AS share, round(cum_share, 6) AS cum_share FROM c
WHERE rn = 1 OR round(cum_share, 12) <= {TOP_P}""")
def share_cut(spark: SparkSession, sf: str):
    e = table(spark, sf, "events").select("user_id", "event_id", "value")
    c = rl.share_cut(e, "user_id", "event_id", "value", TOP_P, TEMP)
    return c.select("user_id", "event_id", _r("share"), _r("cum_share"))


@query("seen_penalty", f"""
WITH sc AS (SELECT user_id, event_type, avg(value) - 50 AS score FROM events GROUP BY 1, 2),
seen AS (SELECT DISTINCT user_id, event_type FROM events WHERE ts < TIMESTAMP '2024-01-04')
SELECT sc.user_id, sc.event_type, round(score, 6) AS score,
       round(CASE WHEN seen.user_id IS NULL THEN score WHEN score < 0 THEN score * {PENALTY}
                  ELSE score / {PENALTY} END, 6) AS penalized, seen.user_id IS NOT NULL AS seen
FROM sc LEFT JOIN seen USING (user_id, event_type)""")
def seen_penalty(spark: SparkSession, sf: str):
    e = table(spark, sf, "events")
    sc = e.groupBy("user_id", "event_type").agg((F.avg("value") - 50).alias("score"))
    seen = e.where(F.col("ts") < F.lit("2024-01-04").cast("timestamp_ntz")).select("user_id", "event_type")
    p = rl.seen_penalty(sc, seen, ["user_id", "event_type"], "score", PENALTY)
    return p.select("user_id", "event_type", _r("score"), _r("penalized"), "seen")


@query("weighted_draw", f"""
SELECT user_id, arg_min(event_id, ln(-ln((CAST(('0x' || substr(md5(concat_ws(':', '7', CAST(user_id AS VARCHAR),
       CAST(event_id AS VARCHAR))), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0)) - value / {TEMP}) AS event_id
FROM events GROUP BY user_id""")
def weighted_draw(spark: SparkSession, sf: str):
    e = table(spark, sf, "events").select("user_id", "event_id", "value")
    return rl.weighted_draw(e, "user_id", "event_id", "value", TEMP, seed=7)
