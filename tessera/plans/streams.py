"""Streaming queries: the table is written as several JSONL files, a stream with
``availableNow`` consumes them, and the sink is read back."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from ..streaming import incremental as inc
from .common import sql_hash, table
from .registry import query
from .tokens import EOS, SQL_DECODED, _bpe, decoded

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
FILES = 6


def _as_files(df, name: str, spark: SparkSession, key: str) -> str:
    path = scratch_path(spark, name)
    df.repartition(FILES, key).write.mode("overwrite").json(path)
    return path


@query("stream_split", f"""
SELECT doc_id, CASE WHEN CAST(('0x' || substr({sql_hash(42, 'doc_id')}, 1, 8)) AS BIGINT)
                         < 0.8::DOUBLE * 4294967296 THEN 'train' ELSE 'validation' END AS split
FROM documents""")
def stream_split(spark: SparkSession, sf: str):
    src = _as_files(table(spark, sf, "documents"), "stream-docs", spark, "doc_id")
    sink, ckpt = scratch_path(spark, "stream-split-out"), scratch_path(spark, "stream-split-ckpt")
    inc.stream_split(spark, src, DOC_SCHEMA, ["doc_id"], sink, ckpt).awaitTermination()
    return spark.read.schema("doc_id long, text string, split string").json(sink).select("doc_id", "split")


@query("stream_encode", SQL_DECODED)
def stream_encode(spark: SparkSession, sf: str):
    model = _bpe(spark, sf)
    src = _as_files(table(spark, sf, "documents"), "stream-enc-docs", spark, "doc_id")
    sink, ckpt = scratch_path(spark, "stream-enc-out"), scratch_path(spark, "stream-enc-ckpt")
    inc.stream_encode(spark, src, DOC_SCHEMA, model, ["doc_id"], sink, ckpt, eos_id=EOS).awaitTermination()
    return decoded(spark.read.parquet(sink), model, spark)


@query("stream_metrics", """
SELECT event_type AS series, min(value / 100) AS best, arg_max(value / 100, (ts, event_id)) AS current,
       count(*) AS points FROM events GROUP BY 1""")
def stream_metrics(spark: SparkSession, sf: str):
    ev = table(spark, sf, "events").select(F.col("event_type").alias("series"), "ts", "event_id",
                                            (F.col("value") / 100).alias("loss"))
    src = _as_files(ev, "stream-metrics-src", spark, "event_id")
    sink, ckpt = scratch_path(spark, "stream-metrics-out"), scratch_path(spark, "stream-metrics-ckpt")
    inc.stream_metrics(spark, src, "series string, ts timestamp_ntz, event_id long, loss double",
                       sink, ckpt).awaitTermination()
    return inc.metric_states(spark, sink).select("series", "best", "current", "points")


@query("stream_last_points", """
SELECT event_type AS series, round(sum(value / 100), 4) AS recent_sum, count(*) AS kept
FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events)
WHERE r <= 1000 GROUP BY 1""")
def stream_last_points(spark: SparkSession, sf: str):
    """The last 1,000 points of each series after a stream in several triggers and a restart."""
    ev = table(spark, sf, "events").select(F.col("event_type").alias("series"), "ts", "event_id",
                                            (F.col("value") / 100).alias("loss"))
    src = _as_files(ev, "stream-points-src", spark, "event_id")
    sink, ckpt = scratch_path(spark, "stream-points-out"), scratch_path(spark, "stream-points-ckpt")
    for _ in range(2):  # the second run finds nothing new and leaves the state as it is
        inc.stream_metrics(spark, src, "series string, ts timestamp_ntz, event_id long, loss double",
                           sink, ckpt, max_files_per_trigger=2).awaitTermination()
    return inc.metric_states(spark, sink).select("series", F.round(F.aggregate("recent", F.lit(0.0), lambda a, x: a + x), 4).alias("recent_sum"),
                                                 F.size("recent").cast("long").alias("kept"))
