"""Structured Streaming versions of the incremental corpus jobs (STR-1..3).

* ``stream_split``   new JSONL files -> text check -> stateless hash split ->
                     file sink (exactly once via the checkpoint location).
* ``stream_blocks``  the same with the exact block split, by running positions
                     in the state store.
* ``stream_encode``  new files -> subword encoding in ``mapInPandas`` (stateless).
* ``stream_metrics`` metric points -> best / current / count / last points per
                     series as keyed state; a trigger writes what it changed.

All take a checkpoint location and, if wanted, a bound on the files of a trigger; with ``trigger(availableNow=True)`` a run
processes what has arrived and stops, so the same code serves backfills and
schedules.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.encode import encode_subword
from ..operators.order import hash_key
from ..operators.slices import BLOCK_SIZE, train_count
from ..operators.vocab import SubwordModel

TWO_32 = float(2 ** 32)


def hash_split(key_cols, train_split: float = 0.8, seed: int = 42) -> Column:
    """Stable per-key split for unbounded input: the first 32 bits of
    ``md5(seed:key)`` below ``train_split * 2^32`` -> train (approximate ratio,
    exact repeatability; the exact-count split needs the whole input)."""
    h = F.conv(F.substring(hash_key(seed, *key_cols), 1, 8), 16, 10).cast("double")
    return F.when(h < F.lit(train_split * TWO_32), "train").otherwise("validation")


def read_jsonl_stream(spark: SparkSession, path: str, schema: T.StructType | str,
                      max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).option("mode", "FAILFAST")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.json(path)


def stream_split(spark: SparkSession, source: str, schema, key_cols, sink: str, checkpoint: str,
                 train_split: float = 0.8, seed: int = 42, text_field: str = "text",
                 available_now: bool = True, max_files_per_trigger: int | None = None):
    docs = read_jsonl_stream(spark, source, schema, max_files_per_trigger)
    out = (docs.withColumn(text_field, F.coalesce(F.col(text_field),
                                                  F.raise_error(F.lit(f"record without '{text_field}'"))))
           .withColumn("split", hash_split(key_cols, train_split, seed)))
    w = (out.writeStream.format("json").option("path", sink).option("checkpointLocation", checkpoint)
         .partitionBy("split").outputMode("append"))
    q = (w.trigger(availableNow=True) if available_now else w).start()
    return q


def _next_positions(block_size: int, target: int):
    """Rows of one source and how many came before -> their position and split, in the given order."""
    def number(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else 0
        rows = sorted((tuple(k), r) for pdf in batches for k, r in zip(pdf["place"].tolist(), pdf["record"].tolist(), strict=True))
        pos = range(before, before + len(rows))
        state.update((before + len(rows),))
        yield pd.DataFrame({"record": [r for _, r in rows], "pos": list(pos),
                            "split": ["train" if p % block_size < target else "validation" for p in pos]})
    return number


def stream_blocks(spark: SparkSession, source: str, schema: T.StructType | str, sink: str, checkpoint: str, order,
                  source_col: str | None = None, train_split: float = 0.8, block_size: int = BLOCK_SIZE,
                  available_now: bool = True, max_files_per_trigger: int | None = None):
    """The block split on unbounded input: of every ``block_size`` rows of a source, in order of arrival and within a
    trigger of ``order`` (whole numbers), the first ``int(block_size * train_split)`` go to train.

    How many rows a source had is keyed state in the checkpoint, so blocks go on over triggers and restarts.  One
    task numbers a source's rows of one trigger, which the files per trigger bound.  Without ``source_col`` all rows
    are one source."""
    docs = read_jsonl_stream(spark, source, schema, max_files_per_trigger)
    kind = docs.schema
    key = F.col(source_col).cast("string") if source_col else F.lit("")
    rows = docs.select(key.alias("source"), F.array(*[F.col(o).cast("long") for o in order]).alias("place"),
                       F.to_json(F.struct(*docs.columns)).alias("record"))
    numbered = rows.groupBy("source").applyInPandasWithState(
        _next_positions(block_size, train_count(block_size, train_split)), "record string, pos long, split string", "n long",
        "append", GroupStateTimeout.NoTimeout)
    out = numbered.select(F.from_json("record", kind).alias("r"), "pos", "split").select("r.*", "pos", "split")
    w = (out.writeStream.format("json").option("path", sink).option("checkpointLocation", checkpoint)
         .partitionBy("split").outputMode("append"))
    return (w.trigger(availableNow=True) if available_now else w).start()


def stream_encode(spark: SparkSession, source: str, schema, model: SubwordModel, key_cols, sink: str,
                  checkpoint: str, eos_id: int | None = None, available_now: bool = True,
                  max_files_per_trigger: int | None = None):
    docs = read_jsonl_stream(spark, source, schema, max_files_per_trigger)
    enc = encode_subword(docs, model, key_cols, eos_id=eos_id)
    w = (enc.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
         .outputMode("append"))
    return (w.trigger(availableNow=True) if available_now else w).start()


def _order_number(col: str, kind: T.DataType) -> Column:
    """A whole number in the order of a time or integer column."""
    return F.unix_micros(F.col(col).cast("timestamp")) if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else (
        F.col(col).cast("long"))


def _metric_state(n_order: int, window: int):
    """Points of one series and its state -> the new state: best value, number of points, and the last ``window``
    points in order, whatever the order in which they arrive."""
    def update(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        best, points, *kept = state.get if state.exists else (float("inf"), 0, *([] for _ in range(n_order + 1)))
        last = list(zip(*kept, strict=True))
        for pdf in batches:
            rows = list(zip(*(pdf[f"k{i}"].tolist() for i in range(n_order)), pdf["value"].tolist(), strict=True))
            points += len(rows)
            best = min([best, *(r[-1] for r in rows)])
            last = sorted([*last, *rows])[-window:]
        columns = [list(c) for c in zip(*last, strict=True)] or [[] for _ in range(n_order + 1)]
        state.update((float(best), int(points), *columns))
        values = columns[-1]
        yield pd.DataFrame({"series": [key[0]], "best": [best], "current": [values[-1]], "points": [points],
                            "recent": [values], "recent_avg": [sum(values) / len(values)]})
    return update


METRIC_STATE = "series string, best double, current double, points long, recent array<double>, recent_avg double"


def stream_metrics(spark: SparkSession, source: str, schema, sink: str, checkpoint: str,
                   series: str = "series", value: str = "loss", order=("ts", "event_id"), window: int = 1000,
                   available_now: bool = True, max_files_per_trigger: int | None = None):
    """Running best, current, count and last ``window`` points of each series, as keyed state in the checkpoint.

    Points without a value do not count.  A trigger writes only the series that it changed, into a folder of its own
    number, so a repeated trigger replaces what it wrote before; :func:`metric_states` reads the newest rows."""
    pts = read_jsonl_stream(spark, source, schema, max_files_per_trigger)
    kinds = [pts.schema[o].dataType for o in order]
    rows = pts.where(F.col(value).isNotNull()).select(
        F.col(series).cast("string").alias("series"), F.col(value).cast("double").alias("value"),
        *[_order_number(o, k).alias(f"k{i}") for i, (o, k) in enumerate(zip(order, kinds, strict=True))])
    kept = ", ".join(f"k{i} array<long>" for i in range(len(order)))
    state = rows.groupBy("series").applyInPandasWithState(
        _metric_state(len(order), window), METRIC_STATE, f"best double, points long, {kept}, recent array<double>", "update",
        GroupStateTimeout.NoTimeout)

    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/epoch={epoch_id}")

    w = state.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write_batch)
    return (w.trigger(availableNow=True) if available_now else w).start()


def metric_states(spark: SparkSession, sink: str) -> DataFrame:
    """The newest state of each series that :func:`stream_metrics` wrote."""
    rows = spark.read.schema(f"{METRIC_STATE}, epoch long").parquet(sink)
    return rows.groupBy("series").agg(F.max_by(F.struct(*[f for f in rows.columns if f not in ("series", "epoch")]), "epoch")
                                      .alias("s")).select("series", "s.*")
