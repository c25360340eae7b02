"""Readers for every input the corpus tools consume, plus a format registry.

All readers are plain ``spark.read`` calls: splittable formats split, Parquet
gets column pruning and predicate pushdown for free.  Readers that must keep
file order add ``order.FILE_ORDER`` columns with ``with_file_order=True``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SourceNotFoundError, UnsupportedFormatError, ValidationError
from ..functions.text import strip_text
from ..operators.order import FILE_ORDER, file_order
from .ranges import csv_records, json_elements, parse_csv

Reader = Callable[..., DataFrame]


def _load(fn, path):
    try:
        return fn(path)
    except AnalysisException as e:  # PATH_NOT_FOUND and friends
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            raise SourceNotFoundError(f"Source not found: {path}") from e
        raise


def _finish(df: DataFrame, with_file_order: bool) -> DataFrame:
    return file_order(df) if with_file_order else df


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
               with_file_order: bool = False) -> DataFrame:
    """JSON Lines: blank lines skipped, a malformed line fails the job."""
    r = spark.read.option("mode", "FAILFAST")
    if schema is not None:
        r = r.schema(schema)
    return _finish(_load(r.json, path), with_file_order)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
              with_file_order: bool = False) -> DataFrame:
    """Whole-file JSON: an array yields its elements, an object yields one row.
    Not splittable: one task per file."""
    r = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    if schema is not None:
        r = r.schema(schema)
    return _finish(_load(r.json, path), with_file_order)


def read_json_elements(spark: SparkSession, path: str, schema: T.StructType | str, field: str | None = None,
                       with_file_order: bool = False) -> DataFrame:
    """As :func:`read_json` with a schema, or with ``field`` the objects of that array of the file's one object,
    but a large file splits over tasks (see :mod:`.ranges`)."""
    rows = _load(lambda p: json_elements(spark, p, field), path)
    kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    rows = rows.select(F.from_json("text", kind, {"mode": "FAILFAST"}).alias("e"), *FILE_ORDER).select("e.*", *FILE_ORDER)
    return rows if with_file_order else rows.drop(*FILE_ORDER)


_CSV = {"escape": '"', "nullValue": ""}


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             with_file_order: bool = False) -> DataFrame:
    """CSV with header; quoted commas and newlines kept; empty cell -> null.  With a schema, files split over
    tasks wherever their quotes stand (see :mod:`.ranges`); without one Spark infers it, file by file."""
    if schema is None:
        r = spark.read.options(header=True, multiLine=True, inferSchema=True, **_CSV)
        return _finish(_load(r.csv, path), with_file_order)
    rows = parse_csv(_load(lambda p: csv_records(spark, p), path), schema, _CSV)
    return rows if with_file_order else rows.drop(*FILE_ORDER)


def read_parquet(spark: SparkSession, path: str, schema=None, with_file_order: bool = False) -> DataFrame:
    r = spark.read.schema(schema) if schema is not None else spark.read
    return _finish(_load(r.parquet, path), with_file_order)


def read_text(spark: SparkSession, path: str, with_file_order: bool = False) -> DataFrame:
    """One row per line, column ``value``."""
    return _finish(_load(spark.read.text, path), with_file_order)


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """Prompt file: one prompt per line, stripped, blank lines dropped.  Stray
    content (a lone ``EOF``, backslashes) is kept as a prompt."""
    lines = read_text(spark, path, with_file_order=True)
    return (lines.select(strip_text("value").alias("prompt"), "_file", "_block", "_row")
            .where(F.col("prompt") != ""))


METRICS_SCHEMA = T.StructType([
    T.StructField("batch", T.LongType()),
    T.StructField("tokens_seen", T.LongType()),
    T.StructField("train_loss", T.DoubleType()),
    T.StructField("val_loss", T.DoubleType()),
    T.StructField("learning_rate", T.DoubleType()),
    T.StructField("timestamp", T.DoubleType()),
])


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metrics log CSV: empty loss cells are null."""
    return read_csv(spark, path, schema=METRICS_SCHEMA)


TRACE_EVENT = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("ph", T.StringType()),
    T.StructField("cat", T.StringType()),
    T.StructField("ts", T.DoubleType()),
    T.StructField("dur", T.DoubleType()),
    T.StructField("pid", T.StringType()),
    T.StructField("tid", T.StringType()),
    T.StructField("args", T.MapType(T.StringType(), T.StringType())),
])


def read_trace(spark: SparkSession, path: str, one_event_per_line: bool = False) -> DataFrame:
    """Profiler trace events with ``event_index`` in file order.

    ``one_event_per_line=False``: one JSON object with a ``traceEvents`` array
    (missing array -> no events).  ``True``: JSON Lines of events.  Both split
    across tasks.
    """
    if one_event_per_line:
        ev = read_jsonl(spark, path, TRACE_EVENT, with_file_order=True)
        from ..operators.order import with_pos
        return with_pos(ev, list(FILE_ORDER), "event_index").drop(*FILE_ORDER)
    from ..operators.order import with_file_pos
    return with_file_pos(read_json_elements(spark, path, TRACE_EVENT, "traceEvents", with_file_order=True), "event_index")


def latest_file(spark: SparkSession, pattern: str, exclude: str = "_with_memory") -> DataFrame:
    """Newest file matching ``pattern`` by modification time, excluding derived names."""
    files = (spark.read.format("binaryFile").load(pattern).select("path", "modificationTime")
             .where(~F.col("path").contains(exclude)))
    return files.agg(F.max_by("path", "modificationTime").alias("path"),
                     F.max("modificationTime").alias("modification_time"))


# --- registry ----------------------------------------------------------------------
_READERS: dict[str, Reader] = {
    ".jsonl": read_jsonl,
    ".json": read_json,
    ".csv": read_csv,
    ".parquet": read_parquet,
    ".pq": read_parquet,
}


def register_reader(extension: str, reader: Reader) -> None:
    """Register a reader ``(spark, path, schema=None, with_file_order=False)``."""
    ext = extension.lower()
    _READERS[ext if ext.startswith(".") else "." + ext] = reader


def supported_formats() -> list[str]:
    return sorted(_READERS)


def reader_for(path: str) -> Reader:
    p = path.rstrip("/")
    name = p.rsplit("/", 1)[-1]
    ext = "." + name.rsplit(".", 1)[-1].lower() if "." in name else ""
    if ext not in _READERS:
        raise UnsupportedFormatError(
            f"Unsupported file format {ext or '(none)'!r}; supported: {', '.join(supported_formats())}")
    return _READERS[ext]


def read_any(spark: SparkSession, path: str, **kw) -> DataFrame:
    return reader_for(path)(spark, path, **kw)


def require_text(df: DataFrame, text_field: str = "text") -> DataFrame:
    """The text field must exist (schema check, names the available fields) and
    be non-null on every row (checked by the job)."""
    if text_field not in df.columns:
        raise ValidationError(
            f"Field {text_field!r} not found; available fields: {', '.join(df.columns)}")
    return df.withColumn(text_field, F.coalesce(
        F.col(text_field), F.raise_error(F.lit(f"record without field '{text_field}'"))))


def text_fallback(df: DataFrame, fields=("text", "content", "body"), out: str = "text") -> DataFrame:
    """First of ``fields`` that is present (per row) -> ``out``."""
    present = [f for f in fields if f in df.columns]
    if not present:
        raise ValidationError(f"None of {', '.join(fields)} found; available: {', '.join(df.columns)}")
    return df.withColumn(out, F.coalesce(*[F.col(f) for f in present]))


def resolve_hub_ref(ref: str, mirror_root: str) -> tuple[str, str]:
    """``name`` or ``name:split`` (split default ``train``) -> mirror directory."""
    name, _, split = ref.partition(":")
    split = split or "train"
    return f"{mirror_root.rstrip('/')}/{name}/{split}", split
