"""Report sinks: CSV files with a header, in the order of their columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .readers import METRICS_SCHEMA


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", null: str = "") -> None:
    """Quoted CSV with a header; text keeps its blanks, quotes are doubled, nulls become ``null``."""
    (df.write.mode(mode).option("header", True).option("escape", '"').option("nullValue", null)
     .option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))


def write_metrics(points: DataFrame, path: str, mode: str = "append") -> None:
    """Metric points with the log's columns; ``append`` goes on after a resumed run, ``overwrite`` exports all."""
    write_csv(points.select(*[f.name for f in METRICS_SCHEMA.fields]), path, mode)


def write_inference(rows: DataFrame, path: str, mode: str = "append") -> bool:
    """Inference results; an empty result writes nothing.  Whether something was written."""
    if rows.isEmpty():
        return False
    write_csv(rows, path, mode)
    return True


def write_timeline(timeline: DataFrame, path: str) -> None:
    """Memory timeline by time; nested columns become JSON text."""
    flat = [F.to_json(c).alias(c) if kind.startswith(("array", "struct", "map")) else F.col(c)
            for c, kind in timeline.dtypes]
    write_csv(timeline.select(*flat), path)
