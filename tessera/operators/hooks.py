"""Row functions supplied by the user."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def map_rows(df: DataFrame, fn: Callable[[dict[str, Any]], dict[str, Any] | None],
             schema: T.StructType | str | None = None) -> DataFrame:
    """Apply ``fn`` to every row as a dict; ``None`` drops the row.

    ``schema`` (default: that of ``df``) declares the result; other keys of the
    returned dicts are left out and absent ones are null.
    """
    out = df.schema if schema is None else schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for r in map(fn, batch.to_pylist()) if r is not None]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
    return df.mapInArrow(run, out)
