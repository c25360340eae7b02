"""Composition of ordered values inside groups, as a tree.

Some sequential rules become parallel once a stretch of rows is summed up by a
value that composes: a cost table between states, a map from entries to exits,
a running balance with its peak.  ``fold`` composes all values of each group
in order, ``scan`` composes for every row those before it (or after it).

A block is the rows whose order key shares all but its last ``bits`` bits, so
a task composes at most ``2 ** bits`` values at a time whatever the size of a
group; the blocks' totals are the rows of the next level, until each group has
one row.  The order key need not be dense, only unique inside its group.  Each
level is a table below the shared checkpoint folder, smaller by the fan-out.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import written

BITS = 8

Combine = Callable[[object, object], object]


def _match(left: str, right: str, cols: Sequence[str]) -> Column:
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return cond


def _levels(df: DataFrame, group: Sequence[str], order: str, value: str, combine: Combine, bits: int) -> list[DataFrame]:
    rows = written(df.select(*group, order, value), "values")
    levels, schema = [rows], rows.schema

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_at")
        values = pdf[value].tolist()
        out = values[0]
        for v in values[1:]:
            out = combine(out, v)
        row = pdf.iloc[:1].drop(columns="_at")
        return row.assign(**{value: [out]})[[f.name for f in schema]]

    while not levels[-1].groupBy(*group).count().where("count > 1").isEmpty():
        below = levels[-1].withColumn("_at", F.col(order)).withColumn(order, F.shiftright(order, bits))
        levels.append(written(below.groupBy(*group, order).applyInPandas(total, schema), "totals"))
    return levels


def fold(df: DataFrame, group: Sequence[str], order: str, value: str, combine: Combine, bits: int = BITS) -> DataFrame:
    """One row per group: its columns and ``value``, all values composed in ``order``."""
    return _levels(df, group, order, value, combine, bits)[-1].select(*group, value)


def scan(df: DataFrame, group: Sequence[str], order: str, value: str, combine: Combine, reverse: bool = False,
         bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """For every row ``group``, ``order`` and ``rest``: the values before it composed in order (``reverse``:
    those after it), null where there are none.  And, from the same tree, what ``fold`` gives."""
    levels = _levels(df, group, order, value, combine, bits)
    kind = levels[0].schema[value].dataType
    schema = levels[0].schema[order].dataType.simpleString()
    fields = ", ".join([*(f"`{c}` {levels[0].schema[c].dataType.simpleString()}" for c in group),
                        f"`{order}` {schema}", f"rest {kind.simpleString()}"])

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, ascending=not reverse)
        so_far, rest = pdf["_rest"].iloc[0], []
        for v in pdf[value].tolist():
            rest.append(so_far)
            so_far = v if so_far is None else combine(v, so_far) if reverse else combine(so_far, v)
        return pdf.assign(rest=rest)[[*group, order, "rest"]]

    known = levels[-1].select(*group, order, F.lit(None).cast(kind).alias("rest"))
    for level in reversed(levels[:-1]):
        up = level.withColumn("_up", F.shiftright(order, bits)).alias("a")
        over = known.select(*group, F.col(order).alias("_up"), F.col("rest").alias("_rest")).alias("b")
        rows = up.join(over, _match("a", "b", [*group, "_up"])).select("a.*", "b._rest")
        known = written(rows.groupBy(*group, "_up").applyInPandas(inside, fields), "scanned")
    return known, levels[-1].select(*group, value)
