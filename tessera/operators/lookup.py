"""Elements of arrays looked up in a table, by the distinct elements of blocks.

Exploding token arrays to join them with a vocabulary sends every token through
two shuffles and a sort.  Here rows are cut into blocks of ``BLOCK_ELEMENTS``
elements (whole rows; a longer row is a block of its own).  A block keeps its
elements as indices into its distinct elements, and only these meet the table,
by a join that Spark deals out by the element: an element stands once in a
block, so a frequent one has as many rows as there are blocks.  What was found
returns to its block, where the indices pick it up.

A task holds one block and what was found for it, whatever the table's size.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .order import written

BLOCK_ELEMENTS = 1 << 21


_ADDED = ("_at", "_block", "_distinct", "_counts")


def is_cut(rows: DataFrame) -> bool:
    """Whether ``rows`` come from :func:`cut_blocks`."""
    return rows.columns[-len(_ADDED):] == list(_ADDED)


def _cut(size: int):
    """(..., elements) -> (..., indices, block, distinct elements and how often each occurs: in the block's first row)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, n = TaskContext.get().partitionId() << 32, [], 0

        def out() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            lists = t.column(t.num_columns - 1).combine_chunks()
            coded = lists.flatten().dictionary_encode()
            offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())])
            at = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), coded.indices.fill_null(len(coded.dictionary)))
            one = pa.array([0, len(coded.dictionary)], pa.int32())
            found = pa.ListArray.from_arrays(one, coded.dictionary)
            often = np.bincount(coded.indices.drop_null().to_numpy(), minlength=len(coded.dictionary))
            often = pa.ListArray.from_arrays(one, pa.array(often, pa.int64()))
            first = pa.array(np.zeros(1, np.int32)).take(pa.array(np.arange(t.num_rows), mask=np.arange(t.num_rows) > 0))
            cols = [c.combine_chunks() for c in t.columns[:-1]]
            return pa.RecordBatch.from_arrays([*cols, at, pa.array(np.full(t.num_rows, block)), found.take(first),
                                               often.take(first)], [*t.column_names[:-1], *_ADDED])
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column(batch.num_columns - 1)), 0).to_numpy()
            start = 0
            for i, k in enumerate(sizes):
                if n and n + k > size:
                    held.append(batch.slice(start, i - start))
                    yield out()
                    block, held, n, start = block + 1, [], 0, i
                n += int(k)
            held.append(batch.slice(start))
        if sum(b.num_rows for b in held):
            yield out()
    return run


def _place(keys: int, places: bool, kind: pa.DataType):
    """A block's rows (keys, block, indices) and (block, index, value) -> keys, values found, in order; with
    ``places`` also the places where they were found."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.sort_by([("_i", "ascending"), ("_value", "ascending")])
        lists = left.column("_at").combine_chunks() if left.num_rows else pa.array([], pa.list_(pa.int32()))
        at, offsets = lists.flatten().to_numpy(), lists.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)
        i = right.column("_i").to_numpy()
        n = max(int(at.max()) if len(at) else 0, int(i.max()) if len(i) else 0) + 1
        count = np.bincount(i, minlength=n)  # none: not in the table; several: it stands there so often
        start, hits = np.cumsum(count) - count, count[at]
        ends = np.concatenate([[0], np.cumsum(hits)])
        which = np.repeat(start[at] - ends[:-1], hits) + np.arange(ends[-1])
        values = right.column("_value").combine_chunks().cast(kind).take(pa.array(which))
        bounds = pa.array(ends[offsets], pa.int32())
        out = [left.column(k) for k in range(keys)] + [pa.ListArray.from_arrays(bounds, values)]
        if places:
            place = np.arange(len(at)) - np.repeat(offsets[:-1], np.diff(offsets))
            out.append(pa.ListArray.from_arrays(bounds, pa.array(np.repeat(place, hits), pa.int32())))
        return pa.table(out, [*left.column_names[:keys], *["_values", "_places"][:1 + places]])
    return run


def cut_blocks(rows: DataFrame, elements: str, block_elements: int = BLOCK_ELEMENTS) -> DataFrame:
    """``rows`` with ``_at``, ``_block``, ``_distinct`` and ``_counts`` in place of the array column ``elements``, written."""
    other = [c for c in rows.columns if c != elements]
    chosen = rows.select(*other, F.col(elements).alias("_elements"))
    schema = T.StructType([*(chosen.schema[c] for c in other), T.StructField("_at", T.ArrayType(T.IntegerType())),
                           T.StructField("_block", T.LongType()),
                           T.StructField("_distinct", T.ArrayType(chosen.schema["_elements"].dataType.elementType)),
                           T.StructField("_counts", T.ArrayType(T.LongType()))])
    return written(chosen.mapInArrow(_cut(block_elements), schema), "blocks")


def found_in(blocks: DataFrame, table: DataFrame, element: str) -> DataFrame:
    """The rows of ``table`` whose ``element`` a block has, with the block (``_of``) and the index there (``_i``)."""
    return (blocks.where("_distinct is not null").select(
        F.col("_block").alias("_of"), F.posexplode("_distinct").alias("_i", element)).join(table, element))


def placed(blocks: DataFrame, key: Sequence[str], found: DataFrame, places: bool = False) -> DataFrame:
    """``key + _values`` (and ``_places``, counted from 0): what ``found`` has as ``_value`` for the elements of each row."""
    from pyspark.sql.pandas.types import to_arrow_type
    to = found.schema["_value"].dataType
    schema = T.StructType([*(blocks.schema[k] for k in key), T.StructField("_values", T.ArrayType(to)),
                           *[T.StructField("_places", T.ArrayType(T.IntegerType()))][:places]])
    return (blocks.select(*key, "_block", "_at").groupBy("_block")
            .cogroup(found.select("_of", "_i", "_value").groupBy("_of"))
            .applyInArrow(_place(len(key), places, to_arrow_type(to)), schema))


def looked_up(rows: DataFrame, key: Sequence[str], elements: str, table: DataFrame, element: str, value: str,
              block_elements: int = BLOCK_ELEMENTS) -> DataFrame:
    """``key + _values``: for each element of the array column ``elements``, in order, the ``value`` of the rows of
    ``table`` with that ``element``; elements that the table has not are left out.

    Rows with the same key share their arrays, added up by place and then by value; a row with a null in its key
    gets an empty array.
    """
    return looked_up_blocks(cut_blocks(rows.select(*key, elements), elements, block_elements), key, table, element, value)


def looked_up_blocks(blocks: DataFrame, key: Sequence[str], table: DataFrame, element: str, value: str) -> DataFrame:
    """:func:`looked_up` for rows that :func:`cut_blocks` has cut."""
    keys = list(key)
    found = found_in(blocks, table.select(element, F.col(value).alias("_value")), element)
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    again = blocks.where(whole).groupBy(*keys).count().where("count > 1").select(*keys)
    nothing = F.array().cast(T.ArrayType(table.schema[value].dataType))
    if again.isEmpty():  # as ids are
        return placed(blocks, keys, found).withColumn("_values", F.when(whole, F.col("_values")).otherwise(nothing))
    again = written(again, "repeated")
    single = placed(blocks.join(again, keys, "left_anti"), keys, found)
    single = single.withColumn("_values", F.when(whole, F.col("_values")).otherwise(nothing))
    several = blocks.join(again, keys, "left_semi")
    each = placed(several, keys, found, places=True).select(*keys, F.explode(F.arrays_zip("_places", "_values")).alias("x"))
    joint = each.groupBy(*keys).agg(F.array_sort(F.collect_list("x")).alias("x")).select(
        *keys, F.col("x._values").alias("_values"))
    shared = several.select(*keys).join(joint, keys, "left").withColumn("_values", F.coalesce("_values", nothing))
    return single.unionByName(shared)
