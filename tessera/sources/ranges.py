"""Large JSON and CSV files over many tasks.

A JSON array, a trace object or a CSV file with quoted line ends cannot be cut
blindly: whether a byte range begins inside a string, and how deep, follows
from all bytes before it.  Spark's text source cuts files at ``}`` (JSON) or at
line ends (CSV), so the ranges split like any text scan.  A first pass sums up
each range for both cases, beginning inside a string or not: how it ends, and
how much deeper.  The sums of a file's ranges, one row each, compose in order
to the true state at each range's start.  A second pass cuts the elements or
records out; those that cross ranges are put together from their parts.  JSON
elements are written then, for all that reads them later.

Bounded: a task holds one element or record; the driver one row per range.
Elements of a JSON array must be objects.  A file that ends inside a string or
an open bracket raises.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ValidationError
from ..operators.order import FILE_ORDER, written

_TOKEN = re.compile(r'\\.|["{\[\]]', re.S)
_ESCAPED = re.compile(r"\\.", re.S)
_KEY = re.compile(r'"((?:[^"\\]|\\.)*)"\s*:\s*$', re.S)

Range = tuple[str, int]


def fragments(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """(file, block, value): the file cut at ``sep``, in file order inside each range (file, block)."""
    return spark.read.option("lineSep", sep).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Range, str]]:
    for b in batches:
        if not b.num_rows:
            continue
        files, blocks, values = b.columns
        new = np.diff(blocks.to_numpy()) != 0
        new |= pc.not_equal(files.slice(1), files.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
        at = [0, *(np.flatnonzero(new) + 1).tolist(), b.num_rows]
        for start, end in zip(at, at[1:]):
            key = files[start].as_py(), blocks[start].as_py()
            for value in values.slice(start, end - start).to_pylist():
                yield key, value


def _sides(value: str, quoted: bool) -> tuple[str, str, bool]:
    """What of a fragment is outside strings and what inside, and whether it ends inside one."""
    parts = (_ESCAPED.sub("", value) if "\\" in value else value).split('"')
    even, odd = "".join(parts[::2]), "".join(parts[1::2])
    return (odd, even, len(parts) % 2 == 1) if quoted else (even, odd, len(parts) % 2 == 0)


class _Json:
    """Where a walk through a JSON file stands; ``other``: how deep the walk would be that began on the other side of
    a quote; ``arrays``: by depth, what stands before the array open there, None once it is closed."""

    def __init__(self, quoted: bool = False, depth: int = 0, active: bool = False, field: str | None = None, base: int = 0):
        self.quoted, self.depth, self.active, self.field, self.base = quoted, depth, active, field, base
        self.other, self.root = 0, ""
        self.arrays: dict[int, str | None] = {}

    def walk(self, value: str, opened: Callable[[int], None] | None = None) -> None:
        """Through one fragment and the ``}`` after it."""
        outside, inside, ends = _sides(value, self.quoted)
        self.other += inside.count("{") + inside.count("[") - inside.count("]") - ends
        n = outside.count("{")
        if "[" in outside or "]" in outside or (n and opened and not self._first(value, opened)):
            self._step(value, opened)
        else:
            if n:
                self.root = self.root or "{"
            self.depth, self.quoted = self.depth + n - (not ends), ends

    def _first(self, value: str, opened: Callable[[int], None]) -> bool:
        """``opened`` for the first bracket, if it is plain that it is the only one of interest."""
        at = value.index("{")
        if self.quoted or self.depth < self.base or '"' in value[:at] or "\\" in value[:at]:
            return False
        opened(at)
        return True

    def _step(self, value: str, opened: Callable[[int], None] | None) -> None:
        for m in _TOKEN.finditer(value):
            c = m.group()
            if c == '"':
                self.quoted = not self.quoted
            elif self.quoted or c[0] == "\\":
                continue
            elif c == "]":
                self.depth -= 1
                self.arrays[self.depth] = None
                if self.depth == 1 and self.field is not None:
                    self.active = False
            else:
                self.root = self.root or c
                if opened and c == "{":
                    opened(m.start())
                if c == "[":
                    self.arrays[self.depth] = value[:m.start()]
                    if self.depth == 1 and self.field is not None:
                        self.active = _named(value[:m.start()], self.field)
                self.depth += 1
        if not self.quoted:
            self.depth -= 1


def _named(before: str | None, field: str) -> bool:
    """Whether an array is open and what stands before it is the name ``field``."""
    key = before is not None and _KEY.search(before)
    return bool(key) and key.group(1) == field


_SUMS = "file string, block long, ends boolean, by0 long, by1 long, root string, depths array<long>, active array<boolean>"


def _json_sums(field: str | None):
    """Ranges -> how they end if they begin outside a string, and how much deeper, beginning outside or inside one; the
    first bracket; whether the last array at each depth is the open one of ``field``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, walk = None, _Json()

        def out() -> pa.RecordBatch:
            arrays = {d: _named(before, field) for d, before in walk.arrays.items()} if field is not None else {}
            row = {"file": now[0], "block": now[1], "ends": walk.quoted, "by0": walk.depth, "by1": walk.other,
                   "root": walk.root, "depths": list(arrays), "active": list(arrays.values())}
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([
                ("file", pa.string()), ("block", pa.int64()), ("ends", pa.bool_()), ("by0", pa.int64()), ("by1", pa.int64()),
                ("root", pa.string()), ("depths", pa.list_(pa.int64())), ("active", pa.list_(pa.bool_()))]))
        for key, value in _ranges(batches):
            if key != now:
                if now is not None:
                    yield out()
                now, walk = key, _Json()
            walk.walk(value)
        if now is not None:
            yield out()
    return run


def _active_sums(starts: dict[Range, tuple[bool, int]], field: str):
    """Ranges with known starts -> whether the field's array is open at their end (null: as at their start)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends: dict[Range, bool | None] = {}
        walk = None
        for key, value in _ranges(batches):
            if key not in ends:
                walk = _Json(*starts[key], active=None, field=field)
            walk.walk(value)
            ends[key] = walk.active
        yield pa.RecordBatch.from_pylist([{"file": f, "block": b, "active": a} for (f, b), a in ends.items()], schema=pa.schema(
            [("file", pa.string()), ("block", pa.int64()), ("active", pa.bool_())]))
    return run


_PARTS = "file string, block long, row long, text string, begins boolean, ends boolean"
_PART = pa.schema([("file", pa.string()), ("block", pa.int64()), ("row", pa.int64()), ("text", pa.string()),
                   ("begins", pa.bool_()), ("ends", pa.bool_())])


class _Out:
    """Parts of elements, in batches."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.size = 0

    def add(self, key: Range, row: int, text: str, begins: bool, ends: bool) -> None:
        self.rows.append((*key, row, text, begins, ends))
        self.size += len(text)

    def full(self) -> bool:
        return self.size > 1 << 22 or len(self.rows) > 20_000

    def batch(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows, strict=True)) or [[] for _ in _PART]
        self.rows, self.size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _PART, strict=True)], schema=_PART)


def _json_parts(starts: dict[Range, tuple[bool, int, bool, int]], field: str | None):
    """Ranges with known starts (quoted, depth, active, depth around the elements) -> elements and parts of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, walk, row, base = _Out(), None, None, 0, 0
        held: list[str] | None = None  # the open element's text so far in this range
        begins = True

        def close(ends: bool) -> None:
            nonlocal held, row
            out.add(now, row, "".join(held), begins, ends)
            held, row = None, row + 1
        for key, value in _ranges(batches):
            if key != now:
                if held is not None:
                    close(False)
                now, row = key, 0
                quoted, depth, active, base = starts[key]
                walk = _Json(quoted, depth, active, field, base)
                held, begins = ([], False) if active and depth > base else (None, True)
            at: list[int] = []
            before = held is not None

            def opened(i: int) -> None:
                if walk.active and walk.depth == base and held is None:
                    at.append(i)
            walk.walk(value, opened)
            # An element that opens here is the only one: none ends before the ``}`` that ends the fragment.
            if not before and at:
                held, begins = [value[at[0]:] + "}"], True
            elif before:
                held.append(value + "}")
            if held is not None and not walk.quoted and walk.depth == base:
                close(True)
            if out.full():
                yield out.batch()
        if held is not None:
            close(False)
        yield out.batch()
    return run


def _joined(parts: DataFrame) -> DataFrame:
    """Whole elements, those cut by ranges put together: ``FILE_ORDER`` columns and ``text``."""
    names = [F.col(c).alias(n) for c, n in zip(("file", "block", "row"), FILE_ORDER, strict=True)]
    whole = parts.where("begins and ends").select(*names, "text")
    # At most two parts of each range: the last one begins an element, the first one ends it.
    inside = Window.partitionBy("file").orderBy("block", "row")
    cut = parts.where("not (begins and ends)").withColumn("n", F.sum(F.col("begins").cast("int")).over(inside))
    one = cut.groupBy("file", "n").agg(F.min(F.struct("block", "row")).alias("k"),
                                       F.array_sort(F.collect_list(F.struct("block", "row", "text"))).alias("p"))
    return whole.unionByName(one.select(
        F.col("file").alias(FILE_ORDER[0]), F.col("k.block").alias(FILE_ORDER[1]), F.col("k.row").alias(FILE_ORDER[2]),
        F.array_join("p.text", "").alias("text")))


def json_elements(spark: SparkSession, path: str, field: str | None = None) -> DataFrame:
    """``text`` of each object in the array that a JSON file holds, or of the one object that it is; with ``field``,
    of each object in that array of the file's object.  With ``FILE_ORDER`` columns."""
    pieces = fragments(spark, path, "}")
    sums = sorted(pieces.mapInArrow(_json_sums(field), _SUMS).collect(), key=lambda r: (r["file"], r["block"]))  # one row per range
    starts: dict[Range, tuple[bool, int]] = {}
    roots, state = {}, {}
    for r in sums:
        quoted, depth = state.get(r["file"], (False, 0))
        starts[r["file"], r["block"]] = (quoted, depth)
        state[r["file"]] = (quoted != r["ends"], depth + (r["by1"] if quoted else r["by0"]))
        if not roots.get(r["file"]):
            roots[r["file"]] = r["root"]
    for file, (quoted, depth) in state.items():
        if quoted or depth > 0:
            raise ValidationError(f"{file} ends inside a value")
    if field is None:
        full = {k: (*s, True, 1 if roots[k[0]] == "[" else 0) for k, s in starts.items()}
    else:
        ends = {(r["file"], r["block"]): dict(zip(r["depths"], r["active"])).get(1 - starts[r["file"], r["block"]][1])
                for r in sums}
        if any(quoted for quoted, _ in starts.values()):  # a range begins inside a string: its arrays are other ones
            again = pieces.mapInArrow(_active_sums(starts, field), "file string, block long, active boolean").collect()
            ends = {(r["file"], r["block"]): r["active"] for r in again}
        active, full = {}, {}
        for k in sorted(ends):
            full[k] = (*starts[k], active.get(k[0], False), 2)
            if ends[k] is not None:
                active[k[0]] = ends[k]
    return _joined(written(pieces.mapInArrow(_json_parts(full, field), _PARTS), "parts"))


def _quote_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    odd: dict[Range, bool] = {}
    for key, value in _ranges(batches):
        odd[key] = odd.get(key, False) ^ (value.count('"') % 2 == 1)
    yield pa.RecordBatch.from_pylist([{"file": f, "block": b, "odd": o} for (f, b), o in odd.items()], schema=pa.schema(
        [("file", pa.string()), ("block", pa.int64()), ("odd", pa.bool_())]))


def _csv_parts(starts: dict[Range, bool]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, row, quoted, begins = _Out(), None, 0, False, True
        held: list[str] = []

        def close(ends: bool) -> None:
            nonlocal held, row
            text = "\n".join(held)
            out.add(now, row, text if ends else text + "\n", begins, ends)
            held, row = [], row + 1
        for key, value in _ranges(batches):
            if key != now:
                if held:
                    close(False)
                now, row, quoted = key, 0, starts[key]
                begins = not quoted
            held.append(value)
            quoted ^= value.count('"') % 2 == 1
            if not quoted:
                close(True)
                begins = True
            if out.full():
                yield out.batch()
        if held:
            close(False)
        yield out.batch()
    return run


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``text`` of each CSV record, line ends inside quotes kept, with ``FILE_ORDER`` columns; header records too."""
    lines = fragments(spark, path, "\n")
    starts: dict[Range, bool] = {}
    state: dict[str, bool] = {}
    sums = lines.mapInArrow(_quote_sums, "file string, block long, odd boolean").collect()  # one row per range
    for r in sorted(sums, key=lambda r: (r["file"], r["block"])):
        starts[r["file"], r["block"]] = state.get(r["file"], False)
        state[r["file"]] = state.get(r["file"], False) ^ r["odd"]
    for file, quoted in state.items():
        if quoted:
            raise ValidationError(f"{file} ends inside quotes")
    rows = _joined(lines.mapInArrow(_csv_parts(starts), _PARTS))
    return rows.withColumn("text", F.regexp_replace("text", "\r$", ""))


def parse_csv(records: DataFrame, schema: T.StructType | str, options: dict[str, str]) -> DataFrame:
    """Fields of CSV records (without the header) beside their ``FILE_ORDER`` columns."""
    kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    body = records.where(~((F.col(FILE_ORDER[1]) == 0) & (F.col(FILE_ORDER[2]) == 0)) & (F.trim("text") != ""))
    return body.select(F.from_csv("text", kind.toDDL(), options).alias("r"), *FILE_ORDER).select("r.*", *FILE_ORDER)
