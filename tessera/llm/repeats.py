"""Exact removal of repeated byte strings by distributed suffix naming over a difference cover.

Every byte covered by an ``L``-byte (400) string that also starts elsewhere in
the corpus goes.  Matches never cross documents; overlaps count.

1. *Cover.*  A difference cover samples positions such that two equal long
   strings meet a sample at the same place.  Residues modulo a number need a
   large share of all positions; here the text chooses them: of every ``L``
   bytes the place with the least hash of ``K`` bytes (leftmost on ties) is
   sampled.  Which place that is follows from the ``L`` bytes alone, so equal
   strings have their sample at the same offset, and about one position in
   (L - K) / 2 is sampled.
2. *Sampled triples.*  The windows (``L``-byte strings) with one sample form a
   run, known by three names: its bytes before the sample, the sample's own
   ``K`` bytes, and the bytes after them.  Sorted together, a sample name seen
   once rules out its whole run, and an equal triple repeats all of it.
3. *Recursion on names.*  Runs whose sample is shared but whose triple is not
   are split by the distance to the sample into parts; the bytes that all
   windows of a part share get a name in turn, and parts of unseen names go.
4. *Remaining suffixes.*  What is left are windows whose place relative to a
   sample is known; they are named whole, and equal neighbours in name order
   are the repeats.  Removed bytes are the union of all repeated windows.

Names are hashes of byte strings (128 bits where equality decides, 64 where it
only rules out), counted by aggregations with partial sums in each task, so a
string in a third of all documents is as cheap as any.  Only places near the
ends of repeats reach step 4.  Between the steps a table of 2**24 bits tells
the tasks which names to look at; it can let too much pass, never too little.

Inputs: null and empty texts have no bytes.  Repeated rows are documents of
their own and repeat each other.  Texts shorter than ``L`` stay whole.  Empty
tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bit_table, key_text, maybe_in, mix, row_groups, saved, signed, text_buffer

L = 400
COMBINE = 500_000  # names that a task holds to combine equal ones before the shuffle
PIECE = 4 << 20  # longer rows are read in pieces that overlap by L - 1 bytes
_U = np.uint64
_LOW = _U((1 << 24) - 1)


class _Hash:
    """Hashes of substrings of one buffer, modulo 2**64."""

    _tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, which: int):
        n = len(data) + 1
        if which not in self._tables or len(self._tables[which][0]) < n:
            size = max(n, 1 << 20)
            mult = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)[which] | 1
            tables = []
            for base in (mult, pow(mult, -1, 1 << 64)):
                t = np.full(size, base, _U)
                t[0] = 1
                tables.append(np.cumprod(t))
            self._tables[which] = (*tables, mix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95 + 2 * which)))
        up, self.down, letters = self._tables[which]
        self.total = np.zeros(n, _U)
        np.cumsum(letters[data] * up[:n - 1], out=self.total[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Names of [start, stop), their lengths included."""
        return mix((self.total[stop] - self.total[start]) * self.down[start] +
                   (stop - start).astype(_U) * _U(0xA24BAED4963EE407))

    def grams(self, k: int) -> np.ndarray:
        n = len(self.total) - k
        return mix((self.total[k:] - self.total[:n]) * self.down[:n])


class Runs:
    """Runs of windows with the same sample, for whole rows or a piece of one row.

    ``row``, ``first`` and ``last`` window start (in the buffer), ``sample``
    (its place) and ``core`` (name of its K bytes).
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray, length: int, k: int):
        self.data, self.bounds, self.hash = data, bounds, _Hash(data, 0)
        n, w = len(data) - length + 1, length - k + 1
        if n <= 0:
            self.row = self.first = self.last = self.sample = np.zeros(0, np.int64)
            self.core = np.zeros(0, _U)
            return
        grams = self.hash.grams(k)
        # Least hash and, among equal ones, least place: content decides alike in every copy.
        key = (grams & ~_LOW) | np.arange(len(grams), dtype=_U)
        blocks = np.concatenate([key, np.full(-len(key) % w, 2**64 - 1, _U)]).reshape(-1, w)
        ahead = np.minimum.accumulate(blocks, 1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
        place = (np.minimum(behind[:n], ahead[w - 1:w - 1 + n]) & _LOW).astype(np.int64)
        row = np.searchsorted(bounds, np.arange(n), "right") - 1
        inside = np.arange(n) + length <= bounds[row + 1]
        new = np.empty(n, bool)
        new[0] = True
        new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
        start = np.flatnonzero(inside & new)
        tail = np.empty(n, bool)
        tail[-1] = True
        tail[:-1] = new[1:] | ~inside[1:]
        self.first, self.last = start, np.flatnonzero(inside & tail)
        self.row, self.sample = row[start], place[start]
        self.core = grams[self.sample]


def pieces(column: pa.Array, length: int) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, byte offset in the row, bytes, bounds) with every window in exactly one piece."""
    data, offsets = text_buffer(column)
    for lo, hi in row_groups(offsets):
        a, b = int(offsets[lo]), int(offsets[hi])
        if hi - lo > 1 or b - a <= PIECE:
            yield lo, hi, 0, data[a:b], offsets[lo:hi + 1] - a
        else:
            for at in range(0, max(1, b - a - length + 1), PIECE):
                part = data[a + at:min(b, a + at + PIECE + length - 1)]
                yield lo, hi, at, part, np.array([0, len(part)])


def _unique(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    if not len(columns[0]):
        return columns, np.zeros(0, np.int64)
    order = np.lexsort(columns[::-1])
    sorted_ = [c[order] for c in columns]
    new = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in sorted_], axis=0)])
    at = np.flatnonzero(new)
    return [c[at] for c in sorted_], np.diff(np.concatenate([at, [len(order)]]))


def _samples(length: int, k: int):
    """Rows (r1, r2, text) -> names of the samples' K bytes, with the task's counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            (core,), count = _unique([np.concatenate(held)])
            return pa.RecordBatch.from_arrays([pa.array(signed(core)), pa.array(count)], ["core", "n"])
        for batch in batches:
            held += [Runs(data, bounds, length, k).core for _, _, _, data, bounds in pieces(batch.column(2), length)]
            if sum(map(len, held)) >= COMBINE:
                yield out()
                held = []
        if held:
            yield out()
    return run


def _triples(length: int, k: int, wanted: bytes):
    """Rows -> one row per row and triple whose sample may be shared: where its runs start, and its names."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, at, data, bounds in pieces(batch.column(2), length):
                r = Runs(data, bounds, length, k)
                keep = np.flatnonzero(maybe_in(wanted, r.core))
                if not len(keep):
                    continue
                first, last, row, core = r.first[keep], r.last[keep], r.row[keep], r.core[keep]
                one, two = _triple(r, first, last, r.sample[keep], length)
                order = np.lexsort((first, two, one, core, row))
                same = [c[order] for c in (row, core, one, two)]
                new = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in same], axis=0)]))
                begin = (first - bounds[row] + at)[order]
                starts = pa.ListArray.from_arrays(pa.array(np.append(new, len(order)).astype(np.int32)), pa.array(begin))
                row, core, one, two = (c[new] for c in same)
                where = pa.array(row + lo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(where), batch.column(1).take(where), starts,
                     pa.array((last - first + 1)[order][new].astype(np.int32)),
                     pa.array(signed(core)), pa.array(signed(one)), pa.array(signed(two))],
                    ["r1", "r2", "starts", "size", "core", "one", "two"])
    return run


def _triple(r: Runs, first: np.ndarray, last: np.ndarray, sample: np.ndarray, length: int):
    """128-bit name of the triple: bytes before, at and after the sample, and where it is."""
    second = _Hash(r.data, 1)
    place = (sample - first).astype(_U) * _U(0x9FB21C651E98DF25)
    return mix(r.hash.of(first, last + length) + place), mix(second.of(first, last + length) ^ place)


def _texts(length: int, k: int, wanted: bytes):
    """Rows -> bytes of the runs whose sample may be shared by different triples, mostly once a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            if len(seen) >= COMBINE:
                seen.clear()
            for _, _, _, data, bounds in pieces(batch.column(2), length):
                r = Runs(data, bounds, length, k)
                keep = np.flatnonzero(maybe_in(wanted, r.core))
                if not len(keep):
                    continue
                first, last, sample = r.first[keep], r.last[keep], r.sample[keep]
                one, two = _triple(r, first, last, sample, length)
                fresh = []
                for i, name in enumerate(zip(one.tolist(), two.tolist())):
                    if name not in seen:
                        seen.add(name)
                        fresh.append(i)
                f = np.array(fresh, np.int64)
                text = [data[a:b + length].tobytes() for a, b in zip(first[f].tolist(), last[f].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(one[f])), pa.array(signed(two[f])), pa.array((sample[f] - first[f]).astype(np.int32)),
                     pa.array(text, pa.binary())], ["one", "two", "place", "text"])
    return run


def _by_text(batch: pa.RecordBatch, length: int, part: int) -> Iterator[tuple]:
    """Windows of stored runs: (run, window, part, hashes, window starts, part's shared bytes)."""
    data, offsets = text_buffer(batch.column("text"))
    place = batch.column("place").to_numpy()
    for lo, hi in row_groups(offsets):
        a = int(offsets[lo])
        own, bounds = data[a:int(offsets[hi])], offsets[lo:hi + 1] - a
        size = np.diff(bounds) - length + 1
        run = np.repeat(np.arange(hi - lo), size)
        window = np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size)
        group = (place[lo:hi][run] - window) // part
        sample = bounds[:-1][run] + place[lo:hi][run]
        begin = sample - group * part
        yield run + lo, window, group, own, bounds[:-1][run] + window, begin, begin - part + 1 + length


def _parts(length: int, part: int):
    """Stored runs -> names of the bytes that the windows of each part share."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = np.minimum(batch.column("n").to_numpy(), 2)
            for which, _, group, own, _, begin, end in _by_text(batch, length, part):
                new = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (group[1:] != group[:-1])])) \
                    if len(which) else np.zeros(0, np.int64)
                name = mix(_Hash(own, 0).of(begin[new], end[new]) + group[new].astype(_U))
                yield pa.RecordBatch.from_arrays([pa.array(signed(name)), pa.array(weight[which[new]])], ["core", "n"])
    return run


def _windows(length: int, part: int, wanted: bytes):
    """Stored runs -> names of the windows in parts whose shared bytes may be shared."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = np.minimum(batch.column("n").to_numpy(), 2)
            one, two = batch.column("one"), batch.column("two")
            for which, window, group, own, start, begin, end in _by_text(batch, length, part):
                h = _Hash(own, 0)
                keep = np.flatnonzero(maybe_in(wanted, mix(h.of(begin, end) + group.astype(_U))))
                at, where = start[keep], pa.array(which[keep])
                yield pa.RecordBatch.from_arrays(
                    [one.take(where), two.take(where), pa.array(window[keep].astype(np.int32)),
                     pa.array(weight[which[keep]]), pa.array(signed(h.of(at, at + length))),
                     pa.array(signed(_Hash(own, 1).of(at, at + length)))], ["one", "two", "window", "n", "w1", "w2"])
    return run


def repeated_windows(rows: DataFrame, length: int = L) -> DataFrame:
    """(r1, r2, starts, size): runs of ``size`` repeated windows of rows (r1, r2, text)."""
    k = length * 5 // 8
    part = max(1, (length - k + 1) // 8)
    shared = rows.mapInArrow(_samples(length, k), "core long, n long").groupBy("core").agg(
        F.sum("n").alias("n")).where("n > 1")
    runs = saved(rows.mapInArrow(_triples(length, k, bit_table(shared, "core")),
                                 "r1 long, r2 long, starts array<long>, size int, core long, one long, two long"), "runs")
    names = saved(runs.groupBy("core", "one", "two").agg(F.sum(F.size("starts")).alias("n")), "triples")
    mixed = names.groupBy("core").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least")).where(
        "kinds > 1 and least = 1")
    texts = rows.mapInArrow(_texts(length, k, bit_table(mixed, "core")), "one long, two long, place int, text binary")
    counted = names.join(mixed.select("core"), "core", "left_semi").select("one", "two", "n")
    open_ = saved(texts.groupBy("one", "two").agg(F.first("place").alias("place"), F.first("text").alias("text"))
                  .join(counted, ["one", "two"]), "open-runs")
    cores = open_.select("place", "text", "n").mapInArrow(_parts(length, part), "core long, n long").groupBy("core").agg(
        F.sum("n").alias("n")).where("n > 1")
    windows = saved(open_.mapInArrow(_windows(length, part, bit_table(cores, "core")),
                                     "one long, two long, window int, n long, w1 long, w2 long"), "windows")
    twice = windows.groupBy("w1", "w2").agg(F.sum("n").alias("n")).where("n > 1").select("w1", "w2")
    single = (windows.where("n = 1").join(twice, ["w1", "w2"], "left_semi")
              .groupBy("one", "two").agg(F.collect_set("window").alias("at")))
    whole = runs.join(names.where("n > 1").select("one", "two", "core"), ["core", "one", "two"], "left_semi")
    some = runs.join(single, ["one", "two"])  # such a triple has one run
    return whole.select("r1", "r2", "starts", "size").unionByName(
        some.select("r1", "r2", F.transform("at", lambda x: F.element_at("starts", 1) + x).alias("starts"),
                    F.lit(1).alias("size")))


def _row_hash(*columns: Column) -> list[Column]:
    return [F.xxhash64(*columns).alias("r1"), F.xxhash64(F.lit("second"), *columns).alias("r2")]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compresses the texts for their way through the last join."""
    import zstandard
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        packed = pa.array([pack((t.as_py() or "").encode()) for t in batch.column(3)], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], packed], ["r1", "r2", "key", "packed"])


def _cut(length: int):
    """Rows (key, packed text, runs) -> key, spans removed, bytes kept."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        unpack = zstandard.ZstdDecompressor().decompress
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            n_bytes, spans, kept = [], [], []
            for text, runs in zip(batch.column(1), batch.column(2)):
                data = unpack(text.as_py())
                out, rest, at = [], [], 0
                for r in sorted((x, x + r["size"] - 1 + length) for r in runs.as_py() or [] for x in r["starts"]):
                    if out and r[0] <= out[-1][1]:
                        out[-1][1] = max(out[-1][1], r[1])
                    else:
                        out.append(list(r))
                for a, b in out:
                    rest.append(data[at:a])
                    at = b
                rest.append(data[at:])
                n_bytes.append(len(data))
                spans.append([{"start": a, "stop": b} for a, b in out])
                kept.append(b"".join(rest))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(spans, kind),
                                              pa.array(kept, pa.binary())], ["key", "n_bytes", "spans", "kept"])
    return run


def remove_repeats(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", length: int = L) -> DataFrame:
    """One row per document row: ``key``, ``n_bytes``, ``spans`` (maximal removed
    runs, byte offsets) and ``kept`` (the remaining bytes joined)."""
    rows = key_text(docs, key_col, text_col)
    rows = rows.select(*_row_hash(F.col("key"), F.col("text")), "key", "text")
    runs = repeated_windows(rows.select("r1", "r2", "text"), length).groupBy("r1", "r2").agg(
        F.collect_list(F.struct("starts", "size")).alias("runs"))
    packed = rows.mapInArrow(_pack, "r1 long, r2 long, key long, packed binary")
    return packed.join(runs, ["r1", "r2"], "left").select("key", "packed", "runs").mapInArrow(
        _cut(length), "key long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary")
