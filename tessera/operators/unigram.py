"""Unigram vocabularies: seeds from sorted suffixes, EM over lattices, pruning by loss.

All of it stays in Spark tables; the driver sees sums, and the vocabulary at
the end.  Words count once each for the seeds and by their count for the rest.

*Seeds* are the substrings (2 to ``longest`` characters) that stand in two
places or more and would be rarer with any one character more: the inner nodes
of a suffix tree.  The suffixes of all words, cut after ``longest`` + 1
characters and added up, are sorted inside partitions by their first two
characters; a stack over the common prefixes of neighbours gives the nodes, so
a task holds one suffix and the stack, however many suffixes it passes.

*Lattices.*  The places where seeds stand in words are found once: a place is
known by the longest seed that starts there, and the others that start there
are those that this one starts with.  Words lie in blocks; the distinct suffixes
of a block meet the seeds by their first two characters, and the block keeps one
number per character and a tree of its distinct seeds.

*EM.*  Each step runs forward and backward over the lattices of a block, many
words at once, with the present scores of its seeds; every task holds these
scores if there are ``WHOLE`` at most, else they meet the blocks by a join.
Expected counts add up to new scores by the digamma rule, and pieces expected
less than half a time go.

*Pruning.*  The loss of a piece is what the corpus loses in likelihood when the
piece is replaced by the best other way to write it.  Each round keeps the
share ``shrink`` of the pieces with the largest loss, until 1.1 times the
vocabulary is left; the best by score then make the vocabulary.  Characters and
pieces that cannot be written otherwise always stay.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import with_pos, written

LONGEST = 16
EXPECTED_LEAST = 0.5
NONE = float("-inf")


# --- seeds -----------------------------------------------------------------------------
_SEEDS = "piece string, freq long"


def _nodes(longest: int):
    """Sorted (suffix, n) -> (piece, freq) of the inner nodes of their tree, two characters and deeper."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: list[str] = []
        freqs: list[int] = []
        last = ""
        stack: list[list[int]] = []  # [depth, places]: open nodes, prefixes of the last suffix

        def close(depth: int) -> int:
            """Close the nodes deeper than ``depth``; the places of the deepest of them that was closed last."""
            carried = 0
            while stack and stack[-1][0] > depth:
                d, n = stack.pop()
                n += carried
                if n > 1 and 1 < d <= longest:
                    pieces.append(last[:d])
                    freqs.append(n)
                carried = n
            return carried
        for batch in batches:
            for suffix, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                common = 0
                for a, b in zip(last, suffix):
                    if a != b:
                        break
                    common += 1
                carried = close(common)
                if carried:
                    if stack and stack[-1][0] == common:
                        stack[-1][1] += carried
                    elif common > 1:
                        stack.append([common, carried])
                # The suffix itself: a word end after it, or more characters than are looked at, may differ each time.
                stack.append([len(suffix), n])
                last = suffix
                if len(pieces) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.string()), pa.array(freqs, pa.int64())], ["piece", "freq"])
                    pieces.clear()
                    freqs.clear()
        close(-1)
        yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.string()), pa.array(freqs, pa.int64())], ["piece", "freq"])
    return run


def seeds(words: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(piece, freq): substrings of two characters and more in two places or more, none of which a longer one always continues."""
    ends = F.expr(f"transform(sequence(1, length(word) - 1), i -> substring(word, i, {longest + 1}))")
    suffixes = (words.where(F.length("word") > 1).select(F.explode(ends).alias("suffix"))
                .groupBy("suffix").agg(F.count(F.lit(1)).alias("n")))
    n = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (suffixes.repartition(n, F.substring("suffix", 1, 2)).sortWithinPartitions("suffix")
            .mapInArrow(_nodes(longest), _SEEDS))


# --- lattices --------------------------------------------------------------------------
LATTICE_CHARS = 1 << 18  # characters of a block of lattices: some megabytes
SLICE_CHARS = 1 << 16  # characters whose lattices are walked at once
COLLECTED = 1 << 20  # scores that come to the driver at once
WHOLE = 1 << 22  # pieces whose scores a task may hold; the scores of more meet the pieces of a block by a join
FAINT = 1e-250  # likelihoods below are added up as logarithms
_TEXTS = """block long, bucket int, text string, sizes binary, weights binary, heads_at binary, heads array<string>,
 places binary"""


def _bucket(first: int, second: int, buckets: int) -> int:
    return (first * 1_000_003 + second) % buckets


def _cut_texts(longest: int, buckets: int):
    """(word, weight) -> blocks of words, longest first, each with a row per bucket of the distinct heads (``longest``
    characters at most) of their suffixes; ``heads_at`` has the head that starts at each character, -1 at a last one."""
    schema = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("text", pa.string()), ("sizes", pa.binary()),
                        ("weights", pa.binary()), ("heads_at", pa.binary()), ("heads", pa.list_(pa.string())),
                        ("places", pa.binary())])

    def rows(block: int, held: list[tuple[str, float]]) -> pa.RecordBatch:
        held.sort(key=lambda x: -len(x[0]))
        words = [w for w, _ in held]
        sizes = np.array([len(w) for w in words], np.int32)
        coded = pa.array([w[i:i + longest] for w in words for i in range(len(w) - 1)], pa.string()).dictionary_encode()
        at = np.full(int(sizes.sum()), -1, np.int32)
        last = np.zeros(len(at), bool)
        last[np.cumsum(sizes) - 1] = True
        at[~last] = coded.indices.to_numpy()
        bucket = np.array([_bucket(ord(h[0]), ord(h[1]), buckets) for h in coded.dictionary.to_pylist()], np.int64)
        places = np.argsort(bucket, kind="stable")
        here, starts = np.unique(bucket[places], return_index=True)
        ends = [0, *starts.tolist(), len(places)]  # the row of the block itself has no heads
        n = len(here)
        first = [True] + [False] * n
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), coded.dictionary.take(pa.array(places)))
        only = lambda x: pa.array([x] + [None] * n)
        return pa.RecordBatch.from_arrays([
            pa.array([block] * (n + 1), pa.int64()), pa.array([None, *here.tolist()], pa.int32()), only("".join(words)),
            only(sizes.tobytes()), only(np.array([x for _, x in held], np.float64).tobytes()), only(at.tobytes()), lists,
            pa.array([None if f else places[i:j].astype(np.int32).tobytes() for f, i, j in zip(first, ends[:-1], ends[1:], strict=True)],
                     pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, n = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for word, weight in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if n and n + len(word) > LATTICE_CHARS:
                    yield rows(block, held)
                    block, held, n = block + 1, [], 0
                held.append((word, weight))
                n += len(word)
        if held:
            yield rows(block, held)
    return run


def _numbers(column, kind=np.int32) -> np.ndarray:
    """The numbers in the binaries of a column."""
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in column] or [np.empty(0, kind)])


def _match(key: pa.DataType):
    """Heads of blocks and the pieces (piece, key) of a bucket -> per block the longest piece that each head starts
    with (``tops``: -1 for none), and these pieces with all that they start with: keys, and the longest shorter one."""
    schema = pa.schema([("block", pa.int64()), ("places", pa.binary()), ("tops", pa.binary()), ("keys", pa.list_(key)),
                        ("parents", pa.binary()), ("depths", pa.binary()), ("firsts", pa.binary())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names, keys = right.column("piece").to_pylist(), right.column("key").combine_chunks()
        number = {p: i for i, p in enumerate(names)}
        deepest = max(map(len, names), default=0)

        def longest(head: str, most: int) -> int:
            for k in range(min(most, deepest), 1, -1):
                i = number.get(head[:k])
                if i is not None:
                    return i
            return -1
        parents = np.array([longest(p, len(p) - 1) for p in names], np.int32)
        depths, firsts = np.array([len(p) for p in names], np.int32), np.array([ord(p[0]) for p in names], np.int32)
        lists = left.column("heads").combine_chunks() if left.num_rows else pa.array([], pa.list_(pa.string()))
        coded = lists.flatten().dictionary_encode()
        heads = np.array([longest(h, len(h)) for h in coded.dictionary.to_pylist()], np.int32)[coded.indices.to_numpy()]
        ends = np.cumsum([0, *pc.list_value_length(lists).to_pylist()]).tolist()
        out, found = [], [keys[:0]]
        for block, places, i, j in zip(left.column("block").to_pylist(), left.column("places").to_pylist(),
                                       ends[:-1], ends[1:], strict=True):
            tops = heads[i:j]
            there = np.zeros(len(names) + 1, bool)  # the last: none
            new = np.unique(tops)
            while len(new):
                there[new] = True
                new = np.unique(parents[new[new >= 0]])
                new = new[~there[new]]
            there[-1] = False
            here = np.flatnonzero(there)
            renumbered = np.full(len(names) + 1, -1, np.int32)
            renumbered[here] = np.arange(len(here))
            found.append(keys.take(pa.array(here)))
            out.append([block, places, renumbered[tops].tobytes(), renumbered[parents[here]].tobytes(),
                        depths[here].tobytes(), firsts[here].tobytes()])
        cols = list(zip(*out, strict=True)) or [()] * 6
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([len(x) for x in found]), pa.int32()), pa.concat_arrays(found))
        return pa.table([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:3]), lists,
                         *(pa.array(c, pa.binary()) for c in cols[3:])], schema=schema)
    return run


def _assemble(letters: dict[int, object], key: pa.DataType):
    """A block and what the buckets found for it -> its lattices: the longest piece at each character, and the pieces,
    shorter ones first, each with the longest shorter one that it starts with."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for i in range(left.num_rows):
            chars = np.frombuffer(left.column("text")[i].as_py().encode("utf-32-le"), np.int32)
            at = _numbers(left.column("heads_at").slice(i, 1))
            alphabet = np.array([c for c in np.unique(chars).tolist() if c in letters], np.int32)

            def letter(c: np.ndarray) -> np.ndarray:
                k = np.searchsorted(alphabet, c)
                return np.where(np.append(alphabet, -1)[k] == c, k, -1).astype(np.int32)
            bases = np.cumsum([len(alphabet), *(len(x) for x in right.column("keys"))])
            parents, tops = [np.full(len(alphabet), -1, np.int32)], np.full(int(at.max(initial=-1)) + 1, -1, np.int32)
            for base, p, t, f, places in zip(bases[:-1].tolist(), *(right.column(c) for c in (
                    "parents", "tops", "firsts", "places")), strict=True):
                p, t, f, places = (np.frombuffer(x.as_buffer(), np.int32) for x in (p, t, f, places))
                parents.append(np.where(p < 0, letter(f), p + base).astype(np.int32))
                tops[places] = np.where(t < 0, -1, t + base)
            top = np.append(tops, -1)[at]
            top = np.where(top < 0, letter(chars), top)
            parents = np.concatenate(parents)
            depths = np.concatenate([np.ones(len(alphabet), np.int32), _numbers(right.column("depths"))])
            keys = pa.concat_arrays([pa.array([letters[c] for c in alphabet.tolist()], key),
                                     *(x.values for x in right.column("keys"))])
            order = np.argsort(depths, kind="stable")
            place = np.full(len(order) + 1, -1, np.int32)  # the last: none
            place[order] = np.arange(len(order))
            out.append([left.column("block")[i].as_py(), left.column("sizes")[i].as_py(), left.column("weights")[i].as_py(),
                        place[top].tobytes(), place[parents[order]].tobytes(), depths[order].tobytes(),
                        keys.take(pa.array(order))])
        cols = list(zip(*out, strict=True)) or [()] * 7
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, cols[6])]), pa.int32()),
                                         pa.concat_arrays([pa.array([], key), *cols[6]]))
        return pa.table([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:6]), lists],
                        ["block", "sizes", "weights", "tops", "parents", "depths", "keys"])
    return run


def edges(strings: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """The lattices of ``strings`` (word, weight), written: all places where ``pieces`` (piece, and id if they have one)
    of ``longest`` characters at most stand.

    Strings lie in blocks.  A block keeps the longest piece at each of its characters, and its distinct pieces as a
    tree: the others at that character are those that the longest one starts with.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    spark = strings.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(4 * parts, 4096)
    texts = written(strings.where(F.length("word") > 0).select("word", F.col("weight").cast("double").alias("weight"))
                    .repartition(parts).mapInArrow(_cut_texts(longest, buckets), _TEXTS), "texts")
    pieces = pieces.where(F.length("piece") <= longest).select(
        "piece", F.col("id" if "id" in pieces.columns else "piece").alias("key"))
    kind, key = pieces.schema["key"].dataType.simpleString(), to_arrow_type(pieces.schema["key"].dataType)
    letters = {ord(r["piece"]): r["key"] for r in pieces.where(F.length("piece") == 1).collect()}  # the alphabet at most
    first, second = (F.ascii(F.substring("piece", i, 1)).cast("long") for i in (1, 2))
    several = pieces.where(F.length("piece") > 1).select(
        F.pmod(first * 1_000_003 + second, F.lit(buckets)).cast("int").alias("bucket"), "piece", "key")
    found = (texts.where("bucket is not null").select("bucket", "block", "heads", "places").groupBy("bucket")
             .cogroup(several.groupBy("bucket"))
             .applyInArrow(_match(key), f"block long, places binary, tops binary, keys array<{kind}>, parents binary, "
                                        "depths binary, firsts binary"))
    return written(texts.where("bucket is null").select("block", "text", "sizes", "weights", "heads_at").groupBy("block")
                   .cogroup(found.groupBy("block"))
                   .applyInArrow(_assemble(letters, key), "block long, sizes binary, weights binary, tops binary, "
                                                          f"parents binary, depths binary, keys array<{kind}>"), "lattices")


class _Slice:
    """Lattices of some strings, the longest first: row l - 1 of ``table`` has the pieces of l characters, by their
    start and then by the string, as the values given for them; ``cells`` and ``nodes`` list them."""

    def __init__(self, sizes: np.ndarray, tops: np.ndarray, up: np.ndarray, depths: np.ndarray, values: np.ndarray,
                 absent: float):
        self.sizes, self.n, self.most = sizes, len(sizes), int(sizes[0])
        self.reach = np.searchsorted(-sizes, -np.arange(self.most + 2), side="right")  # strings of t characters and more
        self.at = np.concatenate([[0], np.cumsum(self.reach[1:])])  # of the first string's cell, by start
        self.wide = int(depths[-1]) if len(depths) else 0
        start = np.repeat(np.arange(self.most), self.reach[1:-1])
        flat = np.arange(len(tops))
        which = flat - self.at[start]
        node = tops[(np.cumsum(sizes) - sizes)[which] + start]
        cells, nodes = [], []
        while len(node):
            there = node >= 0
            node, flat = node[there], flat[there]
            nodes.append(node)
            cells.append((depths[node] - 1) * np.int64(len(tops)) + flat)
            node = up[node]
        self.cells, self.nodes = (np.concatenate([np.empty(0, np.int64), *x]) for x in (cells, nodes))
        self.table = np.full((self.wide, len(tops)), absent)
        self.table.ravel()[self.cells] = values[self.nodes]

    def row(self, start: int, size: int) -> slice:
        """The cells of a row of ``table`` for the strings that have ``size`` characters from ``start``."""
        return slice(self.at[start], self.at[start] + self.reach[start + size])

    def edges(self, i: int) -> list[tuple[int, int, int]]:
        """(start, size, node) of the i-th string's pieces, by start and size."""
        start = np.searchsorted(self.at, self.cells % self.table.shape[1], side="right") - 1
        mine = (self.cells % self.table.shape[1]) - self.at[start] == i
        size = self.cells[mine] // self.table.shape[1] + 1
        return sorted(zip(start[mine].tolist(), size.tolist(), self.nodes[mine].tolist(), strict=True))


class _Lattices:
    """A block's lattices with the present scores of its pieces (nan: none any more)."""

    def __init__(self, row: dict, score: np.ndarray):
        self.sizes, self.tops, parents, self.depths = (np.frombuffer(row[c].as_buffer(), np.int32) for c in (
            "sizes", "tops", "parents", "depths"))
        self.weights, self.keys, self.score = np.frombuffer(row["weights"].as_buffer(), np.float64), row["keys"].values, score
        alive = np.append(~np.isnan(score), False)
        self.up = np.full(len(parents), -1, np.int32)  # the longest piece left that a piece starts with
        level = np.searchsorted(self.depths, np.arange(1, (int(self.depths[-1]) if len(parents) else 0) + 2))
        for a, b in zip(level[:-1], level[1:], strict=True):
            p = parents[a:b]
            self.up[a:b] = np.where(alive[p], p, np.append(self.up, -1)[p])
        self.top = np.where(alive[self.tops], self.tops, np.append(self.up, -1)[self.tops])

    def slices(self, values: np.ndarray, absent: float, some: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, _Slice]]:
        """(strings, their lattices) with ``values`` of the pieces; ``some``: the strings to look at."""
        ends = np.cumsum(self.sizes, dtype=np.int64)
        some = np.arange(len(self.sizes)) if some is None else some
        done = np.cumsum(self.sizes[some], dtype=np.int64)
        first = 0
        while first < len(some):
            last = max(first + 1, int(np.searchsorted(done, (done[first - 1] if first else 0) + SLICE_CHARS, side="right")))
            who = some[first:last]
            sizes = self.sizes[who]
            own = np.arange(int(sizes.sum())) + np.repeat(ends[who] - np.cumsum(sizes), sizes)
            yield who, _Slice(sizes, self.top[own], self.up, self.depths, values, absent)
            first = last


def lattices(edge: DataFrame, scores, fn, schema: str) -> DataFrame:
    """``fn`` (:class:`_Lattices` -> a table) on every block with the present scores, as :func:`at_hand` gives them;
    pieces without one are left out."""
    if not isinstance(scores, DataFrame):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, values = scores.value
            known = np.full(int(ids.max(initial=-1)) + 2, np.nan)
            known[ids] = values
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {c: batch.column(c)[i] for c in batch.schema.names}
                    keys = np.minimum(row["keys"].values.to_numpy(), len(known) - 1)
                    yield from fn(_Lattices(row, known[keys])).to_batches()
        return edge.mapInArrow(run, schema)
    key = "id" if "id" in scores.columns else "piece"
    found = edge.select(F.col("block").alias("_of"), F.posexplode("keys").alias("_i", key)).join(scores.select(key, "score"), key)

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for i in range(left.num_rows):
            row = {c: left.column(c)[i] for c in left.column_names}
            score = np.full(len(row["keys"]), np.nan)
            score[right.column("_i").to_numpy()] = right.column("score").to_numpy()
            out.append(fn(_Lattices(row, score)))
        return pa.concat_tables(out) if out else fn(None)
    return edge.groupBy("block").cogroup(found.select("_of", "_i", "score").groupBy("_of")).applyInArrow(met, schema)


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def at_hand(scores: DataFrame, count: int):
    """``scores`` (id, score) for :func:`lattices`: a copy for every task, if there are ``WHOLE`` at most."""
    if count > WHOLE:
        yield scores
        return
    spark = scores.sparkSession
    ids, values, parts = [], [], math.ceil(count / COLLECTED) or 1
    for k in range(parts):
        some = scores if parts == 1 else scores.where(F.pmod("id", F.lit(parts)) == k)
        t = some.select(F.col("id").cast("int").alias("id"), "score").toArrow()
        ids.append(t.column("id").to_numpy())
        values.append(t.column("score").to_numpy())
        del t
    copy = spark.sparkContext.broadcast((np.concatenate(ids), np.concatenate(values)))
    del ids, values
    rows = spark.conf.get(_BATCH, None)
    spark.conf.set(_BATCH, "1")  # a block is a row of some megabytes, and a task scans many of them
    try:
        yield copy
    finally:
        spark.conf.unset(_BATCH) if rows is None else spark.conf.set(_BATCH, rows)
        copy.destroy()


def _add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == NONE else a + math.log1p(math.exp(b - a))


def marginals(size: int, starts: list[int], pieces: list[str], scores: list[float]) -> tuple[float, list[float]]:
    """Log likelihood of the string, and how often each edge is expected in it."""
    return _marginals(size, starts, [s + len(p) for s, p in zip(starts, pieces, strict=True)], scores)


def _marginals(size: int, starts: list[int], stops: list[int], scores: list[float]) -> tuple[float, list[float]]:
    ahead, behind = [NONE] * (size + 1), [NONE] * (size + 1)
    ahead[0] = behind[size] = 0.0
    for s, t, x in zip(starts, stops, scores, strict=True):
        if ahead[s] != NONE:
            ahead[t] = _add(ahead[t], ahead[s] + x)
    for s, t, x in zip(reversed(starts), reversed(stops), reversed(scores), strict=True):
        if behind[t] != NONE:
            behind[s] = _add(behind[s], behind[t] + x)
    whole = ahead[size]
    if whole == NONE:
        return NONE, [0.0] * len(starts)
    return whole, [math.exp(min(0.0, ahead[s] + x + behind[t] - whole)) for s, t, x in zip(starts, stops, scores, strict=True)]


def _slice_marginals(lattice: _Slice, weights: np.ndarray, score: np.ndarray) -> tuple[float, np.ndarray]:
    """Weighted log likelihood of a slice made with likelihoods, and its ``nodes``' weighted expected counts."""
    t, reach, wide, most = lattice.table, lattice.reach, lattice.wide, lattice.most
    ahead, behind = [np.ones(lattice.n)], [np.empty(0)] * (most + 1)
    for end in range(1, most + 1):
        here = np.zeros(reach[end])
        for k in range(1, min(wide, end) + 1):
            here += ahead[end - k][:reach[end]] * t[k - 1, lattice.row(end - k, k)]
        ahead.append(here)
    for start in range(most, -1, -1):
        here = np.zeros(reach[start])
        here[reach[start + 1]:] = 1.0
        for k in range(1, min(wide, most - start) + 1):
            here[:reach[start + k]] += t[k - 1, lattice.row(start, k)] * behind[start + k]
        behind[start] = here
    whole = behind[0]
    plain = (whole > FAINT) & np.isfinite(whole)
    likelihood = float(np.sum(weights[plain] * np.log(whole[plain])))
    share = np.divide(weights, whole, out=np.zeros(lattice.n), where=plain)
    for start in range(most):
        mine = np.where(plain[:reach[start]], ahead[start] * share[:reach[start]], 0.0)
        for k in range(1, min(wide, most - start) + 1):
            other = behind[start + k]
            t[k - 1, lattice.row(start, k)] *= mine[:reach[start + k]] * (
                other if plain.all() else np.where(plain[:reach[start + k]], other, 0.0))
    expected = t.ravel()[lattice.cells]
    if plain.all():
        return likelihood, np.bincount(lattice.nodes, expected, len(score))
    counts = np.bincount(lattice.nodes, expected, len(score))
    for i in np.flatnonzero(~plain).tolist():
        mine = lattice.edges(i)
        nodes = np.array([x[2] for x in mine], np.int64)
        logs, e = _marginals(int(lattice.sizes[i]), [x[0] for x in mine], [x[0] + x[1] for x in mine], score[nodes].tolist())
        if logs != NONE:
            likelihood += float(weights[i]) * logs
            np.add.at(counts, nodes, np.array(e) * weights[i])
    return likelihood, counts


def _best_paths(lattice: _Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice made with scores: the likeliest segmentations (string, node), each from its end, and their scores."""
    t, reach, n = lattice.table, lattice.reach, lattice.n
    best, back = [np.zeros(n)], np.zeros((lattice.most + 1, n), np.int32)
    score = np.zeros(n)
    for end in range(1, lattice.most + 1):
        here = np.full(reach[end], NONE)
        for k in range(min(lattice.wide, end), 0, -1):  # the first of the best starts first
            x = best[end - k][:reach[end]] + t[k - 1, lattice.row(end - k, k)]
            better = x > here
            here[better] = x[better]
            back[end, :reach[end]][better] = k
        best.append(here)
        score[reach[end + 1]:reach[end]] = here[reach[end + 1]:]
    number = np.zeros(t.shape, np.int32)
    number.ravel()[lattice.cells] = lattice.nodes
    who = np.flatnonzero(score > NONE)
    end = lattice.sizes[who].astype(np.int64)
    strings, nodes = [np.empty(0, np.int64)], [np.empty(0, np.int32)]
    while len(who):
        size = back[end, who]
        end = end - size
        strings.append(who)
        nodes.append(number[size - 1, lattice.at[end] + who])
        left = end > 0
        who, end = who[left], end[left]
    return np.concatenate(strings), np.concatenate(nodes), score


def _expected(key: str, kind: pa.DataType, viterbi: bool):
    """Lattices -> (key, e, f): (expected or best-path) counts, and the weight of strings that have the piece; a
    null key has the log likelihood."""
    schema = pa.schema([(key, kind), ("e", pa.float64()), ("f", pa.float64())])

    def run(block: _Lattices | None) -> pa.Table:
        if block is None:
            return schema.empty_table()
        count, have, likelihood = np.zeros(len(block.score)), np.zeros(len(block.score)), 0.0
        if viterbi:
            for who, lattice in block.slices(block.score, NONE):
                string, node, _ = _best_paths(lattice)
                weight = block.weights[who]
                count += np.bincount(node, weight[string], len(count))
                once = np.unique(string * len(count) + node)
                have += np.bincount(once % len(count), weight[once // len(count)], len(count))
            rows = np.flatnonzero(count > 0)
        else:
            with np.errstate(all="ignore"):
                values = np.exp(block.score)
                for who, lattice in block.slices(values, 0.0):
                    x, e = _slice_marginals(lattice, block.weights[who], block.score)
                    likelihood += x
                    count += e
            rows = np.flatnonzero((count > 0) | ((block.depths == 1) & ~np.isnan(block.score)))
        keys, e, f = block.keys.take(pa.array(rows)), count[rows], have[rows]
        if not viterbi:
            keys, e, f = pa.concat_arrays([keys, pa.nulls(1, kind)]), np.append(e, likelihood), np.append(f, 0.0)
        return pa.table([keys, e, f], schema=schema)
    return run


def corpus_counts(edge: DataFrame, scores, viterbi: bool = False) -> DataFrame:
    """(piece or id, e, f) over all strings; the row of a null piece holds the log likelihood."""
    from pyspark.sql.pandas.types import to_arrow_type
    key = "piece" if isinstance(scores, DataFrame) and "id" not in scores.columns else "id"
    kind = edge.schema["keys"].dataType.elementType
    return lattices(edge, scores, _expected(key, to_arrow_type(kind), viterbi),
                    f"{key} {kind.simpleString()}, e double, f double").groupBy(key).agg(
        F.sum("e").alias("e"), F.sum("f").alias("f"))


def digamma(x: Column) -> Column:
    """For x > 0: moved up by seven, then the asymptotic series."""
    up = F.lit(0.0)
    for k in range(7):
        up = up + F.lit(1.0) / (x + k)
    y = F.lit(1.0) / (x + 6.5)
    y2 = y * y
    return -up + F.log(x + 6.5) + y2 / 24 - y2 * y2 * (7 / 960) + y2 * y2 * y2 * (31 / 8064) - y2 * y2 * y2 * y2 * (127 / 30720)


# --- training --------------------------------------------------------------------------
# Pieces have numbers: characters the first ones, then the others in their order as strings.
def step(edge: DataFrame, pieces: DataFrame, count: int, letters: int) -> tuple[DataFrame, int, float]:
    """One EM step: new (id, score) and their number, and the log likelihood under the old ones."""
    with at_hand(pieces, count) as scores:
        counts = written(corpus_counts(edge, scores), "expected")
    one = F.col("id") < letters
    kept = counts.where("id is not null").where(one | (F.col("e") >= EXPECTED_LEAST)).select(
        "id", F.when(one, F.greatest("e", F.lit(EXPECTED_LEAST))).otherwise(F.col("e")).alias("e"))
    total, n = kept.agg(F.sum("e"), F.count(F.lit(1))).first()
    likelihood = counts.where("id is null").agg(F.sum("e")).first()[0] or 0.0
    return kept.select("id", (digamma(F.col("e")) - digamma(F.lit(total))).alias("score")), n, likelihood


_OTHERS = "id long, score double, other array<long>"


def _others(block: _Lattices | None) -> pa.Table:
    """Lattices of pieces -> (id, score, other) of those that are their own best way: the best way without them
    (empty: there is none)."""
    schema = pa.schema([("id", pa.int64()), ("score", pa.float64()), ("other", pa.list_(pa.int64()))])
    if block is None:
        return schema.empty_table()
    out = [schema.empty_table()]
    top = block.tops[np.cumsum(block.sizes) - block.sizes]  # a piece starts with nothing longer than itself
    own = block.score[top]
    for who, lattice in block.slices(block.score, NONE, np.flatnonzero(~np.isnan(own))):
        lattice.table[lattice.sizes - 1, np.arange(lattice.n)] = NONE
        string, node, score = _best_paths(lattice)
        better = own[who] >= score
        string, node = string[::-1], node[::-1]
        order = np.argsort(string, kind="stable")
        string, node = string[order], node[order]
        here = better[string]
        sizes = np.bincount(string[here], minlength=lattice.n)[better]
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), block.keys.take(pa.array(node[here])))
        out.append(pa.table([block.keys.take(pa.array(top[who[better]])), own[who[better]], lists], schema=schema))
    return pa.concat_tables(out)


def losses(edge: DataFrame, own_edges: DataFrame, pieces: DataFrame, count: int, strings: float) -> DataFrame:
    """(id, score, loss) of pieces of several characters: what the corpus, ``strings`` by weight, loses without the
    piece (infinite: cannot be spared); those that are not used are left out."""
    with at_hand(pieces, count) as scores:
        used = written(corpus_counts(edge, scores, viterbi=True).where("id is not null"), "used")
        ways = written(lattices(own_edges, scores, _others, _OTHERS), "ways")
    whole = used.agg(F.sum("e")).first()[0] or 1.0
    parts = (ways.where(F.size("other") > 0).join(used.where("e > 0"), "id")
             .select("id", "score", "e", "f", F.explode("other").alias("part"))
             .join(used.select(F.col("id").alias("part"), F.col("e").alias("there")), "part", "left")
             .groupBy("id").agg(F.sum(F.log(F.coalesce("there", F.lit(0.0)) + F.col("e"))).alias("logs"),
                                F.count(F.lit(1)).alias("k"), *(F.first(c).alias(c) for c in ("score", "e", "f"))))
    e, k = F.col("e"), F.col("k")
    mine = F.log(e) - math.log(whole)
    instead = F.col("logs") - k * F.log(F.lit(whole) + e * (k - 1))
    return parts.select("id", "score", (F.col("f") / strings * (mine - instead)).alias("loss")).unionByName(
        ways.where(F.size("other") == 0).select("id", "score", F.lit(float("inf")).alias("loss")))


def prune(edge: DataFrame, own_edges: DataFrame, pieces: DataFrame, count: int, letters: int, strings: float,
          size: int) -> tuple[DataFrame, int]:
    """The ``size`` pieces of the largest loss, and those that cannot be spared, and their number."""
    known = losses(edge, own_edges, pieces, count, strings).unionByName(
        pieces.where(F.col("id") < letters).select("id", "score", F.lit(float("inf")).alias("loss")))
    endless = F.col("loss") == float("inf")
    if count > WHOLE:
        ranked = with_pos(known, [F.col("loss").desc(), "id"], "place")
        kept = written(ranked.where((F.col("place") < size) | endless).select("id", "score"), "pieces")
        return kept, kept.count()
    t = known.select("id", "score", "loss").toArrow()  # no more than the scores that every task holds
    t = t.sort_by([("loss", "descending"), ("id", "ascending")])
    t = t.slice(0, max(size, pc.sum(pc.is_inf(t["loss"])).as_py() or 0)).select(["id", "score"])
    return pieces.sparkSession.createDataFrame(t), t.num_rows


def learn_pieces(counts: DataFrame, size: int, longest: int = LONGEST, em_steps: int = 2, shrink: float = 0.75,
                 log: list[dict] | None = None) -> list[tuple[str, float]]:
    """(piece, score) of a vocabulary of ``size`` (or all characters, if these are more) for (word, count), best
    first; ``log`` gets a row per round: pieces before and after, log likelihood."""
    words = written(counts.where("word != '' and count > 0").select("word", F.col("count").cast("double").alias("weight")),
                    "words")
    chars = words.select(F.explode(F.split("word", "")).alias("piece"), "weight").groupBy("piece").agg(
        F.sum("weight").alias("freq")).where("piece != ''")
    alphabet = sorted((r["piece"], r["freq"]) for r in chars.collect())
    letters = len(alphabet)
    if not letters:
        return []
    found = written(seeds(words, longest).select("piece", (F.col("freq") * F.length("piece")).cast("double").alias("freq")),
                    "seeds")
    numbered = with_pos(found, ["piece"], "id").select((F.col("id") + letters).alias("id"), "piece", "freq").unionByName(
        words.sparkSession.createDataFrame([(i, p, f) for i, (p, f) in enumerate(alphabet)], "id long, piece string, freq double"))
    total, before = numbered.agg(F.sum("freq"), F.count(F.lit(1))).first()
    strings = words.agg(F.sum("weight")).first()[0]
    pieces = numbered.select("id", F.log(F.col("freq") / total).alias("score"))
    size = max(size, letters)
    edge = edges(words, numbered, longest)
    own = edges(numbered.where(F.length("piece") > 1).select(F.col("piece").alias("word"), F.lit(1.0).alias("weight")),
                numbered, longest)
    wanted = max(size, math.ceil(1.1 * size))
    left = before
    while True:
        likelihood = 0.0
        for _ in range(em_steps):
            pieces, left, likelihood = step(edge, pieces, left, letters)
        if log is not None:
            log.append({"before": before, "after": left, "likelihood": likelihood})
        if left <= wanted:
            break
        goal = max(wanted, int(left * shrink))
        after = left
        pieces, left = prune(edge, own, pieces, left, letters, strings, goal)
        before = left
        if left >= after:
            break
    one = F.col("id") < letters
    rest = pieces.where(~one).join(numbered.select("id", "piece"), "id").select("piece", "score").orderBy(
        F.col("score").desc(), "piece").limit(size - letters)
    rows = [(r["piece"], r["score"]) for r in rest.collect()]  # the vocabulary
    rows += [(alphabet[r["id"]][0], r["score"]) for r in pieces.where(one).collect()]
    shift = math.log(sum(math.exp(x) for _, x in rows))  # probabilities of the vocabulary add up to one
    return sorted(((p, x - shift) for p, x in rows), key=lambda x: (-x[1], x[0]))
