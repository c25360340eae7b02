"""Learning pair merges (BPE) over a distributed word table, many merges a round.

The word table has one row per distinct word, as a string of one character per
symbol, and its count.  The rule is sequential: merge the most frequent pair of
neighbours (ties: least left id, then least right id) everywhere, count again.
A round finds a whole run of that sequence at once:

1. *Pair counts*, one aggregate over the word table.
2. *Threshold.*  A pair of old symbols never becomes more frequent, and a pair
   with a merged symbol is at most as frequent as the pair of old symbols that
   it came from.  So as long as the best count is ``floor`` or more, no border
   between two symbols whose pair counts less than ``floor`` is ever merged.
3. *Segments.*  Words are cut at those borders and equal segments are added up:
   few short strings, whatever the number of words.
4. *Run.*  The sequential rule on the segments alone, with pair counts kept up
   to date, gives exactly the merges of the whole table down to ``floor``.
5. *Apply.*  One pass over the word table puts the new symbols in.

What the driver holds is bounded by ``max_pairs`` and ``max_segments``, not by
the corpus: the floor rises until the segments fit (with a single merge, which
needs none, as the last resort) and falls when they are few.  A merge whose
string is already a token, by another path, ends its run, since the counts of
that token's pairs are then not those of the segments alone.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import written

SYMBOL_BASE = 0x10000
MAX_SYMBOLS = 0x10FFFF - SYMBOL_BASE
MAX_PAIRS = 1 << 16
MAX_SEGMENTS = 1 << 16
FIRST_PAIRS = 64  # pairs above the floor of the first round
CHUNK_BYTES = 1 << 22  # of words that a task handles at once


def symbol(i: int) -> str:
    return chr(SYMBOL_BASE + i)


def symbol_id(c: str) -> int:
    return ord(c) - SYMBOL_BASE


_STATE = "s string, count long"


def _batches(rows: Iterator[tuple[str, int]], size: int = 50_000) -> Iterator[pa.RecordBatch]:
    texts: list[str] = []
    counts: list[int] = []
    for text, count in rows:
        texts.append(text)
        counts.append(count)
        if len(texts) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(counts, pa.int64())], ["s", "count"])
            texts, counts = [], []
    yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(counts, pa.int64())], ["s", "count"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int]]:
    for b in batches:
        yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)


def as_symbols(counts: DataFrame, ids: dict[str, int], prefix: str = "") -> DataFrame:
    """(word, count) -> (s, count): one symbol per character, ``prefix`` before all but the first."""
    first = {c: symbol(i) for c, i in ids.items()}
    later = {c[len(prefix):]: symbol(i) for c, i in ids.items() if c.startswith(prefix)} if prefix else first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches((first[w[0]] + "".join([later[c] for c in w[1:]]), n) for w, n in _rows(batches) if len(w) > 1)
    return counts.select("word", F.col("count").cast("long")).mapInArrow(run, _STATE)


def _flat(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The symbols (each four bytes of UTF-8) of all words, one after the other, and where the words begin and end."""
    words = words.cast(pa.string())
    at = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1]
    b = np.frombuffer(words.buffers()[2], np.uint8)[at[0]:at[-1]].reshape(-1, 4).astype(np.int64)
    return (((b[:, 0] & 7) << 18) | ((b[:, 1] & 63) << 12) | ((b[:, 2] & 63) << 6) | (b[:, 3] & 63)) - SYMBOL_BASE, (at - at[0]) // 4


def _strings(symbols: np.ndarray, at: np.ndarray) -> pa.Array:
    """The inverse of :func:`_flat`."""
    c = symbols + SYMBOL_BASE
    b = np.stack([0xF0 | (c >> 18), 0x80 | (c >> 12 & 63), 0x80 | (c >> 6 & 63), 0x80 | (c & 63)], axis=1).astype(np.uint8)
    return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer((at * 4).astype(np.int32)), pa.py_buffer(b))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Symbols, bounds and counts of stretches of words, none of which is empty."""
    held: list[pa.RecordBatch] = []
    size = 0

    def out() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t = pa.Table.from_batches(held).combine_chunks()
        return *_flat(t.column(0).combine_chunks()), t.column(1).to_numpy()
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.column(0).nbytes
        if size >= CHUNK_BYTES:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def _codes(symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
    """At each place the symbol there and the next one as a number; -1 at a word's last place."""
    codes = np.full(len(symbols), -1, np.int64)
    codes[:-1] = (symbols[:-1] << 21) | symbols[1:]
    codes[at[1:] - 1] = -1
    return codes


def _code(pair: str) -> int:
    return (symbol_id(pair[0]) << 21) | symbol_id(pair[1])


def _sums(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.diff(codes, prepend=-1))
    return codes[first], np.add.reduceat(counts, first) if len(first) else counts


def pair_counts(state: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out() -> pa.RecordBatch:
            both = np.stack([codes >> 21, codes & 0x1FFFFF], axis=1).reshape(-1)
            return pa.RecordBatch.from_arrays([_strings(both, np.arange(0, len(both) + 1, 2)), pa.array(sums)], ["pair", "c"])
        for symbols, at, counts in _chunks(batches):
            here = _codes(symbols, at)
            weight, inside = np.repeat(counts, np.diff(at)), here >= 0
            codes, sums = _sums(np.concatenate([codes, here[inside]]), np.concatenate([sums, weight[inside]]))
            if len(codes) > 1 << 20:
                yield out()
                codes, sums = codes[:0], sums[:0]
        yield out()
    return state.mapInArrow(run, "pair string, c long").groupBy("pair").agg(F.sum("c").alias("c"))


def cut_segments(state: DataFrame, pairs: frozenset[str]) -> DataFrame:
    """Longest stretches of the words in which every pair of neighbours is one of ``pairs``, with their counts."""
    hot = np.sort(np.array([_code(p) for p in pairs], np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for symbols, at, counts in _chunks(batches):
            here = _codes(symbols, at)
            ends = np.flatnonzero(hot[np.minimum(np.searchsorted(hot, here), len(hot) - 1)] != here) + 1
            starts = np.concatenate([[0], ends[:-1]])
            long = ends - starts > 1
            segments = _strings(symbols, np.concatenate([[0], ends])).filter(pa.array(long))
            weight = np.repeat(counts, np.diff(at))[starts[long]]
            found = pa.table([segments, pa.array(weight)], ["s", "count"]).group_by("s").aggregate([("count", "sum")])
            yield from found.select(["s", "count_sum"]).rename_columns(["s", "count"]).to_batches()
    return state.mapInArrow(run, _STATE).groupBy("s").agg(F.sum("count").alias("count"))


def put_in(state: DataFrame, merges: Sequence[tuple[str, str]]) -> DataFrame:
    """The words after ``merges`` (pair, new symbol), in order; words of one symbol go.

    Every word takes the earliest merge that it has a pair of, all words at once, until none has any.
    """
    codes = np.array([_code(pair) for pair, _ in merges], np.int64)
    rank_of = np.argsort(codes)
    keys, news, none = codes[rank_of], np.array([symbol_id(new) for _, new in merges], np.int64), len(merges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for symbols, at, counts in _chunks(batches):
            ended = np.zeros(len(counts), bool)
            while len(counts):
                here = _codes(symbols, at)
                i = np.minimum(np.searchsorted(keys, here), none - 1)
                rank = np.where(keys[i] == here, rank_of[i], none)
                best = np.minimum.reduceat(rank, at[:-1])
                size = np.diff(at)
                ended |= best == none
                each = np.repeat(ended, size)
                if ended.any():
                    kept = ended & (size > 1)
                    yield pa.RecordBatch.from_arrays(
                        [_strings(symbols[np.repeat(kept, size)], np.concatenate([[0], np.cumsum(size[kept])])),
                         pa.array(counts[kept])], ["s", "count"])
                    symbols, rank = symbols[~each], rank[~each]
                    best, size, counts = best[~ended], size[~ended], counts[~ended]
                # of places that overlap (a symbol met by itself) every other one, from the left
                hits = np.flatnonzero(rank == np.repeat(best, size))
                fresh = np.diff(hits, prepend=-2) != 1
                run_start = hits[np.maximum.accumulate(np.where(fresh, np.arange(len(hits)), 0))] if len(hits) else hits
                hits = hits[(hits - run_start) % 2 == 0]
                symbols = symbols.copy()
                symbols[hits] = news[rank[hits]]
                stay = np.ones(len(symbols), bool)
                stay[hits + 1] = False
                word = np.repeat(np.arange(len(size)), size)[stay]
                symbols, at = symbols[stay], np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(size)))])
                ended = best == none - 1  # nothing follows the last merge, even if its symbol is an old one
    return state.mapInArrow(run, _STATE)


class Vocabulary:
    """Tokens by id, and how a pair's string becomes a token."""

    def __init__(self, tokens: Sequence[str], prefix: str = ""):
        self.tokens, self.prefix = list(tokens), prefix
        self.ids = {t: i for i, t in enumerate(self.tokens)}
        self.merges: list[tuple[int, int]] = []

    def add(self, a: int, b: int) -> tuple[int, bool]:
        """Id of the merged pair, and whether its string was a token before."""
        right = self.tokens[b]
        text = self.tokens[a] + (right[len(self.prefix):] if self.prefix and right.startswith(self.prefix) else right)
        self.merges.append((a, b))
        known = text in self.ids
        if not known:
            self.ids[text] = len(self.tokens)
            self.tokens.append(text)
        return self.ids[text], known


def run_merges(segments: Sequence[tuple[str, int]], floor: int, size: int, vocab: Vocabulary) -> list[tuple[str, str]]:
    """The sequential rule on segments while the best count is ``floor`` or more and the vocabulary below ``size``."""
    words = [[symbol_id(c) for c in s] for s, _ in segments]
    weight = [n for _, n in segments]
    count: dict[tuple[int, int], int] = defaultdict(int)
    where: dict[tuple[int, int], set[int]] = defaultdict(set)
    for i, w in enumerate(words):
        for p in zip(w, w[1:]):
            count[p] += weight[i]
            where[p].add(i)
    heap = [(-n, p) for p, n in count.items() if n >= floor]
    heapq.heapify(heap)
    done: list[tuple[str, str]] = []
    while heap and len(vocab.tokens) < size:
        n, pair = heapq.heappop(heap)
        if count[pair] != -n:
            if count[pair] >= floor:
                heapq.heappush(heap, (-count[pair], pair))
            continue
        new, known = vocab.add(*pair)
        done.append((symbol(pair[0]) + symbol(pair[1]), symbol(new)))
        if known:
            break
        grown: set[tuple[int, int]] = set()
        for i in where.pop(pair):
            w, k = words[i], weight[i]
            if len(w) < 2:
                continue
            out, j, hit = [], 0, False
            while j < len(w):
                if j + 1 < len(w) and w[j] == pair[0] and w[j + 1] == pair[1]:
                    out.append(new)
                    j, hit = j + 2, True
                else:
                    out.append(w[j])
                    j += 1
            if not hit:
                continue
            for p in zip(w, w[1:]):
                count[p] -= k
            for p in zip(out, out[1:]):
                count[p] += k
                if new in p:
                    where[p].add(i)
                    grown.add(p)
            words[i] = out
        count.pop(pair, None)
        for p in grown:
            if count[p] >= floor:
                heapq.heappush(heap, (-count[p], p))
    return done


def learn_merges(counts: DataFrame, vocab: Vocabulary, size: int, min_count: int = 1, max_pairs: int = MAX_PAIRS,
                 max_segments: int = MAX_SEGMENTS, log: list[dict] | None = None) -> Vocabulary:
    """Extend ``vocab`` (special tokens and alphabet) to ``size`` entries by merges learned on (word, count).
    ``log`` gets a row per round: merges, floor, pairs above it, segments."""
    if size > MAX_SYMBOLS:
        raise ValueError(f"more than {MAX_SYMBOLS} symbols")
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    state = written(as_symbols(counts, vocab.ids, vocab.prefix).repartition(parts, "s"), "words")
    wanted = FIRST_PAIRS
    while len(vocab.tokens) < size:
        top = pair_counts(state).orderBy(F.col("c").desc(), "pair").limit(max_pairs + 1).collect()
        if not top or top[0]["c"] < max(1, min_count):
            break
        if len(top) > max_pairs:  # pairs as frequent as the last may be missing
            sure = [r for r in top if r["c"] > top[-1]["c"]]
        else:
            sure = top
        done: list[tuple[str, str]] = []
        while sure and not done:
            floor = max(min_count, 1, sure[min(wanted, len(sure)) - 1]["c"])
            hot = frozenset(r["pair"] for r in sure if r["c"] >= floor)
            rows = cut_segments(state, hot).limit(max_segments + 1).collect()
            if len(rows) <= max_segments:
                done = run_merges([(r["s"], r["count"]) for r in rows], floor, size, vocab)
            elif floor == sure[0]["c"]:
                break
            else:
                wanted = max(1, wanted // 4)
        if not done:
            a, b = (symbol_id(c) for c in top[0]["pair"])
            done, rows, floor, hot = [(top[0]["pair"], symbol(vocab.add(a, b)[0]))], [], top[0]["c"], frozenset()
        if log is not None:
            log.append({"merges": len(done), "floor": floor, "pairs": len(hot), "segments": len(rows)})
        if len(rows) <= max_segments // 8:
            wanted = min(max_pairs, wanted * 4)
        elif len(rows) <= max_segments // 2:
            wanted = min(max_pairs, wanted * 2)
        state = written(put_in(state, done), "words")
    return vocab
