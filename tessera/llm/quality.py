"""Text quality by a generalised additive model with pairwise interactions.

Every feature is cut into bins at quantiles of the training rows.  Training is
cyclic boosting: in each round every feature in turn gets a shallow tree over
its bins, fitted to the gradient of the log loss and added, scaled down, to the
feature's lookup table.  The pairs of features that explain most of what is
left then get two-dimensional tables by the same cycle.  A score is the
logistic of a sum of table entries, added up for whole batches at once.

The features come from whole texts: shares of letters, capitals, digits and
symbols, word and line lengths, and how often words, word triples and lines
repeat.

Bounds: the model is fitted on at most about ``per_class`` labelled rows of
each class; scoring covers all documents.

Inputs: null and empty texts have all features 0 and a score like any other.
Without labelled rows of both classes the score is the share of label 1 (0 if
there are none).  Repeated rows each give a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, Words, byte_class, key_text, mix, ngram_hashes, row_groups, text_buffer, training_sample

PER_CLASS = 20_000
BINS = 64
PAIR_BINS = 16
ROUNDS = 150
PAIRS = 8
RATE = 0.1

_LETTER = byte_class(lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
_CLASSES = {
    "upper": byte_class(lambda b: 65 <= b <= 90), "lower": byte_class(lambda b: 97 <= b <= 122),
    "wide": byte_class(lambda b: b >= 192), "digit": byte_class(lambda b: 48 <= b <= 57),
    "blank": byte_class(lambda b: b in (9, 32)), "line": byte_class(lambda b: b == 10),
    "stop": byte_class(lambda b: chr(b) in ".?"), "comma": byte_class(lambda b: chr(b) in ",;:"),
    "shout": byte_class(lambda b: chr(b) == "!"), "bar": byte_class(lambda b: chr(b) in "|/\\_~^="),
    "symbol": byte_class(lambda b: chr(b) in "#$%&*@+"), "bracket": byte_class(lambda b: chr(b) in "()[]{}<>"),
}
_IS_WORD = byte_class(lambda b: b not in (9, 10, 13, 32))
_IS_LINE = byte_class(lambda b: b != 10)
FEATURES = (*_CLASSES, "log_words", "mean_word", "long_word", "mean_line", "lines", "new_words", "new_triples",
            "new_lines", "top_word", "same_word")


def features(column: pa.Array) -> np.ndarray:
    """Matrix (rows x FEATURES) of a string column."""
    data, offsets = text_buffer(column)
    out = [np.zeros((0, len(FEATURES)))]
    for lo, hi in row_groups(offsets):
        a = int(offsets[lo])
        own, bounds = data[a:int(offsets[hi])], offsets[lo:hi + 1] - a
        out.append(_features(own, bounds))
    return np.concatenate(out)


def _per_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return (total[bounds[1:]] - total[bounds[:-1]]).astype(float)


def _distinct(keys: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of each row, and the count of its most frequent key."""
    if not len(keys):
        return np.zeros(rows), np.zeros(rows)
    _, first, count = np.unique(mix(keys + mix(row.astype(np.uint64) + np.uint64(7))), return_index=True,
                                return_counts=True)
    top = np.zeros(rows)
    np.maximum.at(top, row[first], count)
    return np.bincount(row[first], minlength=rows).astype(float), top


def _features(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    rows = len(bounds) - 1
    size = np.maximum(np.diff(bounds), 1).astype(float)
    cols = [_per_row(table[data], bounds) / size for table in _CLASSES.values()]
    low = ASCII_LOWER[data]
    w, lines = Words(low, bounds, _IS_WORD), Words(low, bounds, _IS_LINE)
    n, n_lines = np.diff(w.first).astype(float), np.diff(lines.first).astype(float)
    length = (w.end - w.start).astype(float)
    some = np.maximum(n, 1)
    total = np.bincount(w.row, weights=length, minlength=rows)
    longest = np.zeros(rows)
    np.maximum.at(longest, w.row, length)
    new, top = _distinct(w.hash, w.row, rows)
    triples = ngram_hashes(w.hash, 3, 3)
    inside = w.row[:len(triples)] == w.row[2:2 + len(triples)]
    new3, _ = _distinct(triples[inside], w.row[:len(triples)][inside], rows)
    new_lines, _ = _distinct(lines.hash, lines.row, rows)
    same = np.flatnonzero((w.hash[1:] == w.hash[:-1]) & (w.row[1:] == w.row[:-1]))
    cols += [np.log1p(n), total / some, np.log1p(longest), np.log1p(size / np.maximum(n_lines, 1)), np.log1p(n_lines),
             new / some, new3 / np.maximum(n - 2, 1), new_lines / np.maximum(n_lines, 1), top / some,
             np.bincount(w.row[same], minlength=rows) / some]
    x = np.column_stack(cols)
    x[np.diff(bounds) == 0] = 0.0
    return x


@dataclass
class Model:
    prior: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)
    base: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.base is None:
            return np.full(len(x), self.prior)
        total = np.full(len(x), self.base)
        for j, (cuts, table) in enumerate(zip(self.cuts, self.tables)):
            total += table[np.searchsorted(cuts, x[:, j], "right")]
        if self.pairs:
            coarse = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.pair_cuts)]
            for (i, j), table in zip(self.pairs, self.pair_tables):
                total += table[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _quantiles(x: np.ndarray, bins: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(col, np.arange(1, bins) / bins)) for col in x.T]


def _best_cut(g: np.ndarray, h: np.ndarray, least: float = 5.0) -> tuple[float, int]:
    """Gain and place (cut after bin k) of the best split of binned gradients."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = np.where((hl >= least / 4) & (hr >= least / 4),
                    gl**2 / (hl + 1) + gr**2 / (hr + 1) - g.sum()**2 / (h.sum() + 1), -1.0)
    k = int(gain.argmax()) if len(gain) else -1
    return (float(gain[k]), k) if k >= 0 else (-1.0, -1)


def _shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int = 4) -> np.ndarray:
    """Step function over bins: splits the leaf with the largest gain until there are ``leaves``."""
    cuts = [(0, len(g))]
    while len(cuts) < leaves:
        options = [(_best_cut(g[a:b], h[a:b]), a, b) for a, b in cuts if b - a > 1]
        options = [(gain, k, a, b) for (gain, k), a, b in options if gain > 1e-9]
        if not options:
            break
        _, k, a, b = max(options)
        cuts.remove((a, b))
        cuts += [(a, a + k + 1), (a + k + 1, b)]
    out = np.zeros(len(g))
    for a, b in cuts:
        out[a:b] = -g[a:b].sum() / (h[a:b].sum() + 1)
    return out


def _grid_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Tree over a grid: the cut of either axis that, with the best cut of the other axis in each half, gains most."""
    best, out = -1.0, np.zeros(g.shape)
    for axis in (0, 1):
        gs, hs = (g, h) if axis == 0 else (g.T, h.T)
        # Sums of [first rows or last rows] x [first columns], for every pair of cuts.
        gq, hq = np.cumsum(np.cumsum(gs, 0), 1), np.cumsum(np.cumsum(hs, 0), 1)
        halves = [(gq[:-1], hq[:-1]), (gq[-1] - gq[:-1], hq[-1] - hq[:-1])]
        if not len(halves[0][0]):
            continue
        gains = [a[:, :-1]**2 / (b[:, :-1] + 1) + (a[:, -1:] - a[:, :-1])**2 / (b[:, -1:] - b[:, :-1] + 1)
                 if a.shape[1] > 1 else a**2 / (b + 1) for a, b in halves]
        total = gains[0].max(1) + gains[1].max(1)
        k = int(total.argmax())
        if total[k] > best:
            best, table = float(total[k]), np.zeros(gs.shape)
            for half, gain in zip((slice(0, k + 1), slice(k + 1, None)), gains):
                c = int(gain[k].argmax()) + 1
                for part in (slice(0, c), slice(c, None)):
                    table[half, part] = -gs[half, part].sum() / (hs[half, part].sum() + 1)
            out = table if axis == 0 else table.T
    return out, best


def train(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting of single tables, then of the pairs with the largest remaining gain."""
    m = Model(prior=float(y.mean()) if len(y) else 0.0)
    if not len(y) or m.prior in (0.0, 1.0):
        return m
    m.base = float(np.log(m.prior / (1 - m.prior)))
    m.cuts, m.pair_cuts = _quantiles(x, BINS), _quantiles(x, PAIR_BINS)
    bins = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(m.cuts)]
    m.tables = [np.zeros(len(c) + 1) for c in m.cuts]
    total = np.full(len(y), m.base)

    def gradient() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return p - y, p * (1 - p)
    for _ in range(ROUNDS):
        for j, b in enumerate(bins):
            g, h = gradient()
            n = len(m.tables[j])
            step = RATE * _shallow_tree(np.bincount(b, g, n), np.bincount(b, h, n))
            m.tables[j] += step
            total += step[b]
    coarse = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(m.pair_cuts)]
    wide = [len(c) + 1 for c in m.pair_cuts]

    def grid(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        g, h = gradient()
        cell, shape = coarse[i] * wide[j] + coarse[j], (wide[i], wide[j])
        return tuple(np.bincount(cell, v, wide[i] * wide[j]).reshape(shape) for v in (g, h))
    gains = sorted(((_grid_tree(*grid(i, j))[1], i, j) for i in range(len(bins)) for j in range(i)), reverse=True)
    m.pairs = [(i, j) for _, i, j in gains[:PAIRS]]
    m.pair_tables = [np.zeros((wide[i], wide[j])) for i, j in m.pairs]
    for _ in range(ROUNDS // 3):
        for table, (i, j) in zip(m.pair_tables, m.pairs):
            step = RATE * _grid_tree(*grid(i, j))[0]
            table += step
            total += step[coarse[i], coarse[j]]
    return m


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = features(batch.column(1))
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)),
                                        pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), flat], ["y", "x"])


def fit(docs: DataFrame, labels: DataFrame, key_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", per_class: int = PER_CLASS) -> Model:
    """Train on at most about ``per_class`` labelled documents of each class (feature rows of fixed size reach the
    driver); a document counts once, however often its row occurs."""
    sample = training_sample(labels, label_col, key_col, per_class)
    texts = key_text(docs, key_col, text_col).join(
        F.broadcast(sample), "key").dropDuplicates(["key"]).select("y", "text")
    got = texts.mapInArrow(_feature_rows, "y int, x array<double>").toArrow()
    x = np.asarray(got["x"].combine_chunks().flatten()).reshape(-1, len(FEATURES))
    return train(x, got["y"].to_numpy().astype(float))


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(features(batch.column(1))))],
                                             ["key", "score"])
    return run


def score(docs: DataFrame, model: Model, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: ``key``, ``score``."""
    return key_text(docs, key_col, text_col).mapInArrow(
        _score(model), "key long, score double")
