"""Toxicity tagging with a linear-chain conditional random field.

Labels exist per document, so tokens are labelled first: over a bounded sample
of labelled documents, the word and word-start features that best explain the
toxic documents are picked greedily (each must hold in few clean documents and
explain toxic documents that nothing picked before explains); tokens with such
a feature in toxic documents are the offending ones.

The CRF has two states (outside, toxic); a token's score is a bias plus the
weights of its word and of its first four and five bytes, and there are weights
for the moves between states.  It is trained by Adam on the exact likelihood of
the labelled token sequences.  Texts outside the sample are tagged by
forward-backward: runs of words without weighted features share one transition
matrix, whose power covers the run, so the work follows the featured words.
Marginals aggregate to a document score (a logistic of the largest marginal's
log odds and of the expected number of toxic tokens) and give the offending
spans (maximal runs of tokens with marginal 1/2 or more, as code points).

Bounds: at most about ``per_class`` labelled documents of each class are used
for training; the model has ``MAX_FEATURES`` weights.  Scoring covers whole
texts of all documents.

Inputs: null and empty texts get the score of a text without toxic words.
Without labelled rows of both classes the score is the share of label 1 (0 if
there are none) and there are no spans.  Repeated rows each give a row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, Words, byte_class, key_text, mix, row_groups, saved, signed, text_buffer, training_sample

PER_CLASS = 3_000
MAX_FEATURES = 4_000
HEADS = (4, 5)
IS_WORD = byte_class(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)
SIDE = 4  # words beside a featured one whose marginals are computed one by one
SEGMENT = 24
DEPTH = 3


@dataclass
class Model:
    prior: float = 0.0
    features: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -10.0
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    head: tuple[float, float, float] | None = None  # of the document score

    def filter_bits(self) -> np.ndarray:
        bits = np.zeros(1 << 18, bool)
        bits[(self.features & np.uint64((1 << 18) - 1)).astype(np.int64)] = True
        return bits


def _featured(words: Words, features: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word index, feature index) of all occurrences of ``features``, by word index."""
    at, which = [], []
    for hashes in (words.hash, *words.heads):
        near = np.flatnonzero(bits[(hashes & np.uint64((1 << 18) - 1)).astype(np.int64)])
        k = np.searchsorted(features, hashes[near])
        ok = (k < len(features)) & (features[np.minimum(k, len(features) - 1)] == hashes[near]) if len(features) else \
            np.zeros(len(near), bool)
        at.append(near[ok])
        which.append(k[ok])
    w, f = np.concatenate(at), np.concatenate(which)
    order = np.argsort(w, kind="stable")
    return w[order], f[order]


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (y, text) -> feature, documents of the class 1 and 0 that have it."""
    for batch in batches:
        data, offsets = text_buffer(batch.column(1))
        y = batch.column(0).to_numpy(zero_copy_only=False)
        for lo, hi in row_groups(offsets, 8 << 20):
            a = int(offsets[lo])
            w = Words(ASCII_LOWER[data[a:int(offsets[hi])]], offsets[lo:hi + 1] - a, IS_WORD, HEADS)
            hashes, row = np.concatenate([w.hash, *w.heads]), np.tile(w.row, 1 + len(w.heads))
            once = np.unique(mix(hashes + mix(row.astype(np.uint64) + np.uint64(1))), return_index=True)[1]
            feature, toxic = hashes[once], y[lo:hi][row[once]] == 1
            values, inverse = np.unique(feature, return_inverse=True)
            ones = np.bincount(inverse, weights=toxic, minlength=len(values)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(values)), pa.array(ones), pa.array(np.bincount(inverse, minlength=len(values)) - ones)],
                ["feature", "ones", "zeros"])


def _sequences(features: np.ndarray):
    """Rows (y, text) -> y, number of words, word and feature indexes of featured words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = Model(features=features).filter_bits()
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for lo, hi in row_groups(offsets):
                a = int(offsets[lo])
                w = Words(ASCII_LOWER[data[a:int(offsets[hi])]], offsets[lo:hi + 1] - a, IS_WORD, HEADS)
                at, which = _featured(w, features, bits)
                cut = np.searchsorted(at, w.first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(w.first).astype(np.int64)),
                     pa.array([(at[s:e] - f).astype(np.int32) for s, e, f in zip(cut[:-1], cut[1:], w.first)],
                              pa.list_(pa.int32())),
                     pa.array([which[s:e].astype(np.int32) for s, e in zip(cut[:-1], cut[1:])], pa.list_(pa.int32()))],
                    ["y", "n", "at", "which"])
    return run


@dataclass
class _Found:
    """Featured words of the sampled documents, flat: document, word and feature of each."""

    y: np.ndarray
    n: np.ndarray
    doc: np.ndarray
    at: np.ndarray
    which: np.ndarray

    def only(self, keep: np.ndarray) -> _Found:
        """The features with ``keep``, renumbered."""
        ok = keep[self.which]
        return _Found(self.y, self.n, self.doc[ok], self.at[ok], (np.cumsum(keep) - 1)[self.which[ok]])


def _pick_seeds(found: _Found, n_features: int) -> np.ndarray:
    """Greedy cover: features that explain toxic documents not yet explained DEPTH times."""
    toxic = found.y[found.doc] == 1
    pair = np.unique(found.which[toxic].astype(np.int64) << 32 | found.doc[toxic])
    feature, doc = pair >> 32, pair & 0xFFFFFFFF
    starts = np.searchsorted(feature, np.arange(n_features + 1))
    order = np.argsort(doc, kind="stable")
    by_doc = np.searchsorted(doc[order], np.arange(len(found.y) + 1))
    gain, left, seeds = np.diff(starts), np.full(len(found.y), DEPTH), []
    least = max(3, 0.005 * (found.y == 1).sum())
    while gain.size and gain[best := int(gain.argmax())] >= least:
        seeds.append(best)
        for d in doc[starts[best]:starts[best + 1]]:
            left[d] -= 1
            if left[d] == 0:
                gain[feature[order[by_doc[d]:by_doc[d + 1]]]] -= 1
        gain[best] = 0
    return np.isin(np.arange(n_features), seeds)


def _labelled(found: _Found, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which featured words are offending, and the features that mostly stand on such words."""
    token = np.unique(found.doc.astype(np.int64) << 32 | found.at, return_inverse=True)[1]
    hot = np.zeros(token.max(initial=-1) + 1, bool)
    np.logical_or.at(hot, token, seed[found.which] & (found.y[found.doc] == 1))
    label = hot[token]
    toxic = found.y[found.doc] == 1
    on = np.bincount(found.which, label, len(seed))
    return label, seed | (on > 0) & (2 * on >= np.bincount(found.which, toxic, len(seed)))


def _spans_around(spots: list[int], n: int) -> Iterator[tuple[int, int]]:
    """Word ranges that hold the featured words ``spots`` with SIDE words on both sides."""
    lo = hi = -1
    for p in spots:
        if hi >= 0 and p - SIDE < hi and p - lo < SEGMENT - SIDE:
            hi = min(n, p + SIDE + 1)
            continue
        if hi >= 0:
            yield lo, hi
        lo, hi = max(0, p - SIDE, hi), min(n, p + SIDE + 1)
    if hi >= 0:
        yield lo, hi


def _segments(found: _Found, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Training sequences: feature indexes per token (padded), labels, lengths, weights.

    Words next to featured ones form segments; all other words are counted as
    background segments of one shape with that many repetitions.
    """
    tokens, labels, background = [], [], int(found.n.sum())
    cut = np.searchsorted(found.doc, np.arange(len(found.y) + 1))
    for d in np.unique(found.doc).tolist():
        by: dict[int, list[int]] = {}
        hot = set()
        for i in range(cut[d], cut[d + 1]):
            by.setdefault(int(found.at[i]), []).append(int(found.which[i]))
            if label[i]:
                hot.add(int(found.at[i]))
        stop = 0
        for lo, hi in _spans_around(sorted(by), int(found.n[d])):
            lo = max(lo, stop)
            tokens.append([by.get(p, []) for p in range(lo, hi)])
            labels.append([int(p in hot) for p in range(lo, hi)])
            background, stop = background - (hi - lo), hi
    tokens.append([[]] * 16)
    labels.append([0] * 16)
    n, t = len(tokens), max(map(len, tokens))
    feat = np.full((n, t, 1 + len(HEADS)), -1, np.int64)
    lab = np.zeros((n, t), np.int64)
    for s, (seq, ys) in enumerate(zip(tokens, labels)):
        lab[s, :len(ys)] = ys
        for p, fs in enumerate(seq):
            feat[s, p, :len(fs)] = fs
    weight = np.ones(n)
    weight[-1] = max(1.0, background / 16)
    return feat, lab, np.array([len(x) for x in tokens]), weight


def _train(feat: np.ndarray, lab: np.ndarray, length: np.ndarray, weight: np.ndarray, n_features: int,
           rounds: int = 80, l2: float = 1e-5) -> tuple[np.ndarray, float, np.ndarray]:
    """Adam on the mean negative log-likelihood; sequences start from and end in the outer state."""
    n, t = lab.shape
    live = np.arange(t)[None, :] < length[:, None]
    theta = np.zeros(n_features + 1 + 3)  # weights, bias, moves 0->1, 1->0, 1->1
    theta[n_features] = -2.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    has = feat >= 0
    total = weight.sum()
    for step in range(1, rounds + 1):
        w, bias = theta[:n_features], theta[n_features]
        move = np.array([[0.0, theta[-3]], [theta[-2], theta[-1]]])
        emit = bias + np.where(has, w[np.maximum(feat, 0)] if n_features else 0.0, 0.0).sum(2)
        alpha, beta = np.zeros((t, n, 2)), np.zeros((t + 1, n, 2))
        prev = np.tile([0.0, -np.inf], (n, 1))
        for p in range(t):
            now = np.logaddexp(prev[:, :1] + move[0], prev[:, 1:] + move[1])
            now[:, 1] += emit[:, p]
            prev = np.where(live[:, p, None], now, prev)
            alpha[p] = prev
        beta[t] = move[:, 0]  # the move back to the outer state after the last token
        for p in range(t - 1, -1, -1):
            nxt = np.zeros((n, 2)) if p + 1 >= t else np.stack([np.zeros(n), emit[:, p + 1]], 1)
            inner = beta[p + 1] + nxt
            got = np.logaddexp(move[:, 0][None] + inner[:, :1], move[:, 1][None] + inner[:, 1:])
            last = (length - 1 == p)[:, None]
            beta[p] = np.where(last, move[:, 0][None], got)
        logz = np.logaddexp(*(alpha[length - 1, np.arange(n), s] + move[s, 0] for s in (0, 1)))
        grad = np.zeros_like(theta)
        post = np.exp(np.minimum(0, alpha[:, :, 1] + beta[:t, :, 1] - logz)).T * live
        gap = (post - lab * live) * weight[:, None]
        np.add.at(grad[:n_features], feat[has], np.broadcast_to(gap[:, :, None], feat.shape)[has])
        grad[n_features] = gap.sum()
        for k, (i, j) in enumerate(((0, 1), (1, 0), (1, 1))):
            want = 0.0
            for p in range(t):
                before = alpha[p - 1, :, i] if p else (np.zeros(n) if i == 0 else np.full(n, -np.inf))
                pair = np.exp(np.minimum(0, before + move[i, j] + emit[:, p] * j + beta[p, :, j] - logz)) * live[:, p]
                y0 = lab[:, p - 1] if p else np.zeros(n, np.int64)
                want += ((pair - ((y0 == i) & (lab[:, p] == j) & live[:, p])) * weight).sum()
            if j == 0:  # the move out of the last token
                end = np.exp(np.minimum(0, alpha[length - 1, np.arange(n), i] + move[i, 0] - logz))
                want += ((end - (lab[np.arange(n), length - 1] == i)) * weight).sum()
            grad[n_features + 1 + k] = want
        grad = grad / total + l2 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta -= 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return theta[:n_features], float(theta[n_features]), np.array([[0.0, theta[-3]], [theta[-2], theta[-1]]])


def marginals(n_words: int, at: list[int], scores: list[float], bias: float, moves: np.ndarray) -> tuple[list, list]:
    """Forward-backward over one text: (word indexes, marginals of the toxic state).

    ``scores`` are the summed weights at the featured words ``at`` (ascending).
    Words up to SIDE beside them are listed too; longer runs are one step.
    """
    special = dict(zip(at, scores))
    listed = sorted({p for a in at for p in range(max(0, a - SIDE), min(n_words, a + SIDE + 1))}) if at else \
        ([0] if n_words else [])
    if not listed:
        return [], []
    move = np.exp(np.clip(moves, -30, 30))
    plain = move * np.array([1.0, np.exp(bias)])[None, :]
    runs: dict[int, tuple] = {}

    def run(k: int) -> tuple:
        """Matrix of k plain words, scaled."""
        if k not in runs:
            out, base, left = np.eye(2), plain / plain.max(), k
            while left:
                if left & 1:
                    out = out @ base
                    out /= out.max()
                base = base @ base
                base /= base.max()
                left >>= 1
            runs[k] = tuple(out.ravel().tolist())
        return runs[k]
    (m00, m01), (m10, m11) = move.tolist()
    emit = [math.exp(min(30.0, max(-30.0, bias + special.get(p, 0.0)))) for p in listed]
    fwd, a0, a1, last = [], 1.0, 0.0, -1
    for p, e in zip(listed, emit):
        if p - last > 1:
            r00, r01, r10, r11 = run(p - last - 1)
            a0, a1 = a0 * r00 + a1 * r10, a0 * r01 + a1 * r11
        a0, a1 = a0 * m00 + a1 * m10, (a0 * m01 + a1 * m11) * e
        s = a0 + a1
        a0, a1, last = a0 / s, a1 / s, p
        fwd.append((a0, a1))
    out = [0.0] * len(listed)
    b0, b1, nxt = m00, m10, n_words
    if n_words - 1 - listed[-1]:
        r00, r01, r10, r11 = run(n_words - 1 - listed[-1])
        b0, b1 = r00 * m00 + r01 * m10, r10 * m00 + r11 * m10
    for i in range(len(listed) - 1, -1, -1):
        if i < len(listed) - 1:
            e = emit[i + 1]
            b0, b1 = m00 * b0 + m01 * e * b1, m10 * b0 + m11 * e * b1
            if (k := nxt - listed[i] - 1) > 0:
                r00, r01, r10, r11 = run(k)
                b0, b1 = r00 * b0 + r01 * b1, r10 * b0 + r11 * b1
            s = b0 + b1
            b0, b1 = b0 / s, b1 / s
        nxt = listed[i]
        x0, x1 = fwd[i][0] * b0, fwd[i][1] * b1
        out[i] = x1 / (x0 + x1) if x0 + x1 > 0 else 0.5
    return listed, out


def _summary(p: list[float]) -> tuple[float, float]:
    top = min(max(max(p, default=0.0), 1e-9), 1 - 1e-9)
    return float(np.log(top / (1 - top))), float(np.log1p(sum(x for x in p if x >= 0.1)))


def fit(docs: DataFrame, labels: DataFrame, key_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", per_class: int = PER_CLASS) -> Model:
    """Train on at most about ``per_class`` labelled documents of each class."""
    sample = training_sample(labels, label_col, key_col, per_class)
    texts = saved(key_text(docs, key_col, text_col).join(F.broadcast(sample), "key").dropDuplicates(["key"]).select("y", "text"), "toxic-sample")
    classes = {r["y"]: r["count"] for r in texts.groupBy("y").count().collect()}
    if len(classes) < 2:
        return Model(prior=float(classes.get(1, 0) > 0))
    least = max(3, classes[1] // 300)
    counted = (texts.mapInArrow(_feature_counts, "feature long, ones long, zeros long")
               .groupBy("feature").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
               .where((F.col("ones") >= least) & (F.col("ones") >= 4 * F.col("zeros")))
               .orderBy(F.desc("ones"), "zeros", "feature").limit(MAX_FEATURES).toPandas())
    feature = np.sort(counted["feature"].to_numpy(np.int64).view(np.uint64))
    got = texts.mapInArrow(_sequences(feature), "y int, n long, at array<int>, which array<int>").toArrow()
    at, which = got["at"].combine_chunks(), got["which"].combine_chunks()
    found = _Found(got["y"].to_numpy(), got["n"].to_numpy(), np.repeat(np.arange(got.num_rows), np.diff(at.offsets)),
                   at.flatten().to_numpy(), which.flatten().to_numpy())
    label, keep = _labelled(found, _pick_seeds(found, len(feature)))
    label, found, feature = label[keep[found.which]], found.only(keep), feature[keep]
    model = Model(prior=classes[1] / sum(classes.values()), features=feature)
    model.weights, model.bias, model.moves = _train(*_segments(found, label), len(feature))
    cut, xs = np.searchsorted(found.doc, np.arange(len(found.y) + 1)), []
    for d in range(len(found.y)):
        own = slice(cut[d], cut[d + 1])
        spots, scores = _sums(found.at[own], model.weights[found.which[own]])
        xs.append(_summary(marginals(int(found.n[d]), spots, scores, model.bias, model.moves)[1]))
    model.head = _logistic(np.array(xs), found.y.astype(float))
    return model


def _sums(at: list[int], weights: np.ndarray) -> tuple[list[int], list[float]]:
    if not len(at):
        return [], []
    spots, inverse = np.unique(np.asarray(at), return_inverse=True)
    return spots.tolist(), np.bincount(inverse, weights=weights).tolist()


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3) -> tuple[float, float, float]:
    """Newton steps for a logistic regression with intercept."""
    z, beta = np.column_stack([np.ones(len(x)), x]), np.zeros(3)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        grad = z.T @ (p - y) / len(y) + l2 * beta
        hess = (z * (p * (1 - p))[:, None]).T @ z / len(y) + l2 * np.eye(3)
        beta -= np.linalg.solve(hess, grad)
    return tuple(beta.tolist())


_TAGGED = "key long, score double, n_words long, spans array<struct<start:int,stop:int,p:double>>"


def _tag(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = model.filter_bits()
        span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("p", pa.float64())]))
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for lo, hi in row_groups(offsets):
                a = int(offsets[lo])
                own = data[a:int(offsets[hi])]
                w = Words(ASCII_LOWER[own], offsets[lo:hi + 1] - a, IS_WORD, HEADS)
                at, which = _featured(w, model.features, bits)
                cut = np.searchsorted(at, w.first)
                scores, spans = [], []
                for i in range(hi - lo):
                    first, n = int(w.first[i]), int(w.first[i + 1] - w.first[i])
                    spots, sums = _sums(at[cut[i]:cut[i + 1]] - first, model.weights[which[cut[i]:cut[i + 1]]])
                    listed, p = marginals(n, spots, sums, model.bias, model.moves)
                    scores.append(_score(model, p))
                    spans.append(_spans(own, w, i, listed, p) if model.head else [])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(scores, pa.float64()),
                     pa.array(np.diff(w.first).astype(np.int64)), pa.array(spans, span)],
                    ["key", "score", "n_words", "spans"])
    return run


def _score(model: Model, p: list[float]) -> float:
    if model.head is None:
        return model.prior
    x = _summary(p)
    b = model.head
    return float(1 / (1 + np.exp(-np.clip(b[0] + b[1] * x[0] + b[2] * x[1], -30, 30))))


def _spans(data: np.ndarray, w: Words, row: int, listed: list[int], p: list[float]) -> list[dict]:
    """Runs of adjacent toxic words as code-point offsets in the row's text."""
    runs: list[list] = []
    for i, q in zip(listed, p):
        if q >= 0.5:
            if runs and runs[-1][1] == i - 1:
                runs[-1][1], runs[-1][2] = i, max(runs[-1][2], q)
            else:
                runs.append([i, i, q])
    if not runs:
        return []
    base, first = int(w.bounds[row]), int(w.first[row])
    points = np.concatenate([[0], np.cumsum((data[base:int(w.bounds[row + 1])] & 0xC0) != 0x80)])
    return [{"start": int(points[w.start[first + s] - base]), "stop": int(points[w.end[first + e] - base]), "p": q}
            for s, e, q in runs]


def tag(docs: DataFrame, model: Model, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: ``key``, ``score``, ``n_words``, ``spans`` of toxic words."""
    return key_text(docs, key_col, text_col).mapInArrow(_tag(model), _TAGGED)


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``, with all their columns."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagged = _tag(model)
        for batch in batches:
            rows = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(at)], ["key", "text"])
            low = [s < threshold for part in tagged(iter([rows])) for s in part.column(1).to_pylist()]
            yield batch.filter(pa.array(low, pa.bool_()))
    return docs.mapInArrow(run, docs.schema)
