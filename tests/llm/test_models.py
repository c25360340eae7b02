import zlib

import numpy as np
import pytest

from tessera.llm import quality, toxicity
from tessera.llm.common import training_sample
from tessera.llm.queries import QUERIES

from .helpers import documents, nasty

SF = "/root/testdata/sf0.1"


def auc(y, s):
    order = np.argsort(np.argsort(s, kind="stable")) + 1
    pos = y == 1
    return (order[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


# Some 6 % of these labels of toxicity contradict the texts.
@pytest.mark.parametrize("name,label,least", [("op2_toxicity", "toxic", 0.92), ("op6_quality", "quality", 0.97)])
def test_held_out_accuracy(spark, name, label, least):
    got = QUERIES[name](spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    assert len(got) == docs and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 5 == 0 for d in got.doc_id]).all()
    test = got.merge(labels, on="doc_id")
    test = test[test.held_out]
    assert len(test) > 500 and auc(test[label].to_numpy(), test.score.to_numpy()) > least
    assert (test.predicted == test[label]).mean() > least


def labelled(spark):
    """200 texts, toxic when a word with the start "vile" occurs; labels with nulls and repeats."""
    import random
    r, rows, labels = random.Random(3), [], []
    for i in range(200):
        bad = i % 3 == 0
        words = [f"w{r.randrange(60)}" for _ in range(r.randrange(20, 60))]
        for _ in range(3 * bad):
            words.insert(r.randrange(len(words)), "vile" + r.choice(["ly", "ness", "r", f"x{i}"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad), int(bad)))
    labels += [(None, 1, 1), (5, None, None), (0, 1, 1), (9999, 1, 1)]
    return rows, spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def test_tagger_finds_spans_and_handles_odd_rows(spark):
    rows, labels = labelled(spark)
    model = toxicity.fit(documents(spark, rows), labels)
    odd = nasty() + [(500, "Wholly Vileness, é vilexyz and w1"), (501, "w1 " * 5000 + "vilely " + "w2 " * 5000)]
    got = {}
    for r in toxicity.tag(documents(spark, odd), model).collect():
        got.setdefault(r.key, []).append(r)
    assert sum(map(len, got.values())) == len(odd)
    text = dict((k, t) for k, t, *_ in odd)
    assert [text[500][s.start:s.stop] for s in got[500][0].spans] == ["Vileness", "vilexyz"]
    assert got[500][0].score > 0.5 and got[501][0].score > 0.5
    assert got[4][0].score < 0.5 and got[4][0].spans == [] and got[5][0].score == got[4][0].score
    kept = toxicity.drop_toxic(documents(spark, odd), model)
    assert kept.count() == sum(r.score < 0.5 for v in got.values() for r in v)
    assert kept.columns == documents(spark, odd).columns


def test_marginals_equal_enumeration():
    import itertools
    bias, moves = -1.3, np.array([[0.0, -0.7], [-0.4, 0.9]])
    for n, at, w in ((1, [], []), (4, [2], [2.5]), (6, [0, 5], [1.0, 3.0]), (13, [1], [2.0])):
        total, mass = 0.0, np.zeros(n)
        for ys in itertools.product((0, 1), repeat=n):
            path = [0, *ys, 0]
            s = sum(moves[a, b] for a, b in zip(path[:-1], path[1:]))
            s += sum(bias + dict(zip(at, w)).get(i, 0.0) for i in range(n) if ys[i])
            total += np.exp(s)
            mass += np.exp(s) * np.array(ys)
        listed, p = toxicity.marginals(n, at, w, bias, moves)
        assert np.allclose(p, (mass / total)[listed])


@pytest.mark.parametrize("op,label", [(toxicity, "toxic"), (quality, "quality")])
def test_without_labels_of_both_classes(spark, op, label):
    docs = documents(spark, nasty())
    score = toxicity.tag if op is toxicity else quality.score
    for rows, want in (([], 0.0), ([(i, 1) for i in range(20)], 1.0), ([(1, None)], 0.0)):
        labels = spark.createDataFrame(rows, f"doc_id long, {label} int")
        got = score(docs, op.fit(docs, labels)).collect()
        assert len(got) == len(nasty()) and {r.score for r in got} == {want}
    assert score(documents(spark, []), op.fit(documents(spark, []), labels)).count() == 0


def test_sample_is_bounded_and_leaves_the_test_fold_out(spark):
    labels = spark.range(20_000).selectExpr("id as doc_id", "cast(id % 10 = 0 as int) as toxic")
    got = [(r.key, r.y) for r in training_sample(labels, "toxic", "doc_id", 500).collect()]
    assert all(zlib.crc32(str(k).encode()) % 5 for k, _ in got)
    assert all(300 < sum(y == c for _, y in got) < 700 for c in (0, 1))


def test_additive_model_needs_its_pairs():
    r = np.random.default_rng(0)
    x = r.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality.train(x[:3000], y[:3000])
    assert (1, 0) in m.pairs and ((m.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95


def test_quality_features_of_odd_texts(spark):
    import pyarrow as pa
    texts = [t for _, t, *_ in nasty()]
    x = quality.features(pa.array(texts))
    assert x.shape == (len(texts), len(quality.FEATURES)) and np.isfinite(x).all()
    assert (x[4] == 0).all() and (x[5] == 0).all()
    f = dict(zip(quality.FEATURES, quality.features(pa.array(["Aa bb, bb!\nAa 12"]))[0]))
    assert f["upper"] == 2 / 16 and f["digit"] == 2 / 16 and f["same_word"] == 0 and f["new_words"] == 4 / 5
    assert np.array_equal(quality.features(pa.array(texts[3:])), x[3:])
