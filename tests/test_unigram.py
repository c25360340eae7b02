"""Unigram training: seeds and lattices against brute force, likelihood against the public library."""

import json
import math
import os
import random
from collections import Counter

import pytest

from tessera.operators import unigram as ug
from tessera.operators.encode import encode_subword
from tessera.operators.vocab import train_unigram, word_counts
from tessera.session import ensure_checkpoint_dir

tokenizers = pytest.importorskip("tokenizers")
from tokenizers import Tokenizer, models, pre_tokenizers, trainers  # noqa: E402

SF001 = "/root/testdata/sf0.001"


def words_of(seed, n=150, letters="abcd", longest=14):
    r = random.Random(seed)
    return ["".join(r.choice(letters) for _ in range(r.randrange(1, longest))) for _ in range(n)]


@pytest.mark.parametrize("longest", [4, 16])
def test_seeds_are_the_inner_nodes_of_the_suffix_tree(spark, longest):
    words = sorted(set(words_of(1) + ["aaaaaaaaaaaaaaaaaaaaaaaa", "aaaaaaaaaaaaaaaaaaaaaaab", "x" * 40, "日本語日本", "é"]))
    here, after = Counter(), {}
    for w in words:
        for i in range(len(w)):
            for j in range(i + 2, min(len(w), i + longest) + 1):
                here[w[i:j]] += 1
                after.setdefault(w[i:j], []).append(w[j:j + 1])
    want = {s: n for s, n in here.items() if n > 1 and ("" in after[s] or len(set(after[s])) > 1)}
    df = spark.createDataFrame([(w, 1) for w in words], "word string, count long")
    assert {r.piece: r.freq for r in ug.seeds(df, longest).collect()} == want


def splits(word, scores):
    if not word:
        yield ()
    for n in range(1, len(word) + 1):
        if word[:n] in scores:
            for rest in splits(word[n:], scores):
                yield (word[:n], *rest)


def test_lattices_match_all_segmentations(spark):
    words = words_of(2, 40, "ab", 9) + ["abba" * 3, "c"]
    scores = {"a": -1.0, "b": -1.3, "ab": -1.1, "ba": -2.0, "bb": -1.7, "abb": -2.5, "abba": -3.05}
    table = [(i, w, float(1 + i % 3)) for i, w in enumerate(words)]
    strings = spark.createDataFrame(table, "id long, word string, weight double")
    pieces = spark.createDataFrame(list(scores.items()), "piece string, score double")
    edge = ug.edges(strings, pieces, 4)
    expected, used, have, likelihood = Counter(), Counter(), Counter(), 0.0
    for _, w, weight in table:
        ways = [(sum(scores[p] for p in way), way) for way in splits(w, scores)]
        if not ways:
            continue
        z = sum(math.exp(x) for x, _ in ways)
        likelihood += weight * math.log(z)
        for x, way in ways:
            for p in way:
                expected[p] += weight * math.exp(x) / z
        best = max(ways, key=lambda t: t[0])[1]
        used.update({p: weight * n for p, n in Counter(best).items()})
        have.update({p: weight for p in set(best)})
    got = {r.piece: r.e for r in ug.corpus_counts(edge, pieces).collect()}
    assert got.pop(None) == pytest.approx(likelihood)
    assert {p: x for p, x in got.items() if x > 1e-12} == pytest.approx(dict(expected))
    best = {r.piece: (r.e, r.f) for r in ug.corpus_counts(edge, pieces, viterbi=True).collect()}
    assert sum(len(p) * n for p, (n, _) in best.items()) == sum(len(p) * n for p, n in used.items())
    assert set(best) == set(used) and all(best[p] == (used[p], have[p]) for p in used)


def test_digamma(spark):
    got = spark.createDataFrame([(0.5,), (1.0,), (3.25,), (1e6,)], "x double").select("x", ug.digamma(ug.F.col("x")).alias("y"))
    known = {0.5: -1.9635100260214235, 1.0: -0.5772156649015329, 3.25: 1.016990911400146, 1e6: 13.815510057964191}
    for r in got.collect():
        assert r.y == pytest.approx(known[r.x], abs=1e-7)


def likelihood(counts, tokens, scores):
    """Log likelihood of the words; a character without a piece costs ten more than the least score."""
    table, least, total = dict(zip(tokens, scores)), min(scores) - 10, 0.0
    for w, n in counts.items():
        edges = [(i, w[i:j]) for i in range(len(w)) for j in range(i + 1, min(len(w), i + 16) + 1) if w[i:j] in table or j == i + 1]
        total += n * ug.marginals(len(w), [i for i, _ in edges], [p for _, p in edges],
                                  [table.get(p, least) for _, p in edges])[0]
    return total


def test_likelihood_is_the_library_s_or_better(spark, size=300):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").where("doc_id < 12")
    counts = word_counts(docs)
    lib = Tokenizer(models.Unigram())
    lib.pre_tokenizer = pre_tokenizers.Whitespace()
    lib.train_from_iterator([r.text for r in docs.collect()], trainers.UnigramTrainer(
        vocab_size=size, show_progress=False, special_tokens=["<unk>"], unk_token="<unk>"))
    theirs = [(t, s) for t, s in json.loads(lib.to_str())["model"]["vocab"] if t != "<unk>"]
    log = []
    model = train_unigram(counts, size, special_tokens=["<unk>"], log=log)
    ours = [(t, s) for t, s in zip(model.tokens, model.scores) if t != "<unk>"]
    words = {r.word: r["count"] for r in counts.collect()}
    a, b = likelihood(words, *zip(*ours)), likelihood(words, *zip(*theirs))
    assert len(model.tokens) == size and a >= b - 0.01 * abs(b), (a, b)
    assert all(x["after"] <= x["before"] for x in log)
    text = docs.limit(3).collect()
    got = encode_subword(spark.createDataFrame(text), model).collect()
    assert all(r.n_tokens > 0 for r in got)


def test_characters_stay_and_empty_tables(spark):
    assert ug.learn_pieces(spark.createDataFrame([], "word string, count long"), 10) == []
    few = spark.createDataFrame([("ab", 3), ("q", 1), ("", 5), ("日", 2)], "word string, count long")
    got = ug.learn_pieces(few, 2)
    assert {p for p, _ in got} == {"a", "b", "q", "日"}


def test_lattices_and_what_they_are_made_of_take_a_few_bytes_a_character(spark):
    root = ensure_checkpoint_dir(spark).removeprefix("file:")

    def on_disk():
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(root) for f in files if f.endswith(".parquet"))
    words = sorted(set(words_of(3, 6000, "abcdefgh", 24)))
    strings = spark.createDataFrame([(i, w, 1.0) for i, w in enumerate(words)], "id long, word string, weight double")
    pieces = ug.seeds(strings).select("piece").unionByName(spark.createDataFrame([(c,) for c in "abcdefgh"], "piece string"))
    pieces = ug.written(pieces.withColumn("id", ug.F.xxhash64("piece")), "test-pieces")
    before = on_disk()
    assert ug.edges(strings, pieces, 16).count() > 0
    assert on_disk() - before < 40 * sum(map(len, words))


def test_strings_too_unlikely_for_floats(spark):
    scores = {"a": -1.0, "b": -40.0, "ab": -38.0, "ba": -37.5}
    words = ["ab" * 30, "ba" * 400 + "a", "abab", "aab" * 200]
    strings = spark.createDataFrame([(i, w, 2.0 + i) for i, w in enumerate(words)], "id long, word string, weight double")
    pieces = spark.createDataFrame(list(scores.items()), "piece string, score double")
    want, likelihood_of = Counter(), 0.0
    for k, w in enumerate(words):
        places = [(i, w[i:i + n]) for i in range(len(w)) for n in (1, 2) if w[i:i + n] in scores and i + n <= len(w)]
        whole, e = ug.marginals(len(w), [i for i, _ in places], [p for _, p in places], [scores[p] for _, p in places])
        likelihood_of += (2.0 + k) * whole
        for (_, p), x in zip(places, e):
            want[p] += (2.0 + k) * x
    got = {r.piece: r.e for r in ug.corpus_counts(ug.edges(strings, pieces, 2), pieces).collect()}
    assert got.pop(None) == pytest.approx(likelihood_of)
    assert got == pytest.approx(dict(want))


def test_scores_that_no_task_holds_whole(spark, monkeypatch):
    words = words_of(4, 400, "abc", 12) + ["日本語日本", "é"]
    counts = spark.createDataFrame(list(Counter(words).items()), "word string, count long")
    log, joined = [], []
    monkeypatch.setattr(ug, "COLLECTED", 300)
    want = ug.learn_pieces(counts, 40, log=log)
    monkeypatch.setattr(ug, "WHOLE", 0)
    got = ug.learn_pieces(counts, 40, log=joined)
    assert len(log) > 2 and [x["after"] for x in log] == [x["after"] for x in joined]
    assert [p for p, _ in got] == [p for p, _ in want]
    assert [s for _, s in got] == pytest.approx([s for _, s in want])
