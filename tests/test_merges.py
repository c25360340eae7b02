"""Merges learned in rounds against the sequential rule and the public tokenizer library."""

import json
import random
from collections import Counter

import pytest

from tessera.operators import merges as mg
from tessera.operators.vocab import train_subword, word_counts

tokenizers = pytest.importorskip("tokenizers")
from tokenizers import Tokenizer, models, pre_tokenizers, trainers  # noqa: E402

SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def sequential(words, alphabet, size, least, prefix=""):
    """The rule, one merge at a time, on {word: count}."""
    vocab = mg.Vocabulary(alphabet, prefix)
    table = [([vocab.ids[prefix * (i > 0) + c] for i, c in enumerate(w)], n) for w, n in words.items()]
    while len(vocab.tokens) < size:
        pairs = Counter()
        for w, n in table:
            for p in zip(w, w[1:]):
                pairs[p] += n
        best = min(pairs, key=lambda p: (-pairs[p], p), default=None)
        if best is None or pairs[best] < least:
            break
        new, _ = vocab.add(*best)
        for w, _ in table:
            i = 0
            while i + 1 < len(w):
                if (w[i], w[i + 1]) == best:
                    w[i:i + 2] = [new]
                i += 1
    return vocab


def corpus(seed, letters="abc", n=60, longest=9):
    r = random.Random(seed)
    out = {}
    for _ in range(n):
        out["".join(r.choice(letters) for _ in range(r.randrange(1, longest)))] = r.choice([1, 2, 3, 50, 700])
    return out


@pytest.mark.parametrize("seed,letters,limits", [
    (1, "abc", {}), (2, "ab", {"max_segments": 6}), (3, "a", {}), (4, "abcdef", {"max_pairs": 5, "max_segments": 20}),
    (5, "ab", {"max_segments": 1, "max_pairs": 1})])
def test_rounds_equal_the_sequential_rule(spark, seed, letters, limits):
    words = corpus(seed, letters)
    df = spark.createDataFrame(list(words.items()), "word string, count long")
    for size, least in ((26, 1),):
        want = sequential(words, sorted(letters), size, least)
        log = []
        got = mg.learn_merges(df, mg.Vocabulary(sorted(letters)), size, least, log=log, **limits)
        assert (got.merges, got.tokens) == (want.merges, want.tokens)
        assert sum(x["merges"] for x in log) == len(want.merges)


def test_a_token_reached_by_two_paths(spark):
    """"abc" comes from ab + c and from a + bc; counts of its pairs then come from both."""
    words = {"xab": 90, "abc": 50, "bcd": 60, "ebc": 55, "abcq": 9, "zbc": 70, "aabc": 41, "abcabc": 40, "qabcq": 8}
    df = spark.createDataFrame(list(words.items()), "word string, count long")
    alphabet = sorted({c for w in words for c in w})
    want = sequential(words, alphabet, 40, 1)
    got = mg.learn_merges(df, mg.Vocabulary(alphabet), 40, 1)
    assert got.merges == want.merges and got.tokens == want.tokens


@pytest.mark.parametrize("size,limits", [(5000, {}), (700, {"max_segments": 400})])
def test_large_vocabulary_equals_the_library(spark, size, limits):
    docs = spark.read.parquet(f"{SF01 if size > 1000 else SF001}/documents.parquet")
    counts = word_counts(docs)
    lib = Tokenizer(models.BPE())
    lib.pre_tokenizer = pre_tokenizers.Whitespace()
    lib.train_from_iterator([r.text for r in docs.select("text").collect()],
                            trainers.BpeTrainer(vocab_size=size, min_frequency=2, show_progress=False))
    alphabet = sorted({c for r in counts.select("word").collect() for c in r.word})
    log = []
    got = mg.learn_merges(counts, mg.Vocabulary(alphabet), size, 2, log=log, **limits)
    assert [list(x) for x in json.loads(lib.to_str())["model"]["merges"]] == [
        [got.tokens[a], got.tokens[b]] for a, b in got.merges]
    assert all(x["segments"] <= limits.get("max_segments", mg.MAX_SEGMENTS) for x in log)
    assert len(log) < len(got.merges) / 10  # far fewer rounds than merges


def _library_wordpiece(texts, size):
    lib = Tokenizer(models.WordPiece(unk_token="[UNK]"))
    lib.pre_tokenizer = pre_tokenizers.Whitespace()
    lib.train_from_iterator(texts, trainers.WordPieceTrainer(vocab_size=size, special_tokens=["[UNK]"], show_progress=False))
    return set(lib.get_vocab())


def test_wordpiece_equals_the_sequential_rule_and_the_library(spark):
    """The library numbers continuation characters in the order of a hash table that differs from run to run, so
    pairs of equal count come in any order there: its own runs differ by as much as ours differs from them."""
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").where("doc_id < 60")
    texts = [r.text for r in docs.collect()]
    counts = word_counts(docs)
    words = {r.word: r["count"] for r in counts.collect()}
    first = sorted({c for w in words for c in w})
    later = sorted({c for w in words for c in w[1:]})
    for size in (60, 500):
        model = train_subword(counts, size, special_tokens=["[UNK]"], kind="wordpiece")
        want = sequential(words, ["[UNK]", *first, *("##" + c for c in later)], size, 1, "##")
        assert (model.tokens, model.merges) == (want.tokens, want.merges)
        runs = [_library_wordpiece(texts, size) for _ in range(4)]
        apart = max(len(a ^ b) for a in runs for b in runs)
        assert min(len(set(model.tokens) ^ a) for a in runs) <= apart + size // 100


def test_rounds_write_their_word_tables(spark, monkeypatch):
    """No round's plan grows with those before it."""
    tables, real = [], mg.written
    monkeypatch.setattr(mg, "written", lambda df, name: tables.append(name) or real(df, name))
    df = spark.createDataFrame([("abcdefghijkl" * 2, 3)], "word string, count long")
    log = []
    mg.learn_merges(df, mg.Vocabulary(sorted("abcdefghijkl")), 60, 1, max_segments=1, max_pairs=2, log=log)
    assert len(tables) == len(log) + 1 > 2


def test_nothing_to_merge(spark):
    empty = spark.createDataFrame([], "word string, count long")
    assert mg.learn_merges(empty, mg.Vocabulary(["a"]), 10).merges == []
    assert train_subword(empty, 10, special_tokens=["<pad>"]).tokens == ["<pad>"]
    single = spark.createDataFrame([("a", 5), ("b", 2), ("", 7)], "word string, count long")
    assert train_subword(single, 10).tokens == ["a", "b"]


def test_passes_over_words_equal_those_of_single_words(spark):
    """Pair counts, segments and merges on whole stretches of words, as on one word at a time."""
    r = random.Random(11)
    words = ["".join(mg.symbol(r.randrange(4)) for _ in range(r.randrange(2, 12))) for _ in range(300)] + [mg.symbol(0) * 7]
    rows = [(w, r.choice([1, 5, 1 << 60])) for w in words]
    rows = [(w, n if i else 1 << 60) for i, (w, n) in enumerate(rows)][:40] + [(w, n % 7 + 1) for w, n in rows[40:]]
    state = spark.createDataFrame([(w, n if n < 1 << 59 else (1 << 55) + 1) for w, n in rows], "s string, count long")
    rows = [tuple(x) for x in state.collect()]
    pairs, cut = Counter(), Counter()
    hot = frozenset(mg.symbol(a) + mg.symbol(b) for a, b in [(0, 0), (0, 1), (2, 1), (3, 3)])
    for w, n in rows:
        part = w[0]
        for p in map("".join, zip(w, w[1:])):
            pairs[p] += n
            if p in hot:
                part += p[1]
                continue
            if len(part) > 1:
                cut[part] += n
            part = p[1]
        if len(part) > 1:
            cut[part] += n
    assert {x["pair"]: x["c"] for x in mg.pair_counts(state).collect()} == pairs
    assert {x["s"]: x["count"] for x in mg.cut_segments(state, hot).collect()} == cut
    merges = [(mg.symbol(0) * 2, mg.symbol(4)), (mg.symbol(4) + mg.symbol(1), mg.symbol(5)),
              (mg.symbol(2) + mg.symbol(3), mg.symbol(6)), (mg.symbol(6) * 2, mg.symbol(7)), (mg.symbol(1) * 2, mg.symbol(4))]
    want = Counter()
    for w, n in rows:
        for pair, new in merges:
            w = w.replace(pair, new)
        if len(w) > 1:
            want[w] += n
    got = Counter()
    for x in mg.put_in(state, merges).collect():
        got[x["s"]] += x["count"]
    assert got == want
    assert mg.pair_counts(state.limit(0)).count() == mg.cut_segments(state.limit(0), hot).count() == 0


def test_a_pass_hands_on_few_rows(spark):
    """A task adds its pairs up before any row of them leaves it: one row per pair and task, not per place."""
    state = spark.createDataFrame([(mg.symbol(0) + mg.symbol(1) * 50, 1)] * 400, "s string, count long").coalesce(1)
    plan = mg.pair_counts(state)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "Generate" not in plan
