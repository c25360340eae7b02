"""The whole model: normaliser, special tokens, WordPiece, Unicode classes, tokenizer files."""

import json

import pytest

from tessera.functions.text import pretokenize
from tessera.operators.encode import encode_subword
from tessera.operators.vocab import SubwordModel, train_subword, train_unigram, word_counts

tokenizers = pytest.importorskip("tokenizers")
from tokenizers import Tokenizer, models, normalizers, pre_tokenizers, trainers  # noqa: E402

TEXTS = ["low lower lowest newer wider new café", "the the then there aaa aaaa", "café naïve Ⓐb x² wide"]
ODD = ["a b", "x　y", "n\u0085m", "x² y½", "می‌خواهم", "Ⓐb ⓒ", " lead", "  two", "", "tab\tx", "١٢a٣", "a_b-c"]


@pytest.mark.parametrize("kind,lib", [
    ("whitespace", pre_tokenizers.Whitespace()), ("digits", pre_tokenizers.Digits(False)),
    ("whitespace_digits", pre_tokenizers.Sequence([pre_tokenizers.Whitespace(), pre_tokenizers.Digits(True)])),
    ("byte_level", pre_tokenizers.ByteLevel(True))])
def test_unicode_classes_equal_the_library(spark, kind, lib):
    df = spark.createDataFrame([(t,) for t in ODD if t], "text string")
    got = [r.t for r in df.select(pretokenize("text", kind).alias("t")).collect()]
    assert got == [[p for p, _ in lib.pre_tokenize_str(t)] for t in ODD if t]


def _frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def _ids(spark, model, texts):
    return [list(r.ids) for r in encode_subword(_frame(spark, texts), model).orderBy("doc_id").collect()]


def test_bpe_normalises_and_keeps_special_tokens_like_the_library(spark):
    specials = ["<pad>", "</s>"]
    lib = Tokenizer(models.BPE())
    lib.normalizer = normalizers.NFC()
    lib.pre_tokenizer = pre_tokenizers.Whitespace()
    lib.train_from_iterator(TEXTS, trainers.BpeTrainer(vocab_size=60, special_tokens=specials, show_progress=False))
    model = train_subword(word_counts(_frame(spark, TEXTS), normalizer="nfc"), 60, special_tokens=specials,
                          normalizer="nfc")
    assert {t: i for i, t in enumerate(model.tokens)} == lib.get_vocab()
    asked = [*TEXTS, "café</s>low <pad></s> lower", "</s", "zzz low", ""]
    assert _ids(spark, model, asked) == [lib.encode(t).ids for t in asked]
    assert Tokenizer.from_str(json.dumps(model.to_json())).encode(asked[3]).ids == lib.encode(asked[3]).ids


@pytest.mark.parametrize("kind", ["bpe", "wordpiece", "unigram"])
def test_save_and_load(spark, tmpdir_path, kind):
    counts = word_counts(_frame(spark, TEXTS), normalizer="nfc_lowercase", pre_tokenizer="whitespace_digits")
    opts = {"special_tokens": ["[UNK]"], "normalizer": "nfc_lowercase", "pre_tokenizer": "whitespace_digits"}
    model = train_unigram(counts, 40, **opts) if kind == "unigram" else train_subword(counts, 70, kind=kind, **opts)
    model.save(spark, f"{tmpdir_path}/m")
    back = SubwordModel.load(spark, f"{tmpdir_path}/m")
    assert (back.tokens, back.merges, back.normalizer, back.pre_tokenizer) == (
        model.tokens, model.merges if kind == "bpe" else back.merges, "nfc_lowercase", "whitespace_digits")
    assert _ids(spark, back, ["LOW café 12"] + TEXTS) == _ids(spark, model, ["LOW café 12"] + TEXTS)


def test_wordpiece_takes_the_longest_piece_like_the_library(spark):
    model = train_subword(word_counts(_frame(spark, TEXTS)), 60, special_tokens=["[UNK]"], kind="wordpiece")
    assert {t[2:] for t in model.tokens if t.startswith("##")} <= {t for t in model.tokens} | {
        t[2:] for t in model.tokens if len(t) > 3}
    lib = Tokenizer.from_str(json.dumps(model.to_json()))
    asked = [*TEXTS, "xlow lowx lowest Ω", "[UNK] low"]
    assert _ids(spark, model, asked) == [lib.encode(t).ids for t in asked]


def test_loads_library_files(spark):
    lib = Tokenizer(models.BPE())
    lib.normalizer = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
    lib.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True)
    lib.train_from_iterator(TEXTS, trainers.BpeTrainer(
        vocab_size=300, special_tokens=["<s>"], show_progress=False, initial_alphabet=pre_tokenizers.ByteLevel.alphabet()))
    art = json.loads(lib.to_str())
    asked = [*TEXTS, "LOW <s> café", "  two"]
    want = [lib.encode(t).ids for t in asked]
    assert _ids(spark, SubwordModel.from_json(art), asked) == want
    art["model"]["merges"] = [m if isinstance(m, str) else " ".join(m) for m in art["model"]["merges"]]
    assert _ids(spark, SubwordModel.from_json(art), asked) == want


def test_a_block_encodes_each_word_once(spark, monkeypatch):
    """Repeated words meet the encoder once, without a cache too; nulls, empty texts, keys and order stay."""
    from tessera.operators import encode as enc

    def once(model):
        seen = set()

        def encode_word(word):
            if word in seen:
                raise ValueError(f"{word} again")
            seen.add(word)
            return [ord(c) for c in word if c != "z"]
        return encode_word
    monkeypatch.setattr(enc, "_subword_encoder", once)
    model = SubwordModel("bpe", ["<s>", "a"], special_tokens=["<s>"])
    rows = [(1, "x", "ab ab zz b"), (2, None, None), (None, "y", ""), (2, "x", "b <s>ab<s>"), (2, "x", "zz")]
    df = spark.createDataFrame(rows, "n long, k string, text string").coalesce(1)
    got = [(r.k, r.n, r.ids, r.n_tokens) for r in enc.encode_subword(df, model, ["k", "n"], eos_id=7, cache_size=0).collect()]
    ab, b = [97, 98], [98]
    want = [[*ab, *ab, *b], [], [], [*b, 0, *ab, 0], []]
    assert got == [(k, n, [*w, 7], len(w) + 1) for (n, k, _), w in zip(rows, want)]
    byte_level = SubwordModel("bpe", ["<s>", "a"], special_tokens=["<s>"], pre_tokenizer="byte_level")
    text = spark.createDataFrame([(1, ""), (2, "a")], "doc_id long, text string")
    assert [r.n_tokens for r in enc.encode_subword(text, byte_level).orderBy("doc_id").collect()] == [0, 2]
