"""Pre-tokenisers, normalisers, BPE training and encoding against the public tokenizers library."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from tessera.errors import ConfigError
from tessera.functions.text import byte_alphabet, clean_markers, normalize, pretokenize, short_name, strip_text
from tessera.operators.encode import cut_at_eos, decode_ids, encode_subword
from tessera.operators.vocab import find_eos, rank_vocab, train_subword, word_counts

tokenizers = pytest.importorskip("tokenizers")
from tokenizers import Tokenizer, models, pre_tokenizers, trainers  # noqa: E402

SF001 = "/root/testdata/sf0.001"
HAND = ["ab12 c3", "ΑΣ final sigma", "İstanbul ½ ٣٤ digits", "tab\there, new\nline!!", "emoji 🙂 ok", "café résumé"]


def _lib_pretok(kind, text):
    pt = {"whitespace": pre_tokenizers.Whitespace(),
          "digits": pre_tokenizers.Digits(individual_digits=False),
          "whitespace_digits": pre_tokenizers.Sequence([pre_tokenizers.Whitespace(),
                                                        pre_tokenizers.Digits(individual_digits=True)]),
          "byte_level": pre_tokenizers.ByteLevel(add_prefix_space=True)}[kind]
    return [p for p, _ in pt.pre_tokenize_str(text)]


@pytest.mark.parametrize("kind", ["whitespace", "digits", "whitespace_digits", "byte_level"])
def test_pretokenizers_equal_library(spark, kind):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("text").limit(60).collect()
    texts = [r.text for r in docs] + HAND
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r.t for r in df.select(pretokenize("text", kind).alias("t")).collect()]
    assert got == [_lib_pretok(kind, t) for t in texts]


def test_unknown_pretokenizer_and_normalizer():
    with pytest.raises(ConfigError):
        pretokenize("text", "bert")
    with pytest.raises(ConfigError):
        normalize("text", "nfx")


def test_normalizers(spark):
    texts = ["é", "ﬁ", "ΑΣ", "Ä"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for kind, fn in [("nfc", lambda s: unicodedata.normalize("NFC", s)),
                     ("nfkd", lambda s: unicodedata.normalize("NFKD", s)),
                     ("lowercase", lambda s: "".join(c.lower() for c in s))]:
        got = [r.t for r in df.select(normalize("text", kind).alias("t")).collect()]
        assert got == [fn(t) for t in texts]
    # per-character lowering keeps U+03C3 for a final capital sigma
    assert df.select(normalize("text", "lowercase").alias("t")).collect()[2].t == "ασ"


def test_small_helpers(spark):
    df = spark.createDataFrame([("  x y \n",)], "s string")
    assert df.select(strip_text("s")).first()[0] == "x y"
    df = spark.createDataFrame([("tokenizers/my-tok.json",), ("plain",)], "s string")
    assert [r[0] for r in df.select(short_name("s")).collect()] == ["my-tok", "plain"]
    df = spark.createDataFrame([("ĠhelloĊworldč",)], "s string")
    assert df.select(clean_markers("s")).first()[0] == " hello\nworld\r"
    assert len(byte_alphabet()) == 256 and len(set(byte_alphabet())) == 256


def _library_bpe(texts, vocab_size, min_freq, specials):
    tok = Tokenizer(models.BPE())
    tok.pre_tokenizer = pre_tokenizers.Whitespace()
    tr = trainers.BpeTrainer(vocab_size=vocab_size, min_frequency=min_freq, special_tokens=list(specials),
                             show_progress=False)
    tok.train_from_iterator(texts, tr)
    return tok


@pytest.mark.parametrize("texts,vocab,minf", [
    (["low lower lowest newer wider new", "the the then there aaa aaaa"], 40, 0),
    (None, 120, 2),
])
def test_bpe_equals_library(spark, texts, vocab, minf):
    if texts is None:
        texts = [r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").orderBy("doc_id").limit(25)
                 .collect()]
    specials = ["<pad>", "</s>"]
    lib = _library_bpe(texts, vocab, minf, specials)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    model = train_subword(word_counts(df), vocab, min_frequency=minf, special_tokens=specials)
    assert {t: i for i, t in enumerate(model.tokens)} == lib.get_vocab()
    enc = encode_subword(df, model, ["doc_id"]).orderBy("doc_id").collect()
    assert [list(r.ids) for r in enc] == [lib.encode(t).ids for t in texts]


def test_rank_vocab_find_eos_decode(spark):
    df = spark.createDataFrame([(0, "b a a c"), (1, "a b")], "doc_id long, text string")
    v = rank_vocab(word_counts(df), ["<pad>", "</s>", "<|endoftext|>"])
    got = {r.token: r.id for r in v.collect()}
    assert got == {"<pad>": 0, "</s>": 1, "<|endoftext|>": 2, "a": 3, "b": 4, "c": 5}
    e = find_eos(v).first()
    assert (e.eos_id, e.eos_token) == (2, "<|endoftext|>")
    rows = spark.createDataFrame([(7, [4, 3, 9, 5])], "row_id long, ids array<int>")
    assert decode_ids(rows, v, "ids", ["row_id"]).first().text == "bac"
    ids = spark.createDataFrame([([5, 2, 7],), ([5],)], "ids array<int>")
    assert [r[0] for r in ids.select(cut_at_eos("ids", 2)).collect()] == [[5], [5]]
