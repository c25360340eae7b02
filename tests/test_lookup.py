"""Array lookups against a plain version, with repeated and null keys, and tables that repeat or lack elements."""

import random

from pyspark.sql import functions as F

from tessera.functions.text import byte_alphabet, byte_level_chars
from tessera.operators.encode import decode_ids, encode_rank
from tessera.operators.lookup import looked_up


def _plain(rows, table):
    out = []
    for key, words in rows:
        both = [x for k, ws in rows if k == key and key is not None for x in enumerate(ws or [])]
        hits = sorted((i, v) for i, w in both for e, v in table if e == w and w is not None)
        out.append((key, [v for _, v in hits] if key is not None else []))
    return out


def _sorted(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def test_as_the_plain_version(spark):
    rng = random.Random(7)
    rows = [(i, [f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(rng.choice([0, 1, 5, 40]))]) for i in range(60)]
    rows += [(100, None), (101, []), (102, [None, "w1"]), (103, ["unknown"])]
    table = [(f"w{i}", i) for i in range(50)] + [("w3", 1003), ("w4", -4)]
    t = spark.createDataFrame(table, "token string, id int")
    for extra in ([], [(5, ["w1", "w2"]), (5, ["w9", "w3", "unknown", "w1"]), (None, ["w1"]), (None, ["w2"])]):
        df = spark.createDataFrame(rows + extra, "k long, ws array<string>").repartition(3)
        for size in (1, 50, 1 << 20):
            got = looked_up(df, ["k"], "ws", t, "token", "id", size).collect()
            assert _sorted((r[0], list(r[1])) for r in got) == _sorted(_plain(rows + extra, table))


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, ["a"])], "k long, ws array<string>")
    t = spark.createDataFrame([], "token string, id int")
    assert [(r[0], r[1]) for r in looked_up(df, ["k"], "ws", t, "token", "id").collect()] == [(1, [])]
    assert looked_up(df.where("k > 1"), ["k"], "ws", t, "token", "id").collect() == []


def test_tokens_do_not_meet_the_vocabulary_one_by_one(spark):
    """A frequent word is joined once a block, not once an occurrence; its ids and text come back whole."""
    from tessera.operators import lookup
    words = ["the"] * 5000 + ["end"]
    docs = spark.createDataFrame([(i, " ".join(words)) for i in range(4)], "doc_id long, text string").coalesce(1)
    vocab = spark.createDataFrame([("the", 7), ("end", 9)], "token string, id long")
    e = encode_rank(docs, vocab, eos_id=3)
    assert [(r.doc_id, r.ids, r.n_tokens) for r in e.orderBy("doc_id").collect()] == [
        (i, [7] * 5000 + [9, 3], 5002) for i in range(4)]
    text = decode_ids(e.withColumnRenamed("doc_id", "row_id"), vocab, "ids", ["row_id"]).collect()
    assert {r.text for r in text} == {"".join(words)} and len(text) == 4
    seen = []

    joined = lookup.written

    def counting(df, name="step"):
        out = joined(df, name)
        if name == "blocks":
            seen.append(out.where("_distinct is not null").selectExpr("sum(size(_distinct))").first()[0])
        return out
    lookup.written = counting
    try:
        encode_rank(docs, vocab).count()
    finally:
        lookup.written = joined
    assert seen == [2]


def test_byte_level_chars_have_no_array_per_byte(spark):
    letters = byte_alphabet()
    texts = ["", "plain text\n", "".join(map(chr, range(256))), "\u00e9\u0416\u4e2d\U0001f600", "\x00\x7f\xad"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9, None)], "i long, t string")
    out = df.select("i", byte_level_chars(F.col("t")).alias("t"))
    assert {r.i: r.t for r in out.collect()} == {i: "".join(letters[b] for b in t.encode()) for i, t in enumerate(texts)} | {9: None}
    assert "sequence" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_documents_cut_once_are_counted_and_encoded_from_their_blocks(spark, monkeypatch):
    from tessera.operators import encode, lookup, vocab
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.7)) % 30}" for _ in range(rng.choice([0, 1, 30])))) for i in range(40)]
    docs = spark.createDataFrame(rows + [(90, None), (7, "w1 again, w2"), (None, "w3")], "doc_id long, text string").repartition(3)
    v = vocab.rank_vocab(vocab.word_counts(docs), ["<pad>"])
    plain = [sorted(map(str, f.collect())) for f in (vocab.word_counts(docs), encode_rank(docs, v))]
    cut = encode.cut_blocks
    monkeypatch.setattr(encode, "cut_blocks", lambda rows, elements: cut(rows, elements, 50))
    blocks = encode.token_blocks(docs)
    assert lookup.is_cut(blocks) and not lookup.is_cut(docs) and blocks.select("_block").distinct().count() > 3

    def refuse(*args):
        raise AssertionError("cut again")
    monkeypatch.setattr(encode, "pretokenize", refuse)
    monkeypatch.setattr(vocab, "pretokenize", refuse)
    assert [sorted(map(str, f.collect())) for f in (vocab.word_counts(blocks), encode_rank(blocks, v))] == plain
