import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import byte_tokens
from tessera.llm.queries import QUERIES

from .helpers import documents, nasty

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = byte_tokens.read_ranks(PATH)
MODEL = byte_tokens.library_model(PIECES, public_tokenizers.PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={p: i for i, p in enumerate(PIECES)},
                            special_tokens={})


def ids(row):
    return [int.from_bytes(row.ids[i:i + 4], "little") for i in range(0, len(row.ids), 4)]


def hard_texts():
    return [t for _, t in nasty()] + [
        "a  b   c\n\n\n d\t\te  f　g", "I'll we're THEY'VE don't 'tis", "x" * 5000 + " " + "=" * 3000, " " * 4000,
        "日本語のテキスト、中文文本。한국어 텍스트", "👩‍👩‍👧‍👦 🇩🇪 é ﷽ 𝔘𝔫𝔦", "<|endoftext|> <s>", "\x00\x01\x1c\x1f\x85 ",
        "1234567890 ١٢٣ ½ Ⅷ ²", "".join(chr(c) for c in range(0x20, 0x2500))]


def test_encoding_matches_the_rank_library(spark):
    rows = [(i, t) for i, t in enumerate(hard_texts())]
    rows += [rows[0], rows[0], (None, "no key"), (None, None)]
    got = byte_tokens.encode(documents(spark, rows), PATH, public_tokenizers.PATTERN).collect()
    assert sorted((str(r.key), ids(r), bytes(r.decoded)) for r in got) == sorted(
        (str(k), LIBRARY.encode_ordinary(t or ""), (t or "").encode()) for k, t in rows)
    for r in got:
        assert r.n_tokens == len(ids(r)) == len(r.starts) == len(r.stops)


def test_offsets_cover_split_characters(spark):
    texts = [t or "" for t in hard_texts()]
    for r in byte_tokens.encode(documents(spark, list(enumerate(texts))), PATH, public_tokenizers.PATTERN).collect():
        text, at, split = texts[r.key], 0, 0
        owner = [i for i, c in enumerate(text) for _ in c.encode()]
        begins = {i for i in range(len(owner)) if i == 0 or owner[i] != owner[i - 1]} | {len(owner)}
        for token, a, b in zip(ids(r), r.starts, r.stops):
            stop = at + len(PIECES[token])
            assert (a, b) == (owner[at], owner[stop - 1] + 1)
            split += at not in begins or stop not in begins
            at = stop
        assert split == r.n_split and at == len(owner)


def test_decoding_slices_of_ids(spark):
    whole = LIBRARY.encode_ordinary("ab 日本語 👩‍👩‍👧 z")
    rows = [(i, b"".join(t.to_bytes(4, "little") for t in whole[i:j])) for i in range(len(whole)) for j in (i + 1, len(whole))]
    df = spark.createDataFrame([*rows, (900, None), (901, b"")], "key long, ids binary")
    back = {(r.key, bytes(r.bytes)): r.text for r in byte_tokens.decode(df, PATH).collect()}
    for i in range(len(whole)):
        for j in (i + 1, len(whole)):
            raw = LIBRARY.decode_bytes(whole[i:j])
            assert back[i, raw] == raw.decode("utf-8", "replace")
    assert back[900, b""] == back[901, b""] == ""
    with pytest.raises(Exception, match="outside the vocabulary"):
        byte_tokens.decode(spark.createDataFrame([(1, b"\xff\xff\xff\x00")], "key long, ids binary"), PATH).collect()


def test_long_texts_are_cut_between_words(spark, monkeypatch):
    r = random.Random(1)
    text = "".join(r.choice(["word", " ", "  ", "\n", "'s", "12", "日本", "!", "\t", " "]) for _ in range(3000))
    for size in (1, 7, 100, 100_000):
        parts = byte_tokens.cut(text, size)
        assert "".join(parts) == text
        assert [i for p in parts for i in LIBRARY.encode_ordinary(p)] == LIBRARY.encode_ordinary(text)
    monkeypatch.setattr(byte_tokens, "GROUP_BYTES", 50)
    run = byte_tokens._encode(MODEL, PIECES, True, True)
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([text, "", text[:70]])], ["key", "text"])
    got = [x for b in run(iter([batch])) for x in b.to_pylist()]
    assert [x["decoded"].decode() for x in got] == [text, "", text[:70]] and [x["key"] for x in got] == [1, 2, 3]


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" a=-\n0'")), max_size=60))
def test_any_text(text):
    got = byte_tokens._loaded(MODEL).encode(text, add_special_tokens=False).ids
    assert got == LIBRARY.encode_ordinary(text)


def test_runs_of_few_characters():
    r, tok = random.Random(2), byte_tokens._loaded(MODEL)
    for _ in range(20_000):
        some = r.sample(" a=-\n\t0x!ehé日", r.choice([1, 1, 2, 3]))
        text = "".join(r.choice(some) for _ in range(r.randrange(1, 80)))
        assert tok.encode(text, add_special_tokens=False).ids == LIBRARY.encode_ordinary(text), text


def test_empty_table(spark):
    assert byte_tokens.encode(documents(spark, []), PATH, public_tokenizers.PATTERN).count() == 0


def test_query_matches_the_rank_library(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: tuple(r)[1:4] for r in QUERIES["op11_byte_bpe"](spark, sf).collect()}
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        found = LIBRARY.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(found), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in found)).hexdigest(),
                          hashlib.sha256((r.text or "").encode()).hexdigest())
    assert got == want
