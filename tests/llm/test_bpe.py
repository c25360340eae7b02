import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import bpe

from .helpers import documents, nasty

PIECES = ["a", " ", "  ", "\n", "'s", "'LL", "é", "1", "２", "中", "<|endoftext|>", "!", "\t", " ", "՘", "😀", "'ll",
          "\r\n", "²", "​", "ß", "Ⅷ", "…", "<|", "|>", "\x1f", "\x85", "ﬁ", "ǅ"]


@pytest.fixture(scope="module")
def path():
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def texts():
    r = random.Random(7)
    return ["".join(r.choice(PIECES) for _ in range(r.randint(0, 30))) for _ in range(300)] + ["w" * 5000, " " * 3000]


def test_equals_the_library(spark, path):
    rows = nasty() + [(100 + i, t) for i, t in enumerate(texts())]
    tok = bpe.loaded(bpe.read_tokenizer(path))
    want = []
    for key, text, *_ in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids
        want.append((key, ids, tok.decode(ids, skip_special_tokens=False)))
    got = [(r.key, np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in bpe.encode(documents(spark, rows), path).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_words_are_the_library_s_for_every_quick_character(path):
    text = bpe.read_tokenizer(path)
    split, library, letters = bpe.word_splitter(text), bpe.loaded(text).pre_tokenizer, bpe.byte_letters()
    for code in [*range(0x260), *range(0x2000, 0x20D0)]:
        c = chr(code)
        s = f"a{c}b {c}1{c} {c}{c}  {c} xé'{c}s's"
        assert split(s) == [bytes(letters[x] for x in w).decode() for w, _ in library.pre_tokenize_str(s)], hex(code)


def test_decode_by_join(spark, path):
    docs = documents(spark, [(i, t) for i, t in enumerate(texts())])
    coded = bpe.encode(docs, path, decode=False)
    rows = [(r.key, np.frombuffer(r.ids, "<u4").tolist()) for r in coded.collect()]
    back = bpe.decode_ids(spark.createDataFrame(rows, "key long, ids array<int>"), path)
    assert {r.key: r.text for r in back.collect()} == dict(enumerate(texts()))


def test_blocks_and_empty_table(spark, path, monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 2000)

    class Context:
        @staticmethod
        def get():
            return Context

        @staticmethod
        def partitionId():
            return 3
    monkeypatch.setattr("pyspark.TaskContext", Context)
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(["x" * 150] * 50)], ["key", "text"])
    blocks = list(bpe._pack(iter([batch, batch])))
    keys = [k for b in blocks for part in bpe._unpacked(b.column(1)[0]) for k in part.column(0).to_pylist()]
    assert keys == list(range(50)) * 2 and len({b.column(0)[0].as_py() for b in blocks}) == len(blocks) > 5
    monkeypatch.undo()
    assert bpe.encode(documents(spark, []), path).count() == 0


def test_a_block_gives_its_rows_out_in_small_batches(path, monkeypatch):
    spec = bpe.read_tokenizer(path)
    tok, added = bpe.loaded(spec), bpe.added_tokens(spec)
    monkeypatch.setattr(bpe, "OUT_WORDS", 50)
    rows = [(i, f"word{i % 7} and {i} é" * (i % 5)) for i in range(200)] + [(200, None), (201, "long " * 300)]
    block = bpe._packed([pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])],
                                                    ["key", "text"])])
    one = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([block], pa.binary())], ["block", "rows"])
    groups = []
    for b in bpe._distinct_words(added, 4)(iter([one])):
        groups += [bpe._encode_bucket(spec)(pa.Table.from_batches([b.slice(i, 1)])) for i in range(b.num_rows)]
    pieces = pa.table({"block": [7], "bucket": pa.array([None], pa.int32()),
                       "data": pa.array([bpe._packed([bpe.piece_batch(spec)])], pa.binary())})
    monkeypatch.setattr(bpe, "loaded", None)  # a block needs no vocabulary of the library
    out = bpe._place(added, 4, True)(pa.table({"block": [7], "rows": pa.array([block], pa.binary())}),
                                     pa.concat_tables([*groups, pieces]))
    assert [(r["key"], np.frombuffer(r["ids"], "<u4").tolist(), r["decoded"]) for r in out.to_pylist()] == [
        (k, tok.encode(t or "", add_special_tokens=False).ids, t or "") for k, t in rows]
    split = bpe.word_splitter(spec)
    for b in out.to_batches():
        assert sum(len(split(t)) for t in b.column("decoded").to_pylist()[:-1]) < 50
