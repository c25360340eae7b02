"""Byte-level BPE encoding and decoding over a distinct-word table.

1. Documents are packed into blocks (whole rows, ``BLOCK_BYTES`` of text at
   most unless one row is longer), each one row with a compressed batch.
2. Every block is split into the tokenizer's words, and its distinct words are
   dealt by hash into buckets; a bucket meets the same word of all blocks and
   encodes each distinct word once.
3. The ids return to their blocks in the order of the bucket's words, which a
   block knows from its own texts, and go back to the words' positions.  Each
   block also gets a copy of the whole id-to-piece table; the pieces, looked up
   by id as index, are the decoded text.

Only distinct words of blocks cross the network, not word occurrences, packed
as compressed batches, and only their ids return.  A task holds one block with
its words as numbers, or one bucket, and gives its rows out in small batches.
BPE never merges across words, so this equals encoding whole texts.

The tokenizer file is a parameter; its JSON travels with the tasks (its size
is bounded by the vocabulary).  Supported: byte-level BPE without a normaliser
and with the usual word pattern, and added tokens that match as plain strings.

Inputs: a null text counts as empty: no ids, decoded to the empty text.
Repeated rows each give a row.  Very long texts and words are encoded whole.
An empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import key_text

BLOCK_BYTES = 8 << 20
#: Words of a batch of rows that a block gives out (whole rows; a longer row stands alone).
OUT_WORDS = 1 << 18
WORD_BATCH = 20_000
PACK_LEVEL = 6
#: Letters, and other characters (neither letters, numbers nor white space), of the texts for the quick splitter.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_OTHERS = "\u00a1-\u00a9\u00ab-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf\u00d7\u00f7\u2010-\u2027\u2030-\u205e\u20a0-\u20bf"
_QUICK = re.compile(f"[\x00-\x7f{_LETTERS}{_OTHERS}]*")
#: The tokenizer's word pattern (fixed value) with its classes spelled out for these characters.
_QUICK_WORDS = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d| ?[L]+| ?[0-9]+| ?[^S0-9L]+|[S]+(?![^S])|[S]+".replace("S", " \t-\r").replace("L", _LETTERS))


def read_tokenizer(path: str) -> str:
    """The tokenizer's JSON after a check that its parts are supported."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    spec = json.loads(text)
    pre = spec.get("pre_tokenizer") or {}
    if (spec["model"]["type"] != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel"
            or pre.get("add_prefix_space") or not pre.get("use_regex", True)):
        raise ValueError("only byte-level BPE without normaliser and prefix space is supported")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", [])):
        raise ValueError("added tokens with strip or single_word flags are not supported")
    return text


def added_tokens(tokenizer_json: str) -> list[str]:
    """The added tokens, longest first."""
    return sorted((t["content"] for t in json.loads(tokenizer_json).get("added_tokens", [])), key=len, reverse=True)


def word_splitter(tokenizer_json: str) -> Callable[[str], list[str]]:
    return _splitter(added_tokens(tokenizer_json))


def _splitter(added: list[str]) -> Callable[[str], list[str]]:
    """Text -> its words, whose concatenation is the text; added tokens stand alone.

    Texts of common Latin characters go through a pattern; in all others the
    tokenizer library cuts the words, by its own character classes.  That part
    of the library has no vocabulary, so none is loaded.
    """
    from tokenizers.pre_tokenizers import ByteLevel
    library = ByteLevel(add_prefix_space=False, use_regex=True)
    letters = byte_letters()

    def words(text: str) -> list[str]:
        if _QUICK.fullmatch(text):
            return _QUICK_WORDS.findall(text)
        return [bytes([letters[c] for c in w]).decode() for w, _ in library.pre_tokenize_str(text)]
    if not added:
        return words
    special = re.compile("(" + "|".join(map(re.escape, added)) + ")")

    def split(text: str) -> list[str]:
        parts = special.split(text)
        if len(parts) == 1:
            return words(text)
        out: list[str] = []
        for i, part in enumerate(parts):
            out.extend([part] if i % 2 else words(part))
        return out
    return split


def loaded(tokenizer_json: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core for each task
    from tokenizers import Tokenizer
    tok = Tokenizer.from_str(tokenizer_json)
    tok.no_truncation()
    tok.no_padding()
    return tok


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable
    Latin-1 characters stand for themselves, the other bytes follow from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def piece_batch(tokenizer_json: str) -> pa.RecordBatch:
    """``id``, ``piece`` (bytes), by id: one row per vocabulary entry and added token."""
    spec = json.loads(tokenizer_json)
    letters = byte_letters()
    ids = dict(spec["model"]["vocab"]) | {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    rows = sorted((i, bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode())
                  for t, i in ids.items())
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()),
                                       pa.array([r[1] for r in rows], pa.binary())], ["id", "piece"])


def _packed(batches: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema, options=pa.ipc.IpcWriteOptions(
            compression=pa.Codec("zstd", PACK_LEVEL))) as w:
        for b in batches:
            w.write_batch(b)
    return sink.getvalue().to_pybytes()


def _unpacked(rows: pa.Scalar) -> Iterator[pa.RecordBatch]:
    with pa.ipc.open_stream(rows.as_buffer()) as stream:
        yield from stream


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, text) -> (block, rows as a compressed Arrow stream)."""
    from pyspark import TaskContext
    block, held, size = TaskContext.get().partitionId() << 24, [], 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([_packed(held)], pa.binary())],
                                          ["block", "rows"])
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            room = max(1, batch.num_rows * max(0, BLOCK_BYTES - size) // max(1, batch.nbytes))
            part = batch.slice(at, room)
            held.append(part)
            size += part.nbytes
            at += part.num_rows
            if size >= BLOCK_BYTES * 9 // 10:
                yield out()
                block, held, size = block + 1, [], 0
    if held:
        yield out()


def _bucket(word: str, buckets: int) -> int:
    return zlib.crc32(word.encode()) % buckets


def _distinct_words(added: list[str], buckets: int):
    """Blocks -> (bucket, block, distinct words of the block that fall into the bucket, sorted)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = _splitter(added)
        for batch in batches:
            for block, rows in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                seen: set[str] = set()
                for b in _unpacked(rows):
                    for text in b.column(1):
                        seen.update(split(text.as_py() or ""))
                dealt: list[list[str]] = [[] for _ in range(buckets)]
                for word in sorted(seen):
                    dealt[_bucket(word, buckets)].append(word)
                del seen
                full = [i for i in range(buckets) if dealt[i]]
                for i in range(0, len(full), 64):
                    part = full[i:i + 64]
                    data = [_packed([pa.RecordBatch.from_arrays([pa.array(dealt[k], pa.string())], ["word"])])
                            for k in part]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(part, pa.int32()), pa.array(np.full(len(part), block)), pa.array(data, pa.binary())],
                        ["bucket", "block", "words"])
    return run


def _encode_bucket(tokenizer_json: str):
    """All words of a bucket -> per block, the ids of its words, in their order; a word is encoded once."""
    def run(group: pa.Table) -> pa.Table:
        tok = loaded(tokenizer_json)
        index: dict[str, int] = {}
        uses = []
        for rows in group["words"]:
            for b in _unpacked(rows):
                uses.append(np.array([index.setdefault(w, len(index)) for w in b.column(0).to_pylist()], np.int64))
        words, values, sizes = list(index), [], []
        for i in range(0, len(words), WORD_BATCH):
            for e in tok.encode_batch_fast(words[i:i + WORD_BATCH], add_special_tokens=False):
                values.append(np.asarray(e.ids, np.uint32))
                sizes.append(len(e.ids))
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values)))
        data = [_packed([pa.RecordBatch.from_arrays([ids.take(pa.array(u))], ["ids"])]) for u in uses]
        return pa.table({"block": group["block"], "bucket": group["bucket"], "data": pa.array(data, pa.binary())})
    return run


def _gather(flat: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Concatenation of the pieces ``flat[offsets[i]:offsets[i + 1]]`` for i of ``which``."""
    size = offsets[which + 1] - offsets[which]
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(offsets[which] - (ends - size), size)]


def _place(added: list[str], buckets: int, decode: bool):
    """Block + the ids of its words by bucket, and the pieces (no bucket) -> key, ids (little-endian unsigned 32-bit),
    decoded."""
    def numbered(rows: pa.ChunkedArray) -> tuple[list[str], list[tuple[pa.Array, np.ndarray, np.ndarray]]]:
        """The block's distinct words, and stretches of its rows: keys, their words as numbers, words of each row."""
        split, index, stretches = _splitter(added), {}, []
        for blob in rows:
            for b in _unpacked(blob):
                at, sizes, n, first = [], [], 0, 0
                for i, text in enumerate(b.column(1)):
                    words = split(text.as_py() or "")
                    at.append(np.fromiter((index.setdefault(w, len(index)) for w in words), np.int32, len(words)))
                    sizes.append(len(words))
                    n += len(words)
                    if n >= OUT_WORDS or i + 1 == b.num_rows:
                        stretches.append((b.column(0).slice(first, i + 1 - first), np.concatenate(at), np.array(sizes)))
                        at, sizes, n, first = [], [], 0, i + 1
        return list(index), stretches

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        flats, sizes, piece_flat, piece_off = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], None, None
        for bucket, data in sorted(zip(right["bucket"].to_pylist(), right["data"], strict=True),
                                   key=lambda x: (x[0] is None, x[0] or 0)):
            for b in _unpacked(data):
                if bucket is not None:
                    flats.append(b.column(0).flatten().to_numpy())
                    sizes.append(np.diff(b.column(0).offsets.to_numpy()))
                else:
                    piece_flat = np.frombuffer(b.column(1).buffers()[2], np.uint8)
                    piece_off = np.frombuffer(b.column(1).buffers()[1], np.int32)[:b.num_rows + 1].astype(np.int64)
                    if (b.column(0).to_numpy() != np.arange(b.num_rows)).any():
                        raise ValueError("ids of the vocabulary are not 0, 1, 2, ...")
        flat, offsets = np.concatenate(flats), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        words, stretches = numbered(left["rows"])
        if len(words) != len(offsets) - 1:
            raise ValueError(f"{len(words)} words of a block met the ids of {len(offsets) - 1}")
        rank = np.empty(len(words), np.int64)
        rank[sorted(range(len(words)), key=lambda i: (_bucket(words[i], buckets), words[i]))] = np.arange(len(words))
        del words
        out = []
        for keys, at, count in stretches:
            ids = _gather(flat, offsets, rank[at])
            ends = np.concatenate([[0], np.cumsum(np.diff(offsets)[rank[at]])])[np.concatenate([[0], np.cumsum(count)])]
            coded = pa.Array.from_buffers(pa.binary(), len(keys), [
                None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
            back = [_gather(piece_flat, piece_off, ids[i:j].astype(np.int64)).tobytes().decode("utf-8", "replace")
                    if decode else None for i, j in zip(ends[:-1], ends[1:], strict=True)]
            out.append(pa.RecordBatch.from_arrays([keys, coded, pa.array(back, pa.string())], ["key", "ids", "decoded"]))
        return pa.Table.from_batches(out, pa.schema([("key", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())]))
    return run


def encode(docs: DataFrame, tokenizer_path: str, key_col: str = "doc_id", text_col: str = "text",
           decode: bool = True) -> DataFrame:
    """One row per document row: ``key``, ``ids`` (binary, little-endian unsigned
    32-bit), and ``decoded``, the text that the ids' pieces give (null if not asked for)."""
    spark = docs.sparkSession
    spec = read_tokenizer(tokenizer_path)
    added, parts = added_tokens(spec), int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = (key_text(docs, key_col, text_col)
              .mapInArrow(_pack, "block long, rows binary").repartition(parts, "block"))
    words = (blocks.mapInArrow(_distinct_words(added, parts), "bucket int, block long, words binary")
             .groupBy("bucket").applyInArrow(_encode_bucket(spec), "block long, bucket int, data binary"))
    if decode:
        words = words.unionByName(blocks.select("block", F.lit(None).cast("int").alias("bucket"),
                                                F.lit(_packed([piece_batch(spec)])).alias("data")))
    return (blocks.groupBy("block").cogroup(words.groupBy("block"))
            .applyInArrow(_place(added, parts, decode), "key long, ids binary, decoded string"))


def decode_ids(encoded: DataFrame, tokenizer_path: str, key_col: str = "key", ids_col: str = "ids") -> DataFrame:
    """``key``, ``text`` of rows with an ``array<int>`` of ids, through the id-to-piece join.

    The piece table is broadcast: its size is that of the vocabulary.  Keys
    must be unique; an unknown id raises.
    """
    spark = encoded.sparkSession
    pieces = spark.createDataFrame(pa.Table.from_batches([piece_batch(read_tokenizer(tokenizer_path))])).withColumn(
        "piece", F.hex("piece"))
    placed = (encoded.select(F.col(key_col).alias("key"), F.posexplode_outer(ids_col).alias("pos", "id"))
              .join(F.broadcast(pieces), "id", "left")
              .withColumn("piece", F.when(F.col("id").isNotNull() & F.col("piece").isNull(),
                                          F.raise_error(F.lit("id outside the vocabulary"))).otherwise(F.col("piece"))))
    return placed.groupBy("key").agg(
        F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("pos", "piece")))).alias("p")).select(
        "key", F.decode(F.unhex(F.array_join(F.col("p.piece"), "")), "UTF-8").alias("text"))
