"""Byte-level BPE by rank files: encoding, character offsets and decoding.

A rank file has one line per piece, base64 bytes and rank; ranks are the ids.
The driver writes the ranks as a model of the tokenizers library (each byte
stands as the letter of the byte table; every way to put a piece together from
two others is a merge at the piece's rank; a word that is a piece is taken
whole), and the tasks encode Arrow batches with it, each match of the word
pattern separately.

*Offsets.*  The bytes of a text map to its characters: a token covers the
characters that own its bytes, so the tokens of one split character all cover
that character.

*Decoding* reverses the byte table: ids give bytes, joined before they are read
as UTF-8, so characters split over tokens come back whole; bytes that are no
character, as in a slice of ids that begins or ends inside one, show as U+FFFD
in the decoded text and are kept in the decoded bytes.

The model travels with the tasks (its size is that of the vocabulary).  Rows
are encoded in groups of about ``GROUP_BYTES``; a longer text is cut where a
blank follows another character, which is a border of words for the pattern.

Inputs: a null text counts as empty: no ids.  Repeated rows each give a row;
keys need not be unique and may be null.  Very long texts and words are encoded
whole.  Other columns are not read, whatever their names.  An empty table gives
an empty result.  Unknown ids raise.
"""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_groups, text_buffer

GROUP_BYTES = 1 << 20


def byte_table() -> list[str]:
    """The letter of each byte: printable Latin-1 characters stand for themselves, others follow from U+0100."""
    table, other = [], 0x100
    for b in range(256):
        shown = 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF
        table.append(chr(b if shown else other))
        other += not shown
    return table


def read_ranks(path: str) -> list[bytes]:
    """Pieces by rank; ranks must be 0, 1, 2, ... and hold every single byte."""
    with open(path, "rb") as f:
        rows = sorted((int(rank), base64.b64decode(piece)) for piece, rank in (line.split() for line in f if line.strip()))
    if [r for r, _ in rows] != list(range(len(rows))):
        raise ValueError("ranks are not 0, 1, 2, ...")
    pieces = [p for _, p in rows]
    if not {bytes([b]) for b in range(256)} <= set(pieces):
        raise ValueError("single bytes are missing")
    return pieces


def library_model(pieces: Sequence[bytes], pattern: str) -> str:
    """The tokenizers library's JSON for the ranks."""
    table, rank = byte_table(), {p: i for i, p in enumerate(pieces)}

    def shown(piece: bytes) -> str:
        return "".join(table[b] for b in piece)
    merges = []
    for piece in pieces:
        halves = [(piece[:i], piece[i:]) for i in range(1, len(piece)) if piece[:i] in rank and piece[i:] in rank]
        merges += [[shown(a), shown(b)] for a, b in sorted(halves, key=lambda h: (rank[h[0]], rank[h[1]]))]
    return json.dumps({
        "version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None,
        "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Isolated", "invert": False},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}]},
        "post_processor": None, "decoder": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False,
                                            "use_regex": False},
        "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None,
                  "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": True,
                  "vocab": {shown(p): i for i, p in enumerate(pieces)}, "merges": merges}})


@lru_cache(maxsize=2)
def _loaded(model: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core for each task
    from tokenizers import Tokenizer
    return Tokenizer.from_str(model)


class Pieces:
    """The bytes of all pieces, by id."""

    def __init__(self, pieces: Sequence[bytes]):
        self.flat = np.frombuffer(b"".join(pieces), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])

    def sizes(self, ids: np.ndarray) -> np.ndarray:
        return self.offsets[ids + 1] - self.offsets[ids]

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) == 0:
            return b""
        if ids.min() < 0 or ids.max() >= len(self.offsets) - 1:
            raise ValueError("id outside the vocabulary")
        size = self.sizes(ids)
        ends = np.cumsum(size)
        return self.flat[np.arange(ends[-1]) + np.repeat(self.offsets[ids] - (ends - size), size)].tobytes()


def cut(text: str, size: int) -> list[str]:
    """The text in parts of ``size`` characters or somewhat more, cut before a blank after another character."""
    parts, at = [], 0
    while len(text) - at > size:
        to = text.find(" ", at + size)
        while to > 0 and text[to - 1].isspace():
            to = text.find(" ", to + 1)
        if to <= 0:
            break
        parts.append(text[at:to])
        at = to
    return [*parts, text[at:]]


def character_offsets(text: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """First and last (exclusive) character of each token, and how many tokens begin or end inside a character."""
    if len(sizes) == 0:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), 0
    leads = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
    char = np.cumsum(leads) - 1  # the character of each byte
    ends = np.cumsum(sizes)
    starts = ends - sizes
    inside_start = ~leads[starts]
    inside_end = np.zeros(len(ends), bool)
    inside_end[:-1] = inside_start[1:]  # the tokens cover the text without gaps
    return char[starts].astype(np.int32), (char[ends - 1] + 1).astype(np.int32), int((inside_start | inside_end).sum())


_SCHEMA = "key long, n_tokens long, n_split long, ids binary, starts array<int>, stops array<int>, decoded binary"


def _encode(model: str, pieces: list[bytes], offsets: bool, decode: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, table = _loaded(model), Pieces(pieces)
        ints = pa.list_(pa.int32())
        for batch in batches:
            data, bounds = text_buffer(batch.column(1))
            keys = batch.column(0)
            for lo, hi in row_groups(bounds, GROUP_BYTES):
                raw = [data[bounds[i]:bounds[i + 1]].tobytes() for i in range(lo, hi)]
                parts = [cut(r.decode(), GROUP_BYTES) for r in raw]
                found = iter([])
                out: dict[str, list] = {c: [] for c in ("n", "split", "ids", "starts", "stops", "decoded")}
                if len(raw) > 1:
                    found = iter(tok.encode_batch_fast([p for ps in parts for p in ps], add_special_tokens=False))
                for text, ps in zip(raw, parts, strict=True):
                    got = [next(found) for _ in ps] if len(raw) > 1 else (
                        tok.encode_batch_fast([p], add_special_tokens=False)[0] for p in ps)
                    ids = np.concatenate([np.array(e.ids, np.int64) for e in got])
                    starts, stops, split = character_offsets(text, table.sizes(ids))
                    out["n"].append(len(ids))
                    out["split"].append(split)
                    out["ids"].append(ids.astype("<u4").tobytes())
                    out["starts"].append(starts if offsets else None)
                    out["stops"].append(stops if offsets else None)
                    out["decoded"].append(table.decode(ids) if decode else None)
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(lo, hi - lo), pa.array(out["n"], pa.int64()), pa.array(out["split"], pa.int64()),
                     pa.array(out["ids"], pa.binary()), pa.array(out["starts"], ints), pa.array(out["stops"], ints),
                     pa.array(out["decoded"], pa.binary())],
                    ["key", "n_tokens", "n_split", "ids", "starts", "stops", "decoded"])
    return run


def encode(docs: DataFrame, ranks_path: str, pattern: str, key_col: str = "doc_id", text_col: str = "text",
           offsets: bool = True, decode: bool = True) -> DataFrame:
    """One row per document row: ``key``, ``n_tokens``, ``n_split`` (tokens that begin or end inside a character),
    ``ids`` (little-endian unsigned 32-bit), ``starts`` and ``stops`` (characters of each token; null unless
    ``offsets``), ``decoded`` (the bytes that the ids give back; null unless ``decode``)."""
    pieces = read_ranks(ranks_path)
    rows = docs.select(F.col(key_col).cast("long").alias("key"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_encode(library_model(pieces, pattern), pieces, offsets, decode), _SCHEMA)


def decode(encoded: DataFrame, ranks_path: str, key_col: str = "key", ids_col: str = "ids") -> DataFrame:
    """``key``, ``bytes`` and ``text`` of rows with ``ids`` (little-endian unsigned 32-bit; null: none)."""
    pieces = read_ranks(ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Pieces(pieces)
        for batch in batches:
            data, bounds = text_buffer(batch.column(1))
            for lo, hi in row_groups(bounds, GROUP_BYTES):
                back = [table.decode(np.frombuffer(data[bounds[i]:bounds[i + 1]].tobytes(), "<u4").astype(np.int64))
                        for i in range(lo, hi)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(back, pa.binary()),
                     pa.array([b.decode("utf-8", "replace") for b in back], pa.string())], ["key", "bytes", "text"])
    return encoded.select(F.col(key_col).cast("long").alias("key"), F.col(ids_col).cast("binary").alias("ids")).mapInArrow(
        run, "key long, bytes binary, text string")
