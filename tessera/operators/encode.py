"""Encoding documents into token tables, offsets, totals, decoding.

Two encoders:

``encode_rank``     word-level ids from a rank vocabulary (``vocab.rank_vocab``),
                    a join of the distinct pre-tokens of blocks of documents with
                    the vocabulary, see :mod:`tessera.operators.lookup`.
``encode_subword``  BPE / WordPiece ids with a trained ``SubwordModel``: pre-tokens
                    are cut in the JVM, and one ``mapInArrow`` pass applies the
                    merges per distinct word of ``BLOCK_WORDS`` words (and a
                    per-task cache), with the model (bounded by ``vocab_size``)
                    shipped in the closure.  No
                    shuffle: document order inside a partition is kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import chain
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ValidationError
from ..functions.text import clean_markers, normalize, normalize_parts, pretokenize
from .lookup import cut_blocks, is_cut, looked_up, looked_up_blocks
from .order import running_sum, with_pos
from .vocab import SubwordModel

BLOCK_WORDS = 1 << 20


def token_blocks(docs: DataFrame, key: Sequence[str] = ("doc_id",), text_col: str = "text",
                 pre_tokenizer: str = "whitespace") -> DataFrame:
    """``key`` and the pre-tokens of each document as blocks, written: ``vocab.word_counts`` and
    ``encode_rank`` take them in place of the documents, which are then cut into words once."""
    return cut_blocks(docs.select(*key, pretokenize(text_col, pre_tokenizer).alias("_tokens")), "_tokens")


def encode_rank(docs: DataFrame, vocab: DataFrame, key: Sequence[str] = ("doc_id",),
                text_col: str = "text", pre_tokenizer: str = "whitespace",
                eos_id: int | None = None) -> DataFrame:
    """``key + (ids ARRAY<INT>, n_tokens INT)``; pre-tokens missing from the vocabulary are dropped."""
    keys = list(key)
    blocks = docs if is_cut(docs) else token_blocks(docs, keys, text_col, pre_tokenizer)
    known = vocab.select("token", F.col("id").cast("int").alias("id"))
    # documents without any known pre-token have an empty array
    out = looked_up_blocks(blocks, keys, known, "token", "id").withColumnRenamed("_values", "ids")
    if eos_id is not None:
        out = out.withColumn("ids", append_eos("ids", eos_id))
    return out.withColumn("n_tokens", F.size("ids"))


def append_eos(ids: str | Column, eos_id: int) -> Column:
    c = F.col(ids) if isinstance(ids, str) else ids
    return F.concat(c, F.array(F.lit(int(eos_id))))


def _unigram_encoder(model: SubwordModel):
    from .vocab import _viterbi
    ids = {t: i for i, t in enumerate(model.tokens)}
    logp = {t: s for t, s in zip(model.tokens, model.scores) if t not in model.special_tokens}

    def encode_word(word: str) -> list[int]:
        seg, _ = _viterbi(word, logp, model.max_piece_len)
        if seg is None:  # characters outside the vocabulary are dropped
            seg, _ = _viterbi("".join(ch for ch in word if ch in logp), logp, model.max_piece_len)
        return [ids[p] for p in (seg or [])]

    return encode_word


def _wordpiece_encoder(model: SubwordModel):
    """Longest piece first; a word with a place where no piece fits is the unknown token."""
    ids = {t: i for i, t in enumerate(model.tokens) if t not in model.special_tokens}
    longest = max(map(len, ids), default=0)
    unknown = model.tokens.index(model.unk_token) if model.unk_token in model.tokens else None

    def encode_word(word: str) -> list[int]:
        out, at = [], 0
        while at < len(word):
            lead = model.prefix if at else ""
            for end in range(min(len(word), at + longest), at, -1):
                piece = ids.get(lead + word[at:end])
                if piece is not None:
                    break
            else:
                if unknown is None:
                    raise ValueError(f"no piece for {word!r} at {at}, and the vocabulary has no unknown token")
                return [unknown]
            out.append(piece)
            at = end
        return out

    return encode_word


def _subword_encoder(model: SubwordModel):
    if model.kind == "unigram":
        return _unigram_encoder(model)
    if model.kind == "wordpiece":
        return _wordpiece_encoder(model)
    tokens = model.tokens
    ids = {t: i for i, t in enumerate(tokens)}
    ranks = {pair: r for r, pair in enumerate(model.merges)}
    merged_id = {}
    for a, b in model.merges:
        merged_id[(a, b)] = ids[tokens[a] + tokens[b]]

    def encode_word(word: str) -> list[int]:
        syms = [ids[ch] for ch in word if ch in ids]  # characters outside the alphabet are dropped
        while len(syms) > 1:
            best, best_r = None, None
            for p in zip(syms, syms[1:]):
                r = ranks.get(p)
                if r is not None and (best_r is None or r < best_r):
                    best, best_r = p, r
            if best is None:
                break
            a, b = best
            c = merged_id[best]
            out, i = [], 0
            while i < len(syms):
                if i + 1 < len(syms) and syms[i] == a and syms[i + 1] == b:
                    out.append(c)
                    i += 2
                else:
                    out.append(syms[i])
                    i += 1
            syms = out
        return syms

    return encode_word


def is_single_token(model: SubwordModel, text: str) -> bool:
    """Special-token probe: ``text`` counts as a token only if it encodes to exactly one id, normalised
    and cut into words as any text of the model is."""
    if text in model.special_tokens:
        return True
    one = SparkSession.active().createDataFrame([(0, text)], "doc_id int, text string")
    return encode_subword(one, model).first()["n_tokens"] == 1


def _words(docs: DataFrame, keys: list[str], text_col: str, model: SubwordModel) -> DataFrame:
    """Keys and ``_words``: the text's special tokens as they are, everything between
    them normalised and pre-tokenised as the model was trained."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    if not model.special_tokens:
        return docs.select(*keys, pretokenize(normalize(text, model.normalizer), model.pre_tokenizer).alias("_words"))
    names = sorted(model.special_tokens, key=len, reverse=True)
    either = "|".join(re.sub(r"([^\w])", r"\\\1", t) for t in names)
    # a text without any of them is one part, without a look ahead at each of its places
    cut = F.regexp_extract_all(text, F.lit(rf"(?s){either}|(?:(?!{either}).)+"), 0)
    parts = F.when((text == "") | reduce(or_, [text.contains(t) for t in names]), cut).otherwise(F.array(text))
    parts = normalize_parts(parts, model.normalizer, names)
    rows = docs.select(*keys, parts.alias("_parts"))
    special = lambda p: p.isin(names)
    return rows.select(*keys, F.flatten(F.transform("_parts", lambda p: F.when(special(p), F.array(p)).otherwise(
        pretokenize(p, model.pre_tokenizer)))).alias("_words"))


def encode_subword(docs: DataFrame, model: SubwordModel, key: Sequence[str] = ("doc_id",),
                   text_col: str = "text", eos_id: int | None = None, cache_size: int = 200_000) -> DataFrame:
    """``key + (ids, n_tokens)``; normaliser, pre-tokeniser and special tokens are the model's."""
    keys = list(key)
    pre = _words(docs, keys, text_col, model)
    key_fields = [f for f in pre.schema.fields if f.name in keys]
    key_fields = [next(f for f in key_fields if f.name == k) for k in keys]
    schema = T.StructType(key_fields + [T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
                                        T.StructField("n_tokens", T.IntegerType())])
    encode_word = _subword_encoder(model)
    special = {t: [i] for i, t in enumerate(model.tokens) if t in model.special_tokens}

    ids_type = pa.list_(pa.field("element", pa.int32(), nullable=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, list[int]] = {}
        held, n = [], 0

        def out() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            lists = t.column("_words").combine_chunks()
            words, pieces = lists.flatten().dictionary_encode(), []
            for w in words.dictionary.to_pylist():
                e = special.get(w) or cache.get(w)
                if e is None:
                    e = encode_word(w)
                    if len(cache) < cache_size:
                        cache[w] = e
                pieces.append(e)
            sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
            flat = np.fromiter(chain.from_iterable(pieces), np.int32, int(sizes.sum()))
            at, start = words.indices.to_numpy(), np.cumsum(sizes) - sizes
            ends = np.concatenate([[0], np.cumsum(sizes[at])])
            ids = flat[np.repeat(start[at] - ends[:-1], sizes[at]) + np.arange(ends[-1])]
            rows = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())])
            bounds = ends[rows]
            if eos_id is not None:
                ids, bounds = np.insert(ids, bounds[1:], int(eos_id)), bounds + np.arange(len(bounds))
            return pa.RecordBatch.from_arrays(
                [*(t.column(k).combine_chunks() for k in keys),
                 pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()), type=ids_type),
                 pa.array(np.diff(bounds), pa.int32())], [*keys, "ids", "n_tokens"])
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += len(batch.column("_words").flatten())
            if n >= BLOCK_WORDS:
                yield out()
                held, n = [], 0
        if held:
            yield out()

    return pre.mapInArrow(run, schema)


def document_tokens(store: DataFrame, doc_pos: int, pos_col: str = "doc_pos") -> DataFrame:
    """The one document of a token store at ``doc_pos``; a place that it does not have is an error."""
    found = store.where(F.col(pos_col) == int(doc_pos))
    if doc_pos < 0 or found.isEmpty():
        raise ValidationError(f"document {doc_pos} is outside the store of {store.count()} documents")
    return found


def reconcile(totals: DataFrame, stats_path: str) -> DataFrame:
    """``split, documents, expected_documents, matches``: counts of a token store beside the
    statistics stored with the corpus.  Without readable statistics nothing is expected."""
    spark = totals.sparkSession
    try:
        row = spark.read.json(stats_path).select("train_records", "validation_records").first()
    except AnalysisException:
        row = None
    pairs = [] if row is None else [("train", row[0]), ("validation", row[1])]
    expected = spark.createDataFrame(pairs, "split string, expected_documents long")
    return totals.select("split", "documents").join(F.broadcast(expected), "split", "left").withColumn(
        "matches", F.col("documents") == F.col("expected_documents"))


def token_offsets(encoded: DataFrame, order: Sequence[str] = ("doc_id",), pos_col: str = "doc_pos") -> DataFrame:
    """Dense document position and ``start``/``end`` offsets into the flat token stream."""
    ordered = with_pos(encoded, list(order), pos_col)
    with_end = running_sum(ordered, "n_tokens", "end", pos_col=pos_col)
    return with_end.withColumn("start", F.col("end") - F.col("n_tokens"))


def token_totals(encoded: DataFrame, split_col: str = "split", eos_id: int | None = None) -> DataFrame:
    return encoded.groupBy(split_col).agg(
        F.sum("n_tokens").cast("long").alias("tokens"),
        F.count(F.lit(1)).alias("documents"),
        F.lit(eos_id).cast("long").alias("eos_id"))


def decode_ids(rows: DataFrame, vocab: DataFrame, ids_col: str = "ids", key: Sequence[str] = ("row_id",),
               clean: bool = True) -> DataFrame:
    """Ids -> text: each id decoded alone, pieces concatenated without spaces,
    byte-level markers cleaned.  Unknown ids decode to nothing."""
    keys = list(key)
    named = vocab.select(F.col("id").cast("int").alias("id"), "token")
    out = looked_up(rows, keys, ids_col, named, "id", "token").select(*keys, F.array_join("_values", "").alias("text"))
    return out.withColumn("text", clean_markers("text")) if clean else out


def cut_at_eos(ids: str | Column, eos_id: int) -> Column:
    """Ids before the first EOS (EOS excluded); unchanged when there is none."""
    c = F.col(ids) if isinstance(ids, str) else ids
    p = F.array_position(c, F.lit(int(eos_id)))
    return F.when(p > 0, F.slice(c, 1, (p - 1).cast("int"))).otherwise(c)
