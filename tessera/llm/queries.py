"""Queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, byte_tokens, chat, decontaminate, jaccard, lines, phrases, pii, quality, repair, repeats, toxicity
from .common import held_out, read_table
from .oracles import ORACLES as ORACLES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_file() -> str:
    """The tokenizer that the queries use; operators take the path as a parameter."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@_query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.remove_boilerplate(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "text", "n_lines", "n_removed")


@_query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"], x["stop"])), ",")
    return toxicity.tag(docs, model).select(
        F.col("key").alias("doc_id"), held_out("key").alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), spans.alias("spans"))


@_query
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts are those of the plain detectors; ``n_disguised`` counts the spans that deobfuscation adds."""
    found = pii.find(read_table(spark, sf_dir, "documents"))
    joined = {c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")
              for c in ("plain", "spans")}

    def count(kind: str):
        return F.size(F.filter("plain", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(F.col("key").alias("doc_id"), *[count(k) for k in pii.KINDS],
                        F.sha2(joined["plain"], 256).alias("base_sha256"), joined["spans"].alias("spans"),
                        (F.size("spans") - F.size("plain")).cast("long").alias("n_disguised"))


@_query
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.group(read_table(spark, sf_dir, "documents")).select(
        F.col("key").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"),
        F.col("component").alias("component_id"))


@_query
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(read_table(spark, sf_dir, "documents"), tokenizer_file())
    return coded.select(F.col("key").alias("doc_id"),
                        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


@_query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select(
        F.col("key").alias("doc_id"), held_out("key").alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"))


@_query
def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    return ann.search(ann.build_index(rows, 5), rows.where("vec_id % 50 = 0"), 5)


@_query
def op8_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2n and 2n + 1 are pair n; the even one is the chosen."""
    turns = read_table(spark, sf_dir, "conversations")
    pair = F.shiftright("conv_id", 1)
    pairs = turns.where("conv_id is not null").select(pair.alias("pair_id")).distinct().select(
        "pair_id", (F.col("pair_id") * 2).alias("chosen_id"), (F.col("pair_id") * 2 + 1).alias("rejected_id"))

    def text(c: str):
        return F.array_join(F.transform(c, lambda r: F.concat_ws(":", r["length"], r["trained"].cast("int"))), ",").alias(c)
    return chat.format_preferences(turns, pairs).select(
        "pair_id", "n_common", "n_chosen", "n_rejected", "prompt", "chosen", "rejected", text("chosen_mask"),
        text("rejected_mask"))


@_query
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.remove_repeats(read_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
    return cut.select(F.col("key").alias("doc_id"), "n_bytes", removed.alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@_query
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(read_table(spark, sf_dir, "documents"),
                                             read_table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(F.col("key").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


@_query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damaged(read_table(spark, sf_dir, "conversations")))


@_query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.best(phrases.collocations(read_table(spark, sf_dir, "documents")))


@_query
def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``n_split`` counts the tokens that begin or end inside a character."""
    import public_tokenizers
    coded = byte_tokens.encode(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                               public_tokenizers.PATTERN, offsets=False)
    return coded.select(F.col("key").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"), "n_split")
