"""Preference formatting: chosen and rejected conversations as prompt and masked completions.

The longest common prefix of turns (equal role and text, turn by turn) of both
conversations is rendered once as the prompt; the turns after it are the two
completions.  A turn is rendered as

    <|im_start|>role NEWLINE text<|im_end|> NEWLINE

A completion's mask lists runs (length in characters, trained) that add up to
its length: a turn's header (not trained), its text with the end marker
(trained for the assistant), and the newline (not trained).

All of it is DataFrame code in the JVM; one pair's turns make one row.

Inputs: a null role or text counts as empty; markers inside a text get a blank
after "<" so that they cannot open or close a turn.  Turns are ordered by turn
number (nulls first), role and text; repeated turns stay.  Turns without a
conversation id belong to none.  A pair without turns on one side has an empty
prompt and an empty completion there; one without turns at all is absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"


def _safe(text: Column) -> Column:
    for marker in (START, END):
        text = F.replace(text, F.lit(marker), F.lit("< " + marker[1:]))
    return text


def _header(turn: Column) -> Column:
    return F.concat(F.lit(START), turn["role"], F.lit("\n"))


def _body(turn: Column) -> Column:
    return F.concat(turn["text"], F.lit(END))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), _body(t), F.lit("\n"))), "")


def mask(turns: Column) -> Column:
    def run(length: Column, trained: Column) -> Column:
        return F.struct(length.cast("int").alias("length"), trained.alias("trained"))
    no = F.lit(False)
    return F.flatten(F.transform(turns, lambda t: F.array(
        run(F.length(_header(t)), no), run(F.length(_body(t)), t["role"] == TRAINED_ROLE), run(F.lit(1), no))))


def format_preferences(turns: DataFrame, pairs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                       role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``pairs`` has ``pair_id``, ``chosen_id``, ``rejected_id``.  One row per pair: ``pair_id``,
    ``n_common``, ``n_chosen``, ``n_rejected`` (turns), ``prompt``, ``chosen``, ``rejected``,
    ``chosen_mask``, ``rejected_mask``."""
    sides = pairs.select("pair_id", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("chosen_id").alias("conv")),
        F.struct(F.lit(1).alias("side"), F.col("rejected_id").alias("conv")))).alias("s")).select(
        "pair_id", "s.side", "s.conv")
    said = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        _safe(F.coalesce(F.col(role_col).cast("string"), F.lit(""))).alias("role"),
        _safe(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text"))
    rows = said.join(sides, "conv").groupBy("pair_id").agg(
        F.sort_array(F.collect_list(F.struct("side", "turn", "role", "text"))).alias("all"))
    rows = rows.select("pair_id", F.filter("all", lambda t: t["side"] == 0).alias("a"),
                       F.filter("all", lambda t: t["side"] == 1).alias("b"))
    n = F.least(F.size("a"), F.size("b"))
    same = F.zip_with(F.slice("a", 1, n), F.slice("b", 1, n),
                      lambda x, y: (x["role"] == y["role"]) & (x["text"] == y["text"]))
    place = F.array_position(same, False)
    rows = rows.withColumn("n_common", F.when(place > 0, place - 1).otherwise(n.cast("long")))
    rest = {c: F.slice(c, F.col("n_common").cast("int") + 1, F.greatest(F.size(c), F.lit(1))) for c in ("a", "b")}
    return rows.select(
        "pair_id", "n_common", F.size("a").cast("long").alias("n_chosen"), F.size("b").cast("long").alias("n_rejected"),
        render(F.slice("a", 1, F.col("n_common").cast("int"))).alias("prompt"),
        render(rest["a"]).alias("chosen"), render(rest["b"]).alias("rejected"),
        mask(rest["a"]).alias("chosen_mask"), mask(rest["b"]).alias("rejected_mask"))
