"""Samples, masks, labels and batches from packed windows (SAM, BAT, SMP-7).

A window holds at most C tokens (oversize windows hold one document), so the
per-window ``collect_list`` below is bounded by construction.  Masks are never
stored: ``doc_ids`` determines them, and ``block_runs`` gives the compact form.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError
from .order import hash_key, running_sum, with_pos

OVERSIZE_MODES = ("pad", "truncate")


def build_samples(windows: DataFrame, tokens: DataFrame, context_length: int = 512,
                  pad_token_id: int = 0, bos_token_id: int | None = None,
                  eos_token_id: int | None = None, oversize: str = "pad") -> DataFrame:
    """``window_id, input_ids ARRAY<INT>(C), doc_ids ARRAY<INT>(C), n_docs, n_real``.

    ``tokens``: ``doc_pos, ids``.  Documents are laid out as BOS + ids + EOS in
    slot order and the rest is ``pad_token_id``; ``doc_ids`` is the slot per
    position, -1 for padding.  ``oversize='pad'``: a window whose only document
    does not fit stays all padding (observed behaviour); ``'truncate'``: the
    document is cut to C (documented behaviour).
    """
    if oversize not in OVERSIZE_MODES:
        raise ConfigError(f"oversize must be one of {OVERSIZE_MODES}")
    C = int(context_length)
    j = windows.select("window_id", "slot", "doc_pos", "oversize").join(tokens.select("doc_pos", "ids"), "doc_pos")
    piece = F.col("ids").cast("array<int>")
    if bos_token_id is not None:
        piece = F.concat(F.array(F.lit(int(bos_token_id))), piece)
    if eos_token_id is not None:
        piece = F.concat(piece, F.array(F.lit(int(eos_token_id))))
    if oversize == "pad":
        piece = F.when(F.col("oversize"), F.array().cast("array<int>")).otherwise(piece)
    else:
        piece = F.slice(piece, 1, C)
    per_w = (j.withColumn("piece", piece)
             .groupBy("window_id")
             .agg(F.array_sort(F.collect_list(F.struct("slot", "piece"))).alias("p"),
                  F.count(F.lit(1)).alias("n_docs")))
    flat = F.flatten(F.transform("p", lambda s: s["piece"]))
    owners = F.flatten(F.transform("p", lambda s: F.array_repeat(s["slot"], F.size(s["piece"]))))
    return (per_w.withColumn("_ids", flat).withColumn("_own", owners)
            .select("window_id", "n_docs",
                    F.concat("_ids", F.array_repeat(F.lit(int(pad_token_id)), F.lit(C) - F.size("_ids")))
                    .alias("input_ids"),
                    F.concat("_own", F.array_repeat(F.lit(-1), F.lit(C) - F.size("_own"))).alias("doc_ids"),
                    F.size("_ids").alias("n_real")))


def make_labels(input_ids: str | Column, context_length: int, pad_token_id: int = 0,
                ignore_index: int = 0) -> Column:
    """Next-token labels: shift left by one, last position ignored, and every
    position whose *input* equals the pad id ignored (so a real token equal to
    the pad id is ignored too, and the last real position gets the pad id)."""
    ids = F.col(input_ids) if isinstance(input_ids, str) else input_ids
    C = int(context_length)
    ign = F.lit(int(ignore_index))
    return F.transform(F.sequence(F.lit(1), F.lit(C)), lambda i: F.when(i == C, ign)
                       .when(F.element_at(ids, i) == F.lit(int(pad_token_id)), ign)
                       .otherwise(F.element_at(ids, i + 1)))


def mask_row(doc_ids: str | Column) -> Column:
    """Full C x C block mask on demand (not causal; padding rows all false)."""
    d = F.col(doc_ids) if isinstance(doc_ids, str) else doc_ids
    return F.transform(d, lambda x: F.transform(d, lambda y: (x == y) & (x >= 0)))


def block_runs(doc_ids: str | Column) -> Column:
    """Compact mask: runs ``(start, len, doc)`` of equal non-negative doc ids."""
    d = F.col(doc_ids) if isinstance(doc_ids, str) else doc_ids
    n = F.size(d)
    at = lambda i: F.element_at(d, i)
    starts = F.filter(F.sequence(F.lit(1), n),
                      lambda i: (at(i) >= 0) & ((i == 1) | (at(i) != at(F.greatest(i - 1, F.lit(1))))))
    ends = F.filter(F.sequence(F.lit(1), n),
                    lambda i: (at(i) >= 0) & ((i == n) | (at(i) != at(F.least(i + 1, n)))))
    return F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")),
                       lambda z: F.struct((z["s"] - 1).alias("start"), (z["e"] - z["s"] + 1).alias("len"),
                                          at(z["s"]).alias("doc")))


def doc_spans(samples: DataFrame, bos_token_id: int | None = None, eos_token_id: int | None = None) -> DataFrame:
    """Document boundaries recovered from a sample: one row per run of
    ``doc_ids`` with its start, length and whether it starts with BOS / ends with EOS."""
    runs = samples.select("window_id", "input_ids", F.explode(block_runs("doc_ids")).alias("r"))
    first = F.element_at("input_ids", F.col("r.start") + 1)
    last = F.element_at("input_ids", F.col("r.start") + F.col("r.len"))
    return runs.select(
        "window_id", F.col("r.doc").alias("doc"), F.col("r.start").alias("start"), F.col("r.len").alias("length"),
        (first == F.lit(bos_token_id)).alias("has_bos") if bos_token_id is not None else F.lit(False).alias("has_bos"),
        (last == F.lit(eos_token_id)).alias("has_eos") if eos_token_id is not None else F.lit(False).alias("has_eos"))


def shuffle_windows(windows_ids: DataFrame, seed: int = 0, epoch: int = 0,
                    out_col: str = "order") -> DataFrame:
    """Reproducible per-epoch permutation of ``window_id``: dense rank of
    ``md5(seed:epoch:window_id)``."""
    keyed = windows_ids.withColumn("_h", hash_key(seed, F.lit(epoch), "window_id"))
    return with_pos(keyed, ["_h", "window_id"], out_col).drop("_h")


def assign_batches(ordered: DataFrame, batch_size: int = 8, drop_last: bool = False,
                   order_col: str = "order") -> DataFrame:
    """``batch_id = order div batch_size``; ``drop_last`` removes a short last batch."""
    out = ordered.withColumn("batch_id", F.floor(F.col(order_col) / batch_size).cast("long"))
    if drop_last:
        n = ordered.count()
        full = (n // batch_size) * batch_size
        out = out.where(F.col(order_col) < full)
    return out


def pad_last_batch(batched: DataFrame, context_length: int, batch_size: int = 8,
                   pad_token_id: int = 0, order_col: str = "order") -> DataFrame:
    """Fill a short last batch with all-pad samples (``doc_ids`` all -1)."""
    spark = batched.sparkSession
    n = batched.count()
    missing = (-n) % batch_size
    if missing == 0:
        return batched.withColumn("is_padding", F.lit(False))
    C = int(context_length)
    pads = (spark.range(n, n + missing).select(
        F.lit(None).cast("long").alias("window_id"), F.col("id").alias(order_col),
        F.floor(F.col("id") / batch_size).cast("long").alias("batch_id"),
        F.array_repeat(F.lit(int(pad_token_id)), C).alias("input_ids"),
        F.array_repeat(F.lit(-1), C).alias("doc_ids"), F.lit(True).alias("is_padding")))
    return batched.withColumn("is_padding", F.lit(False)).unionByName(pads, allowMissingColumns=True)


HALF_ROUNDS = 6
_MOST_STEPS = 64


def permuted(index: Column, n: int, seed: int | str, epoch: Column) -> Column:
    """Place of ``index`` (0 <= index < n) in an order of 0..n-1 that ``seed`` and ``epoch`` choose: a formula, no sort.

    A Feistel network on the pairs (l, r) with l < a, r < b, where a * b is n or up to a - 1 more: l gains a hash of
    r modulo a, r gains a hash of l modulo b, in turn.  That is one-to-one on the a * b pairs; an index that lands
    beyond n goes through again until it does not, which stays one-to-one on 0..n-1."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    b = max(1, -(-n // a))

    def half(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), i.cast("string"),
                           F.when(even, s["r"]).otherwise(s["l"]).cast("string"))
        h = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
        return F.struct(F.when(even, (s["l"] + h) % a).otherwise(s["l"]).alias("l"),
                        F.when(even, s["r"]).otherwise((s["r"] + h) % b).alias("r"))

    def once(x: Column) -> Column:
        start = F.struct(F.floor(x / F.lit(b)).cast("long").alias("l"), (x % b).cast("long").alias("r"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(HALF_ROUNDS - 1)), start, half, lambda s: s["l"] * b + s["r"])
    # At most a * b - n indices lie beyond n, so no walk is longer; on many indices longer ones than this never occur.
    steps = F.sequence(F.lit(1), F.lit(min(_MOST_STEPS, a * b - n + 1)))
    end = F.aggregate(steps, index.cast("long") + F.lit(a * b), lambda x, _: F.when(x < n, x).otherwise(
        once(F.when(x >= a * b, x - a * b).otherwise(x))))
    return F.when(end < n, end).otherwise(F.raise_error(F.lit("no place found")))


def token_budget(ordered_batches: DataFrame, context_length: int, batch_size: int,
                 max_tokens: int | None = None, max_batches: int | None = None,
                 epochs: int = 1, seed: int = 0) -> DataFrame:
    """Batches consumed by a token / batch budget over reshuffled epochs.

    ``ordered_batches``: one row per window with ``window_id`` (0, 1, 2, ... as packing numbers them; others are
    numbered first).  Every batch counts ``batch_size * C`` tokens (padding included); batches are taken while the
    tokens before them are under ``max_tokens`` (or their number is under ``max_batches``).  An epoch's order is
    :func:`permuted` of the window's number: nothing is sorted or written for it, and epochs past the budget are
    never looked at.
    """
    ids = ordered_batches.select("window_id")
    n, low, high = ids.agg(F.count(F.lit(1)), F.min("window_id"), F.max("window_id")).first()
    if n and (low, high) == (0, n - 1):
        rows = ids.withColumn("_at", F.col("window_id"))
    else:
        rows = with_pos(ids, ["window_id"], "_at")
    nb, tok = -(-n // batch_size), batch_size * int(context_length)
    last = min([epochs * nb, *([-(-int(max_tokens) // tok)] if max_tokens is not None else []),
                *([int(max_batches)] if max_batches is not None else [])])  # batches within the budget
    used = -(-last // nb) if nb else 0
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(used - 1)) if used else F.array().cast("array<int>")))
    rows = rows.withColumn("order", permuted(F.col("_at"), n, seed, F.col("epoch"))).drop("_at")
    rows = rows.withColumn("batch_global", F.col("epoch") * nb + F.floor(F.col("order") / batch_size))
    return rows.where(F.col("batch_global") < last).withColumn("tokens_before", F.col("batch_global") * tok)


def tokens_seen(batches: DataFrame, context_length: int, batch_size: int) -> DataFrame:
    """Running tokens seen per batch (padding included) beside real tokens."""
    per = batches.groupBy("batch_id").agg(F.sum("n_real").alias("real"))
    per = per.withColumn("all", F.lit(batch_size * int(context_length)))
    ordered = with_pos(per, ["batch_id"], "_p")
    ordered = running_sum(ordered, "all", "tokens_seen", pos_col="_p")
    ordered = running_sum(ordered, "real", "real_tokens_seen", pos_col="_p")
    return ordered.drop("_p")
