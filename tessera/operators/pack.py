"""Exact next-fit packing of documents into fixed-length windows, in parallel.

Rule (sequential statement): walk the non-empty documents in order with an open
window; a document whose effective length (tokens + BOS/EOS overhead) exceeds
the context length C closes the open window and stands alone; otherwise it
opens a new window when it would overflow C or when the window already holds
``max_docs`` documents.

Parallel form.  With ``cs`` the exclusive prefix sum of effective lengths and
``ce = cs + len``, the window starting at document i ends before

    next(i) = greatest(i + 1, least(i + max_docs, 1 + max{k : ce_k <= cs_i + C}))

and the windows are the orbit of the first document under ``next``.

* Documents are cut into blocks of B tokens by ``cs``, so of at most B documents
  (each has a token).  Every document ending within C tokens of its block's
  start is copied into the previous block as halo, so ``next`` is computable
  inside each block (B >= C).
* Pass 1 (``applyInPandas`` per block): for the entry candidates (the block's
  first document and those starting within its first C tokens), the first
  window start past the block and the number of windows until then, by pointer
  doubling.  The block's map has at most C + 1 entries.
* Maps of neighbouring blocks compose; a tree over the blocks of all groups at
  once (:mod:`.compose`) gives each block the map of those before it, which from
  the group's first document leads to the block's true entry and the number of
  windows before it.
* Pass 2 (per block): walk ``next`` from the true entry, emit one row per
  document with its window and slot.

Nothing but the plan reaches the driver; a task is bounded by B tokens.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConfigError
from .compose import scan
from .order import running_sum, with_group_pos, with_pos, written

DEFAULT_BLOCK_TOKENS = 1 << 18


def _next_array(k, cs, ce, own_n, C, max_docs):
    """next(i) for the first ``own_n`` rows (the block's own documents)."""
    cs_own = cs[:own_n]
    last = np.searchsorted(ce, cs_own + C, side="right") - 1
    idx = np.arange(own_n)
    nxt = np.where(last >= idx, k[np.maximum(last, 0)] + 1, k[:own_n] + 1)
    if max_docs is not None:
        nxt = np.minimum(nxt, k[:own_n] + max_docs)
    return np.maximum(nxt, k[:own_n] + 1)


def _block_arrays(pdf: pd.DataFrame):
    pdf = pdf.sort_values("k", kind="stable")
    own_n = int(pdf["own"].sum())
    return pdf, pdf["k"].to_numpy(np.int64), pdf["cs"].to_numpy(np.int64), pdf["ce"].to_numpy(np.int64), own_n


def _block_maps(C: int, max_docs, keys: list[str]):
    """Rows of one block -> its map: entries, exits and numbers of windows, one after the other."""
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, k, cs, ce, own_n = _block_arrays(pdf)
        if own_n == 0:
            return pdf.iloc[:0].assign(value=pd.Series([], dtype=object))[[*keys, "block", "value"]]
        nxt = _next_array(k, cs, ce, own_n, C, max_docs)
        inside = nxt <= k[own_n - 1]
        last, steps = np.where(inside, nxt - k[0], np.arange(own_n)), inside.astype(np.int64)
        for _ in range(int(own_n).bit_length()):
            steps, last = steps + steps[last], last[last]
        entries = np.flatnonzero(cs[:own_n] < cs[0] + C) if k[0] > 0 else np.zeros(1, np.int64)
        value = np.concatenate([k[entries], nxt[last[entries]], steps[entries] + 1])
        return pdf.iloc[:1].assign(value=[value])[[*keys, "block", "value"]]
    return fn


def compose_maps(a, b) -> np.ndarray:
    """First ``a``, then ``b``; an exit of ``a`` that is no entry of ``b`` lies beyond it and stays."""
    (ea, xa, wa), (eb, xb, wb) = np.reshape(a, (3, -1)), np.reshape(b, (3, -1))
    at = np.minimum(np.searchsorted(eb, xa), len(eb) - 1)
    hit = eb[at] == xa
    return np.concatenate([ea, np.where(hit, xb[at], xa), wa + np.where(hit, wb[at], 0)])


def _windows_of(C: int, max_docs, keys: list[str]):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        entry, before = int(pdf["entry"].iloc[0]), int(pdf["before"].iloc[0])
        pdf, k, cs, ce, own_n = _block_arrays(pdf)
        first, last_own = int(k[0]), int(k[own_n - 1]) if own_n else -1
        nxt = _next_array(k, cs, ce, own_n, C, max_docs)
        starts, ends = [], []
        s = entry
        while s <= last_own:
            e = int(nxt[s - first])
            starts.append(s)
            ends.append(e)
            s = e
        starts_a = np.asarray(starts, dtype=np.int64)
        lens = np.asarray(ends, dtype=np.int64) - starts_a
        w = before + np.repeat(np.arange(len(starts_a), dtype=np.int64), lens)
        slot = np.arange(len(w), dtype=np.int64) - np.repeat(np.cumsum(lens) - lens, lens)
        rows = pdf.iloc[np.repeat(starts_a, lens) + slot - first]
        return rows.assign(window_id=w, slot=slot.astype(np.int32))[[*keys, "window_id", "slot", "doc_pos", "n_tokens", "eff"]]
    return fn


def pack_windows(docs: DataFrame, context_length: int = 512, overhead: int = 0,
                 max_docs: int | None = None, group_cols: Sequence[str] = (),
                 block_tokens: int = DEFAULT_BLOCK_TOKENS) -> DataFrame:
    """Assign every non-empty document to a window.

    ``docs`` needs ``doc_pos`` (unique, increasing = document order within the
    group) and ``n_tokens``.  Returns ``group_cols + (window_id, slot, doc_pos,
    n_tokens, eff_len, oversize)``; ``window_id`` is dense from 0 per group.
    Rows whose group is null belong to no group and are left out.
    """
    C = int(context_length)
    if C < 1:
        raise ConfigError("context_length must be >= 1")
    if max_docs is not None and max_docs < 1:
        raise ConfigError("max_docs_per_window must be >= 1 (0 would emit an empty first window)")
    groups = list(group_cols)
    B = C * math.ceil(max(C, int(block_tokens)) / C)

    # narrow (two longs per document), kept before filtering: the lengths are
    # computed once from the text (not again by the pushed-down filter, the
    # range sort's sampling pass and its shuffle)
    lengths = written(docs.select(*groups, F.col("doc_pos").cast("long"), F.col("n_tokens").cast("long")))
    ne = (lengths.where(F.col("n_tokens") > 0)
          .withColumn("eff", F.col("n_tokens") + F.lit(int(overhead))))
    # dense document index per group
    if groups:
        ne = with_group_pos(ne, groups, ["doc_pos"], "k", "gpos")
    else:
        ne = with_pos(ne, ["doc_pos"], "gpos").withColumn("k", F.col("gpos"))
    ne = running_sum(ne, "eff", "ce", pos_col="gpos", partition_by=groups)
    ne = ne.withColumn("cs", F.col("ce") - F.col("eff")).withColumn("block", F.floor(F.col("cs") / F.lit(B)).cast("long"))
    keys = groups or ["_all"]
    ne = ne if groups else ne.withColumn("_all", F.lit(0))
    rows = written(ne.select(*keys, "block", F.lit(True).alias("own"), "k", "doc_pos", "n_tokens", "eff", "cs", "ce"))
    halo = (rows.where((F.col("block") > 0) & (F.col("ce") - F.col("block") * F.lit(B) <= F.lit(C)))
            .withColumn("block", F.col("block") - 1).withColumn("own", F.lit(False)))
    parts = rows.unionByName(halo)

    key_fields = [f for f in parts.schema.fields if f.name in keys]
    longs = T.StructType([*key_fields, T.StructField("block", T.LongType()), T.StructField("value", T.ArrayType(T.LongType()))])
    # groups of one block begin at their first document
    several = rows.where("block > 0").select(*keys).distinct()
    maps = (parts.join(several, keys, "left_semi").groupBy(*keys, "block")
            .applyInPandas(_block_maps(C, max_docs, keys), longs))
    before, _ = scan(maps, keys, "block", "value", compose_maps)
    entries = before.select(*keys, "block", F.coalesce(F.element_at("rest", 2), F.lit(0)).alias("entry"),
                            F.coalesce(F.element_at("rest", 3), F.lit(0)).alias("before"))
    out = T.StructType([*key_fields, *(T.StructField(c, T.IntegerType() if c == "slot" else T.LongType()) for c in (
        "window_id", "slot", "doc_pos", "n_tokens", "eff"))])
    assigned = (parts.join(entries, [*keys, "block"], "left").fillna(0, ["entry", "before"]).groupBy(*keys, "block")
                .applyInPandas(_windows_of(C, max_docs, keys), out))
    return assigned.select(*groups, "window_id", "slot", "doc_pos", "n_tokens",
                           F.col("eff").alias("eff_len"), (F.col("eff") > F.lit(C)).alias("oversize"))


def pack_stats(windows: DataFrame, docs: DataFrame, context_length: int = 512,
               batch_size: int = 8, drop_last: bool = False,
               group_cols: Sequence[str] = ()) -> DataFrame:
    """Packing statistics (one row per group).

    ``total_documents`` counts every input document, empty ones included;
    tokens per window sum ``min(n_tokens, C)`` without BOS/EOS, so oversize
    windows count as full.  ``real_token_share`` is the share of window slots
    that hold document tokens in the padded samples (oversize -> none).
    """
    C = int(context_length)
    groups = list(group_cols)
    per_w = windows.groupBy(*groups, "window_id").agg(
        F.count(F.lit(1)).alias("docs"),
        F.sum(F.least(F.col("n_tokens"), F.lit(C))).alias("tok"),
        F.sum(F.when(F.col("oversize"), 0).otherwise(F.col("eff_len"))).alias("real"))
    agg = per_w.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("total_windows"),
        F.avg("docs").alias("avg_docs_per_window"),
        F.avg("tok").alias("avg_tokens_per_window"),
        F.min("docs").alias("min_docs_per_window"),
        F.max("docs").alias("max_docs_per_window"),
        F.sum("real").alias("_real"))
    n_docs = docs.groupBy(*groups).agg(F.count(F.lit(1)).alias("total_documents"))
    nb = (F.floor(F.col("total_windows") / batch_size) if drop_last
          else F.ceil(F.col("total_windows") / batch_size))
    if groups:
        out = n_docs.join(agg, groups, "left")
    else:  # both sides are single-row aggregates
        out = n_docs.withColumn("_all", F.lit(0)).join(agg.withColumn("_all", F.lit(0)), "_all", "left")
    return out.select(
        *groups,
        F.col("total_documents").cast("long").alias("total_documents"),
        F.coalesce(F.col("total_windows"), F.lit(0)).cast("long").alias("total_windows"),
        F.coalesce(nb, F.lit(0)).cast("long").alias("total_batches"),
        F.lit(C).alias("context_length"),
        F.lit(int(batch_size)).alias("batch_size"),
        F.round("avg_docs_per_window", 6).alias("avg_docs_per_window"),
        F.round("avg_tokens_per_window", 6).alias("avg_tokens_per_window"),
        F.round(F.col("avg_tokens_per_window") / F.lit(C), 6).alias("avg_packing_efficiency"),
        F.col("min_docs_per_window").cast("long").alias("min_docs_per_window"),
        F.col("max_docs_per_window").cast("long").alias("max_docs_per_window"),
        F.round(F.col("_real") / (F.col("total_windows") * F.lit(C)), 6).alias("real_token_share"),
    )
