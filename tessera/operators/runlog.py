"""Run-log analytics: metric series, evaluation, inference results, ranking.

Inputs are long tables (one row per point); every function takes the column
names it reads.  Per-series "last N" selections use ``row_number() <= N``,
which Spark plans as a window group limit (partial top-k before the shuffle),
so one hot series does not pull its whole history into one sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import hash_key, running_sum, with_group_pos

WINDOW_SIZE = 1000  # points kept per series by the windowed history
TIMING_WINDOW = 100  # non-zero durations averaged per timing category


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x: str | Column) -> Column:
    v = _c(x)
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))


def last_n(points: DataFrame, series: Sequence[str], order: Sequence[str], n: int = WINDOW_SIZE,
           value: str | None = None) -> DataFrame:
    """The last ``n`` points per series (optionally only non-null ``value``)."""
    src = points.where(F.col(value).isNotNull()) if value else points
    w = Window.partitionBy(*series).orderBy(*[F.col(o).desc() for o in order])
    return src.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def best_value(points: DataFrame, series: Sequence[str], value: str) -> DataFrame:
    return points.groupBy(*series).agg(F.min(value).alias("best"))


def current_value(points: DataFrame, series: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """Last non-null value in order."""
    key = F.struct(*[F.col(o) for o in order])
    return (points.where(F.col(value).isNotNull()).groupBy(*series)
            .agg(F.max_by(value, key).alias("current")))


def avg_last(points: DataFrame, series: Sequence[str], value: str, order: Sequence[str],
             last: int | None = None, window_size: int = WINDOW_SIZE) -> DataFrame:
    """Mean of the last ``last`` points within the windowed history (all of it when None)."""
    win = last_n(points, series, order, window_size, value)
    if last is not None:
        win = last_n(win, series, order, last, value)
    return win.groupBy(*series).agg(F.avg(value).alias("avg"))


def metric_stats(points: DataFrame, series: Sequence[str], value: str, order: Sequence[str],
                 batch: str, tokens: str, last: int = 100, window_size: int = WINDOW_SIZE) -> DataFrame:
    """Statistics row per series: counts over the full history, averages over the window."""
    full = points.groupBy(*series).agg(
        F.max(batch).alias("max_batch"), F.max(tokens).alias("max_tokens"),
        F.count(value).alias("points"), F.min(value).alias("best"),
        F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*[F.col(o) for o in order]))).alias("current"))
    win = last_n(points, series, order, window_size, value)
    w_rank = Window.partitionBy(*series).orderBy(*[F.col(o).desc() for o in order])
    win = win.withColumn("_rn", F.row_number().over(w_rank))
    avgs = win.groupBy(*series).agg(F.avg(value).alias("avg_window"),
                                    F.avg(F.when(F.col("_rn") <= last, F.col(value))).alias("avg_last"))
    return full.join(avgs, list(series), "left")


def weighted_loss(batches: DataFrame, loss_sum: str = "loss_sum", n_tokens: str = "n_tokens") -> DataFrame:
    """Token-weighted loss, perplexity; batch loss is 0 when a batch has no tokens."""
    return batches.agg(
        F.coalesce(F.sum(loss_sum) / F.nullif(F.sum(n_tokens), F.lit(0)), F.lit(0.0)).alias("loss"),
        F.sum(n_tokens).cast("long").alias("total_tokens"),
        F.count(F.lit(1)).alias("num_batches"),
    ).withColumn("perplexity", F.exp("loss"))


def batch_losses(batches: DataFrame, loss_sum: str = "loss_sum", n_tokens: str = "n_tokens") -> Column:
    return F.when(F.col(n_tokens) > 0, F.col(loss_sum) / F.col(n_tokens)).otherwise(F.lit(0.0))


def mean_finite(values: DataFrame, value: str) -> DataFrame:
    """Mean over finite values only; null when there are none."""
    return values.where(finite(value)).agg(F.avg(value).alias("mean_loss"),
                                           F.count(F.lit(1)).alias("finite_points"))


def compare_loss(recorded: str | Column, current: str | Column) -> list[Column]:
    """Difference, percent change (0 when recorded <= 0) and a 4-class verdict."""
    r, c = _c(recorded), _c(current)
    diff = c - r
    pct = F.when(r > 0, diff / r * 100).otherwise(F.lit(0.0))
    verdict = (F.when(F.abs(pct) < 1, "very_close").when(F.abs(pct) < 5, "small")
               .when(F.abs(pct) < 20, "moderate").otherwise("large"))
    return [diff.alias("difference"), pct.alias("percent_change"), verdict.alias("verdict")]


def tokens_per_sec(count: str | Column, seconds: str | Column) -> Column:
    return F.when(_c(seconds) > 0, _c(count) / _c(seconds)).otherwise(F.lit(0.0))


def inference_summary(results: DataFrame) -> DataFrame:
    """Generations, prompts, mean tokens, mean time, mean of per-row speeds."""
    return results.agg(
        F.count(F.lit(1)).alias("generations"),
        F.count_distinct("prompt_idx").alias("prompts"),
        F.avg("token_count").alias("avg_tokens"),
        F.avg("generation_time").alias("avg_time"),
        F.avg("tokens_per_sec").alias("avg_tokens_per_sec"),
        F.avg(F.length("generated_text")).alias("avg_chars"))


# --- ranking within groups -------------------------------------------------------------
def topk_ties(scored: DataFrame, group: str, score: str, k: int) -> DataFrame:
    """Items whose score is at least the k-th largest of the group (ties kept)."""
    w = Window.partitionBy(group).orderBy(F.col(score).desc())
    return scored.withColumn("rank", F.rank().over(w)).where(F.col("rank") <= k)


def share_cut(scored: DataFrame, group: str, item: str, score: str, p: float,
              temperature: float = 1.0) -> DataFrame:
    """Keep the highest-scoring items until the inclusive softmax share passes
    ``p``; the item crossing it is dropped, the first item always kept.

    Group maxima and totals are aggregates; the cumulative share is a sharded
    running sum over the dense in-group rank, so a hot group is not sorted in
    one task.
    """
    s = F.col(score) / F.lit(float(temperature))
    x = scored.withColumn("_s", s)
    x = x.join(x.groupBy(group).agg(F.max("_s").alias("_m")), group)
    x = x.withColumn("_e", F.exp(F.col("_s") - F.col("_m")))
    x = x.join(x.groupBy(group).agg(F.sum("_e").alias("_t")), group)
    x = x.withColumn("share", F.col("_e") / F.col("_t"))
    x = with_group_pos(x, [group], [F.col(score).desc(), F.col(item)], "_r", "_gp")
    x = running_sum(x, "share", "cum_share", pos_col="_gp", partition_by=[group])
    # sums of shares differ in their last bits with the order of additions: compare what is stable
    return (x.where((F.col("_r") == 0) | (F.round("cum_share", 12) <= F.lit(float(p))))
            .drop("_s", "_m", "_e", "_t", "_r", "_gp"))


def seen_penalty(scored: DataFrame, seen: DataFrame, keys: Sequence[str], score: str,
                 penalty: float) -> DataFrame:
    """Seen items: negative scores multiplied by ``penalty``, others divided."""
    flagged = scored.join(seen.select(*keys).distinct().withColumn("_seen", F.lit(True)), list(keys), "left")
    s = F.col(score)
    new = (F.when(F.col("_seen").isNull(), s).when(s < 0, s * F.lit(float(penalty)))
           .otherwise(s / F.lit(float(penalty))))
    return flagged.withColumn("penalized", new).withColumn("seen", F.coalesce("_seen", F.lit(False))).drop("_seen")


def uniform01(seed: int | str, *cols: str | Column) -> Column:
    """Repeatable uniform number in (0, 1) from md5 (52 bits)."""
    h = hash_key(seed, *cols)
    return (F.conv(F.substring(h, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2 ** 52))


def weighted_draw(scored: DataFrame, group: str, item: str, score: str, temperature: float = 1.0,
                  seed: int = 0) -> DataFrame:
    """One item per group drawn with probability softmax(score / T): the
    exponential race, argmin of ln(-ln u) - score / T, one aggregate."""
    u = uniform01(seed, group, item)
    key = F.log(-F.log(u)) - F.col(score) / F.lit(float(temperature))
    return scored.groupBy(group).agg(F.min_by(item, key).alias(item))


def recent_timing(durations: DataFrame, category: str, duration: str, order: Sequence[str],
                  n: int = TIMING_WINDOW) -> DataFrame:
    """``category, mean_ms``: mean of each category's last ``n`` positive durations (seconds), in milliseconds."""
    kept = last_n(durations.where(F.col(duration) > 0), [category], order, n)
    return kept.groupBy(category).agg((F.avg(duration) * 1000).alias("mean_ms"))


def timing_breakdown(recent: DataFrame, category: str, total: str, compute: str, parts: Sequence[str],
                     outside: Sequence[str]) -> DataFrame:
    """One row from :func:`recent_timing`: ``total``, ``compute``, ``other`` (compute beyond its ``parts``) and
    ``overhead`` (total beyond the parts and the ``outside`` categories); an absent category counts 0."""
    def mean(names: Sequence[str]) -> Column:
        return F.coalesce(F.sum(F.when(F.col(category).isin(list(names)), F.col("mean_ms"))), F.lit(0.0))
    zero = F.lit(0.0)
    return recent.agg(mean([total]).alias("total"), mean([compute]).alias("compute"),
                      F.greatest(zero, mean([compute]) - mean(parts)).alias("other"),
                      F.greatest(zero, mean([total]) - mean([*parts, *outside])).alias("overhead"))


def throughput(tokens: str | Column, time: str | Column, start_tokens: Column, start_time: Column) -> Column:
    """Tokens a second since the session's start; 0 until time has passed."""
    elapsed = _c(time) - start_time
    return F.when(elapsed > 0, (_c(tokens) - start_tokens) / elapsed).otherwise(F.lit(0.0))
