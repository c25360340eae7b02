"""Epoch orders by formula."""

import pytest
from pyspark.sql import functions as F

from tessera.operators.samples import permuted, token_budget


def test_every_place_once_and_epochs_differ(spark):
    for n in (1, 2, 3, 5, 7, 10, 50, 97, 1000, 1023):
        rows = spark.range(n).select("id", F.explode(F.array(F.lit(0), F.lit(1))).alias("e"))
        got = rows.select("e", permuted(F.col("id"), n, 7, F.col("e")).alias("o")).collect()
        for e in (0, 1):
            assert sorted(r.o for r in got if r.e == e) == list(range(n)), n
        if n > 20:
            assert [r.o for r in got if r.e == 0] != [r.o for r in got if r.e == 1]


def test_order_looks_random(spark):
    n = 4000
    got = [r.o for r in spark.range(n).select(permuted(F.col("id"), n, 1, F.lit(0)).alias("o")).collect()]
    moved = sum(abs(i - o) for i, o in enumerate(got)) / n
    assert abs(moved - n / 3) < n / 20  # the mean distance of a random order
    assert sum(b == a + 1 for a, b in zip(got, got[1:])) < 20


@pytest.mark.parametrize("ids", ["dense", "gaps"])
def test_budget_takes_whole_batches_without_a_sort(spark, ids):
    n, c, batch = 53, 10, 4
    df = spark.range(n).select((F.col("id") * (1 if ids == "dense" else 3)).alias("window_id"))
    out = token_budget(df, c, batch, max_tokens=20 * batch * c + 1, epochs=9, seed=3)
    rows = out.collect()
    assert {r.batch_global for r in rows} == set(range(21)) and {r.epoch for r in rows} == {0, 1}
    assert len([r for r in rows if r.epoch == 0]) == n and all(r.tokens_before == r.batch_global * batch * c for r in rows)
    if ids == "dense":
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Sort" not in plan
    assert token_budget(df, c, batch, max_batches=0).count() == 0
    assert token_budget(df.where("window_id < 0"), c, batch, max_batches=5).count() == 0
