import pytest

from tessera.errors import SamplingError
from tessera.operators.order import running_sum, with_pos
from tessera.operators.slices import (apply_sampling, merge_slices, slice_random, slice_sequential, split_blocks,
                                      split_shuffled, train_count)


def test_train_count_uses_double_product():
    assert train_count(10_000, 0.57) == 5699
    assert train_count(200, 0.8) == 160
    assert train_count(0, 0.8) == 0


@pytest.mark.parametrize("n", [0, 1, 7, 200, 1001])
@pytest.mark.parametrize("ratio", [0.57, 0.8, 0.995])
def test_split_shuffled_exact(spark, n, ratio):
    df = spark.range(n).withColumnRenamed("id", "k")
    out = split_shuffled(df, ["k"], ratio, seed=3, buckets_hex=1)
    rows = out.collect()
    assert len(rows) == n
    assert sum(r.split == "train" for r in rows) == train_count(n, ratio)


def test_split_shuffled_is_the_hash_order(spark):
    import hashlib
    df = spark.range(300).withColumnRenamed("id", "k")
    got = {r.k for r in split_shuffled(df, ["k"], 0.5, seed=9).where("split = 'train'").collect()}
    order = sorted(range(300), key=lambda k: (hashlib.md5(f"9:{k}".encode()).hexdigest(), k))
    assert got == set(order[:150])


def test_split_blocks_short_input_has_no_validation(spark):
    df = with_pos(spark.range(7999).withColumnRenamed("id", "k"), ["k"])
    out = split_blocks(df, 0.8).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in out} == {"train": 7999}
    df2 = with_pos(spark.range(10_001).withColumnRenamed("id", "k"), ["k"])
    c = {r.split: r["count"] for r in split_blocks(df2, 0.8).groupBy("split").count().collect()}
    assert c == {"train": 8001, "validation": 2000}


def test_with_pos_dense_and_ordered(spark):
    df = spark.range(5000).selectExpr("id * 7 % 5003 AS k")
    rows = with_pos(df, ["k"], num_partitions=5).collect()
    assert sorted(r.pos for r in rows) == list(range(5000))
    assert all(a.k < b.k for a, b in zip(sorted(rows, key=lambda r: r.pos), sorted(rows, key=lambda r: r.pos)[1:]))


def test_running_sum_small_shards(spark):
    df = with_pos(spark.range(100).selectExpr("id AS k", "id % 3 AS g", "id AS v"), ["k"])
    out = running_sum(df, "v", "cum", shard_rows=7).collect()
    assert all(r.cum == r.k * (r.k + 1) // 2 for r in out)
    per = running_sum(df, "v", "cum", partition_by=["g"], shard_rows=5).collect()
    for r in per:
        assert r.cum == sum(v for v in range(r.k + 1) if v % 3 == r.g)


def test_slices(spark):
    df = spark.range(50).withColumnRenamed("id", "k")
    s = slice_sequential(df, ["k"], offset=45, limit=10).collect()
    assert sorted(r.k for r in s) == [45, 46, 47, 48, 49]
    assert slice_sequential(df, ["k"], offset=60).count() == 0
    r = slice_random(df, ["k"], offset=0, limit=20, seed=42).collect()
    assert len(r) == 20 and sorted(x.pos for x in r) == list(range(20))
    with pytest.raises(SamplingError):
        apply_sampling(df, "reservoir", ["k"], ["k"])
    with pytest.raises(SamplingError):
        slice_sequential(df, ["k"], limit=0)


def test_merge_slices_positions(spark):
    a = with_pos(spark.createDataFrame([(1, "x"), (2, "y")], "id long, text string"), ["id"])
    b = with_pos(spark.createDataFrame([(5, 7)], "item long, n long"), ["item"])
    m = merge_slices([("a", a), ("b", b)]).orderBy("pos").collect()
    assert [(r.slice_key, r.pos) for r in m] == [("a", 0), ("a", 1), ("b", 2)]
    assert m[2].text is None and m[0].item is None
