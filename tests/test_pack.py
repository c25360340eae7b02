"""Packing: the parallel block/halo/chain form equals the sequential next-fit rule."""

import random

import pytest

from tessera.errors import ConfigError
from tessera.operators.pack import pack_stats, pack_windows


def sequential_pack(lens, C, max_docs):
    """Direct statement of the rule, document order."""
    wins, cur, cur_len = [], [], 0
    for i, n in lens:
        if n == 0:
            continue
        if n > C:
            if cur:
                wins.append(cur)
                cur, cur_len = [], 0
            wins.append([i])
            continue
        if cur_len + n > C or (max_docs is not None and len(cur) >= max_docs):
            if cur:
                wins.append(cur)
            cur, cur_len = [i], n
        else:
            cur.append(i)
            cur_len += n
    if cur:
        wins.append(cur)
    return wins


def _windows(rows):
    got = {}
    for r in rows:
        got.setdefault(r.window_id, []).append((r.slot, r.doc_pos))
    return [[d for _, d in sorted(got[w])] for w in sorted(got)]


@pytest.mark.parametrize("seed", range(4))
def test_random_cases_match_sequential(spark, seed):
    rng = random.Random(seed)
    C = rng.choice([8, 16, 50])
    M = rng.choice([None, 1, 2, 5])
    n = rng.randint(1, 250)
    lens = [(i * 2 + 5, rng.choice([0, 1, 2, 3, 5, 7, C - 1, C, C + 1, 3 * C])) for i in range(n)]
    df = spark.createDataFrame(lens, "doc_pos long, n_tokens long")
    bt = rng.choice([C, 2 * C, 7 * C])
    out = pack_windows(df, C, overhead=0, max_docs=M, block_tokens=bt).collect()
    assert _windows(out) == sequential_pack(lens, C, M)


def test_fixture_edge_cases(spark):
    C = 10
    cases = {
        "exact_fit": [(0, 5), (1, 5), (2, 10)],
        "all_oversize": [(0, 11), (1, 30), (2, 12)],
        "zero_length": [(0, 0), (1, 3), (2, 0), (3, 7)],
        "one_doc_many_blocks": [(0, 3), (1, 95), (2, 4), (3, 4)],
    }
    for name, lens in cases.items():
        df = spark.createDataFrame(lens, "doc_pos long, n_tokens long")
        for M in (None, 1, 2):
            out = pack_windows(df, C, overhead=0, max_docs=M, block_tokens=C).collect()
            assert _windows(out) == sequential_pack(lens, C, M), (name, M)


def test_overhead_counts_bos_eos(spark):
    df = spark.createDataFrame([(0, 4), (1, 4), (2, 9)], "doc_pos long, n_tokens long")
    out = pack_windows(df, 10, overhead=2).collect()
    # effective lengths 6, 6, 11: every document alone, the last one oversize
    assert _windows(out) == [[0], [1], [2]]
    assert [r.oversize for r in sorted(out, key=lambda r: r.doc_pos)] == [False, False, True]


def test_empty_input_and_bad_max_docs(spark):
    df = spark.createDataFrame([(0, 0)], "doc_pos long, n_tokens long")
    assert pack_windows(df, 8).count() == 0
    with pytest.raises(ConfigError):
        pack_windows(df, 8, max_docs=0)


def test_groups_pack_independently(spark):
    rows = [("a", i, 3) for i in range(10)] + [("b", i, 6) for i in range(7)]
    df = spark.createDataFrame(rows, "split string, doc_pos long, n_tokens long")
    out = pack_windows(df, 10, group_cols=["split"], block_tokens=10).collect()
    for g in ("a", "b"):
        got = _windows([r for r in out if r.split == g])
        exp = sequential_pack([(d, n) for s, d, n in rows if s == g], 10, None)
        assert got == exp


def test_one_token_documents_and_small_blocks(spark):
    """Blocks hold at most as many documents as tokens; many blocks compose over several levels."""
    lens = [(i, 1) for i in range(600)] + [(600 + i, 1 + i % 9) for i in range(400)]
    df = spark.createDataFrame(lens, "doc_pos long, n_tokens long")
    for M in (3,):
        assert _windows(pack_windows(df, 8, max_docs=M, block_tokens=8).collect()) == sequential_pack(lens, 8, M)


def test_many_groups(spark):
    from pyspark.sql import functions as F
    rng = random.Random(3)
    rows = [(g, i, rng.randrange(9)) for g in range(400) for i in range(3)] + [(-1, i, 1 + i % 7) for i in range(900)]
    df = spark.createDataFrame(rows, "g long, doc_pos long, n_tokens long")
    got = pack_windows(df, 10, group_cols=["g"], block_tokens=100).groupBy("g").agg(
        F.sort_array(F.collect_list(F.struct("window_id", "slot", "doc_pos"))).alias("w")).collect()
    want = {}
    for g, i, n in rows:
        want.setdefault(g, []).append((i, n))
    want = {g: sequential_pack(lens, 10, None) for g, lens in want.items()}
    assert {r.g: [(x.window_id, x.doc_pos) for x in r.w] for r in got} == {
        g: [(w, d) for w, docs in enumerate(wins) for d in docs] for g, wins in want.items() if wins}


def test_nothing_is_collected(spark, monkeypatch):
    from pyspark.sql import DataFrame
    for name in ("collect", "toPandas", "toLocalIterator"):
        monkeypatch.setattr(DataFrame, name, lambda *a, **k: pytest.fail("rows reached the driver"))
    df = spark.createDataFrame([(i, 1 + i % 5) for i in range(500)], "doc_pos long, n_tokens long")
    assert pack_windows(df, 16, block_tokens=16).count() == 500


def test_pack_stats_counts_empty_documents(spark):
    df = spark.createDataFrame([(0, 0), (1, 4), (2, 4), (3, 20)], "doc_pos long, n_tokens long")
    w = pack_windows(df, 10, overhead=0)
    s = pack_stats(w, df, 10, batch_size=2).first()
    assert s.total_documents == 4 and s.total_windows == 2 and s.total_batches == 1
    assert s.max_docs_per_window == 2 and s.min_docs_per_window == 1
    assert s.avg_tokens_per_window == 9.0  # (4 + 4) and min(20, 10)
