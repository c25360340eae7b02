import numpy as np

from tessera.llm import ann
from tessera.llm.queries import QUERIES


def brute(rows, queries, k):
    use = {}
    for i, v in rows:
        if i is None or v is None or not len(v) or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        use.setdefault((i, tuple(v)), np.array(v, float))
    out = {}
    for i, v in queries:
        if i is None or v is None or not len(v) or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        q = np.array(v, float)
        near = sorted((-float(w @ q / np.sqrt((w @ w) * (q @ q))), j) for (j, _), w in use.items() if j != i and len(w) == len(q))
        out[i] = [(j, -s) for s, j in near[:k]]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows],
                                 "vec_id long, embedding array<float>, shard int, dim int")


def test_small_tables_are_exact(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in r.normal(size=8)]) for i in range(120)]
    rows += [(200 + i, rows[3][1]) for i in range(30)]  # equal vectors: ties to the smaller id
    rows += [(300, None), (301, [0.0] * 8), (302, [float("nan")] * 8), (303, [None] * 8), (304, []),
             (305, [float("inf")] + [1.0] * 7), (None, rows[0][1]), (0, rows[0][1]), (306, [1.0, 2.0])]
    queries = [q for q in rows if q[0] in (0, 3, 7, 40, 205, 300, 301, 302, 304, 306, None)]
    index = ann.build_index(frame(spark, rows), 5, shard_rows=50)
    got = {}
    for x in ann.search(index, frame(spark, queries), 5, query_block=3).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.vec_id, x.score))
    want = brute(rows, queries, 5)
    assert set(got) == {q for q, near in want.items() if near}
    for q, near in got.items():
        assert [n for n, _, _ in near] == list(range(1, len(near) + 1))
        assert [i for _, i, _ in near] == [i for i, _ in want[q]]
        assert np.allclose([s for _, _, s in near], [s for _, s in want[q]], atol=1e-12)


def test_fewer_candidates_than_k_and_empty(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0])]
    found = ann.search(ann.build_index(frame(spark, rows), 5), frame(spark, rows[:1]), 5).collect()
    assert sorted((r["rank"], r.vec_id) for r in found) == [(1, 1), (2, 2)]
    empty = frame(spark, [])
    assert ann.search(ann.build_index(empty, 5), frame(spark, rows), 5).count() == 0
    assert ann.search(ann.build_index(frame(spark, rows), 5), empty, 5).count() == 0


def test_ties_go_to_the_least_ids(spark):
    """Scaled copies of a vector tie to the last bit, also when there are more of them than the beam holds."""
    r = np.random.default_rng(5)
    rows = [(i, r.normal(size=16).tolist()) for i in range(300)]
    near = np.array(rows[7][1])
    order = r.permutation(150)
    rows += [(1001 + int(j), (near * 2.0 ** (int(j) % 39 - 20)).tolist()) for j in order]
    turned = near + 0.01 * r.normal(size=16)
    rows += [(5000 - j, (turned * (1 + j)).tolist()) for j in range(30)]
    got = ann.search(ann.build_index(frame(spark, rows), 5), frame(spark, [rows[7]]), 5).orderBy("rank").collect()
    assert [x.vec_id for x in got] == [1001, 1002, 1003, 1004, 1005]
    x = np.array([v for _, v in rows], np.float32).astype(float)  # as the table holds them
    score = [float(ann.cosine(x[i:i + 1], x[7])[0]) for i in range(len(rows))]
    want = sorted((-s, i) for s, (i, _) in zip(score, rows) if not 1001 <= i <= 1150 and i != 7)[:5]
    rest = [row for row in rows if not 1001 <= row[0] <= 1150]
    got = ann.search(ann.build_index(frame(spark, rest), 5), frame(spark, [rows[7]]), 5).orderBy("rank").collect()
    assert [(-x.score, x.vec_id) for x in got] == want


def test_recall_of_one_graph():
    r = np.random.default_rng(2)
    x = r.normal(size=(1500, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    edges, entry = ann.build_graph(x)
    q = x[:100] + 0.3 * r.normal(size=(100, 32))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    found, _ = ann.beam_search(x, edges, q, entry, ann.BEAM)
    best = np.argsort(-(q @ x.T), 1)[:, :5]
    assert np.mean([len(set(a) & set(b[:5])) / 5 for a, b in zip(best, found)]) > 0.9


def test_query_recall(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op7_ann"](spark, sf).toPandas()
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x, ids = np.array(rows.embedding.tolist(), float), rows.vec_id.to_numpy()
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hits = []
    for q, near in got.groupby("query_id"):
        s = x @ x[np.flatnonzero(ids == q)[0]]
        s[ids == q] = -9
        hits.append(len(set(ids[np.lexsort((ids, -s))[:5]]) & set(near.vec_id)) / 5)
    assert len(hits) == (ids % 50 == 0).sum() and np.mean(hits) >= 0.9
