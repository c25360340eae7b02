from pyspark.sql import functions as F

from tessera.operators import eventlog as ev
from tessera.operators import samples as smp


def test_samples_labels_masks(spark):
    windows = spark.createDataFrame([(0, 0, 10, False), (0, 1, 11, False), (1, 0, 12, True)],
                                    "window_id long, slot int, doc_pos long, oversize boolean")
    tokens = spark.createDataFrame([(10, [5, 6]), (11, [0, 8]), (12, [9] * 20)], "doc_pos long, ids array<int>")
    s = {r.window_id: r for r in smp.build_samples(windows, tokens, 8, pad_token_id=0, bos_token_id=1,
                                                     eos_token_id=2).collect()}
    assert list(s[0].input_ids) == [1, 5, 6, 2, 1, 0, 8, 2]
    assert list(s[0].doc_ids) == [0, 0, 0, 0, 1, 1, 1, 1]
    assert list(s[1].input_ids) == [0] * 8 and list(s[1].doc_ids) == [-1] * 8  # oversize -> all padding
    t = {r.window_id: r for r in smp.build_samples(windows, tokens, 8, 0, 1, 2, oversize="truncate").collect()}
    assert list(t[1].input_ids) == [1] + [9] * 7
    lab = spark.createDataFrame([([1, 5, 0, 8, 2, 0, 0, 0],)], "ids array<int>")
    got = lab.select(smp.make_labels("ids", 8, pad_token_id=0, ignore_index=0)).first()[0]
    # shift left; a real token equal to the pad id is ignored; last position ignored
    assert list(got) == [5, 0, 0, 2, 0, 0, 0, 0]
    runs = spark.createDataFrame([([0, 0, 1, 1, 1, -1],)], "d array<int>").select(smp.block_runs("d")).first()[0]
    assert [(r.start, r.len, r.doc) for r in runs] == [(0, 2, 0), (2, 3, 1)]
    m = spark.createDataFrame([([0, 0, -1],)], "d array<int>").select(smp.mask_row("d")).first()[0]
    assert [list(x) for x in m] == [[True, True, False], [True, True, False], [False, False, False]]


def test_batches_and_padding(spark):
    ids = spark.range(10).withColumnRenamed("id", "window_id")
    sh = smp.shuffle_windows(ids, seed=1, epoch=0)
    assert sorted(r.order for r in sh.collect()) == list(range(10))
    b = smp.assign_batches(sh, 4)
    assert smp.assign_batches(sh, 4, drop_last=True).count() == 8
    p = smp.pad_last_batch(b, 4, 4).groupBy("batch_id").count().collect()
    assert sorted(r["count"] for r in p) == [4, 4, 4]


def _trace(spark, rows):
    return spark.createDataFrame(
        rows, "event_index long, ts double, dur double, name string, cat string, ph string, "
              "args map<string,string>, addr long, bytes long, device long")


def test_free_matching_edge_cases(spark):
    rows = [
        (0, 10.0, None, "free", "m", "i", {}, 7, None, 0),         # free without allocation
        (1, 20.0, None, "[memory]", "m", "i", {}, 7, 100, 0),
        (2, 30.0, None, "[memory]", "m", "i", {}, 7, 50, 1),      # address reused: overwrites
        (3, 40.0, None, "cudaFree", "m", "i", {}, 7, None, 0),    # frees the 50 on device 1
        (4, 50.0, None, "free", "m", "i", {}, 7, None, 0),        # second free: no match
        (5, 50.0, None, "[memory]", "m", "i", {}, 8, -30, 0),     # negative size counts as-is
        (6, 60.0, None, "[memory]", "m", "i", {}, 0, 99, 0),      # address 0: not an allocation
    ]
    d = {r.event_index: r for r in ev.memory_deltas(_trace(spark, rows)).collect()}
    assert sorted(d) == [1, 2, 3, 5]
    assert (d[3].delta, d[3].device) == (-50, 1)
    bal = ev.running_balance(ev.memory_deltas(_trace(spark, rows))).orderBy("seq").collect()
    assert [r.total_balance for r in bal] == [100, 150, 100, 70]
    pk = {r.scope: r for r in ev.peaks(ev.balance_sums(ev.memory_deltas(_trace(spark, rows)))).collect()}
    assert pk["total"].peak_bytes == 150 and pk["total"].peak_ts == 30.0


def test_peaks_and_ends_compose_like_the_running_balance(spark):
    import random
    r = random.Random(4)
    rows = [(i, float(r.randrange(200)), r.choice([None, 0, 1, 2]), r.randrange(-50, 51)) for i in range(800)]
    rows += [(900, 999.0, 7, -5)]  # a scope that never rises
    deltas = spark.createDataFrame(rows, "event_index long, ts double, device int, delta long")
    want, ends = {}, {}
    for scope in {None if d is None else str(d) for _, _, d, _ in rows} | {"total"}:
        at = 0
        for i, ts, d, x in sorted(rows, key=lambda t: (t[1], t[0])):
            if scope == "total" or (None if d is None else str(d)) == scope:
                at += x
                if at > 0 and at > want.get(scope, (0, 0))[0]:
                    want[scope] = (at, ts)
        ends[scope] = at
    old = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("1", "7", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        sums = ev.balance_sums(deltas)
        assert {x.scope: (x.peak_bytes, x.peak_ts) for x in ev.peaks(sums).collect()} == want
        assert {x.scope: x.end_bytes for x in ev.end_balance(sums).collect()} == ends
    spark.conf.set("spark.sql.shuffle.partitions", old)


def test_interval_join_long_and_short_ops(spark):
    pts = spark.createDataFrame([(0, 5.0), (1, 500.0), (2, 5000.0)], "pid long, t double")
    ops = spark.createDataFrame([(10, 0.0, 10.0, "a", "x"), (11, 0.0, 1e6, "long", "y"), (12, 400.0, 600.0, "b", "x")],
                                "op_index long, start double, end double, op_name string, op_cat string")
    got = sorted((r.pid, r.op_index) for r in ev.active_ops(pts, ops, min_dur=0.0, bucket=10.0).collect())
    assert got == [(0, 10), (0, 11), (1, 11), (1, 12), (2, 11)]


def test_activity_equals_all_pairs_with_narrow_and_wide_blocks(spark):
    import random
    r = random.Random(8)
    pts = [(i, float(r.randrange(300))) for i in range(150)]
    ops = [(1000 + i, float(s), float(s + r.choice([0, 1, 2, 30, 280])), f"n{i}", "x")
           for i, s in enumerate(r.randrange(320) for _ in range(60))]
    want = {}
    for pid, t in pts:
        met = [o for o in ops if o[1] <= t <= o[2] and o[2] - o[1] > 1.0]
        if met:
            want[pid] = (len(met), min(met, key=lambda o: (o[1], o[0]))[3])
    p = spark.createDataFrame(pts, "pid long, t double")
    o = spark.createDataFrame(ops, "op_index long, start double, end double, op_name string, op_cat string")
    for wide_bits in (0, 3, 16):
        got = {x.pid: (x.n, x["first"].op_name) for x in ev.activity(p, o, 1.0, wide_bits=wide_bits).collect()}
        assert got == want
    assert ev.activity(p, o.where("false"), 1.0).count() == 0 and ev.activity(p.where("false"), o, 1.0).count() == 0
