"""Keyed metric state over triggers and restarts."""

import json
import os
import random

from tessera.operators.slices import split_blocks
from tessera.streaming.incremental import metric_states, stream_blocks, stream_metrics

SCHEMA = "series string, ts long, event_id long, loss double"


def test_state_survives_restarts_and_late_points(spark, tmpdir_path):
    r = random.Random(1)
    rows = [("ab"[i % 2] if i % 7 else "rare", r.randrange(500), i, None if i % 11 == 0 else r.random()) for i in range(400)]
    src, sink, ckpt = (f"{tmpdir_path}/{n}" for n in ("src", "sink", "ckpt"))
    os.makedirs(src)
    for part in range(4):  # points arrive in any order; every run starts anew from the checkpoint
        with open(f"{src}/{part}.json", "w") as f:
            for s, ts, i, x in rows[part * 100:(part + 1) * 100]:
                f.write(json.dumps({"series": s, "ts": ts, "event_id": i, "loss": x}) + "\n")
        stream_metrics(spark, src, SCHEMA, sink, ckpt, window=20).awaitTermination()
        seen = [x for x in rows[:(part + 1) * 100] if x[3] is not None]
        got = {x.series: x for x in metric_states(spark, sink).collect()}
        assert set(got) == {x[0] for x in seen}
        for s, x in got.items():
            points = sorted((ts, i, v) for name, ts, i, v in seen if name == s)
            assert (x.points, x.best, x.current) == (len(points), min(v for *_, v in points), points[-1][2])
            assert list(x.recent) == [v for *_, v in points[-20:]]
    with open(f"{src}/4.json", "w") as f:
        f.write(json.dumps({"series": "new", "ts": 1, "event_id": 1000, "loss": 0.5}) + "\n")
    stream_metrics(spark, src, SCHEMA, sink, ckpt, window=20).awaitTermination()
    folders = sorted(x for x in os.listdir(sink) if x.startswith("epoch="))
    assert spark.read.parquet(f"{sink}/{folders[-1]}").count() == 1  # only what changed is written
    assert metric_states(spark, sink).count() == 4


def test_blocks_go_on_over_triggers_and_restarts(spark, tmpdir_path):
    src, sink, ckpt = (f"{tmpdir_path}/{n}" for n in ("src", "sink", "ckpt"))
    os.makedirs(src)
    arrived, n = {"a": [], "b": []}, 0
    for run in range(3):
        for part in range(2):
            rows = [{"id": n + i, "src": "ab"[(n + i) % 3 == 0], "text": f"t\n{i}" if i % 5 else None} for i in range(37)]
            n += 37
            with open(f"{src}/{run}-{part}.json", "w") as f:
                f.write("".join(json.dumps(r) + "\n" for r in reversed(rows)))
            for r in rows:
                arrived[r["src"]].append(r["id"])
        stream_blocks(spark, src, "id long, src string, text string", sink, ckpt, ["id"], "src", 0.7, 10).awaitTermination()
    got = spark.read.schema("id long, src string, text string, pos long, split string").json(sink)
    for name, ids in arrived.items():
        want = split_blocks(spark.createDataFrame(list(enumerate(ids)), "pos long, id long"), 0.7, block_size=10)
        rows = sorted((r.pos, r.id, r.split) for r in got.where(f"src = '{name}'").collect())
        assert rows == sorted((r.pos, r.id, r.split) for r in want.collect())
    assert got.where("text is null").count() == sum(i % 5 == 0 for i in range(37)) * 6
