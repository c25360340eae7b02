"""Large JSON and CSV files cut into ranges equal the readers of whole files."""

import csv
import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.errors import ValidationError
from tessera.sources import ranges as ranges_of
from tessera.sources.ranges import csv_records, json_elements
from tessera.sources.readers import read_csv, read_json, read_json_elements, read_trace


@pytest.fixture(params=["1k", "137b", "64m"])
def ranges(request, spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(k) for k in keys]
    for k in keys:
        spark.conf.set(k, request.param)
    yield request.param
    for k, v in zip(keys, old):
        spark.conf.set(k, v)


def value(r, deep=0):
    return r.choice([r.randrange(99), None, "x", 'a "quoted" }{][ \\ text', "}" * r.randrange(9), "\\", "é}日\n", "\\\"}", "",
                     {"k}": "{"} if deep < 2 else 1, [{"t": "}"}, [], {}] if deep < 2 else []] + (
                         [{"in": value(r, deep + 1)}] if deep < 3 else []))


def events(seed, n):
    r = random.Random(seed)
    return [{"name": value(r, 9) or "n", "ph": "X", "ts": i * 1.5, "args": {"a": json.dumps(value(r)), "b": "}{"}} for i in range(n)]


@pytest.mark.parametrize("indent", [None, 1])
def test_traces_split_and_keep_their_order(spark, tmpdir_path, ranges, indent):
    want = [dict(e, name=str(e["name"])) for e in events(1, 150)]
    root = {"schemaVersion": 1, "other": [{"traceEvents": [{"name": "no"}]}, "}"], "nested": {"traceEvents": [{"name": "no"}]},
            "traceEvents": want, "after": [{"name": "no}"}]}
    path = f"{tmpdir_path}/t.json"
    with open(path, "w") as f:
        json.dump(root, f, indent=indent, ensure_ascii=False)
    scanned = json_elements(spark, path, "traceEvents")
    if ranges != "64m":
        assert scanned.select("_block").distinct().count() > 5
    got = read_trace(spark, path).orderBy("event_index").collect()
    assert [(r.event_index, r.name, r.ph, r.ts, r["args"]) for r in got] == [
        (i, e["name"], "X", e["ts"], e["args"]) for i, e in enumerate(want)]


def test_arrays_and_objects_equal_the_whole_file_reader(spark, tmpdir_path, ranges):
    r = random.Random(2)
    rows = [{"text": json.dumps(value(r)), "n": i, "o": {"a": [{"b": "}"}]}} for i in range(120)]
    for name, body in (("a.json", json.dumps(rows)), ("b.json", " \n[" + ",\n".join(json.dumps(x, indent=2) for x in rows) + "\n]\n"),
                       ("c.json", json.dumps(rows[0], indent=1) + "\n"), ("d.json", "[]"), ("e.json", " [ ] ")):
        with open(f"{tmpdir_path}/{name}", "w") as f:
            f.write(body)
        schema = "text string, n long, o struct<a: array<struct<b: string>>>"
        want = read_json(spark, f"{tmpdir_path}/{name}", schema).collect()
        assert sorted(read_json_elements(spark, f"{tmpdir_path}/{name}", schema).collect(), key=lambda x: x.n) == sorted(
            want, key=lambda x: x.n), name
    every = read_json_elements(spark, tmpdir_path, "n long", with_file_order=True)
    assert [x.n for x in every.orderBy("_file", "_block", "_row").collect()] == [*range(120), *range(120), 0]


def test_cut_off_files_raise(spark, tmpdir_path):
    for name, body in (("a.json", '[{"a": 1}, {"a": '), ("b.json", '{"traceEvents": [{"name": "x}'), ("c.csv", 'a,b\n1,"x\n')):
        with open(f"{tmpdir_path}/{name}", "w") as f:
            f.write(body)
        with pytest.raises(ValidationError, match="ends inside"):
            (csv_records if name.endswith("csv") else json_elements)(spark, f"{tmpdir_path}/{name}")


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_with_quoted_line_ends(spark, tmpdir_path, ranges, end):
    r = random.Random(3)
    cells = ["plain", 'with "quotes"', "two\nlines", "a,b", "", '"', "\n\n", "é日", 'tail"\n"', " spaced "]
    rows = [(r.choice(cells), i, r.choice(cells)) for i in range(200)]
    for name in ("a.csv", "b.csv"):
        with open(f"{tmpdir_path}/{name}", "w", newline="") as f:
            w = csv.writer(f, lineterminator=end)
            w.writerow(["text", "n", "more"])
            w.writerows(rows)
    schema = "text string, n long, more string"
    whole = spark.read.options(header=True, multiLine=True, escape='"', nullValue="").schema(schema).csv(f"{tmpdir_path}/a.csv")
    got = read_csv(spark, f"{tmpdir_path}/a.csv", schema).orderBy("n").collect()
    assert got == whole.orderBy("n").collect()
    assert [(x.text, x.n, x.more) for x in got] == [(a or None, n, b or None) for a, n, b in rows]
    both = read_csv(spark, tmpdir_path, schema, with_file_order=True).orderBy("_file", "_block", "_row")
    assert [x.n for x in both.collect()] == [*range(200)] * 2
    if ranges != "64m":
        assert both.select("_block").distinct().count() > 3


def test_large_trace_is_read_by_several_tasks(spark, tmpdir_path):
    """200 MB in one file: several ranges, the same events as from lines."""
    path = f"{tmpdir_path}/big.json"
    event = {"name": "op}", "ph": "X", "ts": 1.0, "dur": 2.0, "args": {"shape": "x" * 900}}
    with open(path, "w") as f:
        f.write('{"traceEvents": [')
        for i in range(200_000):
            f.write(("," if i else "") + json.dumps(event | {"ts": float(i)}))
        f.write("]}")
    found = json_elements(spark, path, "traceEvents")
    assert found.count() == 200_000 and found.select("_block").distinct().count() > 1
    ts = found.select(F.get_json_object("text", "$.ts").cast("double").alias("ts")).agg(F.sum("ts"), F.max("ts")).first()
    assert tuple(ts) == (199_999 * 200_000 / 2, 199_999.0)


def test_plain_events_are_not_walked_bracket_by_bracket(monkeypatch):
    """Strings of a fragment are skipped as wholes; the sums are those of the walk, from either side of a quote."""
    lines = json.dumps({"traceEvents": [dict(e, name='[m] {"}', args={"a": "}{"}) for e in events(4, 60)]}).split("}")[:-1]
    steps, real = [], ranges_of._Json._step
    monkeypatch.setattr(ranges_of._Json, "_step", lambda self, v, opened: (steps.append(v), real(self, v, opened)))
    a, slow = ranges_of._Json(), [ranges_of._Json(), ranges_of._Json(quoted=True)]
    for v in lines:
        a.walk(v)
    plain = len(steps)
    for v in lines:
        for s in slow:
            real(s, v, None)
    assert plain < 5 and len(lines) > 150
    assert (a.depth, a.quoted, a.other) == (slow[0].depth, slow[0].quoted, slow[1].depth) and slow[1].quoted is not a.quoted


def test_traces_are_scanned_twice(spark, tmpdir_path):
    """One scan for where the ranges begin, one that writes the elements, which alone are numbered: no sort, no third scan."""
    with open(f"{tmpdir_path}/t.json", "w") as f:
        json.dump({"traceEvents": events(5, 50)}, f)
    sc = spark.sparkContext
    sc.setJobGroup("scans of a trace", "")
    rows = read_trace(spark, f"{tmpdir_path}/t.json")
    jobs = len(sc.statusTracker().getJobIdsForGroup("scans of a trace"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert rows.count() == 50 and jobs <= 2
    assert "rangepartitioning" not in rows._jdf.queryExecution().toString()
