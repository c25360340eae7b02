import json
import os

import pytest

from tessera.errors import SourceNotFoundError, UnsupportedFormatError, ValidationError
from tessera.sources.readers import (read_csv, read_json, read_jsonl, read_prompts, read_trace, reader_for,
                                     register_reader, require_text, supported_formats, text_fallback)
from tessera.sources.recipe import dataset_config


def _write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_jsonl_blank_lines_nulls_and_failfast(spark, tmpdir_path):
    p = _write(os.path.join(tmpdir_path, "a.jsonl"),
               '{"text": "héllo", "x": 1}\n\n   \n{"text": null}\n{"other": 2}\n')
    rows = read_jsonl(spark, p, "text string, x long, other long").collect()
    assert [r.text for r in rows] == ["héllo", None, None]
    with pytest.raises(Exception):
        require_text(read_jsonl(spark, p, "text string"), "text").collect()
    bad = _write(os.path.join(tmpdir_path, "bad.jsonl"), '{"text": "a"}\n{not json\n')
    with pytest.raises(Exception):
        read_jsonl(spark, bad, "text string").collect()
    with pytest.raises(SourceNotFoundError):
        read_jsonl(spark, os.path.join(tmpdir_path, "missing.jsonl"), "text string")


def test_json_array_and_object(spark, tmpdir_path):
    a = _write(os.path.join(tmpdir_path, "arr.json"), json.dumps([{"text": "a"}, {"text": "b"}]))
    o = _write(os.path.join(tmpdir_path, "obj.json"), json.dumps({"text": "c"}))
    assert [r.text for r in read_json(spark, a, "text string").collect()] == ["a", "b"]
    assert [r.text for r in read_json(spark, o, "text string").collect()] == ["c"]


def test_csv_quotes_and_empty_cells(spark, tmpdir_path):
    p = _write(os.path.join(tmpdir_path, "c.csv"), 'text,n\n"a, b",1\n"line1\nline2",\n"",3\n')
    rows = read_csv(spark, p, "text string, n long").collect()
    assert [(r.text, r.n) for r in rows] == [("a, b", 1), ("line1\nline2", None), (None, 3)]


def test_prompts_keep_stray_lines(spark, tmpdir_path):
    p = _write(os.path.join(tmpdir_path, "prompts.txt"), "  Once upon a time\n\nEOF\nback\\slash\n")
    assert [r.prompt for r in read_prompts(spark, p).orderBy("_row").collect()] == \
        ["Once upon a time", "EOF", "back\\slash"]


def test_trace_object_and_missing_array(spark, tmpdir_path):
    p = _write(os.path.join(tmpdir_path, "t.json"), json.dumps({"traceEvents": [
        {"name": "[memory]", "ph": "i", "ts": 5, "args": {"Addr": 12, "Bytes": 64}},
        {"name": "op", "ph": "X", "ts": 1, "dur": 3, "cat": "cuda"}]}))
    rows = read_trace(spark, p).orderBy("event_index").collect()
    assert [r.name for r in rows] == ["[memory]", "op"] and rows[0].args["Bytes"] == "64"
    q = _write(os.path.join(tmpdir_path, "empty.json"), json.dumps({"other": 1}))
    assert read_trace(spark, q).count() == 0


def test_registry_and_fallback(spark):
    assert supported_formats() == [".csv", ".json", ".jsonl", ".parquet", ".pq"]
    assert reader_for("x/Y.PARQUET") is reader_for("y.parquet")
    with pytest.raises(UnsupportedFormatError):
        reader_for("data.xml")
    register_reader("txt", lambda spark, path, **kw: spark.read.text(path))
    assert ".txt" in supported_formats()
    df = spark.createDataFrame([(None, "c1", None), ("t", None, "b")], "text string, content string, body string")
    assert [r.text for r in text_fallback(df).collect()] == ["c1", "t"]
    with pytest.raises(ValidationError):
        require_text(df.drop("text"), "text")


def test_recipe_validation():
    ok = dataset_config({"key": "k", "name": "n", "slices": [{"key": "a", "local": "x.jsonl", "limit": 5}]})
    assert ok.train_split == 0.8 and ok.split_strategy == "shuffle" and ok.slices[0].sampling == "sequential"
    for bad in [{"key": "k", "name": "n", "slices": []},
                {"key": "k", "name": "n", "slices": [{"key": "a"}]},
                {"key": "k", "name": "n", "slices": [{"key": "a", "local": "x", "limit": 0}]},
                {"key": "k", "name": "n", "train_split": 0.7, "slices": [{"key": "a", "local": "x"}]}]:
        with pytest.raises(ValidationError):
            dataset_config(bad)
