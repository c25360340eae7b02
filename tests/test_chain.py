"""Recipe -> corpus -> token store, positions, hooks, sinks, timings."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tessera.errors import ConfigError, SamplingError, ValidationError
from tessera.operators.encode import document_tokens, encode_subword, reconcile, token_totals
from tessera.operators.hooks import map_rows
from tessera.operators.order import file_order, with_file_pos, with_pos
from tessera.operators.slices import apply_sampling, register_sampling, slice_random, split_shuffled
from tessera.operators.vocab import train_subword, word_counts
from tessera.plans.build import build_corpus, describe_slice, load_slice, pretokenize
from tessera.sources.readers import read_jsonl
from tessera.sources.recipe import dataset_config, load_recipe, load_tokenizer_recipe, tokenizer_config, tokenizer_inputs
from tessera.sources.sinks import write_inference, write_metrics, write_timeline


def _jsonl(folder, files):
    os.makedirs(folder, exist_ok=True)
    for name, rows in files.items():
        with open(os.path.join(folder, name), "w") as f:
            f.write("".join(json.dumps(r) + "\n" for r in rows))
    return folder


def test_all_violations_are_reported_at_once():
    with pytest.raises(ValidationError) as e:
        dataset_config({"name": 3, "train_split": 1.5, "random_seed": True, "split_strategy": "x",
                        "slices": [{"key": "a"}, {"local": "x", "huggingface": "y", "limit": 0, "offset": -1}, 7]})
    for part in ("key: is required", "name: expects str", "train_split: must lie", "random_seed: expects int",
                 "split_strategy: must be one of", "slices[0].exactly one", "slices[1].limit", "slices[1].offset",
                 "slices[1].exactly one", "slices[2]."):
        assert part in str(e.value), part
    with pytest.raises(ConfigError):
        dataset_config({})
    with pytest.raises(ConfigError):
        tokenizer_config({"type": "words", "vocab_size": 0})
    with pytest.raises(ConfigError):
        tokenizer_inputs(tokenizer_config({}))


def test_recipes_from_files(tmp_path):
    (tmp_path / "c.yml").write_text("key: k\nname: n\nslices:\n  - {key: 1, local: a.jsonl, offset: }\n")
    got = load_recipe(tmp_path / "c.yml")
    assert (got.train_split, got.validation_split, got.random_seed, got.slices[0].sampling) == (0.8, 0.2, 42, "sequential")
    assert describe_slice(got.slices[0]) == "a.jsonl, sequential"
    (tmp_path / "t.yml").write_text("dataset: d\nunknown: 1\n")
    assert tokenizer_inputs(load_tokenizer_recipe(tmp_path / "t.yml")) == ["datasets/d/split=train"]
    with pytest.raises(ConfigError):
        load_recipe(tmp_path / "none.yml")


def test_file_positions_follow_the_files_whatever_the_splits(spark, tmpdir_path):
    rows = [{"text": f"row {i} " + "x" * (i % 50)} for i in range(900)]
    path = _jsonl(f"{tmpdir_path}/in", {"b.jsonl": rows[400:], "a.jsonl": rows[:400]})
    seen = []
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in (old, "1k", "7k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = with_file_pos(file_order(read_jsonl(spark, path, "text string").drop("x"))).collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        seen.append([r.text for r in sorted(got, key=lambda r: r.pos)])
        assert sorted(r.pos for r in got) == list(range(900))
    assert seen[0] == seen[1] == seen[2] == [r["text"] for r in rows]


def test_random_slices_repeat_and_see_rewritten_files(spark, tmpdir_path):
    path = _jsonl(f"{tmpdir_path}/s", {"a.jsonl": [{"text": f"t{i}"} for i in range(500)]})
    sl = dataset_config({"key": "k", "name": "n", "slices": [
        {"key": "a", "local": f"{path}/a.jsonl", "sampling": "random", "limit": 60, "offset": 5}]}).slices[0]

    def read():
        return [r.text for r in load_slice(spark, sl).orderBy("pos").collect()]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    first = read()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        assert read() == first and len(set(first)) == 60
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    _jsonl(path, {"a.jsonl": [{"text": f"new{i}"} for i in range(500)]})
    spark.catalog.refreshByPath(path)
    assert all(t.startswith("new") for t in read())


def test_random_slice_equals_the_whole_order(spark):
    df = spark.range(3000).toDF("k")
    whole = [r.k for r in slice_random(df, ["k"]).orderBy("pos").collect()]
    for offset, limit in ((0, 10), (17, 300), (2990, 50), (3000, 5), (0, 3000)):
        got = [(r.pos, r.k) for r in slice_random(df, ["k"], offset, limit).orderBy("pos").collect()]
        assert got == list(enumerate(whole[offset:offset + limit]))


def test_split_is_exact_at_every_share(spark):
    df = spark.range(500).toDF("k")
    order = [r.k for r in slice_random(df, ["k"], seed=42).orderBy("pos").collect()]
    for share in (0.0, 0.01, 0.57, 0.8, 0.999, 1.0):
        train = {r.k for r in split_shuffled(df, ["k"], share, 42).where("split = 'train'").collect()}
        assert train == set(order[:int(500 * share)])


#: Names that the build uses inside, as a corpus may have them.
INSIDE = ["pos", "POS_", "slice_key", "slice_ord", "record", "_h", "_b", "_n", "_base", "_file", "_block", "_row", "_pid", "_loc",
          "_first", "_file_pos", "_seq", "_metadata", "Record"]


@pytest.mark.parametrize("sampling", ["sequential", "random"])
@pytest.mark.parametrize("strategy", ["shuffle", "sequential"])
def test_every_field_of_a_record_reaches_the_corpus(spark, tmpdir_path, sampling, strategy):
    names = [n for n in INSIDE if n != "Record"]
    rows = [{"text": f"t{i}"} | {n: f"{n}-{i}" for n in names} | {"nested": {"pos": i, "split": "x"}} for i in range(60)]
    _jsonl(f"{tmpdir_path}/in", {"a.jsonl": rows[:40], "b.jsonl": [{k: v for k, v in r.items() if k != "_h"} | {"more": 1}
                                                                 for r in rows[40:]]})
    cfg = dataset_config({"key": "k", "name": "n", "split_strategy": strategy, "slices": [
        {"key": "a", "local": f"{tmpdir_path}/in/a.jsonl", "sampling": sampling},
        {"key": "b", "local": f"{tmpdir_path}/in/b.jsonl", "sampling": sampling}]})
    build_corpus(spark, cfg, f"{tmpdir_path}/out")
    got = []
    for folder, _, files in os.walk(f"{tmpdir_path}/out/n"):
        for name in (f for f in files if f.startswith("part-") and "split=" in folder):
            with open(f"{folder}/{name}") as f:
                got += [json.loads(x) for x in f]
    assert sorted(r.pop("corpus_pos") for r in got) == list(range(60))
    want = rows[:40] + [{k: v for k, v in r.items() if k != "_h"} | {"more": 1} for r in rows[40:]]
    assert sorted(got, key=lambda r: r["text"]) == sorted(want, key=lambda r: r["text"])


@pytest.mark.parametrize("name", ["split", "Corpus_Pos"])
def test_fields_named_as_the_corpus_s_own_are_refused(spark, tmpdir_path, name):
    path = _jsonl(f"{tmpdir_path}/in", {"a.jsonl": [{"text": "x", name: 1}]})
    cfg = dataset_config({"key": "k", "name": "n", "slices": [{"key": "a", "local": f"{path}/a.jsonl"}]})
    with pytest.raises(ValidationError, match=name):
        build_corpus(spark, cfg, f"{tmpdir_path}/out")


def test_documents_and_token_ranges_open_few_files(spark, tmpdir_path):
    from tessera.plans.build import stored_document, stored_tokens
    rows = [{"text": " ".join(f"w{(i * j) % 11}" for j in range(i % 9 + 1))} for i in range(300)]
    path = _jsonl(f"{tmpdir_path}/c", {"a.jsonl": rows})
    cfg = dataset_config({"key": "k", "name": "n", "slices": [{"key": "a", "local": f"{path}/a.jsonl"}]})
    build_corpus(spark, cfg, f"{tmpdir_path}/out")
    out = f"{tmpdir_path}/tok"

    def encode(df, key):
        words = F.split("text", " ")
        ids = F.transform(words, lambda w: F.substring(w, 2, 9).cast("int"))
        return df.select(*key, ids.alias("ids"), F.size(words).alias("n_tokens"))
    pretokenize(spark, f"{tmpdir_path}/out/n", out, encode, 11, "w", None)
    whole = spark.read.parquet(f"{out}/tokens").where("split = 'train'").orderBy("doc_pos").collect()
    flat = [x for r in whole for x in r.ids]
    assert len({r.doc_pos for r in whole}) == 240
    for at in (0, 77, 239):
        found = stored_document(spark, out, "train", at)
        assert len(found.inputFiles()) == 1 and [list(r.ids) for r in found.collect()] == [list(whole[at].ids)]
    for a, b in ((0, 5), (100, 101), (37, 400), (len(flat) - 3, len(flat) + 50), (10, 10), (len(flat), len(flat) + 1)):
        got = stored_tokens(spark, out, "train", a, b).orderBy("doc_pos").collect()
        assert [x for r in got for x in r.ids] == flat[a:b] and (not got or got[0]["first"] == a)
    assert len(stored_tokens(spark, out, "train", 100, 104).inputFiles()) <= 2
    for place in (240, -1):
        with pytest.raises(ValidationError):
            stored_document(spark, out, "train", place)


def test_corpus_without_ids_reaches_the_token_store(spark, tmpdir_path):
    rows = [{"body": f"alpha beta w{i % 7}" + " again" * (i % 3), "note": i} for i in range(200)]
    rows += rows[:10]  # repeated rows stay
    path = _jsonl(f"{tmpdir_path}/c", {"a.jsonl": rows})
    cfg = dataset_config({"key": "k", "name": "corp", "slices": [{"key": "a", "local": f"{path}/a.jsonl"}]})
    stats = build_corpus(spark, cfg, tmpdir_path).first()
    assert (stats.total_records, stats.train_records) == (210, 168)
    corpus, out = f"{tmpdir_path}/corp", f"{tmpdir_path}/store"
    model = train_subword(word_counts(spark.read.json(corpus), "body"), 60, special_tokens=["<pad>", "</s>"])

    def encode(df, key):
        return encode_subword(df, model, key, eos_id=1)
    meta = pretokenize(spark, corpus, out, encode, 60, "t", 1, text_field="body")
    assert meta is not None and pretokenize(spark, corpus, out, encode, 60, "t", 1, text_field="body") is None
    store = spark.read.parquet(f"{out}/tokens").collect()
    assert len(store) == 210
    for split in ("train", "validation"):
        docs = sorted((r for r in store if r.split == split), key=lambda r: r.doc_pos)
        assert [r.doc_pos for r in docs] == list(range(len(docs)))
        at = 0
        for r in docs:
            assert r.start == at and r.end == at + len(r.ids) == at + r.n_tokens
            at = r.end
        assert [r.corpus_pos for r in docs] == sorted(r.corpus_pos for r in docs)
    one = document_tokens(spark.read.parquet(f"{out}/tokens").where("split = 'train'"), 3).collect()
    assert len(one) == 1
    for bad in (-1, 168):
        with pytest.raises(ValidationError):
            document_tokens(spark.read.parquet(f"{out}/tokens").where("split = 'train'"), bad)
    totals = token_totals(spark.read.parquet(f"{out}/tokens"))
    assert {(r.split, r.matches) for r in reconcile(totals, f"{corpus}/_stats").collect()} == {
        ("train", True), ("validation", True)}
    assert {r.matches for r in reconcile(totals, f"{tmpdir_path}/nowhere").collect()} == {None}


def test_registered_sampling(spark):
    register_sampling("Every-Other", lambda df, order, key, offset, limit, seed:
                      with_pos(df.where(F.col(key[0]) % 2 == 0), order))
    got = apply_sampling(spark.range(10).toDF("k"), "every-other", ["k"], ["k"])
    assert [r.k for r in got.orderBy("pos").collect()] == [0, 2, 4, 6, 8]
    with pytest.raises(SamplingError, match="every-other, random, sequential"):
        apply_sampling(spark.range(3).toDF("k"), "none", ["k"], ["k"])


def test_row_hook_drops_and_reshapes(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "i long, t string")
    got = map_rows(df, lambda r: None if r["t"] is None else {"i": r["i"] * 10, "extra": 1}, "i long, t string")
    assert sorted((r.i, r.t) for r in got.collect()) == [(10, None), (30, None)]


def test_report_sinks(spark, tmpdir_path):
    rows = spark.createDataFrame([(1, ' a, "b"\nc ', None)], "n long, text string, x double")
    assert not write_inference(rows.limit(0), f"{tmpdir_path}/i") and not os.path.exists(f"{tmpdir_path}/i")
    assert write_inference(rows, f"{tmpdir_path}/i") and write_inference(rows, f"{tmpdir_path}/i")
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{tmpdir_path}/i")
    assert [(r.n, r.text, r.x) for r in back.collect()] == [("1", ' a, "b"\nc ', None)] * 2
    points = spark.createDataFrame([(1, 2, 0.5, None, 0.1, 3.0)], "batch long, tokens_seen long, train_loss double, "
                                   "val_loss double, learning_rate double, timestamp double")
    write_metrics(points, f"{tmpdir_path}/m")
    write_metrics(points, f"{tmpdir_path}/m")
    assert spark.read.option("header", True).csv(f"{tmpdir_path}/m").count() == 2
    write_timeline(spark.createDataFrame([(1.0, [1, 2])], "ts double, ops array<int>"), f"{tmpdir_path}/t")
    assert spark.read.option("header", True).option("escape", '"').csv(f"{tmpdir_path}/t").first().ops == "[1,2]"


def test_rows_are_numbered_and_stored_without_a_shuffle_by_file_or_a_second_one_of_ids(spark, tmpdir_path, monkeypatch):
    from tessera.operators import order
    from tessera.plans import build
    src = _jsonl(f"{tmpdir_path}/c/mix/split=train", {f"{k}.json": [
        {"corpus_pos": i, "text": f"{i} " * (i % 4)} for i in range(k, 30, 3)] for k in range(3)}).rsplit("/", 1)[0]
    _jsonl(f"{src}/split=validation", {"0.json": [{"corpus_pos": i, "text": f"v{i}"} for i in range(30, 40)]})
    monkeypatch.setattr(build, "STRETCH", 4)

    def encode(df, key):
        return df.select(*key, F.transform(F.split("text", " "), lambda x: F.length(x)).alias("ids")).withColumn(
            "n_tokens", F.size("ids"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scan = order.with_file_pos(order.file_order(spark.read.schema("corpus_pos long, text string").json(src)))
        plan = scan._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert pretokenize(spark, src, f"{tmpdir_path}/o", encode, 9, "w", None) is not None
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    got = spark.read.parquet(f"{tmpdir_path}/o/tokens").collect()
    for split, places in (("train", range(30)), ("validation", range(30, 40))):
        rows = sorted((r for r in got if r["split"] == split), key=lambda r: r["doc_pos"])
        sizes = [r["n_tokens"] for r in rows]
        assert [(r["corpus_pos"], r["doc_pos"]) for r in rows] == [(p, i) for i, p in enumerate(places)]
        assert [r["start"] for r in rows] == [sum(sizes[:i]) for i in range(len(sizes))]
        assert all(r["end"] - r["start"] == len(r["ids"]) == r["n_tokens"] for r in rows)
    _jsonl(f"{src}/split=train", {"3.json": [{"corpus_pos": 5, "text": "again"}]})
    with pytest.raises(ValidationError, match="place of another"):
        pretokenize(spark, src, f"{tmpdir_path}/o2", encode, 9, "w", None)
