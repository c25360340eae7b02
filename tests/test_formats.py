"""A user format read in batch, by extension and in a stream."""

import os

import pytest

from tessera.errors import ConfigError
from tessera.sources.formats import register_format
from tessera.sources.readers import read_any


def parser():
    def parse(f):
        """Lines ``key=value``; rows as dicts."""
        for line in f.read().decode().splitlines():
            key, _, text = line.partition("=")
            yield {"key": int(key), "text": text}
    return parse


def put(folder, name, rows):
    with open(f"{folder}/{name}", "w") as f:
        f.write("".join(f"{k}={t}\n" for k, t in rows))


def test_batch_extension_and_stream(spark, tmpdir_path):
    src, sink, ckpt = (f"{tmpdir_path}/{n}" for n in ("src", "sink", "ckpt"))
    os.makedirs(f"{src}/deep")
    register_format(spark, "pairs", "key long, text string", parser(), ".pairs")
    put(src, "a.pairs", [(1, "é"), (2, "two")])
    put(src, "deep/b.pairs", [(3, "three")])
    put(src, "_hidden", [(9, "no")])
    got = spark.read.format("pairs").load(src)
    assert sorted(map(tuple, got.collect())) == [(1, "é"), (2, "two"), (3, "three")] and got.rdd.getNumPartitions() == 2
    assert [tuple(r) for r in read_any(spark, f"{src}/a.pairs", schema="text string").orderBy("text").collect()] == [
        ("two",), ("é",)]
    with pytest.raises(ConfigError):
        read_any(spark, f"{src}/a.pairs", with_file_order=True)

    def run():
        q = (spark.readStream.format("pairs").load(src).writeStream.format("parquet").option("path", sink)
             .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
        q.awaitTermination()
        return sorted(r.key for r in spark.read.parquet(sink).collect())
    assert run() == [1, 2, 3]
    assert run() == [1, 2, 3]  # a restart reads nothing twice
    put(src, "c.pairs", [(4, "new")])
    assert run() == [1, 2, 3, 4]


def test_empty_folder_and_missing_path(spark, tmpdir_path):
    register_format(spark, "pairs2", "key long, text string", parser())
    assert spark.read.format("pairs2").load(tmpdir_path).count() == 0
    with pytest.raises(Exception, match="Source not found"):
        spark.read.format("pairs2").load(f"{tmpdir_path}/none").collect()
