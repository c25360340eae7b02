"""Corpus-builder queries: sources, sinks, slices, splits, text projections."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize, preview, pretokenize, short_name
from ..operators.hooks import map_rows
from ..operators.order import with_pos
from ..operators.slices import (merge_slices, slice_legacy, slice_random, slice_sequential, split_blocks,
                                split_shuffled, split_stats)
from ..session import scratch_path
from ..sources.readers import (read_any, read_csv, read_json, read_jsonl, read_prompts, read_text,
                               require_text, text_fallback)
from .common import SQL_DIGITS, SQL_PRETOK, SQL_WHITESPACE, SQL_WHITESPACE_DIGITS, sql_hash, table
from .registry import query

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
DOC_COLS = ["doc_id", "text", "lang", "source", "n_chars"]
ROWS_PER_JSON_FILE = 5000


def _docs(spark, sf):
    return table(spark, sf, "documents")


# --- sources and sinks: round trips through each format ----------------------------
@query("scan_parquet", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def scan_parquet(spark: SparkSession, sf: str):
    return read_any(spark, f"{sf.rstrip('/')}/documents.parquet").select(*DOC_COLS)


@query("scan_jsonl", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def scan_jsonl(spark: SparkSession, sf: str):
    path = scratch_path(spark, "docs-jsonl")
    _docs(spark, sf).write.mode("overwrite").json(path)
    return read_jsonl(spark, path, DOC_SCHEMA).select(*DOC_COLS)


@query("scan_json", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def scan_json(spark: SparkSession, sf: str):
    """Whole-file JSON arrays: rows are hashed into files of bounded size, each
    file one array (one task per file on read)."""
    d = _docs(spark, sf)
    n_files = max(1, math.ceil(d.count() / ROWS_PER_JSON_FILE))
    arrays = (d.withColumn("_f", F.pmod(F.xxhash64("doc_id"), F.lit(n_files)))
              .groupBy("_f")
              .agg(F.concat(F.lit("["), F.array_join(F.collect_list(F.to_json(F.struct(*DOC_COLS))), ","),
                            F.lit("]")).alias("value")))
    path = scratch_path(spark, "docs-json")
    arrays.write.mode("overwrite").partitionBy("_f").text(path)
    return read_json(spark, path, DOC_SCHEMA + ", _f int").select(*DOC_COLS)


@query("scan_csv", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def scan_csv(spark: SparkSession, sf: str):
    path = scratch_path(spark, "docs-csv")
    (_docs(spark, sf).write.mode("overwrite").option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return read_csv(spark, path, DOC_SCHEMA).select(*DOC_COLS)


@query("scan_text", "SELECT unnest(string_split(text, chr(10))) AS value FROM documents")
def scan_text(spark: SparkSession, sf: str):
    path = scratch_path(spark, "docs-text")
    _docs(spark, sf).select("text").write.mode("overwrite").text(path)
    return read_text(spark, path).select("value")


_SQL_STRIP = "regexp_replace(line, '^\\s+|\\s+$', '', 'g')"


@query("scan_prompts", f"""
SELECT prompt FROM (
  SELECT {_SQL_STRIP} AS prompt
  FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM conversations WHERE role = 'user'))
WHERE prompt <> ''""")
def scan_prompts(spark: SparkSession, sf: str):
    path = scratch_path(spark, "prompts")
    (table(spark, sf, "conversations").where(F.col("role") == "user").select("text")
     .write.mode("overwrite").text(path))
    return read_prompts(spark, path).select("prompt")


@query("extract_text", "SELECT doc_id, text FROM documents")
def extract_text(spark: SparkSession, sf: str):
    return require_text(_docs(spark, sf), "text").select("doc_id", "text")


@query("text_fallback", """
SELECT 'documents' AS origin, doc_id AS id, text FROM documents
UNION ALL SELECT 'pages', page_id, html FROM pages
UNION ALL SELECT 'benchmark', item_id, text FROM benchmark""")
def text_fallback_q(spark: SparkSession, sf: str):
    d = _docs(spark, sf).select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), "text")
    p = table(spark, sf, "pages").select(F.lit("pages").alias("origin"), F.col("page_id").alias("id"),
                                         F.col("html").alias("body"))
    b = table(spark, sf, "benchmark").select(F.lit("benchmark").alias("origin"), F.col("item_id").alias("id"),
                                             F.col("text").alias("content"))
    merged = d.unionByName(p, allowMissingColumns=True).unionByName(b, allowMissingColumns=True)
    return text_fallback(merged).select("origin", "id", "text")


def _keep_long_english(df):
    """Example map-filter hook: keep English documents of at least 100 characters."""
    return df.where((F.col("lang") == "en") & (F.length("text") >= 100))


@query("preprocess_hook", "SELECT doc_id, lang FROM documents WHERE lang = 'en' AND length(text) >= 100")
def preprocess_hook(spark: SparkSession, sf: str):
    return _docs(spark, sf).transform(_keep_long_english).select("doc_id", "lang")


@query("row_hook", """
SELECT doc_id, upper(source) AS source, CAST(length(text) AS BIGINT) AS n FROM documents WHERE lang <> 'de'""")
def row_hook(spark: SparkSession, sf: str):
    """A Python function on every row; rows for which it returns None go."""
    def fn(row):
        return None if row["lang"] == "de" else {"doc_id": row["doc_id"], "source": row["source"].upper(),
                                                 "n": len(row["text"])}
    return map_rows(_docs(spark, sf).select("doc_id", "lang", "source", "text"), fn, "doc_id long, source string, n long")


@query("sample_texts", """
SELECT doc_id, text FROM documents WHERE regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> ''
ORDER BY doc_id LIMIT 5""")
def sample_texts(spark: SparkSession, sf: str):
    d = _docs(spark, sf)
    return d.where(F.regexp_replace("text", r"(?U)^\s+|\s+$", "") != "").orderBy("doc_id").limit(5) \
        .select("doc_id", "text")


@query("preview_text", """
SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS preview
FROM documents""")
def preview_text(spark: SparkSession, sf: str):
    return _docs(spark, sf).select("doc_id", preview("text", 100).alias("preview"))


@query("short_name", """
SELECT page_id, regexp_replace(string_split(url, '/')[-1], '\\.json$', '') AS short_name FROM pages""")
def short_name_q(spark: SparkSession, sf: str):
    return table(spark, sf, "pages").select("page_id", short_name("url").alias("short_name"))


# --- slices ----------------------------------------------------------------------------
@query("slice_sequential", """
SELECT doc_id, pos - 100 AS pos FROM (
  SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents)
WHERE pos >= 100 AND pos < 600""")
def slice_sequential_q(spark: SparkSession, sf: str):
    return slice_sequential(_docs(spark, sf).select("doc_id"), ["doc_id"], offset=100, limit=500).select("doc_id", "pos")


@query("slice_random", f"""
SELECT doc_id, pos - 100 AS pos FROM (
  SELECT doc_id, row_number() OVER (ORDER BY {sql_hash(42, 'doc_id')}, doc_id) - 1 AS pos FROM documents)
WHERE pos >= 100 AND pos < 600""")
def slice_random_q(spark: SparkSession, sf: str):
    return slice_random(_docs(spark, sf).select("doc_id"), ["doc_id"], offset=100, limit=500, seed=42).select("doc_id", "pos")


@query("slice_legacy", f"""
SELECT doc_id, row_number() OVER (ORDER BY {sql_hash(42, 'doc_id')}, doc_id) - 1 AS pos FROM (
  SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p FROM documents)
WHERE p >= 100 AND p < 600""")
def slice_legacy_q(spark: SparkSession, sf: str):
    return slice_legacy(_docs(spark, sf).select("doc_id"), ["doc_id"], ["doc_id"], offset=100, limit=500, seed=42) \
        .select("doc_id", "pos")


@query("merge_slices", f"""
WITH d AS (SELECT 'docs' AS slice_key, doc_id, NULL::BIGINT AS conv_id, NULL::BIGINT AS turn,
                  NULL::BIGINT AS item_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS p FROM documents),
     c AS (SELECT 'chat' AS slice_key, NULL::BIGINT, conv_id, turn, NULL::BIGINT, text,
                  row_number() OVER (ORDER BY {sql_hash(42, 'conv_id', 'turn')}, conv_id, turn) - 1 AS p
           FROM conversations),
     b AS (SELECT 'bench' AS slice_key, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, item_id, text,
                  row_number() OVER (ORDER BY item_id) - 1 AS p FROM benchmark),
     u AS (SELECT *, 0 AS o FROM d
           UNION ALL SELECT *, 1 FROM c
           UNION ALL SELECT *, 2 FROM b)
SELECT slice_key, doc_id, conv_id, turn, item_id, text,
       CASE o WHEN 0 THEN p WHEN 1 THEN p + (SELECT count(*) FROM u WHERE o = 0)
            ELSE p + (SELECT count(*) FROM u WHERE o < 2) END AS pos
FROM u""")
def merge_slices_q(spark: SparkSession, sf: str):
    d = slice_sequential(_docs(spark, sf).select("doc_id", "text"), ["doc_id"])
    conv = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    c = slice_random(conv, ["conv_id", "turn"], seed=42)
    b = slice_sequential(table(spark, sf, "benchmark").select("item_id", "text"), ["item_id"])
    m = merge_slices([("docs", d), ("chat", c), ("bench", b)])
    return m.select("slice_key", "doc_id", "conv_id", "turn", "item_id", "text", "pos")


# --- splits ----------------------------------------------------------------------------
_SQL_SPLIT = f"""
SELECT doc_id, CASE WHEN r < floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'validation' END AS split FROM (
  SELECT doc_id, row_number() OVER (ORDER BY {sql_hash(42, 'doc_id')}, doc_id) - 1 AS r,
         count(*) OVER () AS n FROM documents)"""


@query("split_shuffled", _SQL_SPLIT)
def split_shuffled_q(spark: SparkSession, sf: str):
    return split_shuffled(_docs(spark, sf), ["doc_id"], 0.8, seed=42).select("doc_id", "split")


@query("split_blocks", """
SELECT doc_id, CASE WHEN (row_number() OVER (ORDER BY doc_id) - 1) % 10000 < 8000
                    THEN 'train' ELSE 'validation' END AS split FROM documents""")
def split_blocks_q(spark: SparkSession, sf: str):
    d = with_pos(_docs(spark, sf).select("doc_id"), ["doc_id"], "pos")
    return split_blocks(d, 0.8, "pos").select("doc_id", "split")


@query("split_blocks_events", """
SELECT event_id, CASE WHEN (row_number() OVER (ORDER BY ts, event_id) - 1) % 10000 < floor(10000 * 0.57::DOUBLE)
                      THEN 'train' ELSE 'validation' END AS split FROM events""")
def split_blocks_events_q(spark: SparkSession, sf: str):
    e = with_pos(table(spark, sf, "events").select("event_id", "ts"), ["ts", "event_id"], "pos")
    return split_blocks(e, 0.57, "pos").select("event_id", "split")


@query("split_stats", f"""
SELECT 'documents' AS dataset_name, 'docs' AS dataset_key, count(*) AS total_records,
       count(*) FILTER (WHERE split = 'train') AS train_records,
       count(*) FILTER (WHERE split = 'validation') AS validation_records,
       0.8::DOUBLE AS train_split, 0.2::DOUBLE AS validation_split, 1 AS num_slices
FROM ({_SQL_SPLIT})""")
def split_stats_q(spark: SparkSession, sf: str):
    s = split_shuffled(_docs(spark, sf), ["doc_id"], 0.8, seed=42)
    return split_stats(s, "documents", "docs", 0.8, 0.2, 1)


@query("write_jsonl_roundtrip", f"""
SELECT s.doc_id, s.split, d.text FROM ({_SQL_SPLIT}) s JOIN documents d USING (doc_id)""")
def write_jsonl_roundtrip(spark: SparkSession, sf: str):
    """Corpus sink: ``<out>/split=<train|validation>/part-*.json`` (UTF-8 kept), read back."""
    s = split_shuffled(_docs(spark, sf), ["doc_id"], 0.8, seed=42)
    path = scratch_path(spark, "corpus")
    s.select("doc_id", "text", "split").write.mode("overwrite").partitionBy("split").json(path)
    return read_jsonl(spark, path, "doc_id long, text string, split string").select("doc_id", "split", "text")


# --- text projections ------------------------------------------------------------------
@query("normalize_text", "SELECT doc_id, nfc_normalize(text) AS text_nfc FROM documents")
def normalize_text(spark: SparkSession, sf: str):
    return _docs(spark, sf).select("doc_id", normalize("text", "nfc").alias("text_nfc"))


def _pretok_query(kind: str, pattern: str, sep: str):
    sql = f"""
SELECT doc_id, len(t) AS n_pretokens, array_to_string(t, '{sep}') AS pretokens
FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS t FROM documents)"""

    def fn(spark: SparkSession, sf: str):
        t = pretokenize("text", kind)
        return _docs(spark, sf).select("doc_id", F.size(t).cast("long").alias("n_pretokens"),
                                       F.array_join(t, sep).alias("pretokens"))
    return sql, fn


for _name, _kind, _pat, _sep in (("pretok_whitespace", "whitespace", SQL_WHITESPACE, " "),
                                 ("pretok_digits", "digits", SQL_DIGITS, "|"),
                                 ("pretok_ws_digits", "whitespace_digits", SQL_WHITESPACE_DIGITS, " ")):
    _sql, _fn = _pretok_query(_kind, _pat, _sep)
    query(_name, _sql)(_fn)


@query("pretok_bytes")
def pretok_bytes(spark: SparkSession, sf: str):
    t = pretokenize("text", "byte_level")
    return _docs(spark, sf).select("doc_id", F.size(t).cast("long").alias("n_pretokens"),
                                   F.array_join(t, " ").alias("pretokens"))


@query("word_counts", f"SELECT w AS word, count(*) AS count FROM (SELECT unnest({SQL_PRETOK}) AS w FROM documents) GROUP BY w")
def word_counts_q(spark: SparkSession, sf: str):
    from ..operators.vocab import word_counts
    return word_counts(_docs(spark, sf))


