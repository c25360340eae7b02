"""Token queries: vocabularies, encoding, offsets, packing, samples, batches.

Test mapping: token ids are word-level ranks (pre-token by count desc, then
token), after the special tokens ``<pad> <bos> </s> <|endoftext|>`` (ids 0-3),
so DuckDB can follow; subword (BPE / WordPiece) training and encoding run on
the same documents without an oracle (checked against the public tokenizer
library in the tests).
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.text import preview
from ..operators import encode as enc
from ..operators import samples as smp
from ..operators.order import written
from ..operators.pack import pack_stats, pack_windows
from ..operators.slices import split_shuffled
from ..operators.vocab import (EOS_CANDIDATES, SubwordModel, find_eos, rank_vocab, token_dtype, train_subword, vocab_stats,
                               word_counts)
from ..session import scratch_path
from .common import SQL_PRETOK, SQL_WHITESPACE, sql_hash, table
from .registry import query

SPECIALS = ("<pad>", "<bos>", "</s>", "<|endoftext|>")
PAD, BOS, EOS = 0, 1, 3  # EOS = first EOS candidate found in SPECIALS
C = 512
BATCH = 8
CUT_ID = 4  # "cut at EOS" demonstrated with the most frequent word as the stop id

# --- SQL building blocks ----------------------------------------------------------------
_PRETOK = SQL_PRETOK
_SQL_VOCAB = f"""
wc AS (SELECT w AS token, count(*) AS c FROM (SELECT unnest({_PRETOK}) AS w FROM documents) GROUP BY w),
vocab AS (SELECT token, row_number() OVER (ORDER BY c DESC, token) - 1 + {len(SPECIALS)} AS id FROM wc
          UNION ALL SELECT * FROM (VALUES {", ".join(f"('{t}', {i})" for i, t in enumerate(SPECIALS))}) v(token, id))"""
_SQL_ENC = f"""
toks AS (SELECT doc_id, unnest({_PRETOK}) AS token, generate_subscripts({_PRETOK}, 1) AS i FROM documents),
enc AS (SELECT d.doc_id, coalesce(list(v.id ORDER BY t.i) FILTER (WHERE v.id IS NOT NULL), []) AS ids
        FROM documents d LEFT JOIN toks t ON t.doc_id = d.doc_id LEFT JOIN vocab v ON v.token = t.token
        GROUP BY d.doc_id)"""
_SQL_SPLIT = f"""
split AS (SELECT doc_id, CASE WHEN r < floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'validation' END AS split FROM (
  SELECT doc_id, row_number() OVER (ORDER BY {sql_hash(42, 'doc_id')}, doc_id) - 1 AS r,
         count(*) OVER () AS n FROM documents))"""


def _sql_pack(src: str, max_docs: int | None = None, group: str | None = None, name: str = "pw") -> str:
    """CTEs ``<name>_ne``, ``<name>_w``, ``<name>``: sequential next-fit as a recursive CTE."""
    gs = f"{group}, " if group else ""
    gn = f"ne.{group}, " if group else ""
    gp = f"PARTITION BY {group} " if group else ""
    gj = f" AND ne.{group} = w.{group}" if group else ""
    brk = f"w.len + ne.eff > {C}" + (f" OR w.cnt >= {max_docs}" if max_docs else "")
    return f"""
{name}_ne AS (SELECT {gs}doc_id, n, n + 2 AS eff, row_number() OVER ({gp}ORDER BY doc_id) AS r
        FROM ({src}) WHERE n > 0),
{name}_w AS (
  SELECT {gs}r, doc_id, n, eff, 0::BIGINT AS win, (CASE WHEN eff > {C} THEN {C} ELSE eff END)::BIGINT AS len,
         1::BIGINT AS cnt FROM {name}_ne WHERE r = 1
  UNION ALL
  SELECT {gn}ne.r, ne.doc_id, ne.n, ne.eff,
    CASE WHEN ne.eff > {C} OR {brk} THEN w.win + 1 ELSE w.win END,
    CASE WHEN ne.eff > {C} THEN {C} WHEN {brk} THEN ne.eff ELSE w.len + ne.eff END,
    CASE WHEN ne.eff > {C} OR {brk} THEN 1 ELSE w.cnt + 1 END
  FROM {name}_w w JOIN {name}_ne ne ON ne.r = w.r + 1{gj}),
{name} AS (SELECT {gs}doc_id, win AS window_id,
  CAST(row_number() OVER (PARTITION BY {gs}win ORDER BY r) - 1 AS INTEGER) AS slot,
  CAST(n AS BIGINT) AS n_tokens, eff > {C} AS oversize, CAST(eff AS BIGINT) AS eff_len FROM {name}_w)"""


_SQL_DOCN = f"SELECT doc_id, len({_PRETOK}) AS n FROM documents"
_SQL_PIECES = f"""
pieces AS (SELECT pw.window_id, pw.slot, pw.doc_id,
                  CASE WHEN pw.oversize THEN []::BIGINT[] ELSE list_concat([{BOS}], enc.ids, [{EOS}]) END AS piece
           FROM pw JOIN enc USING (doc_id)),
smp AS (SELECT window_id, count(*) AS n_docs, flatten(list(piece ORDER BY slot)) AS x,
               flatten(list(list_transform(piece, lambda e: slot) ORDER BY slot)) AS o
        FROM pieces GROUP BY window_id),
padded AS (SELECT window_id, n_docs, len(x) AS n_real,
                  list_concat(x, list_transform(range({C} - len(x)), lambda i: {PAD})) AS ids,
                  list_concat(o, list_transform(range({C} - len(o)), lambda i: -1)) AS dids FROM smp)"""


def _with(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(c.strip() for c in ctes)


# --- Spark building blocks --------------------------------------------------------------
def _vocab(spark: SparkSession, sf: str):
    return rank_vocab(word_counts(table(spark, sf, "documents")), SPECIALS)


def _encoded(spark: SparkSession, sf: str, eos: int | None = None):
    """Documents cut into words once: the vocabulary counts the words of the blocks that are then encoded."""
    blocks = enc.token_blocks(table(spark, sf, "documents"))
    return enc.encode_rank(blocks, rank_vocab(word_counts(blocks), SPECIALS), eos_id=eos)


def _ids_str(c: str):
    return F.array_join(F.transform(F.col(c), lambda x: x.cast("string")), " ")


def _windows(spark: SparkSession, sf: str, max_docs: int | None = None):
    from .common import docs_with_counts
    return pack_windows(docs_with_counts(spark, sf), C, overhead=2, max_docs=max_docs)


def _tokens_and_windows(spark: SparkSession, sf: str):
    """One written token table, and the windows of its lengths: a document is read and encoded once."""
    toks = written(_encoded(spark, sf).withColumnRenamed("doc_id", "doc_pos"), "tokens")
    return toks, pack_windows(toks, C, overhead=2)


def _samples(spark: SparkSession, sf: str):
    toks, windows = _tokens_and_windows(spark, sf)
    return smp.build_samples(windows, toks, C, PAD, BOS, EOS)


# --- vocabulary ---------------------------------------------------------------------------
@query("word_vocab", _with(_SQL_VOCAB) + " SELECT token, id FROM vocab")
def word_vocab(spark: SparkSession, sf: str):
    return _vocab(spark, sf)


@query("vocab_stats", _with(_SQL_VOCAB) + f"""
SELECT count(*) AS vocab_size, count(*) FILTER (WHERE token IN ({", ".join(f"'{t}'" for t in SPECIALS)}))
       AS special_tokens, max(id) AS max_id, round(avg(length(token)), 6) AS avg_token_chars,
       max(length(token)) AS max_token_chars FROM vocab""")
def vocab_stats_q(spark: SparkSession, sf: str):
    return vocab_stats(_vocab(spark, sf), SPECIALS).select(
        "vocab_size", "special_tokens", "max_id", "avg_token_chars", F.col("max_token_chars").cast("long"))


@query("find_eos", _with(_SQL_VOCAB) + f"""
SELECT min_by(id, array_position([{", ".join(f"'{t}'" for t in EOS_CANDIDATES)}], token)) AS eos_id,
       min_by(token, array_position([{", ".join(f"'{t}'" for t in EOS_CANDIDATES)}], token)) AS eos_token
FROM vocab WHERE token IN ({", ".join(f"'{t}'" for t in EOS_CANDIDATES)})""")
def find_eos_q(spark: SparkSession, sf: str):
    return find_eos(_vocab(spark, sf))


# --- encoding --------------------------------------------------------------------------------
@query("encode_words", _with(_SQL_VOCAB, _SQL_ENC) + """
SELECT doc_id, len(ids) AS n_tokens, array_to_string(ids, ' ') AS ids FROM enc""")
def encode_words(spark: SparkSession, sf: str):
    e = _encoded(spark, sf)
    return e.select("doc_id", F.col("n_tokens").cast("long"), _ids_str("ids").alias("ids"))


@query("append_eos", _with(_SQL_VOCAB, _SQL_ENC) + f"""
SELECT doc_id, len(ids) + 1 AS n_tokens, {EOS} AS last_id FROM enc""")
def append_eos_q(spark: SparkSession, sf: str):
    e = _encoded(spark, sf, eos=EOS)
    return e.select("doc_id", F.col("n_tokens").cast("long"), F.element_at("ids", -1).alias("last_id"))


@query("cut_at_eos", _with(_SQL_VOCAB, _SQL_ENC) + f"""
SELECT doc_id, CASE WHEN list_position(ids, {CUT_ID}) > 0 THEN list_position(ids, {CUT_ID}) - 1
                    ELSE len(ids) END AS n_tokens FROM enc""")
def cut_at_eos_q(spark: SparkSession, sf: str):
    e = _encoded(spark, sf)
    return e.select("doc_id", F.size(enc.cut_at_eos("ids", CUT_ID)).cast("long").alias("n_tokens"))


@query("decode_tokens", _with(_SQL_VOCAB, _SQL_ENC) + """
SELECT e.doc_id, coalesce(string_agg(v.token, '' ORDER BY u.i), '') AS text
FROM enc e LEFT JOIN (SELECT doc_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS i FROM enc) u USING (doc_id)
LEFT JOIN vocab v ON v.id = u.id GROUP BY e.doc_id""")
def decode_tokens(spark: SparkSession, sf: str):
    e = _encoded(spark, sf).withColumnRenamed("doc_id", "row_id")
    return enc.decode_ids(e, _vocab(spark, sf), "ids", ["row_id"]).withColumnRenamed("row_id", "doc_id")


@query("token_offsets", _with(_SQL_VOCAB, _SQL_ENC) + """
SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS doc_pos, len(ids) + 1 AS n_tokens,
       CAST(coalesce(sum(len(ids) + 1) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
            AS BIGINT) AS start,
       CAST(sum(len(ids) + 1) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS "end"
FROM enc""")
def token_offsets_q(spark: SparkSession, sf: str):
    e = _encoded(spark, sf, eos=EOS)
    o = enc.token_offsets(written(e.select("doc_id", "n_tokens"), "sizes"), ["doc_id"], "doc_pos")
    return o.select("doc_id", "doc_pos", F.col("n_tokens").cast("long"), F.col("start").cast("long"),
                    F.col("end").cast("long"))


@query("token_totals", _with(_SQL_VOCAB, _SQL_ENC, _SQL_SPLIT) + f"""
SELECT split, CAST(sum(len(ids) + 1) AS BIGINT) AS tokens, count(*) AS documents, {EOS}::BIGINT AS eos_id
FROM enc JOIN split USING (doc_id) GROUP BY split""")
def token_totals_q(spark: SparkSession, sf: str):
    e = _encoded(spark, sf, eos=EOS)
    s = split_shuffled(table(spark, sf, "documents").select("doc_id"), ["doc_id"], 0.8, 42)
    return enc.token_totals(e.join(s, "doc_id"), "split", EOS)


def token_metadata(encoded_split, vocab_size: int, tokenizer_name: str, eos_id, dataset_name: str,
                   dataset_key: str, text_field: str = "text"):
    """One metadata row from the per-split totals."""
    t = encoded_split.agg(
        F.sum(F.when(F.col("split") == "train", F.col("n_tokens")).otherwise(0)).cast("long").alias("train_tokens"),
        F.count(F.when(F.col("split") == "train", 1)).alias("train_documents"),
        F.sum(F.when(F.col("split") == "validation", F.col("n_tokens")).otherwise(0)).cast("long")
        .alias("validation_tokens"),
        F.count(F.when(F.col("split") == "validation", 1)).alias("validation_documents"))
    total = F.col("train_tokens") + F.col("validation_tokens")
    return t.select(
        F.lit(tokenizer_name).alias("tokenizer_name"), F.lit(int(vocab_size)).cast("long").alias("vocab_size"),
        "train_tokens", "train_documents", "validation_tokens", "validation_documents",
        total.alias("total_tokens"), (F.col("train_documents") + F.col("validation_documents")).alias("total_documents"),
        F.lit(text_field).alias("text_field"), F.lit(eos_id is not None).alias("add_eos"),
        F.lit(token_dtype(vocab_size)).alias("dtype"),
        F.when(total < F.lit(2 ** 32), "uint32").otherwise("uint64").alias("offset_dtype"),
        F.lit(dataset_name).alias("dataset_name"), F.lit(dataset_key).alias("dataset_key"))


@query("token_metadata", _with(_SQL_VOCAB, _SQL_ENC, _SQL_SPLIT) + """
, t AS (SELECT CAST(sum(len(ids) + 1) FILTER (WHERE split = 'train') AS BIGINT) AS train_tokens,
              count(*) FILTER (WHERE split = 'train') AS train_documents,
              CAST(sum(len(ids) + 1) FILTER (WHERE split = 'validation') AS BIGINT) AS validation_tokens,
              count(*) FILTER (WHERE split = 'validation') AS validation_documents
       FROM enc JOIN split USING (doc_id))
SELECT 'words' AS tokenizer_name, (SELECT count(*) FROM vocab) AS vocab_size, train_tokens, train_documents,
       validation_tokens, validation_documents, train_tokens + validation_tokens AS total_tokens,
       train_documents + validation_documents AS total_documents, 'text' AS text_field, true AS add_eos,
       CASE WHEN (SELECT count(*) FROM vocab) < 65536 THEN 'uint16' ELSE 'uint32' END AS dtype,
       CASE WHEN train_tokens + validation_tokens < 4294967296 THEN 'uint32' ELSE 'uint64' END AS offset_dtype,
       'documents' AS dataset_name, 'docs' AS dataset_key FROM t""")
def token_metadata_q(spark: SparkSession, sf: str):
    v = _vocab(spark, sf)
    n_vocab = v.count()  # vocabulary size: one count, decides the dtype
    e = _encoded(spark, sf, eos=EOS)
    s = split_shuffled(table(spark, sf, "documents").select("doc_id"), ["doc_id"], 0.8, 42)
    return token_metadata(e.join(s, "doc_id"), n_vocab, "words", EOS, "documents", "docs")


@query("count_check", _with(_SQL_VOCAB, _SQL_ENC, _SQL_SPLIT) + """
SELECT s.split, s.expected_documents, t.documents, s.expected_documents = t.documents AS matches
FROM (SELECT split, count(*) AS expected_documents FROM split GROUP BY split) s
LEFT JOIN (SELECT split, count(*) AS documents FROM enc JOIN split USING (doc_id) GROUP BY split) t USING (split)""")
def count_check(spark: SparkSession, sf: str):
    """Token totals reconciled with the split statistics (expected document counts)."""
    s = split_shuffled(table(spark, sf, "documents").select("doc_id"), ["doc_id"], 0.8, 42)
    expected = s.groupBy("split").agg(F.count(F.lit(1)).alias("expected_documents"))
    totals = enc.token_totals(_encoded(spark, sf, eos=EOS).join(s, "doc_id"), "split", EOS)
    return (expected.join(totals.select("split", "documents"), "split", "left")
            .withColumn("matches", F.col("expected_documents") == F.col("documents")))


@query("write_tokens_roundtrip", _with(_SQL_VOCAB, _SQL_ENC) + """
SELECT doc_id, len(ids) AS n_tokens, array_to_string(ids, ' ') AS ids FROM enc""")
def write_tokens_roundtrip(spark: SparkSession, sf: str):
    """Token store: Parquet (zstd), one row per document, read back."""
    path = scratch_path(spark, "tokens")
    _encoded(spark, sf).write.mode("overwrite").option("compression", "zstd").parquet(path)
    back = spark.read.parquet(path)
    return back.select("doc_id", F.col("n_tokens").cast("long"), _ids_str("ids").alias("ids"))


@query("doc_lookup", _with(_SQL_VOCAB, _SQL_ENC, _SQL_SPLIT) + """
, o AS (SELECT doc_id, CAST(coalesce(sum(len(ids)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING
              AND 1 PRECEDING), 0) AS BIGINT) AS start, len(ids) AS n_tokens FROM enc)
SELECT o.doc_id, o.start, o.n_tokens FROM split JOIN o USING (doc_id) WHERE split.split = 'validation'""")
def doc_lookup(spark: SparkSession, sf: str):
    """Random access: the validation documents looked up in the token store (equi join on the document)."""
    sizes = written(_encoded(spark, sf).select("doc_id", "n_tokens"), "sizes")  # ordering reads its rows twice
    store = enc.token_offsets(sizes, ["doc_id"], "doc_pos")
    s = split_shuffled(table(spark, sf, "documents").select("doc_id"), ["doc_id"], 0.8, 42)
    want = s.where(F.col("split") == "validation").select("doc_id")
    return want.join(store, "doc_id").select("doc_id", F.col("start").cast("long"), F.col("n_tokens").cast("long"))


# --- packing ---------------------------------------------------------------------------------
@query("pack_windows", _with(_sql_pack(_SQL_DOCN)) + " SELECT doc_id, window_id, slot, n_tokens, oversize FROM pw")
def pack_windows_q(spark: SparkSession, sf: str):
    return _windows(spark, sf).select(F.col("doc_pos").alias("doc_id"), "window_id", "slot", "n_tokens", "oversize")


@query("pack_windows_max2", _with(_sql_pack(_SQL_DOCN, max_docs=2)) +
       " SELECT doc_id, window_id, slot, n_tokens, oversize FROM pw")
def pack_windows_max2(spark: SparkSession, sf: str):
    return _windows(spark, sf, max_docs=2).select(F.col("doc_pos").alias("doc_id"), "window_id", "slot",
                                                   "n_tokens", "oversize")


@query("pack_oversize", _with(_sql_pack(_SQL_DOCN)) + f"""
SELECT doc_id, window_id, n_tokens, 0 AS real_pad, CAST(least(eff_len, {C}) AS INTEGER) AS real_truncate
FROM pw WHERE oversize""")
def pack_oversize(spark: SparkSession, sf: str):
    """Documents that fit no window, under both rules: each has a window of its own, so only those are built."""
    toks, windows = _tokens_and_windows(spark, sf)
    w = written(windows.where("oversize"), "oversize")
    real = [smp.build_samples(w, toks, C, PAD, BOS, EOS, mode).select("window_id", F.col("n_real").alias(f"real_{mode}"))
            for mode in ("pad", "truncate")]
    return (w.select(F.col("doc_pos").alias("doc_id"), "window_id", "n_tokens")
            .join(real[0], "window_id").join(real[1], "window_id"))


_SQL_STATS_TAIL = f"""
per_w AS (SELECT window_id, count(*) AS docs, sum(least(n_tokens, {C})) AS tok,
                 sum(CASE WHEN oversize THEN 0 ELSE eff_len END) AS real FROM pw GROUP BY window_id)
SELECT (SELECT count(*) FROM documents) AS total_documents, count(*) AS total_windows,
       CAST(ceil(count(*) / {BATCH}.0) AS BIGINT) AS total_batches, {C} AS context_length, {BATCH} AS batch_size,
       round(avg(docs), 6) AS avg_docs_per_window, round(avg(tok), 6) AS avg_tokens_per_window,
       round(avg(tok) / {C}, 6) AS avg_packing_efficiency, CAST(min(docs) AS BIGINT) AS min_docs_per_window,
       CAST(max(docs) AS BIGINT) AS max_docs_per_window,
       round(sum(real) / (count(*) * {C}.0), 6) AS real_token_share FROM per_w"""


@query("pack_stats", _with(_sql_pack(_SQL_DOCN), _SQL_STATS_TAIL))
def pack_stats_q(spark: SparkSession, sf: str):
    from .common import docs_with_counts
    docs = docs_with_counts(spark, sf)
    return pack_stats(pack_windows(docs, C, overhead=2), docs, C, BATCH)


def pack_report(spark: SparkSession, sf: str):
    """Flagship: documents -> exact shuffled split -> pre-token lengths (+BOS/EOS)
    -> next-fit packing per split -> packing statistics per split."""
    from .common import docs_with_counts
    docs = docs_with_counts(spark, sf)
    s = split_shuffled(docs, ["doc_id"], 0.8, seed=42)
    w = pack_windows(s, C, overhead=2, group_cols=["split"])
    return pack_stats(w, s, C, BATCH, group_cols=["split"])


_SQL_REPORT = _with(
    _SQL_SPLIT,
    f"docn AS (SELECT d.doc_id, s.split, len({_PRETOK}) AS n FROM documents d JOIN split s USING (doc_id))",
    _sql_pack("SELECT * FROM docn", group="split"),
    f"""per_w AS (SELECT split, window_id, count(*) AS docs, sum(least(n_tokens, {C})) AS tok,
                 sum(CASE WHEN oversize THEN 0 ELSE eff_len END) AS real FROM pw GROUP BY split, window_id)""") + f"""
SELECT s.split, s.total_documents, count(*) AS total_windows,
       CAST(ceil(count(*) / {BATCH}.0) AS BIGINT) AS total_batches, {C} AS context_length, {BATCH} AS batch_size,
       round(avg(docs), 6) AS avg_docs_per_window, round(avg(tok), 6) AS avg_tokens_per_window,
       round(avg(tok) / {C}, 6) AS avg_packing_efficiency, CAST(min(docs) AS BIGINT) AS min_docs_per_window,
       CAST(max(docs) AS BIGINT) AS max_docs_per_window,
       round(sum(real) / (count(*) * {C}.0), 6) AS real_token_share
FROM (SELECT split, count(*) AS total_documents FROM split GROUP BY split) s JOIN per_w USING (split)
GROUP BY s.split, s.total_documents"""
query("pack_report", _SQL_REPORT)(pack_report)


# --- samples, labels, batches ---------------------------------------------------------------
_SMP = (_SQL_VOCAB, _SQL_ENC, _sql_pack(_SQL_DOCN), _SQL_PIECES)


@query("build_samples", _with(*_SMP) + " SELECT window_id, n_docs, n_real, array_to_string(ids, ' ') AS input_ids FROM padded")
def build_samples_q(spark: SparkSession, sf: str):
    s = _samples(spark, sf)
    return s.select("window_id", "n_docs", F.col("n_real").cast("long"), _ids_str("input_ids").alias("input_ids"))


@query("sample_doc_ids", _with(*_SMP) + " SELECT window_id, array_to_string(dids, ' ') AS doc_ids FROM padded")
def sample_doc_ids(spark: SparkSession, sf: str):
    return _samples(spark, sf).select("window_id", _ids_str("doc_ids").alias("doc_ids"))


@query("make_labels", _with(*_SMP) + f"""
SELECT window_id, array_to_string(list_transform(range(1, {C} + 1), lambda i:
    CASE WHEN i = {C} THEN 0 WHEN ids[i] = {PAD} THEN 0 ELSE ids[i + 1] END), ' ') AS labels FROM padded""")
def make_labels_q(spark: SparkSession, sf: str):
    s = _samples(spark, sf)
    return s.select("window_id", _ids_str_col(smp.make_labels("input_ids", C, PAD, 0)).alias("labels"))


def _ids_str_col(col):
    return F.array_join(F.transform(col, lambda x: x.cast("string")), " ")


_SQL_RUNS = """
runs AS (SELECT window_id, slot, len(piece) AS length,
                CAST(coalesce(sum(len(piece)) OVER (PARTITION BY window_id ORDER BY slot
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start
         FROM pieces)"""


@query("block_mask", _with(*_SMP, _SQL_RUNS) + """
SELECT window_id, coalesce(string_agg(start || ':' || length || ':' || slot, ';' ORDER BY slot)
                           FILTER (WHERE length > 0), '') AS runs FROM runs GROUP BY window_id""")
def block_mask(spark: SparkSession, sf: str):
    s = _samples(spark, sf)
    r = smp.block_runs("doc_ids")
    txt = F.array_join(F.transform(r, lambda x: F.concat_ws(":", x["start"], x["len"], x["doc"])), ";")
    return s.select("window_id", txt.alias("runs"))


@query("doc_spans", _with(*_SMP, _SQL_RUNS) + """
SELECT window_id, slot AS doc, start, CAST(length AS INTEGER) AS length, true AS has_bos, true AS has_eos
FROM runs WHERE length > 0""")
def doc_spans_q(spark: SparkSession, sf: str):
    return smp.doc_spans(_samples(spark, sf), BOS, EOS)


_SQL_SHUF = f"""
shuf AS (SELECT window_id, row_number() OVER (ORDER BY {sql_hash(0, "'0'", 'window_id')}, window_id) - 1 AS "order"
         FROM (SELECT DISTINCT window_id FROM pw))"""


def _shuffled(spark, sf, epoch: int = 0):
    ids = _windows(spark, sf).select("window_id").distinct()
    return smp.shuffle_windows(ids, seed=0, epoch=epoch)


@query("shuffle_windows", _with(_sql_pack(_SQL_DOCN), _SQL_SHUF) + ' SELECT window_id, "order" FROM shuf')
def shuffle_windows_q(spark: SparkSession, sf: str):
    return _shuffled(spark, sf).select("window_id", "order")


@query("assign_batches", _with(_sql_pack(_SQL_DOCN), _SQL_SHUF) + f"""
SELECT window_id, "order" // {BATCH} AS batch_id FROM shuf""")
def assign_batches_q(spark: SparkSession, sf: str):
    return smp.assign_batches(_shuffled(spark, sf), BATCH).select("window_id", "batch_id")


@query("assign_batches_drop_last", _with(_sql_pack(_SQL_DOCN), _SQL_SHUF) + f"""
SELECT window_id, "order" // {BATCH} AS batch_id FROM shuf
WHERE "order" < ((SELECT count(*) FROM shuf) // {BATCH}) * {BATCH}""")
def assign_batches_drop_last(spark: SparkSession, sf: str):
    return smp.assign_batches(_shuffled(spark, sf), BATCH, drop_last=True).select("window_id", "batch_id")


@query("pad_last_batch", _with(_sql_pack(_SQL_DOCN), _SQL_SHUF) + f"""
, b AS (SELECT "order" // {BATCH} AS batch_id FROM shuf)
SELECT batch_id, count(*) AS samples, 0 AS padding FROM b GROUP BY batch_id
HAVING count(*) = {BATCH}
UNION ALL
SELECT batch_id, {BATCH}, {BATCH} - count(*) FROM b GROUP BY batch_id HAVING count(*) < {BATCH}""")
def pad_last_batch_q(spark: SparkSession, sf: str):
    sh = smp.assign_batches(_shuffled(spark, sf), BATCH)
    padded = smp.pad_last_batch(sh, C, BATCH, PAD)
    return padded.groupBy("batch_id").agg(F.count(F.lit(1)).alias("samples"),
                                          F.count(F.when(F.col("is_padding"), 1)).alias("padding"))


@query("token_budget", _with(_sql_pack(_SQL_DOCN)) + f"""
, ids AS (SELECT DISTINCT window_id FROM pw),
p AS (SELECT n, a, (n + a - 1) // a AS b, (n + {BATCH} - 1) // {BATCH} AS nb
      FROM (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS a FROM ids)),
walk AS (
  SELECT epoch, window_id, window_id // b AS l, window_id % b AS r, 0 AS i
  FROM ids, p, (SELECT unnest(range(2)) AS epoch) ep
  UNION ALL
  SELECT epoch, window_id,
         CASE WHEN i < 6 AND i % 2 = 0 THEN (l + h) % a ELSE l END, CASE WHEN i % 2 = 1 THEN (r + h) % b ELSE r END,
         CASE WHEN i < 6 THEN i + 1 ELSE 0 END
  FROM (SELECT w.*, p.*, CAST('0x' || substr(md5(concat_ws(':', '0', epoch, i, CASE WHEN i % 2 = 0 THEN r ELSE l END)), 1, 8)
                              AS BIGINT) AS h FROM walk w, p) WHERE NOT (i = 6 AND l * b + r < n)),
e AS (SELECT epoch, window_id, l * b + r AS o FROM walk, p WHERE i = 6 AND l * b + r < n)
SELECT epoch, window_id, epoch * nb + o // {BATCH} AS batch_global,
       (epoch * nb + o // {BATCH}) * {BATCH * C} AS tokens_before
FROM e, p WHERE (epoch * nb + o // {BATCH}) * {BATCH * C} < 1000000""")
def token_budget_q(spark: SparkSession, sf: str):
    ids = _windows(spark, sf).select("window_id").distinct()
    out = smp.token_budget(ids, C, BATCH, max_tokens=1_000_000, epochs=2, seed=0)
    return out.select(F.col("epoch").cast("long"), "window_id", F.col("batch_global").cast("long"),
                      F.col("tokens_before").cast("long"))


@query("tokens_seen", _with(*_SMP, _SQL_SHUF) + f"""
, pb AS (SELECT "order" // {BATCH} AS batch_id, sum(n_real) AS real FROM padded JOIN shuf USING (window_id)
         GROUP BY 1)
SELECT batch_id, CAST(sum({BATCH * C}) OVER (ORDER BY batch_id) AS BIGINT) AS tokens_seen,
       CAST(sum(real) OVER (ORDER BY batch_id) AS BIGINT) AS real_tokens_seen FROM pb""")
def tokens_seen_q(spark: SparkSession, sf: str):
    s = _samples(spark, sf).select("window_id", "n_real")
    b = smp.assign_batches(_shuffled(spark, sf), BATCH).join(s, "window_id")
    return smp.tokens_seen(b, C, BATCH).select("batch_id", F.col("tokens_seen").cast("long"),
                                               F.col("real_tokens_seen").cast("long"))


# --- subword training and encoding (vocabularies are checked against the library in tests) --
SUBWORD_VOCAB = 32_768  # the size that tokenizer recipes ask for


def _bpe(spark: SparkSession, sf: str, kind: str = "bpe"):
    counts = word_counts(table(spark, sf, "documents"), normalizer="nfc")
    return train_subword(counts, SUBWORD_VOCAB, min_frequency=2, special_tokens=SPECIALS, kind=kind, normalizer="nfc")


@query("train_bpe")
def train_bpe(spark: SparkSession, sf: str):
    return _bpe(spark, sf).vocab_df(spark)


@query("train_wordpiece")
def train_wordpiece(spark: SparkSession, sf: str):
    return _bpe(spark, sf, "wordpiece").vocab_df(spark)


@query("train_unigram")
def train_unigram_q(spark: SparkSession, sf: str):
    from ..operators.vocab import train_unigram
    m = train_unigram(word_counts(table(spark, sf, "documents"), normalizer="nfc"), SUBWORD_VOCAB,
                      special_tokens=SPECIALS, normalizer="nfc")
    return spark.createDataFrame(list(zip(m.tokens, range(len(m.tokens)), [float(x) for x in m.scores])),
                                 "token string, id long, score double")


# The ids' tokens, joined, are the normalised pre-tokens, joined: every character is in the alphabet.
SQL_DECODED = f"""SELECT doc_id, array_to_string(regexp_extract_all(nfc_normalize(text), '{SQL_WHITESPACE}'), '')
       || '<|endoftext|>' AS decoded FROM documents"""


def decoded(encoded, model, spark: SparkSession):
    rows = encoded.select(F.col("doc_id").alias("row_id"), "ids")
    return enc.decode_ids(rows, model.vocab_df(spark), "ids", ["row_id"], clean=False).select(
        F.col("row_id").alias("doc_id"), F.col("text").alias("decoded"))


@query("encode_corpus", SQL_DECODED)
def encode_corpus(spark: SparkSession, sf: str):
    """Every document encoded with a saved and reloaded model, and decoded again."""
    path = scratch_path(spark, "bpe-model")
    _bpe(spark, sf).save(spark, path)
    model = SubwordModel.load(spark, path)
    return decoded(enc.encode_subword(table(spark, sf, "documents"), model, ["doc_id"], eos_id=EOS), model, spark)


@query("token_samples")
def token_samples(spark: SparkSession, sf: str):
    """Sample tokenization report: the first 5 non-blank texts, their first tokens and ids."""
    model = _bpe(spark, sf)
    d = table(spark, sf, "documents")
    first = d.where(F.regexp_replace("text", r"(?U)^\s+|\s+$", "") != "").orderBy("doc_id").limit(5)
    e = enc.encode_subword(first, model, ["doc_id"])
    v = model.vocab_df(spark)
    dec = enc.decode_ids(e.select(F.col("doc_id").alias("row_id"), F.slice("ids", 1, 20).alias("ids")), v,
                         "ids", ["row_id"], clean=False)
    return (e.join(first.select("doc_id", preview("text", 100).alias("text")), "doc_id")
            .join(dec.select(F.col("row_id").alias("doc_id"), F.col("text").alias("first_tokens")), "doc_id")
            .select("doc_id", "text", "n_tokens", F.slice("ids", 1, 20).alias("first_ids"), "first_tokens"))


