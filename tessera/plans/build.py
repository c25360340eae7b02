"""End-to-end jobs: corpus build (recipe -> slices -> merge -> split -> sink + stats)
and pretokenize (corpus -> token store + metadata), plus their registered queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import encode as enc
from ..operators.order import FILE_ORDER, running_sum, with_file_pos, with_group_pos, written
from ..operators.slices import SLICE_SEED, apply_sampling, merge_slices, split_blocks, split_shuffled
from ..sources.readers import read_any, read_jsonl, read_parquet, require_text, resolve_hub_ref
from ..sources.recipe import Recipe, dataset_config, tokenizer_inputs
from ..session import scratch_path
from ..errors import ValidationError
from .common import SQL_WHITESPACE, sql_hash, table
from .registry import query

#: A record's place in its file and in the corpus.  Records travel as one column, RECORD, from the scan to the
#: sink, so a field of any name comes out as it went in; only the sink's own names are refused.
FILE_POS, CORPUS_POS, RECORD = "_file_pos", "corpus_pos", "record"
#: Places of the corpus that travel together into the token store.
STRETCH = 1024


def _field(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def load_records(spark: SparkSession, sl: Recipe, mirror_root: str | None = None, slice_first: bool = False,
                 seed: int = SLICE_SEED) -> DataFrame:
    """``record`` (struct of the fields) and ``pos`` of one slice, in file order, sampled; hub references resolve
    against a mirror root."""
    if sl.local:
        df = read_any(spark, sl.local, schema=sl.schema)
    else:
        if not mirror_root:
            raise ValueError("hub slices need a mirror_root (no network client)")
        path, _ = resolve_hub_ref(sl.huggingface, mirror_root)
        df = read_parquet(spark, path, schema=sl.schema)
    place = df.metadataColumn("_metadata")
    rows = df.select(F.struct(*map(_field, df.columns)).alias(RECORD), place["file_path"].alias(FILE_ORDER[0]),
                     place["file_block_start"].alias(FILE_ORDER[1]), F.monotonically_increasing_id().alias(FILE_ORDER[2]))
    placed = with_file_pos(rows, FILE_POS)
    if sl.sampling == "sequential":  # the file position is the order: no row moves
        offset = sl.offset or 0
        stop = F.lit(True) if sl.limit is None else F.col(FILE_POS) < offset + sl.limit
        return placed.where((F.col(FILE_POS) >= offset) & stop).withColumn("pos", F.col(FILE_POS) - offset).drop(FILE_POS)
    return apply_sampling(placed, sl.sampling, [FILE_POS], [FILE_POS], sl.offset or 0, sl.limit, seed,
                          slice_first).drop(FILE_POS)


def _refuse(df: DataFrame, names: Sequence[str], why: str) -> None:
    taken = [c for c in df.columns if c.lower() in {n.lower() for n in names}]
    if taken:
        raise ValidationError(f"records have the field {', '.join(map(repr, taken))}, which {why}")


def load_slice(spark: SparkSession, sl: Recipe, mirror_root: str | None = None, slice_first: bool = False,
               seed: int = SLICE_SEED) -> DataFrame:
    """As :func:`load_records`, the fields as columns beside ``pos``."""
    rows = load_records(spark, sl, mirror_root, slice_first, seed)
    _refuse(rows.select(f"{RECORD}.*"), ["pos"], "is the place in the slice; use load_records")
    return rows.select(f"{RECORD}.*", "pos")


def describe_slice(sl: Recipe) -> str:
    """One line for logs and reports: source, sampling, range."""
    parts = [f"{sl.local or 'hub:' + sl.huggingface}", sl.sampling]
    parts += [f"{name}={value}" for name, value in (("offset", sl.offset), ("limit", sl.limit)) if value]
    return ", ".join(parts)


def build_corpus(spark: SparkSession, cfg: Recipe, out_dir: str, mirror_root: str | None = None,
                 mode: str = "overwrite") -> DataFrame:
    """Write ``<out>/<name>/split=<train|validation>/*.json`` and ``stats``; returns the stats row.

    Every field of a record is written as it was, whatever its name; fields named ``split`` or ``corpus_pos`` are
    refused.  The split counts are observed while writing (no second scan).
    """
    slices = [(s.key, load_records(spark, s, mirror_root)) for s in cfg.slices]
    merged = merge_slices(slices)
    _refuse(merged.select(f"{RECORD}.*"), ["split", CORPUS_POS], "the corpus adds itself")
    if cfg.split_strategy == "shuffle":
        split = split_shuffled(merged, ["slice_ord", "pos"], cfg.train_split, cfg.random_seed)
    else:
        split = split_blocks(merged, cfg.train_split, "pos")
    obs = Observation("split_counts")
    observed = split.observe(obs, F.count(F.lit(1)).alias("total_records"),
                             F.count(F.when(F.col("split") == "train", 1)).alias("train_records"),
                             F.count(F.when(F.col("split") == "validation", 1)).alias("validation_records"))
    target = f"{out_dir.rstrip('/')}/{cfg.name}"
    (observed.select(f"{RECORD}.*", F.col("pos").alias(CORPUS_POS), "split")
     .write.mode(mode).partitionBy("split").json(target))
    counts = obs.get
    stats = {"dataset_name": cfg.name, "dataset_key": cfg.key, **{k: int(v) for k, v in counts.items()},
             "train_split": float(cfg.train_split), "validation_split": float(cfg.validation_split),
             "num_slices": len(cfg.slices)}
    if cfg.split_strategy == "sequential":
        stats["split_strategy"] = "sequential"
    stats_df = spark.createDataFrame([stats])
    stats_df.coalesce(1).write.mode("overwrite").json(f"{target}/_stats")
    return stats_df.select("dataset_name", "dataset_key", "total_records", "train_records", "validation_records",
                           "train_split", "validation_split", F.col("num_slices").cast("int"))


def pretokenize(spark: SparkSession, corpus_dir: str, out_dir: str, encode_fn, vocab_size: int,
                tokenizer_name: str, eos_id: int | None, force: bool = False, text_field: str = "text",
                mode: str = "overwrite") -> DataFrame | None:
    """Encode both splits into a token store (Parquet, zstd) with offsets and a metadata row.

    The corpus is one that ``build_corpus`` wrote; its rows are known by their
    dense position, whatever other columns they have.  ``encode_fn(df, key)``
    returns the ``key`` columns with ``ids`` and ``n_tokens``, one row per row.
    Positions and offsets run per split.  As many rows must reach the store as
    were read.  Exists guard: when the store and its metadata are present and
    ``force`` is false nothing is done.
    """
    meta_path, store_path = f"{out_dir}/_metadata", f"{out_dir}/tokens"
    if not force and _exists(spark, f"{meta_path}/_SUCCESS") and _exists(spark, f"{store_path}/_SUCCESS"):
        return None
    docs = require_text(read_jsonl(spark, corpus_dir, f"{CORPUS_POS} long, `{text_field}` string, split string"),
                        text_field)
    read = Observation("rows_read")
    docs = docs.withColumnRenamed(text_field, "text").select(
        "split", F.coalesce(CORPUS_POS, F.raise_error(F.lit(f"record without '{CORPUS_POS}'"))).alias(CORPUS_POS), "text")
    encoded = written(encode_fn(docs.observe(read, F.count(F.lit(1)).alias("n")), ["split", CORPUS_POS]), "encoded")
    sizes = with_group_pos(encoded.select("split", CORPUS_POS, "n_tokens"), ["split"], [CORPUS_POS], "doc_pos").drop("_gp")
    sizes = running_sum(sizes, "n_tokens", "end", pos_col="doc_pos", partition_by=["split"])
    # Positions follow the places of the corpus, so each stretch of places needs only where it starts.
    stretch = F.floor(F.col(CORPUS_POS) / STRETCH).alias("_stretch")
    starts = written(sizes.groupBy("split", stretch).agg(
        F.min("doc_pos").alias("_doc"), F.min(F.col("end") - F.col("n_tokens")).alias("_token"),
        F.count(F.lit(1)).alias("_n"), F.count_distinct(CORPUS_POS).alias("_places")), "starts")
    twice = starts.agg(F.sum(F.col("_n") - F.col("_places"))).first()[0]
    if twice:
        raise ValidationError(f"{twice} of the rows read from {corpus_dir} have the place of another")
    # clustered by position: a document or a stretch of tokens lies in few files, and ids are shuffled once
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    before = Window.partitionBy("split", "_stretch").orderBy(CORPUS_POS)
    ranged = (encoded.withColumn("_stretch", stretch).join(F.broadcast(starts.drop("_n", "_places")), ["split", "_stretch"])
              .repartitionByRange(parts, "split", "_stretch"))
    end = F.col("_token") + F.sum("n_tokens").over(before.rowsBetween(Window.unboundedPreceding, 0))
    store = ranged.select("split", CORPUS_POS, "ids", "n_tokens",
                          (F.col("_doc") + F.row_number().over(before) - 1).alias("doc_pos"), end.alias("end")
                          ).withColumn("start", F.col("end") - F.col("n_tokens"))
    store.write.mode(mode).option("compression", "zstd").partitionBy("split").parquet(store_path)
    kept, had = spark.read.parquet(store_path).count(), read.get["n"]
    if kept != had:
        raise ValidationError(f"{had} rows were read from {corpus_dir}, {kept} reached the token store")
    from .tokens import token_metadata
    meta = token_metadata(spark.read.parquet(store_path), vocab_size, tokenizer_name, eos_id, "corpus", "corpus")
    token_manifest(spark, store_path).write.mode("overwrite").parquet(f"{out_dir}/_manifest")
    meta.coalesce(1).write.mode("overwrite").json(meta_path)
    return meta


def token_manifest(spark: SparkSession, store_path: str) -> DataFrame:
    """One row per file of a token store: ``split``, ``file``, and the first and last position and token in it."""
    rows = spark.read.parquet(store_path)
    return rows.groupBy("split", F.col("_metadata.file_path").alias("file")).agg(
        F.min("doc_pos").alias("first_doc"), F.max("doc_pos").alias("last_doc"),
        F.min("start").alias("first_token"), F.max("end").alias("end_token"))


def _stored(spark: SparkSession, out_dir: str, split: str, wanted: Column) -> DataFrame | None:
    files = [r["file"] for r in spark.read.parquet(f"{out_dir}/_manifest").where(
        (F.col("split") == split) & wanted).select("file").collect()]  # those that overlap what is asked for
    return spark.read.option("basePath", f"{out_dir}/tokens").parquet(*files) if files else None


def stored_document(spark: SparkSession, out_dir: str, split: str, doc_pos: int) -> DataFrame:
    """The one document at a position of a split, from the one file that has it; an unknown place is an error."""
    pos = F.lit(int(doc_pos))
    rows = _stored(spark, out_dir, split, (F.col("first_doc") <= pos) & (pos <= F.col("last_doc")))
    if rows is None:
        raise ValidationError(f"document {doc_pos} is outside the split {split!r} of the store")
    return rows.where(F.col("doc_pos") == pos)


def stored_tokens(spark: SparkSession, out_dir: str, split: str, start: int, end: int) -> DataFrame:
    """The tokens ``start`` to ``end`` (exclusive) of a split as ``doc_pos``, ``first`` (offset) and ``ids``, one row
    per document in the range, from the files that overlap it."""
    a, b = F.lit(int(start)), F.lit(int(end))
    if start < 0 or end < start:
        raise ValidationError(f"tokens {start} to {end} are no range")
    rows = _stored(spark, out_dir, split, (F.col("first_token") < b) & (a < F.col("end_token")))
    if rows is None:
        return spark.createDataFrame([], "doc_pos long, first long, ids array<int>")
    first, last = F.greatest("start", a), F.least("end", b)
    ids = F.slice("ids", (first - F.col("start") + 1).cast("int"), (last - first).cast("int"))
    return rows.where((F.col("start") < b) & (a < F.col("end"))).select("doc_pos", first.alias("first"), ids.alias("ids"))


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def train_tokenizer(spark: SparkSession, cfg, out_dir: str | None = None, samples: int = 5):
    """Tokenizer recipe -> trained vocabulary, artefact, statistics and sample report.

    Inputs: ``files`` (JSONL / JSON read with the text-field fallback, anything
    else as text lines, chosen per file) or ``dataset``/``split`` of a built corpus.
    Returns ``(model, stats_df, samples_df)``.
    """
    from ..functions.text import normalize, preview
    from ..operators.vocab import train_subword, train_unigram, vocab_stats, word_counts
    from ..sources.readers import read_text, text_fallback
    frames = []
    for path in tokenizer_inputs(cfg):
        name = path.rstrip("/").rsplit("/", 1)[-1].lower()
        if name.endswith((".jsonl", ".json")) or "." not in name:
            df = read_any(spark, path, with_file_order=True) if "." in name else read_jsonl(
                spark, path, with_file_order=True)
            df = text_fallback(df, (cfg.text_field, "content", "body"))
        else:
            df = read_text(spark, path, with_file_order=True).withColumnRenamed("value", "text")
        frames.append(df.select("text", F.lit(len(frames)).alias("_source"), *FILE_ORDER))
    texts = frames[0]
    for f in frames[1:]:
        texts = texts.unionByName(f)
    counts = word_counts(texts.select(normalize("text", cfg.normalizer).alias("text")),
                         pre_tokenizer=cfg.pre_tokenizer)
    if cfg.type == "unigram":
        model = train_unigram(counts, cfg.vocab_size, cfg.special_tokens, normalizer=cfg.normalizer,
                              pre_tokenizer=cfg.pre_tokenizer)
    else:
        model = train_subword(counts, cfg.vocab_size, cfg.min_frequency, cfg.special_tokens, kind=cfg.type,
                              normalizer=cfg.normalizer, pre_tokenizer=cfg.pre_tokenizer)
    if out_dir:
        model.save(spark, f"{out_dir.rstrip('/')}/{cfg.name}", training_config=cfg.as_dict())
    stats = vocab_stats(model.vocab_df(spark), cfg.special_tokens)
    # the first non-blank texts in file order, fixed in a written table
    first = texts.where(F.regexp_replace("text", r"(?U)^\s+|\s+$", "") != "").orderBy("_source", *FILE_ORDER).limit(samples)
    first = written(first.select("text", F.row_number().over(
        Window.orderBy("_source", *FILE_ORDER)).cast("long").alias("row_id")), "samples")
    enc_df = enc.encode_subword(first, model, ["row_id"])
    report = enc_df.join(first, "row_id").select(preview("text", 100).alias("text"), "n_tokens",
                                                 F.slice("ids", 1, 20).alias("first_ids"),
                                                 F.greatest(F.col("n_tokens") - 20, F.lit(0)).alias("more_ids"))
    return model, stats, report


# --- registered queries ---------------------------------------------------------------------
_SQL_CORPUS = f"""
WITH u AS (
  SELECT 0 AS o, row_number() OVER (ORDER BY doc_id) - 1 AS p, text FROM documents
  UNION ALL
  SELECT 1, row_number() OVER (ORDER BY {sql_hash(42, "f")}, f) - 1, text
  FROM (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS f, text FROM conversations)
  UNION ALL SELECT 2, row_number() OVER (ORDER BY item_id) - 1, text FROM benchmark),
m AS (
  SELECT o, p, text, row_number() OVER (ORDER BY o, p) - 1 AS pos, count(*) OVER () AS n FROM u),
corpus AS (
  SELECT pos, text, CASE WHEN row_number() OVER (ORDER BY {sql_hash(42, "o", "pos")}, o, pos) - 1
                              < floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'validation' END AS split FROM m)"""


def _ordered_files(df: DataFrame, order: list[str], path: str, fmt: str) -> None:
    """Files whose names and contents follow ``order``."""
    getattr(df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite"), fmt)(path)


def _mixed_corpus(spark: SparkSession, sf: str, strategy: str = "shuffle") -> tuple[str, DataFrame]:
    """A three-slice recipe over whole tables (JSONL documents, Parquet conversations
    from a hub mirror in random order, JSON-array benchmark), built end to end."""
    src = scratch_path(spark, "recipe-src")
    _ordered_files(table(spark, sf, "documents").select("doc_id", "text"), ["doc_id"], f"{src}/docs.jsonl", "json")
    _ordered_files(table(spark, sf, "conversations").select("conv_id", "turn", "text"), ["conv_id", "turn"],
                   f"{src}/mirror/chat/train", "parquet")
    b = table(spark, sf, "benchmark").select("item_id", "text")
    per_file = 5000  # JSON-array files of bounded size, in the order of the ids
    part = F.lpad(F.floor(F.col("item_id") / per_file).cast("string"), 12, "0")
    (b.groupBy(part.alias("part"))
     .agg(F.concat(F.lit("["), F.array_join(F.transform(
         F.sort_array(F.collect_list(F.struct("item_id", "text"))), lambda x: F.to_json(x)), ","), F.lit("]")).alias("value"))
     .write.mode("overwrite").partitionBy("part").text(f"{src}/bench.json"))
    cfg = dataset_config({
        "key": "mix-v1", "name": "mix", "train_split": 0.8, "validation_split": 0.2, "split_strategy": strategy,
        "slices": [{"key": "docs", "local": f"{src}/docs.jsonl", "schema": "doc_id long, text string"},
                   {"key": "chat", "huggingface": "chat", "sampling": "random"},
                   {"key": "bench", "local": f"{src}/bench.json", "schema": "item_id long, text string"}]})
    out = scratch_path(spark, "corpus-out")
    stats = build_corpus(spark, cfg, out, mirror_root=f"{src}/mirror")
    return f"{out}/mix", stats


@query("corpus_build", _SQL_CORPUS + " SELECT pos, text, split FROM corpus")
def corpus_build(spark: SparkSession, sf: str):
    """The rows that the recipe's corpus holds: place, text and split."""
    corpus, _ = _mixed_corpus(spark, sf)
    return spark.read.schema(f"{CORPUS_POS} long, text string, split string").json(corpus).select(
        F.col(CORPUS_POS).alias("pos"), "text", "split")


@query("corpus_build_sequential", _SQL_CORPUS + """
SELECT pos, text, CASE WHEN pos % 10000 < 8000 THEN 'train' ELSE 'validation' END AS split FROM corpus""")
def corpus_build_sequential(spark: SparkSession, sf: str):
    """The same corpus, split block by block in its order."""
    corpus, _ = _mixed_corpus(spark, sf, "sequential")
    return spark.read.schema(f"{CORPUS_POS} long, text string, split string").json(corpus).select(
        F.col(CORPUS_POS).alias("pos"), "text", "split")


@query("corpus_stats", _SQL_CORPUS + """
SELECT 'mix' AS dataset_name, 'mix-v1' AS dataset_key, count(*) AS total_records,
       count(*) FILTER (WHERE split = 'train') AS train_records,
       count(*) FILTER (WHERE split = 'validation') AS validation_records,
       0.8::DOUBLE AS train_split, 0.2::DOUBLE AS validation_split, 3 AS num_slices FROM corpus""")
def corpus_stats(spark: SparkSession, sf: str):
    """The statistics row that building the corpus returns."""
    return _mixed_corpus(spark, sf)[1]


@query("scan_hub_ref", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def scan_hub_ref(spark: SparkSession, sf: str):
    """``name:split`` resolved against a mirror root and scanned."""
    root = scratch_path(spark, "mirror")
    table(spark, sf, "documents").write.mode("overwrite").parquet(f"{root}/documents/train")
    path, _ = resolve_hub_ref("documents", root)
    return read_parquet(spark, path).select("doc_id", "text", "lang", "source", "n_chars")


@query("idempotent_write", "SELECT doc_id, lang FROM documents")
def idempotent_write(spark: SparkSession, sf: str):
    """Exists guard: a second write in ``ignore`` mode leaves the first output untouched."""
    path = scratch_path(spark, "guarded")
    d = table(spark, sf, "documents").select("doc_id", "lang")
    d.write.mode("overwrite").parquet(path)
    d.where("lang = 'en'").write.mode("ignore").parquet(path)
    return spark.read.parquet(path)


@query("pretokenize_corpus", _SQL_CORPUS + """
, w AS (SELECT split, pos, len(regexp_extract_all(text, '""" + SQL_WHITESPACE + """')) + 1 AS n_tokens FROM corpus)
SELECT split, row_number() OVER (PARTITION BY split ORDER BY pos) - 1 AS doc_pos,
       CAST(sum(n_tokens) OVER (PARTITION BY split ORDER BY pos) - n_tokens AS BIGINT) AS start,
       CAST(sum(n_tokens) OVER (PARTITION BY split ORDER BY pos) AS BIGINT) AS "end" FROM w""")
def pretokenize_corpus(spark: SparkSession, sf: str):
    """Recipe -> corpus without ids of its own -> word-level token store; its offsets."""
    from ..operators.vocab import rank_vocab, word_counts
    from .tokens import EOS, SPECIALS
    corpus, _ = _mixed_corpus(spark, sf)
    vocab = rank_vocab(word_counts(spark.read.schema("text string").json(corpus)), SPECIALS)
    vocab = written(vocab, "vocab")
    out = scratch_path(spark, "pretok-out")

    def encode(df: DataFrame, key: list[str]) -> DataFrame:
        return enc.encode_rank(df, vocab, key, eos_id=EOS)
    pretokenize(spark, corpus, out, encode, vocab.count(), "words", EOS)
    again = pretokenize(spark, corpus, out, encode, 0, "words", EOS)
    assert again is None  # guard: nothing redone
    return spark.read.parquet(f"{out}/tokens").select("split", "doc_pos", F.col("start").cast("long"),
                                                      F.col("end").cast("long"))
