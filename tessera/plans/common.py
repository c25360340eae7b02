"""Shared pieces of the registered queries: table loading, derived inputs, SQL fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import pretoken_count

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """Scan-parallelism guard: a scan with fewer splits than the cluster has
    cores (a single row group) is spread round-robin before per-row work; a
    normally split scan is left alone (no shuffle)."""
    try:
        n = df.rdd.getNumPartitions()
        par = df.sparkSession.sparkContext.defaultParallelism
    except Exception:  # sessions without RDD access: leave the scan as it is
        return df
    return df.repartition(par) if n < par else df


def docs_with_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with ``n_tokens`` = whitespace pre-token count and ``doc_pos`` = ``doc_id``."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.col("doc_id").alias("doc_pos"), "text",
                    pretoken_count("text").cast("long").alias("n_tokens"))


# --- SQL fragments (DuckDB) ----------------------------------------------------------
# Classes of the pre-tokenisers for RE2, spelled out independently of the Java patterns: alphabetic characters are
# letters, letter numbers and the circled or squared letters; word characters add marks, digits, connectors, joiners.
_SQL_WORD = (r"\p{L}\p{Nl}\x{24B6}-\x{24E9}\x{1F130}-\x{1F149}\x{1F150}-\x{1F169}\x{1F170}-\x{1F189}"
             r"\p{M}\p{Nd}\p{Pc}\x{200C}\x{200D}")
_SQL_SPACE = r"\t-\r\x{85}\p{Z}"
SQL_WHITESPACE = f"[{_SQL_WORD}]+|[^{_SQL_WORD}{_SQL_SPACE}]+"
SQL_DIGITS = r"[\p{Nd}\p{Nl}\p{No}]+|[^\p{Nd}\p{Nl}\p{No}]+"
SQL_WHITESPACE_DIGITS = (r"\p{N}|[" + _SQL_WORD.replace(r"\p{Nl}", "").replace(r"\p{Nd}", "")
                         + f"]+|[^{_SQL_WORD}{_SQL_SPACE}\\p{{N}}]+")
SQL_PRETOK = f"regexp_extract_all(text, '{SQL_WHITESPACE}')"


def sql_hash(seed, *cols: str) -> str:
    parts = ", ".join(f"CAST({c} AS VARCHAR)" for c in cols)
    return f"md5(concat_ws(':', '{seed}', {parts}))"
