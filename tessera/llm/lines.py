"""Cross-site boilerplate: lines that many sites share, found by merged sketches.

A line is the text between newlines, with blanks, tabs and carriage returns
trimmed at both ends; empty lines never count.  A site is a value of the site
column (null: no site).

1. A HyperLogLog sketch of the sites of every line, keyed by a 128-bit line
   hash, is built in each task and merged by the aggregation, so a line or a
   site with a third of all rows crosses the network as small sketches.
2. Estimates farther than ``BAND`` relative errors (at least 1) from
   ``min_sites`` decide; lines nearer to it get an exact count of sites.
3. Lines on ``min_sites`` sites or more go, whatever their share of a document.
   Only a document of which nothing else would be left stays as it is: all its
   lines stand on many sites, so it is a copy as a whole.

All of it is DataFrame code in the JVM.  The numbers of the lines to cut meet
their document by a 128-bit hash of the row.

Inputs: a null text stays null and has no lines; an empty text has one empty
line.  Repeated rows are treated alike and all stay.  Very long texts are split
and joined whole.  Extra columns of any name pass through untouched, but for
``n_lines`` and ``n_removed``, which are added and therefore refused.  An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, refuse_columns, saved

MIN_SITES = 5
LOG_K = 10
BAND = 6.0


def _hash128(*columns: Column) -> Column:
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit("second"), *columns).alias("b"))


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def lines_of(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """``row`` (hash of key and text), ``at`` (from 0), ``line`` (hash), ``site`` of every line that is not blank."""
    text = F.col(text_col).cast("string")
    return (docs.select(_hash128(F.col(key_col), text).alias("row"), F.col(site_col).cast("string").alias("site"),
                        F.posexplode(F.split(text, "\n", -1)).alias("at", "line"))
            .withColumn("line", trimmed(F.col("line"))).where(F.col("line") != "")
            .select("row", "at", _hash128(F.col("line")).alias("line"), "site"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``line`` hashes that stand on ``min_sites`` sites or more."""
    sketches = lines.groupBy("line").agg(F.hll_sketch_agg("site", LOG_K).alias("sites"))
    estimate = F.hll_sketch_estimate("sites")
    slack = max(1.0, BAND * 1.04 / 2 ** (LOG_K / 2) * min_sites)
    marked = saved(sketches.select("line", estimate.alias("estimate"))
                   .where(F.col("estimate") >= min_sites - slack), "line-estimates")
    near = marked.where(F.col("estimate") <= min_sites + slack).select("line")
    exact = (lines.join(near, "line", "left_semi").groupBy("line").agg(F.count_distinct("site").alias("sites"))
             .where(F.col("sites") >= min_sites).select("line"))
    return marked.where(F.col("estimate") > min_sites + slack).select("line").unionByName(exact)


def remove_boilerplate(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", site_col: str = "source",
                       min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` without the boilerplate lines, and with ``n_lines`` (before) and ``n_removed``."""
    refuse_columns(docs, "n_lines", "n_removed")
    lines = saved(lines_of(docs, key_col, text_col, site_col), "lines")
    cuts = (lines.join(boilerplate(lines, min_sites), "line", "left_semi")
            .groupBy("row").agg(F.sort_array(F.collect_set("at")).alias("cut")))
    text = F.col(text_col).cast("string")
    # The caller's other columns go as one, and the split lines take the place of the text.
    others = [c for c in docs.columns if c != text_col]
    joined = docs.select(F.struct(*[column(c) for c in others]).alias("others"), _hash128(F.col(key_col), text).alias("row"),
                         F.split(text, "\n", -1).alias("parts")).join(cuts, "row", "left")
    own = F.size(F.filter("parts", lambda x: trimmed(x) != "")) > F.size("cut")
    joined = joined.withColumn("cut", F.when(own, F.col("cut")))
    kept = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), "cut")
    rest = F.array_join(F.transform(kept, lambda i: F.element_at("parts", i + 1)), "\n")
    clean = F.when(F.col("cut").isNull(), F.array_join("parts", "\n")).otherwise(rest)
    return joined.select(*[clean.alias(c) if c == text_col else F.col("others").getField(c).alias(c) for c in docs.columns],
                         F.coalesce(F.size("parts"), F.lit(0)).cast("long").alias("n_lines"),
                         F.coalesce(F.size("cut"), F.lit(0)).cast("long").alias("n_removed"))
