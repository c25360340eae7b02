"""Phrase collocations by relational mining of sorted occurrence relations (SETM).

Texts are lower-cased (A-Z), cut into pieces at ``. , ; : ! ?`` and line ends,
and pieces into words at blanks and tabs.  Everything is counted per language.

1. *Occurrences.*  The places of all words are numbered piece by piece, with a
   gap after each piece, so neighbours in a piece are places that follow each
   other.  Documents are dealt evenly into as many groups as there are shuffle
   partitions, whatever their contents; relations are written bucketed by group
   and sorted by place, so that later joins on them need no shuffle and one side
   no sort.
2. *Frequent groups.*  Occurrences of a phrase are first counted inside each
   group, where they lie together; one row per group and phrase is shuffled to
   add up the corpus count, so a phrase in a third of all places is a few rows.
   Those of ``min_count`` and more go back to the groups in which they occur,
   and Rk is the semi-join of the occurrences with them, written for the next
   length.
3. *Longer phrases.*  R'k is the merge join of R(k-1) with itself on adjacent
   places: two phrases of k - 1 words that overlap in k - 2.  (R1 has all words:
   a pair of which one is rare is rare itself.)

Words are compared by a 64-bit hash of language and word.  The full list of
counted words shows whether another word shares the hash of a frequent one;
then the mining starts anew with another seed, so the counts are exact.

Scores (see :func:`collocations`) are exact: decimals of 38 digits hold
``10**6 * count**2`` up to counts of 10**16, and a larger one raises.

Inputs: a null text has no words, a null language is ``und``.  Repeated rows
count as often as they occur.  Texts are read whole; a piece of any length is
only ever rows.  Other columns are not read, whatever their names.  Ties are
broken by the phrase itself.  An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import saved

MIN_COUNT = 10
LONGEST = 3
CONTAINED_PERCENT = 50
TOP = 2000
SCALE = 1_000_000
UNKNOWN_LANG = "und"
PIECE_ENDS = ".,;:!?\n\x0b\x0c\r"
CHUNK = 1 << 21
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _even_groups(spark: SparkSession, n: int) -> list[int]:
    """One group number for each of ``n`` shuffle partitions, so that hashing deals one group to each."""
    part = F.pmod(F.hash(F.col("id").cast("int")), F.lit(n))
    rows = spark.range(64 * n).groupBy(part.alias("p")).agg(F.min("id").alias("id")).collect()
    return sorted(r["id"] for r in rows)


#: Places that follow each other are stored as small differences, and words by their number in the file's dictionary.
_COMPACT = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary#place": "false",
            "parquet.dictionary.page.size": str(1 << 24)}


class _Tables:
    """Bucketed, sorted tables below the shared checkpoint folder, known to the catalog while mining runs."""

    def __init__(self, spark: SparkSession, n: int):
        self.spark, self.n, self.names = spark, n, []

    def write(self, df: DataFrame, name: str, *order: str) -> DataFrame:
        table = f"{name}_{uuid.uuid4().hex}"
        self.names.append(table)
        (df.write.bucketBy(self.n, "grp").sortBy("grp", *order).options(**_COMPACT).option("path", scratch_path(self.spark, name))
         .format("parquet").saveAsTable(table))
        return self.spark.table(table)


#: Lets joins on more keys than the bucket's use the buckets as they are, and the order in them (one file each).
_BY_BUCKET = {"spark.sql.requireAllClusterKeysForCoPartition": "false",
              "spark.sql.legacy.bucketedTableScan.outputOrdering": "true"}


@contextmanager
def _tables(spark: SparkSession, n: int) -> Iterator[_Tables]:
    """Tables for the time of the mining, which runs inside; the session is then as it was."""
    tables, before = _Tables(spark, n), {k: spark.conf.get(k) for k in _BY_BUCKET}
    for k, v in _BY_BUCKET.items():
        spark.conf.set(k, v)
    try:
        yield tables
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        for name in tables.names:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def occurrences(docs: DataFrame, groups: list[int], text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``grp``, ``place``, ``lang``, ``word`` of every word, dealt by group."""
    text = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), _UPPER, _LOWER)
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN_LANG))
    n = len(groups)
    at = F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int")
    dealt = docs.select(text.alias("text"), lang.alias("lang"), at.alias("i")).select(
        "text", "lang", F.element_at(F.array(*map(F.lit, groups)).cast("array<int>"), F.col("i") + 1).alias("grp"))
    # Piece ends become words of their own: they take a place and go, as do the empty words around a text.
    marked = F.replace(F.translate(F.concat("text", F.lit("\n")), PIECE_ENDS, "\n" * len(PIECE_ENDS)), F.lit("\n"), F.lit(" \n "))
    words = dealt.repartition(n, "grp").select("grp", "lang", F.explode(F.split(marked, "[ \t]+", -1)).alias("word"))
    placed = words.select("grp", F.monotonically_increasing_id().alias("place"), "lang", "word")
    return placed.where(~F.col("word").isin("", "\n"))


def _local_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (grp, words as numbers) -> the same with their count ``c``, added up over stretches of ``CHUNK`` rows."""
    held: list[pa.RecordBatch] = []

    def out() -> pa.RecordBatch:
        cols = [np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(held[0].num_columns)]
        order = np.lexsort(cols[::-1])
        cols = [c[order] for c in cols]
        new = np.ones(len(order), bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
        first = np.flatnonzero(new)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (*(c[first] for c in cols), np.diff(first, append=len(order)))],
                                          [*held[0].schema.names, "c"])
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= CHUNK:
            yield out()
            held = []
    if any(b.num_rows for b in held):
        yield out()


def _by_group(found: DataFrame, phrase: list[str]) -> DataFrame:
    """``grp``, the columns of ``phrase``, the corpus count ``f`` and ``one`` (true in one group of each phrase)."""
    if phrase == ["lang", "word"]:
        local = found.groupBy("grp", *phrase).agg(F.count(F.lit(1)).alias("c"))
    else:
        numbers = ", ".join(f"{c} long" for c in phrase)
        local = found.select("grp", *phrase).mapInArrow(_local_counts, f"grp int, {numbers}, c long")
    same = Window.partitionBy(*phrase)
    one = F.row_number().over(same.orderBy("grp")) == 1
    return local.select("grp", *phrase, F.sum("c").over(same).alias("f"), one.alias("one"))


def _adjacent(rows: DataFrame, words: list[str], new: str) -> DataFrame:
    """Merge join on adjacent places: each phrase with the last word of the phrase that begins one word later."""
    a = rows.select("grp", (F.col("place") + 1).alias("place"), *words)
    b = rows.select("grp", "place", F.col(words[-1]).alias(new))
    return a.join(b.hint("merge"), ["grp", "place"]).select("grp", (F.col("place") - 1).alias("place"), *words, new)


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT
         ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words (``lang``, ``word``, ``w``, ``f``; all of them), and the frequent phrases of two and three words
    (``w1``, ``w2``[, ``w3``], ``f``)."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = _even_groups(spark, n)
    often = F.col("f") >= min_count
    with _tables(spark, n) as tables:
        def kept(rows: DataFrame, frequent: DataFrame, phrase: list[str], name: str) -> DataFrame:
            """Semi-join of occurrences with the frequent phrases of their own group."""
            here = tables.write(frequent.select("grp", *phrase).repartition(n, "grp"), f"{name}_groups")
            return tables.write(rows.join(here.hint("shuffle_hash"), ["grp", *phrase], "left_semi"), name, "place")
        r0 = tables.write(occurrences(docs, groups, text_col, lang_col), "r0", "place")
        counted = saved(_by_group(r0, ["lang", "word"]), "words-by-group")
        seed = 0
        while True:
            w = F.xxhash64(F.lit(seed), "lang", "word")
            words = counted.where("one").select("lang", "word", w.alias("w"), "f")
            shared = words.groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.max("f").alias("f"))
            if shared.where((F.col("n") > 1) & often).isEmpty():
                break
            seed += 1
        pairs = _adjacent(r0.select("grp", "place", w.alias("w1")), ["w1"], "w2")
        two = saved(_by_group(pairs, ["w1", "w2"]).where(often), "pairs-by-group")
        r2 = kept(pairs, two, ["w1", "w2"], "r2")
        three = saved(_by_group(_adjacent(r2, ["w1", "w2"], "w3"), ["w1", "w2", "w3"]).where(often & F.col("one")), "triples")
    return words, two.where("one").select("w1", "w2", "f"), three.select("w1", "w2", "w3", "f")


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(SCALE * a * a / (left * right)), exactly; at most SCALE as no part is rarer than the whole."""
    def big(c: Column) -> Column:
        return c.cast("decimal(19,0)")
    top = (big(a) * big(a)).cast("decimal(38,0)") * F.lit(SCALE).cast("decimal(7,0)")
    return F.call_function("div", top.cast("decimal(38,0)"), (big(left) * big(right)).cast("decimal(38,0)")).cast("long")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT,
                 contained_percent: int = CONTAINED_PERCENT) -> DataFrame:
    """``lang``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score`` of phrases of two or three words that occur
    ``min_count`` times or more.  ``n`` is the language's words, ``l`` and ``r`` the counts of both parts at the
    cut with the lowest score (the first of equals).  A phrase goes if a longer one, frequent too, holds
    ``contained_percent`` of its occurrences or more."""
    words, pairs, triples = mine(docs, text_col, lang_col, min_count)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    often = words.where(F.col("f") >= min_count)

    def word(i: int) -> DataFrame:
        return often.select(F.col("w").alias(f"w{i}"), F.col("word").alias(f"word{i}"), F.col("f").alias(f"f{i}"),
                            *([F.col("lang")] if i == 1 else []))
    two = saved(pairs.withColumnRenamed("f", "a").join(word(1), "w1").join(word(2), "w2"), "pairs-with-words")
    first = two.select("w1", "w2", "lang", "word1", "word2", "f1", F.col("a").alias("a12"))
    second = two.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("word2").alias("word3"),
                        F.col("f2").alias("f3"), F.col("a").alias("a23"))
    three = triples.withColumnRenamed("f", "a").join(first, ["w1", "w2"]).join(second, ["w2", "w3"])
    s1, s2 = _score(F.col("a"), F.col("f1"), F.col("a23")), _score(F.col("a"), F.col("a12"), F.col("f3"))
    three = three.select("lang", F.concat_ws(" ", "word1", "word2", "word3").alias("phrase"), "a",
                         "f1", "a12", "a23", "f3", s1.alias("s1"), s2.alias("s2"))
    at_one = F.col("s1") <= F.col("s2")
    long = three.select("lang", "phrase", "a", F.when(at_one, F.col("f1")).otherwise(F.col("a12")).alias("l"),
                        F.when(at_one, F.col("a23")).otherwise(F.col("f3")).alias("r"), F.least("s1", "s2").alias("score"))
    longer = triples.select("w1", "w2", "f").unionByName(
        triples.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "f")).groupBy("w1", "w2").agg(F.max("f").alias("longer"))
    within = F.coalesce(F.lit(100) * F.col("longer") >= F.lit(contained_percent) * F.col("a"), F.lit(False))
    short = two.join(longer, ["w1", "w2"], "left").where(~within).select(
        "lang", F.concat_ws(" ", "word1", "word2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"),
        _score(F.col("a"), F.col("f1"), F.col("f2")).alias("score"))
    return short.unionByName(long).join(totals, "lang").select("lang", "phrase", "a", "l", "r", "n", "score")


def best(found: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` rows of each language with their ``rank``: by score, count, then the phrase's bytes."""
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")
