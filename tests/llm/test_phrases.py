import os
import random
import re
from collections import Counter

from tessera.llm import phrases

from .helpers import LOWER


def brute(rows, min_count=10, contained=50, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").encode().translate(LOWER).decode()):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i:i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    common = {p: a for p, a in f.items() if a >= min_count and len(p) > 2}
    inside = {p for q, a in common.items() if len(q) == 4 for p in ((q[0], *q[1:3]), (q[0], *q[2:4]))
              if 100 * a >= contained * f[p]}
    out = {}
    for p, a in common.items():
        if p in inside:
            continue
        cuts = []
        for k in range(1, len(p) - 1):
            left, right = f[p[:k + 1]], f[(p[0], *p[k + 1:])]
            cuts.append((1_000_000 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.setdefault(p[0], []).append((-score, -a, " ".join(p[1:]).encode(), left, right))
    return sorted((lang, i + 1, ph.decode(), -a, left, right, n[lang], -s) for lang, found in out.items()
                  for i, (s, a, ph, left, right) in enumerate(sorted(found)[:top]))


def table(spark, rows):
    return spark.createDataFrame([(i, t, la, "g", 1, 2, "w", 3) for i, (la, t) in enumerate(rows)],
                                 "doc_id long, text string, lang string, grp string, piece int, pos int, word string, f int")


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def corpus(seed, n=120):
    r = random.Random(seed)
    words = ["The", "the", "new", "york", "times", "é", "Éa", "日本", "x.y", "a,b", "of", "to", "ÄB"] + [f"w{i}" for i in range(25)]
    ends = [" ", "  ", "\t", ". ", ", ", "; ", "\n", "! ", "? ", ":", "\r\n", " ", " \x0b"]
    rows = []
    for _ in range(n):
        out = []
        for _ in range(r.randrange(60)):
            out.append("new york times" if r.random() < .1 else r.choice(words))
            out.append(" " if r.random() < .7 else r.choice(ends))
        rows.append((r.choice(["en", "en", "de", None, "und", ""]), "".join(out)))
    return rows


def test_phrases_match_brute_force(spark):
    for seed, least in ((1, 10), (2, 3), (3, 2)):
        rows = corpus(seed) + [("en", None), (None, None), ("fr", ""), ("en", " .,\n "), ("xx", "one two")]
        assert got(phrases.best(phrases.collocations(table(spark, rows), min_count=least))) == brute(rows, least)


def test_repeats_ties_and_long_texts(spark):
    rows = [("en", "a b c a b c")] * 40 + [("en", "tie one. tie two. one tie. two tie")] * 10
    rows += [("de", "lang satz ohne ende " * 20_000), ("es", "aa " * 500), ("es", "AA aa aa, aA")]
    assert got(phrases.best(phrases.collocations(table(spark, rows)))) == brute(rows)
    assert got(phrases.best(phrases.collocations(table(spark, rows)), 2)) == brute(rows, top=2)


def test_empty_table(spark):
    assert phrases.best(phrases.collocations(table(spark, []))).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    rows = [(10**14 + 7, 3 * 10**14 + 1, 10**15 + 9), (10**15, 10**15, 10**15), (5, 7, 11), (99_999_999_999, 10**12 + 3, 10**13 + 1)]
    df = spark.createDataFrame(rows, "a long, l long, r long")
    from pyspark.sql import functions as F
    out = df.select("a", "l", "r", phrases._score(F.col("a"), F.col("l"), F.col("r")).alias("s")).collect()
    assert all(x.s == 1_000_000 * x.a * x.a // (x.l * x.r) for x in out)


def test_words_that_share_a_hash_are_told_apart(spark, monkeypatch):
    """With a hash of few values the mining starts anew until frequent words stand alone."""
    from pyspark.sql import functions as F
    real, seeds = F.xxhash64, []

    def few(seed, *cols):
        seeds.append(1)
        return F.pmod(real(seed, *cols), F.lit(64 if len(seeds) < 2 else 1 << 40))
    monkeypatch.setattr(phrases.F, "xxhash64", few)
    rows = corpus(4)
    out = phrases.best(phrases.collocations(table(spark, rows), min_count=5))
    monkeypatch.undo()
    assert len(seeds) > 1 and got(out) == brute(rows, 5)


def test_occurrence_joins_do_not_shuffle(spark):
    """Joins of bucketed relations add no exchange below the join."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = phrases._even_groups(spark, n)
    assert len(groups) == n
    with phrases._tables(spark, n) as tables:
        r0 = tables.write(phrases.occurrences(table(spark, corpus(5)), groups), "r0", "place")
        r1 = r0.select("grp", "place", phrases.F.xxhash64("word").alias("w1"))
        plan = phrases._by_group(phrases._adjacent(r1, ["w1"], "w2"), ["w1", "w2"])._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan =="):]
    below = physical[physical.index("SortMergeJoin"):]
    assert "Exchange" not in below and below.count("- Sort [") == 1, physical


def test_places_are_stored_compactly(spark):
    """A place takes a fraction of its eight bytes: the words' numbers are most of the file."""
    r, n = random.Random(6), 2
    rows = [("en", " ".join(f"w{r.randrange(1000)}" for _ in range(4_000))) for _ in range(100)]
    groups = phrases._even_groups(spark, n)
    with phrases._tables(spark, n) as tables:
        r0 = tables.write(phrases.occurrences(table(spark, rows), groups), "r0", "place")
        size = sum(os.path.getsize(f.removeprefix("file:")) for f in r0.inputFiles())
        assert r0.count() == 400_000 and size < 400_000 * 2.5, size
