import random

from tessera.llm import jaccard
from tessera.llm.graph import components

from .helpers import documents, nasty, prose, shingles, unite


def brute(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j]
             and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    root = unite(len(rows), pairs)
    out = []
    for i, (key, *_) in enumerate(rows):
        keys = [rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None]
        out.append((key, len(sets[i]), min(keys) if keys else None))
    return sorted(out, key=str), root, sets


def near(seed, n=24):
    """Chains of texts that drift apart, and texts that share a passage without linking."""
    r, rows = random.Random(seed), []
    for c in range(4):
        words = prose(100 * seed + c, 60 + 40 * c).split()
        for _ in range(n // 4):
            rows.append((len(rows), " ".join(words)))
            words[r.randrange(len(words))] = f"z{r.randrange(9999)}"
    passage = prose(900 + seed, 30)
    return rows + [(len(rows) + i, passage + " " + prose(1000 * seed + i, 22)) for i in range(12)]


def test_matches_brute_force(spark):
    for rows in (nasty(), near(1), near(2)):
        got = sorted([tuple(r) for r in jaccard.group(documents(spark, rows)).collect()], key=str)
        assert got == brute(rows)[0]


def test_deduplicate_keeps_one_of_each(spark):
    rows = nasty()
    docs = documents(spark, rows)
    kept = jaccard.deduplicate(docs)
    assert kept.columns == docs.columns
    _, root, sets = brute(rows)
    want = sorted((min([rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None], default=None)
                   for i in {root[j] for j in range(len(rows)) if sets[j]}), key=str)
    want += [r[0] for r, s in zip(rows, sets) if not s]
    assert sorted([r.doc_id for r in kept.collect()], key=str) == sorted(want, key=str)


def test_columns_of_any_name_stay(spark):
    text = prose(1, 60)
    rows = [(1, text, "a", "b", 1, {"k": 1}, "x"), (2, text + " more", "c", "d", 2, {}, "y"), (3, None, "e", "f", 3, None, "z"),
            (1, text, "a", "b", 0, {"k": 1}, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row__ string, one__ string, d int, m map<string,int>, "
                                       "`a.b` string")
    for table in (docs, spark.createDataFrame(rows[::-1], docs.schema)):
        got = jaccard.deduplicate(table)
        assert got.columns == docs.columns
        out = sorted(tuple(r) for r in got.collect())
        assert len(out) == 2 and out[1] == rows[2] and out[0][0] == 1 and out[0][2:4] == ("a", "b")
        assert out[0] == (found := locals().get("found", out[0]))  # the same row in any order


def test_empty_table(spark):
    assert jaccard.group(documents(spark, [])).count() == 0
    assert jaccard.deduplicate(documents(spark, [(4, None), (5, "")])).count() == 2


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(60, 99)] + [(200, 200), (202, 201), (201, 202)]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(60, 99)} == {60} and got[100] == 60
    assert got[201] == got[202] == 201 and 200 not in got
