import random
import re

from tessera.llm import decontaminate

from .helpers import LOWER, documents, nasty, prose


def words(t):
    return re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().translate(LOWER))


def brute(rows, items):
    windows = {}
    for item, t in items:
        w = words(t)
        m = min(10, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            windows.setdefault(tuple(w[i:i + m]), set()).add(item)
    out = []
    for key, t, *_ in rows:
        w, hit, found = words(t), set(), set()
        for m in {len(x) for x in windows}:
            for i in range(len(w) - m + 1):
                if tuple(w[i:i + m]) in windows:
                    hit.update(range(i, i + m))
                    found |= windows[tuple(w[i:i + m])]
        out.append((key, len(w), len(hit), sorted(found - {None})))
    return sorted(out, key=str)


def items():
    return [(1, prose(3, 300)[50:300]), (2, "Short, TEXT!"), (3, None), (4, ""), (5, "one two three four five"),
            (6, prose(2, 20_000)[5000:5200]), (None, prose(1, 300)[:90]), (7, prose(1, 300)[10:99]), (7, "unïcode"),
            (8, "w1"), (9, "a a a a a a a a a a a a")]


def run(spark, rows, bench):
    got = decontaminate.find_contamination(
        documents(spark, rows), spark.createDataFrame(bench, "item_id long, text string"))
    return sorted([(r.key, r.n_words, r.n_hit, sorted(r["items"])) for r in got.collect()], key=str)


def test_matches_brute_force(spark):
    r = random.Random(4)
    rows = nasty() + [(50 + i, prose(70 + i, 30) + " " + " ".join(prose(3, 300).split()[i:i + r.randint(8, 13)])
                       + " " + prose(90 + i, 9)) for i in range(20)] + [(99, "a " * 40)]
    assert run(spark, rows, items()) == brute(rows, items())


def test_columns_of_any_name_stay(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    rows = [(1, "x a b c d e f g h i j y", "p", 1), (2, "clean text", "q", 2), (None, None, "r", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ROW__ string, `d.e` int")
    got = decontaminate.drop_contaminated(docs, bench)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect()), key=str) == sorted(rows[1:], key=str)


def test_drop_and_empty_tables(spark):
    rows, none = nasty(), spark.createDataFrame([], "item_id long, text string")
    docs = documents(spark, rows)
    assert run(spark, rows, [(1, "")]) == brute(rows, [])
    assert decontaminate.drop_contaminated(docs, none).count() == len(rows)
    bench = spark.createDataFrame(items(), "item_id long, text string")
    kept = decontaminate.drop_contaminated(docs, bench)
    clean = [k for k, _, n_hit, _ in brute(rows, items()) if not n_hit]
    assert sorted([r.doc_id for r in kept.collect()], key=str) == sorted(clean, key=str) and kept.columns == docs.columns
    assert run(spark, [], items()) == []


def test_windows_that_choose_one_position_are_one_row(spark):
    text = prose(3, 400)
    n = len(words(text))
    rows = spark.createDataFrame([(1, text)], "key long, text string").mapInArrow(
        decontaminate._scan([], None, 10), decontaminate._FOUND_SQL).where("fp is not null")
    got = decontaminate._each_window(rows).select("start", "win").collect()
    w = [x.decode() for x in words(text)]
    assert sorted(map(tuple, got)) == [(i, " ".join(w[i:i + 10])) for i in range(n - 9)]
    assert rows.count() < (n - 9) / 2


def test_items_of_common_windows(spark):
    passage = prose(3, 40)
    bench = [(i, passage) for i in range(30)] + [(100, passage + " " + prose(5, 12)), (101, passage)]
    rows = [(i, f"{prose(200 + i, 5)} {passage} {prose(300 + i, 5)}") for i in range(40)] + [(99, prose(999, 30))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontaminate.find_contamination(docs, spark.createDataFrame(bench, "item_id long, text string"))
    assert sorted([(r.key, r.n_words, r.n_hit, sorted(r["items"])) for r in got.collect()], key=str) == brute(rows, bench)
