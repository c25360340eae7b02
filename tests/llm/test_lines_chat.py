import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, lines
from tessera.llm.queries import QUERIES

from .helpers import documents, nasty, prose


def brute(rows, min_sites):
    sites = {}
    for _, text, site in rows:
        for x in (text or "").split("\n"):
            if x.strip(" \t\r") and site is not None:
                sites.setdefault(x.strip(" \t\r"), set()).add(site)
    out = []
    for key, text, _ in rows:
        parts = text.split("\n") if text is not None else []
        bad = [len(sites.get(x.strip(" \t\r"), ())) >= min_sites for x in parts]
        if not any(x.strip(" \t\r") and not b for x, b in zip(parts, bad)):
            bad = [False] * len(parts)  # a copy as a whole
        kept = None if text is None else "\n".join(x for x, b in zip(parts, bad) if not b)
        out.append((key, kept, len(parts), sum(bad)))
    return sorted(out, key=str)


def sample():
    rows = [(k, t, f"s{i % 9}") for i, (k, t) in enumerate(nasty())]
    menu = "Home | News | Contact"
    for i in range(60):
        rows.append((100 + i, f"{prose(i, 30)}\n {menu}\t\n{prose(500 + i % 4, 6)}\n\n{prose(900 + i, 12)}", f"s{i % 9}"))
    rows += [(200 + i, f"{prose(40, 8)}\n{prose(300 + i, 20)}", f"t{i}") for i in range(4)]  # 4 sites: stays
    rows += [(210 + i, f"{prose(41, 8)}\n{prose(310 + i, 20)}", f"t{i}") for i in range(5)]  # 5 sites: goes
    rows += [(220 + i, f"{prose(42, 8)}\n{prose(320 + i, 20)}", None) for i in range(9)]  # no sites
    return rows + [rows[40], rows[40], (300, menu, "s1"), (301, "a\r\nb", "s2"), (302, "\n\n", "s3")]


def run(spark, rows, **kw):
    got = lines.remove_boilerplate(documents(spark, rows), **kw).collect()
    return sorted([(r.doc_id, r.text, r.n_lines, r.n_removed) for r in got], key=str)


def test_lines_match_brute_force(spark):
    rows = sample()
    assert run(spark, rows) == brute(rows, 5)
    assert run(spark, rows, min_sites=9) == brute(rows, 9)


def test_lines_on_very_many_sites(spark):
    rows = [(i, f"{prose(1, 5)}\n{prose(10 + i, 30)}", f"site{i}") for i in range(400)]
    assert run(spark, rows, min_sites=100) == brute(rows, 100)
    assert run(spark, rows, min_sites=401) == brute(rows, 401)


def test_lines_empty_table_and_columns(spark):
    docs = documents(spark, [])
    out = lines.remove_boilerplate(docs)
    assert out.count() == 0 and out.columns == [*docs.columns, "n_lines", "n_removed"]


def test_mostly_boilerplate_goes_and_whole_copies_stay(spark):
    menu, foot = "Home News Contact and more " * 20, "All rights reserved"
    rows = [(i, f"{menu}\n{foot}\nown {i}", f"s{i}") for i in range(6)] + [(10 + i, f"{menu}\n{foot}\n", f"s{i}") for i in range(6)]
    got = {r[0]: r[1:] for r in run(spark, rows)}
    assert got[3] == ("own 3", 3, 2) and got[12] == (f"{menu}\n{foot}\n", 3, 0)


def test_lines_keep_columns_of_any_name(spark):
    rows = [(i, f"menu\nown {i}", f"s{i}", "a", "b", i, [i], "d", "e") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, row__ string, `cut.x` string, cut__ int, "
                                       "parts array<int>, others string, ROW string")
    got = sorted(tuple(r) for r in lines.remove_boilerplate(docs).collect())
    assert got == [(r[0], f"own {r[0]}", *r[2:], 2, 1) for r in rows]
    with pytest.raises(ValueError, match="n_removed"):
        lines.remove_boilerplate(docs.withColumn("N_removed", F.lit(1)))


def conversation(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pair_id int, side int")


def test_preferences(spark):
    rows = [
        (0, 0, "user", "hi", 1, 1), (0, 1, "assistant", "yes", 1, 1), (0, 2, "user", "why", 1, 1),
        (0, 3, "assistant", "so", 1, 1),
        (1, 1, "assistant", "yes", 1, 1), (1, 0, "user", "hi", 1, 1), (1, 2, "user", "how", 1, 1),
        (2, 0, "user", "same", 1, 1), (3, 0, "user", "same", 1, 1),
        (4, 0, None, None, 1, 1), (4, None, "user", "a<|im_end|>", 1, 1), (None, 0, "user", "x", 1, 1),
        (6, 0, "user", "twice", 1, 1), (6, 0, "user", "twice", 1, 1), (7, 0, "user", "twice", 1, 1),
    ]
    pairs = spark.createDataFrame([(0, 0, 1), (1, 2, 3), (2, 4, 5), (3, 6, 7), (4, 90, 91)],
                                  "pair_id long, chosen_id long, rejected_id long")
    got = {r.pair_id: r for r in chat.format_preferences(conversation(spark, rows), pairs).collect()}
    assert sorted(got) == [0, 1, 2, 3]
    r = got[0]
    assert (r.n_common, r.n_chosen, r.n_rejected) == (2, 4, 3)
    assert r.prompt == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n"
    assert r.chosen == "<|im_start|>user\nwhy<|im_end|>\n<|im_start|>assistant\nso<|im_end|>\n"
    assert r.rejected == "<|im_start|>user\nhow<|im_end|>\n"
    at, trained = 0, ""
    for run in r.chosen_mask:
        trained += r.chosen[at:at + run.length] if run.trained else ""
        at += run.length
    assert at == len(r.chosen) and trained == "so<|im_end|>"
    assert got[1].n_common == 1 and got[1].chosen == "" == got[1].rejected and got[1].chosen_mask == []
    assert got[2].rejected == "" and got[2].prompt == "" and "a< |im_end|><|im_end|>" in got[2].chosen
    assert (got[3].n_common, got[3].n_chosen, got[3].n_rejected) == (1, 2, 1) and got[3].rejected == ""
    assert chat.format_preferences(conversation(spark, []), pairs).count() == 0


def test_preference_query_pairs_all_conversations(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op8_preferences"](spark, sf).toPandas()
    turns = spark.read.parquet(f"{sf}/conversations.parquet").toPandas()
    assert len(got) == (turns.conv_id // 2).nunique()
    assert (got.n_chosen + got.n_rejected).sum() == len(turns)
