import hashlib
import itertools
import random
import re
import zlib

import pytest

from tessera.llm import repair
from tessera.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, conv int, seg string, copies string, kind int, rest int"
WANTED = re.compile(r"(s?(ua)+)?")


def damage(rows):
    """Rows (conv, turn, role, text) -> {conv: rows (turn, role, text) after damage, in order}."""
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind in (0, 1) else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        kept += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0])) for c, r in out.items()}


def kinds_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]+$", "", text)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else
                   "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, kinds):
    """(cost, audit, lines) by extending, row by row, the best edits for each string of initials' state."""
    def state(initials):  # what can still follow depends on the last row alone, and on there being none
        return initials[-1:]
    best = {"": (0, "", (), "")}

    def offer(table, cost, audit, lines, initials):
        if not re.fullmatch(r"s?(ua)*u?", initials):
            return
        key = state(initials)
        if key not in table or (cost, audit) < table[key][:2]:
            table[key] = (cost, audit, lines, initials)

    def inserted(table):
        for _ in range(3):
            for cost, audit, lines, initials in list(table.values()):
                for role in ("user", "assistant"):
                    offer(table, cost + 5, audit + "I", (*lines, f"{role}:"), initials + role[0])
        return table
    for (_, role, text), kind in zip(rows, kinds):
        after = {}
        for cost, audit, lines, initials in inserted(dict(best)).values():
            offer(after, cost + 2, audit + "D", lines, initials)
            if kind in ("blank", "duplicate"):
                continue
            more = 5 if kind == "truncated" else 0
            if role:
                offer(after, cost + more, audit + "K", (*lines, f"{role}:{text}"), initials + role[0])
            for new in ("user", "assistant"):
                offer(after, cost + 1 + more, audit + "R", (*lines, f"{new}:{text}"), initials + new[0])
        best = after
    return min(x[:3] for x in inserted(dict(best)).values() if WANTED.fullmatch(x[3]))


def exhaustive(rows, kinds, inserts=3):
    """(cost, audit, lines) over all edits, with at most ``inserts`` rows inserted in one place."""
    places = [[tuple(p) for n in range(inserts + 1) for p in itertools.product(("user", "assistant"), repeat=n)]] * (len(rows) + 1)
    edits = [["D"] if k in ("blank", "duplicate") else ["D", "K", "user", "assistant"] for k in kinds]
    best = None
    for choice in itertools.product(*edits):
        for put in itertools.product(*places):
            cost, audit, lines, initials = 0, "", [], ""
            for i in range(len(rows) + 1):
                for role in put[i]:
                    cost, audit, initials = cost + 5, audit + "I", initials + role[0]
                    lines.append(f"{role}:")
                if i < len(rows):
                    _, role, text = rows[i]
                    if choice[i] == "D":
                        cost, audit = cost + 2, audit + "D"
                        continue
                    new = role if choice[i] == "K" else choice[i]
                    cost += (choice[i] != "K") + 5 * (kinds[i] == "truncated")
                    audit += "K" if choice[i] == "K" else "R"
                    initials += new[:1] or "?"
                    lines.append(f"{new}:{text}")
            if WANTED.fullmatch(initials) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, tuple(lines))
    return best


def brute(rows):
    out = {}
    for conv, kept in damage(rows).items():
        kinds = kinds_of(kept)
        turns = [t for t, _, _ in kept if t is not None]
        first = [r[:1] for _, r, _ in kept]
        cost, audit, lines = cheapest(kept, kinds)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(kinds.count(k) for k in (
            "blank", "duplicate", "truncated")), sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:])),
            cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def got(df):
    return {r[0]: tuple(r)[1:] for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost",
                                                  "audit", "repaired_sha256").collect()}


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y", 2, 3) for r in rows], SCHEMA)


def some(r, conv, n):
    roles = ["user", "assistant"] * 4 + ["system", "tool", "u", "", None]
    texts = ["a.", "b", "  ", "", None, "c!  \n", "d? e", "f?", "longer text."]
    return [(conv, r.choice([None, *range(20)]) if r.random() < .1 else i, r.choice(roles) if r.random() < .4 else
             ("user", "assistant")[i % 2], r.choice(texts) if r.random() < .5 else f"text {i}.") for i in range(n)]


@pytest.mark.parametrize("seed", range(60))
def test_search_matches_all_edits(seed):
    r = random.Random(seed)
    rows = [(t, role or "", text or " ") for _, t, role, text in some(r, 1, r.randrange(4))]
    kinds = kinds_of(rows)
    want = exhaustive(rows, kinds)
    codes, _ = repair.faults([x[1:] for x in rows])
    cost, audit, _ = repair.search([x[1][:1] for x in rows], codes)
    assert (cost, audit, tuple(repair.apply_edits([x[1:] for x in rows], audit))) == want == cheapest(rows, kinds)


def unique_turns(rows):
    """No two rows of one turn, whose order the contract leaves open."""
    return list({(c, t): (c, t, role, text) for c, t, role, text in rows}.values())


def test_repair_matches_brute_force(spark):
    r = random.Random(5)
    rows = unique_turns([x for c in range(150) for x in some(r, c, r.randrange(1, 30))])
    rows += unique_turns([(None, t, role, text) for _, t, role, text in some(r, 0, 12)])
    rows += [(900, t, "user", "same.") for t in range(40)] + [(901, None, "user", "no turn.")]
    assert got(repair.repair(repair.damaged(table(spark, rows)))) == brute(rows)


def test_long_conversations_spread_over_segments(spark, monkeypatch):
    """Segments of a few rows give the same answers."""
    import tessera.llm.repair as module
    r = random.Random(6)
    rows = unique_turns([x for c in range(6) for x in some(r, c, r.choice([3, 9, 120]))])
    rows += unique_turns([(None, t, role, text) for _, t, role, text in some(r, 0, 90)])
    cut = module._cut

    def small(batches):
        module.SEGMENT_ROWS = 5
        return cut(batches)
    monkeypatch.setattr(module, "_cut", small)
    monkeypatch.setattr(module, "TREE_BITS", 17)
    assert got(repair.repair(repair.damaged(table(spark, rows)))) == brute(rows)


def test_nulls_ties_repeats_and_empty_tables(spark):
    rows = [(1, 0, "user", "hi."), (1, 0, "user", "hi."), (1, 0, "user", "hi."), (1, 1, "assistant", "x" * 3_000_000 + "."),
            (2, None, None, None), (2, None, None, None), (3, 1, "user", "b."), (3, 1, "assistant", "a."), (3, None, "system", "s.")]
    one = got(repair.repair(repair.damaged(table(spark, rows))))
    two = got(repair.repair(repair.damaged(table(spark, rows[::-1]))))
    assert one == two and sorted(one) == [1, 2, 3]
    assert one[1] == brute(rows[:4])[1] and one[2] == brute(rows[4:6])[2]
    assert repair.repair(repair.damaged(table(spark, []))).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_matches_brute_force(spark, sf):
    path = f"/root/testdata/{sf}"
    rows = [tuple(x) for x in spark.read.parquet(f"{path}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    assert got(QUERIES["op13_conversation_repair"](spark, path)) == brute(rows)
