"""Fixtures and brute-force versions shared by the tests of the subpackage."""

from __future__ import annotations

import re

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
# Extra columns whose names clash with those that operators use inside.
SCHEMA = "doc_id long, text string, source string, row long, key string, n int, spans string, uid int, line string"


def documents(spark, rows):
    """Documents of (doc_id, text[, source]) with extra, clashing columns."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else f"s{i % 7}", 1, "k", 2, "x", 3, "y") for i, r in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def prose(seed: int, n: int, words: int = 400) -> str:
    import random
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(words)}" for _ in range(n))


def nasty():
    """Nulls, empty and blank texts, repeated rows, a long text, odd characters."""
    base = prose(1, 300)
    return [
        (1, base), (2, base), (2, base), (3, base.replace("w7 ", "q ")), (4, None), (5, ""), (6, "  \n\t "), (None, base),
        (None, None), (7, "short text"), (8, "short text"), (9, prose(2, 20_000)), (10, "Ünïcode ＡＢＣ ١٢٣ ​ x" * 20),
        (11, "a" * 3000), (12, "one two three four five"), (13, "ONE two\tthree\nfour five"), (14, prose(3, 300)),
        (15, prose(3, 300) + " " + prose(4, 120)), (16, "x\x00y \x1f z"), (17, prose(3, 300)[40:]),
    ]


def shingles(text, k=5):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def unite(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]
