import numpy as np

from tessera.llm import repeats

from .helpers import documents, nasty, prose


def brute(rows, length):
    texts = [(t or "").encode() for _, t, *_ in rows]
    count = {}
    for b in texts:
        for i in range(len(b) - length + 1):
            count[b[i:i + length]] = count.get(b[i:i + length], 0) + 1
    out = []
    for (key, *_), b in zip(rows, texts):
        cut = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i:i + length]] > 1:
                cut[i:i + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], cut, [0]])))
        spans = [tuple(x) for x in edges.reshape(-1, 2).tolist()]
        out.append((key, len(b), spans, bytes(np.frombuffer(b, np.uint8)[~cut])))
    return sorted(out, key=str)


def run(spark, rows, length):
    got = repeats.remove_repeats(documents(spark, rows), length=length).collect()
    return sorted([(r.key, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in got], key=str)


def test_matches_brute_force(spark):
    rows = nasty()
    assert run(spark, rows, 400) == brute(rows, 400)


def test_short_strings_periods_and_shared_passages(spark):
    passage = prose(50, 40)
    rows = [(i, prose(60 + i, 20) + passage[i:200 + 3 * i] + prose(80 + i, 20)) for i in range(12)]
    rows += [(20, "ab" * 300), (21, "abc" * 100 + "x" + "abc" * 40), (22, "z" * 79), (23, "z" * 80), (24, "é" * 60)]
    assert run(spark, rows, 80) == brute(rows, 80)


def test_long_rows_are_read_in_pieces(spark, monkeypatch):
    body = prose(5, 6000)
    rows = [(1, body), (2, "odd start " + body[1234:30_000]), (3, prose(6, 3000) + body[9000:9400] + "!")]
    import pyarrow as pa
    for size in (1 << 22, 7001):
        monkeypatch.setattr(repeats, "PIECE", size)
        seen = {}
        for lo, hi, at, data, bounds in repeats.pieces(pa.array([r[1] for r in rows]), 400):
            for i in range(hi - lo):
                n = int(bounds[i + 1] - bounds[i]) - 399
                seen.setdefault(lo + i, []).extend(range(at, at + max(0, n)))
        assert all(sorted(seen[i]) == list(range(len(r[1]) - 399)) for i, r in enumerate(rows))
    monkeypatch.undo()
    assert run(spark, rows, 400) == brute(rows, 400)


def test_empty_table(spark):
    assert run(spark, [], 400) == []
