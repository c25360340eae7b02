"""Conversation structure repair by depth-first branch and bound.

A conversation is its rows in order of turn (nulls first), then of the first
characters of role and text and a hash of both.  Each row can have one fault:
blank (nothing but white space), duplicate (role and text of an earlier row),
truncated (its last other character is none of ``. ! ?``).  The repair edits
rows until the roles' initials read ``(s?(ua)+)?``: Keep (K, 0), Rerole to user
or assistant (R, 1), Delete (D, 2, the only choice for blanks and duplicates),
Insert an empty user or assistant row (I, 5); a truncated row that stays adds
5.  The cheapest edits win, equal costs go to the ASCII-least string of edits.

*Search.*  A node is (rows done, state of the role grammar).  Branches are
tried in ASCII order from an explicit stack.  Suffix lower bounds (one backward
pass: the least cost from each node on, audits aside) and the incumbent's
(cost, audit) cut branches that cannot be better.  A dominance table keeps the
best cost at which each node was reached: prefixes come in ASCII order, so a
later prefix that is not cheaper is worse and goes.  Two prefixes of equal cost
at a node differ at some edit (only inserts could follow a shared beginning,
and they cost), so what follows never turns their order.  The search ends with
an empty stack, that is with the optimum proved.

*Long conversations.*  Rows are range-partitioned and sorted by conversation
and turn, so a conversation with a third of all rows spreads over many tasks,
and are cut into segments of bounded rows and bytes.  A conversation of one
segment is repaired on the spot.  For others, each segment's least costs
between grammar states compose (:mod:`tessera.operators.compose`) into the
bounds behind every segment; each segment is searched from every entry state
with inserts placed before rows (at the end only in the last one), so no part
is a prefix of another and the least part is the part of the least audit; the
maps from entry to exit states compose to the true entries.  Earlier rows of
the same role and text are found by an aggregation over hashes.  Only the
SHA-256 of a long conversation is made in order, by one streaming pass that
holds one segment at a time: it cannot be split.

Inputs: a null role or text counts as one blank.  Rows without a conversation
id form one conversation.  Repeated rows are duplicates of each other.  Turns
that tie follow the order above.  A role that starts with none of s, u, a (an
empty one too) must be reroled or deleted.  Other columns of any name are not
read.  Very long texts are handled whole.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.compose import scan
from .common import saved

SEGMENT_ROWS = 1024
SEGMENT_BYTES = 4 << 20
TREE_BITS = 11  # up to 2,048 segments are composed in one task
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
KEEP, REROLE, DELETE, INSERT = 0, 1, 2, 5
CUT_OFF = 5  # of a truncated row that stays
NEVER = 1 << 50

# Grammar states: 0 nothing yet, 1 after s, 2 after u, 3 after a.
_TURN = (2, 2, 3, 2)  # the state after the only user/assistant row that may follow
_KEEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_NAME = {2: "user", 3: "assistant"}
_DONE = (0, NEVER, NEVER, 0)  # cost of ending in a state
_LEGAL = {"su", "ua", "au"}


class Fault:
    NONE, GONE, TRUNCATED = 0, 1, 2  # GONE: blank or duplicate


def faults(rows: Sequence[tuple[str, str]], seen: set[bytes] = frozenset()) -> tuple[list[int], list[int]]:
    """Fault of each (role, text), and how many are blank, duplicate, truncated;
    ``seen`` has the digests of rows that came earlier."""
    here, out, count = set(seen), [], [0, 0, 0]
    for role, text in rows:
        body, mark = text.rstrip(BLANKS), digest(role, text)
        kind = 0 if not body else 1 if mark in here else 2 if body[-1] not in ".!?" else None
        here.add(mark)
        if kind is not None:
            count[kind] += 1
        out.append(Fault.NONE if kind is None else Fault.TRUNCATED if kind == 2 else Fault.GONE)
    return out, count


def digest(role: str, text: str) -> bytes:
    r = role.encode()
    return hashlib.blake2b(len(r).to_bytes(8, "little") + r + text.encode(), digest_size=16).digest()


def _moves(state: int, initial: str, fault: int) -> list[tuple[str, int, int]]:
    """(edit, next state, cost) for the next row, in ASCII order of the edits."""
    moves = [("D", state, DELETE)]
    if fault != Fault.GONE:
        more = CUT_OFF if fault == Fault.TRUNCATED else 0
        if initial in _KEEP[state]:
            moves.append(("K", _KEEP[state][initial], KEEP + more))
        moves.append(("R", _TURN[state], REROLE + more))
    return moves


def _with_inserts(costs: list[int]) -> list[int]:
    """Least cost from each state when rows may be inserted first."""
    for _ in range(2):  # more than two inserts in a row only repeat a state
        costs = [min(costs[s], INSERT + costs[_TURN[s]]) for s in range(4)]
    return costs


def suffix_bounds(initials: Sequence[str], kinds: Sequence[int], after: Sequence[int], last: bool) -> list[list[int]]:
    """For each number of rows done and each state: the least cost of what is left."""
    out = [_with_inserts(list(after)) if last else list(after)]
    for initial, kind in zip(reversed(initials), reversed(kinds), strict=True):
        below = out[-1]
        out.append(_with_inserts([min(c + below[t] for _, t, c in _moves(s, initial, kind)) for s in range(4)]))
    return out[::-1]


def search(initials: Sequence[str], kinds: Sequence[int], entry: int = 0, after: Sequence[int] = _DONE,
           last: bool = True) -> tuple[int, str, int]:
    """(cost, audit, state at the end) of the best repair from grammar state ``entry``;
    ``after`` is the cost that follows each state at the end, and counts."""
    n, bound = len(initials), suffix_bounds(initials, kinds, after, last)
    reached: dict[tuple[int, int], int] = {}  # dominance: node -> cost of its best prefix so far
    best: tuple[int, str, int] | None = None
    path: list[str] = []
    stack: list[tuple[int, str, int, int, int]] = [(0, "", 0, entry, 0)]  # depth, edit, rows done, state, cost
    while stack:
        depth, edit, i, state, cost = stack.pop()
        del path[max(0, depth - 1):]
        if edit:
            path.append(edit)
        if bound[i][state] >= NEVER or cost >= reached.get((i, state), NEVER):
            continue
        # Prefixes come in ASCII order: one that can only equal the incumbent's cost has a greater audit.
        if best is not None and cost + bound[i][state] >= best[0]:
            continue
        reached[i, state] = cost
        if i == n and after[state] < NEVER and (best is None or cost + after[state] < best[0]):
            best = (cost + after[state], "".join(path), state)
        moves = [(e, i + 1, t, cost + c) for e, t, c in _moves(state, initials[i], kinds[i])] if i < n else []
        if i < n or last:
            moves.append(("I", i, _TURN[state], cost + INSERT))
        for e, j, t, c in sorted(moves, reverse=True):
            if bound[j][t] < NEVER and (best is None or c + bound[j][t] < best[0]) and c + bound[j][t] <= bound[0][entry]:
                stack.append((depth + 1, e, j, t, c))
    return best if best is not None else (NEVER, "", entry)


def apply_edits(rows: Sequence[tuple[str, str]], audit: str, state: int = 0) -> list[str]:
    """Lines ``role:text`` after the edits, from grammar state ``state``."""
    out, at = [], 0
    for edit in audit:
        if edit == "I":
            state = _TURN[state]
            out.append(f"{_NAME[state]}:")
            continue
        role, text = rows[at]
        at += 1
        if edit == "K":
            state = _KEEP[state][role[:1]]
            out.append(f"{role}:{text}")
        elif edit == "R":
            state = _TURN[state]
            out.append(f"{_NAME[state]}:{text}")
    return out


def between_states(initials: Sequence[str], kinds: Sequence[int]) -> list[int]:
    """Least costs from each state to each (16, row by row), inserts before rows only."""
    out = []
    for goal in range(4):
        after = [0 if s == goal else NEVER for s in range(4)]
        out.append(suffix_bounds(initials, kinds, after, False)[0])
    return [min(NEVER, out[t][s]) for s in range(4) for t in range(4)]


# What a stretch of rows adds up to: costs between states, then these counts.
_SUMS = ["blank", "duplicate", "truncated", "illegal"]


def summary(rows: Sequence[tuple[str, str]], turns: Sequence[int | None], kinds: Sequence[int], count: list[int],
            costs: bool) -> list[int]:
    first = [r[:1] for r, _ in rows]
    illegal = sum(a + b not in _LEGAL for a, b in zip(first, first[1:]))
    known = [t for t in turns if t is not None]
    ends = [ord(first[0] or "\0"), ord(first[-1] or "\0")] if rows else [-1, -1]
    span = [1, min(known), max(known), len(set(known))] if known else [0, 0, 0, 0]
    return (between_states(first, kinds) if costs else [0] * 16) + count + [illegal] + ends + span


def join_summaries(a: Sequence[int], b: Sequence[int]) -> list[int]:
    """Of two neighbouring stretches."""
    a, b = [int(x) for x in a], [int(x) for x in b]
    costs = [min(NEVER, min(a[4 * s + m] + b[4 * m + t] for m in range(4))) for s in range(4) for t in range(4)]
    sums = [x + y for x, y in zip(a[16:20], b[16:20])]
    if a[21] >= 0 and b[20] >= 0:
        sums[3] += chr(a[21]) + chr(b[20]) not in _LEGAL
    ends = [a[20] if a[20] >= 0 else b[20], b[21] if b[21] >= 0 else a[21]]
    if a[22] and b[22]:  # in order of turns, so only the border can hold a turn twice
        span = [1, min(a[23], b[23]), max(a[24], b[24]), a[25] + b[25] - (a[24] == b[23])]
    else:
        span = a[22:26] if a[22] else b[22:26]
    return costs + sums + ends + span


def gaps(value: Sequence[int]) -> int:
    return int(value[24] - value[23] + 1 - value[25]) if value[22] else 0


# --- rows into segments ---------------------------------------------------------------
_SEGMENT_SQL = "conv long, seg long, turns array<long>, roles array<string>, texts array<string>"
_SEGMENT = pa.schema([("conv", pa.int64()), ("seg", pa.int64()), ("turns", pa.list_(pa.int64())),
                      ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (conv, turn, role, text, copies) -> segments of one conversation each."""
    from pyspark import TaskContext
    seg = TaskContext.get().partitionId() << 32
    held: tuple | None = None
    size = 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(_SEGMENT.names, held, strict=True))], schema=_SEGMENT)
    for batch in batches:
        for conv, turn, role, text, copies in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if held is not None and (held[0] != conv or len(held[2]) + copies > SEGMENT_ROWS or size >= SEGMENT_BYTES):
                yield out()
                held = None
            if held is None:
                held, size, seg = (conv, seg, [], [], []), 0, seg + 1
            for _ in range(copies):
                held[2].append(turn)
                held[3].append(role)
                held[4].append(text)
                size += len(role) + len(text)
    if held is not None:
        yield out()


def segments(rows: DataFrame) -> DataFrame:
    """``rows``: conv, turn, role, text (no nulls in the last two), copies (0: the row is gone, but not its conversation)."""
    keyed = rows.select(
        "conv", "turn", "role", "text", "copies", F.substring("role", 1, 32).alias("r"), F.substring("text", 1, 64).alias("t"),
        F.xxhash64("role", "text").alias("h"), F.monotonically_increasing_id().alias("id"))
    order = [F.col(c).asc_nulls_first() for c in ("conv", "turn", "r", "t", "h", "id")]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return saved(placed.select("conv", "turn", "role", "text", "copies").mapInArrow(_cut, _SEGMENT_SQL), "segments")


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


_RESULT_SQL = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
               "audit string, repaired_sha256 string")
_RESULT = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ["gaps", *_SUMS, "cost"]),
                     ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations of one segment -> results."""
    for batch in batches:
        out = []
        for conv, _, turns, roles, texts in _rows(batch):
            rows = list(zip(roles, texts, strict=True))
            kinds, count = faults(rows)
            value = summary(rows, turns, kinds, count, False)
            cost, audit, _ = search([r[:1] for r in roles], kinds)
            text = "\n".join(apply_edits(rows, audit))
            out.append((conv, gaps(value), *value[16:20], cost, audit, hashlib.sha256(text.encode()).hexdigest()))
        yield pa.RecordBatch.from_pylist([dict(zip(_RESULT.names, r, strict=True)) for r in out], schema=_RESULT)


# --- conversations of several segments --------------------------------------------------
def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for conv, seg, _, roles, texts in _rows(batch):
            marks = sorted({digest(r, t) for r, t in zip(roles, texts, strict=True)})
            n = len(marks)
            yield pa.RecordBatch.from_arrays([pa.array([conv] * n, pa.int64()), pa.array([seg] * n, pa.int64()),
                                              pa.array(marks, pa.binary())], ["conv", "seg", "mark"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments with the digests seen earlier -> fault kinds and summary."""
    for batch in batches:
        out = []
        for conv, seg, turns, roles, texts, seen in _rows(batch):
            rows = list(zip(roles, texts, strict=True))
            kinds, count = faults(rows, set(seen or ()))
            out.append({"conv": conv, "seg": seg, "kinds": bytes(kinds), "value": summary(rows, turns, kinds, count, True)})
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema(
            [("conv", pa.int64()), ("seg", pa.int64()), ("kinds", pa.binary()), ("value", pa.list_(pa.int64()))]))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments with kinds and the summary of all that follows -> exit state and audit from every entry state."""
    schema = pa.schema([("conv", pa.int64()), ("seg", pa.int64()), ("exits", pa.list_(pa.int64())),
                        ("audits", pa.list_(pa.string()))])
    for batch in batches:
        out = []
        for conv, seg, roles, kinds, rest in _rows(batch):
            first, last = [r[:1] for r in roles], rest is None
            # After the last row of the conversation inserts are still possible.
            after = list(_DONE)
            if not last:
                after = _with_inserts(after)
                after = [min(rest[4 * s + t] + after[t] for t in range(4)) for s in range(4)]
            found = [search(first, list(kinds), s, [min(NEVER, x) for x in after], last) for s in range(4)]
            out.append({"conv": conv, "seg": seg, "exits": [f[2] for f in found], "audits": [f[1] for f in found]})
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments with entry state and audit -> the part's repaired text (null: no line)."""
    for batch in batches:
        out = []
        for conv, seg, roles, texts, audits, entry in _rows(batch):
            lines = apply_edits(list(zip(roles, texts, strict=True)), audits[entry], entry)
            out.append({"conv": conv, "seg": seg, "text": "\n".join(lines) if lines else None, "audit": audits[entry]})
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema(
            [("conv", pa.int64()), ("seg", pa.int64()), ("text", pa.string()), ("audit", pa.string())]))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts in order of (conv, seg) -> SHA-256 of each conversation, one part in memory at a time."""
    now, state, any_line = None, None, False
    schema = pa.schema([("conv", pa.int64()), ("sha", pa.string())])

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"conv": now[0], "sha": state.hexdigest()}], schema=schema)
    for batch in batches:
        for conv, text in _rows(batch):
            if now is None or now[0] != conv:
                if now is not None:
                    yield out()
                now, state, any_line = (conv,), hashlib.sha256(), False
            if text is not None:
                state.update((b"\n" if any_line else b"") + text.encode())
                any_line = True
    if now is not None:
        yield out()


def _chain(a: Sequence[int], b: Sequence[int]) -> list[int]:
    return [int(b[int(x)]) for x in a]


def _long(pieces: DataFrame) -> DataFrame:
    """Results for the segments of conversations that have several."""
    key = ["conv", "seg"]
    marks = saved(pieces.mapInArrow(_digests, "conv long, seg long, mark binary"), "marks")
    earliest = marks.groupBy("conv", "mark").agg(F.min("seg").alias("first"))
    same = F.col("m.conv").eqNullSafe(F.col("e.conv")) & (F.col("m.mark") == F.col("e.mark"))
    seen = (marks.alias("m").join(earliest.alias("e"), same).where("m.seg > e.first").select("m.*")
            .groupBy(*key).agg(F.collect_list("mark").alias("seen")))

    def joined(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
        """By segment; its number is unique among all conversations."""
        return left.join(right.drop("conv"), "seg", how)
    known = saved(joined(pieces, seen, "left").select("conv", "seg", "turns", "roles", "texts", "seen").mapInArrow(
        _features, "conv long, seg long, kinds binary, value array<long>"), "features")
    behind, total = scan(known, ["conv"], "seg", "value", join_summaries, reverse=True, bits=TREE_BITS)
    parts = saved(joined(joined(pieces, known.select("conv", "seg", "kinds")), behind, "left")
                  .select("conv", "seg", "roles", "kinds", "rest")
                  .mapInArrow(_parts, "conv long, seg long, exits array<long>, audits array<string>"), "parts")
    entries, _ = scan(parts, ["conv"], "seg", "exits", _chain, bits=TREE_BITS)
    entry = F.coalesce(F.element_at("rest", 1), F.lit(0))
    text = saved(joined(joined(pieces, parts), entries).select("conv", "seg", "roles", "texts", "audits", entry.alias("entry"))
                 .mapInArrow(_lines, "conv long, seg long, text string, audit string"), "repaired")
    n = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sha = (text.select("conv", "seg", "text").repartition(n, "conv").sortWithinPartitions("conv", "seg")
           .select("conv", "text").mapInArrow(_hashed, "conv long, sha string"))
    audit = text.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("seg", "audit"))).alias("a")).select(
        "conv", F.array_join("a.audit", "").alias("audit"))
    v = [F.element_at("value", i + 1) for i in range(26)]
    end = F.least(v[0], v[1] + 2 * INSERT, v[2] + INSERT, v[3])  # states at the end, with the rows inserted after it
    both = total.alias("t").join(audit.alias("a"), F.col("t.conv").eqNullSafe(F.col("a.conv"))).join(
        sha.alias("s"), F.col("t.conv").eqNullSafe(F.col("s.conv")))
    return both.select(
        F.col("t.conv").alias("conv_id"), F.when(v[22] == 1, v[24] - v[23] + 1 - v[25]).otherwise(0).cast("long").alias("gaps"),
        *[v[16 + i].alias(c) for i, c in enumerate(_SUMS)], end.alias("cost"), F.col("a.audit"),
        F.col("s.sha").alias("repaired_sha256"))


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows`` (conv, turn, role, text, copies as for :func:`segments`):
    ``conv_id``, ``gaps`` (missing turns), counts of faults, ``illegal`` (neighbouring initials that may not
    follow each other), ``cost``, ``audit``, ``repaired_sha256`` (lines ``role:text``)."""
    pieces = segments(rows)
    several = saved(pieces.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("conv"), "several")
    match = F.col("p.conv").eqNullSafe(F.col("m.conv"))
    whole = pieces.alias("p").join(several.alias("m"), match, "left_anti").mapInArrow(_whole, _RESULT_SQL)
    if several.isEmpty():
        return whole
    return whole.unionByName(_long(saved(pieces.alias("p").join(several.alias("m"), match, "left_semi"), "long")))


def damaged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text") -> DataFrame:
    """Rows for :func:`repair` with planted faults by crc32(``conv:turn``) mod 20: 0 drops the row, 1 empties
    its text, 2 removes its ``. ! ?``, 3 repeats it, 4 makes it the user's.  Nulls count as one blank."""
    rows = turns.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"),
                        *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n) for c, n in
                          ((role_col, "role"), (text_col, "text"))))
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv", "turn")))
    rows = rows.withColumn("kind", F.crc32(F.encode(name, "UTF-8")) % 20)
    text = (F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.translate("text", ".!?", ""))
            .otherwise(F.col("text")))
    return rows.select("conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                       text.alias("text"), F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))
