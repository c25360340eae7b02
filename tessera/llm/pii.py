"""Personal data with offsets, plain and disguised.

Plain detectors (leftmost, non-overlapping, per kind) run on the text as it is:
email, ip (parts at most 255), card (12 to 19 digits, Luhn) and phone (9 to 15
digits).  A match that fails its test is dropped without another try.

Deobfuscation is a chain of transducers.  Each rewrites the text and carries,
for every character it writes, the source range that the character stands for:

1. characters: invisible characters vanish; look-alikes of ASCII (full-width
   and other compatibility forms, decimal digits of any script, Cyrillic and
   Greek homoglyphs; O, I, l between digits) become it;
2. digits: spelled digits in a row of at least three digits become digits, the
   blanks, hyphens and commas between them vanish ("double"/"triple" repeat);
3. words: "at" and "dot" in brackets, or between blanks where the rest of an
   address in words follows, become @ and a full stop; so does "at" before a
   plain domain if the word before it is no ordinary prose; "plus" before a
   digit becomes +;
   then step 2 once more.

The plain detectors run on the rewritten text, and their spans map back to the
source.  A span that neither equals nor lies in a plain span of its kind joins
the result; plain spans always stay.  Texts in which no transducer changes
anything skip this part.

Inputs: null and empty texts have no spans.  Repeated rows each give a row.
Every detector and transducer is linear in the text's length.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import key_text

#: Kinds in the order in which ties are listed.
KINDS = ("email", "ip", "card", "phone")

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A start inside a run of digits cannot match where the run's start did not.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int, str]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Like searching the pattern, but from the @ outwards: linear on long runs."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            end = domain.end()
        at = text.find("@", max(at + 1, end))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def detect(text: str) -> list[Span]:
    """(start, end, kind) of all plain matches, by start and kind."""
    found: list[Span] = []
    if "@" in text:
        found += [(a, b, "email") for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m.group().split(".")):
            found.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        d = _digits(m.group())
        if 12 <= len(d) <= 19 and luhn(d):
            found.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


#: Homoglyphs of ASCII letters (fixed values): Cyrillic, Greek.
_HOMOGLYPHS = dict(zip("АВЕЅІЈКМНОРСТУХаеѕіјорсухѵԁԛԝһ", "ABESIJKMHOPCTYXaesijopcyxvdqwh")) | dict(
    zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοιναρκ", "ABEZHIKMNOPTYXoivapk"))
#: Letters that stand for a digit between two digits (fixed values).
_BETWEEN_DIGITS = {"O": "0", "o": "0", "I": "1", "l": "1", "З": "3"}
_BETWEEN = re.compile("(?<=[0-9])[OoIlЗ](?=-?[0-9])")
_BETWEEN_HINT = re.compile("[0-9][OoIlЗ]")
_INVISIBLE = "­​‌‍‎‏⁠⁡⁢⁣⁤﻿"


def _character_map() -> dict[str, str]:
    """Look-alikes from rules: decimal digits, compatibility forms, homoglyphs."""
    table = dict(_HOMOGLYPHS) | dict.fromkeys(_INVISIBLE, "")
    for code in range(0x80, 0x20000):
        c = chr(code)
        if c in table or 0xD800 <= code < 0xE000:
            continue
        digit = unicodedata.decimal(c, None)
        if digit is not None:
            table[c] = str(digit)
            continue
        form = unicodedata.normalize("NFKC", c)
        if len(form) == 1 and "!" <= form <= "~" and unicodedata.category(c) not in ("No", "Lm", "Lo"):
            table[c] = form
    return table | {"‐": "-", "‑": "-", "‒": "-", "–": "-", " ": " ", " ": " "}


_DIGIT_WORDS = dict(zip("zero one two three four five six seven eight nine".split(), "0123456789")) | {"oh": "0"}
_ANY = "|".join(_DIGIT_WORDS)
_SEP = r"[\x20,-]{1,2}"
# A row of single digits, spelled or not, with at least one spelled; runs of figures also join.
_ITEM = rf"(?:(?:double|triple)\x20)?(?:{_ANY})\b|[0-9]+(?![A-Za-z])"
_ROW = re.compile(rf"(?<![A-Za-z0-9])(?:{_ITEM})(?:{_SEP}(?:{_ITEM}))+", re.I)
_ITEMS = re.compile(_ITEM, re.I)
_SPELLED = re.compile(rf"\b(?:{_ANY})\b", re.I)
_WORDS = re.compile(
    r"\s*[\[({<]\s*(?P<bat>at|@)\s*[\])}>]\s*"
    r"|\s*[\[({<]\s*(?P<bdot>dot|\.)\s*[\])}>]\s*"
    r"|(?<=[A-Za-z0-9])\x20+(?P<at>at|@)\x20+(?=[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*(?:\x20+dot\x20+|\s*[\[({<]\s*(?:dot|\.))[A-Za-z0-9])"
    r"|(?<=[A-Za-z0-9])\x20+(?P<sign>@)\x20+(?=[A-Za-z0-9-]+\.[A-Za-z0-9])"
    r"|(?<=[A-Za-z0-9])\x20+(?P<half>at)\x20+(?=[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z])"
    r"|(?<=[A-Za-z0-9])\x20+(?P<dot>dot)\x20+(?=[A-Za-z0-9])"
    r"|\bplus\x20+(?=[0-9])",
    re.I)
# Searched in lower-cased texts: without a hit the step changes nothing.
_HINT = re.compile(r"[\[({<]\s*(?:at|@|dot|\.)\s*[\])}>]|\x20@\x20|\x20dot\x20|\bplus\x20"
                   r"|\x20at\x20+[a-z0-9-]+\.[a-z0-9]")
# A name before "at example.com": one with a letter and a mark that prose has not, or any after these words.
_MARKED = re.compile(r"(?=.*[A-Za-z]).*[0-9._+-]")
_ASKED = re.compile(r"\b(?:e-?mail(?:\x20+to)?|mail(?:\x20+to)?|contact|write\x20+to)[\x20:]+$", re.I)
_NO_NAMES = frozenset("me us him her them you it address addresses details form list page sent server".split())
_SPELLED_HINT = re.compile(rf"\b(?:{_ANY})[\x20,.-]{{1,2}}(?:{_ANY}|double|triple|[0-9])"
                           rf"|[0-9][\x20,.-]{{1,2}}(?:{_ANY}|double|triple)\b")


class Mapped:
    """A rewritten text; character i stands for source[start[i]:stop[i]]."""

    def __init__(self, text: str, start: list[int] | None = None, stop: list[int] | None = None):
        self.text = text
        self.start = list(range(len(text))) if start is None else start
        self.stop = list(range(1, len(text) + 1)) if stop is None else stop

    def rewrite(self, edits: list[tuple[int, int, str, list[tuple[int, int]]]]) -> Mapped:
        """Replace [a, b) by a string whose characters come from the given ranges of the present text."""
        text, start, stop, at = [], [], [], 0
        for a, b, new, ranges in edits:
            text += [self.text[at:a], new]
            start += self.start[at:a] + [self.start[x] for x, _ in ranges]
            stop += self.stop[at:a] + [self.stop[y - 1] for _, y in ranges]
            at = b
        text.append(self.text[at:])
        return Mapped("".join(text), start + self.start[at:], stop + self.stop[at:])


class Deobfuscator:
    """The chain of transducers; built once in each task."""

    def __init__(self) -> None:
        self.map = _character_map()
        self.odd = frozenset(self.map)

    def characters(self, t: Mapped) -> Mapped:
        if t.text.isascii():
            return t
        odd = self.odd.intersection(t.text)
        if not odd:
            return t
        found = re.finditer("[" + "".join(map(re.escape, sorted(odd))) + "]", t.text)
        return t.rewrite([(m.start(), m.end(), self.map[m.group()], [m.span()] if self.map[m.group()] else [])
                          for m in found])

    def between(self, t: Mapped) -> Mapped:
        if not _BETWEEN_HINT.search(t.text):
            return t
        edits = [(m.start(), m.end(), _BETWEEN_DIGITS[m.group()], [m.span()]) for m in _BETWEEN.finditer(t.text)]
        return t.rewrite(edits) if edits else t

    def words(self, t: Mapped) -> Mapped:
        if not _HINT.search(t.text.lower()):
            return t
        edits = []
        for m in _WORDS.finditer(t.text):
            if m["half"] and not _named(t.text, m.start()):
                continue
            new = "@" if m["bat"] or m["at"] or m["sign"] or m["half"] else "." if m["bdot"] or m["dot"] else "+"
            edits.append((m.start(), m.end(), new, [m.span()]))
        return t.rewrite(edits) if edits else t

    def digits(self, t: Mapped) -> Mapped:
        if not _SPELLED_HINT.search(t.text.lower()):
            return t
        edits = []
        for row in _ROW.finditer(t.text):
            new, ranges, spelled = [], [], False
            for m in _ITEMS.finditer(t.text, row.start(), row.end()):
                word = m.group().lower().split()
                if word[-1] in _DIGIT_WORDS:
                    spelled = True
                    times = {"double": 2, "triple": 3}.get(word[0], 1)
                    new.append(_DIGIT_WORDS[word[-1]] * times)
                    ranges += [m.span()] * times
                else:
                    new.append(m.group())
                    ranges += [(i, i + 1) for i in range(m.start(), m.end())]
            if spelled and len(ranges) >= 3:
                edits.append((row.start(), row.end(), "".join(new), ranges))
            elif spelled:  # short numbers such as the parts of an address
                edits += [(m.start(), m.end(), _DIGIT_WORDS[m.group().lower()], [m.span()])
                          for m in _SPELLED.finditer(t.text, row.start(), row.end())]
        done = [(a, b) for a, b, _, _ in edits]
        lone = [m for m in _SPELLED.finditer(t.text) if _beside_dot(t.text, m.start(), m.end())]
        edits += [(m.start(), m.end(), _DIGIT_WORDS[m.group().lower()], [m.span()]) for m in lone
                  if not any(a < m.end() and m.start() < b for a, b in done)]
        return t.rewrite(sorted(edits)) if edits else t

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """(plain spans, all spans), each by start and kind."""
        plain = detect(text)
        source = Mapped(text)
        t = self.between(self.characters(source))
        t = self.words(self.digits(t))
        if t is not source:
            t = self.digits(t)
        if t is source:
            return plain, plain
        extra = set()
        for a, b, kind in detect(t.text):
            span = (t.start[a], t.stop[b - 1], kind)
            if not any(k == kind and s <= span[0] and span[1] <= e for s, e, k in plain):
                extra.add(span)
        return plain, sorted({*plain, *extra}, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _named(text: str, end: int) -> bool:
    """Whether the word that ends at ``end`` is the local part of an address, and not prose or a path."""
    start = end
    while start > 0 and text[start - 1] in _LOCAL_CHARS:
        start -= 1
    if text[start - 1:start] in ("@", "/"):
        return False
    word = text[start:end]
    return bool(_MARKED.match(word)) or word.lower() not in _NO_NAMES and bool(_ASKED.search(text[max(0, start - 40):start]))


def _beside_dot(text: str, a: int, b: int) -> bool:
    return text[b:b + 1] == "." and text[b + 1:b + 2].isalnum() or a > 0 and text[a - 1] == "." and text[a - 2:a - 1].isalnum()


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chain = Deobfuscator()
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("kind", pa.string())]))

    def rows(spans: list[Span]) -> list[dict]:
        return [{"start": a, "stop": b, "kind": k} for a, b, k in spans]
    for batch in batches:
        plain, every = [], []
        for text in batch.column(1):
            p, e = chain.spans(text.as_py() or "")
            plain.append(rows(p))
            every.append(rows(e))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(plain, span), pa.array(every, span)],
                                         ["key", "plain", "spans"])


def find(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: ``key``, ``plain`` and ``spans`` (plain and
    disguised) as arrays of (start, stop, kind), code points, by start and kind."""
    kind = "array<struct<start:long,stop:long,kind:string>>"
    return key_text(docs, key_col, text_col).mapInArrow(
        _find, f"key long, plain {kind}, spans {kind}")
