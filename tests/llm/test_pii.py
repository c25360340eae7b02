import re

from tessera.llm import pii

from .helpers import documents, nasty

CHAIN = pii.Deobfuscator()

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    doubled = [sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))]
    return sum(doubled) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else False,
                  "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], list(PATTERNS).index(s[2])))


def test_plain_spans_equal_the_patterns():
    import random
    r = random.Random(1)
    parts = ["a", "@", ".", "b.c", "1", "192", "256", "000", "4111", " ", "-", "+", "(", ")", "x@y.z", "é", "５", "1.2.3.4",
             "4111111111111111", "+1 (555) 123-4567", "%", "--", "\n"]
    for _ in range(20_000):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 14)))
        assert pii.detect(text) == brute(text), repr(text)


def found(text):
    plain, every = CHAIN.spans(text)
    assert set(plain) <= set(every) and plain == brute(text)
    return [(k, text[a:b]) for a, b, k in every if (a, b, k) not in plain]


def test_disguises_map_back_to_the_source():
    for text, want in [
        ("mail john.doe [at] example [dot] com now", [("email", "john.doe [at] example [dot] com")]),
        ("write to ann at example dot org please", [("email", "ann at example dot org")]),
        ("user AT host DOT org", [("email", "user AT host DOT org")]),
        ("jоhn@exаmple.com", [("email", "jоhn@exаmple.com")]),
        ("j​ohn@ex​ample.com", [("email", "j​ohn@ex​ample.com")]),
        ("plus one five five five one two three four five six seven",
         [("phone", "plus one five five five one two three four five six seven")]),
        ("+1 double five five oh one two three four five six",
         [("phone", "+1 double five five oh one two three four five six")]),
        ("see four one one one, one one one one one one one one one one one one!",
         [("card", "four one one one, one one one one one one one one one one one one")]),
        ("ip one nine two dot one six eight dot one dot one.", [("ip", "one nine two dot one six eight dot one dot one")]),
        ("４１１１ １１１１ １１１１ １１１１", [("card", "４１１１ １１１１ １１１１ １１１１")]),
        ("+1 (555) 12З-4567 is", [("phone", "+1 (555) 12З-4567")]),
    ]:
        assert found(text) == want, text


def test_at_before_a_plain_domain():
    for text, want in [
        ("write to jane.doe at example.com", "jane.doe at example.com"),
        ("jane at mail.example dot com", "jane at mail.example dot com"),
        ("ask j_smith7 AT lists.example.co.uk, or", "j_smith7 AT lists.example.co.uk"),
        ("e-mail jane at example.com", "jane at example.com"),
        ("Contact: sales at example.com", "sales at example.com"),
        ("write to ann at mail.example [dot] org", "ann at mail.example [dot] org"),
    ]:
        assert found(text) == [("email", want)], text
    for text in ("contact us at example.com", "mail me at example.com", "open at 5 p.m. at example.com", "in 2024 at example.com",
                 "v1.2 at 3.5 percent", "see x.org/a-b at example.com", "the shop at example.com"):
        assert found(text) == [], text


def test_half_disguises_are_linear():
    import time
    start = time.time()
    for unit in ("a.b at c.d ", "a at b.", "a.", "mail ", " at a.b"):
        CHAIN.spans("a-b at " + unit * (200_000 // len(unit)))
    assert time.time() - start < 60


def test_clean_texts_stay_clean():
    for text in ("we met at noon. A dot com boom", "five dogs and three cats", "look at this dot", "x² and ½", "été à l'Œuvre",
                 "one two three", "at 5 dot", "plus one", "zero tolerance",
                 "meet me at google.com", "see it at example.org or call one two three"):
        assert found(text) == []


def test_long_runs_are_linear():
    import time
    start = time.time()
    for unit in ("a", "1", "1 ", "1.", "@", "a@", "+1", "+1(", "one ", "a at b dot "):
        CHAIN.spans(unit * (200_000 // len(unit)))
    assert time.time() - start < 60


def test_rows(spark):
    rows = nasty() + [(50, "mail a@b.co"), (51, "a at b dot co")]
    got = pii.find(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.key: r for r in got}
    assert [tuple(s) for s in by[50].plain] == [(5, 11, "email")] == [tuple(s) for s in by[50].spans]
    assert by[51].plain == [] and [tuple(s) for s in by[51].spans] == [(0, 13, "email")]
    assert by[4].spans == [] and by[5].spans == []
    assert pii.find(documents(spark, [])).count() == 0
