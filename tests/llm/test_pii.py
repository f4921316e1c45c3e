import random
import re

import pytest
from candela.llm import pii as p

TEXTS = [
    "mail und.34@mail7.example.com geiever, or +1 (017) 555-7713 rethsh 4111 1111 1111 1111 on",
    "eson 97.51.17.173 ueadoos 9807915762804490, x 300.1.2.3 and 1.2.3.4.5 +12 3 4 5",
    "under CC BY-NC 4.0. version 3. token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" a",
    "a@b.c a@b a@b.c@d.e @x.y é@z.com +49 (0)30-1234567\n+49 30", None, "", " ", "é" * 40_000 + " 8.8.8.8", "9" * 30_000,
]


def brute(x):
    x = x or ""
    out = [("email", *m.span()) for m in p.EMAIL.finditer(x)]
    out += [("ip", *m.span()) for m in p.IP.finditer(x) if all(len(v) < 9 and int(v) <= 255 for v in m.group().split("."))]
    out += [("card", *m.span()) for m in p.CARD.finditer(x) if 13 <= len(re.sub("[^0-9]", "", m.group())) <= 19 and p.luhn(re.sub("[^0-9]", "", m.group()))]
    return out + [("phone", *m.span()) for m in p.PHONE.finditer(x) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


@pytest.fixture(scope="module")
def field(spark):
    rows = []
    for k in range(60):
        rows.append((f"w{chr(97 + k % 26)} pe{'abcdefgh'[k % 8]}.{k}@mail{k % 9}.example.com xx, +1 ({100 + k}) 555-{1000 + 37 * k} then 10.{k}.3.{k % 250} end v{k % 7}.{k % 3} of {k}",))
    return p.fit(spark.createDataFrame(rows, "text string"))


def test_base_equals_patterns():
    for x in TEXTS:
        assert p.base_spans(x or "") == brute(x)


def test_decode_equals_enumeration(field):
    """The dynamic program finds the best of all segmentations."""
    text = "to 1.2.3.4 +1 (555) 555-1234 a.b@c.de 5555551234"
    for a, b in p.zones(text):
        n, found = p.segments(text[a:b])
        scored = [(i, j, max(field.scores(p.span_features(text[a + x : a + y], text[a + x - 1 : a + x] if a + x else "", text[a + y : a + y + 1])))) for i, j, x, y in found]
        best = {0: 0.0}
        for j in range(1, n + 1):
            best[j] = max([best[j - 1]] + [best[i] + s for i, e, s in scored if e == j])
        total = 0.0
        for kind, x, y in field.decode(text, a, b):
            total += field.scores(p.span_features(text[x:y], text[x - 1 : x] if x else "", text[y : y + 1]))[p.KINDS.index(kind)]
        assert total == pytest.approx(best[n])


def test_field_adds_variants_and_leaves_others(field):
    assert ("phone", 5, 19) in p.find("call (317) 555-7713 now", field)[1]
    for clean in ("under CC BY-NC 4.0. version 3.", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "in 1999 and 2024"):
        assert p.find(clean, field) == ([], [])


def test_search_and_redact(spark, field):
    docs = spark.createDataFrame([(k if k else None, x, "s") for k, x in enumerate(TEXTS + [TEXTS[0]])], "doc_id long, text string, spans string")
    got = sorted(p.search(docs, field).collect(), key=lambda r: (r.doc_id or 0))
    for r, x in zip(got, TEXTS + [TEXTS[0]]):
        assert r.base == ",".join(f"{k}:{a}:{b}" for k, a, b in brute(x))
        assert set(filter(None, r.base.split(","))) <= set(r.spans.split(","))
    clean = sorted(p.redact(docs, field).collect(), key=lambda r: (r.doc_id or 0))
    assert clean[0].text.startswith("mail <email> geiever, or <phone> rethsh <card> on") and clean[0].spans == "s"
    assert clean[2].text == TEXTS[2] and clean[4].text is None
    assert p.search(docs.limit(0), field).count() == 0


def test_without_examples(spark):
    field = p.fit(spark.createDataFrame([("nothing 1 here",), (None,)], "text string"))
    assert p.find("(317) 555-7713 and a@b.com", field) == ([("email", 19, 26)], [])


def test_checked_patterns_equal_plain_searches():
    """The spans of the patterns as the contract writes them, on random texts."""
    import re

    rng = random.Random(12)
    for _ in range(3000):
        text = "".join(rng.choice(["a", "b@", "@", ".", "..", "-", "_", "%", "1", "12", "255", ".0", " ", "+", "é", "c.d", "@e.f"]) for _ in range(rng.randrange(1, 30)))
        want = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        want += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
        assert [s for s in p.base_spans(text) if s[0] in ("email", "ip")] == want, text


def test_a_million_digits():
    import time

    began = time.time()
    for text in ("1" * 1_000_000, "a" * 1_000_000 + "@", "a@" * 300_000, "1." * 300_000, "+1" + " (" * 300_000, "+1" * 300_000):
        p.base_spans(text)
    assert time.time() - began < 30
