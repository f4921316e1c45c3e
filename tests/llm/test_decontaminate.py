import random
import re

import pytest
from candela.llm import decontaminate as d

DOC = "doc_id long, text string, _hits string"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def words(s):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(s or ""))


def brute(text, items, window):
    ws, hit, found = words(text), set(), set()
    for name, item in items:
        iw = words(item)
        k = min(window, len(iw))
        wins = {tuple(iw[i : i + k]) for i in range(len(iw) - k + 1)} if k else set()
        for i in range(len(ws) - k + 1):
            if k and tuple(ws[i : i + k]) in wins:
                hit |= set(range(i, i + k))
                found.add(str(name))
    return len(ws), hit, sorted(found)


@pytest.mark.parametrize("block_words", [1 << 20, 12])
def test_hits_equal_brute_force(spark, block_words):
    rng = random.Random(3)
    vocab = ["a", "B", "c", "é", "dd"]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(40))) + rng.choice(["", ".", "\n", "!?"]) for _ in range(60)]
    texts += [None, "", "  \n", "x" * 50_000, texts[0], texts[0]]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 5, 9, 14])))) for k in range(12)]
    items += [(90, None), (91, ""), (92, "a, b"), (93, "A B"), (None, "é é é")]
    docs = spark.createDataFrame([(k if k else None, x, "s") for k, x in enumerate(texts)], DOC)
    got = d.hits(docs, spark.createDataFrame(items, "item_id long, text string"), ["doc_id", "text"], window=4, block_words=block_words).collect()
    assert len(got) == len(texts)
    for row in got:
        n, hit, found = brute(row.text, items, 4)
        spans = {p for a, b in zip(row._hits[::2], row._hits[1::2]) for p in range(a, b)}
        assert (row._words, spans, row._items) == (n, hit, found)


def test_clean_cuts_spans_and_drops_covered_rows(spark):
    docs = spark.createDataFrame([(1, "x one two Three. y", "s"), (2, "one two three", "s"), (3, None, "s"), (4, "é clean", None)], DOC)
    items = spark.createDataFrame([("i", "One two three")], "item_id string, text string")
    got = {r.doc_id: r for r in d.clean(docs, items, window=3, max_span=3, max_coverage=0.7).collect()}
    assert {k: r.text for k, r in got.items()} == {1: "x . y", 3: None, 4: "é clean"}
    assert got[1]["_hits"] == "s"


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.hits(docs, none, ["doc_id"]).first()._words == 2
    assert d.hits(docs.limit(0), none, ["doc_id"]).count() == 0


def test_clean_cuts_whole_short_items(spark):
    docs = spark.createDataFrame([(1, "x one two Three. y one two z w", "s")], DOC)
    items = spark.createDataFrame([("i", "One two three")], "item_id string, text string")
    assert [r.text for r in d.clean(docs, items).collect()] == ["x . y one two z w"]
