import random
import re
from collections import Counter

import pytest
from candela.llm import substrings as s


def words(x):
    return re.findall(r"[^\x20\x09-\x0D]+", x or "")


def brute(texts, window):
    rows = [words(x) for x in texts]
    counts = Counter(tuple(r[i : i + window]) for r in rows for i in range(len(r) - window + 1))
    out = []
    for r in rows:
        gone = {i + j for i in range(len(r) - window + 1) if counts[tuple(r[i : i + window])] > 1 for j in range(window)}
        out.append((len(gone), " ".join(w for i, w in enumerate(r) if i not in gone)))
    return out


@pytest.mark.parametrize("window", [3, 8, 35])
def test_equals_brute_force(spark, window):
    rng = random.Random(window)
    vocab = ["a", "b", "é", "c.", "D", "d"] + [f"w{k}" for k in range(60)]
    base = [rng.choice(vocab) for _ in range(300)]
    texts = []
    for _ in range(40):
        own = [rng.choice(vocab) for _ in range(rng.randrange(120))]
        a = rng.randrange(250)
        own[5:5] = base[a : a + rng.randrange(80)]
        texts.append(rng.choice([" ", "\n", " \t"]).join(own))
    texts += [None, "", " ", "z " * 200, "only once " * 2, texts[3], texts[3], " ".join(base), "x" * 100_000]
    docs = spark.createDataFrame([(k if k % 9 else None, x, k) for k, x in enumerate(texts)], "doc_id long, text string, _key int")
    want = brute(texts, window)
    got = {r._key: r.text for r in s.deduplicate(docs, window=window).collect()}
    assert len(got) == len(texts)
    for k, (gone, body) in enumerate(want):
        assert got[k] == (body if gone else texts[k]), k
    found = s.repeats(docs, window=window)
    assert Counter(r.n_removed for r in found.collect()) == Counter({n: c for n, c in Counter(g for g, _ in {(x, d): w for (x, d), w in zip(zip(texts, [k if k % 9 else None for k in range(len(texts))]), want)}.values()).items() if n})


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert s.repeats(docs).count() == 0
    assert s.deduplicate(docs).count() == 0


def test_large_groups_join_no_windows(spark):
    """Near copies, exact copies and one row twice; no join has a row for each window."""
    rng = random.Random(7)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    near = [" ".join([*base[: k % 200], f"own{k}", *base[k % 200 + 1 :]]) for k in range(300)]
    texts = [*near, *[" ".join(base)] * 50, *[" ".join(f"v{rng.randrange(5000)}" for _ in range(80)) for _ in range(100)]]
    docs = spark.createDataFrame([*enumerate(texts), (0, texts[0])], "doc_id long, text string")
    found = s.repeats(docs)
    got = {r.doc_id: (r.n_removed, r.kept) for r in found.collect()}
    assert found.count() == len(got)
    assert got == {k: x for k, x in enumerate(brute([*texts, texts[0]], s.WINDOW)[:-1]) if x[0]}
    joins = re.findall(r"Join \[[^\n]*", found._jdf.queryExecution().executedPlan().toString())
    assert joins and not [x for x in joins if re.search(r"\bh#", x)]


def test_exact_copies_join_by_row_only(spark):
    """A large group of exact copies: rows are told by their keys, not joined by the words they share."""
    texts = ["one two " * 30] * 200 + ["own words " * 2] * 100 + [" ".join(f"u{k}" for k in range(50)), None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = s.repeats(docs)
    assert sorted((r.doc_id, r.n_removed, r.kept) for r in found.collect()) == [(k, 60, "") for k in range(200)]
    made = []
    stored = s.t.stored
    s.t.stored = lambda df, *name, **small: made.append(df._jdf.queryExecution().executedPlan().toString()) or stored(df, *name, **small)
    try:
        made.append(s.repeats(docs)._jdf.queryExecution().executedPlan().toString())
    finally:
        s.t.stored = stored
    assert not re.findall(r"Join \[_all#[^\n]*", "".join(made))
