import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from candela.llm import _text as t
from candela.llm import brown as b


def tokens(x):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x or "")) + [None]


def corpus():
    rng = random.Random(4)
    groups = [[f"{p}{k}" for k in range(40)] for p in ("un", "de", "Be")]
    rows = []
    for k in range(150):  # words of the groups follow each other in turn
        rows.append((k, " ".join(rng.choice(groups[j % 3]) for j in range(rng.randrange(2, 90)))))
    return rows + [(900, None), (901, ""), (902, " \n"), (903, "zzz " * 20000), (None, "un1 de1"), (3, rows[3][1])]


def test_vocabulary_does_not_hang_on_the_size(spark, monkeypatch):
    """A word seen `least` times is a word of its own whatever the number of all tokens."""
    monkeypatch.setattr(b, "BOUND", 100, raising=False)
    rows = [(1, "seldom seldom seldom"), (2, "often " * 2000)]
    model, _ = b.fit(spark.createDataFrame(rows, "doc_id long, text string"), classes=8)
    assert len(model.own) == 2


@pytest.mark.parametrize("least", [1, 3, 60])
def test_counts_and_base(spark, least):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int")
    train = docs.where(~b.held_out(docs["doc_id"]))
    model, counts = b.fit(train, least=least, classes=8)
    count = Counter()
    for key, x in rows:
        if key is None or zlib.crc32(str(key).encode()) % 7 != 2:
            count.update(tokens(x))
    n, v = sum(count.values()), len(count)
    assert (model.tokens, model.distinct) == (n, v)
    want = sorted((str(key), len(w := tokens(x)), sum(count[c] > 0 for c in w), round(sum(math.log10((count[c] + 1) / (n + v + 1)) for c in w), 4)) for key, x in rows)
    got = b.score(docs, model, counts).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got) == want
    out = [r for r in got if r.doc_id is not None and r.doc_id < 200 and zlib.crc32(str(r.doc_id).encode()) % 7 == 2]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)  # the classes help on texts held out


def test_score_equals_brute_force(spark):
    """Scores from their definition, over Python dictionaries and the classes found."""
    rng = random.Random(8)
    rows = corpus() + [(2000 + k, " ".join(rng.choice(["un1", "de2", f"rare{k}", f"odd{k % 9}", "X"]) for _ in range(9))) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    train = [x for key, x in rows if key is not None and key % 5]
    m, counts = b.fit(docs.where("doc_id % 5 != 0"), least=3, classes=8)
    count = Counter(w for x in train for w in tokens(x))
    own = dict(zip(m.own.tolist(), m.own_type.tolist()))

    def kind(w):
        if w is None:
            return len(own) + b.SPELLINGS
        one = pa.array([w.encode()], pa.binary())
        return own.get(int(t.word_hashes(one)[0]), len(own) + int(b.spelling(one)[0]))

    kinds = {w: kind(w) for x in rows for w in tokens(x[1])}
    assert all((kinds[w] < len(own)) == (count[w] >= 3) for w in kinds if w is not None) and len(own) == sum(n >= 3 for w, n in count.items() if w)
    size, members = Counter(), {}
    for w, n in count.items():
        size[kinds[w]] += n
        members.setdefault(kinds[w], []).append(n)
    follow = np.zeros((8, 8))
    before = None  # texts follow each other with an end between them, so an end is the context of each first word
    for x in train:
        before = None
        for w in tokens(x):
            follow[m.where[kinds[before]], m.where[kinds[w]]] += 1
            before = w
    share = (follow.sum(0) + 0.5) / (follow.sum() + 4)
    step = (follow + 5 * share) / (follow.sum(1, keepdims=True) + 5)
    total = np.zeros(8)
    for k in range(len(own) + b.SPELLINGS + 1):
        total[m.where[k]] += size[k] + 0.5
    rest = [n for w, n in count.items() if w is not None and n < 3]
    once, twice = rest.count(1), rest.count(2)
    off = min(max(once / (once + 2 * twice), 0.1), 0.95)

    def emitted(w):
        k = kinds[w]
        p = (size[k] + 0.5) / total[m.where[k]]
        if k < len(own) or w is None:
            return p
        mine = members.get(k, [])
        if count[w]:
            return p * (count[w] - off) / size[k]
        return p * max(off * len(mine), 0.5) / max(mine.count(1) ** 2 / max(2 * mine.count(2), 1), 1) / max(size[k], 1)

    got = sorted((str(r.doc_id), round(r.score, 6)) for r in b.score(docs, m, counts).collect())
    want = []
    for key, x in rows:
        score, before = 0.0, None
        for w in tokens(x):
            score += math.log10(step[m.where[kinds[before]], m.where[kinds[w]]] * emitted(w))
            before = w
        want.append((str(key), round(score, 6)))
    assert [k for k, _ in got] == [k for k, _ in sorted(want)] and np.allclose([v for _, v in got], [v for _, v in sorted(want)], atol=1e-4)
    for c in range(1, 8):  # the emissions of a class are a distribution over words, and what is left to words not seen
        mass = sum(emitted(w) for w in count if m.where[kinds[w]] == c)
        mass += sum((size[k] + 0.5) / total[c] * off * len(members[k]) / size[k] for k in members if len(own) <= k < len(own) + b.SPELLINGS and m.where[k] == c)
        mass += sum(0.5 / total[c] for k in range(len(own) + b.SPELLINGS) if k not in members and m.where[k] == c)
        assert abs(mass - 1) < 1e-6


def test_moves_lose_least():
    """The class that a word goes to is the best of all, by the information of all classes."""
    rng = np.random.default_rng(3)
    n, many = 24, 5
    counts = rng.integers(0, 6, (n, n)).astype(float)
    counts[0, 0] = 3
    where = np.concatenate(([0], rng.integers(1, many, n - 1)))

    def grid_of(w):
        m = np.zeros((n, many))
        on = np.flatnonzero(w >= 0)
        m[on, w[on]] = 1
        return m.T @ counts @ m

    def information(w):
        g = grid_of(w)
        return b._xlogx(g).sum() - b._xlogx(g.sum(0)).sum() - b._xlogx(g.sum(1)).sum()

    for now in (where, np.where(np.arange(n) % 3 == 1, -1, where)):
        word, slot, many_of = [], [], []
        for x in range(1, n):
            for y in range(n):
                if y != x and now[y] >= 0:
                    word += [x, x]
                    slot += [now[y], many + now[y]]
                    many_of += [counts[y, x], counts[x, y]]
            word, slot, many_of = [*word, x], [*slot, 2 * many], [*many_of, counts[x, x]]
        keys, place = np.unique(np.array(word) * 100 + np.array(slot), return_inverse=True)
        words, best = b.moves(keys // 100, keys % 100, np.bincount(place, many_of), now[1:], grid_of(now))
        assert words.tolist() == list(range(1, n))
        for x, c in zip(words.tolist(), best.tolist()):
            tries = []
            for to in range(1, many):
                other = now.copy()
                other[x] = to
                tries.append(information(other))
            assert c > 0 and tries[c - 1] >= max(tries) - 1e-6


def test_exchange_finds_classes_and_gains():
    rng = np.random.default_rng(0)
    member = np.array([0] + [1 + k % 3 for k in range(30)])
    counts = np.zeros((31, 31))
    for x in range(31):
        for y in range(31):
            if member[y] == member[x] % 3 + 1:
                counts[x, y] = rng.integers(1, 30)
    where = b.exchange(counts, 4, 0)
    assert where[0] == 0 and all(len({where[k] for k in range(1, 31) if member[k] == c}) == 1 for c in (1, 2, 3))

    def information(w):
        m = np.zeros((31, 4))
        m[np.arange(31), w] = 1
        g = m.T @ counts @ m
        return b._xlogx(g).sum() - b._xlogx(g.sum(0)).sum() - b._xlogx(g.sum(1)).sum()

    noisy = counts + rng.integers(0, 5, counts.shape)
    counts = noisy
    where = b.exchange(noisy, 4, 0, sweeps=20)
    for x in range(1, 31):  # no single move helps any more
        for to in (1, 2, 3):
            other = where.copy()
            other[x] = to
            assert information(other) <= information(where) + 1e-6


def test_transitions_are_a_distribution(spark):
    model, _ = b.fit(spark.createDataFrame(corpus(), "doc_id long, text string"), classes=8)
    assert np.allclose((10.0**model.transition).sum(1), 1, atol=1e-6)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    model, counts = b.fit(none)
    assert b.score(none, model, counts).count() == 0
    row = b.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), model, counts).first()
    assert (row.n_tokens, row.n_known, row.base_score) == (3, 0, 0.0) and math.isfinite(row.score)
