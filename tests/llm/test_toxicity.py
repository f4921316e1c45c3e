import random

import numpy as np
import pyarrow as pa
import pytest
from candela.llm import _text as t
from candela.llm import toxicity as x

BAD = ["scum", "moron", "trash"]


def corpus(n, seed=0):
    rng = random.Random(seed)
    docs, labels = [], []
    for k in range(n):
        words = [f"w{int(rng.paretovariate(1))}" for _ in range(rng.randrange(5, 120))]
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(rng.randrange(1, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        docs.append((k, " ".join(words), "en"))
        labels.append((k, int(toxic) if k % 50 else None))
    return docs, labels


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = corpus(900)
    frame = spark.createDataFrame(docs + [(5000, None, "en"), (5001, "", None), (None, "idle " * 30000, "en"), (0, docs[0][1], "en")], "doc_id long, text string, _score string")
    return frame, spark.createDataFrame(labels + [(None, 1)], "doc_id long, toxic int"), labels


def test_held_out_accuracy(spark, fitted):
    from pyspark.sql import functions as F

    docs, labels, truth = fitted
    model = x.fit(docs, labels, learn=~x.held_out(F.col("doc_id")))
    rows = x.score(docs, model, carry=["doc_id"]).withColumn("out", x.held_out(F.col("doc_id"))).collect()
    assert len(rows) == 904 and all(0 <= r._score <= 1 for r in rows)
    want = {k: y for k, y in truth if y is not None}
    pairs = [(want[r.doc_id], r._score) for r in rows if r.out and r.doc_id in want]
    good = sum((s >= x.THRESHOLD) == bool(y) for y, s in pairs) / len(pairs)
    assert len(pairs) > 150 and good > 0.95
    kept = x.reject(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r._score < x.THRESHOLD for r in rows)


def test_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([(k, "a b a c b a", 0) for k in range(8)] + [(20 + k, "a d b d", 1) for k in range(8)], "doc_id long, text string, x int")
    labels = spark.createDataFrame([(k, 0) for k in range(8)] + [(20 + k, 1) for k in range(8)], "doc_id long, toxic int")
    m = x.fit(docs, labels)
    kinds = 4
    names = [w.encode() for w in "abcd"]
    h = t.word_hashes(pa.array(names, pa.binary()))
    at = np.searchsorted(m.word, h)
    assert len(m.word) == kinds
    for single, back, two in ((m.toxic1, m.back_toxic, m.toxic2), (m.plain1, m.back_plain, m.plain2)):
        assert abs(single.sum() - 1) < 1e-6 and len(single) == kinds + 1 and (single > 0).all()  # the last is an unknown word
        for v in range(kinds):
            keys = t.pair(np.repeat(h[v], kinds), h)
            spot = np.minimum(np.searchsorted(m.pair, keys), len(m.pair) - 1)
            seen = m.pair[spot] == keys
            total = back[at[v]] * single.sum() + two[spot][seen].sum()
            assert abs(total - 1) < 1e-6


def test_without_labels(spark, fitted):
    docs, labels, _ = fitted
    model = x.fit(docs, labels.limit(0))
    assert {r._score for r in x.score(docs, model, carry=["doc_id"]).collect()} <= {x.score(docs, model, carry=["doc_id"]).first()._score}
    assert x.reject(docs, model).count() == docs.count()
    assert x.score(docs.limit(0), model, carry=["doc_id"]).count() == 0


def test_pairs_seen_once_are_evidence(spark):
    """All words and word pairs of the sampled rows are in the model, and each context's mass is whole."""
    docs = spark.createDataFrame([(k, f"a{k} b{k} c{k}", 0) for k in range(40)] + [(100 + k, f"d{k} e{k} f{k}", 1) for k in range(40)], "doc_id long, text string, x int")
    labels = docs.selectExpr("doc_id", "x as toxic")
    m = x.fit(docs, labels)
    kept = m.word.astype(np.uint64)
    known = 0
    for k in range(40):
        for names in ((f"a{k}", f"b{k}", f"c{k}"), (f"d{k}", f"e{k}", f"f{k}")):
            h = t.word_hashes(pa.array([w.encode() for w in names], pa.binary()))
            if np.isin(h, kept).all():
                known += 1
                assert np.isin(t.pair(h[:-1], h[1:]), m.pair).all()
    assert known * 3 == len(m.word) and len(m.pair) == known * 2


def test_score_equals_brute_force(spark):
    """The models and the score from their definitions, over Python dictionaries."""
    import math
    from collections import Counter

    docs, labels = corpus(160, seed=3)
    labels = [(k, y) for k, y in labels if y is not None]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    m = x.fit(frame, spark.createDataFrame(labels, "doc_id long, toxic int"))
    folds = {r[0] for r in frame.selectExpr("doc_id", "pmod(xxhash64(doc_id, 7), 4) as f").where("f != 0").collect()}
    count = [Counter(), Counter()]
    for k, y in labels:
        if k in folds:
            words = docs[k][1].split()
            count[y].update(zip(["", *words], words))
    off = lambda c: (0, 1.0, 1.9, 2.5)[min(c, 3)]
    vocab = sorted({w for c in count for _, w in c})

    def lower(kinds, shared):
        total = max(sum(kinds.values()), 1)
        own = {w: max(kinds[w] - off(kinds[w]), 0) / total for w in [*vocab, None]}
        left = 1 - sum(own.values())
        return {w: own[w] + left * shared[w] for w in own}

    both = lower(Counter(w for _, w in set(count[0]) | set(count[1])), dict.fromkeys([*vocab, None], 1 / (len(vocab) + 1)))
    low = [lower(Counter(w for _, w in c), both) for c in count]
    after = [{}, {}]
    for c, rows in zip(count, after):
        for (v, w), n in c.items():
            rows.setdefault(v, []).append((w, n))

    def probability(k, v, w):
        w = w if w in both else None
        rows = after[k].get(v, []) if v else []
        if not rows:
            return low[k][w]
        total = sum(n for _, n in rows)
        own = {u: max(n - off(n), 0) / total for u, n in rows}
        return own.get(w, 0) + (1 - sum(own.values())) * low[k][w]

    texts = [d[1] for d in docs[:40]] + ["scum", "unheard of words", ""]
    for text, got in zip(texts, m.features(pa.array(texts))):
        words = text.split()
        d = sorted((math.log(probability(1, v, w)) - math.log(probability(0, v, w)) for v, w in zip([None, *words], words)), reverse=True)
        some = d[: max(1, math.ceil(len(d) / 50))]
        assert abs(got - (sum(some) / len(some) if some else 0)) < 1e-4
    assert m.weights[1] > 0 and (np.diff(m.score(np.linspace(-5, 5, 50))) >= 0).all()


def test_driver_gathers_no_counts_of_pairs_seen_once(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    rng = np.random.default_rng(5)
    docs = spark.createDataFrame([(k, " ".join(f"w{j}" for j in rng.integers(0, 300, 400)), k % 2) for k in range(20)], "doc_id long, text string, x int")
    shapes, real = [], DataFrame.toArrow

    def gathered(self):
        out = real(self)
        shapes.append((out.num_rows, out.num_columns))
        return out

    monkeypatch.setattr(DataFrame, "toArrow", gathered)
    m = x.fit(docs, docs.selectExpr("doc_id", "x as toxic"))
    assert len(m.pair) > 3000 and all(columns == 1 for rows, columns in shapes if rows > len(m.pair) / 2)
