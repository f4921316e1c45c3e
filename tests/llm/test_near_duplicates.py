import random
import re

import numpy as np
import pytest
from candela.llm import near_duplicates as nd


def shingles(x, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x or ""))
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows, k, percent):
    sets = [shingles(x, k) for _, x in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            same = rows[i][0] is not None and rows[i][0] == rows[j][0] and sets[i] and sets[j]
            near = sets[i] and sets[j] and None not in (rows[i][0], rows[j][0]) and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both)
            if same or near:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(least.get(find(i), key), key)
    return [(key, len(sets[i]), None if key is None else least[find(i)] if sets[i] else key) for i, (key, _) in enumerate(rows)]


@pytest.mark.parametrize("k", [2, 5])
def test_components_equal_brute_force(spark, k):
    rng = random.Random(k)
    rows, key = [], 0
    for group in range(14):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(30, 90))]
        for copy in range(rng.randrange(1, 9)):
            own = list(base)
            for _ in range(rng.randrange(0, 5)):
                own[rng.randrange(len(own))] = f"v{rng.randrange(99)}"
            rows.append((key * 7 % 1009, " ".join(own)))
            key += 1
    chain = [f"c{j}" for j in range(100)]
    for step in range(25):  # neighbours are near, the ends are not
        rows.append((2000 + step, " ".join(chain[step : step + 80])))
    rows += [(3000, None), (3001, ""), (3002, " \n"), (3003, "One"), (3004, "one"), (3005, "x " * 20000), (None, "one"), (3005, "x " * 20000)]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, component_id string")
    got = sorted(map(repr, (tuple(r) for r in nd.link(docs, shingle=k).collect())))
    assert got == sorted(map(repr, brute(rows, k, 80)))
    kept = {r.doc_id for r in nd.keep_one(docs, shingle=k).collect()}
    assert kept == {c for i, _, c in brute(rows, k, 80)}


def test_signatures_estimate_resemblance():
    rng = np.random.default_rng(5)
    table = nd.permutations(240)
    for n, same in ((40, 30), (2000, 1500), (300, 60)):
        pool = rng.integers(0, 2**63, 3 * n).astype(np.uint64)
        a, b = pool[:n], np.concatenate([pool[:same], pool[n : 2 * n - same]])
        s = nd.signatures(np.concatenate([a, b]), np.array([0, n, 2 * n]), 240, table)
        assert abs((s[0] == s[1]).mean() - same / (2 * n - same)) < 0.12
        whole = nd.signatures(np.concatenate([a[::-1], a]), np.array([0, n, 2 * n]), 240, table)
        assert (whole[0] == whole[1]).all()


def test_empty(spark):
    assert nd.link(spark.createDataFrame([], "doc_id long, text string")).count() == 0
