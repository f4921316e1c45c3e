import re

import xxhash
from candela.llm import fingerprints as fp
from pyspark.sql import functions as F


def chain(words):
    s = 42
    for x in words:
        s = xxhash.xxh64(x.encode(), seed=s).intdigest()
    return s - 2**64 if s >= 2**63 else s


def shingles(x, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x or ""))
    return {chain(w)} if 0 < len(w) < k else {chain(w[i : i + k]) for i in range(len(w) - k + 1)}


TEXTS = ["a b c d e f", "A b\tc d e", "one", "", None, "é " * 4000, " ".join(f"w{k}" for k in range(5000)), " ".join(f"w{k % 97} v{k}" for k in range(900)), " ".join(f"w{k}" for k in range(2500, 9000)), "a b c d e f"]


def test_sketch_equals_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for k, n in ((256, 5), (8, 2)):
        for row in docs.select("doc_id", fp.sketch(F.col("text"), k, n).alias("s")).collect():
            assert row.s == sorted(shingles(TEXTS[row.doc_id], n))[:k]


def test_merge_and_estimates(spark):
    docs = spark.createDataFrame([(k, TEXTS[6 if k % 2 else 8]) for k in range(2)] + [(2, TEXTS[0]), (3, "")], "doc_id long, text string").withColumn("s", fp.sketch(F.col("text")))
    a, b = docs.alias("a"), docs.alias("b")
    rows = {(r[0], r[1]): r for r in a.join(b, F.lit(True)).select("a.doc_id", "b.doc_id", fp.resemblance(F.col("a.s"), F.col("b.s")), fp.containment(F.col("a.s"), F.col("b.s")), fp.merge(F.col("a.s"), F.col("b.s")), fp.distinct_shingles(F.col("a.s"))).collect()}
    x, y = shingles(TEXTS[8], 5), shingles(TEXTS[6], 5)
    assert abs(rows[0, 1][2] - len(x & y) / len(x | y)) < 0.1 and abs(rows[0, 1][3] - len(x & y) / len(x)) < 0.15
    assert rows[0, 1][4] == sorted(x | y)[:256] and abs(rows[0, 1][5] / len(x) - 1) < 0.2
    assert rows[2, 2][2:4] == (1.0, 1.0) and rows[2, 2][5] == 2.0 and rows[3, 3][2] == 1.0 and rows[2, 3][2] == 0.0
    whole = fp.merge_all(docs.withColumn("g", F.lit(1)), ["g"], "s").first().s
    assert whole == sorted(x | y | shingles(TEXTS[0], 5))[:256]


def test_next(spark):
    rows = [(k * 3 % 101, f"t{k}") for k in range(101)] + [(5, "again"), (None, "no id"), (None, None), (-4, "less")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    order = sorted(((k is not None, k or 0, x or "") for k, x in rows))
    want = sorted((repr(a), order[(i + 1) % len(order)][2]) for i, a in enumerate(order))
    for ranges in (1, 2, 7, 40, 300):
        got = fp.with_next(docs, "doc_id", "text", ranges=ranges).collect()
        assert sorted((repr((r.doc_id is not None, r.doc_id or 0, r.text)), r.next_text) for r in got) == want
    assert fp.with_next(docs.limit(0), "doc_id", "text").count() == 0
    one = fp.with_next(docs.where("doc_id = -4"), "doc_id", "text").collect()
    assert [(r.text, r.next_text) for r in one] == [("less", "less")]
