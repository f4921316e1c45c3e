import random

import corpus_pipeline as c
import pytest


def words(rng, n):
    return " ".join(f"w{int(rng.paretovariate(0.7)) % 5000}" for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(9)
    item = " ".join(f"q{k}" for k in range(16))
    base = words(rng, 200)
    docs = [(k, words(rng, rng.randrange(20, 90)), "en", "s", 0) for k in range(400)]
    labels = []
    for k in range(400):
        if k % 4 == 0:
            docs[k] = (k, docs[k][1] + " scum moron trash scum moron", "en", "s", 0)
        labels.append((k, 1, int(k % 4 == 0)))
    docs += [(1000, base, "en", "s", 0), (1001, base, "en", "s", 0), (1002, base + " w1 w2", "de", None, 0)]
    docs += [(1100, "w5 w6 " + item + " w7 w8 " + words(rng, 40), "en", "s", 0), (1101, item, "en", "s", 0)]
    docs += [(1200, words(rng, 15) + " write to jo.1@mail.example.com or +1 (555) 555-1234 now", "en", "s", 0), (1300, None, "en", "s", None), (1301, "", "en", "s", 0)]
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(a, b, x, s, None if b is None else len(b)) for a, b, x, s, _ in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    states = []
    for _, stage in c.STAGES[:-1]:
        before, docs = docs, c._text.stored(stage(spark, docs, tables), "stage")
        assert [(f.name, f.dataType) for f in docs.schema] == [(f.name, f.dataType) for f in before.schema]
        rows = {r.doc_id: r for r in docs.collect()}
        assert all(r.text is None or r.n_chars == len(r.text) for r in rows.values())
        states.append(rows)
    clean = {k for k in range(400) if k % 4}
    assert len(clean - states[0].keys()) <= 6 and len({k for k in range(0, 400, 4)} & states[0].keys()) <= 6
    kept = clean & states[0].keys()
    assert kept <= states[1].keys() and 1000 in states[1] and not {1001, 1002} & states[1].keys() and {1300} <= states[1].keys()
    assert kept <= states[2].keys() and states[2][1100].text.startswith("w5 w6  w7 w8") and 1101 not in states[2]
    assert states[3][1200].text.endswith("write to <email> or <phone> now")
    assert all(states[3][k].text == states[2][k].text for k in kept)
    pieces = c.run(spark, tables).toPandas()
    assert set(pieces.doc_id) == set(states[3])
    assert pieces.groupby("sequence_id").length.sum().max() <= 2048
