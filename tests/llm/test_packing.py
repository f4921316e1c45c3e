import random
import zlib

import numpy as np
import pytest
from candela.llm import packing as p
from tokenizers import Tokenizer


def sample(spark):
    rng = random.Random(1)
    words = ["the", "Thing,", "é's", "don't", "x" * 30, "42", "-", "ção"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(900))) for _ in range(80)]
    texts += [None, "", " \n\t", "a b <|endoftext|> c", "z " * 9000, texts[0], texts[0]]
    return texts, spark.createDataFrame([(k if k != 3 else None, x, k) for k, x in enumerate(texts)], "doc_id long, text string, length int")


@pytest.mark.parametrize("by_word", [True, False])
def test_round_trip(spark, by_word):
    texts, docs = sample(spark)
    path = p.default_tokenizer()
    rows = p.pack(docs, path, size=256, by_word=by_word, with_ids=True).toPandas()
    tokenizer = Tokenizer.from_file(path)
    want = {(k if k != 3 else -1): tokenizer.encode(x or "", add_special_tokens=False).ids + [1] for k, x in enumerate(texts)}
    assert sorted({-1 if np.isnan(x) else int(x) for x in rows.doc_id}) == sorted(want)
    for key, own in rows.assign(doc_id=rows.doc_id.fillna(-1)).groupby("doc_id"):
        own = own.sort_values("start")
        assert [i for ids in own.ids for i in ids] == want[int(key)]
        assert (own.start == own.length.cumsum() - own.length).all()
        assert (own.doc_tokens == len(want[int(key)])).all()
        assert [zlib.crc32(np.array(x, "<u4").tobytes()) for x in own.ids] == own.ids_crc32.tolist()
    for _, own in rows.sort_values("offset").groupby("sequence_id"):
        assert (own.offset == own.length.cumsum() - own.length).all()
        assert own.length.sum() <= 256
    n = rows.sequence_id.nunique()
    assert sorted(rows.sequence_id.unique()) == list(range(n))
    assert n <= -(-rows.length.sum() // 256) * 1.06 + 1


def test_column_generation_uses_every_piece():
    rng = np.random.default_rng(2)
    for most in (3, 400):
        demand = np.zeros(65, int)
        demand[1:64] = rng.integers(0, most, 63)
        out = p.column_generation(demand)
        assert (sum(a * n for a, n in out) == demand).all()
        assert all((a * np.arange(65)).sum() <= 64 for a, _ in out)
        least = (demand * np.arange(65)).sum() / 64
        assert sum(n for _, n in out) <= least * 1.08 + 8
    assert p.column_generation(np.zeros(9, int)) == []


def test_knapsack_equals_enumeration():
    price = np.array([0, 0.11, 0.0, 0.4, 0.45, 0, 0.7, 0])
    worth, pattern = p._knapsack(price, 7)
    best = max(a * 0.11 + c * 0.4 + d * 0.45 + f * 0.7 for a in range(8) for c in range(3) for d in range(2) for f in range(2) if a + 3 * c + 4 * d + 6 * f <= 7)
    assert worth == pytest.approx(best) and (pattern * np.arange(8)).sum() <= 7


def test_clear_deletes_the_tables(spark):
    import os

    from candela.llm import _text

    _text.clear(spark)
    assert p.pack(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), p.default_tokenizer()).count() == 1
    paths = [x.removeprefix("file://") for x in _text.TABLES]
    assert paths and all(map(os.path.isdir, paths))
    assert _text.clear(spark) == len(paths) and not any(map(os.path.exists, paths))


def test_empty(spark):
    assert p.pack(spark.createDataFrame([], "doc_id long, text string"), p.default_tokenizer()).count() == 0


def test_ids_by_word_equal_ids_of_whole_texts():
    """Words that are tokenised joined, apart or from memory give the ids of the whole text."""
    import random

    import pyarrow as pa

    code = p.Coder(p.default_tokenizer(), True)
    rng = random.Random(1)
    signs = ["a", "b", "É", "İ", "ß", "ǆ", "한", "ㄱ", "ᄀ", "ᅡ", "\u0301", "1", "²", "'", "s", "t", ".", ",", "-", "_", "\u200b", "日", "本", "é", "Σ", "ς", "ﬁ", "\xa0", " ", " ", " "]
    for _ in range(100):
        texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(200))) for _ in range(40)]
        ids, at = code(pa.array(texts))
        for k, x in enumerate(texts):
            assert ids[at[k] : at[k + 1]].tolist() == code.tokenizer.encode(x, add_special_tokens=False).ids
    code.forget()
    assert not code.known and not code.before
