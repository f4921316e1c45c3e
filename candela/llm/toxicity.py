"""Toxicity by class-conditional Kneser-Ney language models.

Two interpolated Kneser-Ney bigram models, of toxic and of ordinary labelled texts. Their lower orders
are continuation counts (in how many contexts a word was seen), and these back off to the continuation
counts of both classes together, so an expression that is rare in either is smoothed alike. Discounts
are those of counts of one, two and more (DISCOUNT): what was seen once says that a context or a word
has varied company, and leaves its whole mass to the backoff; what few texts have can't tell classes
apart. All probabilities of a context, unknown word included, sum to one.

A text's score compares its log-likelihoods under the two, normalised by length: the mean difference
over the fiftieth of its words (one at least) where that is greatest, as a few insults in a long text
leave the mean of all words unmoved. A logistic curve of this one number, fitted on labelled rows that
the models did not see and never falling, turns it into 0 to 1.

Bounds: the models learn from at most `sample` labelled rows, those of least hash of their id, and
hold all words and word pairs of these (the driver gathers the counts of words and of pairs seen twice
or more by a class, and of the other pairs, which add nothing of their own, a hash). This is the only
bound; every whole text is scored. Labels are read for fitting only, and of a text nothing but its
words is an input of its score.

Rows: words are lower-cased `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`. Null, empty and wordless texts get
the score that the curve gives to a difference of zero. Labels that are null or whose id is
null are not learned from; ids with several labels are learned from by each. Where labels of both
classes are lacking, every score is the rate of toxic rows among the labelled ones (0 without any).
`reject` carries all other columns, whatever their names; `score` those that are asked for.

Scale: fitting joins the sampled ids to the texts by broadcast (the bound above); scoring is one
pass without a shuffle.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as t

SAMPLE, THRESHOLD = 16_000, 0.3
#: What is taken off a count of 0, 1, 2 and 3 or more.
DISCOUNT = np.array([0.0, 1.0, 1.9, 2.5])
#: The share of a text's words that are compared.
SHARE = 0.02


def held_out(id: Column) -> Column:
    return F.crc32(id.cast("string").cast("binary")) % 4 == 2


class Model:
    """word: sorted hashes; toxic1, plain1: probability of each word without its context (last: of an
    unknown one); pair: sorted hashes of word pairs, toxic2, plain2: what the pair itself gives;
    back_toxic, back_plain: the weight of the backoff after each word (last: after an unknown one)."""

    def __init__(self, word, toxic1, plain1, pair, toxic2, plain2, back_toxic, back_plain):
        self.word, self.toxic1, self.plain1 = word, toxic1, plain1
        self.pair, self.toxic2, self.plain2 = pair, toxic2, plain2
        self.back_toxic, self.back_plain = back_toxic, back_plain
        self.weights = self.held = None  # held: the broadcast of the model without them

    def short(self) -> Model:
        """The same probabilities, less the pairs that give nothing themselves."""
        some = (self.toxic2 > 0) | (self.plain2 > 0)
        return Model(self.word, self.toxic1, self.plain1, self.pair[some], self.toxic2[some], self.plain2[some], self.back_toxic, self.back_plain)

    def differences(self, h: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log P(word | before, toxic) - log P(word | before, ordinary) of each word; the first of a row has no context."""
        n = len(self.word)
        spot = np.minimum(np.searchsorted(self.word, h), max(n - 1, 0))
        spot = np.where(self.word[spot] == h, spot, n) if n else np.full(len(h), n)
        before = np.concatenate(([n], spot[:-1]))
        first = at[:-1][at[:-1] < len(h)]
        keys = t.pair(np.concatenate((h[:1], h[:-1])), h)
        two = np.minimum(np.searchsorted(self.pair, keys), max(len(self.pair) - 1, 0))
        seen = self.pair[two] == keys if len(self.pair) else np.zeros(len(h), bool)
        seen[first] = False
        out = []
        for single, back, pair in ((self.toxic1, self.back_toxic, self.toxic2), (self.plain1, self.back_plain, self.plain2)):
            given = single[spot] * back[before]
            given[first] = single[spot[first]]
            given[seen] += pair[two[seen]]
            out.append(np.log(given))
        return out[0] - out[1]

    def features(self, texts: pa.Array) -> np.ndarray:
        """The mean difference of the words where it is greatest; 0 without words."""
        words = t.Words(texts, t.ALNUM, t.LOWER)
        d, at = self.differences(words.hashes(), words.at), words.at
        out = np.zeros(len(at) - 1)
        for r, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
            if b > a:
                k = max(1, math.ceil(SHARE * (b - a)))
                out[r] = np.partition(d[a:b], b - a - k)[b - a - k :].mean()
        return out

    def score(self, features: np.ndarray) -> np.ndarray:
        base, slope = self.weights
        return 1 / (1 + np.exp(-np.clip(base + slope * features, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple[float, float]:
    """Intercept and slope, 0 at least, by Newton's method."""
    rate = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    base, slope = float(np.log(rate / (1 - rate))), 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(base + slope * x, -30, 30)))
        w = p * (1 - p)
        a, b, c = w.sum() + 1e-9, (w * x).sum(), (w * x * x).sum() + ridge
        g, h = (y - p).sum(), ((y - p) * x).sum() - ridge * slope
        det = a * c - b * b + 1e-12
        one, two = np.clip((c * g - b * h) / det, -2, 2), np.clip((a * h - b * g) / det, -2, 2)
        base, slope = base + float(one), slope + float(two)
        if max(abs(one), abs(two)) < 1e-9:
            break
    return (base, slope) if slope > 0 else (float(np.log(rate / (1 - rate))), 0.0)


def _count(batches):
    """Counts of word pairs by class; the first word's context is 0."""
    for batch in t.sliced(batches, "text"):
        words = t.Words(batch.column(batch.schema.get_field_index("text")), t.ALNUM, t.LOWER)
        h, rows = words.hashes(), words.rows()
        if not len(h):
            continue
        before = np.concatenate((np.zeros(1, np.uint64), h[:-1]))
        before[words.at[:-1][words.at[:-1] < len(h)]] = 0
        kind = batch.column(batch.schema.get_field_index("toxic")).to_numpy(zero_copy_only=False)[rows]
        keys = t.pair(t.pair(before, h), kind.astype(np.uint64))
        _, first, n = np.unique(keys, return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(kind[first].astype(np.int32)), pa.array(before[first].view(np.int64)), pa.array(h[first].view(np.int64)), pa.array(n)], ["toxic", "before", "word", "n"])


def _keys(batches):
    """The hash of each word pair."""
    for batch in batches:
        before, word = (batch.column(k).to_numpy().view(np.uint64) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(t.pair(before, word).view(np.int64))], ["pair"])


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", learn: Column | None = None, sample: int = SAMPLE) -> Model:
    """Learn from the labelled rows for which `learn`, a condition on the labels' columns, holds."""
    known = labels.where(F.col(label).isNotNull() & F.col(id).isNotNull() & (F.lit(True) if learn is None else learn))
    chosen = known.select(F.col(id).alias("_id"), (F.col(label) > 0).cast("int").alias("toxic")).orderBy(F.xxhash64("_id"), "_id", "toxic").limit(sample)
    texts = docs.select(F.col(id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), "_id")
    texts = texts.withColumn("fold", F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(4)))
    by_class = [F.sum(F.when(F.col("toxic") == k, F.col("n")).otherwise(0)).cast("int").alias(f"c{k}") for k in (0, 1)]
    pairs = t.stored(t.map_arrow(texts.where("fold != 0").select("toxic", "text"), _count, "toxic int, before long, word long, n long").groupBy("before", "word").agg(*by_class), "pairs")
    # the driver gathers counts of words, and of those pairs that keep something after the discount
    seen = [F.count(F.when(F.col(f"c{k}") > 0, 1)).cast("int").alias(f"c{k}") for k in (0, 1)]
    single_counts = pairs.groupBy("word").agg(*seen, F.count(F.lit(1)).cast("int").alias("any")).toArrow()
    word = single_counts.column("word").to_numpy().view(np.uint64)
    order = np.argsort(word)
    word, n = word[order], len(word)
    after = [single_counts.column(c).to_numpy()[order] for c in ("c0", "c1", "any")]
    inside = pairs.where("before != 0")  # the first word of a text has no context, but counts as in one more company
    contexts = inside.groupBy("before").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")).toArrow()
    context = np.searchsorted(word, contexts.column("before").to_numpy().view(np.uint64))
    found = inside.where("c0 > 1 or c1 > 1").toArrow()
    before, last = (found.column(c).to_numpy().view(np.uint64) for c in ("before", "word"))
    behind = np.searchsorted(word, before).astype(np.int32)

    def kept(c: np.ndarray) -> np.ndarray:
        return np.maximum(c - DISCOUNT[np.minimum(c, 3).astype(np.int64)], 0)

    def lower(c: np.ndarray, shared: np.ndarray) -> np.ndarray:
        """Discounted shares of the words and an unknown one; what was taken off goes to `shared`."""
        own = np.append(kept(c), 0) / max(c.sum(), 1)
        return own + (1 - own.sum()) * shared

    shared = lower(after[2], np.full(n + 1, 1 / (n + 1)))
    single, back, given = [], [], []
    for k, c in enumerate(("c0", "c1")):
        single.append(lower(after[k], shared))
        total = np.zeros(n + 1)
        total[context] = contexts.column(c).to_numpy()
        own = kept(found.column(c).to_numpy()).astype(np.float32)
        used = np.bincount(behind, own, minlength=n + 1)
        back.append(np.where(total > 0, 1 - used / np.maximum(total, 1), 1.0))
        own /= np.maximum(total, 1)[behind]
        given.append(own)
    # a pair without mass of its own is a key alone
    once = t.map_arrow(inside.where("c0 <= 1 and c1 <= 1").select("before", "word"), _keys, "pair long").toArrow().column("pair").to_numpy().view(np.uint64)
    keys = np.concatenate((t.pair(before, last), once))
    given = [np.concatenate((own, np.zeros(len(once), np.float32))) for own in given]
    del found, before, last, behind, contexts, single_counts, once, own
    pa.default_memory_pool().release_unused()
    order = np.argsort(keys)
    model = Model(word, single[1], single[0], keys[order], given[1][order], given[0][order], back[1], back[0])
    del keys, given, order
    held = docs.sparkSession.sparkContext.broadcast(model.short())
    model.held = held

    def features(batches):
        for batch in t.sliced(batches, "text"):
            x = held.value.features(batch.column(batch.schema.get_field_index("text")))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("toxic")), pa.array(x)], ["toxic", "x"])

    rows = t.map_arrow(texts.where("fold = 0").select("toxic", "text"), features, "toxic int, x double").toArrow()  # a fourth of the sample at most
    y = rows.column("toxic").to_numpy().astype(float)
    if len(y) and 0 < y.sum() < len(y):
        model.weights = _logistic(rows.column("x").to_numpy(), y)
    else:
        rate = chosen.agg(F.avg("toxic")).first()[0] or 0.0
        model.weights = (float(np.log((rate + 1e-9) / (1 - rate + 1e-9))), 0.0)
    return model


def score(docs: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns `carry` of docs (all) with `_score`."""
    carry = docs.columns if carry is None else carry
    held, weights = model.held, model.weights
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    source = docs.select(*carry, F.col(text).alias("_scored"))

    def run(batches):
        held.value.weights = weights
        for batch in t.sliced(batches, "_scored"):
            x = held.value.features(batch.column(batch.schema.get_field_index("_scored")))
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(len(carry))] + [pa.array(held.value.score(x))], [*carry, "_score"])

    return t.map_arrow(source, run, ", ".join([f"`{c}` {kinds[c]}" for c in carry] + ["_score double"]))


def reject(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score threshold or more."""
    plain, (text,) = t.renamed(docs, text)
    return score(plain, model, text).where(F.col("_score") < threshold).drop("_score").toDF(*docs.columns)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's toxicity; learned from labels whose crc32 remainder by 4 is not 2."""
    docs = t.table(spark, sf_dir, "documents")
    model = fit(docs, t.table(spark, sf_dir, "labels"), learn=~held_out(F.col("doc_id")))
    found = score(docs, model, carry=["doc_id"])
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))
