"""Language-model scoring by Brown class-based n-grams.

Exchange clustering assigns words to classes so that the mutual information of adjacent classes is
greatest. P(word | before) = P(class | class before) * P(word | class). Every word that the training
texts have `least` times or more is clustered as itself; rarer words, and words that they lack, are
clustered by types of spelling (last letters and length). Within such a type a word has its absolutely
discounted count; what the discount frees goes to the words not seen, whose number is estimated from
those seen once and twice (Chao). Class transitions are interpolated with the class frequencies. The
number of classes grows with the vocabulary. Scores are log10 probabilities of whole texts; perplexity
is 10^(-score / n_tokens).

The TOP most frequent words are exchanged one after the other. Then every other word goes to the class
that loses least, given the counts of its neighbours' classes, and in SWEEPS further rounds a half of
all words, and then the other, is taken out and put back: the words of a round are judged against the
same counts, apart from each other, so a round is one distributed pass.

Tokens: lower-cased `[^\\x20\\x09-\\x0D]+`, then one end, which is also the context of the first word.

Rows: null, empty and blank texts are their end alone; repeated rows and ids are scored, and learned
from, each; a null id passes through. An empty training set gives base scores of 0 and finite scores.
Other columns are not read.

Scale: counts of all training words are one aggregate, pre-aggregated in each task and kept as a
table that grows with the input. `least` is what is given, 3 by default, however large the input. The
vocabulary is broadcast and grows with the words that occur so often, some 14 bytes each; it, its
classes and classes * classes counts are all that the driver gathers. Texts are coded once as a table of word numbers; a round sums each
word's neighbours by class there, in blocks of words. Texts are never shuffled; rarer words are joined
with the table of counts, as (row, word, times).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as t

LEAST, TOP, SPELLINGS, SWEEPS = 3, 512, 511, 1
FLUSH = 2_000_000
#: Words of a block, and neighbours by class that are judged at once.
BLOCK, CHUNK = 2048, 4_000


def spelling(vocab: pa.Array) -> np.ndarray:
    """A type, from 0 on, for each word by its last two bytes and its length."""
    off, raw = t.buffers(vocab)
    size = np.diff(off)
    last = raw[off[1:] - 1].astype(np.uint64) if len(size) else np.zeros(0, np.uint64)
    prior = np.where(size > 1, raw[np.maximum(off[1:] - 2, 0)], 0).astype(np.uint64) if len(size) else last
    key = (last * np.uint64(256) + prior) * np.uint64(4) + np.minimum(size // 5, 3).astype(np.uint64)
    return (t.mix(key + np.uint64(1)) % np.uint64(SPELLINGS)).astype(np.int32)


class Sums:
    """Sums of counts by key, handed on whenever FLUSH entries are held."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, keys, counts, extra):
        self.parts.append((keys, counts, extra))
        self.size += len(keys)
        if self.size < FLUSH:
            return None
        out = self.take()
        if len(out[0]) < FLUSH // 2:  # keys recur: go on with the sums
            self.parts, self.size = [out], len(out[0])
            return None
        return out

    def take(self):
        keys, counts, extra = (np.concatenate(x) for x in zip(*self.parts))
        self.parts, self.size = [], 0
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        return keys[first], np.add.reduceat(counts[order], first), extra[order][first]


def _count(batches):
    sums = Sums()
    batch_of = lambda x: pa.RecordBatch.from_arrays([pa.array(x[0].view(np.int64)), pa.array(x[1]), pa.array(x[2])], ["h", "n", "spelling"])
    for batch in t.sliced(batches, "_text"):
        words = t.Words(batch.column(batch.schema.get_field_index("_text")), t.SPACED, t.LOWER)
        if len(words.codes):
            full = sums.add(t.word_hashes(words.vocab), np.bincount(words.codes, minlength=len(words.vocab)).astype(np.int64), spelling(words.vocab))
            if full:
                yield batch_of(full)
    if sums.parts:
        yield batch_of(sums.take())


def _types(words: t.Words, own: np.ndarray, own_type: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash and the type of each word of the vocabulary: its number, or, after these, its spelling's."""
    h, kind = t.word_hashes(words.vocab), spelling(words.vocab) + len(own)
    if len(own):
        at = np.minimum(np.searchsorted(own, h), len(own) - 1)
        kind = np.where(own[at] == h, own_type[at], kind)
    return h, kind


def _with_ends(values: np.ndarray, at: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of all rows, an end after each row, and the offsets of the rows."""
    return np.insert(values, at[1:], end), at + np.arange(len(at))


def _code(vocabulary):
    """Numbers of the words of each slice of texts, with an end before the first and after each text."""

    def run(batches):
        own, own_type = vocabulary.value
        end = len(own) + SPELLINGS
        for batch in t.sliced(batches, "_text"):
            words = t.Words(batch.column(batch.schema.get_field_index("_text")), t.SPACED, t.LOWER)
            _, kind = _types(words, own, own_type)
            seq, _ = _with_ends(kind[words.codes] if len(words.codes) else np.zeros(0, np.int32), words.at, end)
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(([end], seq)).astype(np.int32)], pa.list_(pa.int32()))], ["seq"])

    return run


def _sequences(batches) -> Iterator[np.ndarray]:
    for batch in batches:
        for seq in batch.column(0):
            yield seq.values.to_numpy()


def _adjacent(classes):
    """Counts of adjacent classes (pair, n); words without a class are left out."""

    def run(batches):
        where, many = classes.value
        total = np.zeros(many * many, np.int64)
        for seq in _sequences(batches):
            c = where[seq].astype(np.int64)
            known = (c[:-1] >= 0) & (c[1:] >= 0)
            total += np.bincount(c[:-1][known] * many + c[1:][known], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["pair", "n"])

    return run


def _neighbours(classes, part: int, parts: int, blocks: int):
    """Counts of each word's neighbours by class, for the words of this part (of all, those without a class
    if part is -1), in blocks of words: a number for word, side and class, as differences, and its count."""

    def run(batches):
        where, many = classes.value
        width = 2 * many + 1
        sums = Sums()

        def packed(found):
            keys, n, _ = found
            block = keys // width % blocks
            order = np.argsort(block, kind="stable")
            block = block[order]
            first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
            out = []
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(block)]):
                own = keys[order[a:b]]
                out.append(zlib.compress(np.diff(own, prepend=0).tobytes() + n[order[a:b]].astype(np.int64).tobytes(), 1))
            return pa.RecordBatch.from_arrays([pa.array(block[first].astype(np.int32)), pa.array(out, pa.binary())], ["block", "counts"])

        for seq in _sequences(batches):
            c = where[seq].astype(np.int64)
            word = seq.astype(np.int64)
            moving = (c < 0) if part < 0 else (word % parts == part)
            moving &= c != 0  # the end stays
            same = word[1:] == word[:-1]
            left, right = moving[1:] & (c[:-1] >= 0) & ~same, moving[:-1] & (c[1:] >= 0) & ~same
            keys = np.concatenate((word[1:][left] * width + c[:-1][left], word[:-1][right] * width + many + c[1:][right], word[1:][same & moving[1:]] * width + 2 * many))
            keys, n = np.unique(keys, return_counts=True)
            if len(keys) and (full := sums.add(keys, n.astype(np.int64), np.zeros(len(keys), np.int8))):
                yield packed(full)
        if sums.parts:
            yield packed(sums.take())

    return run


def moves(word: np.ndarray, slot: np.ndarray, n: np.ndarray, was: np.ndarray, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, the best class of each): word is sorted, slot its neighbours' class (after `classes`, of those
    behind it; at last, itself), n how often; was: its class now, -1 for none; grid: counts of adjacent classes."""
    many = len(grid)
    words, row = np.unique(word, return_inverse=True)
    dense = np.zeros((len(words), 2 * many + 1))
    dense[row, slot] = n
    left, right, own = dense[:, :many], dense[:, many : 2 * many], dense[:, -1]
    placed = np.flatnonzero(was >= 0)
    down, across, corner = (np.repeat(x[None, :].astype(float), len(words), 0) for x in (grid.sum(1), grid.sum(0), np.diag(grid)))
    home = was[placed]
    down[placed, home] -= right[placed].sum(1) + own[placed]
    across[placed, home] -= left[placed].sum(1) + own[placed]
    loose = np.flatnonzero(was < 0)  # its neighbours' classes don't count it yet
    down[loose] += left[loose]
    across[loose] += right[loose]
    corner[placed, home] -= left[placed, home] + right[placed, home] + own[placed]
    gain = np.zeros((len(words), many))
    for side, lines, other in ((left, grid, right), (right, np.ascontiguousarray(grid.T), left)):
        at, c = np.nonzero(side)
        plain = _xlogx(lines)
        for a in range(0, len(at), CHUNK):  # cells of the neighbour's class c and each class, without the word itself
            r, k = at[a : a + CHUNK], c[a : a + CHUNK]
            more = side[r, k]
            cell, before = lines[k], plain[k]
            home = was[r]
            inside = np.flatnonzero(home >= 0)
            cell[inside, home[inside]] -= more[inside]
            before[inside, home[inside]] = _xlogx(cell[inside, home[inside]])
            self_ = np.flatnonzero((home >= 0) & (k == home))
            cell[self_] -= other[r[self_]]
            cell[self_, k[self_]] -= own[r[self_]]
            before[self_] = _xlogx(cell[self_])
            cell += more[:, None]
            logs = np.log(np.maximum(cell, 1))
            logs *= cell
            logs -= before
            first = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
            gain[r[first]] += np.add.reduceat(logs, first, axis=0)
    both = left + right + own[:, None]
    gain += _xlogx(corner + both) - _xlogx(corner + left) - _xlogx(corner + right) + _xlogx(corner)
    gain -= _xlogx(down + (right.sum(1) + own)[:, None]) - _xlogx(down) + _xlogx(across + (left.sum(1) + own)[:, None]) - _xlogx(across)
    gain[:, 0] = -np.inf
    best = gain.argmax(1)
    stay = np.flatnonzero((was > 0) & (gain[np.arange(len(words)), np.maximum(was, 0)] >= gain.max(1) - 1e-9))
    best[stay] = was[stay]
    return words, best


def _judge(state):
    def run(table: pa.Table) -> pa.Table:
        where, many, grid = state.value
        width = 2 * many + 1
        keys, n = [], []
        for raw in table.column("counts"):
            found = np.frombuffer(zlib.decompress(raw.as_py()), np.int64)
            keys.append(np.cumsum(found[: len(found) // 2]))
            n.append(found[len(found) // 2 :])
        keys, n = np.concatenate(keys), np.concatenate(n)
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        keys, n = keys[first], np.add.reduceat(n[order], first)
        word = keys // width
        words, best = moves(word, keys % width, n, where[np.unique(word)].astype(np.int64), grid)
        return pa.table({"word": pa.array(words.astype(np.int32)), "class": pa.array(best.astype(np.int32))})

    return run


def _xlogx(x: np.ndarray) -> np.ndarray:
    """Of counts."""
    return x * np.log(np.maximum(x, 1))


def exchange(counts: np.ndarray, classes: int, fixed: int, sweeps: int = 4) -> np.ndarray:
    """A class for each type from the counts of adjacent types; the type `fixed` alone has class 0.

    Types, in order of frequency, go to the class that loses least mutual information; the most
    frequent ones start a class each, and later sweeps take each type out and put it back.
    """
    n = len(counts)
    total = counts.sum(0) + counts.sum(1)
    order = [k for k in np.argsort(-total, kind="stable").tolist() if k != fixed]
    where = np.full(n, -1)
    where[fixed] = 0
    for k, x in enumerate(order[: classes - 1]):
        where[x] = k + 1
    member = np.zeros((n, classes))
    member[np.flatnonzero(where >= 0), where[where >= 0]] = 1
    grid = member.T @ counts @ member

    def best(x: int, left: np.ndarray, right: np.ndarray, own: float) -> int:
        down, across = grid.sum(1), grid.sum(0)
        gain = (_xlogx(grid + left[:, None]) - _xlogx(grid)).sum(0) + (_xlogx(grid + right[None, :]) - _xlogx(grid)).sum(1)
        d = np.diag(grid)
        gain += _xlogx(d + left + right + own) - _xlogx(d + left) - _xlogx(d + right) + _xlogx(d)
        gain -= _xlogx(down + right.sum() + own) - _xlogx(down) + _xlogx(across + left.sum() + own) - _xlogx(across)
        gain[0] = -np.inf
        return int(np.argmax(gain))

    for sweep in range(sweeps):
        moved = 0
        for x in order:
            was = where[x]
            if sweep == 0 and was >= 0:
                continue
            if was >= 0:
                member[x, was] = 0
            left, right, own = counts[:, x] @ member, counts[x] @ member, counts[x, x]
            if was >= 0:
                grid[:, was] -= left
                grid[was] -= right
                grid[was, was] -= own
            to = best(x, left, right, own) if total[x] else max(was, 1)
            member[x, to] = 1
            grid[:, to] += left
            grid[to] += right
            grid[to, to] += own
            moved += to != was
            where[x] = to
        if not moved:
            break
    return where


class Model:
    """Words by hash with their numbers, classes of types, and log10 probabilities."""

    def __init__(self, own, own_type, where, transition, emit, plain, unseen, discount, tokens, distinct, ends):
        self.own, self.own_type, self.where = own, own_type, where
        self.transition, self.emit, self.plain, self.unseen = transition, emit, plain, unseen
        self.discount, self.tokens, self.distinct, self.ends = discount, tokens, distinct, ends


def cluster(coded: DataFrame, words: int, classes: int, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """A class for each type (-1 for those that never occur), and the counts of adjacent classes."""
    spark = coded.sparkSession
    types = words + SPELLINGS + 1
    end, top = types - 1, min(TOP, words)

    def counted(where: np.ndarray, many: int) -> np.ndarray:
        held = spark.sparkContext.broadcast((where, many))
        found = t.map_arrow(coded, _adjacent(held), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # many * many rows at most
        grid = np.zeros(many * many)
        grid[found.column("pair").to_numpy()] = found.column("n").to_numpy()
        held.destroy()
        return grid.reshape(many, many)

    # the most frequent words, each a class of its own for now, are exchanged here
    first = np.full(types, -1, np.int16)
    first[:top], first[end] = np.arange(top), top
    where = np.full(types, -1, np.int16)
    found = exchange(counted(first, top + 1), classes, top)
    where[:top], where[end] = found[:top], 0
    grid = counted(where, classes)
    blocks = -(-types // BLOCK)
    for part in [-1, *list(range(2)) * sweeps]:
        held = spark.sparkContext.broadcast((where, classes))
        state = spark.sparkContext.broadcast((where, classes, grid))
        around = t.map_arrow(coded, _neighbours(held, part, 2, blocks), "block int, counts binary")
        moved = around.groupBy("block").applyInArrow(_judge(state), "word int, class int").toArrow()  # a row for each word of the vocabulary
        where = where.copy()
        where[moved.column("word").to_numpy()] = moved.column("class").to_numpy()
        grid = counted(where, classes)
        held.destroy()
        state.destroy()
    return where, grid


def fit(docs: DataFrame, text: str = "text", least: int = LEAST, classes: int | None = None, sweeps: int = SWEEPS) -> tuple[Model, DataFrame]:
    """The model, and the table of counts (h, n) of all words of docs."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("_text"))
    counts = t.stored(t.map_arrow(texts, _count, "h long, n long, spelling int").groupBy("h").agg(F.sum("n").alias("n"), F.first("spelling").alias("spelling")), "counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    top = counts.where(F.col("n") >= least).select("h", "n").toArrow()  # the vocabulary
    h, n = top.column("h").to_numpy(), top.column("n").to_numpy()
    order = np.lexsort((h, -n))
    h, n = h[order].view(np.uint64), n[order]
    words = len(h)
    end = words + SPELLINGS
    types = end + 1
    classes = classes or max(8, round(1.5 * words ** (1 / 3)))
    rare = F.col("n") < least
    by_type = counts.where(rare).groupBy("spelling").agg(F.sum("n"), F.count(F.lit(1)), F.count(F.when(F.col("n") == 1, 1)), F.count(F.when(F.col("n") == 2, 1))).collect()  # SPELLINGS rows at most
    size, many, once, twice = (np.zeros(types) for _ in range(4))
    size[:words], many[:words] = n, 1
    for row in by_type:
        k = words + row[0]
        size[k], many[k], once[k], twice[k] = row[1:]
    distinct = int(many.sum())
    all_once, all_twice = once.sum(), twice.sum()
    discount = float(np.clip(all_once / (all_once + 2 * all_twice), 0.1, 0.95)) if all_once and all_twice else 0.5
    order = np.argsort(h)
    own, own_type = h[order], order.astype(np.int32)
    vocabulary = spark.sparkContext.broadcast((own, own_type))
    coded = t.stored(t.map_arrow(texts, _code(vocabulary), "seq array<int>"), "coded")
    where, follow = cluster(coded, words, classes, sweeps)
    ends = int(follow[:, 0].sum())
    size[end], many[end] = ends, 1
    where = where.astype(np.int64)
    where[where < 0] = classes - 1  # types that never occur
    share = (follow.sum(0) + 0.5) / (follow.sum() + 0.5 * classes)
    transition = np.log10((follow + 5 * share[None, :]) / (follow.sum(1, keepdims=True) + 5))
    in_class = np.bincount(where, size + 0.5, classes)
    # of a word: log10 of its share of its class; of a spelling: the same over its tokens, and the word's own count, less the discount, is added
    emit = np.log10((size + 0.5) / in_class[where])
    emit[words:end] -= np.log10(np.maximum(size[words:end], 1))
    missing = np.maximum(once**2 / np.maximum(2 * twice, 1), 1)
    unseen = np.log10(np.maximum(discount * many, 0.5) / missing)
    return Model(own, own_type, where, transition, emit, np.log10(size + 1.0), unseen, discount, int(total) + ends, distinct + (ends > 0), ends), counts.select("h", "n")


def _score(model, carry: int):
    def run(batches):
        m = model.value
        base = TaskContext.get().partitionId() << 33
        names = None
        for batch in t.sliced(batches, "_text"):
            words = t.Words(batch.column(batch.schema.get_field_index("_text")), t.SPACED, t.LOWER)
            rows = batch.num_rows
            h, kind = _types(words, m.own, m.own_type)
            inside, end = kind < len(m.own), len(m.own) + SPELLINGS
            codes, row = words.codes, words.rows()
            seq, ends = _with_ends(m.where[kind][codes] if len(codes) else np.zeros(0, np.int64), words.at, 0)
            step = m.transition[np.concatenate(([0], seq[:-1])), seq]
            total = np.add.reduceat(step, ends[:-1]) if rows else step
            total += np.bincount(row, m.emit[kind][codes] if len(codes) else None, rows) + m.emit[end]
            flat = np.bincount(row, np.where(inside, m.plain[kind], 0)[codes] if len(codes) else None, rows) + np.log10(m.ends + 1.0)
            known = np.bincount(row, inside[codes] if len(codes) else None, rows).astype(np.int64) + (m.ends > 0)
            n = np.diff(words.at) + 1
            flat -= n * np.log10(m.tokens + m.distinct + 1.0)
            ids = base + np.arange(rows)
            base += rows
            names = names or [*batch.schema.names[:carry], "_row", "n_tokens", "known", "base", "score", "h", "times", "unseen"]
            nothing = [pa.nulls(rows, kind) for kind in (pa.int64(), pa.int64(), pa.float64())]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(carry)], pa.array(ids), pa.array(n), pa.array(known), pa.array(flat), pa.array(total), *nothing], names)
            rare = np.flatnonzero(~inside[codes]) if len(codes) else np.zeros(0, np.int64)
            if len(rare):
                keys, times = np.unique(row[rare] * len(h) + codes[rare], return_counts=True)
                r, w = keys // len(h), keys % len(h)
                blank = [pa.nulls(len(r), batch.schema.field(k).type) for k in range(carry)]
                empty = [pa.nulls(len(r), kind) for kind in (pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                yield pa.RecordBatch.from_arrays([*blank, pa.array(ids[r]), *empty, pa.array(h[w].view(np.int64)), pa.array(times), pa.array(m.unseen[kind[w]])], names)

    return run


def score(docs: DataFrame, model: Model, counts: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `carry` of docs with n_tokens, n_known, base_score and score."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*carry, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1])
    rows = t.stored(t.map_arrow(source, _score(held, len(carry)), f"{kinds}, _row long, n_tokens long, known long, base double, score double, h long, times long, unseen double"), "scores")
    rare = rows.where("h is not null").select("_row", "h", "times", "unseen").join(counts, "h", "left")
    found = F.col("n").isNotNull()
    added = rare.groupBy("_row").agg(
        F.sum(F.when(found, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * F.when(found, F.log10(F.col("n") + 1.0)).otherwise(0.0)).alias("more_base"),
        F.sum(F.col("times") * F.when(found, F.log10(F.col("n") - model.discount)).otherwise(F.col("unseen"))).alias("more_score"),
    )
    out = rows.where("h is null").join(added, "_row", "left")
    return out.select(*carry, "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"), (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"))


def held_out(id: Column) -> Column:
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def op4_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's log10 probability, learned from those whose crc32 remainder by 7 is not 2."""
    docs = t.table(spark, sf_dir, "documents")
    model, counts = fit(docs.where(~held_out(F.col("doc_id"))))
    found = score(docs, model, counts)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
