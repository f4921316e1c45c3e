"""Sequence packing as a cutting-stock problem, solved by column generation.

Texts are tokenised; an end id follows each. A document of more than `size` ids is cut into full
sequences and one rest. The rests, in length classes of `grain` ids, are packed by patterns (how
many pieces of each class go into one sequence): a linear program over the histogram of classes
says how often each pattern is used, and a knapsack dynamic program over its dual prices finds the
next pattern worth adding, until the Farley bound says that nothing much is left to gain. Patterns
are rounded down; the few pieces over, fewer than a pattern for each class, are packed by first fit
of decreasing classes. Pieces are ranked within their class and dealt to the patterns by rank.

Rows: a null or empty text is one piece of the end id alone; repeated rows and ids are packed each
on its own; a null id is passed through; an empty table gives no piece. Other columns, whatever
their names, are not read.

Scale: pieces are a few numbers each and are written once; texts are never shuffled. Ranks come
from a count for each writing task and class plus the place within that task, so no global sort or
single task is needed. The driver sees the histogram (size / grain numbers) and the patterns (no
more than a few for each class), whatever the input. Sequences are numbered by arithmetic.

The tokenizer's file is a parameter and must be found on the executors. Words are tokenised apart
and remembered, which is exact for a tokenizer that drops white space before it splits, as the one
named by default does (see Coder); `by_word=False` tokenises whole texts for others.
"""

from __future__ import annotations

import zlib
from functools import lru_cache
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _text as t

SIZE, GRAIN, END = 2048, 8, 1
#: Words of a worker's memory when it begins the next of its two generations.
REMEMBERED = 200_000
#: Ids never reach over a change between these two classes: ASCII letters and digits, and ASCII
#: punctuation but the apostrophe (which may begin a contraction).
JOINTS = np.zeros(256, np.uint8)
JOINTS[33:127] = 2
JOINTS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 1
JOINTS[39] = 0


class Coder:
    """Ids of slices of texts. By word, it holds for a tokenizer that lower-cases, drops white space
    and splits between letters or digits and punctuation before it looks at its vocabulary."""

    def __init__(self, path: str, by_word: bool):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.by_word = Tokenizer.from_file(path), by_word
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        # of a vocabulary that marks the ends of words: which ids are such ends
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.ends[[k for x, k in vocab.items() if x.endswith("</w>")]] = True

    def _split(self, texts: list[str]) -> tuple[np.ndarray, list[int]]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(ids), self.kind), np.cumsum([0, *map(len, ids)]).tolist()

    def _encode(self, words: list[str]) -> list[bytes]:
        """Words of letters are tokenised as one text, and told apart by the ids that end a word, if
        there are as many of these as words; all others are texts of their own."""
        letters = list(map(str.isalpha, words))
        joined = list(compress(words, letters)) if self.ends.any() else []
        flat, _ = self._split([" ".join(joined[a : a + 500]) for a in range(0, len(joined), 500)])
        at = np.append(0, np.flatnonzero(self.ends[flat]) + 1).tolist()
        if len(at) != len(joined) + 1:
            joined = []
        if not joined:
            letters = [False] * len(words)
        apart, spots = self._split([w for w, x in zip(words, letters) if not x])
        one, two = flat.tobytes(), apart.tobytes()
        size = self.kind().itemsize
        known, rest = (iter([raw[a * size : b * size] for a, b in zip(x, x[1:])]) for raw, x in ((one, at), (two, spots)))
        return [next(known) if x else next(rest) for x in letters]

    def _ids(self, words: list[bytes]) -> list[bytes]:
        """From memory where known. Two generations: words of the older one are taken over as they occur."""
        out = list(map(self.known.get, words))
        new = []
        for k in [k for k, x in enumerate(out) if x is None]:
            x = self.before.get(words[k])
            if x is None:
                new.append(k)
            else:
                out[k] = self.known[words[k]] = x
        for a in range(0, len(new), 20_000):
            some = new[a : a + 20_000]
            for k, x in zip(some, self._encode([words[k].decode() for k in some])):
                out[k] = self.known[words[k]] = x
        if len(self.known) > REMEMBERED:
            self.before, self.known = self.known, {}
        return out

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the offset of each text's first, one more than texts."""
        if not self.by_word:
            found = [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast([x or "" for x in texts.to_pylist()], add_special_tokens=False)]
            return np.concatenate([np.zeros(0, self.kind), *found]), np.cumsum([0, *map(len, found)])
        special = pa.compute.any(pa.compute.match_substring(texts, "<|")).as_py()  # these may be ids of their own, and only as they are written
        words = t.Words(texts, t.SPACED, None) if special else t.Words(texts, t.SPACED, t.LOWER, JOINTS)
        known = self._ids(words.vocab.to_pylist())
        flat = np.frombuffer(b"".join(known), self.kind)
        size = np.fromiter(map(len, known), np.int64, len(known)) // self.kind().itemsize
        first = np.cumsum(size) - size
        sizes = size[words.codes]
        at = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=at[1:])
        index = np.repeat(first[words.codes] - at[:-1], sizes)
        index += np.arange(at[-1])
        return flat[index], at[words.at]


    def forget(self) -> None:
        self.known, self.before = {}, {}


@lru_cache(maxsize=1)
def coder(path: str, by_word: bool) -> Coder:
    """A worker keeps the tokenizer from task to task; its words it forgets after each, as idle workers
    of several stages would add up."""
    return Coder(path, by_word)


def pieces(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", size: int = SIZE, grain: int = GRAIN, end: int = END, by_word: bool = True, with_ids: bool = False) -> DataFrame:
    """One row per piece: the id, start, length, ids_crc32, doc_tokens, its class and its place
    (writing task, place of that class within the task); with_ids adds the ids themselves."""
    kind = docs.schema[id].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "task", "place", *["ids"] * with_ids]
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, class int, task long, place long" + ", ids array<int>" * with_ids

    def run(batches):
        encode, task, counts = coder(path, by_word), TaskContext.get().partitionId(), np.zeros(size // grain + 2, np.int64)
        for batch in t.sliced(batches, "_text", 4 << 20):
            ids, at = encode(batch.column(1))
            lengths = np.diff(at) + 1
            number = -(-lengths // size)
            rows = np.repeat(np.arange(batch.num_rows), number)
            starts = (np.arange(len(rows)) - np.repeat(np.cumsum(number) - number, number)) * size
            sizes = np.minimum(size, lengths[rows] - starts)
            crc, own = np.zeros(len(rows), np.int64), []
            for k, (r, a, n) in enumerate(zip(rows.tolist(), starts.tolist(), sizes.tolist())):
                body = ids[at[r] + a : min(at[r] + a + n, at[r + 1])].astype("<u4")
                if len(body) < n:
                    body = np.append(body, np.array([end], "<u4"))
                crc[k] = zlib.crc32(body)
                if with_ids:
                    own.append(body.astype(np.int32))
            kinds = -(-sizes // grain)
            order = np.argsort(kinds, kind="stable")
            _, first, many = np.unique(kinds[order], return_index=True, return_counts=True)
            place = np.empty(len(rows), np.int64)
            place[order] = np.arange(len(rows)) - np.repeat(first, many) + counts[kinds[order]]
            counts += np.bincount(kinds, minlength=len(counts))
            columns = [batch.column(0).take(pa.array(rows)), pa.array(starts), pa.array(sizes), pa.array(crc), pa.array(lengths[rows]), pa.array(kinds.astype(np.int32)), pa.array(np.full(len(rows), task, np.int64)), pa.array(place)]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(own, pa.list_(pa.int32()))] * with_ids, names)
        encode.forget()

    return t.map_arrow(docs.select(F.col(id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")), run, schema)


def _knapsack(price: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of the greatest total price; price[s] is for a piece of s units, 0 where there is none."""
    best, taken = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        values = price[1 : c + 1] + best[c - 1 :: -1] if c > 1 else price[1:2] + best[:1]
        k = int(np.argmax(values))
        best[c], taken[c] = values[k], k + 1
    pattern, c = np.zeros(capacity + 1, np.int64), capacity
    while c > 0:
        if price[taken[c]] > 0:
            pattern[taken[c]] += 1
        c -= taken[c]
    return float(best[capacity]), pattern


def _inverse(a: np.ndarray) -> np.ndarray:
    """By Gauss-Jordan elimination with row exchanges. The matrices are small, and a threaded LAPACK may
    hang in a driver that has forked."""
    n = len(a)
    both = np.hstack([a.astype(float), np.eye(n)])
    for k in range(n):
        p = k + int(np.argmax(np.abs(both[k:, k])))
        if p != k:
            both[[k, p]] = both[[p, k]]
        both[k] /= both[k, k]
        factor = both[:, k].copy()
        factor[k] = 0
        both -= factor[:, None] * both[k]
    return both[:, n:]


def _apply(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,j->i", a, x)


def column_generation(demand: np.ndarray, gap: float = 1e-3, rounds: int = 2000) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often to use them, for demand[s] pieces of s units in stock of len(demand) - 1 units."""
    capacity = len(demand) - 1
    sizes = np.flatnonzero(demand > 0)
    if not len(sizes):
        return []
    need, m = demand[sizes].astype(float), len(sizes)
    basis = np.zeros((m, m))  # a column per pattern
    np.fill_diagonal(basis, capacity // sizes)
    left = need.copy()
    for k in range(m - 1, -1, -1):  # first fit of decreasing classes, each pattern (in part) until it uses up a class
        while left[k] > 0:
            pattern, room = np.zeros(m), capacity
            for j in range(k, -1, -1):
                if left[j] > 0:
                    pattern[j] = room // sizes[j]
                    room -= pattern[j] * sizes[j]
            used = np.flatnonzero(pattern)
            ended = used[np.argmin(left[used] / pattern[used])]
            left -= pattern * (left[ended] / pattern[ended])
            left[ended] = 0
            left = np.maximum(left, 0)
            basis[:, ended] = pattern
    inverse = _inverse(basis)
    x = np.maximum(_apply(inverse, need), 0)
    bound = (need * sizes).sum() / capacity
    for step in range(rounds):
        dual = inverse.sum(0)
        price = np.zeros(capacity + 1)
        price[sizes] = np.maximum(dual, 0)
        worth, pattern = _knapsack(price, capacity)
        bound = max(bound, (price[sizes] * need).sum() / max(worth, 1.0))
        if worth <= 1 + 1e-9 or x.sum() - bound <= max(gap * bound, 0.5):
            break
        column = pattern[sizes].astype(float)
        d = _apply(inverse, column)
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        leave = int(np.argmin(ratio))
        if not np.isfinite(ratio[leave]):
            break
        basis[:, leave] = column
        if step % 50 == 49:
            inverse = _inverse(basis)
        else:
            row = inverse[leave] / d[leave]
            inverse -= np.outer(d, row)
            inverse[leave] = row
        x = np.maximum(_apply(inverse, need), 0)
    left, out = demand.copy(), []
    for k in np.argsort(-x, kind="stable"):
        pattern = np.zeros(capacity + 1, np.int64)
        pattern[sizes] = np.round(basis[:, k]).astype(np.int64)
        used = pattern > 0
        times = min(int(x[k] + 1e-6), int((left[used] // pattern[used]).min()) if used.any() else 0)
        if times:
            out.append((pattern, times))
            left = left - pattern * times
    bins: list[list[int]] = []
    room: list[int] = []
    for s in range(capacity, 0, -1):
        for _ in range(int(left[s])):
            spot = next((k for k, r in enumerate(room) if r >= s), None)
            if spot is None:
                bins.append([])
                room.append(capacity)
                spot = len(room) - 1
            bins[spot].append(s)
            room[spot] -= s
    for b in bins:
        out.append((np.bincount(b, minlength=capacity + 1), 1))
    return out


def _plan(demand: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(class, first rank, rank after the last, pieces of it in one sequence, first sequence) for each
    class of each pattern; full pieces, the last class, are sequences alone."""
    full = int(demand[-1])
    rest = demand.copy()
    rest[-1] = 0
    ranks, sequence, out = np.zeros(len(demand), np.int64), full, [(len(demand) - 1, 0, full, 1, 0)] if full else []
    for pattern, times in column_generation(rest):
        for s in np.flatnonzero(pattern):
            many = int(pattern[s])
            out.append((int(s), int(ranks[s]), int(ranks[s]) + many * times, many, sequence))
            ranks[s] += many * times
        sequence += times
    return out


def pack(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", size: int = SIZE, grain: int = GRAIN, end: int = END, by_word: bool = True, with_ids: bool = False) -> DataFrame:
    """Pieces with their sequence_id and offset there."""
    spark = docs.sparkSession
    rows = t.stored(pieces(docs, path, id, text, size, grain, end, by_word, with_ids), "pieces")
    counts = rows.groupBy("class", "task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("class").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("class", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    demand = np.zeros(size // grain + 1, np.int64)
    for kind, n in counts.groupBy("class").agg(F.sum("n")).collect():  # size / grain rows at most
        demand[kind] = n
    plan = spark.createDataFrame(_plan(demand), "class int, low long, high long, many int, first long")
    ranked = rows.join(bases, ["class", "task"]).withColumn("rank", F.col("base") + F.col("place"))
    ranges = plan.groupBy("class").agg(F.sort_array(F.collect_list(F.struct("low", "high", "many", "first"))).alias("ranges"))
    part = F.filter("ranges", lambda r: (r["low"] <= F.col("rank")) & (F.col("rank") < r["high"]))[0]
    dealt = ranked.join(F.broadcast(ranges), "class").withColumn("r", part)
    step = F.col("rank") - F.col("r.low")
    dealt = dealt.withColumn("sequence_id", F.col("r.first") + (step / F.col("r.many")).cast("long"))
    order = Window.partitionBy("sequence_id").orderBy(F.desc("class"), "rank")
    offset = F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    return dealt.withColumn("offset", offset).select(*[F.col("doc_id").alias(id)], "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of 2048 ids."""
    return pack(t.table(spark, sf_dir, "documents"), default_tokenizer())
