"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Items are normalised to lower-cased words, and one automaton over all of them streams the words of
a text, tracking the longest match that ends at each word. Where that match reaches the window
length, the last `window` words are a passage of some item. Items shorter than the window count
when the whole item occurs. Texts are streamed only over stretches whose adjacent word pairs all
occur in some item (no window can lie outside them), which a sorted lookup finds for whole slices.

Rows: a null or empty text has no words and is clean; repeated rows and repeated ids are judged
alone; null ids pass through; columns beyond the named ones are carried by `clean` and dropped by
`hits`. Items that are null, empty or without words match nothing; items with equal texts are all
reported. An empty benchmark leaves every text clean.

Scale: texts are never shuffled. The benchmark is cut into blocks of about `block_words` words (an
automaton takes some 0.9 KB a word), and texts pass the blocks one after the other, with a table of
them in the shared folder after each but the last: one automaton is built and broadcast at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text as t

WINDOW = 10
BLOCK_WORDS = 1 << 18


class Automaton:
    """Generalised suffix automaton over word ids, with the items that each state's strings occur in."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[tuple[int, int, int]] = []
        seqs = []
        for name, words in items:
            if words:
                seqs.append((name, [self.vocab.setdefault(w, len(self.vocab)) for w in words]))
        self.names = [name for name, _ in seqs]
        for _, seq in seqs:
            last = 0
            for w in seq:
                last = self._extend(last, w)
        owners = [set() for _ in self.length]
        self.short: dict[int, list[tuple[int, int]]] = {}
        for k, (_, seq) in enumerate(seqs):
            state = 0
            for w in seq:
                state = self.next[state][w]
                owners[state].add(k)
            ends.append((k, state, len(seq)))
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                owners[self.link[state]] |= owners[state]
        # only these are asked for: the states that hold a string of a window's length
        self.owners = {s: x for s, x in enumerate(owners) if s and self.length[self.link[s]] < window <= self.length[s]}
        for k, state, n in ends:
            if n < window:
                self.short.setdefault(state, []).append((n, k))
        self.least = min([window, *(n for _, _, n in ends)]) if ends else 0
        v = max(len(self.vocab), 1)
        self.pairs = np.unique(np.fromiter((a * v + b for _, seq in seqs for a, b in zip(seq, seq[1:])), np.int64))

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur = len(length)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        c = len(length)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = c
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = c
            p = link[p]
        return c

    def stream(self, ids: list[int]) -> Iterator[tuple[int, int, int]]:
        """(position, state, longest match that ends there) for each word."""
        nxt, link, length = self.next, self.link, self.length
        state = got = 0
        for i, w in enumerate(ids):
            while state and w not in nxt[state]:
                state = link[state]
                got = length[state]
            if w in nxt[state]:
                state = nxt[state][w]
                got += 1
            else:
                got = 0
            yield i, state, got

    def found(self, state: int, got: int) -> tuple[int, set[int]]:
        """The longest window that ends with this match, and the items with any window that does."""
        n, out, s = 0, set(), state
        while s > 0:
            low, high = self.length[self.link[s]], min(got, self.length[s])
            if low < self.window <= high:
                n = self.window
                out |= self.owners[s]
            for size, k in self.short.get(s, ()):
                if low < size <= high:
                    n = max(n, size)
                    out.add(k)
            s = self.link[s]
        return n, out


def _scan(auto: Automaton, words: t.Words) -> tuple[np.ndarray, dict[int, set[int]]]:
    """Flag of each word that a window covers, and the items of each row with any."""
    n = len(words.codes)
    hit = np.zeros(n, bool)
    rows: dict[int, set[int]] = {}
    if not n or not auto.names:
        return hit, rows
    get = auto.vocab.get
    ids = np.fromiter((get(w, -1) for w in words.vocab.to_pylist()), np.int64, len(words.vocab))[words.codes]
    known = ids >= 0
    if auto.least > 1:
        joined = known[:-1] & known[1:]
        firsts = words.at[(words.at > 0) & (words.at < n)]
        joined[firsts - 1] = False
        spots = np.flatnonzero(joined)
        keys = ids[spots] * len(auto.vocab) + ids[spots + 1]
        joined[spots] = np.isin(keys, auto.pairs)
        edge = np.diff(np.concatenate(([0], joined.astype(np.int8), [0])))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
        keep = last - first >= auto.least
        first, last = first[keep], last[keep]
    else:
        alone = known.copy()
        firsts = np.zeros(n + 1, bool)
        firsts[words.at] = True
        begins = alone & (np.concatenate(([True], ~alone[:-1])) | firsts[:-1])
        first = np.flatnonzero(begins)
        stops = alone & (np.concatenate((~alone[1:], [True])) | firsts[1:])
        last = np.flatnonzero(stops) + 1
    memo: dict[tuple[int, int], tuple[int, set[int]]] = {}
    for a, b, row in zip(first.tolist(), last.tolist(), (np.searchsorted(words.at, first, "right") - 1).tolist()):
        for i, state, got in auto.stream(ids[a:b].tolist()):
            if got < auto.least:
                continue
            key = (state, min(got, auto.window))
            if key not in memo:
                memo[key] = auto.found(*key)
            size, items = memo[key]
            if size:
                hit[a + i - size + 1 : a + i + 1] = True
                rows.setdefault(row, set()).update(items)
    return hit, rows


def _blocks(items: DataFrame, id_column: str, text_column: str, block_words: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Normalised items in blocks of about block_words words; rows come to the driver one partition at a time."""
    pattern = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = bytes(t.LOWER)
    block, size = [], 0
    for name, text in items.select(F.col(id_column), F.col(text_column)).toLocalIterator():
        words = pattern.findall((text or "").encode().translate(lower))
        if not words:
            continue
        block.append((name, words))
        size += len(words)
        if size >= block_words:
            yield block
            block, size = [], 0
    if block:
        yield block


def hits(docs: DataFrame, items: DataFrame, carry: list[str], text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The columns `carry` and `text` of docs, with `_words` (count), `_hits` (flat begin, end pairs of
    covered word positions) and `_items` (distinct items, as strings)."""
    spark = docs.sparkSession
    extra = T.StructType([T.StructField("_words", T.LongType()), T.StructField("_hits", T.ArrayType(T.IntegerType())), T.StructField("_items", T.ArrayType(T.StringType()))])
    out = docs.select(*dict.fromkeys([*carry, text])).withColumns({"_words": F.lit(None).cast("long"), "_hits": F.array().cast("array<int>"), "_items": F.array().cast("array<string>")})
    schema = T.StructType([f for f in out.schema if f.name not in ("_words", "_hits", "_items")] + extra.fields)
    blocks = _blocks(items, item_id, item_text, block_words)
    block = next(blocks, [])  # with an empty benchmark the words are counted all the same
    while True:
        held = spark.sparkContext.broadcast(Automaton(block, window))
        out = _pass(out, schema, text, held)
        block = next(blocks, None)
        if block is None:
            return out
        out = t.stored(out, "hits")
        held.destroy()


def _pass(docs: DataFrame, schema: T.StructType, text: str, held) -> DataFrame:
    """docs after the automaton that `held`, a broadcast, holds."""
    plain = [f.name for f in schema if f.name not in ("_words", "_hits", "_items")]

    def run(batches):
        auto = held.value
        names = [str(x) for x in auto.names]
        for batch in t.sliced(batches, text):
            words = t.Words(batch.column(batch.schema.get_field_index(text)), t.ALNUM, t.LOWER)
            hit, rows = _scan(auto, words)
            before_hits = batch.column(batch.schema.get_field_index("_hits"))
            before_items = batch.column(batch.schema.get_field_index("_items"))
            spans, found = [], []
            for r in range(batch.num_rows):
                old, had = before_hits[r].as_py() or [], before_items[r].as_py() or []
                if r in rows:
                    flags = hit[words.at[r] : words.at[r + 1]].copy()
                    for a, b in zip(old[::2], old[1::2]):
                        flags[a:b] = True
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
                    old, had = edge.tolist(), sorted({*had, *(names[k] for k in rows[r])})
                spans.append(old)
                found.append(had)
            columns = [batch.column(batch.schema.get_field_index(c)) for c in plain]
            columns += [pa.array(np.diff(words.at), pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, [*plain, "_words", "_hits", "_items"])

    return t.map_arrow(docs, run, schema)


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, max_span: int = WINDOW, max_coverage: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with all their columns, less every covered span of at least max_span words (from its first
    word to its last), or of less than a window, which only whole short items cover, and less the rows of which more than max_coverage of the words are covered."""
    names = docs.columns
    docs, (text,) = t.renamed(docs, text)
    columns = docs.columns
    found = hits(docs, items, columns, text, item_id, item_text, window, block_words)
    kept = found.where(F.col("_words").eqNullSafe(0) | (_covered() <= F.lit(max_coverage) * F.col("_words")))
    schema = T.StructType([f for f in kept.schema if f.name in columns])

    def run(batches):
        for batch in t.sliced(batches, text):
            column = batch.column(batch.schema.get_field_index(text))
            spans = batch.column(batch.schema.get_field_index("_hits"))
            if pa.compute.max(pa.compute.list_value_length(spans)).as_py():
                words = t.Words(column, t.ALNUM, t.LOWER)
                out = column.to_pylist()
                for r, pairs in enumerate(spans.to_pylist()):
                    raw = bytes(words.data[words.row_at[r] : words.row_at[r + 1]]) if pairs else b""
                    for a, b in reversed(list(zip(pairs[::2], pairs[1::2]))):
                        if b - a >= max_span or b - a < window:
                            w = words.at[r]
                            raw = raw[: words.start[w + a] - words.row_at[r]] + raw[words.end[w + b - 1] - words.row_at[r] :]
                    if pairs:
                        out[r] = raw.decode()
                column = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays([column if f.name == text else batch.column(batch.schema.get_field_index(f.name)) for f in schema], names=schema.names)

    return t.map_arrow(kept, run, schema).select(*columns).toDF(*names)


def _covered():
    return F.aggregate("_hits", F.struct(F.lit(0).alias("n"), F.lit(-1).alias("sign")), lambda s, x: F.struct((s["n"] + s["sign"] * x).alias("n"), (-s["sign"]).alias("sign")), lambda s: s["n"].cast("long"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's words that lie in windows of the benchmark, and the items they come from."""
    found = hits(t.table(spark, sf_dir, "documents"), t.table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select(
        "doc_id",
        F.col("_words").alias("n_words"),
        _covered().alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
        (F.size("_hits") > 0).alias("contaminated"),
    )


OP9_SQL = r"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS rid, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM documents
), b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM benchmark
), items AS (
  SELECT item_id, ws, least(len(ws), 10) AS k FROM b WHERE len(ws) > 0
), iw AS (
  SELECT DISTINCT item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS win
  FROM (SELECT item_id, ws, k, unnest(range(1, CAST(len(ws) - k + 2 AS BIGINT))) AS i FROM items)
), ks AS (
  SELECT DISTINCT k FROM items
), dw AS (
  SELECT rid, i, k, array_to_string(ws[i:i + k - 1], ' ') AS win
  FROM (SELECT rid, ws, k, unnest(range(1, CAST(len(ws) - k + 2 AS BIGINT))) AS i FROM docs, ks WHERE len(ws) >= k)
), m AS (
  SELECT rid, i, dw.k AS k, item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.k = iw.k
), h AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT rid, i, k FROM m)) GROUP BY rid
), f AS (
  SELECT rid, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS name FROM m) GROUP BY rid
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN h USING (rid) LEFT JOIN f USING (rid)
"""
