"""Substring de-duplication by level-wise doubling of repeated word windows.

A window of `window` words is removed if its word sequence starts anywhere else in the input, the
same row included. The search goes by levels of doubled length: windows that are repeated at one
length alone are extended to twice that length, until the full length is reached or no candidate
survives.

- Level 1 (quarter length): of each full window, only its minimiser, the short window of least
  hash, is looked at. Two equal full windows have equal minimisers at equal places, so nothing is
  lost, and about one word in fourteen yields a row instead of every word.
- Level 2 (half length): surviving minimisers are extended by their own length to the right and to
  the left. A full window always contains one of the two, so it survives only if that is repeated.
- Level 3 (full length): the full windows whose minimisers survived both levels are counted, by 96
  bits of hash. What is repeated is removed.

Rows: words are `[^\\x20\\x09-\\x0D]+`; null and empty texts have none and nothing is removed; texts
below `window` words have no window. Repeated rows are each other's repeats. A null id is a value
like any other. Other columns, whatever their names, are not read.

Scale: each level counts by a partial aggregate before the shuffle, and what is left of a hash that
occurs once is its place (see _alone); the next pass over the texts takes these places out. So nothing is
joined by a hash, and a passage in a third of all rows is one row of each task; exact copies are told
by the key of the one that stands for them. No group is gathered but the window starts of one row,
bounded by that row's length. Rows are told apart by 64 bits of hash of id and text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as t

WINDOW = 35
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _level(window: int) -> int:
    return max(1, (window + 1) // 4)


def _slide(x: np.ndarray, width: int, f: np.ufunc) -> np.ndarray:
    """f over all runs of `width` values, by doubling."""
    size = 1
    while size * 2 <= width:
        x = f(x[:-size], x[size:])
        size *= 2
    return x if size == width else f(x[: len(x) - (width - size)], x[width - size :])


def _inside(at: np.ndarray, n: int, window: int) -> np.ndarray:
    """Whether the window that starts at each of n - window + 1 words lies in one row."""
    last = np.repeat(at[1:], np.diff(at))
    return np.arange(n - window + 1) + window <= last[: n - window + 1]


def _minimisers(h: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of short windows, the least in each full window (0 across rows), and whether each short window is one."""
    short = _level(window)
    hs = t.windows(h, short)
    width = window - short + 1
    low = _slide(hs, width, np.minimum)
    fine = _inside(at, len(h), window)
    low = np.where(fine, low, np.uint64(0))
    padded = np.concatenate((np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)))
    anchor = _slide(padded, width, np.maximum) == hs
    return hs, low, fine, anchor


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _take(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _placed(words: t.Words, starts: np.ndarray, batch: pa.RecordBatch, *hashes: pa.Array) -> pa.RecordBatch:
    """Windows that start at these words: hashes, key and weight of the row, place in it."""
    rows = np.searchsorted(words.at, starts, "right") - 1
    keys, weight = (_take(batch, c).to_numpy(zero_copy_only=False)[rows] for c in ("_key", "weight"))
    return pa.RecordBatch.from_arrays([*hashes, pa.array(keys), pa.array((starts - words.at[rows]).astype(np.int32)), pa.array(weight)], [*"hg"[: len(hashes)], "_key", "pos", "weight"])


def _spots(words: t.Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of short windows, and the words at which minimisers start."""
    hs, _, _, anchor = _minimisers(words.hashes(), words.at, window)
    return hs, np.flatnonzero(anchor & (hs != 0))


def _level_1(window: int):
    def run(batches):
        for batch in t.sliced(batches, "_text"):
            words = t.Words(_take(batch, "_text"), t.SPACED, None)
            if len(words.codes) >= window:
                hs, spots = _spots(words, window)
                yield _placed(words, spots, batch, _signed(hs[spots]))

    return run


def _starts(words: t.Words, batch: pa.RecordBatch, name: str) -> np.ndarray:
    """The words at the places of a list column."""
    column = _take(batch, name)
    sizes = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.repeat(words.at[:-1], sizes) + pa.compute.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.int64)


def _listed(starts: np.ndarray, at: np.ndarray) -> pa.ListArray:
    """Ascending words as one list of places per row."""
    offsets = np.searchsorted(starts, at).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array((starts - np.repeat(at[:-1], np.diff(offsets))).astype(np.int32)))


def _without(starts: np.ndarray, gone: np.ndarray, n: int) -> np.ndarray:
    kept = np.ones(n + 1, bool)
    kept[gone] = False
    return starts[kept[starts]]


def _anchored(window: int):
    """Rows that have minimisers that occur twice or more, with these."""

    def run(batches):
        for batch in t.sliced(batches, "_text"):
            words = t.Words(_take(batch, "_text"), t.SPACED, None)
            n = len(words.codes)
            if n < window:
                continue
            spots = _without(_spots(words, window)[1], _starts(words, batch, "alone"), n)
            anchors = _listed(spots, words.at)
            out = pa.RecordBatch.from_arrays([*(_take(batch, c) for c in ("_key", "_id", "_text", "weight")), anchors], ["_key", "_id", "_text", "weight", "anchors"])
            yield out.filter(pa.array(np.diff(anchors.offsets.to_numpy()) > 0))

    return run


def _doubles(words: t.Words, anchors: np.ndarray, short: int) -> np.ndarray:
    """The words at which minimisers extended to the right or to the left start, inside one row."""
    n = len(words.codes)
    if n < 2 * short:
        return np.zeros(0, np.int64)
    first = words.at[np.searchsorted(words.at, anchors, "right") - 1]
    starts = np.unique(np.concatenate((anchors, np.maximum(anchors - short, first))))
    starts = starts[starts + 2 * short <= n]
    return starts[_inside(words.at, n, 2 * short)[starts]]


def _level_2(window: int):
    short = _level(window)

    def run(batches):
        for batch in t.sliced(batches, "_text"):
            words = t.Words(_take(batch, "_text"), t.SPACED, None)
            starts = _doubles(words, _starts(words, batch, "anchors"), short)
            if len(starts):
                yield _placed(words, starts, batch, _signed(t.windows(words.hashes(), 2 * short)[starts]))

    return run


def _candidates(words: t.Words, batch: pa.RecordBatch, window: int, h: np.ndarray) -> np.ndarray:
    """The full windows whose minimisers occur twice or more at both levels, by their first words."""
    short, n = _level(window), len(words.codes)
    hs, low, fine, _ = _minimisers(h, words.at, window)
    anchors = _starts(words, batch, "anchors")
    twice = np.zeros(n + 1, bool)
    twice[_without(_doubles(words, anchors, short), _starts(words, batch, "single"), n)] = True
    candidate = np.zeros(len(low), bool)
    for back in range(window - short + 1):  # the anchor is word `back` of the full window
        starts = anchors - back
        keep = (starts >= 0) & (starts < len(low))
        a, s = anchors[keep], starts[keep]
        ok = fine[s] & (hs[a] == low[s])
        if back + 2 * short <= window:
            ok &= twice[a]
        if back >= short:
            ok &= twice[np.maximum(a - short, 0)]
        candidate[s[ok]] = True
    return np.flatnonzero(candidate)


def _level_3(window: int):
    def run(batches):
        for batch in t.sliced(batches, "_text"):
            words = t.Words(_take(batch, "_text"), t.SPACED, None)
            if len(words.codes) < window:
                continue
            h = words.hashes()
            starts = _candidates(words, batch, window, h)
            more = t.windows(words.hashes(1), window)[starts].astype(np.uint32).view(np.int32)
            yield _placed(words, starts, batch, _signed(t.windows(h, window)[starts]), pa.array(more))

    return run


def _cut(window: int):
    """What repeated windows leave of each text that has any."""

    def run(batches):
        for batch in t.sliced(batches, "_text"):
            words = t.Words(_take(batch, "_text"), t.SPACED, None)
            n = len(words.codes)
            if n < window:
                continue
            starts = _without(_candidates(words, batch, window, words.hashes()), _starts(words, batch, "lone"), n)
            depth = np.zeros(n + 1, np.int32)
            depth[starts] += 1
            np.subtract.at(depth, starts + window, 1)
            covered = np.cumsum(depth)[:-1] > 0
            rows = np.unique(np.searchsorted(words.at, starts, "right") - 1)
            kept, spans, gone = [], [], []
            for k, raw in zip(rows, _take(batch, "_text").take(pa.array(rows)).to_pylist()):
                flags = covered[words.at[k] : words.at[k + 1]]
                kept.append(b" ".join(np.array(raw.encode().split(), object)[~flags].tolist()).decode())
                spans.append(np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))).astype(np.int32))
                gone.append(int(flags.sum()))
            same = [_take(batch, c).take(pa.array(rows)) for c in ("_key", "_id")]
            yield pa.RecordBatch.from_arrays([*same, pa.array(gone, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(kept, pa.string())], ["_key", "_id", "n_removed", "spans", "kept"])

    return run


def _alone(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """The places of each row whose hashes occur once only, as one list per key.

    A hash that occurs once has one key and one place, so the count itself tells them, and no row has to
    be joined with its count.
    """
    once = rows.groupBy(*by).agg(F.sum("weight").alias("_n"), F.min("_key").alias("_key"), F.min("pos").alias("pos")).where("_n = 1")
    return once.select("_key", "pos").repartition("_key").groupBy("_key").agg(F.collect_list("pos").alias(name))


def _whole(batches):
    """Words and digest of each whole text."""
    import hashlib

    for batch in t.sliced(batches, "_text"):
        n, digest = [], []
        for raw in batch.column(batch.schema.get_field_index("_text")).to_pylist():
            words = raw.encode().split()
            n.append(len(words))
            digest.append(hashlib.sha256(b" ".join(words)).digest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary())], ["_key", "_id", "n_words", "_all"])


def _keyed(docs: DataFrame, id: str, text: str) -> DataFrame:
    return docs.select(F.col(id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn("_key", F.xxhash64("_id", "_text"))


def rows_of(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """`_key` (a hash of id and text), `_id`, `n_words` and `_all` (SHA-256 of the words joined by one space) of each row."""
    kind = docs.schema[id].dataType.simpleString()
    return t.stored(t.map_arrow(_keyed(docs, id, text).select("_key", "_id", "_text"), _whole, f"_key long, _id {kind}, n_words long, _all binary"), "rows")


def repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW, rows: DataFrame | None = None) -> DataFrame:
    """Rows of which anything is removed, once for each id and text: `_key`, the id, `n_removed`, `spans`
    (word begin, end pairs that are removed, flat) and `kept` (the other words joined by one space).

    Of rows with equal words only the one of least key goes through the levels, with a weight of two;
    the others are removed whole if they have a window. rows: of rows_of, where already at hand.
    """
    if window < 3 or 2 * _level(window) > window:
        raise ValueError("a window has 3 words at least")
    rows = rows_of(docs, id, text) if rows is None else rows
    long = rows.where(F.col("n_words") >= window)
    firsts = long.groupBy("_all").agg(F.min("_key").alias("_key"), F.when(F.count(F.lit(1)) > 1, 2).otherwise(1).alias("weight"))
    firsts = t.stored(firsts.select("_key", "weight"), "firsts")

    keyed, kind = _keyed(docs, id, text), docs.schema[id].dataType.simpleString()
    places = "_key long, pos int, weight int"
    first = keyed.join(firsts, "_key").select("_key", "_id", "_text", "weight")
    ones = t.map_arrow(first, _level_1(window), "h long, " + places)
    alone = first.join(_alone(ones, ["h"], "alone"), "_key", "left")
    held = t.stored(t.map_arrow(alone, _anchored(window), f"_key long, _id {kind}, _text string, weight int, anchors array<int>"), "candidates")
    twos = t.map_arrow(held.select("_key", "_text", "anchors", "weight"), _level_2(window), "h long, " + places)
    second = held.join(_alone(twos, ["h"], "single"), "_key", "left")
    full = t.map_arrow(second, _level_3(window), "h long, g int, " + places)
    third = second.join(_alone(full, ["h", "g"], "lone"), "_key", "left")
    some = t.map_arrow(third, _cut(window), f"_key long, _id {kind}, n_removed long, spans array<int>, kept string").dropDuplicates(["_key", "_id"])
    copies = long.join(firsts, "_key", "left_anti").select("_key", "_id", "n_words").distinct()
    whole = copies.select("_key", "_id", F.col("n_words").alias("n_removed"), F.array(F.lit(0), F.col("n_words").cast("int")).alias("spans"), F.lit("").alias("kept"))
    return some.unionByName(whole).withColumnRenamed("_id", id)


def deduplicate(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with all columns, its text without what `repeats` removes; texts without repeats stay as they are."""
    found = repeats(docs, id, text, window).select("_key", F.col(id).alias("_id"), F.col("kept").alias("_kept")).dropDuplicates(["_key", "_id"])
    plain, (id, text) = t.renamed(docs, id, text)
    keyed = plain.withColumn("_key", F.xxhash64(F.col(id), F.coalesce(F.col(text), F.lit(""))))
    joined = keyed.join(found, (keyed["_key"] == found["_key"]) & keyed[id].eqNullSafe(found["_id"]), "left")
    return joined.select(*[F.coalesce(F.col("_kept"), keyed[c]).alias(c) if c == text else keyed[c] for c in plain.columns]).toDF(*docs.columns)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that repeated 35-word windows cover, and a digest of the rest, for each document."""
    docs = t.table(spark, sf_dir, "documents")
    every = rows_of(docs)
    cut = repeats(docs, rows=every).select("_key", F.col("doc_id").alias("_other"), "n_removed", F.sha2("kept", 256).alias("_cut"))
    joined = every.join(cut.withColumnRenamed("_key", "_k"), F.expr("_key = _k and _id <=> _other"), "left")
    return joined.select(F.col("_id").alias("doc_id"), "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("_cut", F.lower(F.hex("_all"))).alias("kept_sha256"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), w AS (
  SELECT rid, i, sha256(array_to_string(ws[i:i + 34], ' ')) AS win
  FROM (SELECT rid, ws, unnest(range(1, CAST(len(ws) - 33 AS BIGINT))) AS i FROM d WHERE len(ws) >= 35)
), r AS (
  SELECT rid, i FROM w JOIN (SELECT win FROM w GROUP BY win HAVING count(*) > 1) USING (win)
), gone AS (
  SELECT DISTINCT rid, unnest(range(i, i + 35)) AS p FROM r
), g AS (
  SELECT rid, count(*) AS n, list(p) AS ps FROM gone GROUP BY rid
), x AS (
  SELECT d.rid, ws[p] AS word, p FROM (SELECT rid, ws, unnest(range(1, CAST(len(ws) + 1 AS BIGINT))) AS p FROM d WHERE rid IN (SELECT rid FROM g)) d ANTI JOIN gone USING (rid, p)
), kept AS (
  SELECT rid, string_agg(word, ' ' ORDER BY p) AS body FROM x GROUP BY rid
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN n IS NULL THEN array_to_string(ws, ' ') ELSE coalesce(body, '') END) AS kept_sha256
FROM d LEFT JOIN g USING (rid) LEFT JOIN kept USING (rid)
"""
