"""Near-duplicate detection with SuperMinHash signatures, banding, verification and union-find grouping.

A row's set is its distinct word shingles, by 64-bit hash. For each element a pseudo-random
permutation of the registers says which register gets its values of rank 0, 1, 2, ... (the ranks of
one element are thus correlated over the registers, which lowers the variance against independent
minima), and ranks stop as soon as no register of the row can still fall. Bands of registers are
compared by equality; candidate pairs are confirmed on the full sets, exactly.

Within a bucket no pairs are listed. Each member is confirmed against one pivot, and linked members
fall into components. In buckets that then hold several components (of buckets with the same members,
by count and two 64-bit sums, in one) each set is compared with all sets of other components at once,
by the postings of its shingles, in blocks of bounded size. So each pair that shares a band ends in
one component or has been compared. Rows of equal sets are one node. Elements draw their permutation
from a shared table of 4096.

At the threshold itself a pair shares no band with probability (1 - 0.8^rows)^bands, 5e-6 for 40
bands of 6; there is no cap on buckets, partners or candidates.

Rows: words are lower-cased `[^\\x20\\x09-\\x0D]+`; fewer words than a shingle make one shingle of
them all; null, empty and blank texts have an empty set, are linked with nothing and are their own
component. Rows that repeat an id count as one node each set, joined by the id. A null id is never
linked; its component is null and it is kept. Other columns are not read.

Scale: a signature is 40 band keys per distinct set. Keys are aggregated to those that occur in two
sets or more, a small table that band rows are then joined with; texts are shuffled once, and only
where the candidates are too many to broadcast (Spark's size check). Components come from large-star
and small-star steps over links that each task has contracted by itself, each step a table in the
shared folder. Hot buckets and groups of copies are pre-aggregated or split by the skew join. Ids must
be whole numbers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text as t

BANDS, ROWS = 40, 6
PERMUTATIONS = 4096
#: Shingles of a block of sets that meet in one task with another block.
BLOCK = 400_000
U = np.uint64


def shingle_sets(words: t.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, one row after the other, and each row's offset."""
    h, at = words.hashes(), words.at
    n, size = len(h), np.diff(at)
    parts, rows = [], []
    if n >= k:
        all_k = t.windows(h, k)
        inside = np.repeat(at[1:], size)[: len(all_k)] >= np.arange(len(all_k)) + k
        spots = np.flatnonzero(inside)
        parts.append(all_k[spots])
        rows.append(np.searchsorted(at, spots, "right") - 1)
    for few in range(1, k):
        short = np.flatnonzero(size == few)
        if len(short):
            parts.append(t.windows(h, few)[at[short]])
            rows.append(short)
    if not parts:
        return np.zeros(0, U), np.zeros(len(size) + 1, np.int64)
    values, row = np.concatenate(parts), np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    values, row = values[order], row[order]
    first = np.searchsorted(row, np.arange(len(size) + 1))
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        values[a:b].sort()
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    return values[new], np.searchsorted(row[new], np.arange(len(size) + 1))


def permutations(registers: int) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(20))
    return rng.permuted(np.tile(np.arange(registers, dtype=np.uint8), (PERMUTATIONS, 1)), axis=1)


def signatures(values: np.ndarray, at: np.ndarray, registers: int, table: np.ndarray) -> np.ndarray:
    """SuperMinHash signatures: the upper 8 bits of a register are the rank, the lower 24 the draw."""
    rows = len(at) - 1
    out = np.full((rows, registers), 0xFFFFFFFF, np.uint32)
    flat = out.reshape(-1)
    row = np.repeat(np.arange(rows), np.diff(at))
    which = (t.mix(values ^ U(0xA5A5A5A5DEADBEEF)) & U(PERMUTATIONS - 1)).astype(np.int64)
    for rank in range(registers):
        draw = (t.mix(values + U((rank + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))) >> U(40)).astype(np.uint32)
        draw |= np.uint32(rank << 24)
        np.minimum.at(flat, row * registers + table[which, rank], draw)
        going = out.max(axis=1) >= np.uint32((rank + 1) << 24) if rank < 255 else np.zeros(rows, bool)
        keep = going[row]
        if not keep.any():
            break
        if not keep.all():
            values, row, which = values[keep], row[keep], which[keep]
    return out


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    rows, registers = signature.shape
    each = registers // bands
    key = np.tile(t.mix(np.arange(1, bands + 1).astype(U)), (rows, 1))
    for k in range(each):
        key = t.pair(key, signature[:, k::each][:, :bands].astype(U))
    return t.mix(key)


def _sketch(k: int, bands: int, rows: int):
    def run(batches):
        table = permutations(bands * rows)
        for batch in t.sliced(batches, "_text", 1 << 20):
            words = t.Words(batch.column(batch.schema.get_field_index("_text")), t.SPACED, t.LOWER)
            values, at = shingle_sets(words, k)
            size = np.diff(at)
            signature = signatures(values, at, bands * rows, table)
            keys = band_keys(signature, bands).view(np.int64)
            digest = [hashlib.blake2b(values[a:b], digest_size=16).digest() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (batch.num_rows + 1) * bands, bands, dtype=np.int32)), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("_id")), pa.array(size), pa.array(digest, pa.binary()), lists], ["_id", "n", "digest", "bands"])

    return run


def _full_sets(k: int):
    def run(batches):
        for batch in t.sliced(batches, "_text", 1 << 20):
            words = t.Words(batch.column(batch.schema.get_field_index("_text")), t.SPACED, t.LOWER)
            values, at = shingle_sets(words, k)
            wanted = batch.column(batch.schema.get_field_index("digest")).to_pylist()
            good = [hashlib.blake2b(values[a:b], digest_size=16).digest() == w for a, b, w in zip(at[:-1].tolist(), at[1:].tolist(), wanted)]
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("_id")), lists], ["_id", "items"]).filter(pa.array(good, pa.bool_()))

    return run


def _contract(batches):
    """Links of a task joined to their least nodes, as far as that task can tell: fewer steps are left."""
    held, size = [], 0

    def stars():
        a, b = (np.concatenate([x[k] for x in held]) for k in (0, 1))
        nodes, place = np.unique(np.concatenate((a, b)), return_inverse=True)
        x, y = place[: len(a)], place[len(a) :]
        label = np.arange(len(nodes))
        while True:
            low = np.minimum(label[x], label[y])
            if (low == label[x]).all() and (low == label[y]).all():
                break
            for side in (x, y):
                np.minimum.at(label, label[side], low)
                np.minimum.at(label, side, low)
            label = label[label]
        own = label != np.arange(len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[label[own]])], ["u", "v"])

    for batch in batches:
        held.append([batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)])
        size += batch.num_rows
        if size >= 1 << 20:
            yield stars()
            held, size = [], 0
    if size:
        yield stars()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for links (a, b): the least node that each is joined to, by large-star and small-star steps."""
    edges = t.map_arrow(links.where("a != b").select("a", "b"), _contract, "u long, v long")
    edges = t.stored(edges, "edges", small=True)
    while True:
        # all stars: no centre is joined to a lesser one
        if edges.select(F.col("v").alias("u")).distinct().join(edges, "u", "left_semi").isEmpty() and edges.groupBy("u").count().where("count > 1").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).distinct()
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).repartition("u")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = t.stored(small.distinct(), "edges", small=True)


def _group_links(ids: np.ndarray, label: np.ndarray, items: np.ndarray, at: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between sets of different labels, enough to join all labels that any pair links: the overlap
    of one set with all others at once, by the postings of its shingles."""
    size = np.diff(at)
    owner = np.repeat(np.arange(len(ids)), size)
    order = np.argsort(items, kind="stable")
    first = np.concatenate(([True], items[order][1:] != items[order][:-1])) if len(items) else np.zeros(0, bool)
    code = np.empty(len(items), np.int64)
    code[order] = np.cumsum(first) - 1
    posting, starts = owner[order], np.append(np.flatnonzero(first), len(items))
    labels, label, many = np.unique(label, return_inverse=True, return_counts=True)
    out = []
    for q in np.flatnonzero(label != np.argmax(many)).tolist():  # pairs within the largest are joined, pairs with it are found from the other side
        if (label == label[q]).all():
            break
        mine = code[at[q] : at[q + 1]]
        low, n = starts[mine], starts[mine + 1] - starts[mine]
        spots = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(posting[spots], minlength=len(ids))
        near = ((100 + percent) * both >= percent * (size + size[q])) & (label != label[q])
        for d in np.flatnonzero(near).tolist():
            if label[d] != label[q]:
                out.append((int(ids[q]), int(ids[d])))
                label[label == label[d]] = label[q]
    return out


def _compare(percent: int):
    """Streams groups of rows (group, i, j, _id, c, items) that are sorted by their first three columns."""

    def run(batches):
        held, key = [], None

        def found():
            ids, label = (np.concatenate([x[k] for x in held]) for k in (0, 1))
            at = np.concatenate(([0], np.cumsum(np.concatenate([x[2] for x in held]))))
            links = _group_links(ids, label, np.concatenate([x[3] for x in held]), at, percent)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)])
            ids, label = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 4))
            sizes = pa.compute.list_value_length(batch.column(5)).to_numpy(zero_copy_only=False)
            items, at = pa.compute.list_flatten(batch.column(5)).to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(sizes)))
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if key is not None and tuple(keys[:, a]) != key:
                    yield found()
                    held = []
                key = tuple(keys[:, a])
                held.append((ids[a:b].copy(), label[a:b].copy(), sizes[a:b].copy(), items[at[a] : at[b]].copy()))
        if held:
            yield found()

    return run


def _across(items: DataFrame, open: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between rows (_id, c, group, n) of a group and of different components c.

    No pairs are listed: a group's sets meet in one task, or, where they hold more than BLOCK shingles,
    in blocks, each block with each other one.
    """
    blocks = open.groupBy("group").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    dealt = open.join(blocks, "group").withColumn("own", F.pmod(F.xxhash64("_id"), F.col("blocks")).cast("int"))
    each = dealt.select("group", "_id", "c", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = each.join(items, "_id").select("group", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "_id", "c", "items")
    rows = rows.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j")
    return t.map_arrow(rows, _compare(percent), "a long, b long")


def link(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, n_shingles, component_id) of each row; sets are linked if 100 * intersection >= percent * union."""
    if not isinstance(docs.schema[id].dataType, T.IntegralType):
        raise TypeError(f"{id} must be a column of whole numbers")
    source = docs.select(F.col(id).cast("long").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    every = t.stored(t.map_arrow(source, _sketch(shingle, bands, rows), "_id long, n long, digest binary, bands array<long>"), "sketches")
    sets = every.where("n > 0 and _id is not null")
    copies = t.stored(sets.groupBy("digest").agg(F.min("_id").alias("rep"), F.max("_id").alias("top")).where("rep < top").drop("top"), "copies", small=True)
    nodes = sets.join(copies, "digest", "left").where("rep is null or rep = _id")
    spread = nodes.select("_id", F.explode("bands").alias("key"))
    buckets = t.stored(spread.groupBy("key").agg(F.min("_id").alias("pivot"), F.max("_id").alias("top")).where("pivot < top").drop("top"), "buckets", small=True)
    members = t.stored(t.sieve(spread, "key", buckets.select("key")).join(buckets, "key"), "members", small=True)
    ids = t.stored(members.select("_id").distinct(), "ids", small=True)
    names = t.stored(t.sieve(nodes.select("_id", "digest", "n"), "_id", ids).join(ids, "_id", "left_semi").distinct(), "names", small=True)
    items = t.stored(t.map_arrow(t.sieve(source, "_id", ids).join(names.drop("n"), "_id"), _full_sets(shingle), "_id long, items array<long>"), "sets")
    sizes = names.groupBy("_id").agg(F.min("n").alias("least"), F.max("n").alias("n"))

    def confirm(pairs: DataFrame) -> DataFrame:
        left, right = items.select(F.col("_id").alias("a"), F.col("items").alias("x")), items.select(F.col("_id").alias("b"), F.col("items").alias("y"))
        for c in ("a", "b"):
            pairs = pairs.join(sizes.select(F.col("_id").alias(c), F.col("least").alias(f"{c}_least"), F.col("n").alias(f"{c}_most")), c)
        pairs = pairs.where((F.col("a_least") * percent <= F.col("b_most") * 100) & (F.col("b_least") * percent <= F.col("a_most") * 100)).select("a", "b")
        near = (100 + percent) * F.size(F.array_intersect("x", "y")).cast("long") >= percent * (F.size("x") + F.size("y")).cast("long")
        return pairs.join(left, "a").join(right, "b").where(near).select("a", "b")

    # one id with several sets, from repeated ids, needs no link: its sets share the node
    found = components(confirm(members.where("_id != pivot").select(F.col("_id").alias("a"), F.col("pivot").alias("b")).distinct()))
    placed = members.select("key", "_id").join(found, F.col("_id") == F.col("node"), "left").select("key", "_id", F.coalesce("component", "_id").alias("c")).distinct()
    # buckets of one component are done with, and of buckets with the same members one is enough
    mark = F.xxhash64("_id", F.lit(1)).cast("decimal(20,0)")
    mixed = placed.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count(F.lit(1)).alias("n"), F.sum(mark).alias("sum"), F.bit_xor(F.xxhash64("_id", F.lit(2))).alias("xor")).where("low < high")
    mixed = mixed.groupBy("n", "sum", "xor").agg(F.min("key").alias("key")).select("key")
    open = t.stored(placed.join(mixed, "key", "left_semi").join(sizes, "_id").select("_id", "c", F.col("key").alias("group"), "n"), "open", small=True)
    if not open.isEmpty():
        more = t.stored(_across(items, open, percent), "links", small=True)
        if not more.isEmpty():
            found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    out = every.join(copies, "digest", "left").withColumn("rep", F.when(F.col("n") > 0, F.coalesce("rep", "_id"))).join(found, F.col("rep") == F.col("node"), "left")
    return out.select(F.col("_id").alias(id), F.col("n").alias("n_shingles"), F.when(F.col("_id").isNull(), None).otherwise(F.coalesce("component", "rep", "_id")).alias("component_id"))


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs, with all columns, whose id is their component's least, and those without an id; rows that repeat a kept id stay."""
    gone = link(docs, id, text, **options).where(F.col(id) != F.col("component_id")).select(F.col(id).cast(docs.schema[id].dataType).alias("_gone")).distinct()
    return docs.join(gone, docs[id] == gone["_gone"], "left_anti")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's component under two-word shingles at 0.8."""
    found = link(t.table(spark, sf_dir, "documents"), shingle=2)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]] ELSE list_transform(range(1, CAST(len(ws) AS BIGINT)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS items FROM d
), rep AS (
  SELECT min(doc_id) AS rep, list_sort(items) AS items FROM s WHERE len(items) > 0 GROUP BY list_sort(items)
), e AS (
  SELECT rep, len(items) AS n, unnest(items) AS item FROM rep
), shared AS (
  SELECT a.rep AS x, b.rep AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS i FROM e a JOIN e b ON a.item = b.item AND a.rep < b.rep
  WHERE least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80 GROUP BY a.rep, b.rep
), l AS (
  SELECT x, y FROM shared WHERE 100 * i >= 80 * (nx + ny - i)
), both_ways AS (
  SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), reach AS (
  SELECT rep AS node, rep AS seen FROM rep
  UNION
  SELECT reach.node, both_ways.y FROM reach JOIN both_ways ON reach.seen = both_ways.x
), comp AS (
  SELECT node, min(seen) AS component FROM reach GROUP BY node
), m AS (
  SELECT s.doc_id, CAST(len(s.items) AS BIGINT) AS n_shingles, coalesce(component, s.doc_id) AS component_id
  FROM s LEFT JOIN rep ON list_sort(s.items) = rep.items LEFT JOIN comp ON comp.node = rep.rep
)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM m
"""
