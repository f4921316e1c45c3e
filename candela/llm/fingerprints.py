"""Document fingerprints: bottom-k sketches of word shingles.

A text's sketch holds the k least distinct 64-bit hashes of its shingles of `shingle` words (or of
the whole sequence, where it has fewer), with the number of its distinct shingles where that is at
most k and k otherwise reached. Sketches of parts merge into the sketch of the whole: the k least of
their union. From two sketches come the resemblance (share of the k least of the union that both
hold), the containment, and the number of distinct shingles ((k - 1) / the k-th least hash, as a
share of the hash range).

All of it is DataFrame functions; sketches are arrays of BIGINT in ascending order.

Rows: words are lower-cased `[^\\x20\\x09-\\x0D]+`. Null, empty and blank texts have an empty sketch;
two empty sketches have resemblance 1 (the texts' words are equal), one empty one has 0. In
`with_next`, rows are ordered by id, nulls first, then text; repeated ids are rows of their own; a
single row's next is itself. Other columns are not read.

Scale: a sketch is at most k numbers. `with_next` deals rows to ranges of ids cut at keys
of a sample, and gives each range the first rows of the one after it, so neighbours meet in one task
without a global sort; the text is shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _text as t
from ._order import dealt, let

K, SHINGLE = 256, 5
SPACE = r"[\x20\x09-\x0D]+"


def hashes(text: Column, shingle: int = SHINGLE) -> Column:
    """The hash of each shingle of a text, in order; an empty array for none."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(lower, SPACE), lambda w: w != "")

    def of(w: Column) -> Column:
        n = F.size(w)
        each = F.transform(F.sequence(F.lit(0), n - shingle), lambda i: F.xxhash64(*[w[i + k] for k in range(shingle)]))
        return F.when(n == 0, F.array().cast("array<bigint>")).when(n < shingle, F.array(F.xxhash64(w))).otherwise(each)

    return let(words, of)


def sketch(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    """The bottom-k sketch of a text.

    Long texts are thinned first to the hashes under a bound that about 4k of n would meet; where
    fewer than k distinct ones do, the whole list is used, so the sketch is the same.
    """
    def of(h: Column) -> Column:
        whole = F.slice(F.sort_array(F.array_distinct(h)), 1, k)
        bound = (F.lit(-(2.0**63)) + F.lit(2.0**64) * (4.0 * k) / F.size(h)).cast("bigint")
        thin = let(F.array_distinct(F.filter(h, lambda x: x < bound)), lambda d: F.when(F.size(d) >= k, F.slice(F.sort_array(d), 1, k)).otherwise(whole))
        return F.when(F.size(h) > 8 * k, thin).otherwise(whole)

    return let(hashes(text, shingle), of)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both parts together; shingles across their border belong to neither."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_all(df: DataFrame, keys: list[str], column: str, k: int = K) -> DataFrame:
    """One sketch per group, without gathering a group: the k least distinct hashes of each, by rank
    within salted parts first."""
    each = df.select(*keys, F.explode(column).alias("_h")).distinct()
    part = Window.partitionBy(*keys, F.pmod(F.xxhash64("_h"), F.lit(32))).orderBy("_h")
    few = each.withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= k).drop("_r")
    least = few.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("_h"))).where(F.col("_r") <= k)
    return least.groupBy(*keys).agg(F.sort_array(F.collect_list("_h")).alias(column))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of the shingle sets, 0 to 1; exact where both are smaller than k."""
    both = let(merge(a, b, k), lambda u: F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    share = (a[k - 1].cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1.0) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has, 0 to 1; 1 for an empty a."""
    j = resemblance(a, b, k)
    both = j * (distinct_shingles(a, k) + distinct_shingles(b, k)) / (1 + j)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), both / distinct_shingles(a, k)))


def as_text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.lower(F.hex(x))), ",")


def with_next(df: DataFrame, id: str, text: str, derive: dict[str, Column] | None = None, ranges: int | None = None) -> DataFrame:
    """(id, text, next_text) with the text of the row after it by id, after the last the first. derive:
    more columns, each also with `next_`, from the columns `_id` and `_text`, computed once a row."""
    rows = df.select(F.col(id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = dealt(rows, "_id", True, ranges)
    order = Window.partitionBy("_range").orderBy("_order", F.asc_nulls_first("_id"), "_text")
    more = derive or {}
    out = rows.withColumns(more) if more else rows
    out = out.withColumns({"next_text": F.lead("_text").over(order)} | {f"next_{c}": F.lead(c).over(order) for c in more}).where("_order = 0")
    return out.select(F.col("_id").alias(id), F.col("_text").alias(text), "next_text", *[x for c in more for x in (c, f"next_{c}")])


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each document and of its edited text: its last half replaced by the beginning of the next."""
    rows = with_next(t.table(spark, sf_dir, "documents"), "doc_id", "text", {"a": sketch(F.col("_text"))})
    half = "int(floor(char_length(text) / 2))"
    edited = F.expr(f"concat(substring(text, 1, char_length(text) - {half}), substring(next_text, 1, {half}))")
    rows = rows.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), edited.alias("edited"), "a", F.col("next_a").alias("x"))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "a", sketch(F.col("edited")).alias("e"), "x")
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("a")).alias("fingerprint"),
        as_text(F.col("e")).alias("edited_fingerprint"),
        resemblance(F.col("a"), F.col("e")).alias("near_edited"),
        resemblance(F.col("a"), F.col("x")).alias("near_next"),
        containment(F.col("a"), F.col("e")).alias("kept_share"),
        distinct_shingles(F.col("a")).alias("n_shingles"),
    )
