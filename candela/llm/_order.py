"""Neighbours in a global order without a global sort or a single task."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 8


def let(value: Column, f) -> Column:
    """f(value), with value computed once a row."""
    return F.transform(F.array(value), f)[0]


def dealt(df: DataFrame, key: str, wrap: bool = False, ranges: int | None = None, keys: DataFrame | None = None, both: bool = False) -> DataFrame:
    """df with `_range` and `_order`: rows dealt to ranges of `key` and there to be sorted by (_order,
    key nulls first, what else breaks ties). `_order` is 0 for the row itself. The rows that begin a
    range are also given to the range before, with 1, and with `wrap` the least rows to the last range,
    with 2; so every row finds the one after it in its own range.

    Ranges are cut at keys of a sample, 16 for each range, of least hash: that is all that comes to the
    driver, with the least key. Each cut is the key of a row, so no range but that of an empty table is
    empty.
    """
    spark = df.sparkSession
    ranges = ranges or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = (df if keys is None else keys).select(F.col(key).alias("k"))
    rows, nulls, least = keys.agg(F.count(F.lit(1)), F.count(F.when(F.col("k").isNull(), 1)), F.min("k")).first()
    drawn = F.pmod(F.xxhash64("k"), F.lit(1 << 40)) < F.lit(int((1 << 40) * min(1.0, SAMPLE * ranges / max(rows, 1))))
    sample = sorted({r.k for r in keys.where(F.col("k").isNotNull() & drawn).collect()})
    firsts = sorted({least, *sample[:: max(1, len(sample) // ranges)]}) if least is not None else []
    kind = f"array<{df.schema[key].dataType.simpleString()}>"
    step = max(1, int(len(firsts) ** 0.5))
    # one literal each, however many ranges there are
    literal = lambda x: F.from_json(F.lit(json.dumps([v if v is None else str(v) for v in x])), "array<string>").cast(kind)
    starts, coarse = literal(firsts), literal(firsts[::step])

    def place(k: str) -> Column:
        below = lambda x: x <= F.col(k)
        group = F.greatest(F.lit(0), F.size(F.filter(coarse, below)) - 1) * step
        at = let(group, lambda g: F.greatest(F.lit(0), g + F.size(F.filter(F.slice(starts, g + 1, step), below)) - 1))
        return F.when(F.col(k).isNull(), 0).otherwise(at)

    rows = df.withColumn("_at", place(key))
    begins = (F.col("_at") > 0) & (F.get(starts, F.col("_at")) == F.col(key))
    very_first = F.col(key).isNull() if nulls else F.col(key) == F.lit(least)
    spot = lambda r, o: F.struct(r.cast("int").alias("range"), F.lit(o).alias("order"))
    none = F.array().cast("array<struct<range:int,order:int>>")
    before = F.when(begins, F.array(spot(F.col("_at") - 1, 1))).otherwise(none)
    around = F.when(F.coalesce(very_first, F.lit(False)), F.array(spot(F.lit(max(len(firsts) - 1, 0)), 2))).otherwise(none) if wrap else none
    behind = none
    if both and len(firsts) > 1:
        ends = dict(keys.where("k is not null").groupBy(place("k").alias("at")).agg(F.max("k")).collect())  # a row per range
        lasts = literal([ends.get(k) for k in range(len(firsts))])
        ending = (F.col("_at") < len(firsts) - 1) & (F.get(lasts, F.col("_at")) == F.col(key))
        behind = F.when(ending, F.array(spot(F.col("_at") + 1, -1))).otherwise(none)
    rows = rows.withColumn("_to", F.explode(F.concat(F.array(spot(F.col("_at"), 0)), before, around, behind)))
    return rows.select(*df.columns, F.col("_to.range").alias("_range"), F.col("_to.order").alias("_order")).repartition("_range")
