"""Indicators on calendar-aligned bars: missing bars between two rows are filled before computing.

A gap holds the grid points after the row before, every `bar_period` minutes from it, that are
trading minutes and come before the row. They repeat the row before, with a volume of 0. Rows with a
null time or input are left out, do not move the grid, and repeat the value of the row before them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.market import Calendar
from ..functions.registry import ALL
from .windowed import Frame, Request, with_indicators

DAYS = 366


def fill(df: DataFrame, ts: str, partition: list[str], columns: list[str], volume: str | None = None, bar_period: int = 1, calendar: Calendar | None = None) -> DataFrame:
    """df with filler rows; `_real` says which rows were there. Only partition, ts, columns and other
    columns (null in fillers) are kept."""
    calendar, step = calendar or Calendar(), min(max(bar_period or 1, 1), 1440)
    w = Frame(partition, [ts]).base
    rows = df.withColumns({"_t": F.lag(ts).over(w)} | {f"_b{k}": F.lag(c).over(w) for k, c in enumerate(columns)})
    minutes = lambda n: F.expr(f"make_dt_interval(0, 0, {n}, 0)")
    cur, old = F.col(ts), F.col("_t")
    ok = (cur > old + minutes(step)) & (cur <= old + minutes(DAYS * 1440))
    points = F.when(ok, F.sequence(old + minutes(step), cur - F.expr("make_dt_interval(0, 0, 0, 0.000001)"), minutes(step)))
    grid = F.filter(points, calendar.trading_minute)
    fillers = rows.withColumn("_g", F.explode(grid))
    names = [f.name for f in df.schema]
    value = {c: F.col(f"_b{k}") for k, c in enumerate(columns)} | ({volume: F.lit(0.0)} if volume else {}) | {c: F.col(c) for c in partition} | {ts: F.col("_g")}
    kinds = {f.name: f.dataType for f in df.schema}
    fake = fillers.select(*[value.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in names], F.lit(False).alias("_real"))
    return df.withColumn("_real", F.lit(True)).unionByName(fake)


def with_aligned(df: DataFrame, requests: list[Request], ts: str, partition: list[str], bar_period: int = 1, calendar: Calendar | None = None, skip_nulls: bool = True) -> DataFrame:
    """with_indicators over filled bars, at the real rows. Requests with the same inputs share one fill;
    give skip_nulls=False where no input is null, and all of them do."""
    asked, names = list(requests), df.columns
    if not skip_nulls:
        inputs = sorted({c for r in asked for c in r[3].values()})
        volume = next((r[3]["volume"] for r in asked if "volume" in r[3]), None)
        full = fill(df, ts, partition, inputs, volume, bar_period, calendar)
        return with_indicators(full, asked, partition, [ts], skip_nulls=False).where("_real").select(*names, *[r[0] for r in asked])
    for group in sorted({tuple(r[3].items()) for r in asked}):
        some = [r for r in asked if tuple(r[3].items()) == group]
        inputs = dict(group)
        bad = F.col(ts).isNull()
        for c in inputs.values():
            bad = bad | F.col(c).isNull()
        full = fill(df.where(~bad), ts, partition, sorted(set(inputs.values())), inputs.get("volume"), bar_period, calendar)
        done = with_indicators(full, some, partition, [ts], skip_nulls=False).where("_real").drop("_real")
        rest = df.where(bad)
        for r in some:
            rest = rest.withColumn(r[0], F.lit(None).cast(done.schema[r[0]].dataType))
        order = Frame(partition, [ts]).base.rowsBetween(-(2**31), 0)
        df = done.unionByName(rest).withColumns({r[0]: F.coalesce(F.col(r[0]), F.last(r[0], True).over(order)) for r in some})
    return df.select(*names, *[r[0] for r in asked])


def aligned_names() -> list[str]:
    return [n for n, i in ALL.items() if i.aligned]
