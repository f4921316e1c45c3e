"""Bars from a stream of events, and bounded local indicators on closed bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bars(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Bars (symbol, ts, open, high, low, close, volume), each given out once its window is closed;
    events later than `late` are dropped. events needs ts as a timestamp."""
    window = F.window("ts", every)
    return (
        events.withWatermark("ts", late)
        .groupBy(window, F.col("event_type").alias("symbol"))
        .agg(F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))
        .select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")
    )


def running_ema(bars: DataFrame, period: int) -> DataFrame:
    """(symbol, ts, ema) for a stream of bars: the state of a symbol is the number of bars, the sum of
    the first `period` and the last value. Bars of one micro-batch are taken in order of time."""
    import pandas as pd

    factor = 2.0 / (period + 1)

    def step(key, frames, state):
        n, total, last = state.get if state.exists else (0, 0.0, 0.0)
        out = []
        rows = pd.concat(list(frames)).sort_values("ts")
        for ts, close in zip(rows["ts"], rows["close"]):
            n += 1
            total += close if n <= period else 0.0
            last = total / period if n == period else last + (close - last) * factor if n > period else last
            out.append((key[0], ts, last if n >= period else None))
        state.update((n, total, last))
        yield pd.DataFrame(out, columns=["symbol", "ts", "ema"])

    return bars.groupBy("symbol").applyInPandasWithState(step, "symbol string, ts timestamp, ema double", "n long, total double, last double", "append", "NoTimeout")
