"""Queries use all rows of their tables."""

import datetime as dt
import math

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from candela import queries
from candela.functions import market, stats
from candela.operators import aligned
from pyspark.sql import functions as F


def _events(path, values, step):
    start = dt.datetime(2024, 1, 1, 0, 30)
    n = len(values)
    pq.write_table(
        pa.table({"event_id": range(n), "ts": pa.array([start + k * step for k in range(n)], pa.timestamp("us")), "user_id": [0] * n, "event_type": ["a"] * n, "value": values, "props": ["{}"] * n}),
        path / "events.parquet",
    )
    return str(path)


def test_dtw_sees_the_last_bars(spark, tmp_path):
    rng = np.random.default_rng(1)
    opens, closes = rng.integers(1, 50, 90).astype(float), rng.integers(1, 50, 90).astype(float)
    both = [x for pair in zip(opens, closes) for x in pair]  # two events an hour: its open and its close
    got = queries.QUERIES["stats_scans"](spark, _events(tmp_path, both, dt.timedelta(minutes=30))).first()
    start = dt.datetime(2024, 1, 1, 0, 30)
    bars = {}
    for k, v in enumerate(both):
        bars.setdefault((start + k * dt.timedelta(minutes=30)).replace(minute=0), []).append(v)
    a, b = ([x[j] for _, x in sorted(bars.items())] for j in (-1, 0))
    n = len(a)
    cost = np.full((n + 1, n + 1), np.inf)
    cost[0, 0] = 0
    for i in range(1, n + 1):
        for j in range(max(1, i - 10), min(n, i + 10) + 1):
            cost[i, j] = abs(a[i - 1] - b[j - 1]) + min(cost[i - 1, j - 1], cost[i - 1, j], cost[i, j - 1])
    assert n > 60 and got.dtw == round(cost[n, n], 6)
    assert stats._dtw(a, b, 10)["distance"] == cost[n, n]


def test_returns_beyond_100_000_bars(spark, tmp_path):
    n = 100_200
    values = [100.0 + k % 2 for k in range(100_001)] + [100.0 + 50 * (k % 2) for k in range(n - 100_001)]
    got = queries.QUERIES["stats_lists"](spark, _events(tmp_path, values, dt.timedelta(hours=1))).first()
    x = np.array(values)
    want = (np.diff(x) / x[:-1] / 100).std(ddof=1) * math.sqrt(252)
    assert abs(got.annual_vol - want) < 2e-6


def test_aligned_keeps_bars_off_the_grid(spark, tmp_path):
    """A Saturday and nights: every bar is a row, and only trading minutes are filled in."""
    path = _events(tmp_path, [float(k % 7) for k in range(200)], dt.timedelta(hours=5))
    got = queries.QUERIES["aligned_recursive"](spark, path).orderBy("ts").collect()
    assert [r.ts for r in got] == [dt.datetime(2024, 1, 1, 0, 30) + k * dt.timedelta(hours=5) for k in range(200)]
    full = aligned.fill(queries._minutes(spark, path), "ts", ["symbol"], ["close"], "volume")
    assert full.where("_real").count() == 200
    assert full.where(~market.Calendar().trading_minute(F.col("ts")) & ~F.col("_real")).count() == 0
    close = {r.ts: r.close for r in full.orderBy("ts").collect()}
    ema, k = sum(list(close.values())[:14]) / 14, 2 / 15
    for v in list(close.values())[14:]:
        ema += (v - ema) * k
    assert got[-1].ema == round(ema, 6)
