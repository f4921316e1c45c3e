"""Queries against their SQL, run by another engine over the same files."""

import glob
import os

import __spark_entry__ as entry
import duckdb
import pytest
from candela import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(table):
    names = sorted(table.column_names)
    cell = lambda v: v if v is None or isinstance(v, bool) else float(v) if isinstance(v, (int, float)) else str(v)
    return names, sorted(map(repr, zip(*[map(cell, table.column(c).to_pylist()) for c in names])))


@pytest.mark.parametrize("name", ["list_local", "list_recursive", "list_prices", "list_math", "list_candles", "window_macd", "window_bbands", "window_stoch", "window_aroon", "window_cci", "window_adxr", "frame_ema", "aggregate_last", "aligned_local", "stats_lists", "rolling_stats", "market_rules", "trading_calendar", "bars_sma", "list_cycles", "list_multi", "aligned_recursive", "stats_scans", "wide_table", "shape_search"])
def test_equals_sql(spark, duck, name):
    assert plain(queries.QUERIES[name](spark, SF).toArrow()) == plain(duck.execute(queries.SQL[name]).to_arrow_table())


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
    assert set(queries.SQL) == set(queries.QUERIES)
    assert {f"window_{n}" for n in ("sma", "cdldoji", "ht_sine", "mama")} <= set(entry.queries())


def test_recursive_aligned_equal_lists_over_filled_bars(spark):
    """Another way: fill, gather, and compute the list form."""
    from candela.operators import aligned, series

    bars = queries._minutes(spark, SF)
    names = ["ema", "rsi", "atr", "adx"]
    got = queries.QUERIES["aligned_recursive"](spark, SF).toPandas().set_index(["symbol", "ts"])
    full = aligned.fill(bars, "ts", ["symbol"], ["open", "high", "low", "close"], "volume")
    lists = series.ordered_lists(full, ["symbol"], "ts", ["ts", "_real", "high", "low", "close"])
    for name in names:
        cols = ["close"] if queries.ALL[name].inputs == ("x",) else ["high", "low", "close"]
        for row in lists.select("symbol", "ts", "_real", series.series(name, *cols, period=14).alias("v")).collect():
            for ts, real, v in zip(row.ts, row._real, row.v):
                if real:
                    want, have = v, got.loc[(row.symbol, ts), name]
                    assert (want is None and have != have) or abs(want - have) < 1e-5


def test_zero_closes_and_ties_of_rounding_equal_sql(spark, tmp_path):
    """A close of zero, and a change of 16.4703125, which lies at the seventh place between two results."""
    import datetime as dt

    import pyarrow as pa
    import pyarrow.parquet as pq

    values = [6.40 + k % 5 for k in range(40)]
    values[16], values[30], values[35] = 6.40, 111.81, 0.0
    steps = {"a": (dt.datetime(2024, 1, 2, 9, 31), dt.timedelta(minutes=1)), "b": (dt.datetime(2024, 1, 6), dt.timedelta(hours=1))}
    rows = [(t, start + k * step, v) for t, (start, step) in steps.items() for k, v in enumerate(values)]
    kinds, times, amounts = zip(*rows)
    pq.write_table(pa.table({"event_id": range(len(rows)), "ts": pa.array(times, pa.timestamp("us")), "user_id": [0] * len(rows), "event_type": kinds, "value": amounts, "props": ["{}"] * len(rows)}), tmp_path / "events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    for name in ("aligned_recursive", "window_natr", "window_rocp", "list_recursive", "list_local"):
        assert plain(queries.QUERIES[name](spark, str(tmp_path)).toArrow()) == plain(con.execute(queries.SQL[name]).to_arrow_table()), name
