"""Published values of the indicators on small inputs."""

import datetime as dt
import math

import numpy as np
import pytest
from candela import sql
from candela.functions import market, stats
from candela.functions.registry import ALL
from candela.operators import aligned, series, wide, windowed
from candela.operators.windowed import request
from candela.sources import bars
from pyspark.sql import Window
from pyspark.sql import functions as F

CLOSE = [102.0, 107, 106, 111, 113, 114, 117, 119]
HIGH = [105.0, 108, 110, 112, 115, 116, 118, 120]
LOW = [95.0, 101, 104, 105, 109, 110, 112, 115]
OPEN = [100.0, 102, 107, 106, 111, 113, 114, 117]


@pytest.fixture(scope="module")
def daily(spark):
    rows = [("A", k, *map(float, x), 1e6) for k, x in enumerate(zip(OPEN, HIGH, LOW, CLOSE))]
    return spark.createDataFrame(rows, "symbol string, ts int, open double, high double, low double, close double, volume double")


def column(df, *names):
    return [tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in df.orderBy("ts").collect()]


def test_windows(daily):
    out = windowed.with_indicators(daily, [request("sma", "sma", 3), request("willr", "willr", 3), request("cci", "cci", 3), request("rsi", "rsi", 3), request("atr", "atr", 3)], ["symbol"], ["ts"])
    assert column(out, "sma")[:3] == [None, None, 105.0] and column(out, "sma")[3:] == pytest.approx([108, 110, 112.66667, 114.66667, 116.66667], rel=1e-6)
    assert column(out, "willr")[-1] == pytest.approx(-10.0) and column(out, "cci")[-1] == pytest.approx(100.0)
    assert column(out, "rsi")[-1] == pytest.approx(97.2603, abs=1e-4) and column(out, "rsi")[3] == pytest.approx(90.909, abs=1e-3)
    assert windowed.with_indicators(daily, [request("x", "sma", 1)], ["symbol"], ["ts"]).where("x is not null").count() == 0


def test_frames_start_recursions_anew(daily):
    out = column(windowed.framed(daily, "e", "ema", ["symbol"], ["ts"], 2, 3), "e")
    assert out[:2] == [None, None] and out[2:] == pytest.approx([105, 108, 110, 112.66667, 114.66667, 116.66667], rel=1e-6)


def test_nulls_repeat_the_row_before(spark):
    rows = [("A", 1, 1.0), ("A", 2, 2.0), ("A", 3, None), ("A", 4, 3.0), ("A", 5, None), ("B", 1, None), ("B", 2, 7.0)]
    df = spark.createDataFrame(rows, "symbol string, ts int, close double")
    out = windowed.with_indicators(df, [request("s", "sma", 2), request("e", "ema", 2)], ["symbol"], ["ts"]).orderBy("symbol", "ts").collect()
    assert [r.s for r in out] == [None, 1.5, 1.5, 2.5, 2.5, None, None]
    assert [r.e for r in out] == pytest.approx([None, 1.5, 1.5, 2.5, 2.5, None, None], nan_ok=True)


def test_peers_share_a_value(spark):
    df = spark.createDataFrame([("A", 1, 1.0), ("A", 2, 2.0), ("A", 2, 2.0)], "symbol string, ts int, close double")
    out = windowed.with_indicators(df, [request("s", "sum", 2)], ["symbol"], ["ts"], peers=True).orderBy("ts").collect()
    assert [r.s for r in out] == [None, 4.0, 4.0]


def test_lists(spark):
    df = spark.createDataFrame([([10.0 * k for k in range(1, 11)],), (None,), ([1.0],), ([1.0, None, 3.0],), ([],)], "x array<double>")
    rows = df.select(series.series("sma", "x", period=3).alias("sma"), series.series("roc", "x", period=3).alias("roc"), series.series("linearreg", "x", period=3).alias("line"), series.series("max", "x", period=3).alias("max")).collect()
    assert (rows[0].sma[-1], rows[0].line[-1], rows[0].max[-1]) == pytest.approx((90, 100, 100)) and rows[0].roc[-1] == pytest.approx(42.8571, abs=1e-4)
    assert rows[1].sma is None and rows[2].sma == [None] and rows[4].sma == []
    assert math.isnan(rows[3].sma[2]) and rows[3].sma[:2] == [None, None]


def test_native_windows_equal_kernels(spark):
    """Two ways to compute each indicator: window columns and numpy over the whole series."""
    rng = np.random.default_rng(1)
    n = 160
    c = np.round(100 + np.cumsum(rng.normal(size=n)), 1)
    o = np.round(c + rng.normal(size=n), 1)
    h, lo = np.maximum(o, c) + np.round(abs(rng.normal(size=n)), 1), np.minimum(o, c) - np.round(abs(rng.normal(size=n)), 1)
    v = rng.integers(1, 99, n).astype(float)
    df = spark.createDataFrame([("A", k, *map(float, x)) for k, x in enumerate(zip(o, h, lo, c, v))], "symbol string, ts int, open double, high double, low double, close double, volume double")
    params = {"macd": (12, 26, 9), "bbands": (20, 2.0, 2.0, 0), "stoch": (5, 3, 0, 3, 0), "mama": (0.5, 0.05)}
    asked = [request(f"{i.name}_", i.name, *(params.get(i.name) or tuple(9 for _ in i.params))) for i in ALL.values() if i.name not in ("acos", "asin")]
    got = windowed.with_indicators(df, asked, ["symbol"], ["ts"], skip_nulls=False).orderBy("ts").toPandas()
    data = dict(x=c, open=o, high=h, low=lo, close=c, volume=v)
    for alias, name, p, _ in asked:
        ind = ALL[name]
        for k, want in enumerate(ind.run([data[x] for x in ind.inputs], *p)):
            values = [None if x is None else x[ind.out[k]] for x in got[alias]] if ind.out else got[alias]
            values, skip = np.array(values, float), ind.lookback(*p)
            assert np.isnan(values[:skip]).all() and np.allclose(values[skip:], want[skip:], rtol=1e-7, atol=1e-7, equal_nan=True), name


def test_cycle_kernels_find_a_cycle():
    t = np.arange(400)
    x = 100 + 10 * np.sin(2 * np.pi * t / 20)
    period = ALL["ht_dcperiod"].run([x])[0]
    assert abs(np.median(period[200:]) - 20) < 1.5 and set(ALL["ht_trendmode"].run([x])[0][63:]) <= {0.0, 1.0}
    sine, lead = ALL["ht_sine"].run([x])
    assert np.nanmax(np.abs(sine)) <= 1 and np.nanmax(np.abs(lead)) <= 1
    mama, fama = ALL["mama"].run([x], 0.5, 0.05)
    assert (abs(mama[100:] - 100) < 12).all() and (abs(fama[100:] - 100) < 12).all()


def bars_at(spark, times, closes):
    rows = [("A", t, float(c), float(c) + 1, float(c) - 1) for t, c in zip(times, closes)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double, high double, low double")


def aligned_sma(df, period, **more):
    return [r.s for r in aligned.with_aligned(df, [request("s", "sma", period)], "ts", ["symbol"], **more).orderBy("ts").collect()]


def test_aligned(spark):
    day = dt.datetime(2024, 1, 2)
    at = lambda h, m, d=0: day + dt.timedelta(days=d, hours=h, minutes=m)
    assert aligned_sma(bars_at(spark, [at(9, 31), at(9, 34)], [20, 30]), 3)[-1] == pytest.approx(23.3333, abs=1e-4)  # two bars filled
    assert aligned_sma(bars_at(spark, [at(11, 30), at(13, 1)], [10, 11]), 2)[-1] == 10.5  # lunch is no gap
    assert aligned_sma(bars_at(spark, [at(14, 57), at(15, 0)], [10, 11]), 2)[-1] == 10.5  # nor the closing auction
    assert aligned_sma(bars_at(spark, [at(9, 35), at(9, 40), at(9, 45)], [10, 11, 12]), 2, bar_period=5) == [None, 10.5, 11.5]
    assert aligned_sma(bars_at(spark, [at(15, 0), at(9, 31, 1)], [10, 11]), 2)[-1] == 10.5
    calendar = market.Calendar()
    assert (calendar.set_holiday(dt.date(2024, 1, 3)), calendar.set_holiday(dt.date(2024, 1, 3))) == (1, 0)
    over = bars_at(spark, [at(15, 0), at(9, 31, 2)], [10, 20])
    assert aligned_sma(over, 2, calendar=calendar)[-1] == 15.0 and aligned_sma(over, 2)[-1] == 15.0
    assert aligned_sma(over, 239, calendar=calendar)[-1] is None and aligned_sma(over, 239)[-1] == pytest.approx((238 * 10 + 20) / 239)
    assert calendar.clear_holidays() == 1
    with_null = bars_at(spark, [at(9, 31), at(9, 33)], [10, 20]).union(spark.createDataFrame([("A", at(9, 32), None, None, None)], "symbol string, ts timestamp_ntz, close double, high double, low double"))
    assert aligned_sma(with_null, 2) == [None, None, 15.0]


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first()


def L(*values):
    return F.array(*[F.lit(float(v)) if v is not None else F.lit(None).cast("double") for v in values])


def test_statistics(spark):
    five, ten = L(1, 2, 3, 4, 5), L(2, 4, 6, 8, 10)
    r = one(spark, stats.stat_var(five), stats.stat_cov(five, L(1, 2, 3, 4, 5)), stats.stat_beta(ten, five), stats.stat_max_drawdown(L(100, 120, 80, 90)), stats.stat_corr(five, ten), stats.stat_trend_strength(five), stats.stat_var_historical(five, 0.4), stats.stat_max_drawdown_duration(five))
    assert list(r) == pytest.approx([2.5, 2.5, 2.0, 1 / 3, 1.0, 1.0, 2.0, 1.0])
    k = one(spark, stats.stat_kalman(L(1, 2, 3), 0.0, 1.0), stats.stat_resample(five, 5), stats.stat_resample(L(1, 2, None, 4), 2), stats.stat_resample(L(3, 3), 2))
    assert k.c0 == pytest.approx([1.0, 1.5, 2.0]) and k.c1 == pytest.approx([-1.4142, -0.7071, 0, 0.7071, 1.4142], abs=1e-4) and len(k.c2) == 2 and k.c3 is None
    d = one(spark, stats.stat_dtw(L(1, 2, 3, 2, 1), L(1, 1, 2, 3, 2, 1), 0), stats.stat_ols(L(9, 8, 13, 14, 20), F.array(L(1, 2, 3, 4, 5), L(2, 1, 2, 1, 3))), stats.stat_pca(F.array(L(1, 2, 3), L(2, 4, 6))), stats.stat_cov_matrix(F.array(L(1, 2, 3, 4), L(2, 4, 6, 8))))
    assert d.c0.distance == 0.0 and d.c0.similarity == 1.0 and len(d.c1.coefficients) == 2 and d.c1.r2 > 0.9
    assert d.c2.eigenvalues == pytest.approx([0, 5]) and [x for y in d.c3 for x in y] == pytest.approx([5 / 3, 10 / 3, 10 / 3, 20 / 3])
    g = one(spark, stats.stat_regress(ten, five), stats.stat_skew(five), stats.stat_kurtosis(five), stats.stat_rsi(five, 3), stats.stat_sharpe(five, 0, 1), stats.stat_ewma_vol(five, 0.9), stats.stat_var(L(1)), stats.stat_var(L(1, None, 3)))
    assert tuple(g.c0) == pytest.approx((2, 0, 1, 0), abs=1e-9) and g.c1 == pytest.approx(0) and g.c2 == pytest.approx(-1.3) and g.c3 == 100 and g.c4 == pytest.approx(3 / math.sqrt(2.5)) and g.c5 > 0 and g.c6 is None and g.c7 is None
    x = [1.0, 1.1, 0.9, 1.3, 1.2, 1.5, 1.4, 1.6]
    more = one(spark, stats.stat_garch_vol(L(*x), 252, 0.1, 0.8), stats.stat_coint(L(*x), L(*[2 * v + 0.01 * (-1) ** k for k, v in enumerate(x)])), stats.stat_sortino(L(0.1, -0.2, 0.3), 0, 1), stats.stat_calmar(L(0.1, -0.2, 0.3), 1), stats.stat_information_ratio(L(1, 2, 4), L(0, 1, 1), 1), stats.stat_annual_vol(five, 4), stats.stat_garch_vol(five, 252, 0.9, 0.2))
    assert more.c0 > 0 and more.c1 < 0 and more.c2 == pytest.approx((0.2 / 3) / math.sqrt(0.02)) and more.c3 == pytest.approx((0.2 / 3) / 0.2) and more.c4 == pytest.approx((5 / 3) / np.std([1, 1, 3], ddof=1)) and more.c5 == pytest.approx(2 * math.sqrt(2.5)) and more.c6 is None


def test_rolling(spark):
    df = spark.createDataFrame([(k, float(k), 2.0 * k) for k in range(1, 6)], "rn int, x double, y double")
    w = Window.orderBy("rn").rowsBetween(-2, 0)
    out = df.select("rn", *[stats.rolling(n, w, F.col("x"), F.col("y")).alias(n) for n in ("avg", "sum", "momentum", "rolling_var", "rolling_beta", "rolling_corr")]).orderBy("rn").collect()
    assert [r["avg"] for r in out] == [1, 1.5, 2, 3, 4] and [r["rolling_beta"] for r in out] == [None, 0.5, 0.5, 0.5, 0.5]
    assert [r["rolling_corr"] for r in out][1:] == pytest.approx([1] * 4) and out[2]["momentum"] == 2.0 and out[0]["rolling_var"] is None


def test_market(spark):
    codes = [("600000", False, 0.1), ("688001", False, 0.2), ("300750", True, 0.2), ("830001", False, 0.3), ("600001", True, 0.05), ("920001", None, 0.3), ("6", True, 0.1), (None, True, None)]
    rows = spark.createDataFrame(codes, "code string, st boolean, want double").select("want", market.cn_limit_pct("code", "st").alias("got")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]
    p = one(spark, market.cn_limit_price(F.lit(10.0), F.lit("600000"), F.lit(False)), market.cn_limit_price(F.lit(20.0), F.lit("300750"), F.lit(False)), market.cn_is_st(F.lit("*ST Q")), market.cn_is_st(F.lit(None).cast("string")), market.cn_turnover(F.lit(500000), F.lit(1000000)), market.cn_volume_ratio(F.lit(200.0), L(100, 100)), market.cn_pe_percentile(F.lit(15.0), L(10, 12, 15, 20, 30)), market.cn_adjust_price(F.lit(10.0), F.lit(1.2)), market.cn_change_pct(F.lit(11.0), F.lit(10.0)), market.cn_turnover(F.lit(1), F.lit(0)))
    assert tuple(p.c0) == (11.0, 9.0) and tuple(p.c1) == (24.0, 16.0) and (p.c2, p.c3) == (True, False)
    assert list(p)[4:9] == pytest.approx([0.5, 2.0, 0.6, 12.0, 0.1]) and p.c9 is None
    days = [dt.date(2024, 1, 1), dt.date(2024, 1, 2), dt.date(2024, 1, 6), dt.date(2025, 10, 8), dt.date(2030, 1, 1)]
    got = spark.createDataFrame([(d,) for d in days], "d date").select(market.cn_trading_day("d").alias("x")).collect()
    assert [r.x for r in got] == [False, True, False, False, True] and len(market.BUILT_IN) == 130


def test_wide_table(spark, daily):
    out = wide.indicator_table(daily.union(daily.withColumn("symbol", F.lit("B"))), ["symbol"])
    assert out.count() == 16 and len(out.columns) == len(daily.columns) + 51 + 18 + 2 + 14 + 7
    last = out.where("symbol = 'B'").orderBy(F.desc("ts")).first()
    assert last.sma5 == pytest.approx(114.8) and last.sma10 is None and last.stat_var == pytest.approx(np.var(CLOSE, ddof=1)) and last.roll_avg is None
    assert wide.indicator_table(daily.drop("volume"), ["symbol"]).first().ad is None


def test_sql_names(spark):
    names = sql.register(spark)
    assert len(names) > 250
    spark.createDataFrame([("A", k, float(x)) for k, x in enumerate((102, 107, 106, 111))] + [("B", 0, None)], "s string, ts int, x double").createOrReplaceTempView("prices")
    rows = spark.sql("SELECT s, ts, cta_sma(x, 3) OVER (PARTITION BY s ORDER BY ts ROWS 2 PRECEDING) a, cta_ema(x, 3) OVER (PARTITION BY s ORDER BY ts) e FROM prices ORDER BY s, ts").collect()
    assert [r.a for r in rows] == [None, None, 105.0, 108.0, None] and [r.e for r in rows] == [None, None, 105.0, 108.0, None]
    assert spark.sql("SELECT cta_max(x, 4) m FROM prices WHERE s = 'A'").first().m == 111.0
    r = spark.sql("SELECT ct_sma(array(1D, 2D, 3D, 4D, 5D), 3) a, ct_minmax(array(1D, 2D, 3D), 2) b, stat_rsi(array(1D, 2D, 3D, 4D), 2) c, cn_is_st('ST x') d, cn_limit_pct('688001', false) e, cn_trading_day(DATE'2024-01-01') f, cn_volume_ratio(2D, array(1D, 1D)) g").first()
    assert r.a == [None, None, 2.0, 3.0, 4.0] and r.b[1]["max"] == 2.0 and (r.c, r.d, r.e, r.f, r.g) == (100.0, True, 0.2, False, 2.0)


def test_csv_and_plain_aggregate(spark, tmp_path, daily):
    path = str(tmp_path / "bars.csv")
    daily.select("symbol", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(ts)").alias("ts"), "open", "high", "low", "close", "volume").write.option("header", True).csv(path)
    back = bars.read_csv(spark, path)
    assert back.count() == 8
    assert series.last_value(back, "sma", ["symbol"], "ts", ["close"], period=8).first().sma == pytest.approx(111.125)
