"""One table of indicators for bars: every column in one plan.

Bars have ts, open, high, low, close and, where there, volume, amount, outstanding_share, turnover.
Columns that need what is missing are null (volume) or left out (amount, outstanding_share); other
columns pass through. Each partition is a series of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.registry import ALL
from ..functions.stats import pearson
from .windowed import Frame, request, with_indicators

_PERIODS = {
    "sma": (5, 10, 20, 60), "ema": (5, 10, 20, 60), "wma": (10,), "dema": (10,), "tema": (10,), "trima": (10,), "kama": (10,), "midpoint": (10,),
    "rsi": (6, 12, 24), "cmo": (14,), "mom": (10,), "roc": (10,), "rocp": (10,), "rocr": (10,), "rocr100": (10,), "trix": (12,),
    "linearreg": (14,), "linearreg_slope": (14,), "linearreg_intercept": (14,), "linearreg_angle": (14,), "tsf": (14,), "sum": (10,), "max": (10,), "min": (10,),
    "atr": (14,), "natr": (14,), "willr": (14,), "cci": (14,), "adx": (14,), "adxr": (14,), "dx": (14,), "plus_di": (14,), "minus_di": (14,),
    "midprice": (14,), "plus_dm": (14,), "minus_dm": (14,),
}
_PLAIN = ("ad", "avgprice", "bop", "medprice", "trange", "typprice", "wclprice")
_MANY = {"bbands": (20, 2.0, 2.0, 0), "macd": (12, 26, 9), "stoch": (5, 3, 0, 3, 0), "aroon": (14,), "minmax": (20,), "mama": (0.5, 0.05), "ht_phasor": (), "ht_sine": ()}


def flat_name(n: str, f: str) -> str:
    """The column of an output field of an indicator with several."""
    return f if f.startswith(n) or n in ("macd", "bbands", "stoch", "aroon", "mama") and f in ("macd", "mama", "fama", "slowk", "slowd", "aroon_up", "aroon_down") else f"{n}_{f}"


def _null_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def indicator_table(bars: DataFrame, partition: list[str], ts: str = "ts") -> DataFrame:
    """bars with every indicator column; NaN becomes null."""
    names = bars.columns
    has = set(names)
    if "volume" not in has:
        bars = bars.withColumn("volume", F.lit(None).cast("double"))
    asked = [request(f"{n}{p}", n, p) for n, ps in _PERIODS.items() for p in ps] + [request(f"_{n}", n, *ps) for n, ps in _MANY.items()]
    asked += [request(n, n) for n in _PLAIN if n != "ad" or "volume" in has]
    # window columns first: they leave the rows dealt and sorted for the one pass over the recursive ones
    later = [r for r in asked if ALL[r[1]].kind == "R" and r[1] not in ("bbands", "stoch")]
    df = with_indicators(bars, [r for r in asked if r not in later], partition, [ts], skip_nulls=False)
    if "volume" not in has:
        df = df.withColumn("ad", F.lit(None).cast("double"))
    fields = {n: ALL[n].out for n in _MANY}
    flat = {flat_name(n, f): F.col(f"_{n}")[f] for n, fs in fields.items() for f in fs}
    frame = Frame(partition, [ts])
    c, v, before = F.col("close"), F.col("volume"), F.lag("close").over(frame.base)
    prior = F.avg("volume").over(frame.base.rowsBetween(-5, -1))
    many = F.count("volume").over(frame.base.rowsBetween(-5, -1))
    share = lambda a, b: F.when(F.abs(b) >= 1e-12, a / F.when(b != 0, b))
    derived = {"pct_change": share(c - before, before), "volume_ratio": F.when(many == 5, share(v, prior))}
    if "amount" in has:
        derived |= {f"amount_ma{p}": F.when(F.count("amount").over(frame.last(p)) == p, F.avg("amount").over(frame.last(p))) for p in (5, 10)}
    if "outstanding_share" in has:
        derived["turnover_calc"] = share(v, F.col("outstanding_share"))
    df = df.withColumns(derived | {"_r": F.when((c > 0) & (before > 0), F.log(c / F.when(before > 0, before))), "_k": F.row_number().over(frame.base), "_up": F.max("close").over(frame.full)})
    whole = frame.base.rowsBetween(-(2**63), 2**63 - 1)
    w20, full20 = frame.last(20), F.col("_k") >= 20
    n, m = F.count("close").over(whole), F.avg("close").over(whole)
    df = df.withColumns({"_n": n, "_fall": F.when(F.col("_up") > 0, (F.col("_up") - c) / F.when(F.col("_up") > 0, F.col("_up")))})
    sd = F.stddev_samp("_r").over(whole)
    slope = F.regr_slope("close", "volume").over(whole)
    both = pearson(F.when(v.isNotNull(), c), F.when(c.isNotNull(), v), whole)
    r2 = both * both
    trend = pearson(c, F.when(c.isNotNull(), F.col("_k").cast("double")), whole)
    left = F.regr_syy("close", "volume").over(whole) * (1 - r2)
    sxx = F.regr_sxx("close", "volume").over(whole)
    whole_series = {
        "stat_var": F.var_samp("close").over(whole),
        "stat_stddev": F.stddev_samp("close").over(whole),
        "stat_skew": F.when(n >= 3, F.skewness("close").over(whole)),
        "stat_kurtosis": F.when(n >= 4, F.kurtosis("close").over(whole)),
        "stat_max_drawdown": F.max("_fall").over(whole),
        "stat_sharpe": F.when(sd > 0, F.avg("_r").over(whole) / F.when(sd > 0, sd) * F.sqrt(F.lit(252.0))),
        "stat_annual_vol": sd * F.sqrt(F.lit(252.0)),
        "stat_corr_close_vol": both,
        "stat_beta": slope,
        "stat_regress_slope": slope,
        "stat_regress_intercept": F.regr_intercept("close", "volume").over(whole),
        "stat_regress_r2": r2,
        "stat_regress_std_err": F.when((n > 2) & (sxx > 0), F.sqrt(left / F.when(n > 2, n - 2) / F.when(sxx > 0, sxx))),
        "stat_trend_strength": F.when(n >= 3, trend * trend),
    }
    first = F.first("close").over(w20)
    rolled = {
        "roll_avg": F.avg("close").over(w20),
        "roll_sum": F.sum("close").over(w20),
        "roll_momentum": F.when(F.abs(first) >= 1e-12, (c - first) / F.abs(F.when(first != 0, first))),
        "roll_var": F.var_samp("close").over(w20),
        "roll_stddev": F.stddev_samp("close").over(w20),
        "roll_min": F.min("low").over(w20),
        "roll_max": F.max("high").over(w20),
    }
    df = df.withColumns(whole_series | {k: F.when(full20, x) for k, x in rolled.items()})
    df = with_indicators(df, later, partition, [ts], skip_nulls=False).withColumns(flat)
    out = [r[0] for r in asked if not r[0].startswith("_")] + (["ad"] if "volume" not in has else []) + [*flat, *derived, *whole_series, *rolled]
    return df.select(*names, *[_null_nan(F.col(x)).alias(x) for x in dict.fromkeys(out)])
