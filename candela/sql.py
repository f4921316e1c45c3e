"""SQL names: register(spark), then ct_sma(list, 20), cta_sma(close, 20) OVER (...), cn_is_st(name).

Each is a session function. ct_<name> is an indicator over lists; cta_<name> is one as an aggregate, of
a group or a window frame, of a single output (Spark's vectorised aggregates give no structs: use
with_indicators for those). A frame is computed afresh for each row; with_indicators is the fast way.
The market rules are SQL expressions, which Catalyst inlines. Statistics of lists that are Arrow
functions keep their names; the others are columns (functions.stats).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import stats
from .functions.market import BUILT_IN
from .functions.registry import ALL, Indicator
from .operators.series import list_udf

_SQL = {
    "cn_is_st(name STRING)": ("BOOLEAN", "coalesce(contains(name, 'ST') OR contains(name, 'st'), false)"),
    "cn_limit_pct(code STRING, is_st BOOLEAN)": ("DOUBLE", "CASE WHEN code IS NULL THEN NULL WHEN length(code) < 2 THEN 0.10D WHEN code LIKE '688%' OR code LIKE '30%' THEN 0.20D WHEN code LIKE '8%' OR code LIKE '4%' OR code LIKE '92%' THEN 0.30D WHEN coalesce(is_st, false) THEN 0.05D ELSE 0.10D END"),
    "cn_change_pct(now DOUBLE, before DOUBLE)": ("DOUBLE", "CASE WHEN abs(before) >= 1e-12 THEN try_divide(now - before, before) END"),
    "cn_turnover(volume DOUBLE, shares DOUBLE)": ("DOUBLE", "CASE WHEN abs(shares) >= 1e-12 THEN try_divide(volume, shares) END"),
    "cn_adjust_price(price DOUBLE, factor DOUBLE)": ("DOUBLE", "price * factor"),
    "cn_volume_ratio(volume DOUBLE, history ARRAY<DOUBLE>)": ("DOUBLE", "CASE WHEN aggregate(history, 0D, (s, v) -> s + coalesce(v, 0D)) / nullif(size(history), 0) >= 1e-12 THEN try_divide(volume, aggregate(history, 0D, (s, v) -> s + coalesce(v, 0D)) / nullif(size(history), 0)) END"),
    "cn_pe_percentile(pe DOUBLE, history ARRAY<DOUBLE>)": ("DOUBLE", "CASE WHEN size(history) > 0 AND pe IS NOT NULL THEN size(filter(history, v -> coalesce(v, 0D) <= pe)) / nullif(size(history), 0) END"),
    "cn_trading_day(day DATE)": ("BOOLEAN", "weekday(day) < 5 AND NOT array_contains(array({days}), day)"),
}


def _aggregate(ind: Indicator):
    """The indicator's last value over the rows without nulls; parameters are constants of the group."""
    many = len(ind.inputs)

    def last(*args: pd.Series) -> float:
        data = [a.to_numpy(float, na_value=np.nan) for a in args[:many]]
        known = ~np.any([np.isnan(d) for d in data], axis=0)
        if not len(known) or any(pd.isna(a.iloc[0]) for a in args[many:]):
            return None
        found = ind.run([d[known] for d in data], *(int(a.iloc[0]) for a in args[many:]))[0]
        return None if found is None or np.isnan(found[-1]) else int(found[-1]) if ind.integer else float(found[-1])

    return F.pandas_udf(last, "int" if ind.integer else "double")


def register(spark: SparkSession) -> list[str]:
    """The names that were registered."""
    names = []
    for name in ALL:
        spark.udf.register(f"ct_{name}", list_udf(name))
        names.append(f"ct_{name}")
        if not ALL[name].out:
            spark.udf.register(f"cta_{name}", _aggregate(ALL[name]))
            names.append(f"cta_{name}")
    for name in stats._KINDS:
        spark.udf.register(name, stats.arrow(name))
        names.append(name)
    days = ", ".join(f"DATE'{d}'" for d in BUILT_IN)
    for head, (kind, body) in _SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body.format(days=days)}")
        names.append(head.partition("(")[0])
    return names
