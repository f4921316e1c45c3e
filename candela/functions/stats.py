"""Statistics of lists of numbers and of list pairs, as columns, and rolling statistics as window columns.

Null elements are NaN; a NaN result is null; lists of unequal lengths give null. What array functions
can express stays in them; regression on several variables, eigenvectors, cointegration, the Kalman
filter and time warping are Arrow functions over numpy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

NAN = float("nan")


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _let(value: Column, f) -> Column:
    return F.transform(F.array(value), f)[0]


def _clean(x) -> Column:
    return F.transform(_col(x), lambda v: F.coalesce(v.cast("double"), F.lit(NAN)))


def _sum(x: Column, f=lambda v: v) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + f(v))


def _mean(x: Column) -> Column:
    return _sum(x) / F.size(x)


def _known(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / F.when(b != 0, b))


def _one(x, least: int, f) -> Column:
    """f(values, mean) where there are `least` values at least."""
    return _let(_clean(x), lambda c: F.when(F.size(c) >= least, _known(_let(_mean(c), lambda m: f(c, m)))))


def _two(x, y, least: int, f) -> Column:
    """f(deviations as structs a, b; mean a; mean b) where both are as long."""
    pair = F.zip_with(_clean(x), _clean(y), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    ok = (F.size(_col(x)) == F.size(_col(y))) & (F.size(_col(x)) >= least)
    means = lambda p: F.struct((_sum(p, lambda v: v["a"]) / F.size(p)).alias("a"), (_sum(p, lambda v: v["b"]) / F.size(p)).alias("b"))
    return F.when(ok, _let(pair, lambda p: _let(means(p), lambda m: f(F.transform(p, lambda v: F.struct((v["a"] - m["a"]).alias("a"), (v["b"] - m["b"]).alias("b"))), m["a"], m["b"]))))


def stat_var(x) -> Column:
    """Sample variance."""
    return _one(x, 2, lambda c, m: _sum(c, lambda v: (v - m) * (v - m)) / (F.size(c) - 1))


def stat_stddev(x) -> Column:
    return F.sqrt(stat_var(x))


def _drawdown(x: Column) -> Column:
    start = F.struct(F.lit(float("-inf")).alias("peak"), F.lit(0.0).alias("most"))

    def step(s, v):
        peak = F.when(F.isnan(v), s["peak"]).otherwise(F.greatest(s["peak"], v))
        fall = F.when(~F.isnan(v) & (peak > 0), (peak - v) / F.when(peak > 0, peak)).otherwise(0.0)
        return F.struct(peak.alias("peak"), F.greatest(s["most"], fall).alias("most"))

    return F.aggregate(x, start, step, lambda s: s["most"])


def stat_max_drawdown(x) -> Column:
    """Largest fall from a peak, as a share of it; NaN for an empty list."""
    return _let(_clean(x), lambda c: F.when(F.size(c) > 0, _drawdown(c)).when(F.size(c) == 0, F.lit(NAN)))


def stat_sharpe(x, risk_free, per_year) -> Column:
    return _let(stat_stddev(x), lambda s: _known(_ratio(_mean(_clean(x)) - risk_free, s) * F.sqrt(F.lit(float(per_year)))))


def stat_ewma_vol(x, decay) -> Column:
    if not 0 < decay < 1:
        return F.lit(None).cast("double")
    step = lambda s, v: (1 - decay) * v * v + decay * s
    return _one(x, 1, lambda c, m: F.sqrt(F.aggregate(c, F.lit(0.0), step)))


def stat_cov(x, y) -> Column:
    return _two(x, y, 2, lambda d, a, b: _known(_sum(d, lambda v: v["a"] * v["b"]) / (F.size(d) - 1)))


def stat_corr(x, y) -> Column:
    return _two(x, y, 2, lambda d, a, b: _known(_ratio(_sum(d, lambda v: v["a"] * v["b"]), F.sqrt(_sum(d, lambda v: v["a"] * v["a"]) * _sum(d, lambda v: v["b"] * v["b"])))))


def stat_beta(asset, market) -> Column:
    return _two(asset, market, 2, lambda d, a, b: _known(_ratio(_sum(d, lambda v: v["a"] * v["b"]), _sum(d, lambda v: v["b"] * v["b"]))))


def stat_regress(y, x) -> Column:
    """Least squares of y on x: slope, intercept, r2 (NaN for a constant y), std_err (0 with two points)."""

    def fit(d, my, mx):
        n = F.size(d)
        sxx, sxy, syy = _sum(d, lambda v: v["b"] * v["b"]), _sum(d, lambda v: v["a"] * v["b"]), _sum(d, lambda v: v["a"] * v["a"])

        def out(s):
            left = _sum(d, lambda v: (v["a"] - s["slope"] * v["b"]) * (v["a"] - s["slope"] * v["b"]))
            mse = F.when(n > 2, left / F.when(n > 2, n - 2)).otherwise(0.0)
            r2 = F.when(s["syy"] == 0, F.lit(NAN)).otherwise(1 - left / F.when(s["syy"] != 0, s["syy"]))
            return F.struct(s["slope"].alias("slope"), (my - s["slope"] * mx).alias("intercept"), r2.alias("r2"), F.sqrt(mse / s["sxx"]).alias("std_err"))

        sums = F.struct(sxx.alias("sxx"), syy.alias("syy"), (sxy / F.when(sxx != 0, sxx)).alias("slope"))
        return _let(sums, lambda s: F.when(s["sxx"] != 0, out(s)))

    return _two(y, x, 2, fit)


def _moments(c: Column, m: Column, k: int, n) -> Column:
    power = lambda v, p: (v - m) if p == 1 else (v - m) * power(v, p - 1)
    return _let(_sum(c, lambda v: power(v, 2)) / n, lambda two: F.when(two != 0, (_sum(c, lambda v: power(v, k)) / n) / F.pow(F.when(two != 0, two), F.lit(k / 2))))


def stat_skew(x) -> Column:
    return _one(x, 3, lambda c, m: _moments(c, m, 3, F.size(c)))


def stat_kurtosis(x) -> Column:
    return _one(x, 4, lambda c, m: _moments(c, m, 4, F.size(c)) - 3)


def stat_annual_vol(x, per_year) -> Column:
    return stat_stddev(x) * F.sqrt(F.lit(float(per_year)))


def stat_sortino(x, target, per_year) -> Column:
    low = lambda v: F.when(v < target, (v - target) * (v - target)).when(F.isnan(v), F.lit(NAN)).otherwise(0.0)
    return _one(x, 2, lambda c, m: _ratio(m - target, F.sqrt(_sum(c, low) / (F.size(c) - 1))) * F.sqrt(F.lit(float(per_year))))


def stat_information_ratio(x, y, per_year) -> Column:
    both = F.zip_with(_clean(x), _clean(y), lambda a, b: a - b)
    return F.when(F.size(_col(x)) == F.size(_col(y)), _one(both, 2, lambda c, m: _ratio(m, F.sqrt(_sum(c, lambda v: (v - m) * (v - m)) / (F.size(c) - 1))) * F.sqrt(F.lit(float(per_year)))))


def stat_calmar(x, per_year) -> Column:
    start = F.struct(F.lit(1.0).alias("nav"), F.lit(1.0).alias("peak"), F.lit(0.0).alias("most"))

    def step(s, v):
        nav = s["nav"] * (1 + v)
        peak = F.greatest(s["peak"], nav)
        return F.struct(nav.alias("nav"), peak.alias("peak"), F.greatest(s["most"], F.when(peak > 0, (peak - nav) / F.when(peak > 0, peak)).otherwise(0.0)).alias("most"))

    return _one(x, 2, lambda c, m: _ratio(m * per_year, F.aggregate(c, start, step, lambda s: s["most"])))


def stat_var_historical(x, alpha) -> Column:
    if not 0 < alpha < 1:
        return F.lit(None).cast("double")
    return _one(x, 1, lambda c, m: F.try_element_at(F.sort_array(c), F.greatest(F.lit(1), F.ceil(F.lit(alpha) * F.size(c)).cast("int"))))


def stat_max_drawdown_duration(x) -> Column:
    """Longest stretch from a peak to a later bar under it or to the next peak; NaN below two values."""
    start = F.struct(F.lit(0).alias("k"), F.lit(float("-inf")).alias("peak"), F.lit(0).alias("at"), F.lit(0).alias("most"))

    def step(s, v):
        new = v >= s["peak"]
        run = F.when(s["k"] > 0, s["k"] - s["at"]).otherwise(0)
        return F.struct((s["k"] + 1).alias("k"), F.when(new, v).otherwise(s["peak"]).alias("peak"), F.when(new, s["k"]).otherwise(s["at"]).alias("at"), F.greatest(s["most"], run).alias("most"))

    return _let(_clean(x), lambda c: F.when(F.size(c) >= 2, F.aggregate(c, start, step, lambda s: s["most"].cast("double"))).when(F.size(c) >= 0, F.lit(NAN)))


def stat_trend_strength(x) -> Column:
    index = F.transform(_clean(x), lambda v, k: k.cast("double"))
    r = _two(x, index, 3, lambda d, a, b: _ratio(F.pow(_sum(d, lambda v: v["a"] * v["b"]), F.lit(2.0)), _sum(d, lambda v: v["a"] * v["a"]) * _sum(d, lambda v: v["b"] * v["b"])))
    return _known(r)


def stat_cov_matrix(rows) -> Column:
    """Sample covariances of a list of variables, each a list."""
    rows = F.filter(_col(rows), lambda v: v.isNotNull())
    n = F.size(rows[0])
    ragged = F.exists(rows, lambda v: F.size(v) != n)
    cells = F.transform(rows, lambda a: F.transform(rows, lambda b: stat_cov(a, b)))
    return F.when((F.size(rows) > 0) & (n >= 2) & ~ragged, cells)


def stat_resample(x, n: int) -> Column:
    """Population z-scores of the known values, linearly interpolated at n points from first to last."""
    if n is None or n < 2:
        return F.lit(None).cast("array<double>")
    known = F.filter(_clean(x), lambda v: ~F.isnan(v))

    def scaled(c):
        m = _mean(c)
        return _let(m, lambda u: _let(F.sqrt(_sum(c, lambda v: (v - u) * (v - u)) / F.size(c)), lambda s: F.when(s > 0, F.transform(c, lambda v: (v - u) / F.when(s > 0, s)))))

    def points(z):
        def at(k):
            return _let(k.cast("double") * (F.size(z) - 1) / F.lit(float(n - 1)), lambda p: _let(F.least(F.floor(p).cast("int"), F.size(z) - 2), lambda i: F.get(z, i) + (F.get(z, i + 1) - F.get(z, i)) * (p - i)))

        return F.when(F.size(z) == n, z).otherwise(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at))

    return _let(known, lambda c: F.when(F.size(c) >= 2, _let(scaled(c), lambda z: F.when(z.isNotNull(), points(z)))))


# --- numpy kernels ----------------------------------------------------------------------------------


def _array(x) -> np.ndarray:
    return np.array([NAN if v is None else v for v in x], float)


def _fine(v):
    return None if v is None or np.isnan(v) else float(v)


def _rsi(x, period):
    x, p = _array(x), int(period)
    if p < 1 or len(x) < p + 1:
        return None
    d = np.diff(x)
    gain, loss = np.maximum(d[:p], 0).mean(), np.maximum(-d[:p], 0).mean()
    for v in d[p:]:
        gain, loss = (gain * (p - 1) + max(v, 0.0)) / p, (loss * (p - 1) + max(-v, 0.0)) / p
    return 100.0 if loss == 0 else _fine(100 - 100 / (1 + gain / loss))


def _garch(x, per_year, alpha, beta):
    x = _array(x)
    if len(x) < 5 or alpha < 0 or beta < 0 or alpha + beta >= 1:
        return None
    r = np.array([np.log(b / a) for a, b in zip(x, x[1:]) if a > 0 and b > 0])
    if len(r) < 4:
        return None
    s2 = r.var(ddof=1)
    omega, v = (1 - alpha - beta) * s2, s2
    for e in r:
        v = omega + alpha * e * e + beta * v
    return _fine(np.sqrt(max(v, 0)) * np.sqrt(per_year))


def _coint(x, y):
    x, y = _array(x), _array(y)
    if len(x) != len(y) or len(x) < 6:
        return None
    a = np.column_stack([np.ones(len(x)), x])
    e = y - a @ np.linalg.lstsq(a, y, rcond=None)[0]
    d, lag = np.diff(e), np.column_stack([np.ones(len(e) - 1), e[:-1]])
    coef = np.linalg.lstsq(lag, d, rcond=None)[0]
    rest = d - lag @ coef
    free = len(d) - 2
    det = np.linalg.det(lag.T @ lag)
    if free <= 0 or abs(det) < 1e-300:
        return None
    error = np.sqrt((rest @ rest) / free * np.linalg.inv(lag.T @ lag)[1, 1])
    return _fine(coef[1] / error) if error > 0 else None


def _ols(y, rows):
    y, rows = _array(y), [_array(r) for r in rows if r is not None]
    if not rows or any(len(r) != len(y) for r in rows) or len(y) < len(rows) + 1:
        return None
    a = np.column_stack([*rows, np.ones(len(y))])
    coef = np.linalg.lstsq(a, y, rcond=None)[0]
    sst = ((y - y.mean()) ** 2).sum()
    return {"coefficients": coef[:-1].tolist(), "intercept": float(coef[-1]), "r2": float(1 - ((y - a @ coef) ** 2).sum() / sst) if sst else NAN}


def _pca(rows):
    rows = [_array(r) for r in rows if r is not None]
    if not rows or len({len(r) for r in rows}) > 1 or len(rows[0]) < 2:
        return None
    cov = np.atleast_2d(np.cov(np.array(rows)))
    if np.isnan(cov).any():
        return None
    values, vectors = np.linalg.eigh(cov)
    signs = np.sign(vectors[np.abs(vectors).argmax(0), range(len(values))])  # the largest part is positive
    return {"eigenvalues": values.tolist(), "eigenvectors": (vectors * signs).T.tolist()}


def _kalman(z, q, r):
    if not z or r <= 0 or q < 0:
        return None
    out, x, p = [], None, 1.0
    for v in _array(z):
        if x is None:
            x = None if np.isnan(v) else float(v)
        elif not np.isnan(v):
            p += q
            gain = p / (p + r)
            x, p = x + gain * (float(v) - x), (1 - gain) * p
        out.append(x)
    return out


def _dtw(a, b, window):
    a, b = (x[~np.isnan(x)] for x in (_array(a), _array(b)))
    n, m = len(a), len(b)
    if not n or not m:
        return None
    w = int(window) if window and window > 0 else max(n, m)
    a, b, inf = a.tolist(), b.tolist(), float("inf")
    # rows of the band only: row i holds the columns from starts[i] on; outside it the cost is infinite
    starts, rows = [0], [[0.0] + [inf] * min(m, w)]
    for i in range(1, n + 1):
        lo, hi, start, above, x = max(1, i - w), min(m, i + w), starts[-1], rows[-1], a[i - 1]
        row, left, size = [], inf, len(above)
        for j in range(lo, hi + 1):
            k = j - start
            diagonal = above[k - 1] if 0 < k <= size else inf
            up = above[k] if 0 <= k < size else inf
            left = abs(x - b[j - 1]) + min(diagonal, up, left)
            row.append(left)
        starts.append(lo)
        rows.append(row)

    def cost(i, j):
        k = j - starts[i]
        return rows[i][k] if 0 <= k < len(rows[i]) else inf

    i, j, lags = n, m, []
    while i > 0 and j > 0:
        lags.append(j - i)
        diagonal, up, left = cost(i - 1, j - 1), cost(i - 1, j), cost(i, j - 1)
        if diagonal <= up and diagonal <= left:
            i, j = i - 1, j - 1
        elif up <= left:
            i -= 1
        else:
            j -= 1
    lags.sort()
    distance = cost(n, m)
    return {"distance": distance, "lag": lags[len(lags) // 2], "similarity": 1 / (1 + distance / (n + m))}


_KINDS = {
    "stat_rsi": (_rsi, "double"), "stat_garch_vol": (_garch, "double"), "stat_coint": (_coint, "double"), "stat_kalman": (_kalman, "array<double>"),
    "stat_ols": (_ols, "struct<coefficients: array<double>, intercept: double, r2: double>"),
    "stat_pca": (_pca, "struct<eigenvalues: array<double>, eigenvectors: array<array<double>>>"),
    "stat_dtw": (_dtw, "struct<distance: double, lag: int, similarity: double>"),
}
_ARROW = {
    "double": pa.float64(), "array<double>": pa.list_(pa.float64()),
    _KINDS["stat_ols"][1]: pa.struct([("coefficients", pa.list_(pa.float64())), ("intercept", pa.float64()), ("r2", pa.float64())]),
    _KINDS["stat_pca"][1]: pa.struct([("eigenvalues", pa.list_(pa.float64())), ("eigenvectors", pa.list_(pa.list_(pa.float64())))]),
    _KINDS["stat_dtw"][1]: pa.struct([("distance", pa.float64()), ("lag", pa.int32()), ("similarity", pa.float64())]),
}


def arrow(name: str):
    """The Arrow function of a statistic, of lists and numbers."""
    f, kind = _KINDS[name]

    def run(*args: pa.Array) -> pa.Array:
        rows = zip(*(a.to_pylist() for a in args))
        return pa.array([None if any(x is None for x in r) else f(*r) for r in rows], _ARROW[kind])

    return F.arrow_udf(run, kind)


def _call(name, *args) -> Column:
    return arrow(name)(*[F.col(a) if isinstance(a, str) else a if isinstance(a, Column) else F.lit(a) for a in args])


def stat_rsi(x, period) -> Column:
    """Wilder's index of the last value; 100 where there is no loss."""
    return _call("stat_rsi", x, period)


def stat_garch_vol(x, per_year, alpha, beta) -> Column:
    return _call("stat_garch_vol", x, float(per_year), float(alpha), float(beta))


def stat_coint(x, y) -> Column:
    """t-statistic of the residuals' reversion."""
    return _call("stat_coint", x, y)


def stat_ols(y, rows) -> Column:
    return _call("stat_ols", y, rows)


def stat_pca(rows) -> Column:
    """Eigenvalues of the covariance in ascending order, and their vectors."""
    return _call("stat_pca", rows)


def stat_kalman(z, q, r) -> Column:
    return _call("stat_kalman", z, float(q), float(r))


def stat_dtw(a, b, window=0) -> Column:
    return _call("stat_dtw", a, b, int(window))


LISTS = {n: f for n, f in globals().items() if n.startswith("stat_")}

# --- rolling forms ----------------------------------------------------------------------------------


def pearson(a: Column, b: Column, w: WindowSpec, least: float = 0.0) -> Column:
    """Correlation over a window of pairs without nulls; null where a spread is not above `least`."""
    n = F.count(a).over(w)
    spread = n * F.sqrt(F.var_pop(a).over(w) * F.var_pop(b).over(w))
    return F.when((n >= 2) & (spread > least), n * F.covar_pop(a, b).over(w) / F.when(spread > 0, spread))


def rolling(name: str, w: WindowSpec, x: Column, y: Column | None = None) -> Column:
    """A statistic over the rows of a window, by name: avg, sum, min, max, momentum, rolling_var,
    rolling_stddev, rolling_beta, rolling_corr. Pairs leave out rows with a null on either side."""
    known = F.count(x).over(w)
    if name in ("avg", "sum", "min", "max"):
        return getattr(F, name)(x).over(w)
    if name == "momentum":
        first, last = F.first(x, True).over(w), F.last(x, True).over(w)
        return F.when((known >= 2) & (F.abs(first) >= 1e-12), (last - first) / F.abs(F.when(first != 0, first)))
    if name == "rolling_var":
        return F.var_samp(x).over(w)
    if name == "rolling_stddev":
        return F.stddev_samp(x).over(w)
    both = F.count(F.when(x.isNotNull() & y.isNotNull(), 1)).over(w)
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    spread = lambda v: F.var_pop(v).over(w) * both
    if name == "rolling_beta":
        return F.when((both >= 2) & (spread(b) >= 1e-12), F.regr_slope(a, b).over(w))
    return pearson(a, b, w, 1e-12)
