"""Indicator kernels over whole series: numpy arrays in, an array as long as the input out.

Values before a kernel's first output are NaN; registry.lookback says how many. Window kernels work
on strided views, recursive ones step through the series once. Seeds, ties and zero denominators
follow the published definitions of the indicators.
"""

from __future__ import annotations

import math

import numpy as np

NAN = float("nan")


def _full(n: int, start: int, values) -> np.ndarray:
    out = np.full(n, NAN)
    if start < n:
        out[start:] = values
    return out


def _view(x: np.ndarray, p: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(x, p)


def _ratio(a, b, other=0.0):
    b = np.asarray(b, float)
    zero = b == 0
    return np.where(zero, other, np.asarray(a, float) / np.where(zero, 1.0, b))


def rolling(f):
    def kernel(x, p):
        return _full(len(x), p - 1, f(_view(x, p)) if len(x) >= p else [])

    return kernel


sma = rolling(lambda v: v.mean(1))
total = rolling(lambda v: v.sum(1))
highest = rolling(lambda v: v.max(1))
lowest = rolling(lambda v: v.min(1))
midpoint = rolling(lambda v: (v.max(1) + v.min(1)) / 2)


def wma(x, p):
    w = np.arange(1, p + 1)
    return rolling(lambda v: v @ w / w.sum())(x, p)


def trima(x, p):
    w = np.convolve(np.ones((p + 1) // 2), np.ones(p - (p + 1) // 2 + 1))
    return rolling(lambda v: v @ w / w.sum())(x, p)


def maxindex(x, p):
    n = len(x)
    return _full(n, p - 1, np.arange(p - 1, n) - np.argmax(_view(x, p)[:, ::-1], 1) if n >= p else [])


def minindex(x, p):
    return maxindex(-x, p)


def _line(x, p):
    """Mean and slope of the least-squares line over each window."""
    t = np.arange(p) - (p - 1) / 2
    v = _view(x, p)
    return v.mean(1), v @ t / (t @ t)


def _line_kernel(f):
    def kernel(x, p):
        return _full(len(x), p - 1, f(*_line(x, p), p) if len(x) >= p else [])

    return kernel


linearreg = _line_kernel(lambda m, s, p: m + s * (p - 1) / 2)
linearreg_slope = _line_kernel(lambda m, s, p: s)
linearreg_intercept = _line_kernel(lambda m, s, p: m - s * (p - 1) / 2)
linearreg_angle = _line_kernel(lambda m, s, p: np.degrees(np.arctan(s)))
tsf = _line_kernel(lambda m, s, p: m + s * (p + 1) / 2)


def _lagged(f):
    def kernel(x, p):
        return _full(len(x), p, f(x[p:], x[:-p]) if len(x) > p else [])

    return kernel


mom = _lagged(lambda a, b: a - b)
roc = _lagged(lambda a, b: np.where(b == 0, 0.0, (_ratio(a, b) - 1) * 100))
rocp = _lagged(lambda a, b: _ratio(a - b, b))
rocr = _lagged(_ratio)
rocr100 = _lagged(lambda a, b: _ratio(a, b) * 100)


def ema(x, p, start=None):
    """Seeded by the mean of the p values that end at `start` (the p-th by default)."""
    n, start = len(x), p - 1 if start is None else start
    out = np.full(n, NAN)
    if start >= n or start < p - 1:
        return out
    k, e = 2.0 / (p + 1), float(np.mean(x[start - p + 1 : start + 1]))
    values = [e]
    for v in x[start + 1 :].tolist():
        e += (v - e) * k
        values.append(e)
    out[start:] = values
    return out


def _again(x, p, f=ema):
    """f over the outputs of x, in place."""
    start = int(np.argmax(~np.isnan(x))) if not np.isnan(x).all() else len(x)
    return _full(len(x), start, f(x[start:], p)) if start < len(x) else x


def dema(x, p):
    one = ema(x, p)
    return 2 * one - _again(one, p)


def tema(x, p):
    one = ema(x, p)
    two = _again(one, p)
    return 3 * one - 3 * two + _again(two, p)


def trix(x, p):
    three = _again(_again(ema(x, p), p), p)
    out = np.full(len(x), NAN)
    out[1:] = np.where(np.isnan(three[:-1]), NAN, (_ratio(three[1:], three[:-1], 1.0) - 1) * 100)
    return out


def t3(x, p, v=0.7):
    e = [ema(x, p)]
    for _ in range(5):
        e.append(_again(e[-1], p))
    return -(v**3) * e[5] + 3 * (v**2 + v**3) * e[4] + (-6 * v**2 - 3 * (v + v**3)) * e[3] + (1 + 3 * v + v**3 + 3 * v**2) * e[2]


def kama(x, p):
    n = len(x)
    out = np.full(n, NAN)
    if n <= p:
        return out
    d = np.abs(np.diff(x))
    way = _view(d, p).sum(1)
    move = x[p:] - x[:-p]
    er = np.where((way <= move) | (np.abs(way) < 1e-14), 1.0, np.abs(_ratio(move, way)))
    fast, slow = 2.0 / 3, 2.0 / 31
    sc = (er * (fast - slow) + slow) ** 2
    k, values = float(x[p - 1]), []
    for v, s in zip(x[p:].tolist(), sc.tolist()):
        k += (v - k) * s
        values.append(k)
    out[p:] = values
    return out


def wilder(x, p):
    """Mean of the first p, then w = (w (p - 1) + x) / p."""
    out = np.full(len(x), NAN)
    if len(x) < p:
        return out
    w = float(np.mean(x[:p]))
    values = [w]
    for v in x[p:].tolist():
        w = (w * (p - 1) + v) / p
        values.append(w)
    out[p - 1 :] = values
    return out


def _gain_loss(x, p):
    d = np.diff(x)
    return wilder(np.maximum(d, 0), p), wilder(np.maximum(-d, 0), p)


def rsi(x, p):
    g, s = _gain_loss(x, p)
    return np.concatenate(([NAN], 100 * _ratio(g, g + s)))[: len(x)]


def cmo(x, p):
    g, s = _gain_loss(x, p)
    return np.concatenate(([NAN], 100 * _ratio(g - s, g + s)))[: len(x)]


def trange(h, l, c):  # noqa: E741
    b = c[:-1]
    return _full(len(h), 1, np.maximum(h[1:] - l[1:], np.maximum(np.abs(h[1:] - b), np.abs(l[1:] - b))))


def atr(h, l, c, p):  # noqa: E741
    tr = trange(h, l, c)
    return tr if p <= 1 else _full(len(h), 1, wilder(tr[1:], p))


def natr(h, l, c, p):  # noqa: E741
    return _ratio(100 * atr(h, l, c, p), c) if p > 1 else trange(h, l, c)


def willr(h, l, c, p):  # noqa: E741
    top, low = highest(h, p), lowest(l, p)
    return -100 * _ratio(top - c, top - low)


def cci(h, l, c, p):  # noqa: E741
    tp = (h + l + c) / 3
    if len(tp) < p:
        return np.full(len(tp), NAN)
    v = _view(tp, p)
    m = v.mean(1)
    dev = np.abs(v - m[:, None]).mean(1)
    return _full(len(tp), p - 1, np.where((tp[p - 1 :] - m == 0) | (dev == 0), 0.0, _ratio(tp[p - 1 :] - m, 0.015 * dev)))


def _directional(h, l):  # noqa: E741
    up, down = np.diff(h), -np.diff(l)
    return np.where((up > 0) & (up > down), up, 0.0), np.where((down > 0) & (up < down), down, 0.0)


def _smoothed(x, p, first):
    """Sum of the first p - 1 of x, then s = s - s / p + x; the value at bar k of the series is from x[k - 1]."""
    n = len(x) + 1
    out = np.full(n, NAN)
    if p <= 1:
        out[1:] = x
        return out
    if len(x) < p - 1:
        return out
    s = float(np.sum(x[: p - 1]))
    out[p - 1] = s
    for k, v in enumerate(x[p - 1 :].tolist(), p):
        s = s - s / p + v
        out[k] = s
    out[:first] = NAN
    return out


def plus_dm(h, l, p):  # noqa: E741
    return _smoothed(_directional(h, l)[0], p, max(p - 1, 1)) if len(h) else h


def minus_dm(h, l, p):  # noqa: E741
    return _smoothed(_directional(h, l)[1], p, max(p - 1, 1)) if len(h) else h


def _di(h, l, c, p):  # noqa: E741
    plus, minus = _directional(h, l)
    tr = _smoothed(trange(h, l, c)[1:], p, max(p, 1))
    scale = 100.0 if p > 1 else 1.0
    return [np.where(np.isnan(tr), NAN, scale * _ratio(_smoothed(d, p, max(p, 1)), tr)) for d in (plus, minus)]


def plus_di(h, l, c, p):  # noqa: E741
    return _di(h, l, c, p)[0] if len(h) else h


def minus_di(h, l, c, p):  # noqa: E741
    return _di(h, l, c, p)[1] if len(h) else h


def dx(h, l, c, p):  # noqa: E741
    if not len(h):
        return h
    a, b = _di(h, l, c, p)
    out, last = np.full(len(h), NAN), 0.0
    for k in range(p, len(h)):
        if a[k] + b[k] != 0:
            last = 100 * abs(a[k] - b[k]) / (a[k] + b[k])
        out[k] = last
    return out


def adx(h, l, c, p):  # noqa: E741
    d = dx(h, l, c, p)
    return _full(len(h), p, wilder(d[p:], p)) if len(h) > p else np.full(len(h), NAN)


def adxr(h, l, c, p):  # noqa: E741
    a = adx(h, l, c, p)
    out = np.full(len(h), NAN)
    if len(h) >= p:
        out[p - 1 :] = (a[p - 1 :] + a[: len(h) - p + 1]) / 2
    return out


def ad(h, l, c, v):  # noqa: E741
    span = h - l
    return np.cumsum(np.where(span > 0, _ratio((c - l) - (h - c), span) * v, 0.0))


def bop(o, h, l, c):  # noqa: E741
    return np.where(h - l <= 0, 0.0, _ratio(c - o, h - l))


def midprice(h, l, p):  # noqa: E741
    return (highest(h, p) + lowest(l, p)) / 2


# --- multiple outputs -------------------------------------------------------------------------------


def _average(x, p, kind):
    """Moving averages by code: SMA, EMA, WMA, DEMA, TEMA, TRIMA, KAMA, MAMA (limits 0.5, 0.05), T3."""
    if p <= 1:
        return x.copy()
    if kind == 7:
        return mama(x, 0.5, 0.05)[0]
    return (sma, ema, wma, dema, tema, trima, kama, None, t3)[kind](x, p)


def average_lookback(p: int, kind: int) -> int:
    if p <= 1:
        return 0
    return {0: p - 1, 1: p - 1, 2: p - 1, 3: 2 * (p - 1), 4: 3 * (p - 1), 5: p - 1, 6: p, 7: 32, 8: 6 * (p - 1)}[kind]


def macd(x, fast, slow, signal):
    if slow < fast:
        fast, slow = slow, fast
    line = ema(x, fast, slow - 1) - ema(x, slow)
    trigger = _again(line, signal)
    line = np.where(np.isnan(trigger), NAN, line)
    return line, trigger, line - trigger


def bbands(x, p, up, down, kind):
    middle = _average(x, p, kind)
    spread = np.sqrt(np.maximum(rolling(lambda v: v.var(1))(x, p), 0))
    return np.where(np.isnan(middle), NAN, middle + up * spread), middle, np.where(np.isnan(middle), NAN, middle - down * spread)


def stoch(h, l, c, fast_k, slow_k, slow_k_kind, slow_d, slow_d_kind):  # noqa: E741
    top, low = highest(h, fast_k), lowest(l, fast_k)
    raw = np.where(np.isnan(top), NAN, 100 * _ratio(c - low, top - low))
    k = _again(raw, slow_k, lambda x, p: _average(x, p, slow_k_kind))
    d = _again(k, slow_d, lambda x, p: _average(x, p, slow_d_kind))
    return np.where(np.isnan(d), NAN, k), d


def aroon(h, l, p):  # noqa: E741
    bars = np.arange(len(h))
    since = lambda i: np.where(np.isnan(i), NAN, 100 * (p - (bars - i)) / p)
    return since(minindex(l, p + 1)), since(maxindex(h, p + 1))


def minmax(x, p):
    return lowest(x, p), highest(x, p)


# --- Hilbert transform family (Ehlers) --------------------------------------------------------------

DEGREES = 180.0 / math.pi


_CYCLES: dict = {}


def _cycle(x, begin):
    """_discriminator, remembered for the last few series: several indicators start from the same one."""
    key = (begin, x.tobytes())
    if key not in _CYCLES:
        if len(_CYCLES) >= 4:
            _CYCLES.pop(next(iter(_CYCLES)))
        _CYCLES[key] = _discriminator(x, begin)
    return _CYCLES[key]


def _discriminator(x, begin):
    """The homodyne discriminator from bar `begin` on: per bar the smoothed price, I1, Q1, period and smoothed period."""
    n = len(x)
    smooth = np.zeros(n)
    if n > 3:
        smooth[3:] = (4 * x[3:] + 3 * x[2:-1] + 2 * x[1:-2] + x[:-3]) / 10
    # lists begin six bars early, with zeros, so that taps need no test
    s = [0.0] * 6 + smooth[begin:].tolist()
    m = len(s)
    detrend, q1, i1 = [0.0] * m, [0.0] * m, [0.0] * m
    periods, smoothed = [0.0] * m, [0.0] * m
    i2 = q2 = re = im = period = sp = 0.0
    a, b, atan = 0.0962, 0.5769, math.atan
    for t in range(6, m):
        adjust = 0.075 * period + 0.54
        d = (a * s[t] + b * s[t - 2] - b * s[t - 4] - a * s[t - 6]) * adjust
        detrend[t] = d
        q = (a * d + b * detrend[t - 2] - b * detrend[t - 4] - a * detrend[t - 6]) * adjust
        q1[t] = q
        i = detrend[t - 3]
        i1[t] = i
        ji = (a * i + b * i1[t - 2] - b * i1[t - 4] - a * i1[t - 6]) * adjust
        jq = (a * q + b * q1[t - 2] - b * q1[t - 4] - a * q1[t - 6]) * adjust
        old_i, old_q = i2, q2
        q2, i2 = 0.2 * (q + ji) + 0.8 * old_q, 0.2 * (i - jq) + 0.8 * old_i
        re = 0.2 * (i2 * old_i + q2 * old_q) + 0.8 * re
        im = 0.2 * (i2 * old_q - q2 * old_i) + 0.8 * im
        old = period
        if im != 0 and re != 0:
            period = 360 / (atan(im / re) * DEGREES)
        top, low = 1.5 * old, 0.67 * old
        if period > top:
            period = top
        if period < low:
            period = low
        period = 6.0 if period < 6 else 50.0 if period > 50 else period
        period = 0.2 * period + 0.8 * old
        sp = 0.33 * period + 0.67 * sp
        periods[t], smoothed[t] = period, sp
    lead = [0.0] * min(begin, n)
    return smooth.tolist(), *(lead + y[6:] for y in (i1, q1, periods, smoothed))


def ht_dcperiod(x):
    return _full(len(x), 32, _cycle(x, 12)[4][32:])


def ht_phasor(x):
    _, i1, q1, _, _ = _cycle(x, 12)
    return _full(len(x), 32, i1[32:]), _full(len(x), 32, q1[32:])


def mama(x, fast, slow):
    _, i1, q1, _, _ = _cycle(x, 12)
    n, m, f, old = len(x), 0.0, 0.0, 0.0
    out = np.full(n, NAN), np.full(n, NAN)
    for t in range(12, n):
        phase = math.atan(q1[t] / i1[t]) * DEGREES if i1[t] else 0.0
        delta, old = max(old - phase, 1.0), phase
        alpha = max(fast / delta, slow) if delta > 1 else fast
        m = alpha * x[t] + (1 - alpha) * m
        f = 0.5 * alpha * m + (1 - 0.5 * alpha) * f
        if t >= 32:
            out[0][t], out[1][t] = m, f
    return out


#: Sines and cosines of one turn in `size` steps, for the sizes that a period can have.
_TURNS = {size: (np.sin(np.arange(size) * 2 * math.pi / size), np.cos(np.arange(size) * 2 * math.pi / size)) for size in range(1, 52)}


def _phase(x):
    """Phase and trend line per bar from 37 on, with the smoothed price and period."""
    s, _, _, _, smoothed = _cycle(x, 37)
    n, phase = len(x), 0.0
    phases, means = np.zeros(n), np.zeros(n)
    back = np.concatenate((np.zeros(51), np.where(np.arange(n) >= 37, s, 0.0)))[::-1]  # newest first; bar t is at n - 1 - t
    for t in range(37, n):
        size = int(smoothed[t] + 0.5)
        re = im = 0.0
        if size:
            sines, cosines = _TURNS[size]
            last = back[n - 1 - t : n - 1 - t + size]
            re, im = float(sines @ last), float(cosines @ last)
        if abs(im) > 0:
            phase = math.atan(re / im) * DEGREES
        elif re < 0:
            phase -= 90
        elif re > 0:
            phase += 90
        phase += 90
        phase += 360 / smoothed[t] if smoothed[t] else 0.0
        if im < 0:
            phase += 180
        if phase > 315:
            phase -= 360
        phases[t] = phase
        means[t] = np.cumsum(x[t - size + 1 : t + 1])[-1] / size if 0 < size <= t + 1 else 0.0
    line = np.zeros(n)
    if n > 37:
        m = np.where(np.arange(n) >= 37, means, 0.0)
        lag = lambda k: np.concatenate((np.zeros(k), m[:-k]))
        line[37:] = ((4 * m + 3 * lag(1) + 2 * lag(2) + lag(3)) / 10)[37:]
    return s, smoothed, phases, line


def ht_dcphase(x):
    return _full(len(x), 63, _phase(x)[2][63:])


def ht_trendline(x):
    return _full(len(x), 63, _phase(x)[3][63:])


def ht_sine(x):
    p = np.radians(_phase(x)[2])
    return _full(len(x), 63, np.sin(p)[63:]), _full(len(x), 63, np.sin(p + math.pi / 4)[63:])


def ht_trendmode(x):
    s, smoothed, phases, line = _phase(x)
    out, days, old = np.full(len(x), NAN), 0, (0.0, 0.0)
    for t in range(37, len(x)):
        now = math.sin(phases[t] / DEGREES), math.sin((phases[t] + 45) / DEGREES)
        mode = 1
        if (now[0] > now[1] and old[0] <= old[1]) or (now[0] < now[1] and old[0] >= old[1]):
            days, mode = 0, 0
        days += 1
        if days < 0.5 * smoothed[t]:
            mode = 0
        step = phases[t] - (phases[t - 1] if t > 37 else 0.0)
        if smoothed[t] and 0.67 * 360 / smoothed[t] < step < 1.5 * 360 / smoothed[t]:
            mode = 0
        if line[t] and abs((s[t] - line[t]) / line[t]) >= 0.015:
            mode = 1
        old = now
        if t >= 63:
            out[t] = mode
    return out
