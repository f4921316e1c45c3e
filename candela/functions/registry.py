"""One row per indicator: its inputs, parameters, kernel, lookback, class and output.

Classes: E element-wise, L local (a window of lookback + 1 bars), C cumulative, R recursive.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from . import candles
from . import kernels as k

MOST = 100_000


@dataclass(frozen=True)
class Indicator:
    name: str
    inputs: tuple[str, ...]  # of x, open, high, low, close, volume
    params: tuple[str, ...]
    kernel: Callable
    lookback: Callable[..., int]
    kind: str
    out: tuple[str, ...] = ()  # fields of several outputs
    integer: bool = False
    aligned: bool = False
    least: int = 2  # of a period
    valid: Callable[..., bool] = lambda *a: True

    def accepts(self, *params) -> bool:
        """Whether the parameters are in range; if not, every output is null."""
        if len(params) != len(self.params) or any(p is None for p in params):
            return False
        whole = [p for p, n in zip(params, self.params) if n == "period"]
        return all(self.least <= p <= MOST for p in whole) and self.valid(*params)

    def run(self, columns: list[np.ndarray], *params) -> list[np.ndarray | None]:
        """Each output over the whole series, and how many leading ones are null; None if all are."""
        n = len(columns[0])
        if not self.accepts(*params) or n <= self.lookback(*params):
            return [None] * max(1, len(self.out))
        with np.errstate(all="ignore"):
            found = self.kernel(*columns, *params)
        return list(found) if self.out else [np.asarray(found, float)]


ALL: dict[str, Indicator] = {}


def _add(names: str, inputs: str, params: str, lookback, kind: str, **more) -> None:
    for item in names.split():
        name, _, kernel = item.partition("=")
        f = more.get("kernel") or getattr(k, kernel or name)
        ALL[name] = Indicator(name, tuple(inputs.split()), tuple(params.split()), f, lookback, kind, **{a: b for a, b in more.items() if a != "kernel"})


_p1 = lambda p: p - 1
_add("sma wma trima midpoint sum=total max=highest min=lowest linearreg linearreg_angle linearreg_intercept linearreg_slope tsf", "x", "period", _p1, "L", aligned=True)
_add("ema", "x", "period", _p1, "R", aligned=True)
_add("dema", "x", "period", lambda p: 2 * (p - 1), "R", aligned=True)
_add("tema", "x", "period", lambda p: 3 * (p - 1), "R", aligned=True)
_add("kama rsi cmo", "x", "period", lambda p: p, "R", aligned=True)
_add("mom roc rocp rocr rocr100", "x", "period", lambda p: p, "L", aligned=True, least=1)
_add("trix", "x", "period", lambda p: 3 * (p - 1) + 1, "R", aligned=True, least=1)
_add("maxindex minindex", "x", "period", _p1, "L", integer=True)
_add("ht_dcperiod", "x", "", lambda: 32, "R")
_add("ht_dcphase ht_trendline", "x", "", lambda: 63, "R")
_add("ht_trendmode", "x", "", lambda: 63, "R", integer=True)
for _n, _f in {"acos": np.arccos, "asin": np.arcsin, "atan": np.arctan, "ceil": np.ceil, "cos": np.cos, "cosh": np.cosh, "exp": np.exp, "floor": np.floor, "ln": np.log, "log10": np.log10, "sin": np.sin, "sinh": np.sinh, "sqrt": np.sqrt, "tan": np.tan, "tanh": np.tanh}.items():
    _add(_n, "x", "", lambda: 0, "E", kernel=_f)
_add("atr natr", "high low close", "period", lambda p: p, "R", aligned=True, least=1)
_add("willr cci", "high low close", "period", _p1, "L", aligned=True)
_add("adx", "high low close", "period", lambda p: 2 * p - 1, "R", aligned=True)
_add("adxr", "high low close", "period", lambda p: 3 * p - 2, "R", aligned=True)
_add("dx", "high low close", "period", lambda p: p, "R", aligned=True)
_add("plus_di minus_di", "high low close", "period", lambda p: p, "R", aligned=True, least=1)
_add("ad", "high low close volume", "", lambda: 0, "C", aligned=True)
_add("avgprice", "open high low close", "", lambda: 0, "E", aligned=True, kernel=lambda o, h, l, c: (o + h + l + c) / 4)  # noqa: E741
_add("bop", "open high low close", "", lambda: 0, "E", aligned=True)
_add("medprice", "high low", "", lambda: 0, "E", aligned=True, kernel=lambda h, l: (h + l) / 2)  # noqa: E741
_add("trange", "high low close", "", lambda: 1, "L", aligned=True)
_add("typprice", "high low close", "", lambda: 0, "E", aligned=True, kernel=lambda h, l, c: (h + l + c) / 3)  # noqa: E741
_add("wclprice", "high low close", "", lambda: 0, "E", aligned=True, kernel=lambda h, l, c: (h + l + 2 * c) / 4)  # noqa: E741
_add("midprice", "high low", "period", _p1, "L", aligned=True)
_add("plus_dm minus_dm", "high low", "period", lambda p: max(p - 1, 1), "R", aligned=True, least=1)
for _n in candles.RULES:
    _add(_n, "open high low close", "", lambda n=_n: candles.lookback(n), "L", integer=True, kernel=lambda o, h, l, c, n=_n: candles.evaluate(n, candles.Arrays(o, h, l, c)))  # noqa: E741

_whole = lambda *ps: all(1 <= p <= MOST for p in ps)
_add("macd", "x", "fast slow signal", lambda f, s, g: max(f, s) + g - 2, "R", out=("macd", "signal", "hist"), valid=lambda f, s, g: f >= 2 and s >= 2 and _whole(f, s, g))
_add("bbands", "x", "period dev_up dev_dn ma_type", lambda p, u, d, m: k.average_lookback(p, m), "R", out=("upper", "middle", "lower"), valid=lambda p, u, d, m: 0 <= m <= 8)
_add("stoch", "high low close", "fast_k slow_k slow_k_ma slow_d slow_d_ma", lambda f, s, a, d, b: f - 1 + k.average_lookback(s, a) + k.average_lookback(d, b), "R", out=("slowk", "slowd"), valid=lambda f, s, a, d, b: _whole(f, s, d) and 0 <= a <= 8 and 0 <= b <= 8)
_add("aroon", "high low", "period", lambda p: p, "L", out=("aroon_down", "aroon_up"))
_add("minmax", "x", "period", _p1, "L", out=("min", "max"))
_add("mama", "x", "fast_limit slow_limit", lambda f, s: 32, "R", out=("mama", "fama"), valid=lambda f, s: 0.01 <= f <= 0.99 and 0.01 <= s <= 0.99)
_add("ht_phasor", "x", "", lambda: 32, "R", out=("inphase", "quadrature"))
_add("ht_sine", "x", "", lambda: 63, "R", out=("sine", "leadsine"))
