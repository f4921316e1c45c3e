"""Candlestick rules, written once over an abstract view of the last bars.

A view gives prices some bars back and the arithmetic to combine them; there are views over numpy
arrays (whole series), Spark columns (lag columns) and SQL text. A rule returns (condition, value)
cases; the first that holds gives the value, else 0.
"""

from __future__ import annotations

import functools
import operator

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: name: (range, bars averaged, factor). The range is of the body, high to low, or both shadows.
STANDARD = {
    "BL": ("body", 10, 1.0), "BVL": ("body", 10, 3.0), "BS": ("body", 10, 1.0), "BD": ("span", 10, 0.1),
    "SL": ("body", 0, 1.0), "SVL": ("body", 0, 2.0), "SS": ("shadows", 10, 1.0), "SVS": ("span", 10, 0.1),
    "NEAR": ("span", 5, 0.2), "FAR": ("span", 5, 0.6), "EQ": ("span", 5, 0.05),
}
#: All averages are zero: long is any body, short none, near and equal are exact.
ZERO = None


class View:
    """What rules are written in. Subclasses give bar(), max, min, abs, both, either, no, case and avg."""

    settings: dict | None = ZERO

    def o(self, k): return self.bar("o", k)  # noqa: E704
    def h(self, k): return self.bar("h", k)  # noqa: E704
    def l(self, k): return self.bar("l", k)  # noqa: E704, E743
    def c(self, k): return self.bar("c", k)  # noqa: E704
    def top(self, k): return self.max(self.o(k), self.c(k))  # noqa: E704
    def foot(self, k): return self.min(self.o(k), self.c(k))  # noqa: E704
    def body(self, k): return self.abs(self.c(k) - self.o(k))  # noqa: E704
    def us(self, k): return self.h(k) - self.top(k)  # noqa: E704
    def ls(self, k): return self.foot(k) - self.l(k)  # noqa: E704
    def white(self, k): return self.c(k) >= self.o(k)  # noqa: E704
    def black(self, k): return self.c(k) < self.o(k)  # noqa: E704
    def sgn(self, k): return self.case([(self.white(k), 1)], -1)  # noqa: E704
    def body_up(self, a, b): return self.foot(a) > self.top(b)  # noqa: E704
    def body_down(self, a, b): return self.top(a) < self.foot(b)  # noqa: E704
    def gap_up(self, a, b): return self.l(a) > self.h(b)  # noqa: E704
    def gap_down(self, a, b): return self.h(a) < self.l(b)  # noqa: E704
    def all(self, *xs): return functools.reduce(self.both, xs)  # noqa: E704
    def any(self, *xs): return functools.reduce(self.either, xs)  # noqa: E704
    def range(self, kind, k): return self.body(k) if kind == "body" else self.h(k) - self.l(k) if kind == "span" else self.us(k) + self.ls(k)  # noqa: E704
    def avg(self, name, k):  # noqa: E301
        if self.settings is None:
            return self.zero()
        kind, bars, factor = self.settings[name]
        return self.mean(kind, bars, k) * (factor / (2 if kind == "shadows" else 1))

    def near(self, x, y, name, k):
        """x within the average around y."""
        return self.all(x <= y + self.avg(name, k), x >= y - self.avg(name, k))

    def long(self, k): return self.body(k) > self.avg("BL", k)  # noqa: E704
    def short(self, k): return self.body(k) < self.avg("BS", k)  # noqa: E704
    def small(self, k): return self.body(k) <= self.avg("BS", k)  # noqa: E704
    def doji(self, k, at=None): return self.body(k) <= self.avg("BD", k if at is None else at)  # noqa: E704
    def no_us(self, k): return self.us(k) < self.avg("SVS", k)  # noqa: E704
    def no_ls(self, k): return self.ls(k) < self.avg("SVS", k)  # noqa: E704
    def some_us(self, k): return self.us(k) > self.avg("SVS", k)  # noqa: E704
    def some_ls(self, k): return self.ls(k) > self.avg("SVS", k)  # noqa: E704
    def same(self, *ks): return self.any(self.all(*map(self.white, ks)), self.all(*map(self.black, ks)))  # noqa: E704
    def opposite(self, a, b): return self.any(self.all(self.white(a), self.black(b)), self.all(self.black(a), self.white(b)))  # noqa: E704
    def bare(self, k): return self.all(self.long(k), self.no_us(k), self.no_ls(k))  # noqa: E704
    def three_rising(self): return self.all(self.white(2), self.white(1), self.white(0), self.c(0) > self.c(1), self.c(1) > self.c(2))  # noqa: E704
    def steps_up(self): return self.all(self.o(1) > self.o(2), self.o(1) <= self.c(2) + self.avg("NEAR", 2), self.o(0) > self.o(1), self.o(0) <= self.c(1) + self.avg("NEAR", 1))  # noqa: E704


class Arrays(View):
    """Whole series as numpy arrays; bars before the first are NaN, which no comparison holds for."""

    def __init__(self, o, h, l, c, settings=ZERO):  # noqa: E741
        self.data, self.settings = {"o": o, "h": h, "l": l, "c": c}, settings

    def bar(self, name, k):
        x = self.data[name]
        out = np.full(len(x), np.nan)
        out[k:] = x[: len(x) - k] if k else x
        return out

    def mean(self, kind, bars, k):
        if not bars:
            return self.range(kind, k)
        return sum(self.range(kind, k + j) for j in range(1, bars + 1)) / bars

    zero = staticmethod(lambda: 0.0)
    max, min, abs = staticmethod(np.maximum), staticmethod(np.minimum), staticmethod(np.abs)
    both, either, no = staticmethod(operator.and_), staticmethod(operator.or_), staticmethod(operator.invert)

    def case(self, cases, other=0):
        out = np.full(len(self.data["o"]), other)
        for condition, value in reversed(cases):
            out = np.where(condition, value, out)
        return out


class Columns(View):
    """Columns named o0, o1, ... c6 of a DataFrame."""

    def __init__(self, settings=ZERO):
        self.settings = settings

    def bar(self, name, k):
        return F.col(f"{name}{k}")

    def mean(self, kind, bars, k):
        if not bars:
            return self.range(kind, k)
        return sum((self.range(kind, k + j) for j in range(1, bars + 1)), F.lit(0.0)) / bars

    zero = staticmethod(lambda: F.lit(0.0))
    max, min, abs = staticmethod(F.greatest), staticmethod(F.least), staticmethod(F.abs)
    both, either, no = staticmethod(operator.and_), staticmethod(operator.or_), staticmethod(operator.invert)

    def case(self, cases, other=0):
        out = functools.reduce(lambda w, x: w.when(*x), cases[1:], F.when(*cases[0]))
        return out.otherwise(other)


class Text:
    """A piece of SQL that combines like a column."""

    def __init__(self, sql):
        self.sql = sql


def _binary(sign):
    return lambda a, b: Text(f"({a.sql} {sign} {b.sql if isinstance(b, Text) else b})")


for _name, _sign in {"add": "+", "sub": "-", "mul": "*", "truediv": "/", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}.items():
    setattr(Text, f"__{_name}__", _binary(_sign))
Text.__neg__ = lambda a: Text(f"(-{a.sql})")


class Sql(View):
    """SQL over columns o0, o1, ... c6."""

    bar = staticmethod(lambda name, k: Text(f"{name}{k}"))
    zero = staticmethod(lambda: Text("0.0"))
    max, min = staticmethod(lambda a, b: Text(f"greatest({a.sql}, {b.sql})")), staticmethod(lambda a, b: Text(f"least({a.sql}, {b.sql})"))
    abs = staticmethod(lambda a: Text(f"abs({a.sql})"))
    both, either, no = staticmethod(lambda a, b: Text(f"({a.sql} AND {b.sql})")), staticmethod(lambda a, b: Text(f"({a.sql} OR {b.sql})")), staticmethod(lambda a: Text(f"(NOT {a.sql})"))
    case = staticmethod(lambda cases, other=0: Text("(CASE " + " ".join(f"WHEN {c.sql} THEN {v.sql if isinstance(v, Text) else v}" for c, v in cases) + f" ELSE {other} END)"))


#: name: (bars needed before the first output with zero settings, rule)
RULES: dict = {}


def rule(lookback: int):
    return lambda f: RULES.setdefault(f.__name__.removeprefix("_"), (lookback, f)) and f


def _sides(b, up, down):
    return b.any(b.all(*up), b.all(*down))


@rule(2)
def cdl2crows(b):
    return [(b.all(b.white(2), b.long(2), b.black(1), b.body_up(1, 2), b.black(0), b.o(0) < b.o(1), b.o(0) > b.c(1), b.c(0) > b.o(2), b.c(0) < b.c(2)), -100)]


@rule(3)
def cdl3blackcrows(b):
    return [(b.all(b.white(3), *[b.all(b.black(k), b.no_ls(k)) for k in (2, 1, 0)], b.o(1) < b.o(2), b.o(1) > b.c(2), b.o(0) < b.o(1), b.o(0) > b.c(1), b.h(3) > b.c(2), b.c(2) > b.c(1), b.c(1) > b.c(0)), -100)]


@rule(2)
def cdl3inside(b):
    inside = b.all(b.long(2), b.small(1), b.top(1) < b.top(2), b.foot(1) > b.foot(2))
    return [(b.all(inside, _sides(b, [b.white(2), b.black(0), b.c(0) < b.o(2)], [b.black(2), b.white(0), b.c(0) > b.o(2)])), -b.sgn(2) * 100)]


@rule(3)
def cdl3linestrike(b):
    opens = b.all(*[b.all(b.o(k) >= b.foot(k + 1) - b.avg("NEAR", k + 1), b.o(k) <= b.top(k + 1) + b.avg("NEAR", k + 1)) for k in (2, 1)])
    up = [b.white(1), b.c(1) > b.c(2), b.c(2) > b.c(3), b.o(0) > b.c(1), b.c(0) < b.o(3)]
    down = [b.black(1), b.c(1) < b.c(2), b.c(2) < b.c(3), b.o(0) < b.c(1), b.c(0) > b.o(3)]
    return [(b.all(b.same(3, 2, 1), b.opposite(1, 0), opens, _sides(b, up, down)), b.sgn(1) * 100)]


@rule(3)
def cdl3outside(b):
    up = [b.white(1), b.black(2), b.c(1) > b.o(2), b.o(1) < b.c(2), b.c(0) > b.c(1)]
    down = [b.black(1), b.white(2), b.o(1) > b.c(2), b.c(1) < b.o(2), b.c(0) < b.c(1)]
    return [(_sides(b, up, down), b.sgn(1) * 100)]


@rule(2)
def cdl3starsinsouth(b):
    return [(b.all(b.black(2), b.black(1), b.black(0), b.long(2), b.ls(2) > b.avg("SL", 2), b.body(1) < b.body(2), b.o(1) > b.c(2), b.o(1) <= b.h(2), b.l(1) < b.c(2), b.l(1) >= b.l(2), b.some_ls(1), b.short(0), b.no_ls(0), b.no_us(0), b.l(0) > b.l(1), b.h(0) < b.h(1)), 100)]


@rule(2)
def cdl3whitesoldiers(b):
    return [(b.all(b.three_rising(), b.no_us(2), b.no_us(1), b.no_us(0), b.steps_up(), b.body(1) > b.body(2) - b.avg("FAR", 2), b.body(0) > b.body(1) - b.avg("FAR", 1), b.body(0) > b.avg("BS", 0)), 100)]


@rule(2)
def cdladvanceblock(b):
    weak = b.any(
        b.all(b.body(1) < b.body(2) - b.avg("FAR", 2), b.body(0) < b.body(1) + b.avg("NEAR", 1)),
        b.body(0) < b.body(1) - b.avg("FAR", 1),
        b.all(b.body(0) < b.body(1), b.body(1) < b.body(2), b.any(b.us(0) > b.avg("SS", 0), b.us(1) > b.avg("SS", 1))),
        b.all(b.body(0) < b.body(1), b.us(0) > b.avg("SL", 0)),
    )
    return [(b.all(b.three_rising(), b.steps_up(), b.long(2), b.us(2) < b.avg("SS", 2), weak), -100)]


@rule(0)
def cdlbelthold(b):
    return [(b.all(b.long(0), _sides(b, [b.white(0), b.no_ls(0)], [b.black(0), b.no_us(0)])), b.sgn(0) * 100)]


@rule(4)
def cdlbreakaway(b):
    down = [b.black(4), b.body_down(3, 4), b.h(2) < b.h(3), b.l(2) < b.l(3), b.h(1) < b.h(2), b.l(1) < b.l(2), b.c(0) > b.o(3), b.c(0) < b.c(4)]
    up = [b.white(4), b.body_up(3, 4), b.h(2) > b.h(3), b.l(2) > b.l(3), b.h(1) > b.h(2), b.l(1) > b.l(2), b.c(0) < b.o(3), b.c(0) > b.c(4)]
    return [(b.all(b.long(4), b.same(4, 3), b.same(3, 1), b.opposite(1, 0), _sides(b, up, down)), b.sgn(0) * 100)]


@rule(0)
def cdlclosingmarubozu(b):
    return [(b.all(b.long(0), _sides(b, [b.white(0), b.no_us(0)], [b.black(0), b.no_ls(0)])), b.sgn(0) * 100)]


@rule(3)
def cdlconcealbabyswall(b):
    return [(b.all(*map(b.black, (3, 2, 1, 0)), b.no_ls(3), b.no_us(3), b.no_ls(2), b.no_us(2), b.body_down(1, 2), b.some_us(1), b.h(1) > b.c(2), b.h(0) > b.h(1), b.l(0) < b.l(1)), 100)]


@rule(1)
def cdlcounterattack(b):
    return [(b.all(b.opposite(1, 0), b.long(1), b.long(0), b.near(b.c(0), b.c(1), "EQ", 1)), b.sgn(0) * 100)]


@rule(0)
def cdldoji(b):
    return [(b.doji(0), 100)]


@rule(1)
def cdldojistar(b):
    return [(b.all(b.long(1), b.doji(0), _sides(b, [b.white(1), b.body_up(0, 1)], [b.black(1), b.body_down(0, 1)])), -b.sgn(1) * 100)]


@rule(0)
def cdldragonflydoji(b):
    return [(b.all(b.doji(0), b.no_us(0), b.some_ls(0)), 100)]


@rule(2)
def cdlengulfing(b):
    up = b.all(b.white(0), b.black(1), b.any(b.all(b.c(0) >= b.o(1), b.o(0) < b.c(1)), b.all(b.c(0) > b.o(1), b.o(0) <= b.c(1))))
    down = b.all(b.black(0), b.white(1), b.any(b.all(b.o(0) >= b.c(1), b.c(0) < b.o(1)), b.all(b.o(0) > b.c(1), b.c(0) <= b.o(1))))
    strict = b.any(b.all(b.o(0) < b.c(1), b.c(0) > b.o(1)), b.all(b.o(0) > b.c(1), b.c(0) < b.o(1)))
    return [(b.all(b.any(up, down), strict), b.sgn(0) * 100), (b.any(up, down), b.sgn(0) * 80)]


@rule(2)
def cdlgapsidesidewhite(b):
    like = b.all(b.white(1), b.white(0), b.near(b.body(0), b.body(1), "NEAR", 1), b.near(b.o(0), b.o(1), "EQ", 1))
    return [(b.all(like, b.body_up(1, 2), b.body_up(0, 2)), 100), (b.all(like, b.body_down(1, 2), b.body_down(0, 2)), -100)]


@rule(0)
def cdlgravestonedoji(b):
    return [(b.all(b.doji(0), b.no_ls(0), b.some_us(0)), 100)]


@rule(1)
def cdlhammer(b):
    return [(b.all(b.short(0), b.ls(0) > b.avg("SL", 0), b.no_us(0), b.foot(0) <= b.l(1) + b.avg("NEAR", 1)), 100)]


@rule(1)
def cdlhangingman(b):
    return [(b.all(b.short(0), b.ls(0) > b.avg("SL", 0), b.no_us(0), b.foot(0) >= b.h(1) - b.avg("NEAR", 1)), -100)]


def _harami(b, second):
    start = b.all(b.long(1), second)
    return [(b.all(start, b.top(0) < b.top(1), b.foot(0) > b.foot(1)), -b.sgn(1) * 100), (b.all(start, b.top(0) <= b.top(1), b.foot(0) >= b.foot(1)), -b.sgn(1) * 80)]


@rule(1)
def cdlharami(b):
    return _harami(b, b.small(0))


@rule(1)
def cdlharamicross(b):
    return _harami(b, b.doji(0))


@rule(0)
def cdlhighwave(b):
    return [(b.all(b.short(0), b.us(0) > b.avg("SVL", 0), b.ls(0) > b.avg("SVL", 0)), b.sgn(0) * 100)]


def _confirmed(b, up, down):
    """up(k), down(k): the pattern k bars back. A pattern of the last three bars, the newest one, is
    confirmed once, by the first close beyond the bar before it."""
    cases = [(up(0), 100), (down(0), -100)]
    for k in (1, 2, 3):
        newest = [b.no(b.either(up(j), down(j))) for j in range(1, k)]
        for pattern, value, beyond in ((up(k), 200, lambda j, k=k: b.c(j) > b.h(k + 1)), (down(k), -200, lambda j, k=k: b.c(j) < b.l(k + 1))):
            cases.append((b.all(pattern, beyond(0), *newest, *[b.no(beyond(j)) for j in range(1, k)]), value))
    return cases


@rule(5)
def cdlhikkake(b):
    inside = lambda k: b.all(b.h(k + 1) < b.h(k + 2), b.l(k + 1) > b.l(k + 2))
    return _confirmed(b, lambda k: b.all(inside(k), b.h(k) < b.h(k + 1), b.l(k) < b.l(k + 1)), lambda k: b.all(inside(k), b.h(k) > b.h(k + 1), b.l(k) > b.l(k + 1)))


@rule(6)
def cdlhikkakemod(b):
    inside = lambda k: b.all(b.h(k + 2) < b.h(k + 3), b.l(k + 2) > b.l(k + 3), b.h(k + 1) < b.h(k + 2), b.l(k + 1) > b.l(k + 2))
    up = lambda k: b.all(inside(k), b.h(k) < b.h(k + 1), b.l(k) < b.l(k + 1), b.c(k + 2) <= b.l(k + 2) + b.avg("NEAR", k + 2))
    down = lambda k: b.all(inside(k), b.h(k) > b.h(k + 1), b.l(k) > b.l(k + 1), b.c(k + 2) >= b.h(k + 2) - b.avg("NEAR", k + 2))
    return _confirmed(b, up, down)


@rule(1)
def cdlhomingpigeon(b):
    return [(b.all(b.black(1), b.black(0), b.long(1), b.small(0), b.o(0) < b.o(1), b.c(0) > b.c(1)), 100)]


@rule(2)
def cdlidentical3crows(b):
    return [(b.all(*[b.all(b.black(k), b.no_ls(k)) for k in (2, 1, 0)], b.c(2) > b.c(1), b.c(1) > b.c(0), b.near(b.o(1), b.c(2), "EQ", 2), b.near(b.o(0), b.c(1), "EQ", 1)), -100)]


def _black_then_lower(b):
    return b.all(b.black(1), b.long(1), b.white(0), b.o(0) < b.l(1))


@rule(1)
def cdlinneck(b):
    return [(b.all(_black_then_lower(b), b.c(0) <= b.c(1) + b.avg("EQ", 1), b.c(0) >= b.c(1)), -100)]


@rule(1)
def cdlinvertedhammer(b):
    return [(b.all(b.short(0), b.us(0) > b.avg("SL", 0), b.no_ls(0), b.body_down(0, 1)), 100)]


def _kicks(b):
    return b.all(b.opposite(1, 0), b.bare(1), b.bare(0), _sides(b, [b.black(1), b.gap_up(0, 1)], [b.white(1), b.gap_down(0, 1)]))


@rule(1)
def cdlkicking(b):
    return [(_kicks(b), b.sgn(0) * 100)]


@rule(1)
def cdlkickingbylength(b):
    return [(b.all(_kicks(b), b.body(0) > b.body(1)), b.sgn(0) * 100), (_kicks(b), b.sgn(1) * 100)]


@rule(4)
def cdlladderbottom(b):
    return [(b.all(*map(b.black, (4, 3, 2, 1)), b.o(4) > b.o(3), b.o(3) > b.o(2), b.c(4) > b.c(3), b.c(3) > b.c(2), b.some_us(1), b.white(0), b.o(0) > b.o(1), b.c(0) > b.h(1)), 100)]


@rule(0)
def cdllongleggeddoji(b):
    return [(b.all(b.doji(0), b.any(b.ls(0) > b.avg("SL", 0), b.us(0) > b.avg("SL", 0))), 100)]


@rule(0)
def cdllongline(b):
    return [(b.all(b.long(0), b.us(0) < b.avg("SS", 0), b.ls(0) < b.avg("SS", 0)), b.sgn(0) * 100)]


@rule(0)
def cdlmarubozu(b):
    return [(b.bare(0), b.sgn(0) * 100)]


@rule(1)
def cdlmatchinglow(b):
    return [(b.all(b.black(1), b.black(0), b.near(b.c(0), b.c(1), "EQ", 1)), 100)]


@rule(1)
def cdlonneck(b):
    return [(b.all(_black_then_lower(b), b.near(b.c(0), b.l(1), "EQ", 1)), -100)]


@rule(1)
def cdlpiercing(b):
    return [(b.all(_black_then_lower(b), b.long(0), b.c(0) < b.o(1), b.c(0) > b.c(1) + b.body(1) * 0.5), 100)]


@rule(0)
def cdlrickshawman(b):
    middle = b.l(0) + (b.h(0) - b.l(0)) / 2
    return [(b.all(b.doji(0), b.ls(0) > b.avg("SL", 0), b.us(0) > b.avg("SL", 0), b.foot(0) <= middle + b.avg("NEAR", 0), b.top(0) >= middle - b.avg("NEAR", 0)), 100)]


@rule(4)
def cdlrisefall3methods(b):
    small = b.all(b.long(4), b.short(3), b.short(2), b.short(1), b.long(0), b.opposite(4, 3), b.same(3, 2, 1), b.opposite(1, 0))
    within = b.all(*[b.all(b.foot(k) < b.h(4), b.top(k) > b.l(4)) for k in (3, 2, 1)])
    up = [b.white(4), b.c(2) < b.c(3), b.c(1) < b.c(2), b.o(0) > b.c(1), b.c(0) > b.c(4)]
    down = [b.black(4), b.c(2) > b.c(3), b.c(1) > b.c(2), b.o(0) < b.c(1), b.c(0) < b.c(4)]
    return [(b.all(small, within, _sides(b, up, down)), b.sgn(4) * 100)]


@rule(1)
def cdlseparatinglines(b):
    return [(b.all(b.opposite(1, 0), b.near(b.o(0), b.o(1), "EQ", 1), b.long(0), _sides(b, [b.white(0), b.no_ls(0)], [b.black(0), b.no_us(0)])), b.sgn(0) * 100)]


@rule(1)
def cdlshootingstar(b):
    return [(b.all(b.short(0), b.us(0) > b.avg("SL", 0), b.no_ls(0), b.body_up(0, 1)), -100)]


@rule(0)
def cdlshortline(b):
    return [(b.all(b.short(0), b.us(0) < b.avg("SS", 0), b.ls(0) < b.avg("SS", 0)), b.sgn(0) * 100)]


@rule(0)
def cdlspinningtop(b):
    return [(b.all(b.short(0), b.us(0) > b.body(0), b.ls(0) > b.body(0)), b.sgn(0) * 100)]


@rule(2)
def cdlstalledpattern(b):
    return [(b.all(b.three_rising(), b.long(2), b.long(1), b.no_us(1), b.o(1) > b.o(2), b.o(1) <= b.c(2) + b.avg("NEAR", 2), b.short(0), b.o(0) >= b.c(1) - b.body(0) - b.avg("NEAR", 1)), -100)]


@rule(2)
def cdlsticksandwich(b):
    return [(b.all(b.black(2), b.white(1), b.black(0), b.l(1) > b.c(2), b.near(b.c(0), b.c(2), "EQ", 2)), 100)]


@rule(0)
def cdltakuri(b):
    return [(b.all(b.doji(0), b.no_us(0), b.ls(0) > b.avg("SVL", 0)), 100)]


@rule(2)
def cdltasukigap(b):
    like = b.abs(b.body(1) - b.body(0)) < b.avg("NEAR", 1)
    up = [b.body_up(1, 2), b.white(1), b.black(0), b.o(0) < b.c(1), b.o(0) > b.o(1), b.c(0) < b.o(1), b.c(0) > b.top(2), like]
    down = [b.body_down(1, 2), b.black(1), b.white(0), b.o(0) < b.o(1), b.o(0) > b.c(1), b.c(0) > b.o(1), b.c(0) < b.foot(2), like]
    return [(_sides(b, up, down), b.sgn(1) * 100)]


@rule(1)
def cdlthrusting(b):
    return [(b.all(_black_then_lower(b), b.c(0) > b.c(1) + b.avg("EQ", 1), b.c(0) <= b.c(1) + b.body(1) * 0.5), -100)]


@rule(2)
def cdltristar(b):
    three = b.all(b.doji(2), b.doji(1, 2), b.doji(0, 2))
    return [(b.all(three, b.body_up(1, 2), b.top(0) < b.top(1)), -100), (b.all(three, b.body_down(1, 2), b.foot(0) > b.foot(1)), 100)]


@rule(2)
def cdlunique3river(b):
    return [(b.all(b.long(2), b.black(2), b.black(1), b.c(1) > b.c(2), b.o(1) <= b.o(2), b.l(1) < b.l(2), b.short(0), b.white(0), b.o(0) > b.l(1)), 100)]


@rule(2)
def cdlupsidegap2crows(b):
    return [(b.all(b.white(2), b.long(2), b.black(1), b.small(1), b.body_up(1, 2), b.black(0), b.o(0) > b.o(1), b.c(0) < b.c(1), b.c(0) > b.c(2)), -100)]


@rule(2)
def cdlxsidegap3methods(b):
    within = b.all(b.o(0) < b.top(1), b.o(0) > b.foot(1), b.c(0) < b.top(2), b.c(0) > b.foot(2))
    return [(b.all(b.same(2, 1), b.opposite(1, 0), within, _sides(b, [b.white(2), b.body_up(1, 2)], [b.black(2), b.body_down(1, 2)])), b.sgn(2) * 100)]


def lookback(name: str, settings: dict | None = ZERO) -> int:
    """Bars before the first output; with averages, the longest that the rule may use is waited for."""
    base = RULES[name][0]
    return base if settings is None else base + max(n for _, n, _ in settings.values())


def evaluate(name: str, view: View):
    return view.case(RULES[name][1](view))


#: Bars back that any rule reads, with zero settings.
DEPTH = 6


def lag_columns(partition, order, settings: dict | None = ZERO) -> dict[str, Column]:
    """The columns that Columns reads, from open, high, low, close."""
    from pyspark.sql import Window

    w = Window.partitionBy(*partition).orderBy(*order)
    depth = DEPTH + (0 if settings is None else max(n for _, n, _ in settings.values()))
    return {f"{x[0]}{k}": F.lag(x, k).over(w) if k else F.col(x) for x in ("open", "high", "low", "close") for k in range(depth + 1)}
