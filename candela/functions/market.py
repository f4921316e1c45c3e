"""Rules of an equity exchange: price limits, ratios and the trading calendar, as columns."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weekdays on which the exchange was or is closed, 2020 to 2026, a line for each year.
HOLIDAYS = """
    2020-01-01 2020-01-24 2020-01-27 2020-01-28 2020-01-29 2020-01-30 2020-01-31 2020-04-06 2020-05-01 2020-05-04 2020-05-05 2020-06-25 2020-06-26 2020-10-01 2020-10-02 2020-10-05 2020-10-06 2020-10-07 2020-10-08
    2021-01-01 2021-02-11 2021-02-12 2021-02-15 2021-02-16 2021-02-17 2021-04-05 2021-05-03 2021-05-04 2021-05-05 2021-06-14 2021-09-20 2021-09-21 2021-10-01 2021-10-04 2021-10-05 2021-10-06 2021-10-07
    2022-01-03 2022-01-31 2022-02-01 2022-02-02 2022-02-03 2022-02-04 2022-04-04 2022-04-05 2022-05-02 2022-05-03 2022-05-04 2022-06-03 2022-09-12 2022-10-03 2022-10-04 2022-10-05 2022-10-06 2022-10-07
    2023-01-02 2023-01-23 2023-01-24 2023-01-25 2023-01-26 2023-01-27 2023-04-05 2023-05-01 2023-05-02 2023-05-03 2023-06-22 2023-06-23 2023-09-29 2023-10-02 2023-10-03 2023-10-04 2023-10-05 2023-10-06
    2024-01-01 2024-02-09 2024-02-12 2024-02-13 2024-02-14 2024-02-15 2024-02-16 2024-04-04 2024-04-05 2024-05-01 2024-05-02 2024-05-03 2024-06-10 2024-09-16 2024-09-17 2024-10-01 2024-10-02 2024-10-03 2024-10-04 2024-10-07
    2025-01-01 2025-01-28 2025-01-29 2025-01-30 2025-01-31 2025-02-03 2025-02-04 2025-04-04 2025-05-01 2025-05-02 2025-05-05 2025-06-02 2025-10-01 2025-10-02 2025-10-03 2025-10-06 2025-10-07 2025-10-08
    2026-01-01 2026-02-16 2026-02-17 2026-02-18 2026-02-19 2026-02-20 2026-02-23 2026-04-06 2026-05-01 2026-05-04 2026-05-05 2026-06-19 2026-09-25 2026-10-01 2026-10-02 2026-10-05 2026-10-06 2026-10-07 2026-10-08
"""
BUILT_IN = tuple(map(dt.date.fromisoformat, HOLIDAYS.split()))


class Calendar:
    """The exchange's days and minutes. Days added hold for columns made from this object afterwards."""

    def __init__(self, days=BUILT_IN):
        self.built_in, self.added = frozenset(days), set()

    def set_holiday(self, day: dt.date) -> int:
        """1 if the day is new, else 0."""
        new = day not in self.added
        self.added.add(day)
        return int(new)

    def clear_holidays(self) -> int:
        """How many added days were dropped."""
        n = len(self.added)
        self.added.clear()
        return n

    def trading_day(self, day: Column | str) -> Column:
        """Whether a date or timestamp is on a weekday that is no holiday."""
        day = (F.col(day) if isinstance(day, str) else day).cast("date")
        closed = sorted(self.built_in | self.added)
        return (F.weekday(day) < 5) & (~day.isin(closed) if closed else F.lit(True))

    def trading_minute(self, ts: Column) -> Column:
        """Whether a bar may end at this minute: 09:31-11:30, 13:01-14:57 and 15:00 of a trading day."""
        minute = F.hour(ts) * 60 + F.minute(ts)
        return self.trading_day(ts) & (minute.between(571, 690) | minute.between(781, 897) | (minute == 900))


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def cn_limit_pct(code, is_st) -> Column:
    """Daily limit by board: .20, .30 or .10, which special treatment halves."""
    code = _col(code)
    is_st = F.coalesce(_col(is_st), F.lit(False))
    plain = F.when(is_st, 0.05).otherwise(0.10)
    board = F.when(code.startswith("688") | code.startswith("30"), 0.20).when(code.startswith("8") | code.startswith("4") | code.startswith("92"), 0.30).otherwise(plain)
    return F.when(code.isNotNull(), F.when(F.length(code) < 2, 0.10).otherwise(board))


def _cents(x: Column) -> Column:
    """Rounded to cents, halves away from zero."""
    return F.signum(x) * F.floor(F.abs(x) * 100 + 0.5).cast("double") / 100


def cn_limit_price(previous, code, is_st) -> Column:
    p, pct = _col(previous), cn_limit_pct(code, is_st)
    return F.when(p.isNotNull() & pct.isNotNull(), F.struct(_cents(p * (1 + pct)).alias("limit_up"), _cents(p * (1 - pct)).alias("limit_down")))


def cn_is_st(name) -> Column:
    name = _col(name)
    return F.coalesce(name.contains("ST") | name.contains("st"), F.lit(False))


def _share(a: Column, b: Column) -> Column:
    return F.when(F.abs(b) >= 1e-12, a / F.when(b != 0, b))


def cn_change_pct(close, previous) -> Column:
    return _share(_col(close) - _col(previous), _col(previous))


def cn_turnover(volume, shares) -> Column:
    return _share(_col(volume).cast("double"), _col(shares).cast("double"))


def cn_trading_day(day, calendar: Calendar | None = None) -> Column:
    return (calendar or Calendar()).trading_day(day)


def _zeros(history) -> Column:
    return F.transform(_col(history), lambda v: F.coalesce(v.cast("double"), F.lit(0.0)))


def cn_volume_ratio(volume, history) -> Column:
    """Volume over the mean of past volumes; null elements count as 0."""
    h = _zeros(history)
    mean = F.when(F.size(h) > 0, F.aggregate(h, F.lit(0.0), lambda s, v: s + v) / F.when(F.size(h) > 0, F.size(h)))
    return F.when(mean >= 1e-12, _col(volume) / F.when(mean != 0, mean))


def cn_pe_percentile(pe, history) -> Column:
    """Share of past values that are not above."""
    h, pe = _zeros(history), _col(pe)
    return F.when((F.size(h) > 0) & pe.isNotNull(), F.size(F.filter(h, lambda v: v <= pe)) / F.when(F.size(h) > 0, F.size(h)))


def cn_adjust_price(close, factor) -> Column:
    return _col(close) * _col(factor)
