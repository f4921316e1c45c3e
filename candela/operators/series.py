"""Indicators over whole lists: ARRAY<DOUBLE> columns in, an array as long as the first out.

Null elements are NaN and propagate; outputs before the lookback, and all outputs under parameters
out of range, are null; a null list or parameter, or lists of unequal lengths, give null.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.registry import ALL, Indicator


def _element(ind: Indicator) -> str:
    kind = "int" if ind.integer else "double"
    return f"struct<{', '.join(f'{f}: double' for f in ind.out)}>" if ind.out else kind


def _row(ind: Indicator, lists: list, params: list) -> list | None:
    if any(x is None for x in lists) or any(p is None for p in params) or len({len(x) for x in lists}) > 1:
        return None
    columns = [np.array([np.nan if v is None else v for v in x], float) for x in lists]
    n, whole = len(columns[0]), tuple(int(p) if float(p).is_integer() and not isinstance(p, float) else float(p) for p in params)
    found = ind.run(columns, *whole) if n else [None]
    if found[0] is None:
        return [None] * n
    skip = ind.lookback(*whole)
    if ind.out:
        return [None] * skip + [dict(zip(ind.out, map(float, v))) for v in zip(*(f[skip:] for f in found))]
    return [None] * skip + [int(v) if ind.integer else float(v) for v in found[0][skip:]]


@lru_cache(maxsize=None)
def list_udf(name: str):
    """The Arrow function of lists and parameters for an indicator."""
    ind = ALL[name]
    many = len(ind.inputs)

    def f(*args: pa.Array) -> pa.Array:
        rows = zip(*(a.to_pylist() for a in args))
        kind = pa.struct([(x, pa.float64()) for x in ind.out]) if ind.out else pa.int32() if ind.integer else pa.float64()
        return pa.array([_row(ind, list(r[:many]), list(r[many:])) for r in rows], pa.list_(kind))

    return F.arrow_udf(f, f"array<{_element(ind)}>")


def _lit(p) -> Column:
    return p if isinstance(p, Column) else F.lit(p)


def series(name: str, *lists: str | Column, **params) -> Column:
    """The indicator over list columns, by its registry name: series("sma", "closes", period=20)."""
    ind = ALL[name]
    return list_udf(name)(*lists, *[_lit(params[p]) for p in ind.params])


def ordered_lists(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """One row per key with each column as a list in order; rows with a null in any of them are skipped."""
    full = df.where(" and ".join(f"`{c}` is not null" for c in columns))
    packed = full.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in columns if c != order]))).alias("_rows"))
    field = lambda c: F.transform("_rows", lambda r: r[c]).alias(c)
    return packed.select(*keys, *map(field, columns))


def last_value(df: DataFrame, name: str, keys: list[str], order: str, columns: list[str], **params) -> DataFrame:
    """The indicator as a plain aggregate: its last value over each group's rows in order."""
    lists = ordered_lists(df, keys, order, columns)
    return lists.select(*keys, F.try_element_at(series(name, *columns, **params), F.lit(-1)).alias(name))
