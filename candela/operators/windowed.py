"""Indicators over ordered rows.

Element-wise, local and cumulative indicators are window expressions, which Catalyst plans and which
share one sort per partition key. Recursive ones share one pass over the sorted partition: a series
is held by one task while it is computed, so a task's memory is that of the longest series.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import candles
from ..functions.registry import ALL, Indicator
from .series import series

NAN = float("nan")
MATH = "acos asin atan cos cosh exp sin sinh sqrt tan tanh".split()


class Frame:
    """Window specifications of one partition and order."""

    def __init__(self, partition: list, order: list):
        self.partition, self.order = list(partition), list(order)

    @property
    def base(self) -> WindowSpec:
        return Window.partitionBy(*self.partition).orderBy(*self.order)

    def last(self, p: int) -> WindowSpec:
        return self.base.rowsBetween(-(p - 1), 0)

    @property
    def full(self) -> WindowSpec:
        return self.base.rowsBetween(Window.unboundedPreceding, 0)


def _div(a, b, other=0.0) -> Column:
    return F.when(b == 0, F.lit(other)).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def _triangle(p: int) -> tuple[int, int]:
    return ((p + 1) // 2, (p + 1) // 2) if p % 2 else (p // 2, p // 2 + 1)


def steps(ind: Indicator, f: Frame, col: dict[str, Column], params: tuple, tag: str) -> tuple[list[dict[str, Column]], dict[str, Column]] | None:
    """Columns to add first, step by step, and the outputs; None if the indicator has no window form."""
    name, p = ind.name, params[0] if params else None
    x, h, l, c, o, v = (col.get(k) for k in ("x", "high", "low", "close", "open", "volume"))  # noqa: E741
    rn = F.row_number().over(f.base).cast("double")
    at = F.row_number().over(f.base) - 1
    one = lambda e: ([], {name: e})
    if ind.kind == "R" and not (name == "bbands" and params[3] == 0 or name == "stoch" and params[2] == params[4] == 0):
        return None
    if name in candles.RULES:
        w = f.base
        lags = {f"{tag}{a}{k}": (F.lag(col[b], k).over(w) if k else col[b]) for a, b in (("o", "open"), ("h", "high"), ("l", "low"), ("c", "close")) for k in range(candles.DEPTH + 1)}
        view = candles.Columns()
        view.bar = lambda a, k: F.col(f"{tag}{a}{k}")
        return [lags], {name: candles.evaluate(name, view).cast("int")}
    if name in MATH:
        return one(getattr(F, name)(x))
    if name in ("ceil", "floor"):
        return one(getattr(F, name)(x).cast("double"))
    if name in ("ln", "log10"):
        g = F.log if name == "ln" else F.log10
        return one(F.when(x > 0, g(x)).when(x == 0, F.lit(float("-inf"))).when(x.isNotNull(), F.lit(NAN)))
    if name == "sma":
        return one(F.avg(x).over(f.last(p)))
    if name in ("sum", "max", "min"):
        return one(getattr(F, name)(x).over(f.last(p)))
    if name == "midpoint":
        return one((F.max(x).over(f.last(p)) + F.min(x).over(f.last(p))) / 2)
    if name == "wma":
        weighted = [{f"{tag}r": rn}, {f"{tag}w": F.sum(x * F.col(f"{tag}r")).over(f.last(p)), f"{tag}s": F.sum(x).over(f.last(p))}]
        return weighted, {name: (F.col(f"{tag}w") - (F.col(f"{tag}r") - p) * F.col(f"{tag}s")) / (p * (p + 1) / 2)}
    if name == "trima":
        a, b = _triangle(p)
        return [{f"{tag}i": F.avg(x).over(f.last(a))}], {name: F.avg(f"{tag}i").over(f.last(b))}
    if name.startswith("linearreg") or name == "tsf":
        pre = [{f"{tag}r": rn}, {f"{tag}m": F.avg(x).over(f.last(p)), f"{tag}b": F.regr_slope(x, F.col(f"{tag}r")).over(f.last(p))}]
        m, b = F.col(f"{tag}m"), F.col(f"{tag}b")
        half = (p - 1) / 2
        return pre, {name: {"linearreg": m + b * half, "linearreg_slope": b, "linearreg_intercept": m - b * half, "linearreg_angle": F.degrees(F.atan(b)), "tsf": m + b * (half + 1)}[name]}
    if name in ("maxindex", "minindex"):
        y = x if name == "maxindex" else -x
        return [{f"{tag}k": at}], {name: F.max_by(F.col(f"{tag}k"), F.struct(y, F.col(f"{tag}k"))).over(f.last(p)).cast("int")}
    if name in ("mom", "roc", "rocp", "rocr", "rocr100"):
        b = F.lag(x, p).over(f.base)
        ratio = _div(x, b)
        return one({"mom": x - b, "roc": F.when(b == 0, 0.0).otherwise((ratio - 1) * 100), "rocp": _div(x - b, b), "rocr": ratio, "rocr100": ratio * 100}[name])
    if name == "willr":
        top, low = F.max(h).over(f.last(p)), F.min(l).over(f.last(p))
        return one(-100 * _div(top - c, top - low))
    if name == "cci":
        pre = [{f"{tag}t": (h + l + c) / 3}, {f"{tag}m": F.avg(f"{tag}t").over(f.last(p)), f"{tag}l": F.collect_list(f"{tag}t").over(f.last(p))}]
        t, m = F.col(f"{tag}t"), F.col(f"{tag}m")
        dev = F.aggregate(f"{tag}l", F.lit(0.0), lambda s, y: s + F.abs(y - m)) / p
        return pre, {name: F.when(t == m, 0.0).otherwise(_div(t - m, dev * 0.015))}
    if name == "ad":
        return one(F.sum(F.when(h > l, _div((c - l) - (h - c), h - l) * v).otherwise(0.0)).over(f.full))
    if name == "bop":
        return one(F.when(h > l, _div(c - o, h - l)).otherwise(0.0))
    if name == "trange":
        b = F.lag(c).over(f.base)
        return one(F.greatest(h - l, F.abs(h - b), F.abs(l - b)))
    if name in ("avgprice", "medprice", "typprice", "wclprice"):
        return one({"avgprice": lambda: (o + h + l + c) / 4, "medprice": lambda: (h + l) / 2, "typprice": lambda: (h + l + c) / 3, "wclprice": lambda: (h + l + c * 2) / 4}[name]())
    if name == "midprice":
        return one((F.max(h).over(f.last(p)) + F.min(l).over(f.last(p))) / 2)
    if name == "minmax":
        return [], {"min": F.min(x).over(f.last(p)), "max": F.max(x).over(f.last(p))}
    if name == "aroon":
        k = F.col(f"{tag}k")
        since = lambda e: 100 * (p - (k - e)) / p
        return [{f"{tag}k": at}, {f"{tag}u": F.max_by(k, F.struct(h, k)).over(f.last(p + 1)), f"{tag}d": F.max_by(k, F.struct(-l, k)).over(f.last(p + 1))}], {"aroon_down": since(F.col(f"{tag}d")), "aroon_up": since(F.col(f"{tag}u"))}
    if name == "bbands":
        pre = [{f"{tag}m": F.avg(x).over(f.last(p)), f"{tag}s": F.stddev_pop(x).over(f.last(p))}]
        m, s = F.col(f"{tag}m"), F.col(f"{tag}s")
        return pre, {"upper": m + s * params[1], "middle": m, "lower": m - s * params[2]}
    if name == "stoch":
        fast, slow_k, _, slow_d, _ = params
        top, low = F.max(h).over(f.last(fast)), F.min(l).over(f.last(fast))
        pre = [{f"{tag}t": top, f"{tag}b": low}, {f"{tag}f": 100 * _div(c - F.col(f"{tag}b"), F.col(f"{tag}t") - F.col(f"{tag}b"))}, {f"{tag}k": F.avg(f"{tag}f").over(f.last(slow_k))}]
        return pre, {"slowk": F.col(f"{tag}k"), "slowd": F.avg(f"{tag}k").over(f.last(slow_d))}
    return None


Request = tuple[str, str, tuple, dict]


def request(alias: str, name: str, *params, **columns) -> Request:
    """An indicator to compute: request("fast", "ema", 12, x="close"). Inputs default to columns of their names, x to close."""
    ind = ALL[name]
    return alias, name, params, {k: columns.get(k, "close" if k == "x" else k) for k in ind.inputs}


def with_indicators(df: DataFrame, requests: Iterable[Request], partition: list[str], order: list[str], skip_nulls: bool = True, peers: bool = False) -> DataFrame:
    """df with a column per request: at each row the indicator over the rows of its partition up to it.

    skip_nulls: rows with a null input are left out and repeat the value of the row before; give False
    where inputs have none, which saves a shuffle. peers: rows that tie in the order share the last
    one's value, as a default SQL frame has it.
    """
    columns, asked = df.columns, list(requests)
    inputs = {tuple(sorted(set(r[3].values()))) for r in asked}
    if skip_nulls and len(inputs) > 1:  # each set of inputs has its own rows to skip
        for group in sorted(inputs):
            df = with_indicators(df, [r for r in asked if tuple(sorted(set(r[3].values()))) == group], partition, order, True, peers)
        return df.select(*columns, *[r[0] for r in asked])
    part = list(partition)
    if skip_nulls:
        df = df.withColumn("_ok", F.lit(True) if not inputs else ~F.greatest(*[F.col(c).isNull() for c in next(iter(inputs))], F.lit(False)))
        part = [*partition, "_ok"]
    frame, scans = Frame(part, order), []
    df = df.withColumn("_n", F.row_number().over(frame.base))
    # the first steps of all requests go into one projection, then the second ones, and so on
    plans = []
    for k, (alias, name, params, cols) in enumerate(asked):
        ind = ALL[name]
        if not ind.accepts(*params):
            kind = "int" if ind.integer else f"struct<{', '.join(f'{x}: double' for x in ind.out)}>" if ind.out else "double"
            plans.append((alias, [], F.lit(None).cast(kind)))
            continue
        found = steps(ind, frame, {a: F.col(b).cast("double") for a, b in cols.items()}, params, f"_{k}_")
        if found is None:
            scans.append((alias, name, params, cols))
            continue
        pre, out = found
        value = F.struct(*[e.alias(a) for a, e in out.items()]) if ind.out else next(iter(out.values()))
        plans.append((alias, pre, F.when(F.col("_n") > ind.lookback(*params), value)))
    for level in range(max([len(p) for _, p, _ in plans], default=0)):
        df = df.withColumns({a: e for _, pre, _ in plans if level < len(pre) for a, e in pre[level].items()})
    df = df.select(*columns, *[c for c in ("_ok",) if c in df.columns], *[e.alias(a) for a, _, e in plans])
    if scans:
        df = _scan(df, scans, part, order)
    names = [r[0] for r in asked]
    if skip_nulls:
        whole = Frame(partition, order)
        df = df.select(*columns, *[F.coalesce(F.when(F.col("_ok"), F.col(a)), F.last(F.when(F.col("_ok"), F.col(a)), True).over(whole.full)).alias(a) for a in names])
    if peers:
        df = df.select(*columns, *[F.last(a).over(Frame(partition, order).base.rangeBetween(0, 0)).alias(a) for a in names])
    return df.select(*columns, *names)


def _scan(df: DataFrame, scans: list[Request], partition: list[str], order: list[str]) -> DataFrame:
    """One pass over the sorted partitions for all recursive indicators."""
    kinds = [f"struct<{', '.join(f'{x}: double' for x in ALL[n].out)}>" if ALL[n].out else "int" if ALL[n].integer else "double" for _, n, _, _ in scans]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"`{a}` {k}" for (a, *_), k in zip(scans, kinds)])
    names = df.columns

    def compute(table: pa.Table) -> pa.Table:
        for alias, name, params, cols in scans:
            ind = ALL[name]
            data = [np.array(table.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False), float) for c in cols.values()]
            found, n = ind.run(data, *params), table.num_rows
            if found[0] is None:
                kind = pa.struct([(x, pa.float64()) for x in ind.out]) if ind.out else pa.int32() if ind.integer else pa.float64()
                value = pa.nulls(n, kind)
            else:
                early = np.arange(n) < ind.lookback(*params)
                parts = [pa.array(x, pa.float64(), mask=early) for x in found]
                value = pa.StructArray.from_arrays(parts, names=list(ind.out), mask=pa.array(early)) if ind.out else parts[0].cast(pa.int32()) if ind.integer else parts[0]
            table = table.append_column(alias, value)
        return table

    def run(batches):
        held, key = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            change = np.zeros(batch.num_rows, bool)
            for c in partition:
                code = batch.column(names.index(c)).dictionary_encode(null_encoding="encode").indices.to_numpy()
                change[1:] |= code[1:] != code[:-1]
            cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                own = tuple(batch.column(names.index(c))[a].as_py() for c in partition)
                if held and own != key:
                    yield from compute(pa.Table.from_batches(held)).combine_chunks().to_batches(10_000)
                    held = []
                key = own
                held.append(batch.slice(a, b - a))
        if held:
            yield from compute(pa.Table.from_batches(held)).combine_chunks().to_batches(10_000)

    dealt = (df.repartition(*partition) if partition else df.repartition(1)).sortWithinPartitions(*partition, *order)
    return dealt.mapInArrow(run, schema)


def framed(df: DataFrame, alias: str, name: str, partition: list[str], order: list[str], preceding: int, *params, **columns) -> DataFrame:
    """The indicator over each row's frame of `preceding` rows before it and itself, computed afresh: the
    frame's first row is where a recursion starts. Rows with a null input are not in any frame."""
    ind = ALL[name]
    cols = [columns.get(k, "close" if k == "x" else k) for k in ind.inputs]
    frame = Frame(partition, order)
    rows = F.filter(F.collect_list(F.struct(*[F.col(c).cast("double").alias(f"v{k}") for k, c in enumerate(cols)])).over(frame.last(preceding + 1)), lambda r: ~F.greatest(*[r[f"v{k}"].isNull() for k in range(len(cols))], F.lit(False)))
    field = lambda k: F.transform("_frame", lambda r: r[f"v{k}"])
    lists = [field(k) for k in range(len(cols))]
    value = F.try_element_at(series(name, *lists, **dict(zip(ind.params, params))), F.lit(-1))
    return df.withColumn("_frame", rows).withColumn(alias, value).drop("_frame")
