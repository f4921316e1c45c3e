"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line with the seconds of each.

Ticks are the table lineitem as 50 series in key order. Every query is run whole, its result thrown
away by Spark's noop sink; the better of two runs counts, after one run to warm up.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candela import queries
from candela.functions import stats
from candela.operators import series, wide, windowed
from candela.operators.windowed import request

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def ticks(spark: SparkSession) -> DataFrame:
    df = spark.read.parquet(f"{SF_DIR}/lineitem.parquet")
    price = F.col("l_extendedprice")
    return df.select(
        (F.col("l_suppkey") % 50).alias("symbol"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ts"),
        price.alias("open"), (price * 1.02).alias("high"), (price * 0.97).alias("low"), (price * (1 - F.col("l_discount") / 10)).alias("close"), F.col("l_quantity").alias("volume"),
    )


def one_series(spark: SparkSession) -> DataFrame:
    """300,000 rows of one partition."""
    return spark.range(300_000).select(F.lit("A").alias("symbol"), F.col("id").alias("ts"), (100 + 10 * F.sin(F.col("id") / 50) + F.col("id") % 7).alias("close"))


def indicators(df: DataFrame, *asked) -> DataFrame:
    return windowed.with_indicators(df, list(asked), ["symbol"], ["ts"], skip_nulls=False)


def rolling(spark):
    w = Window.partitionBy("symbol").orderBy("ts").rowsBetween(-99, 0)
    return ticks(spark).select("symbol", "ts", *[stats.rolling(n, w, F.col("close"), F.col("volume")).alias(n) for n in ("avg", "rolling_var", "rolling_beta")])


def lists(spark):
    df = series.ordered_lists(ticks(spark), ["symbol"], "ts", ["close", "volume"])
    return df.select("symbol", stats.stat_var("close"), stats.stat_corr("close", "volume"), stats.stat_max_drawdown("close"), stats.stat_skew("close"))


QUERIES = {
    "sma20_one_series_300k": lambda s: indicators(one_series(s), request("v", "sma", 20)),
    "linearreg20_one_series_300k": lambda s: indicators(one_series(s), request("v", "linearreg", 20)),
    "sma20_ema20_rsi14": lambda s: indicators(ticks(s), request("a", "sma", 20), request("b", "ema", 20), request("c", "rsi", 14)),
    "rolling_100": rolling,
    "list_statistics": lists,
    "wide_table": lambda s: wide.indicator_table(ticks(s).where("symbol = 0 or symbol > 41"), ["symbol"]),
    "bars_sma": lambda s: queries.first_slice(s, SF_DIR),
    "candles": lambda s: indicators(ticks(s), *[request(n, n) for n in ("cdldoji", "cdlengulfing", "cdlharami", "cdl3outside")]),
}


def main() -> None:
    spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    found: dict[str, float] = {}
    todo = dict(QUERIES)
    try:  # the operators over texts can be taken out as a whole
        from candela.llm import registry

        todo |= {n: (lambda s, f=registry.QUERIES[n]: f(s, SF_DIR)) for n in ("op1_fingerprints", "op9_decontamination", "op10_packing")}
    except ImportError:
        pass
    for name, query in todo.items():
        best = []
        for _ in range(3):
            began = time.time()
            query(spark).write.format("noop").mode("overwrite").save()
            best.append(time.time() - began)
        found[name] = round(min(best[1:]), 3)
        print(name, found[name], file=sys.stderr)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "sf": os.path.basename(SF_DIR).removeprefix("sf")}))


if __name__ == "__main__":
    main()
