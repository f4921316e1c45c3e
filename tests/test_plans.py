"""Physical plans: what is shuffled, sorted and read."""

import re

import pytest
from candela.operators import wide, windowed
from candela.operators.windowed import request
from pyspark.sql import functions as F


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bars") / "bars")
    names = ("open", "high", "low", "close", "volume")
    spark.range(500).select((F.col("id") % 5).cast("string").alias("symbol"), F.col("id").alias("ts"), *[(F.col("id") * 1.0 + k).alias(c) for k, c in enumerate(names)], F.lit("x").alias("unused")).write.parquet(path)
    return spark.read.parquet(path)


def test_window_indicators_share_one_shuffle_and_read_what_they_need(stored):
    asked = [request(n, n, 5) for n in ("sma", "wma", "trima", "linearreg", "max", "mom")] + [request("willr", "willr", 5)]
    text = plan(windowed.with_indicators(stored.select("symbol", "ts", "high", "low", "close"), asked, ["symbol"], ["ts"], skip_nulls=False))
    assert len(re.findall(r"Exchange hashpartitioning\(symbol", text)) == 1 and len(re.findall(r"\bSort \[", text)) == 1
    assert "MapInArrow" not in text and "unused" not in re.search(r"ReadSchema: .*", text)[0]


def test_wide_table_is_one_shuffle_one_sort_and_one_scan(stored):
    text = plan(wide.indicator_table(stored.drop("unused"), ["symbol"]))
    assert len(re.findall(r"Exchange", text)) == 1 and len(re.findall(r"\bSort \[", text)) == 1 and len(re.findall(r"MapInArrow", text)) == 1


def test_filters_on_the_partition_reach_the_scan(stored):
    out = windowed.with_indicators(stored, [request("v", "sma", 5)], ["symbol"], ["ts"], skip_nulls=False).where("symbol = '3'")
    assert "EqualTo(symbol,3)" in plan(out)
