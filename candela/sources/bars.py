"""Bars (symbol, ts, open, high, low, close, volume) from files and from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


def read_csv(spark: SparkSession, path: str, schema: str = SCHEMA, header: bool = True) -> DataFrame:
    """Typed bars from CSV files; rows that don't parse are an error."""
    return spark.read.schema(schema).option("header", header).option("mode", "FAILFAST").csv(path)


def from_events(events: DataFrame, unit: str = "hour") -> DataFrame:
    """Bars of the values of each event type: first, highest, lowest, last value and count per unit of time."""
    ts = F.date_trunc(unit, F.col("ts")).cast("timestamp_ntz")
    return events.groupBy(F.col("event_type").alias("symbol"), ts.alias("ts")).agg(
        F.min_by("value", "ts").alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", "ts").alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume"),
    )


def load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


#: The same bars in SQL.
SQL = """bars AS (
  SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM events GROUP BY 1, 2
)"""
