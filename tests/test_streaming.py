import datetime as dt

from candela.streaming import bars
from pyspark.sql import functions as F


def test_stream_bars_and_running_ema(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(minutes=17 * k), "A" if k % 2 else "B", float(k)) for k in range(80)]
    spark.createDataFrame(rows, "ts timestamp, event_type string, value double").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "in"))
    closed = bars.stream_bars(stream, "1 hour", "1 hour")
    query = closed.writeStream.outputMode("append").format("memory").queryName("closed_bars").start()
    query.processAllAvailable()
    query.stop()
    got = spark.table("closed_bars").orderBy("symbol", "ts").collect()
    late = max(r[0] for r in rows) - dt.timedelta(hours=1)
    assert got and all(r.ts + dt.timedelta(hours=1) <= late for r in got)
    for r in got:
        own = [v for t, s, v in rows if s == r.symbol and r.ts <= t < r.ts + dt.timedelta(hours=1)]
        assert (r.open, r.high, r.low, r.close, r.volume) == (own[0], max(own), min(own), own[-1], len(own))

    spark.createDataFrame([("A", start + dt.timedelta(hours=k), float(k)) for k in range(6)], "symbol string, ts timestamp, close double").coalesce(1).write.parquet(str(tmp_path / "bars"))
    more = spark.readStream.schema("symbol string, ts timestamp, close double").parquet(str(tmp_path / "bars"))
    query = bars.running_ema(more, 3).writeStream.outputMode("append").format("memory").queryName("emas").start()
    query.processAllAvailable()
    query.stop()
    assert [r.ema for r in spark.table("emas").orderBy("ts").collect()] == [None, None, 1.0, 2.0, 3.0, 4.0]
    assert spark.table("emas").where(F.col("ema").isNotNull()).count() == 4
