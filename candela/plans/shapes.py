"""Search for series of a like shape: resampled z-scores by cosine and time warping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null where one is zero or they differ in length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / F.when(size > 0, size))


def nearest_shapes(series: DataFrame, key: str, values: str, target: list[float], points: int = 32, candidates: int | None = None, top: int = 5, window: int = 0) -> DataFrame:
    """The `top` rows whose list is closest to target by warped distance of the resampled shapes, with
    their cosine. All rows are warped, `points` squared steps each; with `candidates`, only as many of
    the greatest cosine, which is quicker and may miss some. The target, a list of the caller's, is a
    literal of the plan; rows without a shape are left out."""
    want = F.array(*[F.lit(float(v)) for v in target])
    shaped = series.select(key, stats.stat_resample(values, points).alias("_s"), stats.stat_resample(want, points).alias("_t"))
    shaped = shaped.withColumn("cosine", cosine(F.col("_s"), F.col("_t"))).where("cosine is not null")
    if candidates is not None:
        shaped = shaped.orderBy(F.desc("cosine"), key).limit(candidates)
    warped = shaped.withColumn("warp", stats.stat_dtw("_s", "_t", window))
    return warped.select(key, "cosine", F.col("warp.distance").alias("distance"), F.col("warp.lag").alias("lag"), F.col("warp.similarity").alias("similarity")).orderBy("distance", key).limit(top)
