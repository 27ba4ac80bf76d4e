"""Time-series metrics: registry, windows, decomposition and export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def series(metrics: DataFrame, gauges: DataFrame, counters: DataFrame) -> DataFrame:
    """All values as doubles: ``metric, ts, value``."""
    values = gauges.select("metric_id", "ts", F.col("value").cast("double").alias("value")).unionByName(
        counters.select("metric_id", "ts", F.col("value").cast("double").alias("value"))
    )
    return values.join(metrics, "metric_id").select("metric", "ts", "value")


def window(values: DataFrame, names: Sequence[str] | None, start: Column | None = None, end: Column | None = None) -> DataFrame:
    if names is not None:
        values = values.where(F.col("metric").isin(list(names)))
    if start is not None:
        values = values.where(F.col("ts") >= start)
    if end is not None:
        values = values.where(F.col("ts") < end)
    return values


def export(values: DataFrame, names: Sequence[str] | None = None, start: Column | None = None, end: Column | None = None) -> DataFrame:
    return window(values, names, start, end).orderBy("metric", "ts")


def decompose(values: DataFrame, accuracy: int | None = 10_000) -> DataFrame:
    """Count, least, largest, mean, deviation and percentiles of each metric. The percentiles come from a sketch
    of bounded size, with a rank error of 1 / accuracy; with None they are exact and hold every distinct value."""
    at = [("median", 0.5), ("p75", 0.75), ("p95", 0.95), ("p98", 0.98), ("p99", 0.99), ("p999", 0.999)]
    points = F.array(*[F.lit(p) for _, p in at])
    q = F.percentile("value", points) if accuracy is None else F.percentile_approx("value", points, accuracy)
    wide = values.groupBy("metric").agg(
        F.count("value").alias("n"), F.min("value").alias("least"), F.max("value").alias("largest"), F.avg("value").alias("mean"), F.stddev("value").alias("stddev"), q.alias("q")
    )
    return wide.select("metric", "n", "least", "largest", "mean", "stddev", *[F.col("q")[i].alias(name) for i, (name, _) in enumerate(at)])


def rates(values: DataFrame, now: Column) -> DataFrame:
    """Events a second over the last 1, 5 and 15 minutes, and over all time."""
    first = values.groupBy("metric").agg(
        F.min("ts").alias("first"),
        *[F.count(F.when(F.col("ts") > now - F.expr(f"INTERVAL {m} MINUTES"), 1)).alias(f"_m{m}") for m in (1, 5, 15)],
        F.count(F.lit(1)).alias("_n"),
    )
    seconds = F.greatest(F.lit(1.0), (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("first").cast("timestamp"))) / 1e6)
    return first.select("metric", *[(F.col(f"_m{m}") / (60.0 * m)).alias(f"rate_{m}m") for m in (1, 5, 15)], (F.col("_n") / seconds).alias("rate_mean"))
