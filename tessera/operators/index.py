"""Temporal key index: values of keys over half-open integer ranges, as a table sorted by start."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX = (1 << 63) - 1


def check(entries: DataFrame, largest: int = MAX) -> DataFrame:
    """Entries that no index takes: negative start, end before start or beyond the largest value."""
    return entries.where((F.col("start") < 0) | (F.col("end") < F.col("start")) | (F.col("end") > largest))


def insert(index: DataFrame, entries: DataFrame, largest: int = MAX) -> DataFrame:
    """``key, start, end, value``; a null end is open. Raises on bad entries."""
    entries = entries.withColumn("end", F.coalesce("end", F.lit(largest)))
    if not check(entries, largest).isEmpty():
        raise ValueError("an entry is negative, reversed or too large")
    return index.unionByName(entries.select(*index.columns))


def holds(at: Column) -> Column:
    return ((F.col("start") <= at) & (at < F.col("end"))) | ((F.col("start") == F.col("end")) & (F.col("start") == at))


def get(index: DataFrame, key: str, at: int) -> DataFrame:
    return index.where((F.col("key") == key) & holds(F.lit(at))).select("value")


def lookup(index: DataFrame, queries: DataFrame, width: int | None = None, most: int = 64) -> DataFrame:
    """Values for many ``key, at`` at once: an equi-join on the key with the range as residual.

    With ``width``, ranges of up to ``most`` times that length are joined by key and slice of time, so that a key
    with very many versions is spread over tasks and compares neighbours only; longer ones by key alone."""

    def joined(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        return left.join(right, on).where(holds(F.col("at"))).select("key", "at", "value")

    if width is None:
        return joined(queries, index, ["key"])
    short = F.col("end") - F.col("start") <= most * width
    slices = F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width)))
    near = joined(queries.withColumn("_slice", F.floor(F.col("at") / width)), index.where(short).withColumn("_slice", slices), ["key", "_slice"])
    return near.unionByName(joined(queries, index.where(~short), ["key"]))


def delete(index: DataFrame, key: str, at: int) -> DataFrame:
    return index.where(~((F.col("key") == key) & holds(F.lit(at))))


def delete_value(index: DataFrame, value: str) -> DataFrame:
    return index.where(F.col("value") != value)


def update(index: DataFrame, key: str, at: int, value: str) -> DataFrame:
    return index.withColumn("value", F.when((F.col("key") == key) & holds(F.lit(at)), F.lit(value)).otherwise(F.col("value")))


def set_range(index: DataFrame, key: str, at: int, start: int, end: int) -> DataFrame:
    hit = (F.col("key") == key) & holds(F.lit(at))
    return index.select("key", F.when(hit, F.lit(start)).otherwise(F.col("start")).alias("start"), F.when(hit, F.lit(end)).otherwise(F.col("end")).alias("end"), "value")


def rebuild(index: DataFrame, partitions: int) -> DataFrame:
    """Range partitions by start, sorted: point queries then skip files by their statistics."""
    return index.repartitionByRange(partitions, "start").sortWithinPartitions("start", "end")


def statistics(index: DataFrame) -> DataFrame:
    """Entries of each key and the share of them that are points."""
    return index.groupBy("key").agg(F.count(F.lit(1)).alias("entries"), F.avg(F.when(F.col("start") == F.col("end"), 1.0).otherwise(0.0)).alias("points"))
