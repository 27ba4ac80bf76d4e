"""Facts as a stream: each micro-batch is merged into the stored tables, exactly once.

An extension: the tables only know batches. The new versions of the tables and the batch's number
are published by one file; a batch that is replayed after a failure finds its number and does nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import merge
from ..operators.relations import checkpointer
from ..sources.readers import Store


def ordered(batch: DataFrame) -> list[DataFrame]:
    """A batch in steps that each hold one new fact for an object and property."""
    from ..operators.objects import sequence_of

    numbered = sequence_of(batch.dropDuplicates(["object_id", "property", "value", "valid_from"])).persist()
    try:
        last = numbered.agg(F.max("version")).first()[0] or 0
        return [numbered.where(F.col("version") == i).drop("version") for i in range(1, last + 1)]
    finally:
        numbered.unpersist()


def ingest(
    facts: DataFrame,
    store: Store,
    checkpoint: str,
    *,
    strategy: merge.MergeStrategy = merge.MergeStrategy.EXISTING,
    existence: merge.ExistenceStrategy = merge.ExistenceStrategy.IGNORE,
    database: Column | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Start merging a streaming DataFrame of facts into the store."""

    def one(batch: DataFrame, number: int) -> None:
        if number <= (store.mark(checkpoint) if store.mark(checkpoint) is not None else -1):
            return
        step = store.step()
        keep = checkpointer(batch.sparkSession)
        objects, known = store.read("objects"), store.read("facts")
        for i, part in enumerate(ordered(batch)):
            at = database if database is not None else F.current_timestamp().cast("timestamp_ntz")
            objects, known = merge.merge(objects, known, part, at, strategy=strategy, existence=existence)
            if i % 4 == 3:  # a key with many versions makes no plan of as many merges
                objects, known = keep(objects), keep(known)
        step.stage("facts", known)
        step.stage("objects", objects)
        step.publish(**{checkpoint: number})

    writer = facts.writeStream.option("checkpointLocation", f"{checkpoint}/stream").foreachBatch(one)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_counts(events: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Events by type and tumbling window; rows later than ``late`` are left out."""
    return (
        events.withWatermark("at", late)
        .groupBy(F.window("at", width).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("start"), "event_type", "n")
    )
