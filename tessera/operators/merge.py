"""Merging new fact versions into a bitemporal fact table, for whole batches at once.

A new fact whose value differs from the object's current one ends the old version: the old
row's database time is closed, a copy valid until the new start is recorded, and the new
fact is added. Equal facts change nothing. All steps are joins on (object, property).
"""

from __future__ import annotations

from enum import StrEnum

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.temporal import Span, as_of, during
from ..schema import TABLES



class MergeStrategy(StrEnum):
    CONTINUING = "continuing"  # the current facts must be open
    EXISTING = "existing"
    NO_MERGE = "none"


class ExistenceStrategy(StrEnum):
    IGNORE = "ignore"
    DURING = "during"
    EXTEND = "extend"


class MergeConflict(ValueError):
    """A batch that the strategy doesn't admit."""


def _keys(df: DataFrame) -> DataFrame:
    return df.select("object_id", "property").distinct()


def current_facts(facts: DataFrame, incoming: DataFrame, valid: Column | None, database: Column) -> DataFrame:
    """Current versions of the properties that the batch touches."""
    own = facts.join(_keys(incoming), ["object_id", "property"], "left_semi")
    if valid is not None:
        return own.where(as_of(valid, database))
    new = incoming.groupBy("object_id", "property").agg(F.min(F.coalesce("valid_from", "valid_at")).alias("_at"))
    return own.join(new, ["object_id", "property"]).where(as_of(F.col("_at"), database)).drop("_at")


def diverging(facts: DataFrame, incoming: DataFrame) -> DataFrame:
    """Facts of the batch that no current fact equals."""
    same = ["object_id", "property", "value", "datatype"]
    return incoming.join(facts.select(*same).distinct(), same, "left_anti")


def continuing_conflicts(facts: DataFrame, incoming: DataFrame, valid: Column | None, database: Column) -> DataFrame:
    """Current facts that have ended already: ``continuing`` rejects the batch."""
    return current_facts(facts, incoming, valid, database).where(F.col("valid_to").isNotNull() | F.col("valid_at").isNotNull())


def no_merge_conflicts(facts: DataFrame, incoming: DataFrame) -> DataFrame:
    """Properties of the batch that the objects have already."""
    return _keys(facts.where(F.col("db_to").isNull())).join(_keys(incoming), ["object_id", "property"], "left_semi")


def existence_violations(objects: DataFrame, incoming: DataFrame) -> DataFrame:
    """Facts that don't lie within their object's lifetime."""
    life = objects.select("object_id", F.col("exists_from").alias("_from"), F.col("exists_to").alias("_to"))
    b = Span(F.col("_from"), F.col("_to"))
    inside = F.when(F.col("valid_at").isNotNull(), during(Span(at=F.col("valid_at")), b)).otherwise(during(Span.of("valid"), b))
    return incoming.join(life, "object_id").where(~F.coalesce(inside, F.lit(False))).drop("_from", "_to")


def extended_existence(objects: DataFrame, incoming: DataFrame, unit: str = "1 MICROSECOND") -> DataFrame:
    """Lifetimes grown to hold the facts. A closed lifetime can't hold an open fact: see
    ``open_on_closed``; such objects keep their end."""
    f = incoming.groupBy("object_id").agg(
        F.min(F.coalesce("valid_from", "valid_at")).alias("_first"), F.max(F.coalesce("valid_to", "valid_at")).alias("_last")
    )
    end = F.when(F.col("_last") >= F.col("exists_to"), F.col("_last") + F.expr(f"INTERVAL {unit}")).otherwise(F.col("exists_to"))
    return (
        objects.join(f, "object_id", "left")
        .withColumn("exists_to", end)
        .withColumn("exists_from", F.least("exists_from", "_first"))
        .select(*TABLES["objects"].names)
    )


def open_on_closed(objects: DataFrame, incoming: DataFrame) -> DataFrame:
    closed = objects.where(F.col("exists_to").isNotNull()).select("object_id")
    return incoming.where(F.col("valid_to").isNull() & F.col("valid_at").isNull()).join(closed, "object_id", "left_semi")


def merge_existing(facts: DataFrame, incoming: DataFrame, database: Column, valid: Column | None = None) -> DataFrame:
    """The whole fact table after the batch. The batch holds at most one new fact for each
    object and property; longer chains go through ``version_chain``."""
    names = TABLES["facts"].names
    now = current_facts(facts, incoming, valid, database)
    new = diverging(now, incoming).select(*names).withColumns({"db_from": database, "db_to": F.lit(None).cast("timestamp_ntz")})
    begins = new.groupBy("object_id", "property").agg(F.min(F.coalesce("valid_from", "valid_at")).alias("_new"))
    at = begins.withColumnRenamed("_new", "_at")
    flagged = facts.join(at, ["object_id", "property"], "left")
    hit = F.coalesce(F.col("_at").isNotNull() & as_of(F.col("_at") if valid is None else valid, database), F.lit(False))
    closed = flagged.withColumn("db_to", F.when(hit, database).otherwise(F.col("db_to"))).select(*names)
    cut = (
        now.join(begins, ["object_id", "property"])
        .withColumn("valid_to", F.when(F.col("valid_at").isNull(), F.col("_new")).otherwise(F.col("valid_to")))
        .withColumns({"db_from": database, "db_to": F.lit(None).cast("timestamp_ntz")})
        .select(*names)
    )
    return closed.unionByName(cut).unionByName(new.select(*names))


def merge(
    objects: DataFrame,
    facts: DataFrame,
    incoming: DataFrame,
    database: Column,
    *,
    valid: Column | None = None,
    strategy: MergeStrategy = MergeStrategy.CONTINUING,
    existence: ExistenceStrategy = ExistenceStrategy.DURING,
) -> tuple[DataFrame, DataFrame]:
    """Objects and facts after the batch; raises MergeConflict before anything changes."""
    if strategy == MergeStrategy.NO_MERGE:
        if not no_merge_conflicts(facts, incoming).isEmpty():
            raise MergeConflict("the objects have some of these properties already")
    elif strategy == MergeStrategy.CONTINUING and not continuing_conflicts(facts, incoming, valid, database).isEmpty():
        raise MergeConflict("some current facts have ended")
    if existence == ExistenceStrategy.DURING and not existence_violations(objects, incoming).isEmpty():
        raise MergeConflict("some facts lie outside their object's lifetime")
    if existence == ExistenceStrategy.EXTEND:
        if not open_on_closed(objects, incoming).isEmpty():
            raise MergeConflict("an open fact on an object whose lifetime has ended")
        objects = extended_existence(objects, incoming)
    return objects, merge_existing(facts, incoming, database, valid)


def collapse(df: DataFrame, keys: list[str], order: list, value: str) -> DataFrame:
    """Rows whose value differs from the one before: consecutive repeats go."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.lag(F.struct(value)).over(w)
    return df.withColumn("_before", before).where(F.col("_before").isNull() | ~F.col("_before")[value].eqNullSafe(F.col(value))).drop("_before")


def version_chain(df: DataFrame, keys: list[str], value: str, at: str, delay: str = "1 DAY") -> DataFrame:
    """Fact versions that a sequence of single merges would leave: for each key the changes of
    ``value`` in order of ``at``, each recorded ``delay`` after it became true. Every change
    but the last leaves two rows: open until it was superseded, and closed after that."""
    changes = collapse(df, keys, [at], value)
    w = Window.partitionBy(*keys).orderBy(at)
    known = F.col(at) + F.expr(f"INTERVAL {delay}")
    rows = changes.withColumns({"_next": F.lead(at).over(w), "_known": known}).withColumn("_next_known", F.col("_next") + F.expr(f"INTERVAL {delay}"))
    none = F.lit(None).cast("timestamp_ntz")
    first = F.struct(F.col(at).alias("valid_from"), none.alias("valid_to"), F.col("_known").alias("db_from"), F.col("_next_known").alias("db_to"))
    second = F.struct(F.col(at).alias("valid_from"), F.col("_next").alias("valid_to"), F.col("_next_known").alias("db_from"), none.alias("db_to"))
    versions = F.when(F.col("_next").isNull(), F.array(first)).otherwise(F.array(first, second))
    return rows.select(*keys, value, F.inline(versions))


def close_database(facts: DataFrame, at: Column, keys: DataFrame) -> DataFrame:
    """End the open database time of facts of these objects and properties."""
    return _close(facts, "db_to", at, keys)


def close_valid(facts: DataFrame, at: Column, keys: DataFrame) -> DataFrame:
    return _close(facts, "valid_to", at, keys)


def _close(facts: DataFrame, column: str, at: Column, keys: DataFrame) -> DataFrame:
    k = keys.select("object_id", "property").distinct().withColumn("_hit", F.lit(True))
    open_ = F.col(column).isNull() & F.col("_hit") & F.col("valid_at").isNull()
    return facts.join(k, ["object_id", "property"], "left").withColumn(column, F.when(open_, at).otherwise(F.col(column))).select(*TABLES["facts"].names)


def add_facts(objects: DataFrame, facts: DataFrame, incoming: DataFrame, datatypes: dict[str, str], database: Column, **options) -> tuple[DataFrame, DataFrame]:
    """Facts for existing objects; their datatypes must be those of the dataset's properties."""
    expected = F.create_map(*[F.lit(x) for pair in datatypes.items() for x in pair]) if datatypes else F.create_map()
    if not incoming.where(~F.col("datatype").eqNullSafe(expected[F.col("property")])).isEmpty():
        raise MergeConflict("a fact's datatype is not its property's")
    return merge(objects, facts, incoming, database, **options)
