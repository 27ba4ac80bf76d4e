"""Weighted collections of objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import relation_id
from ..schema import TABLES

RELATION_TYPES = ("TEMPORAL", "SPATIAL", "SEMANTIC")


def collections(members: DataFrame) -> DataFrame:
    return members.select("collection_id").distinct()


def related(members: DataFrame, object_id: str, cutoff: float, collection: str | None = None) -> DataFrame:
    """Collections of an object with the members that share its strength there, grouped."""
    strong = members.where(F.col("strength") >= cutoff)
    own = strong.where(F.col("object_id") == object_id).select("collection_id", "strength").distinct()
    own = own if collection is None else own.where(F.col("collection_id") == collection)
    peers = strong.join(own, ["collection_id", "strength"], "left_semi")
    return peers.groupBy("collection_id").agg(F.array_sort(F.collect_set("object_id")).alias("members"))


def related_pairs(members: DataFrame, object_id: str, cutoff: float) -> DataFrame:
    return related(members, object_id, cutoff).select("collection_id", F.explode("members").alias("object_id"))


def members_of(members: DataFrame, objects: DataFrame, class_: str, collection: str, cutoff: float) -> DataFrame:
    own = members.where((F.col("collection_id") == collection) & (F.col("strength") >= cutoff))
    return own.join(objects.where(F.col("class") == class_).select("object_id"), "object_id", "left_semi").select("object_id", "strength")


def adjacent(members: DataFrame, relations: DataFrame, cutoff: float, collection: str | None = None) -> DataFrame:
    """Pairs of collections whose members meet, both members at least at the cutoff."""
    strong = members.where(F.col("strength") >= cutoff).select("collection_id", "object_id").distinct()
    meets = relations.where(F.col("relation") == "SPATIAL_MEETS").select("subject", "object")
    left = strong.select(F.col("collection_id").alias("collection"), F.col("object_id").alias("subject"))
    if collection is not None:
        left = left.where(F.col("collection") == collection)
    right = strong.select(F.col("collection_id").alias("other"), F.col("object_id").alias("object"))
    # each join is followed by a distinct: at most collections x objects rows go on
    reached = left.join(meets, "subject").select("collection", "object").distinct()
    return reached.join(right, "object").where(F.col("collection") != F.col("other")).select("collection", "other").distinct()


def are_adjacent(members: DataFrame, relations: DataFrame, a: str, b: str, cutoff: float) -> bool:
    return not adjacent(members, relations, cutoff, a).where(F.col("other") == b).limit(1).isEmpty()


def intersecting(members: DataFrame, shapes: DataFrame, hit: Column, cutoff: float) -> DataFrame:
    """Collections with a member whose shape satisfies ``hit``."""
    ids = shapes.where(hit).select("object_id").distinct()
    return members.where(F.col("strength") >= cutoff).join(ids, "object_id", "left_semi").select("collection_id").distinct()


def add(members: DataFrame, new: DataFrame) -> DataFrame:
    """Members are unique within a collection: a new strength replaces the old."""
    if not new.where(~F.col("relation_type").isin(*RELATION_TYPES)).isEmpty():
        raise ValueError(f"relation types are {', '.join(RELATION_TYPES)}")
    names = TABLES["collection_members"].names
    kept = members.join(new.select("collection_id", "object_id").distinct(), ["collection_id", "object_id"], "left_anti")
    return kept.select(*names).unionByName(new.select(*names))


def remove(members: DataFrame, collection: str) -> DataFrame:
    return members.where(F.col("collection_id") != collection)


def remove_member(members: DataFrame, collection: str, object_id: str) -> DataFrame:
    """A collection without members is gone by itself: it exists through its members."""
    return members.where(~((F.col("collection_id") == collection) & (F.col("object_id") == object_id)))


def with_ids(members: DataFrame) -> DataFrame:
    return members.withColumn("relation_id", relation_id(F.col("collection_id"), F.col("object_id")))
