"""Aggregation of datasets: restrict objects, then unite their shapes."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..geometry import udfs
from ..schema import typed
from . import spatial
from .objects import COMPARISONS


@dataclass(frozen=True)
class Operation:
    """A comparison of a property with a value, of the given datatype."""

    property: str
    op: str
    value: Any
    datatype: str = "xsd:double"

    def holds(self) -> Column:
        return (F.col("property") == self.property) & COMPARISONS[self.op](typed(F.col("value"), self.datatype), F.lit(self.value))


def restricted(objects: DataFrame, facts: DataFrame, class_: str, where: Operation | None = None, shape: str | None = None, op: Operation | None = None) -> DataFrame:
    """Ids of a class whose facts satisfy the restriction, whose shape meets ``shape``, and then ``op``."""
    ids = objects.where(F.col("class") == class_).select("object_id")
    for step in filter(None, (where, op)):
        ids = ids.join(facts.where(step.holds()).select("object_id").distinct(), "object_id", "left_semi")
    if shape is not None:
        own = facts.where(F.col("property") == "asWKT").join(ids, "object_id", "left_semi")
        ids = udfs.intersecting(udfs.with_envelope(own, "value"), "value", shape).select("object_id").distinct()
    return ids


def union_of(facts: DataFrame, ids: DataFrame, group: DataFrame | None = None, cell: float | None = None) -> DataFrame:
    """Area and envelope of the union of the objects' outer rings, by group (object_id, group_id) or overall.

    Shapes are dealt over a grid; each task unites what lies in its cells, and the areas of the cells are added
    up, so no task holds a group. ``cell``: length of a cell's side, by default four mean extents of the shapes."""
    shapes = facts.where(F.col("property") == "asWKT").join(ids, "object_id", "left_semi").select("object_id", "value")
    shapes = shapes.join(group, "object_id") if group is not None else shapes.withColumn("group_id", F.lit("all"))
    boxed = udfs.with_envelope(shapes, "value")
    bounds = boxed.groupBy("group_id").agg(
        F.countDistinct("object_id").alias("n"), *[f(c).alias(c) for c, f in (("xmin", F.min), ("ymin", F.min), ("xmax", F.max), ("ymax", F.max))]
    )
    size = cell or spatial.cell_size(boxed)
    dealt = boxed.select("group_id", "value", F.inline(spatial.cells(spatial.Box.of(), size)))
    x, y = F.col("_cx") * F.lit(size), F.col("_cy") * F.lit(size)
    parts = dealt.withColumns({"_x": x, "_y": y}).groupBy("group_id", "_cx", "_cy").agg(udfs.union_area_within(F.col("value"), F.col("_x"), F.col("_y"), F.lit(size)).alias("area"))
    return parts.groupBy("group_id").agg(F.sum("area").alias("area")).join(bounds, "group_id")
