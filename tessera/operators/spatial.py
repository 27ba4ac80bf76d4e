"""Spatial operators on envelopes: exact for axis-parallel rectangles, the filter step for polygons.

Joins deal both sides over a grid of cells and compare only within a cell; a pair that
shares several cells is kept in the one that holds the lower left corner of the common area,
so no distinct is needed. Equal shapes are joined as blocks (``block_join``): a report is made once for a
pair of blocks, and only its rows are as many as the pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENVELOPE = ("xmin", "ymin", "xmax", "ymax")


@dataclass(frozen=True)
class Box:
    xmin: Column
    ymin: Column
    xmax: Column
    ymax: Column

    @classmethod
    def of(cls, prefix: str = "") -> Box:
        return cls(*(F.col(prefix + c) for c in ENVELOPE))

    @classmethod
    def lit(cls, *bounds: float) -> Box:
        return cls(*map(F.lit, bounds))

    @property
    def area(self) -> Column:
        return (self.xmax - self.xmin) * (self.ymax - self.ymin)

    def grown(self, by: float | Column) -> Box:
        return Box(self.xmin - by, self.ymin - by, self.xmax + by, self.ymax + by)

    def intersects(self, o: Box) -> Column:
        return (self.xmin <= o.xmax) & (o.xmin <= self.xmax) & (self.ymin <= o.ymax) & (o.ymin <= self.ymax)

    def overlaps_inside(self, o: Box) -> Column:
        return (self.xmin < o.xmax) & (o.xmin < self.xmax) & (self.ymin < o.ymax) & (o.ymin < self.ymax)

    def touches(self, o: Box) -> Column:
        return self.intersects(o) & ~self.overlaps_inside(o)

    def covers(self, o: Box) -> Column:
        return (self.xmin <= o.xmin) & (self.ymin <= o.ymin) & (self.xmax >= o.xmax) & (self.ymax >= o.ymax)

    def common(self, o: Box) -> Box:
        return Box(F.greatest(self.xmin, o.xmin), F.greatest(self.ymin, o.ymin), F.least(self.xmax, o.xmax), F.least(self.ymax, o.ymax))

    def common_area(self, o: Box) -> Column:
        c = self.common(o)
        return F.greatest(F.lit(0), c.xmax - c.xmin) * F.greatest(F.lit(0), c.ymax - c.ymin)

    @property
    def wkt(self) -> Column:
        at = lambda x, y: F.concat_ws(" ", x.cast("string"), y.cast("string"))
        ring = [at(self.xmin, self.ymin), at(self.xmax, self.ymin), at(self.xmax, self.ymax), at(self.xmin, self.ymax), at(self.xmin, self.ymin)]
        return F.concat(F.lit("POLYGON (("), F.concat_ws(", ", *ring), F.lit("))"))


def equality(a: Box, b: Box) -> Column:
    """Common area over the larger area."""
    return a.common_area(b) / F.greatest(a.area, b.area)


def containment(a: Box, b: Box, threshold: float) -> Column:
    """WITHIN or CONTAINS by which is smaller, if enough of it is common; else NONE."""
    enough = a.common_area(b) / F.least(a.area, b.area) >= threshold
    return F.when(enough & (a.area <= b.area), "WITHIN").when(enough, "CONTAINS").otherwise("NONE")


def compare(a: Box, b: Box, threshold: float) -> Column:
    """Struct of equality (null below the threshold), relation, overlap (share of a) and
    overlap_wkt; all null for disjoint shapes."""
    equal = equality(a, b)
    meets, apart, covers = a.touches(b), ~a.intersects(b), a.covers(b)
    return F.struct(
        F.when(~apart & (equal >= threshold), equal).alias("equality"),
        F.when(apart, F.lit(None).cast("string")).when(meets, "SPATIAL_MEETS").when(covers, "COVERS").otherwise("SPATIAL_OVERLAPS").alias("relation"),
        F.when(apart | meets, F.lit(None).cast("double")).when(covers, b.area / a.area).otherwise(a.common_area(b) / a.area).alias("overlap"),
        F.when(apart | meets, F.lit(None).cast("string")).when(covers, b.wkt).otherwise(a.common(b).wkt).alias("overlap_wkt"),
    )


def cells(box: Box, size: float) -> Column:
    def along(lo: Column, hi: Column) -> Column:
        return F.sequence(F.floor(lo / size).cast("int"), F.floor(hi / size).cast("int"))

    return F.flatten(
        F.transform(along(box.xmin, box.xmax), lambda x: F.transform(along(box.ymin, box.ymax), lambda y: F.struct(x.alias("_cx"), y.alias("_cy"))))
    )


def cell_size(*sides: DataFrame) -> float:
    """Side of a grid cell for frames with envelopes: four mean extents of the side with the larger ones, so
    that a shape falls into a few cells. One aggregate over each side; 1 if there is nothing to measure."""
    extent = F.avg(F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")))
    found = [s.agg(extent).first()[0] for s in sides]
    return 4.0 * max((x for x in found if x and x > 0), default=0.25)


def grid_join(a: DataFrame, b: DataFrame, size: float | None = None) -> DataFrame:
    """Pairs whose envelopes intersect. The columns of ``a`` come back as ``a_*``, those of ``b``
    as ``b_*``. A crowded cell is split by AQE's skew join. ``size``: see ``cell_size``, which is asked
    if none is given."""
    size = size or cell_size(a, b)
    left = a.select(*[F.col(c).alias(f"a_{c}") for c in a.columns])
    right = b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns])
    x, y = Box.of("a_"), Box.of("b_")
    left = left.select("*", F.inline(cells(x, size)))
    right = right.select("*", F.inline(cells(y, size)))
    corner = x.common(y)
    home = (F.floor(corner.xmin / size).cast("int") == F.col("_cx")) & (F.floor(corner.ymin / size).cast("int") == F.col("_cy"))
    return left.join(right, ["_cx", "_cy"]).where(x.intersects(y) & home).drop("_cx", "_cy")


#: Rows in a block of equal shapes, and in a group that is collected before it is cut into blocks.
BLOCK, GROUP = 1024, 65536


def blocks(shapes: DataFrame) -> DataFrame:
    """Shapes that agree in their envelope, and in ``wkt`` if there is one, as blocks: these columns and ``rows``, an
    array of at most ``BLOCK`` structs of the other columns. A shape that more than ``GROUP`` rows have is dealt by
    their hash first. One count of the rows of each shape."""
    by = [c for c in shapes.columns if c in (*ENVELOPE, "wkt")]
    rows = shapes.select(*by, F.struct(*[c for c in shapes.columns if c not in by]).alias("row")).dropna(subset=list(ENVELOPE))
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    if (counts.agg(F.max("_n")).first()[0] or 0) > GROUP:
        same = [F.col(f"r.{c}").eqNullSafe(F.col(f"n.{c}")) for c in by]
        many = counts.where(F.col("_n") > GROUP).alias("n")
        deal = F.when(F.col("_n").isNotNull(), F.pmod(F.xxhash64("row"), F.ceil(F.col("_n") / GROUP))).otherwise(0)
        rows = rows.alias("r").join(many, same, "left").select("r.*", deal.alias("_deal"))
    else:
        rows = rows.withColumn("_deal", F.lit(0))
    groups = rows.groupBy(*by, "_deal").agg(F.collect_list("row").alias("rows"))
    starts = F.sequence(F.lit(1), F.size("rows"), F.lit(BLOCK))
    return groups.select(*by, "rows", F.explode(starts).alias("_start")).select(*by, F.slice("rows", F.col("_start"), BLOCK).alias("rows"))


def spread(df: DataFrame) -> DataFrame:
    """Deals few, costly rows over all tasks; the adaptive planner would merge them by their bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def block_join(a: DataFrame, b: DataFrame, size: float | None = None) -> DataFrame:
    """As ``grid_join``, but a row is a pair of blocks: ``a_rows`` and ``b_rows`` beside the bounds (and ``a_wkt``,
    ``b_wkt``), dealt over all tasks. Reports go on these; ``expand`` makes the pairs."""
    return spread(grid_join(blocks(a), blocks(b), size or cell_size(a, b)))


def expand(pairs: DataFrame) -> DataFrame:
    """The pairs of a block join's rows: structs ``a`` and ``b`` in place of the arrays. Nothing is shuffled, and a task
    holds the pairs of one row of ``a`` at a time: generated code would first make all of a pair of blocks and keep
    them, so the outer array is read through a function that Spark interprets."""
    rest = [c for c in pairs.columns if c not in ("a_rows", "b_rows")]
    outer = F.explode(F.transform("a_rows", lambda row: row)).alias("a")
    return pairs.select(*rest, "b_rows", outer).select(*rest, "a", F.explode("b_rows").alias("b"))


def intersecting(shapes: DataFrame, box: tuple[float, float, float, float], buffer: float = 0.0) -> DataFrame:
    """Shapes whose envelope meets the box grown by the buffer (in the units of the coordinates)."""
    return shapes.where(Box.of().intersects(Box.lit(*box).grown(buffer)))


def contributions(groups: DataFrame) -> DataFrame:
    """For groups of rectangles that tile a whole: each part's equality with the group's
    envelope, and the envelope's area. Rows: ``group_id, object_id`` and the bounds."""
    whole = groups.groupBy("group_id").agg(F.min("xmin").alias("u_xmin"), F.min("ymin").alias("u_ymin"), F.max("xmax").alias("u_xmax"), F.max("ymax").alias("u_ymax"))
    u, p = Box.of("u_"), Box.of()
    return groups.join(whole, "group_id").select("group_id", "object_id", equality(u, p).alias("contribution"), u.area.alias("union_area"))


def membership_weight(collection_box: Box, box: Box) -> Column:
    """Weight of an object in a collection: common area over the larger; 0 means no member."""
    return equality(collection_box, box)


def folded_intersection(groups: DataFrame, key: str) -> DataFrame:
    """The common area of all rectangles of a group: bounds, area and perimeter (0 if nothing is common)."""
    g = groups.groupBy(key).agg(F.max("xmin").alias("xmin"), F.max("ymin").alias("ymin"), F.min("xmax").alias("xmax"), F.min("ymax").alias("ymax"))
    w, h = F.greatest(F.lit(0), F.col("xmax") - F.col("xmin")), F.greatest(F.lit(0), F.col("ymax") - F.col("ymin"))
    some = (w > 0) & (h > 0)
    return g.select(key, F.when(some, w * h).otherwise(0).alias("common_area"), F.when(some, 2 * (w + h)).otherwise(0).alias("common_perimeter"))


def spatio_temporal_relations(shapes: DataFrame, buffer: float, threshold: float, size: float | None = None) -> DataFrame:
    """All pairs of one class in a single pass: spatial report and temporal relation, for pairs that
    lie within the buffer and have a spatial relation. Rows of ``shapes``: object_id, bounds, exists_from, exists_to."""
    from ..functions.temporal import Span, relation

    near = shapes.withColumns({"xmin": F.col("xmin") - buffer, "ymin": F.col("ymin") - buffer, "xmax": F.col("xmax") + buffer, "ymax": F.col("ymax") + buffer})
    a = Box(F.col("a_xmin") + buffer, F.col("a_ymin") + buffer, F.col("a_xmax") - buffer, F.col("a_ymax") - buffer)
    pairs = block_join(near, shapes, size).select("a_rows", "b_rows", compare(a, Box.of("b_"), threshold).alias("r"))
    pairs = pairs.where(F.col("r.relation").isNotNull() | F.col("r.equality").isNotNull()).select("a_rows", "b_rows", "r.*")
    temporal = relation(Span(F.col("a.exists_from"), F.col("a.exists_to")), Span(F.col("b.exists_from"), F.col("b.exists_to")))
    return (
        expand(pairs)
        .where(F.col("a.object_id") != F.col("b.object_id"))
        .select(F.col("a.object_id").alias("a"), F.col("b.object_id").alias("b"), "equality", "relation", "overlap", "overlap_wkt", temporal.alias("temporal"))
    )


def change_metric(rows: DataFrame, key: str, order: str, ratio: str) -> DataFrame:
    """The running recurrence d = (d + ratio) / n over a group's rows in order."""
    listed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, ratio))).alias("r"))
    step = F.aggregate(
        "r",
        F.struct(F.lit(0.0).alias("d"), F.lit(0).alias("n")),
        lambda s, x: F.struct(((s["d"] + x[ratio]) / (s["n"] + 1)).alias("d"), (s["n"] + 1).alias("n")),
        lambda s: s["d"],
    )
    return listed.select(key, step.alias("change"))
