"""Common shapes of any polygons, and what exports can't hold."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.geometry import polygon as g
from tessera.geometry import udfs
from tessera.operators import relations
from tessera.schema import TABLES
from tessera.sources import shapefile, sinks

L = "POLYGON ((0 0, 3 0, 3 1, 1 1, 1 3, 0 3, 0 0))"
L2 = "POLYGON ((3 3, 0 3, 0 2, 2 2, 2 0, 3 0, 3 3))"
HOLED = "POLYGON ((0 0, 6 0, 6 6, 0 6, 0 0), (2 2, 2 4, 4 4, 4 2, 2 2))"
TWO = "MULTIPOLYGON (((-1 1, 7 1, 7 3, -1 3, -1 1)), ((1 5, 5 5, 3 9, 1 5)))"


@pytest.mark.parametrize(("a", "b"), [(L, L2), (L, L), (HOLED, TWO), (TWO, HOLED), (HOLED, HOLED), (HOLED, "POLYGON ((1 1, 5 1, 5 5, 1 5, 1 1))"), (L, "POLYGON ((0 0, 4 1, 1 4, 0 0))")])
def test_common_shape(a, b):
    p, q = g.parse(a), g.parse(b)
    shape = g.intersection_shape(p, q)
    assert g.area(shape) == pytest.approx(g.common_area(p, q)) and g.common_area(p, q) > 0
    again = g.parse(g.write(shape))
    assert g.covers(p, again) and g.covers(q, again)


def test_random_common_shapes():
    rng = random.Random(6)

    def star():
        import math

        x, y, n = rng.uniform(0, 4), rng.uniform(0, 4), rng.randint(3, 9)
        ring = [(x + rng.uniform(0.5, 3) * math.cos(2 * math.pi * k / n), y + rng.uniform(0.5, 3) * math.sin(2 * math.pi * k / n)) for k in range(n)]
        return g.Shape("POLYGON", [[[*ring, ring[0]]]])

    for _ in range(60):
        a, b = star(), star()
        shape = g.intersection_shape(a, b)
        assert (0 if shape is None else g.area(shape)) == pytest.approx(g.common_area(a, b), abs=1e-6)


def test_stored_overlap_of_concave_shapes(spark):
    pairs = spark.createDataFrame([("x", "y", L, L2)], "a string, b string, a_wkt string, b_wkt string")
    report = pairs.withColumn("r", udfs.comparison(0.9)(F.col("a_wkt"), F.col("b_wkt"))).select("a", "b", "r.*")
    stored = relations.add_overlaps(spark.createDataFrame([], TABLES["overlaps"]), report).first()
    assert (stored.a, stored.b, stored.pct) == ("x", "y", pytest.approx(2 / 5)) and g.area(g.parse(stored.wkt)) == pytest.approx(2)


def test_shapefile_limits_raise():
    row = {"id": 1, "wkt": L}
    assert shapefile.shapefile_zip([row], "id", "wkt")
    for more in ({"v": "é" * 128}, {"population_a": 1}, {"a b": 1, "a-b": 2}):
        with pytest.raises(g.GeometryError):
            shapefile.shapefile_zip([row | more], "id", "wkt")


def test_long_ids_stay_whole(spark):
    import json

    out = spark.range(1).select(sinks.feature(F.concat(F.lit('q"]'), F.repeat(F.lit("x"), 1_100_000)), None, {}).alias("v")).first().v
    assert json.loads(out)["id"] == 'q"]' + "x" * 1_100_000


def test_convex_pairs_at_once():
    import math

    rng = random.Random(9)

    def convex():
        x, y, r, n = rng.uniform(0, 5), rng.uniform(0, 5), rng.uniform(0.2, 3), rng.randint(3, 8)
        return [(x + r * math.cos(t), y + r * math.sin(t)) for t in sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))]

    box = lambda a, b, c, d: [(a, b), (c, b), (c, d), (a, d)]
    a = [convex() for _ in range(300)] + [box(0, 0, 2, 2), box(0, 0, 2, 2), box(0, 0, 2, 2), box(0, 0, 4, 4)]
    b = [convex() for _ in range(300)] + [box(2, 0, 3, 2), box(0, 0, 2, 2), box(5, 5, 6, 6), box(1, 1, 2, 2)]
    got = g.convex_common_areas(a, b)
    want = [abs(g._shoelace(g._clip(p, q))) for p, q in zip(a, b, strict=True)]
    assert got.tolist() == pytest.approx(want, abs=1e-9)
    assert got[-4:].tolist() == [0, 4, 0, 1]
