import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessera.geometry import polygon as g
from tessera.geometry import udfs
from tessera.operators import union
from tessera.operators.equivalence import Change, MixedDirections, traverse

SQUARE = "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))"
HOLED = "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 1 3, 3 3, 3 1, 1 1))"
TWO = "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 1, 0 0)), ((5 5, 7 5, 7 7, 5 7, 5 5), (5.5 5.5, 6 5.5, 6 6, 5.5 6, 5.5 5.5)))"


def test_wkt_round_trip():
    for w in (SQUARE, HOLED, TWO, "POINT (1 2)", "LINESTRING (0 0, 1 1)", "MULTIPOINT ((1 2), (3 4))", "POLYGON EMPTY"):
        assert g.write(g.parse(w)) == w
    assert g.parse("<http://www.opengis.net/def/crs/EPSG/0/4269> POINT (1 2)").srid == 4269
    with pytest.raises(g.GeometryError):
        g.parse("CIRCLE (0 0, 3)")


def test_areas():
    a = lambda w: g.area(g.parse(w))
    assert (a(SQUARE), a(HOLED), a(TWO), a("POINT (1 2)")) == (16, 12, 4.75, 0)
    c = lambda x, y: g.common_area(g.parse(x), g.parse(y))
    assert c(SQUARE, HOLED) == pytest.approx(12)
    assert c(SQUARE, "POLYGON ((2 2, 6 2, 6 6, 2 6, 2 2))") == pytest.approx(4)
    assert c(HOLED, "POLYGON ((1 1, 3 1, 3 3, 1 3, 1 1))") == pytest.approx(0)
    assert c(SQUARE, "POLYGON ((2 -2, 6 2, 2 6, -2 2, 2 -2))") == pytest.approx(16)
    assert g.union_area([g.parse(SQUARE), g.parse("POLYGON ((2 2, 6 2, 6 6, 2 6, 2 2))")]) == pytest.approx(28)
    assert g.folded_common_area([g.parse(SQUARE)] * 3) == pytest.approx(16)
    assert g.centroid(g.parse(HOLED)) == pytest.approx((2, 2))


def test_areas_against_a_grid():
    rng = random.Random(2)

    def box():
        x, y, w, h = rng.randint(0, 10), rng.randint(0, 10), rng.randint(1, 6), rng.randint(1, 6)
        cells = {(i, j) for i in range(x, x + w) for j in range(y, y + h)}
        return cells, g.parse(f"POLYGON (({x} {y}, {x + w} {y}, {x + w} {y + h}, {x} {y + h}, {x} {y}))")

    for _ in range(30):
        (ca, a), (cb, b), (cc, c) = box(), box(), box()
        assert g.common_area(a, b) == pytest.approx(len(ca & cb))
        assert g.union_area([a, b, c]) == pytest.approx(len(ca | cb | cc))
        assert g.unions_common_area([a, b], [c]) == pytest.approx(len((ca | cb) & cc))
        assert 0 <= g.equality(a, b) <= 1 and g.equality(a, b) == pytest.approx(g.equality(b, a))


def test_predicates():
    p = g.parse
    inner, beside, apart = p("POLYGON ((1 1, 2 1, 2 2, 1 2, 1 1))"), p("POLYGON ((4 0, 6 0, 6 4, 4 4, 4 0))"), p("POLYGON ((9 9, 10 9, 10 10, 9 9))")
    assert g.covers(p(SQUARE), inner) and not g.covers(inner, p(SQUARE))
    assert g.touches(p(SQUARE), beside) and not g.touches(p(SQUARE), inner)
    assert g.disjoint(p(SQUARE), apart) and g.intersects(p(SQUARE), inner)
    assert g.disjoint(p(HOLED), p("POLYGON ((1.5 1.5, 2 1.5, 2 2, 1.5 1.5))"))
    assert g.intersects(p("POINT (4 2)"), p(SQUARE)) and not g.intersects(p("POINT (5 2)"), p(SQUARE))
    assert g.intersects(p("LINESTRING (-1 2, 5 2)"), p(SQUARE))
    assert g.within_distance(p("POINT (6 2)"), p(SQUARE), 2.5) and not g.within_distance(p("POINT (7 2)"), p(SQUARE), 2.5)


def test_projection_simplification():
    m = g.reproject(g.parse("POINT (-122.3 47.6)"), 3857)
    import math

    assert m.rings[0][0] == pytest.approx((math.radians(-122.3) * 6378137, math.asinh(math.tan(math.radians(47.6))) * 6378137))
    assert g.reproject(m, 4326).rings[0][0] == pytest.approx((-122.3, 47.6))
    with pytest.raises(g.GeometryError):
        g.reproject(m, 2285)
    ring = [(math.cos(k / 500 * math.tau) * 10, math.sin(k / 500 * math.tau) * 10) for k in range(500)]
    text = g.write(g.Shape("POLYGON", [[[*ring, ring[0]]]]))
    short = g.simplify(text)
    assert len(short) < 3000 < len(text) and g.equality(g.parse(text), g.parse(short)) > 0.98
    assert g.simplify(SQUARE) == SQUARE
    assert g.area_km2(g.parse("POLYGON ((0 0, 1 0, 1 1, 0 1, 0 0))")) == pytest.approx(12364, rel=1e-3)


def test_udfs(spark):
    rows = [("a", SQUARE, "POLYGON ((2 2, 6 2, 6 6, 2 6, 2 2))"), ("b", SQUARE, "POLYGON ((4 0, 6 0, 6 4, 4 4, 4 0))"), ("c", SQUARE, HOLED), ("d", SQUARE, "POLYGON ((9 9, 10 9, 10 10, 9 9))")]
    df = spark.createDataFrame(rows, "k string, a string, b string")
    got = {r.k: r for r in df.select("k", udfs.comparison(0.7)(F.col("a"), F.col("b")).alias("r"), udfs.containment(0.9)(F.col("a"), F.col("b")).alias("c")).collect()}
    assert got["a"].r.relation == "SPATIAL_OVERLAPS" and got["a"].r.overlap == pytest.approx(0.25) and got["a"].r.equality is None
    assert got["b"].r.relation == "SPATIAL_MEETS" and got["b"].r.overlap is None
    assert got["c"].r.relation == "COVERS" and got["c"].r.equality == pytest.approx(0.75) and got["c"].c == "CONTAINS"
    assert got["d"].r.relation is None and got["d"].c == "NONE"
    shaped = udfs.with_envelope(df.select("k", F.col("b").alias("wkt")), "wkt")
    assert {r.k for r in udfs.intersecting(shaped, "wkt", "POINT (5 3)").collect()} == {"a", "b"}
    assert {r.k for r in udfs.intersecting(shaped, "wkt", "POINT (7 3)", 1.5).collect()} == {"a", "b"}


def parts_of(n, lack=()):
    """A strip in n parts, without some."""
    return [(f"part{i}", f"POLYGON (({i} 0, {i + 1} 0, {i + 1} 2, {i} 2, {i} 0))") for i in range(n) if i not in lack]


@pytest.mark.parametrize(("lack", "want"), [((), "MERGED"), ((4,), None)])
def test_union_merge(spark, lack, want):
    rows = [("g", o, w, datetime(2000, 1, 1), datetime(2001, 1, 1)) for o, w in parts_of(5, lack)]
    rows.append(("g", "whole", "POLYGON ((0 0, 5 0, 5 2, 0 2, 0 0))", datetime(2001, 1, 1), datetime(2002, 1, 1)))
    df = spark.createDataFrame(rows, "group_id string, object_id string, wkt string, exists_from timestamp_ntz, exists_to timestamp_ntz")
    got = union.spatial_unions(df, 0.9).collect()
    if want is None:
        assert got == []
    else:
        assert (got[0].direction, got[0].union_object, len(got[0].early)) == (want, "whole", 5) and got[0].strength > 0.99
    back = df.withColumns({"exists_from": F.when(F.col("object_id") == "whole", F.lit("1999-01-01").cast("timestamp_ntz")).otherwise(F.col("exists_from")), "exists_to": F.when(F.col("object_id") == "whole", F.lit("2000-01-01").cast("timestamp_ntz")).otherwise(F.col("exists_to"))})
    assert [r.direction for r in union.spatial_unions(back, 0.9).collect()] == (["SPLIT"] if want else [])
    total = {r.object_id: r.contribution for r in union.contributions(df.where("object_id <> 'whole'")).collect()}
    assert sum(total.values()) == pytest.approx(1)


def test_union_subsets_and_errors():
    t = lambda y: datetime(y, 1, 1)
    import pandas as pd

    c = lambda o, w, a: union.Candidate(o, pd.Timestamp(t(a)), pd.Timestamp(t(a + 1)), g.parse(w))
    whole = c("w", "POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))", 2001)
    parts = [c(o, w, 2000) for o, w in parts_of(3)]
    assert union.match([whole, *parts], 0.9) is None
    assert union.match([whole, *parts], 0.9, exhaustive=True)[2] == ["part0", "part1"]
    same = [c("a", SQUARE, 2000), c("b", SQUARE, 2001)]
    assert union.match(same, 0.9)[0] == "UNKNOWN"
    with pytest.raises(g.GeometryError):
        union.match(same, 0.9, strict=True)
    with pytest.raises(union.OpenLifetime):
        union.match([union.Candidate("x", pd.Timestamp(t(2000)), pd.NaT, g.parse(SQUARE))], 0.9)


Y = {n: datetime(n, 1, 1) for n in range(2012, 2020)}
LIVES = {"1": (Y[2012], Y[2013]), "2": (Y[2013], Y[2014]), "3": (Y[2013], Y[2017]), "4": (Y[2013], Y[2018]), "5": (Y[2013], Y[2016]), "6": (Y[2013], Y[2016]), "7": (Y[2014], Y[2018]), "8": (Y[2014], Y[2018]), "9": (Y[2016], Y[2018])}
CHANGES = [Change("a", "SPLIT", "1", frozenset("23456")), Change("b", "MERGED", "9", frozenset("56")), Change("c", "SPLIT", "2", frozenset("78"))]


@pytest.mark.parametrize(
    ("ids", "year", "want"),
    [
        ("1", 2013, "23456"), ("2", 2015, "78"), ("1", 2014, "345678"), ("1", 2015, "345678"), ("1", 2016, "34789"), ("56", 2016, "9"), ("5", 2016, ""), ("1", 2017, ""),
        ("3", 2013, "3"), ("23456", 2012, "1"), ("2356", 2012, ""), ("9", 2014, "56"), ("78349", 2013, "23456"), ("78349", 2012, "1"), ("78", 2013, "2"), ("7", 2013, ""),
    ],
)
def test_equivalence(ids, year, want):
    assert traverse(LIVES, CHANGES, [], ids, datetime(year, 3, 11)) == set(want)


def test_equivalence_over_equals_and_mixed():
    with pytest.raises(MixedDirections):
        traverse(LIVES, CHANGES, [], "29", datetime(2014, 3, 11))
    lives = {"a": (Y[2012], Y[2013]), "b": (Y[2013], Y[2014])}
    assert traverse(lives, [], [("a", "b")], ["a"], datetime(2013, 5, 1)) == {"b"}
