from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessera.functions.identifiers import choose_language, normal_id, with_crs
from tessera.operators import collections, graph, objects, relations
from tessera.plans import pipelines
from tessera.schema import TABLES


def test_nested_objects(spark):
    parents = spark.createDataFrame([("p", "P"), ("q", "Q")], "object_id string, name string")
    children = spark.createDataFrame([("a", 1), ("b", 2)], "object_id string, n int")
    edges = spark.createDataFrame([("p", "CONTAINS", "b"), ("p", "CONTAINS", "a"), ("q", "MEETS", "a")], TABLES["relations"])
    got = {r.object_id: r.parts for r in objects.with_linked(parents, edges, children, "CONTAINS", "parts").collect()}
    assert [c.object_id for c in got["p"]] == ["a", "b"] and got["q"] is None


def test_statements(spark):
    e = spark.createDataFrame([("p", "CONTAINS", "b")], TABLES["relations"])
    o = spark.createDataFrame([("p", "T", None, None, None)], TABLES["objects"])
    f = spark.createDataFrame([], TABLES["facts"])
    t = objects.triples(o, f, e)
    assert objects.contains_resource(t, "p") and not objects.contains_resource(t, "x")
    assert objects.match(t, predicate="type").count() == 1 and objects.match(t, "p", object_="b").count() == 1
    sub = spark.createDataFrame([("T", "Dataset")], TABLES["datasets"])
    assert objects.instances(o, "Dataset", sub).first().object_id == "p"


def test_temporal_properties(spark):
    p = spark.createDataFrame([("valid_from",), ("name",)], "property string")
    h = spark.createDataFrame([("valid_from", "Temporal_Property")], "property string, ancestor string")
    assert objects.temporal_properties(p, h, True).first().property == "valid_from"
    assert objects.temporal_properties(p, h, False).first().property == "name"


def test_events(spark):
    o = spark.createDataFrame([("a", "T", datetime(2000, 1, 1), datetime(2001, 1, 1), None), ("b", "T", None, None, datetime(2000, 5, 1)), ("c", "T", datetime(2000, 1, 1), None, None)], TABLES["objects"])
    ev = objects.lifecycle_events(o)
    assert {(r.object_id, r.event_type) for r in ev.collect()} == {("a", "CREATED"), ("a", "DESTROYED"), ("b", "CREATED"), ("b", "DESTROYED"), ("c", "CREATED")}
    moved = o.withColumn("exists_from", F.lit("1999-01-01").cast("timestamp_ntz"))
    assert {r["at"].year for r in relations.adjust_events(ev, moved).where("event_type = 'CREATED'").collect()} == {1999}
    with pytest.raises(ValueError, match="CREATED"):
        relations.add_event(ev, ev.withColumn("event_type", F.lit("SPLIT")))
    bad = spark.createDataFrame([("SPLIT", "c", "a", 1.0)], "event_type string, subject string, component string, strength double")
    assert relations.undated_changes(o, bad).count() == 1


def test_collections(spark):
    m = spark.createDataFrame([("c", "a", "SPATIAL", 0.5), ("c", "b", "SPATIAL", 0.5), ("c", "d", "SPATIAL", 0.9), ("e", "a", "TEMPORAL", 0.1)], TABLES["collection_members"])
    assert {r.collection_id: r.members for r in collections.related(m, "a", 0.3).collect()} == {"c": ["a", "b"]}
    k = spark.createDataFrame([("a", "T"), ("b", "T"), ("d", "U")], "object_id string, class string")
    assert {(r.subject, r.object) for r in relations.concept_relations(m, k, 0.3).collect()} == {("a", "b"), ("b", "a")}
    with pytest.raises(ValueError, match="relation types"):
        collections.add(m, m.withColumn("relation_type", F.lit("OTHER")))
    assert collections.with_ids(m).where("object_id = 'd'").first().relation_id == "relation:c:d"
    e = spark.createDataFrame([("a", "SPATIAL_MEETS", "z")], TABLES["relations"])
    more = m.unionByName(spark.createDataFrame([("f", "z", "SPATIAL", 0.8)], TABLES["collection_members"]))
    assert collections.are_adjacent(more, e, "c", "f", 0.3) and not collections.are_adjacent(more, e, "e", "f", 0.3)


def test_graph(spark):
    rows = [("a", "b", 1.0), ("b", "c", 5.0), ("a", "c", 2.0), ("c", "b", 4.0), ("x", "y", 3.0), ("x", "x", 9.0)]
    e = spark.createDataFrame(rows, "from string, to string, weight double")
    assert {tuple(r) for r in graph.undirected(e).collect()} == {("a", "b", 1.0), ("b", "c", 4.0), ("a", "c", 2.0), ("x", "y", 3.0)}
    assert {tuple(r) for r in graph.spanning_forest(e).collect()} == {("a", "b", 1.0), ("a", "c", 2.0), ("x", "y", 3.0)}
    start = spark.createDataFrame([("b",)], "node string")
    assert {(r["from"], r["to"]) for r in graph.neighbourhood(graph.undirected(e), start, 1).collect()} == {("a", "b"), ("b", "c")}
    assert [r["to"] for r in graph.ranked_edges(e).where("`from` = 'a' and rank = 1").collect()] == ["b"]


def test_sizes_and_text(spark):
    df = spark.createDataFrame([("g", "POLYGON ((0 0, 1 0, 1 1, 0 1, 0 0))"), ("g", "POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))")], "k string, wkt string")
    r = pipelines.size_distribution(df, "k", "wkt").first()
    assert r.n == 2 and r.largest == pytest.approx(4 * r.least, rel=1e-3)
    one = spark.range(1)
    assert one.select(with_crs(F.lit("POINT (1 2)"), 4326).alias("x")).first().x.startswith("<http://www.opengis.net/def/crs/EPSG/0/4326> ")
    assert one.select(choose_language(F.lit(""), "en").alias("x")).first().x == "en"
    assert one.select(normal_id(F.lit(" a  b ")).alias("x")).first().x == "a_b"
    assert one.select(pipelines.out_of_range(F.lit("POLYGON ((200 1, 2 2))")).alias("x")).first().x
