"""Sources, sinks, the facade and streaming."""

import json
import zipfile
from datetime import datetime
from io import BytesIO

import pytest
from pyspark.sql import functions as F

from tessera.operators import index, merge, metrics, relations
from tessera.plans import pipelines
from tessera.schema import TABLES, DatasetSchema, Fact, RegistrationError, TypeCodecs, typed
from tessera.session import Tessera
from tessera.sources import readers, shapefile, sinks
from tessera.streaming.ingest import ingest, windowed_counts

SQUARE = "POLYGON ((0 0, 0 4, 4 4, 4 0, 0 0))"
SCHEMA = DatasetSchema("Tract", "id", (Fact("name", language="en"), Fact("people", "population")), spatial="wkt", start="since", duration="1 YEAR")


def tracts(spark, year=2000, people=10):
    rows = [("t1", "One", people, SQUARE, f"{year}-01-01"), ("t2", "Two", 20, "POLYGON ((4 0, 4 4, 8 4, 8 0, 4 0))", f"{year}-01-01")]
    return spark.createDataFrame(rows, "id string, name string, people int, wkt string, since string").withColumn("since", F.to_date("since"))


def test_schema_rules(spark):
    df = tracts(spark)
    SCHEMA.validate(df.columns)
    for bad in (
        DatasetSchema("x", "none", start="since"),
        DatasetSchema("x", "id"),
        DatasetSchema("x", "id", (Fact("id"),), start="since"),
        DatasetSchema("x", "id", (Fact("name", language="english!"),), start="since"),
        DatasetSchema("x", "id", (Fact("name", datatype="xsd:what"),), start="since"),
        DatasetSchema("x", "id", start="since", end="since", duration="1 YEAR"),
    ):
        with pytest.raises(RegistrationError):
            bad.validate(df.columns)
    one = spark.range(1)
    assert one.select(typed(F.lit("7"), "xsd:byte").alias("x")).first().x == 7
    assert one.select(typed(F.lit("seven"), "xsd:int").alias("x")).first().x is None
    codecs = TypeCodecs()
    codecs.register("upper", F.upper, F.lower)
    assert one.select(codecs.decode("upper", codecs.encode("upper", F.lit("aB"))).alias("x")).first().x == "ab"


def test_facade(spark, tmp_path):
    t = Tessera(spark, f"file://{tmp_path}/store", strategy=merge.MergeStrategy.EXISTING, existence=merge.ExistenceStrategy.IGNORE)
    t.register(SCHEMA, tracts(spark))
    t.write("Tract", tracts(spark), "2000-06-01")
    assert {r.object_id for r in t.dataset_members("Tract").collect()} == {"t1", "t2"}
    assert [r["class"] for r in t.dataset_names().collect()] == ["Tract"]
    assert [r.property for r in t.dataset_properties("Tract").collect()] == ["asWKT", "name", "population"]
    got = {r.object_id: r.population for r in t.read("Tract", valid="2000-07-01", database="2001-01-01").collect()}
    assert got == {"t1": "10", "t2": "20"}
    assert t.read("Tract", valid="2005-07-01", database="2001-01-01").count() == 0
    t.write("Tract", tracts(spark, people=11), "2000-08-01")
    assert {r.population for r in t.read("Tract", ["t1"], "2000-07-01", "2000-09-01").collect()} == {"11"}
    assert {r.population for r in t.read("Tract", ["t1"], "2000-07-01", "2000-07-15").collect()} == {"10"}
    assert {r.object_id for r in t.intersect("Tract", "POINT (1 1)", valid="2000-07-01", database="2000-09-01").collect()} == {"t1"}
    assert t.intersect_objects("Tract", "POINT (5 1)", valid="2000-07-01", database="2000-09-01").first().name == "Two"
    assert {r.event_type for r in t.events.collect()} == {"CREATED", "DESTROYED"}
    assert t.fact_history(["t1"], "population").count() >= 2
    assert [r.object_id for r in t.search("t2").collect()] == ["t2"]
    assert t.sql("SELECT count(DISTINCT object_id) AS n FROM facts").first().n == 2
    out = json.loads(t.export("Tract", ["t1", "t2"], "GEOJSON", "2000-07-01", "2000-09-01"))
    assert len(out["features"]) == 2 and out["features"][0]["geometry"]["type"] == "Polygon"
    text = t.export("Tract", ["t1"], "KML", "2000-07-01", "2000-09-01")
    assert "<outerBoundaryIs>" in text and "<name>t1</name>" in text
    with zipfile.ZipFile(BytesIO(t.export("Tract", ["t1"], "KMZ", "2000-07-01", "2000-09-01"))) as z:
        assert z.namelist() == ["doc.kml"]
    with zipfile.ZipFile(BytesIO(t.export("Tract", None, "SHAPEFILE", "2000-07-01", "2000-09-01"))) as z:
        assert len(list(shapefile.read_shapes(z.read("export.shp")))) == 2
    with pytest.raises(sinks.UnsupportedFormat):
        t.export("Tract", None, "TOPOJSON")
    assert {(r.b, r.relation) for r in t.compare_ids("Tract", "t1", ["t2"], "2000-07-01").collect()} == {("t2", "SPATIAL_MEETS")}
    none, parts = t.union_of_ids("Tract", ["t1", "t2"], "2000-07-01")
    assert none.count() == 0 and {r.contribution for r in parts.collect()} == {0.5}
    t.relate_dataset("Tract", "2000-07-01")
    assert {(r.subject, r.relation) for r in t.relations.collect()} == {("t1", "SPATIAL_MEETS"), ("t2", "SPATIAL_MEETS"), ("t1", "EQUALS"), ("t2", "EQUALS")}
    t.relate(spark.createDataFrame([("t1", "SPATIAL_MEETS", "t2")], TABLES["relations"]))
    t.infer()
    assert t.relations.where("subject = 't2' and relation = 'SPATIAL_MEETS'").count() == 1
    t.add_changes(spark.createDataFrame([("SPLIT", "t1", "t2", 0.9)], "event_type string, subject string, component string, strength double"))
    assert t.event_components.count() == 1
    t.add_to_collection(spark.createDataFrame([("c", "t1", "SPATIAL", 0.5)], TABLES["collection_members"]))
    area = t.aggregate("Tract")
    assert area.first().area == pytest.approx(32)
    t.remove(spark.createDataFrame([("t1",)], "id string"))
    assert {r.object_id for r in t.objects.collect()} == {"t2"} and t.collection_members.count() == 0
    t.store.initialize()
    assert t.objects.count() == 0 and t.store.read("objects", 1).count() == 2


def test_shapefile_reader(spark, tmp_path):
    holed = "POLYGON ((0 0, 0 9, 9 9, 9 0, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))"
    data = shapefile.shapefile_zip([{"code": 7, "name": "é", "wkt": holed}, {"code": 8, "name": None, "wkt": "MULTIPOLYGON (((0 0, 0 1, 1 1, 0 0)), ((5 5, 5 6, 6 6, 5 5)))"}], "code", "wkt")
    (tmp_path / "1999").mkdir()
    with zipfile.ZipFile(BytesIO(data)) as z:
        z.extractall(tmp_path / "1999")
    rows = shapefile.read(spark, f"file://{tmp_path}", {"code": "int", "name": "string"}, r"/(\d{4})/").orderBy("code").collect()
    assert [(r.code, r.name, r.year) for r in rows] == [(7, "é", 1999), (8, None, 1999)]
    assert rows[0].wkt == holed and rows[1].wkt.startswith("MULTIPOLYGON")


def test_text_readers(spark, tmp_path):
    (tmp_path / "p.csv").write_text(f"1;{SQUARE}\n2;POINT (1 2)\n")
    assert readers.polygons(spark, f"file://{tmp_path}/p.csv").count() == 2
    (tmp_path / "o.csv").write_text('code;name;start;end;wkt\n5;"A";2000-01-01;2001-01-01;POINT (1 2)\n')
    assert [r.code for r in readers.object_rows(spark, f"file://{tmp_path}/o.csv").collect()] == [5]
    (tmp_path / "c.csv").write_text("County Name,,Confirmed,,,,,,Updated,State,County\nKing,,12,,,,,,2020-03-01 10:00 UTC,53,33\nUnknown,,4,,,,,,2020-03-01 10:00 UTC,53,NA\n")
    got = pipelines.case_counts(readers.case_rows(spark, f"file://{tmp_path}/c.csv")).collect()
    assert {(r.geoid, r.level, r.confirmed) for r in got} == {("53033", "county", 12), ("53", "state", 4)}
    assert got[0]["at"] == datetime(2020, 3, 1, 10)


def test_jdbc_by_year(spark):
    url = "jdbc:derby:memory:shapes;create=true"
    for year in (2000, 2001):
        spark.createDataFrame([(1, f"s{year}")], "id int, wkt string").write.format("jdbc").options(url=url, dbtable=f"shapes{year}", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver").mode("overwrite").save()
    out = readers.jdbc_by_year(spark, url, "SELECT * FROM <shapetable>", {2000: "shapes2000", 2001: "shapes2001"}, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    assert {(r.wkt, r.year) for r in out.collect()} == {("s2000", 2000), ("s2001", 2001)}


def test_pipelines(spark):
    shapes = spark.createDataFrame([("53", "33", SQUARE)], "statefp string, countyfp string, wkt string")
    population = spark.createDataFrame([("053", "033", "50", "4", "9", 5), ("053", "000", "40", "4", "9", 9)], "state string, county string, sumlev string, region string, division string, pop int")
    r = pipelines.counties(shapes, population).collect()
    assert [(x.region, x.division, x.geoid, x["pop"]) for x in r] == [("West", "Pacific", "53033", 5)]
    z = spark.createDataFrame([("z", 1, SQUARE), ("z", 2, "POLYGON ((0 0, 0 4, 2 4, 2 0, 0 0))"), ("z", 3, SQUARE)], "zone string, year int, wkt string")
    assert pipelines.zone_change(z, "zone", "year").first().change == pytest.approx((0.5 + 0) / 2)
    nodes = spark.createDataFrame([(f"n{i}", v) for i, v in enumerate([1, 2, 3, 50, 51])], "object_id string, v int")
    edges = spark.createDataFrame([(f"n{i}", "SPATIAL_MEETS", f"n{i + 1}") for i in range(4)], TABLES["relations"])
    groups = {x.node: x.region for x in pipelines.regionalize(edges, nodes, "v", 2).collect()}
    assert groups["n0"] == groups["n2"] != groups["n3"] == groups["n4"]
    rows = [(f"r{i}", 1, y, w, datetime(y, 1, 1), datetime(y + 1, 1, 1)) for i, (y, w) in enumerate([(2000, SQUARE), (2001, SQUARE), (2002, "POLYGON ((0 0, 0 4, 2 4, 2 0, 0 0))")])]
    df = spark.createDataFrame(rows, "object_id string, code int, year int, wkt string, exists_from timestamp_ntz, exists_to timestamp_ntz")
    out = pipelines.integrate_regions(df, spark.createDataFrame([("c", "r0", "SPATIAL", 0.9)], TABLES["collection_members"]))
    assert {x.object_id for x in out["versions"].collect()} == {"r0", "r2"}
    assert {(x.object_id, x.strength) for x in out["members"].collect()} == {("r2", 0.5)}
    assert {(x.a, x.b, x.relation) for x in out["relations"].collect()} == {("r0", "r2", "COVERS"), ("r2", "r0", "SPATIAL_OVERLAPS")}


def test_metrics_and_index(spark):
    m = spark.createDataFrame([(1, "a"), (2, "b")], TABLES["metrics"])
    gauges = spark.createDataFrame([(1, datetime(2000, 1, 1, 0, k), float(k)) for k in range(10)], TABLES["gauges"])
    counters = spark.createDataFrame([(2, datetime(2000, 1, 1), 7)], TABLES["counters"])
    s = metrics.series(m, gauges, counters)
    assert s.count() == 11 and metrics.export(s, ["a"], F.lit("2000-01-01 00:05:00").cast("timestamp_ntz")).count() == 5
    assert {r.metric: r["median"] for r in metrics.decompose(s).collect()} == {"a": 4.0, "b": 7.0}  # a sketch gives values that occur
    d = {r.metric: r for r in metrics.decompose(s, accuracy=None).collect()}
    assert (d["a"].n, d["a"]["median"], d["b"]["largest"]) == (10, 4.5, 7.0)
    r = {x.metric: x.rate_5m for x in metrics.rates(s, F.lit("2000-01-01 00:10:00").cast("timestamp_ntz")).collect()}
    assert r["a"] == pytest.approx(4 / 300)
    i = spark.createDataFrame([], "key string, start long, end long, value string")
    i = index.insert(i, spark.createDataFrame([("k", 0, 5, "x"), ("k", 5, None, "y"), ("p", 3, 3, "z")], "key string, start long, end long, value string"))
    get = lambda k, at: [r.value for r in index.get(i, k, at).collect()]
    assert (get("k", 4), get("k", 5), get("p", 3), get("p", 4)) == (["x"], ["y"], ["z"], [])
    with pytest.raises(ValueError, match="negative"):
        index.insert(i, spark.createDataFrame([("k", -1, 2, "x")], "key string, start long, end long, value string"))
    assert [r.value for r in index.get(index.update(i, "k", 2, "w"), "k", 1).collect()] == ["w"]
    assert index.delete(i, "k", 2).count() == 2 and index.delete_value(i, "y").count() == 2
    assert index.get(index.set_range(i, "k", 2, 1, 3), "k", 4).count() == 0
    assert index.rebuild(i, 2).count() == 3 and index.statistics(i).count() == 2


def test_closure_is_idempotent(spark):
    e = spark.createDataFrame([("a", "CONTAINS", "b"), ("b", "CONTAINS", "c"), ("x", "BEFORE", "y"), ("y", "DURING", "z")], TABLES["relations"])
    once = relations.closure(e)
    assert {tuple(r) for r in relations.closure(once).collect()} == {tuple(r) for r in once.collect()}
    got = {tuple(r) for r in once.collect()}
    assert {("a", "CONTAINS", "c"), ("c", "INSIDE", "a"), ("x", "BEFORE", "z"), ("z", "AFTER", "x")} <= got
    assert ("z", "DURING", "y") not in got
    assert relations.violations(spark.createDataFrame([("a", "BEGINS", "b"), ("b", "BEGINS", "a")], TABLES["relations"])).count() == 2


def test_streaming(spark, tmp_path):
    def fact(o, v, day):
        return (o, "p", v, "xsd:string", None, datetime(2000, 1, day), None, None, None, None)

    src = f"{tmp_path}/in"
    spark.createDataFrame([fact("a", "1", 1), fact("a", "2", 5), fact("b", "1", 1)], TABLES["facts"]).write.parquet(src)
    store = readers.Store(spark, f"file://{tmp_path}/store")
    stream = lambda: spark.readStream.schema(TABLES["facts"]).parquet(src)
    at = F.lit("2000-02-01").cast("timestamp_ntz")
    ingest(stream(), store, f"{tmp_path}/ck", database=at).awaitTermination(120)
    first = {(r.object_id, r.value, r.valid_from.day, r.valid_to) for r in store.read("facts").where("db_to is null").collect()}
    assert first == {("a", "1", 1, datetime(2000, 1, 5)), ("a", "2", 5, None), ("b", "1", 1, None)}
    version = store.version("facts")
    ingest(stream(), store, f"{tmp_path}/ck", database=at).awaitTermination(120)
    assert store.version("facts") == version
    spark.createDataFrame([(datetime(2000, 1, 1, 0, 1), "x"), (datetime(2000, 1, 1, 0, 2), "x")], "at timestamp, event_type string").write.parquet(f"{tmp_path}/ev")
    ev = spark.readStream.schema("at timestamp, event_type string").parquet(f"{tmp_path}/ev")
    q = windowed_counts(ev).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/w").start()
    q.awaitTermination(120)
    assert [r.n for r in spark.sql("select n from w").collect()] == [2]


def test_lines(spark, tmp_path):
    f = spark.createDataFrame([("a", "p", 'say "x"\n', "xsd:string", "en", None, None, None, None, None)], TABLES["facts"])
    line = sinks.ntriples(f, spark.createDataFrame([], TABLES["relations"])).first().line
    assert line == '<urn:a> <urn:p> "say \\"x\\"\\n"@en .'
    rows = spark.createDataFrame([("c", "n", 5, "2000-01-01", "2001-01-01")], "country string, name string, code int, start string, end string")
    sinks.write_lines(pipelines.summary_lines(rows), f"file://{tmp_path}/s")
    assert spark.read.text(f"file://{tmp_path}/s").first().value == "c:n:5-n:2000-01-01:2001-01-01"
    sinks.write_csv(rows, f"file://{tmp_path}/c")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/c").count() == 1


def test_versions_are_atomic(spark, tmp_path):
    """A step that dies shows nothing; a half-written version file is passed over; writers that began alike conflict."""
    store = readers.Store(spark, f"file://{tmp_path}/s")
    edge = lambda s: spark.createDataFrame([(s, "CONTAINS", "x")], TABLES["relations"])
    subjects = lambda v=None: {r.subject for r in store.read("relations", v).collect()}
    assert store.write("relations", edge("a")) == 1 and store.write("relations", edge("b")) == 2
    died = store.step()
    died.stage("relations", edge("c"))
    died.stage("datasets", spark.createDataFrame([("c", "Dataset")], TABLES["datasets"]))
    assert subjects() == {"b"} and store.version("relations") == 2 and store.read("datasets").count() == 0
    (tmp_path / "s" / "_versions" / f"{3:012d}").write_text('{"tables": {"rela')
    assert subjects() == {"b"} and subjects(1) == {"a"}
    one, two = store.step(), store.step()
    for step, s in ((one, "d"), (two, "e")):
        step.stage("relations", edge(s))
    one.publish(batch=7)
    with pytest.raises(readers.WriteConflict):
        two.publish()
    assert subjects() == {"d"} and store.version("relations") == 3 and store.mark("batch") == 7
    # without its newest file the store still reads what was before
    (tmp_path / "s" / "_versions" / f"{4:012d}").unlink()
    assert subjects() == {"b"}


def test_a_batch_that_dies_is_replayed(spark, tmp_path, monkeypatch):
    fact = ("a", "p", "1", "xsd:string", None, datetime(2000, 1, 1), None, None, None, None)
    spark.createDataFrame([fact], TABLES["facts"]).write.parquet(f"{tmp_path}/in")
    store = readers.Store(spark, f"file://{tmp_path}/store")
    run = lambda: ingest(spark.readStream.schema(TABLES["facts"]).parquet(f"{tmp_path}/in"), store, f"{tmp_path}/ck", database=F.lit("2000-02-01").cast("timestamp_ntz")).awaitTermination(120)

    def dies(self, **marks):
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(readers.Step, "publish", dies)
        with pytest.raises(Exception, match="gone"):
            run()
    assert store.read("facts").count() == 0 and store.version("facts") == 0
    run()
    assert store.read("facts").count() == 1 and store.version("facts") == 1
