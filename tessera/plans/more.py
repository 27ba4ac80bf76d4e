"""More registered queries: polygons that are no rectangles, equivalence, writes, the index, sources and jobs."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identifiers as ident
from ..geometry import udfs
from ..operators import aggregate, equivalence, index, merge, metrics, objects, relations, spatial, union
from ..operators.spatial import Box
from ..schema import empty
from . import pipelines
from .queries import AS_OF, KNOWN, D, V, _metrics, _polygons, _reported, at, query
from .views import Views


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _key(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix), column)


def _folder(v: Views, name: str) -> str:
    """A new folder that driver and executors share."""
    relations.checkpointer(v.spark)
    base = v.spark.conf.get("spark.checkpoint.dir", None) or v.spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


# --- polygons with notches, holes and parts ------------------------------------------------------

#: Cells of unit squares: a supplier's rectangle without its upper right quarter; a part's rectangle as two opposite
#: quarters (odd keys), or with a hole around its middle where it has room (even keys).
CELLS_SQL = """
WITH s AS (SELECT object_id, CAST(xmin AS INT) AS x0, CAST(xmax AS INT) AS x1, CAST(ymin AS INT) AS y0, CAST(ymax AS INT) AS y1 FROM v_supplier_rect),
p AS (SELECT object_id, CAST(substr(object_id, 2) AS INT) % 2 AS odd, CAST(xmin AS INT) AS x0, CAST(xmax AS INT) AS x1, CAST(ymin AS INT) AS y0, CAST(ymax AS INT) AS y1 FROM v_part_rect),
sx AS (SELECT *, CAST(floor((x0 + x1) / 2) AS INT) AS cx, CAST(floor((y0 + y1) / 2) AS INT) AS cy, unnest(range(x0, x1)) AS x FROM s),
sc AS (SELECT object_id, x, y FROM (SELECT *, unnest(range(y0, y1)) AS y FROM sx) WHERE NOT (x >= cx AND y >= cy)),
px AS (SELECT *, CAST(floor((x0 + x1) / 2) AS INT) AS cx, CAST(floor((y0 + y1) / 2) AS INT) AS cy, unnest(range(x0, x1)) AS x FROM p),
pc AS (SELECT object_id, x, y FROM (SELECT *, unnest(range(y0, y1)) AS y FROM px)
  WHERE CASE WHEN odd = 1 THEN (x < cx) = (y < cy) ELSE NOT (x1 - x0 >= 4 AND y1 - y0 >= 4 AND x BETWEEN cx - 1 AND cx AND y BETWEEN cy - 1 AND cy) END)
"""


def _ring(*points: tuple[Column, Column]) -> Column:
    text = [F.concat_ws(" ", x.cast("string"), y.cast("string")) for x, y in (*points, points[0])]
    return F.concat(F.lit("("), F.concat_ws(", ", *text), F.lit(")"))


def _box_ring(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return _ring((x0, y0), (x1, y0), (x1, y1), (x0, y1))


def _notched(v: Views) -> DataFrame:
    b = Box.of()
    cx, cy = (b.xmin + b.xmax) / 2, (b.ymin + b.ymax) / 2
    ring = _ring((b.xmin, b.ymin), (b.xmax, b.ymin), (b.xmax, cy), (cx, cy), (cx, b.ymax), (b.xmin, b.ymax))
    return v.rectangles("supplier").withColumn("wkt", F.concat(F.lit("POLYGON ("), ring, F.lit(")")))


def _parted(v: Views) -> DataFrame:
    b = Box.of()
    cx, cy = (b.xmin + b.xmax) / 2, (b.ymin + b.ymax) / 2
    two = F.concat(F.lit("MULTIPOLYGON (("), _box_ring(b.xmin, b.ymin, cx, cy), F.lit("), ("), _box_ring(cx, cy, b.xmax, b.ymax), F.lit("))"))
    shell = _box_ring(b.xmin, b.ymin, b.xmax, b.ymax)
    holed = F.concat(F.lit("POLYGON ("), shell, F.lit(", "), _box_ring(cx - 1, cy - 1, cx + 1, cy + 1), F.lit(")"))
    room = (b.xmax - b.xmin >= 4) & (b.ymax - b.ymin >= 4)
    odd = F.pmod(F.substring("object_id", 2, 20).cast("long"), F.lit(2)) == 1
    return v.rectangles("part").withColumn("wkt", F.when(odd, two).when(room, holed).otherwise(F.concat(F.lit("POLYGON ("), shell, F.lit(")"))))


def _shape_pairs(v: Views) -> DataFrame:
    return spatial.block_join(_notched(v), _parted(v))


@query(CELLS_SQL + "SELECT sc.object_id AS a, pc.object_id AS b, count(*)::DOUBLE AS common FROM sc JOIN pc USING (x, y) GROUP BY ALL")
def common_area_shapes(v: Views) -> DataFrame:
    """Notched shapes against holed ones and ones of two parts."""
    common = F.round(udfs.common_area(F.col("a_wkt"), F.col("b_wkt")), 6)
    return _reported(_shape_pairs(v).select("a_rows", "b_rows", common.alias("common")).where(F.col("common") > 0), "common")


@query(CELLS_SQL + """, c AS (SELECT sc.object_id AS a, pc.object_id AS b, count(*) AS k FROM sc JOIN pc USING (x, y) GROUP BY ALL),
  n AS (SELECT object_id, count(*) AS n FROM (SELECT * FROM sc UNION ALL SELECT * FROM pc) GROUP BY 1)
  SELECT a, b, CASE WHEN k / greatest(x.n, y.n) >= 0.3 THEN round(k / greatest(x.n, y.n), 9) END AS equality, CASE WHEN k = y.n THEN 'COVERS' ELSE 'SPATIAL_OVERLAPS' END AS relation, round(k / x.n, 9) AS overlap, k::DOUBLE AS overlap_area
  FROM c JOIN n x ON x.object_id = a JOIN n y ON y.object_id = b""")
def compare_shapes(v: Views) -> DataFrame:
    """The whole report on such pairs, with the area of the overlap's shape."""
    r = udfs.comparison(0.3)(F.col("a_wkt"), F.col("b_wkt"))
    found = _shape_pairs(v).select("a_rows", "b_rows", r.alias("r")).where(F.col("r.overlap").isNotNull())
    report = [F.round("r.equality", 9).alias("equality"), "r.relation", F.round("r.overlap", 9).alias("overlap"), F.round(udfs.area(F.col("r.overlap_wkt")), 6).alias("overlap_area")]
    return _reported(found.select("a_rows", "b_rows", *report), "equality", "relation", "overlap", "overlap_area")


@query(CELLS_SQL + "SELECT object_id, count(*)::DOUBLE AS area FROM (SELECT * FROM sc UNION ALL SELECT * FROM pc) GROUP BY 1")
def shape_area(v: Views) -> DataFrame:
    both = _notched(v).select("object_id", "wkt").unionByName(_parted(v).select("object_id", "wkt"))
    return both.select("object_id", F.round(udfs.area(F.col("wkt")), 6).alias("area"))


@query(CELLS_SQL + """SELECT DISTINCT object_id FROM pc WHERE x BETWEEN -20 AND 19 AND y BETWEEN -10 AND 9 AND NOT (x >= 0 AND y >= 0)""")
def spatial_intersect_notched(v: Views) -> DataFrame:
    """Parts that share area with a notched window."""
    window = "POLYGON ((-20 -10, 20 -10, 20 0, 0 0, 0 10, -20 10, -20 -10))"
    near = udfs.intersecting(_parted(v), "wkt", window)
    return near.where(udfs.common_area(F.col("wkt"), F.lit(window)) > 1e-9).select("object_id")


@query(CELLS_SQL + """, e AS (SELECT *, (x1 - x0) * (y1 - y0) AS whole FROM s) SELECT CAST(count(DISTINCT (sc.x, sc.y)) AS DOUBLE) AS area, count(DISTINCT sc.object_id) AS n, min(e.x0)::DOUBLE AS xmin, max(e.y1)::DOUBLE AS ymax
  FROM sc JOIN e ON e.object_id = sc.object_id""")
def union_area_shapes(v: Views) -> DataFrame:
    """The union of all notched shapes, without groups: added up over cells."""
    shapes = _notched(v)
    facts = shapes.select("object_id", F.lit("asWKT").alias("property"), F.col("wkt").alias("value"))
    return aggregate.union_of(facts, shapes.select("object_id")).select(F.round("area", 6).alias("area"), "n", "xmin", "ymax")


@query("""SELECT object_id, 6371.0072 * 6371.0072 * radians(xmax - xmin) * (sin(radians(ymax)) - sin(radians(ymin))) AS km2 FROM v_supplier_rect WHERE ymin >= -85 AND ymax <= 85""")
def area_km2(v: Views) -> DataFrame:
    inside = (F.col("ymin") >= -85) & (F.col("ymax") <= 85)
    return _polygons(v, "supplier").where(inside).select("object_id", udfs.area_km2(F.col("wkt")).alias("km2"))


@query("""SELECT object_id, 6378137.0 * radians(xmax - xmin) * 6378137.0 * (ln(tan(pi() / 4 + radians(ymax) / 2)) - ln(tan(pi() / 4 + radians(ymin) / 2))) / 1e6 AS area FROM v_supplier_rect WHERE ymin >= -80 AND ymax <= 80""")
def reprojected_area(v: Views) -> DataFrame:
    inside = (F.col("ymin") >= -80) & (F.col("ymax") <= 80)
    return _polygons(v, "supplier").where(inside).select("object_id", (udfs.area(udfs.reproject(3857)(F.col("wkt"))) / 1e6).alias("area"))


@query("SELECT object_id, 4326 + CAST(substr(object_id, 2) AS INT) % 3 AS srid, 'POINT (' || printf('%.1f', xmin) || ' ' || printf('%.1f', ymin) || ')' AS wkt FROM v_supplier_rect")
def wkt_literals(v: Views) -> DataFrame:
    """Reference systems written in front of a shape and read back; none is 4326."""
    srid = 4326 + F.pmod(F.substring("object_id", 2, 20).cast("int"), F.lit(3))
    point = F.concat(F.lit("POINT ("), F.col("xmin").cast("string"), F.lit(" "), F.col("ymin").cast("string"), F.lit(")"))
    literal = F.when(srid == 4326, point).otherwise(ident.with_crs(point, srid))
    return v.rectangles("supplier").select("object_id", ident.split_crs(literal).alias("c")).select("object_id", "c.srid", "c.wkt")


@query("SELECT 'S' || s_suppkey AS object_id, true AS near FROM supplier")
def simplified_shapes(v: Views) -> DataFrame:
    """Rings of four hundred points on a square, too long to store, come back shorter and cover nearly the same."""
    key = F.col("s_suppkey").cast("int")
    side = F.transform(F.sequence(F.lit(0), F.lit(399)), lambda i: F.struct((i / 100).cast("int").alias("s"), (F.pmod(i, F.lit(100)) / 100.0).alias("t")))

    def point(p: Column) -> Column:
        x = F.when(p["s"] == 0, p["t"]).when(p["s"] == 1, 1.0).when(p["s"] == 2, 1 - p["t"]).otherwise(0.0)
        y = F.when(p["s"] == 0, 0.0).when(p["s"] == 1, p["t"]).when(p["s"] == 2, 1.0).otherwise(1 - p["t"])
        return F.concat_ws(" ", (key + 10 * x).cast("string"), (10 * y).cast("string"))

    ring = F.transform(side, point)
    wkt = F.concat(F.lit("POLYGON (("), F.array_join(ring, ", "), F.lit(", "), F.get(ring, F.lit(0)), F.lit("))"))
    rows = spatial.spread(v.table("supplier").select("s_suppkey")).select(_key("S", "s_suppkey").alias("object_id"), wkt.alias("wkt")).withColumn("short", udfs.simplify(F.col("wkt")))
    near = (F.length("short") < 3000) & (udfs.equality(F.col("wkt"), F.col("short")) > 0.95)
    return rows.select("object_id", near.alias("near"))


@query("""SELECT object_id, greatest(0, least(xmax, 60) - greatest(xmin, -60)) * greatest(0, least(ymax, 45) - greatest(ymin, -45)) / greatest((xmax - xmin) * (ymax - ymin), 120 * 90) AS weight FROM v_part_rect""")
def membership_weights(v: Views) -> DataFrame:
    weight = spatial.membership_weight(Box.lit(-60.0, -45.0, 60.0, 45.0), Box.of())
    return v.rectangles("part").select("object_id", weight.alias("weight"))


def _halves(v: Views) -> DataFrame:
    """Each supplier's rectangle as a left and a right half."""
    b, mid = Box.of(), (F.col("xmin") + F.col("xmax")) / 2
    parts = F.array(F.struct(F.lit("L").alias("side"), Box(b.xmin, b.ymin, mid, b.ymax).wkt.alias("wkt")), F.struct(F.lit("R").alias("side"), Box(mid, b.ymin, b.xmax, b.ymax).wkt.alias("wkt")))
    return v.rectangles("supplier").select(F.col("object_id").alias("group_id"), F.inline(parts))


@query("SELECT object_id AS group_id, unnest(['L', 'R']) AS object_id, 0.5::DOUBLE AS contribution, (xmax - xmin) * (ymax - ymin) AS union_area FROM v_supplier_rect")
def union_contributions(v: Views) -> DataFrame:
    out = union.contributions(_halves(v).withColumnRenamed("side", "object_id"))
    return out.select("group_id", "object_id", F.round("contribution", 9).alias("contribution"), F.round("union_area", 6).alias("union_area"))


BOX = "xmin <= 20 AND xmax >= -20 AND ymin <= 20 AND ymax >= -20"


@query(f"""SELECT object_id, min(CASE WHEN property = 'orderpriority' THEN value END) AS orderpriority, min(CASE WHEN property = 'priceband' THEN value END) AS priceband
  FROM v_facts WHERE {AS_OF} AND object_id IN (SELECT object_id FROM v_customer_rect WHERE {BOX}) GROUP BY 1 HAVING count(DISTINCT CASE WHEN property <> 'orderstatus' THEN property END) = 2""")
def intersect_full_objects(v: Views) -> DataFrame:
    """Whole objects, as of two times, whose shape meets a polygon."""
    hit = udfs.intersecting(_polygons(v, "customer"), "wkt", "POLYGON ((-20 -20, 20 -20, 20 20, -20 20, -20 -20))").select("object_id")
    return objects.read_objects(v.facts(), ["orderpriority", "priceband"], at(V), at(D), hit)


@query(f"""SELECT object_id, min(CASE WHEN property = 'orderpriority' THEN value END) AS orderpriority, min(CASE WHEN property = 'priceband' THEN value END) AS priceband
  FROM v_facts WHERE {AS_OF} AND object_id IN ('C1', 'C2', 'C5', 'C7', 'C11', 'C13') GROUP BY 1 HAVING count(DISTINCT CASE WHEN property <> 'orderstatus' THEN property END) = 2""")
def objects_by_id(v: Views) -> DataFrame:
    return objects.read_objects(v.facts(), ["orderpriority", "priceband"], at(V), at(D), ["C1", "C2", "C5", "C7", "C11", "C13"])


# --- equivalence -------------------------------------------------------------------------------------


@query("""SELECT 'S' || s_suppkey AS group_id, 'M' || s_suppkey AS object_id FROM supplier WHERE s_suppkey % 5 NOT IN (0, 1)
  UNION ALL SELECT 'S' || s_suppkey, p || s_suppkey FROM (SELECT s_suppkey, unnest(['L', 'R']) AS p FROM supplier WHERE s_suppkey % 5 = 1)""")
def equivalent_objects(v: Views) -> DataFrame:
    """A whole splits in 2001 into two halves, which merge again in 2002: what stands for it in 2002. Every fifth lacks the
    second half's life after the split, so nothing does; of every fifth the halves never merge."""
    key = F.col("s_suppkey")
    none = F.pmod(key, F.lit(5))
    day = lambda y: at(f"{y}-01-01 00:00:00")
    s = v.table("supplier").select("s_suppkey")
    one = lambda p, a, b: F.struct(F.concat(F.lit(p), key).alias("object_id"), day(a).alias("exists_from"), b.alias("exists_to"))
    late = F.when(none == 1, _none("timestamp_ntz")).otherwise(day(2002))
    lives = F.array(one("W", 2000, day(2001)), one("L", 2001, late), one("R", 2001, F.when(none == 0, day(2001)).otherwise(late)), one("M", 2002, _none("timestamp_ntz")))
    lifetimes = s.select(F.inline(lives)).withColumn("exists_at", _none("timestamp_ntz"))
    change = lambda kind, whole: F.struct(F.lit(kind).alias("event_type"), F.concat(F.lit(whole), key).alias("subject"))
    changes = s.select("s_suppkey", F.inline(F.when(none > 1, F.array(change("SPLIT", "W"), change("MERGED", "M"))).otherwise(F.array(change("SPLIT", "W")))))
    changes = changes.select("event_type", "subject", F.explode(F.array(F.concat(F.lit("L"), key), F.concat(F.lit("R"), key))).alias("component"), F.lit(1.0).alias("strength"))
    events, parts, _ = relations.split_merge_events(lifetimes, changes)
    asked = s.select(_key("S", "s_suppkey").alias("group_id"), _key("W", "s_suppkey").alias("object_id"))
    return equivalence.equivalents(lifetimes, events, parts, v.edges().limit(0), asked, datetime(2002, 6, 1))


# --- writes -------------------------------------------------------------------------------------------

EDGES_SQL = "SELECT subject, relation, object FROM v_edges"


@query(EDGES_SQL + " UNION SELECT 'N' || n_nationkey, 'RELATED_TO', 'R' || n_regionkey FROM nation")
def write_relations(v: Views) -> DataFrame:
    new = v.table("nation").select(_key("N", "n_nationkey").alias("subject"), F.lit("RELATED_TO").alias("relation"), _key("R", "n_regionkey").alias("object"))
    return relations.add_edges(relations.add_edges(v.edges(), new), new)


@query(CELLS_SQL + """, c AS (SELECT sc.object_id AS a, pc.object_id AS b, count(*) AS k FROM sc JOIN pc USING (x, y) GROUP BY ALL), n AS (SELECT object_id, count(*) AS n FROM sc GROUP BY 1)
  SELECT 'overlap:' || a || ':' || b AS overlap_id, a, b, round(k / n, 9) AS pct, k::DOUBLE AS area FROM c JOIN n ON n.object_id = a""")
def write_overlaps(v: Views) -> DataFrame:
    """Overlaps of notched shapes as stored things, with their own shapes."""
    r = udfs.comparison(0.3)(F.col("a_wkt"), F.col("b_wkt"))
    found = _shape_pairs(v).select("a_rows", "b_rows", r.alias("r")).select("a_rows", "b_rows", "r.overlap", "r.overlap_wkt")
    found = found.where(F.col("overlap_wkt").isNotNull()).withColumns({"overlap": F.round("overlap", 9), "area": F.round(udfs.area(F.col("overlap_wkt")), 6)})
    none = empty(v.spark, "overlaps").withColumn("area", _none("double"))
    stored = relations.add_overlaps(none, _reported(found, "overlap", "overlap_wkt", "area"))
    return stored.select("overlap_id", "a", "b", "pct", "area")


LIFE_SQL = """SELECT object_id || ':created:event' AS event_id, object_id, 'CREATED' AS event_type, exists_from AS at FROM v_objects
  UNION ALL SELECT object_id || ':destroyed:event', object_id, 'DESTROYED', exists_to FROM v_objects WHERE exists_to IS NOT NULL"""


@query(f"""SELECT * FROM ({LIFE_SQL}) UNION ALL
  SELECT 'C' || c_custkey || ':destroyed:event', 'C' || c_custkey, 'DESTROYED', TIMESTAMP '1999-01-01' FROM customer WHERE c_custkey % 7 = 0""")
def write_events(v: Views) -> DataFrame:
    """Ends of some customers beside the events that are there; an event that is added twice is one."""
    gone = v.table("customer").where(F.pmod("c_custkey", F.lit(7)) == 0).select(_key("C", "c_custkey").alias("object_id"))
    new = gone.select(ident.event_id(F.col("object_id"), F.lit("destroyed")).alias("event_id"), "object_id", F.lit("DESTROYED").alias("event_type"), at("1999-01-01 00:00:00").alias("at"), _none("double").alias("strength"))
    known = objects.lifecycle_events(v.objects())
    return relations.add_event(relations.add_event(known, new), new).drop("strength")


@query("""SELECT object_id, event_type, CASE event_type WHEN 'CREATED' THEN exists_from - INTERVAL 1 DAY ELSE exists_to + INTERVAL 1 DAY END AS at FROM (
  SELECT object_id, unnest(['CREATED', 'DESTROYED']) AS event_type, exists_from, exists_to FROM v_objects) WHERE event_type = 'CREATED' OR exists_to IS NOT NULL""")
def adjusted_events(v: Views) -> DataFrame:
    """Events follow lifetimes that grew by a day on both sides."""
    day = F.expr("INTERVAL 1 DAY")
    grown = v.objects().withColumns({"exists_from": F.col("exists_from") - day, "exists_to": F.col("exists_to") + day})
    return relations.adjust_events(objects.lifecycle_events(v.objects()), grown).select("object_id", "event_type", "at")


@query(f"""SELECT object_id, value, valid_from, db_from FROM v_facts WHERE property = 'orderpriority' UNION ALL SELECT 'C' || o_custkey, 'note', min(o_orderdate), TIMESTAMP '{KNOWN}' FROM orders GROUP BY o_custkey""")
def add_facts(v: Views) -> DataFrame:
    """A property that the objects did not have, of the datatype that the dataset declares."""
    own = v.objects().where(F.col("class") == "Customer")
    none = _none("timestamp_ntz")
    new = own.select("object_id", F.lit("note").alias("property"), F.lit("note").alias("value"), F.lit("xsd:string").alias("datatype"), _none("string").alias("lang"), F.col("exists_from").alias("valid_from"), none.alias("valid_to"), none.alias("valid_at"), none.alias("db_from"), none.alias("db_to"))
    _, facts = merge.add_facts(own, v.facts(), new, {"note": "xsd:string"}, at(KNOWN))
    return facts.where(F.col("property").isin("orderpriority", "note")).select("object_id", "value", "valid_from", "db_from")


@query(f"""WITH e AS (SELECT 'U' || user_id AS object_id, event_type AS value, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1),
  n AS (SELECT object_id, 'later' AS value, ts AS t FROM e WHERE value = 'click')
  SELECT object_id, value, ts AS valid_at, CASE WHEN value = 'click' THEN TIMESTAMP '{KNOWN}' END AS db_to FROM e
  UNION ALL SELECT object_id, 'click', t, NULL FROM n UNION ALL SELECT object_id, value, t, NULL FROM n""")
def merge_points(v: Views) -> DataFrame:
    """Facts of a single instant: a new one at the same instant closes the old in database time and keeps its instant."""
    first = v.table("events").groupBy("user_id").agg(F.min(F.struct("ts", "event_id", "event_type")).alias("e"))
    none = _none("timestamp_ntz")

    def facts(df: DataFrame, value: Column, known: Column) -> DataFrame:
        return df.select(_key("U", "user_id").alias("object_id"), F.lit("seen").alias("property"), value.alias("value"), F.lit("xsd:string").alias("datatype"), _none("string").alias("lang"), none.alias("valid_from"), none.alias("valid_to"), F.col("e.ts").alias("valid_at"), known.alias("db_from"), none.alias("db_to"))

    old = facts(first, F.col("e.event_type"), at("1990-01-01 00:00:00"))
    new = facts(first.where(F.col("e.event_type") == "click"), F.lit("later"), at(KNOWN))
    return merge.merge_existing(old, new, at(KNOWN)).select("object_id", "value", "valid_at", "db_to")


@query("""SELECT 'R' || n_regionkey AS object_id, n_regionkey AS key, count(*) AS n, min('N' || n_nationkey) AS first FROM nation GROUP BY n_regionkey""")
def nested_objects(v: Views) -> DataFrame:
    """Regions with the nations that they contain as nested objects."""
    regions = v.table("region").select(_key("R", "r_regionkey").alias("object_id"), F.col("r_regionkey").alias("key"))
    nations = v.table("nation").select(_key("N", "n_nationkey").alias("object_id"), "n_name")
    out = objects.with_linked(regions, v.edges(), nations, "CONTAINS", "nations").where(F.col("nations").isNotNull())
    return out.select("object_id", "key", F.size("nations").cast("long").alias("n"), F.array_min(F.transform("nations", lambda x: x["object_id"])).alias("first"))


@query("SELECT object_id, property, value, valid_from, valid_to, db_from, db_to FROM v_facts")
def stored_facts(v: Views) -> DataFrame:
    """Facts through a store: two versions are written, the second is current."""
    from ..sources.readers import Store

    store = Store(v.spark, _folder(v, "store"))
    store.write("facts", v.facts().where(F.col("property") == "priceband"))
    store.write("facts", v.facts())
    return store.read("facts").select("object_id", "property", "value", "valid_from", "valid_to", "db_from", "db_to")


@query(f"SELECT object_id, property, value FROM v_facts WHERE {AS_OF} AND property = 'priceband'")
def stored_asof(v: Views) -> DataFrame:
    """As-of facts of a stored table: the filters reach its scan."""
    from ..sources.readers import Store

    store = Store(v.spark, _folder(v, "store"))
    store.write("facts", v.facts(), ["property"])
    return objects.facts_as_of(store.read("facts"), at(V), at(D), None, ["priceband"]).select("object_id", "property", "value")


# --- scans, restrictions, set operations ------------------------------------------------------------------


@query("SELECT 'N1' AS subject, true AS found UNION ALL SELECT 'N99999', false")
def contains_resource(v: Views) -> DataFrame:
    known = objects.triples(v.objects(), v.facts(), v.edges())
    rows = [(s, objects.contains_resource(known, s)) for s in ("N1", "N99999")]
    return v.spark.createDataFrame(rows, "subject string, found boolean")


@query("SELECT object_id, property, value FROM v_facts WHERE property <> 'priceband'")
def temporal_property_facts(v: Views) -> DataFrame:
    """Facts whose property lies below the temporal ones; the others go."""
    tree = v.spark.createDataFrame([("orderpriority", "Temporal_Property"), ("orderstatus", "Temporal_Property"), ("priceband", "Other")], "property string, ancestor string")
    return objects.temporal_properties(v.facts(), tree, True).select("object_id", "property", "value")


@query("SELECT n_nationkey AS k, CASE WHEN n_nationkey % 3 = 0 THEN 'en' WHEN n_nationkey % 3 = 1 THEN 'fr' ELSE 'en' END AS lang FROM nation")
def language_choice(v: Views) -> DataFrame:
    k = F.pmod("n_nationkey", F.lit(3))
    explicit = F.when(k == 0, F.lit("")).when(k == 1, F.lit("fr"))
    return v.table("nation").select(F.col("n_nationkey").alias("k"), ident.choose_language(explicit, "en").alias("lang"))


@query("SELECT object_id FROM v_part_rect WHERE xmin < -180 OR xmin > 180")
def coordinate_check(v: Views) -> DataFrame:
    return _polygons(v, "part").where(pipelines.out_of_range(F.col("wkt"))).select("object_id")


@query("""SELECT DISTINCT a.object_id AS subject, b.object_id AS object FROM v_members a JOIN v_members b ON a.collection_id = b.collection_id AND a.object_id <> b.object_id
  WHERE a.strength >= 0.9 AND b.strength >= 0.9 AND a.object_id IN ('C9', 'C19', 'C29')""")
def concept_partners(v: Views) -> DataFrame:
    classes = v.objects().where(F.col("class") == "Customer").select("object_id", "class").unionByName(
        v.table("customer").select(_key("C", "c_custkey").alias("object_id"), F.lit("Customer").alias("class"))
    ).distinct()
    return relations.concept_relations(v.members(), classes, 0.9, v.spark.createDataFrame([("C9",), ("C19",), ("C29",)], "object_id string"))


@query("""SELECT a.object_id AS subject, 'CONTRIBUTES_TO' AS relation, b.object_id AS object FROM v_order_facts a JOIN v_order_facts b ON a.value = b.value WHERE a.object_id IN ('O1', 'O2', 'O7', 'O32')""")
def contributes_to_ids(v: Views) -> DataFrame:
    return relations.contributes_to(v.order_facts(), "customer", v.spark.createDataFrame([("O1",), ("O2",), ("O7",), ("O32",)], "object_id string"))


@query("""SELECT c_nationkey AS k, 'both' AS kind FROM customer INTERSECT SELECT s_nationkey, 'both' FROM supplier
  UNION ALL (SELECT c_custkey, 'no order' FROM customer EXCEPT SELECT o_custkey, 'no order' FROM orders)""")
def set_operations(v: Views) -> DataFrame:
    c, s, o = v.table("customer"), v.table("supplier"), v.table("orders")
    both = c.select(F.col("c_nationkey").alias("k")).intersect(s.select("s_nationkey")).withColumn("kind", F.lit("both"))
    return both.unionByName(c.select(F.col("c_custkey").alias("k")).subtract(o.select("o_custkey")).withColumn("kind", F.lit("no order")))


# --- rules ----------------------------------------------------------------------------------------------------


@query("""SELECT 'N' || n_nationkey AS subject, 'BEGINS' AS relation, 'N' || (n_nationkey + CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE -1 END) AS object FROM nation WHERE n_nationkey < 24 AND n_nationkey // 2 % 2 = 0""")
def inference_asymmetric(v: Views) -> DataFrame:
    """Pairs of nations that begin each other, of which every second only one way."""
    k = F.col("n_nationkey")
    other = k + F.when(F.pmod(k, F.lit(2)) == 0, 1).otherwise(-1)
    both = (F.pmod(F.floor(k / 2), F.lit(2)) == 0) | (F.pmod(k, F.lit(2)) == 0)
    edges = v.table("nation").where((k < 24) & both).select(_key("N", "n_nationkey").alias("subject"), F.lit("BEGINS").alias("relation"), F.concat(F.lit("N"), other).alias("object"))
    return relations.violations(edges)


@query("SELECT 'N' || n_nationkey AS id, 'AttributeFact' AS class, 'SpatialFact' AS other FROM nation WHERE n_nationkey % 6 = 0")
def inference_disjoint(v: Views) -> DataFrame:
    """Facts of an attribute that are also stated to be rasters, which are spatial."""
    k, none = F.col("n_nationkey"), _none("timestamp_ntz")
    stated = F.when(F.pmod(k, F.lit(6)) == 0, F.array(F.lit("AttributeFact"), F.lit("RasterFact"))).when(F.pmod(k, F.lit(2)) == 0, F.array(F.lit("AttributeFact"))).otherwise(F.array(F.lit("VectorFact")))
    things = v.table("nation").select(_key("N", "n_nationkey").alias("object_id"), F.explode(stated).alias("class"), none.alias("exists_from"), none.alias("exists_to"), none.alias("exists_at"))
    return relations.disjoint_violations(relations.types(things, v.facts().limit(0), v.edges().limit(0)))


@query("""SELECT subject AS id, 'Object' AS class FROM (SELECT 'N' || n_nationkey AS subject FROM nation WHERE n_nationkey % 2 = 0) UNION SELECT 'N' || (n_nationkey + 1), 'Object' FROM nation WHERE n_nationkey % 2 = 0
  UNION SELECT 'N' || n_nationkey, 'Split_Event' FROM nation WHERE n_nationkey % 2 = 1 UNION SELECT 'N' || n_nationkey, 'Event' FROM nation WHERE n_nationkey % 2 = 1""")
def inference_domains(v: Views) -> DataFrame:
    """What domains and ranges say, also those of super-properties and with superclasses."""
    k = F.col("n_nationkey")
    name = F.when(F.pmod(k, F.lit(2)) == 0, F.lit("BEFORE")).otherwise(F.lit("SPLIT_OF"))
    edges = v.table("nation").select(_key("N", "n_nationkey").alias("subject"), name.alias("relation"), F.concat(F.lit("N"), k + 1).alias("object"))
    return relations.types(v.objects().limit(0), v.facts().limit(0), edges)


# --- index -----------------------------------------------------------------------------------------------------

INDEX_SQL = "SELECT o_custkey % 50 AS key, epoch_ms(o_orderdate) // 1000 AS s, epoch_ms(o_orderdate) // 1000 + CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE 864000 END AS e, o_orderkey AS value FROM orders"
HOLDS_SQL = "((s <= {0} AND {0} < e) OR (s = e AND s = {0}))"


def _entries(v: Views) -> DataFrame:
    s = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    return v.table("orders").select(
        F.pmod("o_custkey", F.lit(50)).cast("string").alias("key"), s.alias("start"), (s + F.when(F.pmod("o_orderkey", F.lit(4)) == 0, 0).otherwise(864000)).alias("end"), F.col("o_orderkey").cast("string").alias("value")
    )


def _index(v: Views) -> DataFrame:
    return index.insert(v.spark.createDataFrame([], "key string, start long, end long, value string"), _entries(v))


@query(f"SELECT CAST(key AS VARCHAR) AS key, s AS start, e AS end_, CAST(value AS VARCHAR) AS value FROM ({INDEX_SQL})")
def index_insert(v: Views) -> DataFrame:
    return _index(v).withColumnRenamed("end", "end_")


AT = 800_000_000


@query(f"""WITH i AS ({INDEX_SQL}) SELECT CAST(key AS VARCHAR) AS key, s AS start, CAST(CASE WHEN key = 7 AND {HOLDS_SQL.format(AT)} THEN 'new' ELSE value::VARCHAR END AS VARCHAR) AS value
  FROM i WHERE NOT (key = 3 AND {HOLDS_SQL.format(AT)}) AND value <> 77""")
def index_changes(v: Views) -> DataFrame:
    """One entry goes by time, one by value, one gets another value."""
    left = index.delete_value(index.delete(_index(v), "3", AT), "77")
    return index.update(left, "7", AT, "new").select("key", "start", "value")


@query(f"SELECT CAST(key AS VARCHAR) AS key, count(*) AS entries, avg(CASE WHEN s = e THEN 1.0 ELSE 0.0 END) AS points FROM ({INDEX_SQL}) GROUP BY key")
def index_statistics(v: Views) -> DataFrame:
    return index.statistics(index.rebuild(_index(v), 4))


@query(f"""WITH i AS ({INDEX_SQL}), q AS (SELECT DISTINCT o_custkey % 50 AS k, epoch_ms(o_orderdate) // 1000 + 3600 AS t FROM orders WHERE o_orderkey % 3 = 0)
  SELECT CAST(key AS VARCHAR) AS key, t AS at, CAST(value AS VARCHAR) AS value FROM q JOIN i ON key = k AND {HOLDS_SQL.format('t')}""")
def index_lookup_slices(v: Views) -> DataFrame:
    """Keys with many entries: joined by slices of ten days."""
    asked = v.table("orders").where(F.pmod("o_orderkey", F.lit(3)) == 0).select(F.pmod("o_custkey", F.lit(50)).cast("string").alias("key"), (F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + 3600).alias("at"))
    return index.lookup(_index(v), asked.distinct(), width=864_000)


# --- sources, sinks and jobs ------------------------------------------------------------------------------------


@query("SELECT CAST(substr(object_id, 2) AS INT) AS code, object_id AS name, (xmax - xmin) * (ymax - ymin) AS area FROM v_supplier_rect")
def shapefile_round_trip(v: Views) -> DataFrame:
    """Shapefiles written and read back by all tasks."""
    from ..sources import shapefile

    path = _folder(v, "shapes")
    rows = _polygons(v, "supplier").select(F.substring("object_id", 2, 20).alias("code"), F.col("object_id").alias("name"), "wkt")
    shapefile.write(rows.repartition(3), path, "code", "wkt").write.parquet(f"{path}-report")
    out = shapefile.read(v.spark, path, {"code": "int", "name": "string"})
    return out.select("code", "name", F.round(udfs.area(F.col("wkt")), 6).alias("area"))


@query("""SELECT s_suppkey AS code, s_name AS name, CAST(CAST(DATE '2000-01-01' + CAST(s_suppkey % 300 AS INT) AS DATE) AS VARCHAR) AS start FROM supplier""")
def delimited_round_trip(v: Views) -> DataFrame:
    """``code;name;start;end;wkt`` files: rows whose code is no number are dropped."""
    from ..sources import readers

    path = _folder(v, "delimited")
    day = F.date_add(F.lit("2000-01-01").cast("date"), F.pmod("s_suppkey", F.lit(300)).cast("int"))
    rows = v.table("supplier").select(F.col("s_suppkey").cast("string").alias("code"), F.col("s_name").alias("name"), day.alias("start"), F.date_add(day, 1).alias("end"), F.lit("POINT (1 2)").alias("wkt"))
    rows.unionByName(rows.withColumn("code", F.lit("none"))).write.option("sep", ";").csv(path)
    return readers.object_rows(v.spark, path).select("code", "name", F.col("start").cast("string").alias("start"))


@query("""SELECT n_regionkey || ':' || n_name || ':' || n_nationkey || '-' || n_name || ':' || 1990 || ':' || 2000 AS value FROM nation""")
def summary_lines(v: Views) -> DataFrame:
    path = _folder(v, "lines")
    from ..sources.sinks import write_lines

    rows = v.table("nation").select(F.col("n_regionkey").cast("string").alias("country"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("code"), F.lit("1990").alias("start"), F.lit("2000").alias("end"))
    write_lines(pipelines.summary_lines(rows), path)
    return v.spark.read.text(path)


@query("""SELECT lpad(CAST(n_nationkey + 1 AS VARCHAR), 2, '0') || lpad(CAST(c_custkey AS VARCHAR), 3, '0') AS geoid, c_custkey AS pop,
    ['Northeast', 'Midwest', 'South', 'West'][n_regionkey % 4 + 1] AS region FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey < 1000 AND c_custkey % 3 <> 0""")
def county_population(v: Views) -> DataFrame:
    """County shapes joined with the rows of summary level 50 of a population file, on numeric codes."""
    c = v.table("customer").join(v.table("nation"), F.col("n_nationkey") == F.col("c_nationkey")).where(F.col("c_custkey") < 1000)
    state, county = (F.col("n_nationkey") + 1).cast("string"), F.col("c_custkey").cast("string")
    shapes = c.select(F.lpad(state, 2, "0").alias("statefp"), F.lpad(county, 3, "0").alias("countyfp"), F.lit("POINT (0 0)").alias("wkt"))
    level = F.when(F.pmod("c_custkey", F.lit(3)) == 0, "40").otherwise("50")
    population = c.select(F.lpad(state, 3, "0").alias("state"), F.lpad(county, 3, "0").alias("county"), level.alias("sumlev"), (F.pmod("n_regionkey", F.lit(4)) + 1).cast("string").alias("region"), F.lit("1").alias("division"), F.col("c_custkey").alias("pop"))
    return pipelines.counties(shapes, population).select("geoid", "pop", "region")


@query("""SELECT lpad(CAST(o_custkey % 50 AS VARCHAR), 2, '0') || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE lpad(CAST(o_orderkey % 900 AS VARCHAR), 3, '0') END AS geoid,
  CASE WHEN o_orderkey % 5 = 0 THEN 'state' ELSE 'county' END AS level, count(*) AS n, sum(o_orderkey % 100) AS confirmed FROM orders GROUP BY ALL""")
def case_loader(v: Views) -> DataFrame:
    """Case rows by position; a row without a county counts for its state."""
    o = v.table("orders")
    county = F.when(F.pmod("o_orderkey", F.lit(5)) == 0, F.lit("NA")).otherwise(F.pmod("o_orderkey", F.lit(900)).cast("string"))
    rows = o.select(F.lit("x").alias("county"), F.pmod("o_orderkey", F.lit(100)).cast("string").alias("confirmed"), F.lit("2020-03-01 10:00 UTC").alias("updated"), F.pmod("o_custkey", F.lit(50)).cast("string").alias("state_fips"), county.alias("county_fips"))
    return pipelines.case_counts(rows).groupBy("geoid", "level").agg(F.count(F.lit(1)).alias("n"), F.sum("confirmed").alias("confirmed"))


REGION_SQL = """
WITH r AS (
  SELECT s_suppkey AS code, y, CASE WHEN s_suppkey % 2 = 0 OR y < 2002 THEN xmax ELSE xmax - 1 END AS xmax, xmin, ymin, ymax
  FROM v_supplier_rect JOIN supplier ON object_id = 'S' || s_suppkey, (SELECT unnest([2000, 2001, 2002]) AS y)),
ver AS (SELECT * FROM r WHERE y = 2000 OR (y = 2002 AND code % 2 = 1))
"""


@query(REGION_SQL + "SELECT 'V' || code || '-' || y AS object_id, code, y AS year FROM ver")
def regional_versions(v: Views) -> DataFrame:
    """Yearly regions, of which equal ones in a row are one version."""
    return _integrated(v)["versions"].select("object_id", "code", "year")


@query(REGION_SQL + """SELECT 'G' || code AS collection_id, 'V' || code || '-2002' AS object_id, (xmax - xmin) / (xmax + 1 - xmin) AS strength FROM ver WHERE y = 2002""")
def regional_members(v: Views) -> DataFrame:
    """New versions that joined their region's collection, by the common area over the larger."""
    own = _integrated(v)["members"]
    same = F.substring("collection_id", 2, 20) == F.regexp_extract("object_id", r"^V(\d+)-", 1)
    return own.where(same).select("collection_id", "object_id", F.round("strength", 9).alias("strength"))


def _integrated(v: Views) -> dict[str, DataFrame]:
    key = F.substring("object_id", 2, 20)
    years = v.rectangles("supplier").select(key.alias("k"), *spatial.ENVELOPE, F.explode(F.array(*map(F.lit, (2000, 2001, 2002)))).alias("year"))
    shrunk = F.when((F.pmod(F.col("k").cast("int"), F.lit(2)) == 0) | (F.col("year") < 2002), F.col("xmax")).otherwise(F.col("xmax") - 1)
    day = lambda y: F.make_timestamp_ntz(y, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    rows = years.withColumn("xmax", shrunk).select(
        F.concat(F.lit("V"), "k", F.lit("-"), "year").alias("object_id"), F.col("k").cast("long").alias("code"), "year", Box.of().wkt.alias("wkt"), day(F.col("year")).alias("exists_from"), day(F.col("year") + 1).alias("exists_to")
    )
    members = v.rectangles("supplier").select(F.concat(F.lit("G"), key).alias("collection_id"), F.concat(F.lit("V"), key, F.lit("-2000")).alias("object_id"), F.lit("SEMANTIC").alias("relation_type"), F.lit(1.0).alias("strength"))
    return pipelines.integrate_regions(rows, members)


@query("""WITH w AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey < 10 THEN 0 WHEN n_nationkey < 20 THEN 100 ELSE 500 END AS v FROM nation)
  SELECT 'N' || k AS node, v // 100 AS region FROM w""")
def regionalization(v: Views) -> DataFrame:
    """Neighbours of like value: two cuts make three regions, named here by their value."""
    k = F.col("n_nationkey")
    nodes = v.table("nation").select(_key("N", "n_nationkey").alias("object_id"), F.when(k < 10, 0).when(k < 20, 100).otherwise(500).alias("value"))
    groups = pipelines.regionalize(v.edges(), nodes, "value", 3)
    least = groups.join(nodes.select(F.col("object_id").alias("region"), "value"), "region")
    return least.select("node", F.floor(F.col("value") / 100).alias("region"))


@query("""SELECT c_nationkey AS nation, count(*) AS n, round(avg(6371.0072 * 6371.0072 * radians(xmax - xmin) * (sin(radians(ymax)) - sin(radians(ymin)))), 3) AS mean
  FROM v_customer_rect JOIN customer ON object_id = 'C' || c_custkey GROUP BY 1""")
def size_distribution(v: Views) -> DataFrame:
    own = v.table("customer").select(_key("C", "c_custkey").alias("object_id"), F.col("c_nationkey").alias("nation"))
    return pipelines.size_distribution(_polygons(v, "customer").join(own, "object_id"), "nation", "wkt").select("nation", "n", F.round("mean", 3).alias("mean"))


@query("""WITH n AS (SELECT max(ts) AS t FROM events) SELECT event_type AS metric, count(*) FILTER (WHERE ts > t - INTERVAL 15 MINUTE) / 900.0::DOUBLE AS rate_15m,
  count(*) / greatest(1.0, epoch_us(max(t)) / 1e6 - epoch_us(min(ts)) / 1e6) AS rate_mean FROM events, n GROUP BY event_type""")
def metric_rates(v: Views) -> DataFrame:
    values = _metrics(v)
    now = values.agg(F.max("ts").alias("t")).first().t
    return metrics.rates(values, F.lit(str(now)).cast("timestamp_ntz")).select("metric", "rate_15m", "rate_mean")


@query(f"""SELECT object_id FROM v_objects WHERE class = 'Customer' AND object_id IN (SELECT object_id FROM v_facts WHERE property = 'orderpriority' AND value = '1-URGENT')
  AND object_id IN (SELECT object_id FROM v_facts WHERE property = 'priceband' AND TRY_CAST(value AS INT) > 3)""")
def restricted_objects(v: Views) -> DataFrame:
    """Two restrictions as operations: by equal text and by a number."""
    where = aggregate.Operation("orderpriority", "=", "1-URGENT", "xsd:string")
    return aggregate.restricted(v.objects(), v.facts(), "Customer", where, None, aggregate.Operation("priceband", ">", 3, "xsd:int"))


@query("SELECT n_nationkey AS k, n_name AS name, upper(n_name) AS stored FROM nation")
def type_codecs(v: Views) -> DataFrame:
    """A datatype of one's own: how it is stored and read back."""
    from ..schema import TypeCodecs

    codecs = TypeCodecs()
    codecs.register("name", lambda c: F.reverse(F.upper(c)), lambda c: F.reverse(c))
    rows = v.table("nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), codecs.encode("name", F.col("n_name")).alias("e"))
    return rows.select("k", "name", codecs.decode("name", F.col("e")).alias("stored"))
