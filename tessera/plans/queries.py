"""One registered query for each operator family, with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import identifiers as ident
from ..functions import temporal as t
from ..operators import collections as coll
from ..operators import graph, index, merge, metrics, objects, relations, spatial
from ..operators.spatial import Box
from .views import Views, with_views

V, D = "1996-01-01 00:00:00", "1996-06-01 00:00:00"
AS_OF = f"valid_from <= TIMESTAMP '{V}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{V}') AND db_from <= TIMESTAMP '{D}' AND (db_to IS NULL OR db_to > TIMESTAMP '{D}')"
WINDOW = (-60.0, -40.0, 45.0, 30.0)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None):
    """Register a function of Views; its SQL may use the views by name."""

    def put(f: Callable[[Views], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql is not None:
            ORACLE[f.__name__] = with_views(sql)
        return f

    return put


def at(text: str):
    return t.instant(text)


# --- facts as of two times -----------------------------------------------------------------


@query(f"SELECT object_id, property, value, valid_from, valid_to FROM v_facts WHERE {AS_OF}")
def asof_facts(v: Views) -> DataFrame:
    return objects.facts_as_of(v.facts(), at(V), at(D)).select("object_id", "property", "value", "valid_from", "valid_to")


@query(f"""
SELECT object_id, min(CASE WHEN property = 'orderpriority' THEN value END) AS orderpriority,
  min(CASE WHEN property = 'orderstatus' THEN value END) AS orderstatus, min(CASE WHEN property = 'priceband' THEN value END) AS priceband
FROM v_facts WHERE {AS_OF} GROUP BY object_id HAVING count(DISTINCT property) = 3""")
def object_state_pivot(v: Views) -> DataFrame:
    return objects.read_objects(v.facts(), ["orderpriority", "orderstatus", "priceband"], at(V), at(D))


@query(f"""
SELECT object_id, max(valid_from) AS valid_from, min(valid_to) AS valid_to, max(db_from) AS db_from, min(db_to) AS db_to
FROM v_facts WHERE {AS_OF} GROUP BY object_id""")
def state_window(v: Views) -> DataFrame:
    return objects.state_window(v.facts(), at(V), at(D))


FACTS_SQL = "SELECT object_id, value, valid_from, valid_to, db_from, db_to FROM v_facts WHERE property = 'orderpriority' AND "
START, END = "1994-01-01 00:00:00", "1996-01-01 00:00:00"


def _history(v: Views, keep) -> DataFrame:
    return v.facts().where(F.col("property") == "orderpriority").where(keep).select("object_id", "value", "valid_from", "valid_to", "db_from", "db_to")


@query(FACTS_SQL + f"valid_from >= TIMESTAMP '{START}' AND valid_from < TIMESTAMP '{END}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{END}')")
def fact_history_window(v: Views) -> DataFrame:
    return _history(v, t.history_mode(at(START), at(END)))


@query(FACTS_SQL + f"valid_from >= TIMESTAMP '{START}' AND db_from >= TIMESTAMP '{END}'")
def fact_history_since(v: Views) -> DataFrame:
    return _history(v, t.history_mode(at(START), None, at(END)))


@query(FACTS_SQL + f"valid_from < TIMESTAMP '{END}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{START}')")
def fact_history_overlap(v: Views) -> DataFrame:
    return _history(v, t.history_mode(at(START), at(END), mode="overlap"))


@query("SELECT object_id, exists_from, exists_to FROM v_objects WHERE class = 'Order'")
def object_header(v: Views) -> DataFrame:
    return objects.header(v.objects(), "Order", None)


@query("SELECT object_id, CAST(NULL AS TIMESTAMP) AS exists_at, exists_from, exists_to FROM v_objects WHERE object_id IN (SELECT 'C' || c_custkey FROM customer WHERE c_acctbal > 0)")
def object_temporals(v: Views) -> DataFrame:
    ids = v.table("customer").where(F.col("c_acctbal") > 0).select(F.concat(F.lit("C"), "c_custkey").alias("id"))
    return objects.existence(v.objects(), ids)


@query("SELECT DISTINCT value FROM v_facts WHERE property = 'priceband' ORDER BY value LIMIT 5")
def sample_fact_values(v: Views) -> DataFrame:
    return objects.sample_values(v.objects(), v.facts(), "Customer", "priceband", 5)


@query("SELECT object_id FROM v_objects WHERE class = 'Customer' AND contains(lower(object_id), 'c1') ORDER BY object_id LIMIT 10")
def search_ids(v: Views) -> DataFrame:
    return objects.search(v.objects(), "c1", "Customer", 10)


@query("SELECT DISTINCT object_id FROM v_facts WHERE property = 'orderpriority' AND value = '1-URGENT'")
def property_restriction(v: Views) -> DataFrame:
    return objects.having(v.facts(), "orderpriority", "1-URGENT")


@query("""SELECT DISTINCT object_id FROM v_facts WHERE property = 'priceband' AND TRY_CAST(value AS INT) > 3
  AND object_id IN (SELECT object_id FROM v_facts WHERE property = 'orderpriority' AND value = '1-URGENT')""")
def value_compare(v: Views) -> DataFrame:
    urgent = objects.having(v.facts(), "orderpriority", "1-URGENT")
    return objects.comparing(v.facts(), "priceband", ">", 3, urgent, "xsd:int")


@query("SELECT object_id, exists_from, exists_to FROM v_objects WHERE exists_from >= TIMESTAMP '1995-01-01' AND (exists_to IS NULL OR exists_to >= TIMESTAMP '1997-01-01')")
def existence_compare(v: Views) -> DataFrame:
    return objects.existing(v.objects(), ">=", at("1995-01-01 00:00:00"), at("1997-01-01 00:00:00"))


@query(f"""SELECT object_id, CASE WHEN exists_to <= TIMESTAMP '{V}' THEN exists_to - INTERVAL 1 MICROSECOND
  WHEN exists_from > TIMESTAMP '{V}' THEN exists_from ELSE TIMESTAMP '{V}' END AS read_at FROM v_objects""")
def adjusted_time(v: Views) -> DataFrame:
    return objects.at_adjusted_time(v.objects(), at(V))


@query(f"""
SELECT f.object_id, f.property, f.value, CASE WHEN exists_from > TIMESTAMP '{START}' THEN exists_from ELSE TIMESTAMP '{START}' END AS read_at
FROM v_facts f JOIN v_objects o ON o.object_id = f.object_id
WHERE valid_from <= greatest(exists_from, TIMESTAMP '{START}') AND (valid_to IS NULL OR valid_to > greatest(exists_from, TIMESTAMP '{START}'))
  AND db_from <= TIMESTAMP '{END}' AND (db_to IS NULL OR db_to > TIMESTAMP '{END}')""")
def facts_at_adjusted_time(v: Views) -> DataFrame:
    found = objects.facts_at_adjusted_time(v.facts(), v.objects(), at(START), at(END))
    return found.select("object_id", "property", "value", "read_at")


# --- temporal relations ----------------------------------------------------------------------

PAIRS_SQL = """
WITH o AS (
  SELECT o_custkey AS k, object_id, exists_from AS f, exists_to AS e FROM v_objects JOIN orders ON object_id = 'O' || o_orderkey WHERE class = 'Order'),
p AS (SELECT a.object_id AS a, b.object_id AS b, a.f AS af, a.e AS ae, b.f AS bf, b.e AS be FROM o a JOIN o b ON a.k = b.k AND a.object_id <> b.object_id),
q AS (SELECT *, af >= bf AND (be IS NULL OR (ae IS NOT NULL AND ae <= be)) AS dur FROM p)
"""


def _order_pairs(v: Views) -> DataFrame:
    o = v.objects().where(F.col("class") == "Order").join(
        v.table("orders").select(F.concat(F.lit("O"), "o_orderkey").alias("object_id"), F.col("o_custkey").alias("k")), "object_id"
    ).select("k", "object_id", "exists_from", "exists_to")
    a = o.select("k", F.col("object_id").alias("a"), F.col("exists_from").alias("a_from"), F.col("exists_to").alias("a_to"))
    b = o.select("k", F.col("object_id").alias("b"), F.col("exists_from").alias("b_from"), F.col("exists_to").alias("b_to"))
    return a.join(b, "k").where(F.col("a") != F.col("b"))


@query(PAIRS_SQL + """
SELECT a, b, CASE WHEN af = bf AND ae IS NOT DISTINCT FROM be THEN 'EQUALS' WHEN NOT dur AND ae = bf THEN 'TEMPORAL_MEETS'
  WHEN dur AND af = bf THEN 'STARTS' WHEN dur AND ae = be THEN 'FINISHES' WHEN dur THEN 'DURING' WHEN af > bf THEN 'AFTER' WHEN ae <= bf THEN 'BEFORE' END AS relation
FROM q""")
def temporal_relations(v: Views) -> DataFrame:
    return _order_pairs(v).select("a", "b", t.relation(t.Span.of("a"), t.Span.of("b")).alias("relation"))


@query(PAIRS_SQL + """
SELECT relation, count(*) AS n FROM (
  SELECT CASE WHEN af = bf AND x = y THEN 'EQUALS' WHEN x < bf THEN 'BEFORE' WHEN y < af THEN 'AFTER' WHEN x = bf THEN 'MEETS' WHEN y = af THEN 'MET_BY'
    WHEN af = bf AND x < y THEN 'STARTS' WHEN af = bf THEN 'STARTED_BY' WHEN x = y AND af > bf THEN 'FINISHES' WHEN x = y THEN 'FINISHED_BY'
    WHEN af > bf AND x < y THEN 'DURING' WHEN af < bf AND x > y THEN 'CONTAINS' WHEN af < bf THEN 'OVERLAPS' ELSE 'OVERLAPPED_BY' END AS relation
  FROM (SELECT *, coalesce(ae, TIMESTAMP '9999-12-31') AS x, coalesce(be, TIMESTAMP '9999-12-31') AS y FROM q)) GROUP BY relation""")
def allen_relations(v: Views) -> DataFrame:
    return _order_pairs(v).groupBy(t.allen(t.Span.of("a"), t.Span.of("b")).alias("relation")).agg(F.count(F.lit(1)).alias("n"))


# --- merging ---------------------------------------------------------------------------------

NEW, KNOWN = "1999-01-01 00:00:00", "1999-02-01 00:00:00"


def _incoming(v: Views, start: str = NEW) -> DataFrame:
    """Every customer becomes urgent."""
    return v.objects().where(F.col("class") == "Customer").select(
        "object_id", F.lit("orderpriority").alias("property"), F.lit("1-URGENT").alias("value"), F.lit("xsd:string").alias("datatype"), F.lit(None).cast("string").alias("lang"),
        at(start).alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"), F.lit(None).cast("timestamp_ntz").alias("valid_at"),
        at(KNOWN).alias("db_from"), F.lit(None).cast("timestamp_ntz").alias("db_to"),
    )


@query(f"""
WITH cur AS (
  SELECT * FROM v_facts WHERE property = 'orderpriority' AND valid_from <= TIMESTAMP '{NEW}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{NEW}')
    AND db_from <= TIMESTAMP '{KNOWN}' AND (db_to IS NULL OR db_to > TIMESTAMP '{KNOWN}')),
ids AS (SELECT object_id FROM v_objects WHERE class = 'Customer'),
new AS (SELECT object_id FROM ids WHERE object_id NOT IN (SELECT object_id FROM cur WHERE value = '1-URGENT'))
SELECT f.object_id, f.property, f.value, f.valid_from, f.valid_to, f.db_from, CASE WHEN n.object_id IS NOT NULL AND c.object_id IS NOT NULL THEN TIMESTAMP '{KNOWN}' ELSE f.db_to END AS db_to
FROM v_facts f LEFT JOIN new n ON n.object_id = f.object_id AND f.property = 'orderpriority'
  LEFT JOIN cur c ON c.object_id = f.object_id AND c.property = f.property AND c.valid_from = f.valid_from AND c.db_from = f.db_from
UNION ALL SELECT c.object_id, property, value, valid_from, TIMESTAMP '{NEW}', TIMESTAMP '{KNOWN}', NULL FROM cur c JOIN new USING (object_id)
UNION ALL SELECT object_id, 'orderpriority', '1-URGENT', TIMESTAMP '{NEW}', NULL, TIMESTAMP '{KNOWN}', NULL FROM new""")
def merge_existing(v: Views) -> DataFrame:
    return merge.merge_existing(v.facts(), _incoming(v), at(KNOWN)).select("object_id", "property", "value", "valid_from", "valid_to", "db_from", "db_to")


@query(f"""SELECT object_id, value, valid_from, valid_to FROM v_facts WHERE property = 'orderpriority' AND valid_to IS NOT NULL
  AND valid_from <= TIMESTAMP '{V}' AND valid_to > TIMESTAMP '{V}' AND db_from <= TIMESTAMP '{KNOWN}' AND (db_to IS NULL OR db_to > TIMESTAMP '{KNOWN}')""")
def merge_continuing_conflicts(v: Views) -> DataFrame:
    return merge.continuing_conflicts(v.facts(), _incoming(v, V), at(V), at(KNOWN)).select("object_id", "value", "valid_from", "valid_to")


@query("SELECT DISTINCT object_id, property FROM v_facts WHERE property = 'orderpriority' AND db_to IS NULL")
def merge_nomerge_conflicts(v: Views) -> DataFrame:
    return merge.no_merge_conflicts(v.facts(), _incoming(v))


def _shipments(v: Views) -> DataFrame:
    """Facts of orders: each line's shipment day."""
    none = F.lit(None).cast("timestamp_ntz")
    day = F.expr("INTERVAL 2 DAYS")
    return v.table("lineitem").select(
        F.concat(F.lit("O"), "l_orderkey").alias("object_id"), F.lit("line").alias("property"), F.col("l_linenumber").cast("string").alias("value"), F.lit("xsd:int").alias("datatype"),
        F.lit(None).cast("string").alias("lang"), F.col("l_shipdate").alias("valid_from"), (F.col("l_shipdate") + day).alias("valid_to"), none.alias("valid_at"), none.alias("db_from"), none.alias("db_to"),
    )


@query("""SELECT o.object_id, CAST(l_linenumber AS VARCHAR) AS value, l_shipdate AS valid_from FROM lineitem JOIN v_objects o ON o.object_id = 'O' || l_orderkey
  WHERE NOT (l_shipdate >= exists_from AND (exists_to IS NULL OR l_shipdate + INTERVAL 2 DAY <= exists_to))""")
def existence_during_violations(v: Views) -> DataFrame:
    return merge.existence_violations(v.objects(), _shipments(v)).select("object_id", "value", "valid_from")


@query("""SELECT o.object_id, least(exists_from, f) AS exists_from, CASE WHEN e >= exists_to THEN e + INTERVAL 1 MICROSECOND ELSE exists_to END AS exists_to
  FROM v_objects o LEFT JOIN (SELECT 'O' || l_orderkey AS object_id, min(l_shipdate) AS f, max(l_shipdate) + INTERVAL 2 DAY AS e FROM lineitem GROUP BY 1) x ON x.object_id = o.object_id""")
def existence_extend(v: Views) -> DataFrame:
    return merge.extended_existence(v.objects(), _shipments(v)).select("object_id", "exists_from", "exists_to")


@query(f"""SELECT object_id, property, value, valid_from, CASE WHEN valid_to IS NULL AND property = 'orderstatus' THEN TIMESTAMP '{NEW}' ELSE valid_to END AS valid_to,
  CASE WHEN db_to IS NULL AND property = 'orderstatus' THEN TIMESTAMP '{KNOWN}' ELSE db_to END AS db_to FROM v_facts""")
def close_open_facts(v: Views) -> DataFrame:
    keys = v.facts().where(F.col("property") == "orderstatus")
    closed = merge.close_database(merge.close_valid(v.facts(), at(NEW), keys), at(KNOWN), keys)
    return closed.select("object_id", "property", "value", "valid_from", "valid_to", "db_to")


@query("""SELECT object_id, property, value, valid_from FROM v_facts WHERE property <> 'orderstatus'
  UNION ALL SELECT object_id, property, CASE WHEN substr(object_id, -1) = '7' THEN 'X' ELSE value END, valid_from FROM v_facts WHERE property = 'orderstatus'""")
def update_properties(v: Views) -> DataFrame:
    changes = v.facts().where((F.col("property") == "orderstatus") & F.col("object_id").endswith("7")).select("object_id", "property", F.lit("X").alias("value")).distinct()
    return objects.update_properties(v.facts(), changes).select("object_id", "property", "value", "valid_from")


@query("""SELECT object_id, count(*) AS n FROM v_facts WHERE object_id NOT IN (SELECT 'C' || c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY object_id""")
def remove_individuals(v: Views) -> DataFrame:
    ids = v.table("customer").where(F.col("c_acctbal") < 0).select(F.concat(F.lit("C"), "c_custkey").alias("id"))
    return objects.remove({"facts": v.facts()}, ids)["facts"].groupBy("object_id").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'V1:' || object_id || '@' || property || ':' || epoch_ms(valid_from) || ':' || epoch_ms(db_from) AS fact_id, value FROM v_facts""")
def fact_identifiers(v: Views) -> DataFrame:
    name = ident.versioned(F.col("object_id"), F.col("valid_from"), F.col("db_from"), F.col("property"))
    return v.facts().select(name.alias("fact_id"), "value")


@query("""SELECT * FROM (SELECT c_custkey AS k, o_orderdate AS d, o_orderpriority AS value FROM orders JOIN customer ON c_custkey = o_custkey
  QUALIFY row_number() OVER (PARTITION BY c_custkey, o_orderdate ORDER BY o_orderkey) = 1)
  QUALIFY lag(value) OVER (PARTITION BY k ORDER BY d) IS DISTINCT FROM value""")
def version_collapse(v: Views) -> DataFrame:
    first = v.table("orders").groupBy(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("d")).agg(F.min(F.struct("o_orderkey", "o_orderpriority")).alias("o"))
    return merge.collapse(first.select("k", "d", F.col("o.o_orderpriority").alias("value")), ["k"], ["d"], "value")


# --- scans and edges ---------------------------------------------------------------------------


@query("SELECT object_id FROM v_objects WHERE class = 'Order'")
def class_scan(v: Views) -> DataFrame:
    return objects.instances(v.objects(), "Order")


@query("SELECT DISTINCT class FROM v_objects WHERE class IN ('Order', 'Customer', 'Unused')")
def dataset_list(v: Views) -> DataFrame:
    registered = v.spark.createDataFrame([("Order",), ("Customer",), ("Unused",)], "class string")
    return objects.dataset_list(v.objects(), registered)


@query("SELECT DISTINCT property FROM v_facts ORDER BY property")
def dataset_properties(v: Views) -> DataFrame:
    return objects.dataset_properties(v.objects(), v.facts(), "Customer")


@query("SELECT object_id, property, value FROM v_facts WHERE property IN ('orderstatus', 'priceband') AND object_id IN (SELECT 'C' || c_custkey FROM customer WHERE c_nationkey = 3)")
def data_properties(v: Views) -> DataFrame:
    ids = v.table("customer").where(F.col("c_nationkey") == 3).select(F.concat(F.lit("C"), "c_custkey").alias("id"))
    return objects.data_properties(v.facts(), ids, ["orderstatus", "priceband"]).select("object_id", "property", "value")


@query("SELECT subject, relation, object FROM v_edges WHERE relation = 'CONTAINS' AND subject IN ('N1', 'N2', 'R0')")
def object_properties(v: Views) -> DataFrame:
    return objects.object_properties(v.edges(), ["N1", "N2", "R0"], "CONTAINS")


@query("""SELECT object_id AS subject, 'type' AS predicate, class AS object FROM v_objects UNION ALL SELECT object_id, property, value FROM v_facts
  UNION ALL SELECT subject, relation, object FROM v_edges""")
def triple_scan(v: Views) -> DataFrame:
    return objects.triples(v.objects(), v.facts(), v.edges())


@query("SELECT DISTINCT 'U' || user_id AS object_id, event_type, ts AS at FROM events WHERE event_type <> 'view'")
def individual_events(v: Views) -> DataFrame:
    return relations.individual_events(v.lifecycle().where(F.col("event_type") != "view"))


@query("SELECT DISTINCT subject, relation, object FROM v_edges WHERE subject <> object")
def individual_relations(v: Views) -> DataFrame:
    return relations.individual_relations(v.edges())


@query(f"SELECT e.subject, e.object, f.value FROM v_edges e JOIN v_facts f ON f.object_id = e.object WHERE relation = 'CONTAINS' AND property = 'orderpriority' AND {AS_OF}")
def related_objects(v: Views) -> DataFrame:
    return relations.related_objects(v.edges(), v.facts(), "CONTAINS", at(V), at(D), "orderpriority")


@query("SELECT a.object_id AS subject, 'CONTRIBUTES_TO' AS relation, b.object_id AS object FROM v_order_facts a JOIN v_order_facts b ON a.value = b.value")
def contributes_to(v: Views) -> DataFrame:
    return relations.contributes_to(v.order_facts(), "customer")


@query("""SELECT object_id, (SELECT count(*) FROM v_facts f WHERE f.object_id = o.object_id) AS n_facts, (SELECT count(*) FROM v_edges e WHERE e.subject = o.object_id) AS n_relations
  FROM (SELECT object_id FROM v_facts UNION SELECT subject FROM v_edges) o""")
def individual_view(v: Views) -> DataFrame:
    none = v.lifecycle().select("object_id", "event_type", "at").limit(0)
    seen = objects.individual(v.facts(), v.edges(), none)
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return seen.select("object_id", F.greatest(n("facts"), F.lit(0)).alias("n_facts"), F.greatest(n("relations"), F.lit(0)).alias("n_relations"))


@query("""SELECT object_id || ':created:event' AS event_id, object_id, 'CREATED' AS event_type, exists_from AS at FROM v_objects
  UNION ALL SELECT object_id || ':destroyed:event', object_id, 'DESTROYED', exists_to FROM v_objects WHERE exists_to IS NOT NULL""")
def lifecycle_events(v: Views) -> DataFrame:
    return objects.lifecycle_events(v.objects()).drop("strength")


@query("""SELECT subject || ':' || lower(event_type) || ':event' AS event_id, subject AS object_id, event_type,
    CASE event_type WHEN 'SPLIT' THEN exists_to ELSE exists_from END AS at, max(strength) AS strength, count(*) AS n_parts
  FROM v_splits JOIN v_objects ON object_id = subject WHERE event_type = 'MERGED' OR exists_to IS NOT NULL GROUP BY ALL""")
def split_merge_events(v: Views) -> DataFrame:
    events, parts, _ = relations.split_merge_events(v.objects(), v.changes())
    n = parts.groupBy("event_id").agg(F.count(F.lit(1)).alias("n_parts"))
    return events.join(n, "event_id")


@query("""SELECT object_id, exists_from FROM v_objects WHERE class = 'Order' AND object_id NOT IN (SELECT subject FROM v_splits)
  ORDER BY exists_from, object_id""")
def orphan_objects(v: Views) -> DataFrame:
    changed = v.changes().select("subject", F.concat(F.col("event_type"), F.lit("_INTO")).alias("relation"), F.col("component").alias("object"))
    return relations.orphans(v.objects().where(F.col("class") == "Order").select("object_id", "exists_from"), changed, ["exists_from", "object_id"])


# --- inference -----------------------------------------------------------------------------------


@query("SELECT subject, 'Spatial_Relation' AS relation, object FROM v_edges")
def inference_subprop(v: Views) -> DataFrame:
    return relations.supers(v.edges())


@query("""SELECT object AS subject, CASE relation WHEN 'CONTAINS' THEN 'INSIDE' ELSE relation END AS relation, subject AS object FROM v_edges""")
def inference_inverse(v: Views) -> DataFrame:
    return relations.inverses(v.edges())


@query("""SELECT a.subject, 'CONTAINS' AS relation, b.object FROM v_edges a JOIN v_edges b ON a.object = b.subject WHERE a.relation = 'CONTAINS' AND b.relation = 'CONTAINS'
  UNION SELECT subject, relation, object FROM v_edges WHERE relation = 'CONTAINS'""")
def inference_transitive_contains(v: Views) -> DataFrame:
    rules = relations.Rules(sub={}, inverse={}, symmetric=frozenset(), chains=())
    return relations.closure(v.edges().where(F.col("relation") == "CONTAINS"), rules)


@query("""SELECT DISTINCT e.subject, 'SPLIT_INTO' AS relation, e.component AS object FROM v_splits e JOIN v_objects ON object_id = e.subject WHERE event_type = 'SPLIT' AND exists_to IS NOT NULL""")
def inference_chain(v: Views) -> DataFrame:
    _, _, edges = relations.split_merge_events(v.objects(), v.changes())
    both = edges.unionByName(relations.inverses(edges))
    return relations.chained(both, both).where(F.col("relation") == "SPLIT_INTO").distinct()


@query("""WITH e AS (SELECT * FROM v_edges), c AS (
    SELECT a.subject, 'CONTAINS' AS relation, b.object FROM e a JOIN e b ON a.object = b.subject WHERE a.relation = 'CONTAINS' AND b.relation = 'CONTAINS'
    UNION SELECT subject, relation, object FROM e),
  i AS (SELECT * FROM c UNION SELECT object, CASE relation WHEN 'CONTAINS' THEN 'INSIDE' ELSE relation END, subject FROM c)
  SELECT relation, count(*) AS n FROM (SELECT * FROM i UNION SELECT subject, 'Spatial_Relation', object FROM i) GROUP BY relation""")
def inference_closure(v: Views) -> DataFrame:
    return relations.closure(v.edges()).groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT object_id AS id, class FROM v_objects UNION SELECT object_id, 'Interval_Object' FROM v_objects UNION SELECT object_id, 'Temporal_Object' FROM v_objects
  UNION SELECT subject || ':' || lower(event_type) || ':event', 'SpatialUnion' FROM v_splits JOIN v_objects ON object_id = subject WHERE event_type = 'MERGED' OR exists_to IS NOT NULL
  UNION SELECT component, 'Object' FROM v_splits JOIN v_objects ON object_id = subject WHERE event_type = 'MERGED' OR exists_to IS NOT NULL""")
def inference_types(v: Views) -> DataFrame:
    _, _, edges = relations.split_merge_events(v.objects(), v.changes())
    return relations.types(v.objects(), v.facts(), edges)


# --- collections ---------------------------------------------------------------------------------


@query("SELECT DISTINCT collection_id FROM v_members")
def collection_list(v: Views) -> DataFrame:
    return coll.collections(v.members())


@query("""SELECT b.collection_id, b.object_id FROM v_members a JOIN v_members b ON a.collection_id = b.collection_id AND a.strength = b.strength
  WHERE a.object_id = 'C7' AND a.strength >= 0.3""")
def collection_related(v: Views) -> DataFrame:
    return coll.related_pairs(v.members(), "C7", 0.3)


@query("SELECT object_id, strength FROM v_members WHERE collection_id = 'BUILDING' AND strength >= 0.7 AND object_id IN (SELECT object_id FROM v_objects WHERE class = 'Customer')")
def collection_members(v: Views) -> DataFrame:
    return coll.members_of(v.members(), v.objects(), "Customer", "BUILDING", 0.7)


@query("""SELECT DISTINCT a.collection_id AS collection, b.collection_id AS other FROM v_nation_members a JOIN v_edges e ON e.subject = a.object_id AND relation = 'SPATIAL_MEETS'
  JOIN v_nation_members b ON b.object_id = e.object WHERE a.strength >= 0.25 AND b.strength >= 0.25 AND a.collection_id <> b.collection_id""")
def collections_adjacent(v: Views) -> DataFrame:
    return coll.adjacent(v.nation_members(), v.edges(), 0.25)


@query("""SELECT collection_id, count(*) AS n FROM v_members WHERE collection_id <> 'MACHINERY' AND NOT (collection_id = 'BUILDING' AND object_id = 'C1') GROUP BY collection_id""")
def collection_removal(v: Views) -> DataFrame:
    left = coll.remove_member(coll.remove(v.members(), "MACHINERY"), "BUILDING", "C1")
    return left.groupBy("collection_id").agg(F.count(F.lit(1)).alias("n"))


BOX_SQL = "xmin <= {2} AND xmax >= {0} AND ymin <= {3} AND ymax >= {1}".format(*WINDOW)


@query(f"SELECT DISTINCT collection_id FROM v_members m JOIN v_customer_rect r ON r.object_id = m.object_id WHERE strength >= 0.8 AND {BOX_SQL}")
def st_intersect_collection(v: Views) -> DataFrame:
    return coll.intersecting(v.members(), v.rectangles("customer"), Box.of().intersects(Box.lit(*WINDOW)), 0.8)


# --- rectangles ------------------------------------------------------------------------------------


@query(f"SELECT object_id FROM v_part_rect WHERE {BOX_SQL}")
def spatial_intersect_rect(v: Views) -> DataFrame:
    return spatial.intersecting(v.rectangles("part"), WINDOW).select("object_id")


@query("SELECT object_id FROM v_part_rect WHERE xmin <= {2} + 7.5 AND xmax >= {0} - 7.5 AND ymin <= {3} + 7.5 AND ymax >= {1} - 7.5".format(*WINDOW))
def spatial_buffer_rect(v: Views) -> DataFrame:
    return spatial.intersecting(v.rectangles("part"), WINDOW, 7.5).select("object_id")


@query(f"SELECT r.object_id, f.property, f.value FROM v_customer_rect r JOIN v_facts f ON f.object_id = r.object_id WHERE {BOX_SQL} AND {AS_OF}")
def spatial_intersect_asof(v: Views) -> DataFrame:
    hit = spatial.intersecting(v.rectangles("customer"), WINDOW).select("object_id")
    return objects.facts_as_of(v.facts(), at(V), at(D), hit).select("object_id", "property", "value")


RECT_SQL = """
WITH p AS (
  SELECT a.object_id AS a, b.object_id AS b, (a.xmax - a.xmin) * (a.ymax - a.ymin) AS sa, (b.xmax - b.xmin) * (b.ymax - b.ymin) AS sb,
    greatest(0, least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin)) * greatest(0, least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin)) AS sc,
    a.xmin <= b.xmin AND a.ymin <= b.ymin AND a.xmax >= b.xmax AND a.ymax >= b.ymax AS cov,
    NOT (a.xmin < b.xmax AND b.xmin < a.xmax AND a.ymin < b.ymax AND b.ymin < a.ymax) AS touch
  FROM {0} a JOIN {1} b ON a.xmin <= b.xmax AND b.xmin <= a.xmax AND a.ymin <= b.ymax AND b.ymin <= a.ymax{2})
"""
SP = RECT_SQL.format("v_supplier_rect", "v_part_rect", "")
REPORT_SQL = """a, b, CASE WHEN sc / greatest(sa, sb) >= {0} THEN sc / greatest(sa, sb) END AS equality,
  CASE WHEN touch THEN 'SPATIAL_MEETS' WHEN cov THEN 'COVERS' ELSE 'SPATIAL_OVERLAPS' END AS relation,
  CASE WHEN touch THEN NULL WHEN cov THEN sb / sa ELSE sc / sa END AS overlap"""


def _pairs(v: Views) -> DataFrame:
    return spatial.block_join(v.rectangles("supplier"), v.rectangles("part"))


def _reported(pairs: DataFrame, *columns) -> DataFrame:
    """The ids of the pairs with what was found on their blocks."""
    return spatial.expand(pairs).select(F.col("a.object_id").alias("a"), F.col("b.object_id").alias("b"), *columns)


@query(SP + "SELECT a, b, sc / greatest(sa, sb) AS equality FROM p WHERE sc / greatest(sa, sb) >= 0.4")
def spatial_equality_rect(v: Views) -> DataFrame:
    e = spatial.equality(Box.of("a_"), Box.of("b_"))
    return _reported(_pairs(v).where(e >= 0.4).select("a_rows", "b_rows", e.alias("equality")), "equality")


@query(SP + "SELECT a, b, CASE WHEN sa <= sb THEN 'WITHIN' ELSE 'CONTAINS' END AS containment FROM p WHERE sc / least(sa, sb) >= 0.9")
def containment_rect(v: Views) -> DataFrame:
    c = spatial.containment(Box.of("a_"), Box.of("b_"), 0.9)
    return _reported(_pairs(v).select("a_rows", "b_rows", c.alias("containment")).where(F.col("containment") != "NONE"), "containment")


@query(SP + f"SELECT {REPORT_SQL.format(0.4)} FROM p")
def compare_rect(v: Views) -> DataFrame:
    r = spatial.compare(Box.of("a_"), Box.of("b_"), 0.4)
    return _reported(_pairs(v).select("a_rows", "b_rows", r.alias("r")).select("a_rows", "b_rows", "r.equality", "r.relation", "r.overlap"), "equality", "relation", "overlap")


GROUPS_SQL = "SELECT 'G' || s_nationkey AS group_id, object_id, xmin, ymin, xmax, ymax FROM v_supplier_rect JOIN supplier ON object_id = 'S' || s_suppkey"


def _groups(v: Views) -> DataFrame:
    s = v.table("supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("object_id"), F.concat(F.lit("G"), "s_nationkey").alias("group_id"))
    return v.rectangles("supplier").join(s, "object_id")


@query(f"""WITH g AS ({GROUPS_SQL}), u AS (SELECT group_id, min(xmin) AS x0, min(ymin) AS y0, max(xmax) AS x1, max(ymax) AS y1 FROM g GROUP BY 1)
  SELECT g.group_id, object_id, (xmax - xmin) * (ymax - ymin) / ((x1 - x0) * (y1 - y0)) AS contribution, (x1 - x0) * (y1 - y0) AS union_area FROM g JOIN u ON u.group_id = g.group_id""")
def union_contribution_rect(v: Views) -> DataFrame:
    return spatial.contributions(_groups(v))


@query(f"""WITH g AS ({GROUPS_SQL}), f AS (SELECT group_id, least(min(xmax) - max(xmin), 1e9) AS w, least(min(ymax) - max(ymin), 1e9) AS h FROM g GROUP BY 1)
  SELECT f.group_id, CASE WHEN w > 0 AND h > 0 THEN w * h ELSE 0 END AS common_area, CASE WHEN w > 0 AND h > 0 THEN 2 * (w + h) ELSE 0 END AS common_perimeter,
    (SELECT avg((xmax - xmin) * (ymax - ymin)) FROM g WHERE g.group_id = f.group_id) AS mean_area, (SELECT count(*) FROM g WHERE g.group_id = f.group_id) AS n FROM f""")
def area_summary(v: Views) -> DataFrame:
    g = _groups(v)
    stats = g.groupBy("group_id").agg(F.avg(Box.of().area).alias("mean_area"), F.count(F.lit(1)).alias("n"))
    return spatial.folded_intersection(g, "group_id").join(stats, "group_id")


@query("""
WITH life AS (
  SELECT r.*, TIMESTAMP '1992-01-01' + INTERVAL (s_suppkey % 50) MONTH AS f, TIMESTAMP '1992-01-01' + INTERVAL (s_suppkey % 50 + 6 + s_suppkey % 9) MONTH AS e
  FROM v_supplier_rect r JOIN supplier ON r.object_id = 'S' || s_suppkey),
p AS (
  SELECT a.object_id AS a, b.object_id AS b, a.f AS af, a.e AS ae, b.f AS bf, b.e AS be, (a.xmax - a.xmin) * (a.ymax - a.ymin) AS sa, (b.xmax - b.xmin) * (b.ymax - b.ymin) AS sb,
    greatest(0, least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin)) * greatest(0, least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin)) AS sc,
    a.xmin <= b.xmin AND a.ymin <= b.ymin AND a.xmax >= b.xmax AND a.ymax >= b.ymax AS cov,
    NOT (a.xmin < b.xmax AND b.xmin < a.xmax AND a.ymin < b.ymax AND b.ymin < a.ymax) AS touch
  FROM life a JOIN life b ON a.xmin <= b.xmax AND b.xmin <= a.xmax AND a.ymin <= b.ymax AND b.ymin <= a.ymax AND a.object_id <> b.object_id),
q AS (SELECT *, af >= bf AND ae <= be AS dur FROM p)
SELECT a, b, CASE WHEN sc / greatest(sa, sb) >= 0.9 THEN sc / greatest(sa, sb) END AS equality,
  CASE WHEN touch THEN 'SPATIAL_MEETS' WHEN cov THEN 'COVERS' ELSE 'SPATIAL_OVERLAPS' END AS relation,
  CASE WHEN touch THEN NULL WHEN cov THEN sb / sa ELSE sc / sa END AS overlap,
  CASE WHEN af = bf AND ae = be THEN 'EQUALS' WHEN NOT dur AND ae = bf THEN 'TEMPORAL_MEETS' WHEN dur AND af = bf THEN 'STARTS' WHEN dur AND ae = be THEN 'FINISHES'
    WHEN dur THEN 'DURING' WHEN af > bf THEN 'AFTER' WHEN ae <= bf THEN 'BEFORE' END AS temporal FROM q""")
def relation_calc_rect(v: Views) -> DataFrame:
    k = F.col("s_suppkey").cast("int")
    start = at("1992-01-01 00:00:00")
    life = v.table("supplier").select(
        F.concat(F.lit("S"), "s_suppkey").alias("object_id"),
        (start + F.make_ym_interval(F.lit(0), F.pmod(k, F.lit(50)))).alias("exists_from"),
        (start + F.make_ym_interval(F.lit(0), F.pmod(k, F.lit(50)) + 6 + F.pmod(k, F.lit(9)))).alias("exists_to"),
    )
    return spatial.spatio_temporal_relations(v.rectangles("supplier").join(life, "object_id"), 1.0, 0.9).drop("overlap_wkt")


@query("""WITH r AS (SELECT 'N' || c_nationkey AS k, c_custkey AS o, (c_custkey % 7) / 7.0::DOUBLE AS x FROM customer),
  l AS (SELECT k, list(x ORDER BY o) AS xs FROM r GROUP BY k)
  SELECT k AS zone, list_reduce(list_prepend(0.0::DOUBLE, xs), lambda d, x, i: (d + x) / (i - 1)) AS change FROM l""")
def zcta_recurrence(v: Views) -> DataFrame:
    rows = v.table("customer").select(F.concat(F.lit("N"), "c_nationkey").alias("zone"), F.col("c_custkey").alias("o"), (F.pmod("c_custkey", F.lit(7)) / 7.0).alias("x"))
    return spatial.change_metric(rows, "zone", "o", "x")


# --- graphs ------------------------------------------------------------------------------------------


@query("""SELECT 'N' || a.n_nationkey AS "from", 'N' || b.n_nationkey AS "to", abs(a.c - b.c)::DOUBLE AS weight
  FROM (SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS c FROM nation) a
  JOIN (SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS c FROM nation) b
    ON abs(a.n_nationkey - b.n_nationkey) = 1 AND 'N' || a.n_nationkey < 'N' || b.n_nationkey""")
def graph_edges(v: Views) -> DataFrame:
    n = v.table("customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    nodes = v.table("nation").join(n, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(
        F.concat(F.lit("N"), "n_nationkey").alias("object_id"), F.coalesce("n", F.lit(0)).alias("population")
    )
    return graph.spatial_graph(v.edges(), nodes, lambda a, b: F.abs(a("population") - b("population")).cast("double"))


@query("SELECT 'N' || n_nationkey AS node, abs(n_nationkey - 3) AS hops FROM nation WHERE abs(n_nationkey - 3) <= 4")
def graph_bfs(v: Views) -> DataFrame:
    edges = v.edges().where(F.col("relation") == "SPATIAL_MEETS").select(F.col("subject").alias("from"), F.col("object").alias("to"))
    return graph.reachable(edges, v.spark.createDataFrame([("N3",)], "node string"), 4)


# --- index, lifetimes, metrics, pipelines ---------------------------------------------------------------


@query("""SELECT o_custkey AS key, o_orderdate AS at, min(value) AS value FROM (SELECT DISTINCT o_custkey, o_orderdate FROM orders) q
  JOIN v_facts f ON f.object_id = 'C' || q.o_custkey AND f.property = 'orderstatus' AND f.db_to IS NULL AND f.valid_from <= q.o_orderdate AND (f.valid_to IS NULL OR f.valid_to > q.o_orderdate)
  GROUP BY 1, 2""")
def index_lookup(v: Views) -> DataFrame:
    day = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    own = v.facts().where((F.col("property") == "orderstatus") & F.col("db_to").isNull())
    entries = own.select(F.substring("object_id", 2, 20).cast("long").alias("key"), day("valid_from").alias("start"), F.coalesce(day("valid_to"), F.lit(index.MAX)).alias("end"), "value")
    asked = v.table("orders").select(F.col("o_custkey").alias("key"), day("o_orderdate").alias("at"), "o_orderdate").distinct()
    found = index.lookup(entries, asked.select("key", "at"))
    return found.groupBy("key", "at").agg(F.min("value").alias("value")).select("key", F.timestamp_micros("at").cast("timestamp_ntz").alias("at"), "value")


@query("""SELECT c_nationkey AS nation, count(*) AS n, least(max(year(o_orderdate)), 1997) - greatest(min(year(o_orderdate)), 1993) AS lifetime
  FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1""")
def lifetimes(v: Views) -> DataFrame:
    from .pipelines import lifetime_by

    rows = v.table("orders").join(v.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return lifetime_by(rows.select(F.col("c_nationkey").alias("nation"), F.year("o_orderdate").alias("year")), "nation", 1993, 1997)


METRICS_SQL = "SELECT event_type AS metric, ts, value FROM events"


def _metrics(v: Views) -> DataFrame:
    return v.table("events").select(F.col("event_type").alias("metric"), "ts", "value")


@query(f"SELECT * FROM ({METRICS_SQL}) WHERE metric IN ('click', 'purchase') ORDER BY metric, ts")
def metrics_export(v: Views) -> DataFrame:
    return metrics.export(_metrics(v), ["click", "purchase"])


@query(f"""SELECT metric, count(value) AS n, min(value) AS least, max(value) AS largest, avg(value) AS mean, stddev_samp(value) AS stddev, quantile_cont(value, 0.5) AS median,
  quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.98) AS p98, quantile_cont(value, 0.99) AS p99, quantile_cont(value, 0.999) AS p999
  FROM ({METRICS_SQL}) GROUP BY metric""")
def metrics_decompose(v: Views) -> DataFrame:
    return metrics.decompose(_metrics(v), accuracy=None)


@query("""SELECT year(o_orderdate) AS tbl_year, o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2""")
def yearly_union(v: Views) -> DataFrame:
    from .pipelines import yearly

    o = v.table("orders")
    tables = {y: o.where(F.year("o_orderdate") == y).select("o_orderstatus", "o_totalprice") for y in range(1990, 2003)}
    return yearly(tables).groupBy("tbl_year", F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""SELECT o_orderkey AS code, CAST(make_date(year(o_orderdate)::INT, 1, 1) AS VARCHAR) AS start, CAST(make_date(year(o_orderdate)::INT + 3, 1, 1) AS VARCHAR) AS "end" FROM orders
  WHERE o_orderstatus = 'F' AND o_custkey % 300 IN (6, 29, 49, 59, 68, 74, 170, 182, 253)""")
def region_rows(v: Views) -> DataFrame:
    from .pipelines import region_filter

    rows = v.table("orders").select(
        F.col("o_orderkey").alias("code"), F.when(F.col("o_orderstatus") == "F", "NO").otherwise("YES").alias("disputed"), F.pmod("o_custkey", F.lit(300)).alias("country"),
        F.year("o_orderdate").alias("first_year"), (F.year("o_orderdate") + 2).alias("last_year"),
    )
    return region_filter(rows).select("code", F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"))


@query("""SELECT nation, min(y) AS first_year, max(y) AS last_year FROM (SELECT c_nationkey AS nation, year(o_orderdate) AS y FROM orders JOIN customer ON c_custkey = o_custkey)
  GROUP BY 1 HAVING NOT (min(y) <= 1992 AND max(y) >= 1998)""")
def incomplete_regions(v: Views) -> DataFrame:
    from .pipelines import incomplete

    rows = v.table("orders").join(v.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return incomplete(rows.select(F.col("c_nationkey").alias("nation"), F.year("o_orderdate").alias("year")), "nation", 1992, 1998)


@query("""SELECT c_custkey AS k, '{"type":"Feature","id":"C' || c_custkey || '","properties":{"segment":"' || c_mktsegment || '","nation":' || c_nationkey || '}}' AS feature FROM customer""")
def feature_text(v: Views) -> DataFrame:
    from ..sources.sinks import feature

    c = v.table("customer")
    return c.select(F.col("c_custkey").alias("k"), feature(F.concat(F.lit("C"), "c_custkey"), None, {"segment": F.col("c_mktsegment"), "nation": F.col("c_nationkey")}).alias("feature"))


@query("""SELECT '<urn:' || object_id || '> <urn:' || property || '> "' || value || '" .' AS line FROM v_facts UNION ALL SELECT '<urn:' || subject || '> <urn:' || relation || '> <urn:' || object || '> .' FROM v_edges""")
def triples_export(v: Views) -> DataFrame:
    from ..sources.sinks import ntriples

    return ntriples(v.facts(), v.edges())


@query("""SELECT event_id, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS running FROM events""")
def running_counter(v: Views) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return v.table("events").select("event_id", F.sum("value").over(w).alias("running"))


# --- shapes as polygons, and the rest of the write side ----------------------------------------------------


@query("SELECT object_id, property, value, valid_from, valid_to, db_from, db_to FROM v_facts")
def merge_chain(v: Views) -> DataFrame:
    return v.facts().select("object_id", "property", "value", "valid_from", "valid_to", "db_from", "db_to")


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS object_id, unnest(['name', 's_nationkey', 's_acctbal']) AS property, unnest(['xsd:string', 'xsd:int', 'xsd:double']) AS datatype,
  TIMESTAMP '1995-01-01' + INTERVAL (s_suppkey % 9) YEAR AS valid_from, TIMESTAMP '1996-01-01' + INTERVAL (s_suppkey % 9) YEAR AS valid_to FROM supplier""")
def write_objects(v: Views) -> DataFrame:
    from ..schema import DatasetSchema, Fact

    rows = v.table("supplier").withColumn("day", F.make_date(1995 + F.pmod("s_suppkey", F.lit(9)).cast("int"), F.lit(1), F.lit(1)))
    schema = DatasetSchema("Supplier", "s_suppkey", (Fact("s_name", "name"), Fact("s_nationkey"), Fact("s_acctbal")), start="day", duration="1 YEAR")
    return objects.decompose(rows, schema, at(KNOWN))["facts"].select("object_id", "property", "datatype", "valid_from", "valid_to")


def _polygons(v: Views, kind: str) -> DataFrame:
    return v.rectangles(kind).withColumn("wkt", Box.of().wkt)


@query(SP + "SELECT a, b, sc AS common, CASE WHEN touch THEN 'SPATIAL_MEETS' WHEN cov THEN 'COVERS' ELSE 'SPATIAL_OVERLAPS' END AS relation FROM p")
def compare_polygons(v: Views) -> DataFrame:
    from ..geometry import udfs

    pairs = spatial.block_join(_polygons(v, "supplier"), _polygons(v, "part"))
    found = pairs.select("a_rows", "b_rows", udfs.comparison(0.4)(F.col("a_wkt"), F.col("b_wkt")).alias("r"))
    return _reported(found.select("a_rows", "b_rows", F.round("r.common", 6).alias("common"), "r.relation"), "common", "relation")


@query("SELECT object_id FROM v_part_rect WHERE xmin <= 5 AND xmax >= -5 AND ymin <= 5 AND ymax >= -5")
def spatial_intersect_polygon(v: Views) -> DataFrame:
    from ..geometry import udfs

    return udfs.intersecting(_polygons(v, "part"), "wkt", "POLYGON ((-5 -5, 5 -5, 5 5, -5 5, -5 -5))").select("object_id")


@query(f"""WITH g AS ({GROUPS_SQL}), x AS (SELECT group_id, object_id, unnest(range(CAST(xmin AS INT), CAST(xmax AS INT))) AS x, ymin, ymax FROM g),
  c AS (SELECT group_id, object_id, x, unnest(range(CAST(ymin AS INT), CAST(ymax AS INT))) AS y FROM x)
  SELECT group_id, CAST(count(DISTINCT (x, y)) AS DOUBLE) AS area, count(DISTINCT object_id) AS n FROM c GROUP BY group_id""")
def dataset_union_area(v: Views) -> DataFrame:
    from ..operators import aggregate

    s = v.table("supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("object_id"), F.concat(F.lit("G"), "s_nationkey").alias("group_id"))
    facts = _polygons(v, "supplier").select("object_id", F.lit("asWKT").alias("property"), F.col("wkt").alias("value"))
    out = aggregate.union_of(facts, s.select("object_id"), s)
    return out.select("group_id", F.round("area", 6).alias("area"), "n")


@query("""SELECT 'S' || s_suppkey AS group_id, 'SPLIT' AS direction, 'W' || s_suppkey AS union_object, 2 AS n_late, 1.0::DOUBLE AS strength FROM supplier WHERE s_suppkey % 5 <> 0""")
def spatial_union_match(v: Views) -> DataFrame:
    """A whole and its two halves a year later, of which every fifth lacks one."""
    from ..operators import union

    r = v.rectangles("supplier")
    key = F.substring("object_id", 2, 20)
    mid = (F.col("xmin") + F.col("xmax")) / 2
    y0, y1 = F.col("ymin"), F.col("ymax")

    def part(name: str, x0, x1, year: int):
        return F.struct(
            F.concat(F.lit(name), key).alias("object_id"), Box(x0, y0, x1, y1).wkt.alias("wkt"), at(f"{year}-01-01 00:00:00").alias("exists_from"), at(f"{year + 1}-01-01 00:00:00").alias("exists_to")
        )

    whole, left, right = part("W", F.col("xmin"), F.col("xmax"), 2000), part("L", F.col("xmin"), mid, 2001), part("R", mid, F.col("xmax"), 2001)
    parts = F.when(F.pmod(key.cast("int"), F.lit(5)) == 0, F.array(whole, left)).otherwise(F.array(whole, left, right))
    found = union.spatial_unions(r.select(F.col("object_id").alias("group_id"), F.inline(parts)), 0.9)
    return found.select("group_id", "direction", "union_object", F.size("late").alias("n_late"), F.round("strength", 9).alias("strength"))


@query("""WITH RECURSIVE e AS (SELECT subject AS s, component AS p FROM v_splits UNION SELECT component, subject FROM v_splits
    UNION SELECT a.component, b.component FROM v_splits a JOIN v_splits b ON a.subject = b.subject AND a.event_type = b.event_type AND a.component <> b.component),
  r AS (SELECT 'O20' AS object_id UNION SELECT e.p FROM r JOIN e ON e.s = r.object_id) SELECT object_id FROM r""")
def change_neighbourhood(v: Views) -> DataFrame:
    from ..operators import equivalence

    far = at("9999-01-01 00:00:00")
    dated = v.objects().withColumn("exists_to", F.coalesce("exists_to", far))
    events, parts, _ = relations.split_merge_events(dated, v.changes())
    none = v.edges().limit(0)
    return equivalence.neighbourhood(events, parts, none, v.spark.createDataFrame([("O20",)], "id string"))


@query("""SELECT 'N' || least(a, b) AS x, 'N' || greatest(a, b) AS y FROM (SELECT n_nationkey AS a, n_nationkey + 1 AS b FROM nation WHERE n_nationkey < 24)""")
def graph_spanning(v: Views) -> DataFrame:
    edges = v.edges().where(F.col("relation") == "SPATIAL_MEETS")
    weight = F.pmod(F.hash(F.least("subject", "object"), F.greatest("subject", "object")), F.lit(97)).cast("double")
    forest = graph.spanning_forest(edges.select(F.col("subject").alias("from"), F.col("object").alias("to"), weight.alias("weight")))
    n = lambda c: F.substring(c, 2, 9).cast("int")
    return forest.select(
        F.concat(F.lit("N"), F.least(n("from"), n("to"))).alias("x"), F.concat(F.lit("N"), F.greatest(n("from"), n("to"))).alias("y")
    )


@query("""SELECT '{"type":"Feature","id":"' || object_id || '","properties":{"xmin":' || printf('%.1f', xmin) || '},"geometry":{"type":"Polygon","coordinates":[[['
  || printf('%.1f', xmin) || ',' || printf('%.1f', ymin) || '],[' || printf('%.1f', xmax) || ',' || printf('%.1f', ymin) || '],[' || printf('%.1f', xmax) || ',' || printf('%.1f', ymax) || '],['
  || printf('%.1f', xmin) || ',' || printf('%.1f', ymax) || '],[' || printf('%.1f', xmin) || ',' || printf('%.1f', ymin) || ']]]}}' AS value FROM v_supplier_rect""")
def geojson_export(v: Views) -> DataFrame:
    from ..sources.sinks import geojson_lines

    return geojson_lines(_polygons(v, "supplier"), "object_id", "wkt", ["xmin"])


@query("""SELECT '<Placemark><name>' || object_id || '</name><ExtendedData></ExtendedData><Polygon><outerBoundaryIs><LinearRing><coordinates>' ||
  printf('%.1f', xmin) || ',' || printf('%.1f', ymin) || chr(10) || printf('%.1f', xmax) || ',' || printf('%.1f', ymin) || chr(10) || printf('%.1f', xmax) || ',' || printf('%.1f', ymax) || chr(10)
  || printf('%.1f', xmin) || ',' || printf('%.1f', ymax) || chr(10) || printf('%.1f', xmin) || ',' || printf('%.1f', ymin) || '</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>' AS value FROM v_supplier_rect""")
def kml_export(v: Views) -> DataFrame:
    from ..sources.sinks import placemark

    return _polygons(v, "supplier").select(placemark(F.col("object_id"), F.col("wkt"), {}).alias("value"))


@query("""SELECT object_id, strength * 2 AS strength FROM v_members WHERE collection_id = 'BUILDING'
  UNION ALL SELECT object_id, strength FROM v_members WHERE collection_id <> 'BUILDING'""")
def collection_add(v: Views) -> DataFrame:
    new = v.members().where(F.col("collection_id") == "BUILDING").withColumn("strength", F.col("strength") * 2)
    return coll.add(v.members(), new).select("object_id", "strength")


@query(f"SELECT 'Order' AS class, count(*) AS n FROM v_objects WHERE class = 'Order' AND exists_from <= TIMESTAMP '{V}' AND (exists_to IS NULL OR exists_to > TIMESTAMP '{V}')")
def sql_passthrough(v: Views) -> DataFrame:
    """Plain SQL over the stored tables as views."""
    v.objects().createOrReplaceTempView("objects")
    return v.spark.sql(f"SELECT class, count(*) AS n FROM objects WHERE class = 'Order' AND exists_from <= TIMESTAMP_NTZ '{V}' AND (exists_to IS NULL OR exists_to > TIMESTAMP_NTZ '{V}') GROUP BY class")
