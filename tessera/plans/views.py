"""Objects, facts, rectangles, edges and collections derived from order tables: the data that
the registered queries run on. Each view exists twice, as DataFrames and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merge import version_chain
from ..schema import TABLES


#: Bytes of files of orders for one task: some hundred thousand facts.
TASK_BYTES = 1 << 20


class Views:
    """Views over the Parquet tables of one folder; nothing is read before an action."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def _dealt(self, df: DataFrame, key: str) -> DataFrame:
        """A table dealt by a key over so many tasks that each has ``TASK_BYTES`` of its files: the adaptive planner
        would make as few as there are cores, whose sorts grow with the input."""
        files = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        least = min(int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.spark.sparkContext.defaultParallelism)
        return df.repartition(max(least, -(-files // TASK_BYTES)), key)

    def objects(self) -> DataFrame:
        """Orders live from order to last shipment; customers from their first order on."""
        orders, items = self.table("orders"), self.table("lineitem")
        shipped = items.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("exists_to"))
        none = F.lit(None).cast("timestamp_ntz")
        o = orders.join(shipped, orders.o_orderkey == shipped.l_orderkey, "left").select(
            F.concat(F.lit("O"), "o_orderkey").alias("object_id"), F.lit("Order").alias("class"), F.col("o_orderdate").alias("exists_from"), "exists_to", none.alias("exists_at")
        )
        c = orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("exists_from"))
        c = c.select(F.concat(F.lit("C"), "o_custkey").alias("object_id"), F.lit("Customer").alias("class"), "exists_from", none.alias("exists_to"), none.alias("exists_at"))
        return o.unionByName(c)

    def facts(self) -> DataFrame:
        """Three properties of customers that change with their orders, as merges would leave them."""
        orders = self._dealt(self.table("orders"), "o_custkey")  # all that follows stays in these tasks
        # one order for each customer and date: the one with the least key
        first = orders.groupBy("o_custkey", "o_orderdate").agg(F.min(F.struct("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice")).alias("o"))
        band = F.floor(F.col("o.o_totalprice") / 50000).cast("int").cast("string")
        long = first.select(
            "o_custkey",
            F.col("o_orderdate").alias("at"),
            F.inline(
                F.array(
                    F.struct(F.lit("orderpriority").alias("property"), F.col("o.o_orderpriority").alias("value"), F.lit("xsd:string").alias("datatype")),
                    F.struct(F.lit("orderstatus").alias("property"), F.col("o.o_orderstatus").alias("value"), F.lit("xsd:string").alias("datatype")),
                    F.struct(F.lit("priceband").alias("property"), band.alias("value"), F.lit("xsd:int").alias("datatype")),
                )
            ),
        )
        chain = version_chain(long, ["o_custkey", "property", "datatype"], "value", "at")
        return chain.withColumns({"object_id": F.concat(F.lit("C"), "o_custkey"), "lang": F.lit(None).cast("string"), "valid_at": F.lit(None).cast("timestamp_ntz")}).select(*TABLES["facts"].names)

    def order_facts(self) -> DataFrame:
        """The customer of each order, as a fact of the order."""
        o = self.table("orders")
        return o.select(
            F.concat(F.lit("O"), "o_orderkey").alias("object_id"), F.lit("customer").alias("property"), F.col("o_custkey").cast("string").alias("value")
        )

    def rectangles(self, kind: str) -> DataFrame:
        """A rectangle for each part, supplier or customer, with integer bounds."""
        key = {"part": "p_partkey", "supplier": "s_suppkey", "customer": "c_custkey"}[kind]
        k = F.col(key)
        cx, cy = F.pmod(k * 37, F.lit(360)) - 180, F.pmod(k * 53, F.lit(180)) - 90
        w, h = 1 + F.pmod(k, F.lit(4)), 1 + F.pmod(k, F.lit(3))
        return self.table(kind).select(
            F.concat(F.lit(kind[0].upper()), k).alias("object_id"),
            (cx - w).cast("double").alias("xmin"),
            (cy - h).cast("double").alias("ymin"),
            (cx + w).cast("double").alias("xmax"),
            (cy + h).cast("double").alias("ymax"),
        )

    def edges(self) -> DataFrame:
        """region contains nation contains customer and supplier; nations with neighbouring keys meet."""
        n, c, s = self.table("nation"), self.table("customer"), self.table("supplier")

        def edge(df: DataFrame, a: Column, relation: str, b: Column) -> DataFrame:
            return df.select(a.alias("subject"), F.lit(relation).alias("relation"), b.alias("object"))

        def tag(t: str, col: str) -> Column:
            return F.concat(F.lit(t), F.col(col))

        up = edge(n, tag("R", "n_regionkey"), "CONTAINS", tag("N", "n_nationkey"))
        up = up.unionByName(edge(c, tag("N", "c_nationkey"), "CONTAINS", tag("C", "c_custkey")))
        up = up.unionByName(edge(s, tag("N", "s_nationkey"), "CONTAINS", tag("S", "s_suppkey")))
        m = n.select("n_nationkey", F.explode(F.array(F.lit(-1), F.lit(1))).alias("d"))
        last = self.table("nation").select(F.col("n_nationkey").alias("k"))
        meets = m.join(last, m.n_nationkey + m.d == last.k)
        return up.unionByName(edge(meets, tag("N", "n_nationkey"), "SPATIAL_MEETS", tag("N", "k")))

    def members(self) -> DataFrame:
        """Customers in their market segment, with a strength of 0 to 0.9."""
        return self.table("customer").select(
            F.col("c_mktsegment").alias("collection_id"),
            F.concat(F.lit("C"), "c_custkey").alias("object_id"),
            F.lit("SEMANTIC").alias("relation_type"),
            (F.pmod("c_custkey", F.lit(10)) / 10.0).alias("strength"),
        )

    def nation_members(self) -> DataFrame:
        """Nations in one of six collections, two for each region's parity."""
        return self.table("nation").select(
            F.concat(F.lit("G"), F.pmod("n_nationkey", F.lit(6))).alias("collection_id"),
            F.concat(F.lit("N"), "n_nationkey").alias("object_id"),
            F.lit("SPATIAL").alias("relation_type"),
            (F.pmod("n_nationkey", F.lit(4)) / 4.0).alias("strength"),
        )

    def lifecycle(self) -> DataFrame:
        return self.table("events").select(
            F.concat(F.lit("U"), "user_id").alias("object_id"), F.col("event_type"), F.col("ts").alias("at"), F.col("value"), "event_id"
        )

    def changes(self) -> DataFrame:
        """Every tenth order splits into the two after it; orders after those merge two before them."""
        o = self.table("orders").select("o_orderkey")
        key = F.col("o_orderkey")
        split = F.struct(F.lit("SPLIT").alias("event_type"), F.array(key + 1, key + 2).alias("parts"), F.lit(0.9).alias("strength"))
        merged = F.struct(F.lit("MERGED").alias("event_type"), F.array(key - 1, key - 2).alias("parts"), F.lit(0.8).alias("strength"))
        kind = F.when(F.pmod(key, F.lit(10)) == 0, split).when(F.pmod(key, F.lit(10)) == 5, merged)
        rows = o.select("o_orderkey", kind.alias("k")).where(F.col("k").isNotNull()).select("o_orderkey", "k.event_type", F.explode("k.parts").alias("part"), "k.strength")
        known = o.select(key.alias("part"))
        return rows.join(known, "part", "left_semi").select(
            "event_type", F.concat(F.lit("O"), "o_orderkey").alias("subject"), F.concat(F.lit("O"), "part").alias("component"), "strength"
        )


#: The same views in DuckDB SQL, as common table expressions.
SQL = {
    "v_objects": """
  SELECT 'O' || o_orderkey AS object_id, 'Order' AS class, o_orderdate AS exists_from, max(l_shipdate) AS exists_to
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate
  UNION ALL SELECT 'C' || o_custkey, 'Customer', min(o_orderdate), NULL FROM orders GROUP BY o_custkey""",
    "v_long": """
  SELECT 'C' || o_custkey AS object_id, o_orderdate AS tm, unnest(['orderpriority', 'orderstatus', 'priceband']) AS property,
    unnest([o_orderpriority, o_orderstatus, CAST(CAST(floor(o_totalprice / 50000) AS INT) AS VARCHAR)]) AS value
  FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey) = 1""",
    "v_changes": """
  SELECT *, lead(tm) OVER (PARTITION BY object_id, property ORDER BY tm) AS nxt FROM (
    SELECT * FROM v_long QUALIFY lag(value) OVER (PARTITION BY object_id, property ORDER BY tm) IS DISTINCT FROM value)""",
    "v_facts": """
  SELECT object_id, property, value, tm AS valid_from, CAST(NULL AS TIMESTAMP) AS valid_to, tm + INTERVAL 1 DAY AS db_from, nxt + INTERVAL 1 DAY AS db_to FROM v_changes
  UNION ALL SELECT object_id, property, value, tm, nxt, nxt + INTERVAL 1 DAY, NULL FROM v_changes WHERE nxt IS NOT NULL""",
    "v_customer_rect": "SELECT 'C' || k AS object_id, cx - w AS xmin, cy - h AS ymin, cx + w AS xmax, cy + h AS ymax FROM (SELECT c_custkey AS k, CAST((c_custkey * 37) % 360 - 180 AS DOUBLE) AS cx, CAST((c_custkey * 53) % 180 - 90 AS DOUBLE) AS cy, 1 + c_custkey % 4 AS w, 1 + c_custkey % 3 AS h FROM customer)",
    "v_supplier_rect": "SELECT 'S' || k AS object_id, cx - w AS xmin, cy - h AS ymin, cx + w AS xmax, cy + h AS ymax FROM (SELECT s_suppkey AS k, CAST((s_suppkey * 37) % 360 - 180 AS DOUBLE) AS cx, CAST((s_suppkey * 53) % 180 - 90 AS DOUBLE) AS cy, 1 + s_suppkey % 4 AS w, 1 + s_suppkey % 3 AS h FROM supplier)",
    "v_part_rect": "SELECT 'P' || k AS object_id, cx - w AS xmin, cy - h AS ymin, cx + w AS xmax, cy + h AS ymax FROM (SELECT p_partkey AS k, CAST((p_partkey * 37) % 360 - 180 AS DOUBLE) AS cx, CAST((p_partkey * 53) % 180 - 90 AS DOUBLE) AS cy, 1 + p_partkey % 4 AS w, 1 + p_partkey % 3 AS h FROM part)",
    "v_edges": """
  SELECT 'R' || n_regionkey AS subject, 'CONTAINS' AS relation, 'N' || n_nationkey AS object FROM nation
  UNION ALL SELECT 'N' || c_nationkey, 'CONTAINS', 'C' || c_custkey FROM customer
  UNION ALL SELECT 'N' || s_nationkey, 'CONTAINS', 'S' || s_suppkey FROM supplier
  UNION ALL SELECT 'N' || a.n_nationkey, 'SPATIAL_MEETS', 'N' || b.n_nationkey FROM nation a JOIN nation b ON abs(a.n_nationkey - b.n_nationkey) = 1""",
    "v_members": "SELECT c_mktsegment AS collection_id, 'C' || c_custkey AS object_id, (c_custkey % 10) / 10.0::DOUBLE AS strength FROM customer",
    "v_nation_members": "SELECT 'G' || (n_nationkey % 6) AS collection_id, 'N' || n_nationkey AS object_id, (n_nationkey % 4) / 4.0::DOUBLE AS strength FROM nation",
    "v_order_facts": "SELECT 'O' || o_orderkey AS object_id, 'customer' AS property, CAST(o_custkey AS VARCHAR) AS value FROM orders",
    "v_splits": """
  SELECT event_type, 'O' || k AS subject, 'O' || part AS component, strength FROM (
    SELECT 'SPLIT' AS event_type, o_orderkey AS k, o_orderkey + unnest([1, 2]) AS part, 0.9::DOUBLE AS strength FROM orders WHERE o_orderkey % 10 = 0
    UNION ALL SELECT 'MERGED', o_orderkey, o_orderkey - unnest([1, 2]), 0.8 FROM orders WHERE o_orderkey % 10 = 5)
  WHERE part IN (SELECT o_orderkey FROM orders)""",
}
_NEEDS = {"v_changes": ["v_long"], "v_facts": ["v_changes"]}


def with_views(sql: str) -> str:
    """The query with the views that it uses in front."""
    used: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, ()):
            add(n)
        if name not in used:
            used.append(name)

    import re

    for name in SQL:
        if re.search(rf"\b{name}\b", sql):
            add(name)
    recursive = "RECURSIVE " if "RECURSIVE" in sql else ""
    own = re.sub(r"^\s*WITH\s+(RECURSIVE\s+)?", "", sql) if re.match(r"\s*WITH\b", sql) else None
    head = ",\n".join(f"{n} AS ({SQL[n]})" for n in used)
    if own is not None:
        return f"WITH {recursive}{head},\n{own}" if head else sql
    return f"WITH {head}\n{sql}" if head else sql
