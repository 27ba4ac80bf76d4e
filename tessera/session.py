"""The facade: one object over a store, with the operations by name."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.temporal import history_mode
from .geometry import udfs
from .operators import aggregate, collections, equivalence, graph, merge, metrics, objects, relations, union
from .schema import Catalog, DatasetSchema
from .sources import sinks
from .sources.readers import Store


def _time(t: datetime | str | Column | None) -> Column:
    if t is None:
        return F.current_timestamp().cast("timestamp_ntz")
    return t if isinstance(t, Column) else F.lit(str(t)).cast("timestamp_ntz")


class Tessera:
    """Reads and writes the tables of a store. Every read is lazy; every write makes a new version."""

    def __init__(self, spark: SparkSession, path: str, strategy: merge.MergeStrategy = merge.MergeStrategy.CONTINUING, existence: merge.ExistenceStrategy = merge.ExistenceStrategy.DURING) -> None:
        self.spark, self.store, self.catalog = spark, Store(spark, path), Catalog()
        self.strategy, self.existence = strategy, existence

    def __getattr__(self, name: str) -> DataFrame:
        from .schema import TABLES

        if name in TABLES:
            return self.store.read(name)
        raise AttributeError(name)

    # --- datasets

    def register(self, schema: DatasetSchema, df: DataFrame) -> None:
        self.catalog.register(schema, df)

    def deregister(self, name: str) -> None:
        self.catalog.remove(name)

    def dataset_names(self) -> DataFrame:
        known = self.spark.createDataFrame([(n,) for n in self.catalog.names()], "class string")
        return objects.dataset_list(self.objects, known)

    def dataset_members(self, name: str) -> DataFrame:
        return objects.instances(self.objects, name)

    def dataset_properties(self, name: str) -> DataFrame:
        return objects.dataset_properties(self.objects, self.facts, name)

    def property_values(self, name: str, property_: str, n: int = 10) -> DataFrame:
        return objects.sample_values(self.objects, self.facts, name, property_, n)

    def search(self, needle: str, name: str | None = None, n: int = 10) -> DataFrame:
        return objects.search(self.objects, needle, name, n)

    def sql(self, text: str) -> DataFrame:
        self.store.register_views()
        return self.spark.sql(text)

    # --- reading

    def read(self, name: str, ids: Iterable[str] | DataFrame | None = None, valid=None, database=None) -> DataFrame:
        schema = self.catalog[name]
        properties = [f.property for f in schema.facts] + (["asWKT"] if schema.spatial else [])
        members = self.dataset_members(name)
        return objects.read_objects(self.facts.join(members, "object_id", "left_semi"), properties, _time(valid), _time(database), ids)

    def individual(self, ids: Iterable[str] | DataFrame) -> DataFrame:
        return objects.individual(self.facts, self.relations, self.events, ids)

    def header(self, name: str, ids) -> DataFrame:
        return objects.header(self.objects, name, ids)

    def fact_history(self, ids, property_: str, start=None, end=None, database=None, mode: str = "reference") -> DataFrame:
        own = objects.only(self.facts, "object_id", ids).where(F.col("property") == property_)
        if start is not None:
            own = own.where(history_mode(_time(start), None if end is None else _time(end), None if database is None else _time(database), mode))
        elif database is not None:
            own = own.where(F.col("db_from") >= _time(database))
        return own.select("object_id", "value", "valid_from", "valid_to", "valid_at").distinct()

    def intersect(self, name: str, wkt: str, buffer: float = 0.0, valid=None, database=None) -> DataFrame:
        """Ids of a dataset whose shape meets ``wkt``. Without a valid time all versions count."""
        from .functions.temporal import known_at, valid_within

        own = self.facts.where((F.col("property") == "asWKT") & known_at(_time(database)))
        own = own if valid is None else own.where(valid_within(_time(valid)))
        shaped = udfs.with_envelope(own.join(self.dataset_members(name), "object_id", "left_semi"), "value")
        return udfs.intersecting(shaped, "value", wkt, buffer).select("object_id").distinct()

    def intersect_objects(self, name: str, wkt: str, buffer: float = 0.0, valid=None, database=None) -> DataFrame:
        valid = _time(valid)
        return self.read(name, self.intersect(name, wkt, buffer, valid, database), valid, database)

    def related(self, relation: str, property_: str, valid=None, database=None) -> DataFrame:
        return relations.related_objects(self.relations, self.facts, relation, _time(valid), _time(database), property_)

    def equivalent(self, ids: Sequence[str], t: datetime) -> DataFrame:
        equals = self.relations.where(F.col("relation") == "EQUALS")
        return equivalence.equivalent_objects(self.objects, self.events, self.event_components, equals, ids, t)

    def compare(self, pairs: DataFrame, threshold: float = 0.9) -> DataFrame:
        """``a, b, a_wkt, b_wkt`` with the spatial report of each pair."""
        return pairs.withColumn("r", udfs.comparison(threshold)(F.col("a_wkt"), F.col("b_wkt"))).select("a", "b", "r.*")

    def shapes(self, name: str, ids, t, database=None) -> DataFrame:
        """``object_id, wkt, exists_from, exists_to`` of objects, each read at t moved into its lifetime."""
        members = objects.only(self.objects.where(F.col("class") == name), "object_id", ids)
        own = self.facts.where(F.col("property") == "asWKT")
        state = objects.facts_at_adjusted_time(own, members, _time(t), _time(database))
        lives = members.select("object_id", "exists_from", "exists_to")
        return state.join(lives, "object_id").select("object_id", F.col("value").alias("wkt"), "exists_from", "exists_to")

    def compare_ids(self, name: str, object_id: str, ids: Sequence[str], t, threshold: float = 0.9) -> DataFrame:
        """One object against several."""
        one = self.shapes(name, [object_id], t).select(F.col("object_id").alias("a"), F.col("wkt").alias("a_wkt"))
        others = self.shapes(name, ids, t).select(F.col("object_id").alias("b"), F.col("wkt").alias("b_wkt"))
        return self.compare(others.join(F.broadcast(one)), threshold)  # one row

    def relate_dataset(self, name: str, valid, buffer: float = 0.0, threshold: float = 0.9) -> None:
        """Spatial and temporal relations between all objects of a dataset whose envelopes meet, in one pass."""
        from .operators.spatial import spatio_temporal_relations

        shaped = udfs.with_envelope(self.shapes(name, None, valid), "wkt")
        report = spatio_temporal_relations(shaped.select("object_id", "xmin", "ymin", "xmax", "ymax", "exists_from", "exists_to"), buffer, threshold)
        step = self.store.step()
        step.stage("relations", relations.add_edges(self.relations, relations.report_edges(report)))
        step.stage("overlaps", relations.add_overlaps(self.overlaps, report))
        step.publish()

    def union_of_ids(self, name: str, ids: Sequence[str], t, threshold: float = 0.9) -> tuple[DataFrame, DataFrame]:
        """The best split or merge among objects, and what each contributes to their union."""
        own = self.shapes(name, ids, t).withColumn("group_id", F.lit("all"))
        return union.spatial_unions(own, threshold), union.contributions(own)

    def spatial_union(self, candidates: DataFrame, threshold: float = 0.9) -> DataFrame:
        return union.spatial_unions(candidates, threshold)

    def aggregate(self, name: str, where: aggregate.Operation | None = None, shape: str | None = None, op: aggregate.Operation | None = None) -> DataFrame:
        return aggregate.union_of(self.facts, aggregate.restricted(self.objects, self.facts, name, where, shape, op))

    def spatial_graph(self, nodes: DataFrame, compute, keep=None) -> DataFrame:
        return graph.spatial_graph(self.relations, nodes, compute, keep)

    # --- writing

    def write(self, name: str, df: DataFrame, database=None, database_end=None) -> None:
        """New objects are added; facts of known ones are merged."""
        schema = self.catalog[name]
        at = _time(database)
        parts = objects.decompose(df, schema, at, None if database_end is None else _time(database_end))
        known = self.objects.select("object_id")
        fresh = parts["objects"].join(known, "object_id", "left_anti")
        new_facts = parts["facts"].join(known, "object_id", "left_anti")
        again = parts["facts"].join(known, "object_id", "left_semi")
        own, facts = merge.merge(self.objects, self.facts, again, at, strategy=self.strategy, existence=self.existence)
        events = parts["events"].join(known, "object_id", "left_anti")
        step = self.store.step()
        stored = step.stage("facts", facts.unionByName(new_facts))
        lives = step.stage("objects", own.unionByName(fresh))
        step.stage("events", relations.adjust_events(self.events.unionByName(events), lives))
        linked = [f.property for f in schema.facts if f.related]
        edges = parts.get("relations", self.relations.limit(0))
        for p in linked:
            shared = relations.contributes_to(stored, p, parts["objects"].select("object_id"))
            edges = edges.unionByName(shared).unionByName(shared.select(F.col("object").alias("subject"), "relation", F.col("subject").alias("object")))
        if "relations" in parts or linked:
            step.stage("relations", relations.add_edges(self.relations, edges))
        step.stage("datasets", self.datasets.unionByName(self.spark.createDataFrame([(name, "Dataset")], "class string, parent string")).distinct())
        step.publish()

    def add_facts(self, incoming: DataFrame, datatypes: dict[str, str], database=None) -> None:
        own, facts = merge.add_facts(self.objects, self.facts, incoming, datatypes, _time(database), strategy=self.strategy, existence=self.existence)
        step = self.store.step()
        step.stage("facts", facts)
        step.stage("objects", own)
        step.publish()

    def relate(self, edges: DataFrame) -> None:
        self.store.write("relations", relations.add_edges(self.relations, edges))

    def add_changes(self, changes: DataFrame) -> None:
        """Splits and merges; raises if a split subject has no end."""
        if not relations.undated_changes(self.objects, changes).isEmpty():
            raise ValueError("a split's subject has no end")
        events, parts, edges = relations.split_merge_events(self.objects, changes)
        step = self.store.step()
        step.stage("events", self.events.unionByName(events).dropDuplicates(["event_id"]))
        step.stage("event_components", self.event_components.unionByName(parts).distinct())
        step.stage("relations", relations.add_edges(self.relations, edges))
        step.publish()

    def infer(self, rules: relations.Rules | None = None) -> None:
        self.store.write("relations", relations.closure(self.relations, rules))

    def remove(self, ids: DataFrame) -> None:
        names = ("objects", "facts", "events", "event_components", "relations", "overlaps", "collection_members")
        left = objects.remove({n: self.store.read(n) for n in names}, ids)
        step = self.store.step()
        for n in names:
            step.stage(n, left[n])
        step.publish()

    def add_to_collection(self, new: DataFrame) -> None:
        self.store.write("collection_members", collections.add(self.collection_members, new))

    # --- export

    def export(self, name: str, ids, kind: str, valid=None, database=None) -> str | bytes:
        """Objects as of two times in a geographic format; those without a state then are left out."""
        schema = self.catalog[name]
        rows = self.read(name, ids, valid, database)
        return sinks.export(rows.withColumn("asWKT", F.regexp_replace("asWKT", r"^<[^>]*>\s*", "")), kind, "object_id", "asWKT", [f.property for f in schema.facts])

    def metrics_series(self) -> DataFrame:
        return metrics.series(self.metrics, self.gauges, self.counters)
