"""Edges between objects: relation vocabulary, lookups, events and materialised rules."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import StrEnum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import event_id
from ..functions.temporal import as_of
from ..schema import TABLES

#: Relation names and the super-property each belongs to.
TEMPORAL = "BEFORE AFTER DURING STARTS STARTED_BY FINISHES FINISHED_BY TEMPORAL_MEETS MET_BY TEMPORAL_OVERLAPS".split()
SPATIAL = "EQUALS SPATIAL_EQUALS SPATIAL_MEETS SPATIAL_OVERLAPS CONTAINS INSIDE COVERS COVERED_BY DISJOINT".split()
EVENT = "SPLIT_FROM SPLIT_INTO MERGED_FROM MERGED_INTO".split()
COMPONENT = "COMPONENT_OF HAS_COMPONENT".split()
SUPERS = {"Temporal_Relation": TEMPORAL, "Spatial_Relation": SPATIAL, "Event_Relation": EVENT, "Component_Relation": COMPONENT}
#: Names of the vocabulary's other spelling.
ALIASES = {"meets": "SPATIAL_MEETS", "equal": "SPATIAL_EQUALS", "overlaps": "SPATIAL_OVERLAPS"}

#: The axioms of the vocabulary, from here to DISJOINT_CLASSES.
INVERSE = {
    "AFTER": "BEFORE", "ASPECT_OF": "HAS_ASPECT", "BEGINS": "ENDS", "COMPONENT_OF": "HAS_COMPONENT", "CONCEPT_OF": "HAS_CONCEPT",
    "CONTAINS": "INSIDE", "COVERS": "COVERED_BY", "FACET_OF": "HAS_FACET", "FACT_OF": "HAS_FACT", "HAS_OVERLAP": "OVERLAP_OF",
    "HAS_RELATION": "RELATION_OF", "MERGE_OF": "MERGED", "MERGED_FROM": "MERGED_INTO", "RELATED_BY": "RELATED_TO", "SPLIT": "SPLIT_OF",
    "SPLIT_FROM": "SPLIT_INTO", "STARTS": "STARTED_BY", "FINISHES": "FINISHED_BY", "TEMPORAL_MEETS": "MET_BY",
}
SYMMETRIC = frozenset("DISJOINT SPATIAL_EQUALS EQUALS SPATIAL_MEETS TEMPORAL_OVERLAPS SPATIAL_OVERLAPS".split())
TRANSITIVE = frozenset("AFTER BEFORE CONTAINS DURING SPATIAL_EQUALS EQUALS INSIDE".split())
ASYMMETRIC = frozenset("BEGINS ENDS".split())
SUB = {"MERGED": "EQUALS", "SPLIT": "EQUALS", "MERGE_OF": "EQUALS", "SPLIT_OF": "EQUALS"} | {r: s for s, rs in SUPERS.items() for r in rs}
CHAINS = (
    ("AFTER", "DURING", "AFTER"),
    ("BEFORE", "DURING", "BEFORE"),
    ("BEGINS", "BEFORE", "BEFORE"),
    ("COMPONENT_OF", "MERGE_OF", "MERGED_INTO"),
    ("DURING", "AFTER", "AFTER"),
    ("ENDS", "AFTER", "AFTER"),
    ("EQUALS", "HAS_COMPONENT", "CONTAINS"),
    ("HAS_RELATION", "RELATED_TO", "HAS_CONCEPT"),
    ("TEMPORAL_OVERLAPS", "TEMPORAL_OVERLAPS", "SPATIAL_OVERLAPS"),
    ("RELATED_BY", "RELATION_OF", "CONCEPT_OF"),
    ("SPLIT", "HAS_COMPONENT", "SPLIT_INTO"),
)
SUBCLASSES = {
    "AttributeFact": "Fact", "Became_Event": "Event", "Created_Event": "Event", "Database_Object": "Temporal_Object", "Destroyed_Event": "Event",
    "Exists_Object": "Temporal_Object", "GAUL": "Dataset", "Interval_Object": "Temporal_Object", "Merged_Event": "Event", "Point_Object": "Temporal_Object",
    "RasterFact": "SpatialFact", "SpatialFact": "Fact", "Spatial_Overlap": "Overlap", "Split_Event": "Event", "Temporal_Overlap": "Overlap",
    "Valid_Object": "Temporal_Object", "VectorFact": "SpatialFact",
}
DOMAINS = {
    "Temporal_Relation": "Object", "COMPONENT_OF": "Object", "CONCEPT_OF": "Concept", "HAS_CONCEPT": "Object", "HAS_FACT": "Object", "HAS_RELATION": "Object",
    "MERGE_OF": "Merged_Event", "OVERLAP_OF": "Overlap", "RELATED_TO": "Relation", "RELATION_OF": "Relation", "SPLIT_OF": "Split_Event",
}
RANGES = {
    "Temporal_Relation": "Object", "BECAME": "Became_Event", "COMPONENT_OF": "SpatialUnion", "CONCEPT_OF": "Object", "CREATED": "Created_Event",
    "DESTROYED": "Destroyed_Event", "FACET_OF": "Dataset", "HAS_CONCEPT": "Concept", "HAS_FACT": "Fact", "HAS_RELATION": "Relation", "OVERLAP_OF": "Object",
    "RELATED_TO": "Concept", "RELATION_OF": "Object",
}
DISJOINT_CLASSES = (("AttributeFact", "SpatialFact"), ("Exists_Object", "Valid_Object"))


class EventType(StrEnum):
    CREATED = "CREATED"
    DESTROYED = "DESTROYED"
    BECAME = "BECAME"
    SPLIT = "SPLIT"
    MERGED = "MERGED"


@dataclass(frozen=True)
class Rules:
    """A rule set; ``strict`` makes DURING symmetric too, which contradicts its meaning."""

    sub: dict[str, str] = field(default_factory=lambda: dict(SUB))
    inverse: dict[str, str] = field(default_factory=lambda: dict(INVERSE))
    symmetric: frozenset[str] = SYMMETRIC
    transitive: frozenset[str] = TRANSITIVE
    chains: tuple[tuple[str, str, str], ...] = CHAINS
    strict: bool = False

    @property
    def pairs(self) -> list[tuple[str, str]]:
        """relation, relation of the swapped edge."""
        both = [*self.inverse.items(), *((b, a) for a, b in self.inverse.items())]
        return both + [(r, r) for r in sorted(self.symmetric | ({"DURING"} if self.strict else set()))]


def _lookup(df: DataFrame, pairs: list[tuple[str, str]], column: str) -> Column:
    """The partner of a relation name; the vocabulary is a literal, so no join is needed."""
    return F.create_map(*[F.lit(x) for p in dict(pairs).items() for x in p])[F.col(column)] if pairs else F.lit(None).cast("string")


def add_edges(relations: DataFrame, new: DataFrame) -> DataFrame:
    return relations.unionByName(new.select("subject", "relation", "object")).distinct()


def inverses(relations: DataFrame, rules: Rules | None = None) -> DataFrame:
    rules = rules or Rules()
    swapped = relations.select(F.col("object").alias("subject"), _lookup(relations, rules.pairs, "relation").alias("relation"), F.col("subject").alias("object"))
    return swapped.where(F.col("relation").isNotNull())


def supers(relations: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Edges by all super-properties, at most three levels up."""
    rules = rules or Rules()
    if not rules.sub:
        return relations.select("subject", "relation", "object").limit(0)
    up = {r: [] for r in rules.sub}
    for r in up:
        s = rules.sub.get(r)
        while s is not None and s not in up[r]:
            up[r].append(s)
            s = rules.sub.get(s)
    table = F.create_map(*[x for r, ss in up.items() for x in (F.lit(r), F.array(*[F.lit(s) for s in ss]))])
    return relations.select("subject", F.explode(table[F.col("relation")]).alias("relation"), "object")


def chained(left: DataFrame, right: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Edges that a transitive relation or a property chain makes of one edge of each side."""
    rules = rules or Rules()
    steps = [(r, r, r) for r in sorted(rules.transitive)] + list(rules.chains)
    made = {}
    for a, b, c in steps:
        made.setdefault(a, []).append((b, c))
    known = sorted(made)
    table = F.create_map(
        *[x for a in known for x in (F.lit(a), F.array(*[F.struct(F.lit(b).alias("second"), F.lit(c).alias("result")) for b, c in made[a]]))]
    )
    l = left.where(F.col("relation").isin(known)).select("subject", F.col("object").alias("_mid"), F.inline(table[F.col("relation")]))  # noqa: E741
    seconds = sorted({b for _, b, _ in steps})
    r = right.where(F.col("relation").isin(seconds)).select(F.col("subject").alias("_mid"), F.col("relation").alias("second"), "object")
    return l.join(r, ["_mid", "second"]).select("subject", F.col("result").alias("relation"), "object")


def closure(relations: DataFrame, rules: Rules | None = None, max_rounds: int = 50) -> DataFrame:
    """All edges that the rules imply: semi-naive, each round joins only new edges. The edges
    of each round are checkpointed, so the plan stays short and a lost executor costs a round."""
    rules = rules or Rules()
    spark = relations.sparkSession
    keep = checkpointer(spark)
    every = keep(relations.select("subject", "relation", "object").distinct())
    new = every
    for _ in range(max_rounds):
        found = (
            inverses(new, rules)
            .unionByName(supers(new, rules))
            .unionByName(chained(new, every, rules))
            .unionByName(chained(every, new, rules))
            .where(F.col("subject") != F.col("object"))
            .distinct()
        )
        new = keep(found.join(every, ["subject", "relation", "object"], "left_anti"))
        if new.isEmpty():
            return every
        every = every.unionByName(new)  # both are checkpointed: nothing is written again
    raise RuntimeError("the rules did not reach a fixpoint")


def checkpointer(spark):
    """A function that writes a DataFrame to the folder that ``spark.checkpoint.dir`` names and cuts its lineage.
    Only in local mode, where there is one machine, a temporary folder may stand for it."""
    import tempfile

    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tessera-"))
    return lambda df: df.checkpoint(eager=True)


def _above(name: str, parents: dict[str, str]) -> list[str]:
    found: list[str] = []
    while (up := parents.get(name)) is not None and up not in found:
        found.append(up)
        name = up
    return found


def _listed(table: dict[str, list[str]], column: str) -> Column:
    """What a literal table lists for a name; nothing for others."""
    pairs = [x for k, v in table.items() if v for x in (F.lit(k), F.array(*map(F.lit, v)))]
    return F.coalesce(F.create_map(*pairs)[F.col(column)], F.array().cast("array<string>"))


def types(objects: DataFrame, facts: DataFrame, relations: DataFrame) -> DataFrame:
    """``id, class``: stated classes, their superclasses, and what domains and ranges (also those of
    super-properties) and the temporal columns imply."""
    stated = objects.select(F.col("object_id").alias("id"), "class")
    names = {*DOMAINS, *RANGES, *SUB}
    implied = lambda table: {r: sorted({table[p] for p in (r, *_above(r, SUB)) if p in table}) for r in names}
    ends = relations.select(F.col("subject").alias("id"), F.explode(_listed(implied(DOMAINS), "relation")).alias("class")).unionByName(
        relations.select(F.col("object").alias("id"), F.explode(_listed(implied(RANGES), "relation")).alias("class"))
    )
    spans = objects.select(
        F.col("object_id").alias("id"), F.when(F.col("exists_at").isNotNull(), "Point_Object").when(F.col("exists_from").isNotNull(), "Interval_Object").alias("class")
    )
    direct = stated.unionByName(ends).unionByName(spans).where(F.col("class").isNotNull())
    supers_ = _listed({c: _above(c, SUBCLASSES) for c in SUBCLASSES}, "class")
    return direct.unionByName(direct.select("id", F.explode(supers_).alias("class"))).distinct()


def disjoint_violations(typed: DataFrame) -> DataFrame:
    """``id, class, other``: things of two classes that have nothing in common."""
    own = sorted({c for pair in DISJOINT_CLASSES for c in pair})
    sets = typed.where(F.col("class").isin(own)).groupBy("id").agg(F.collect_set("class").alias("own"))
    pairs = F.array(*[F.struct(F.lit(a).alias("class"), F.lit(b).alias("other")) for a, b in DISJOINT_CLASSES])
    both = F.filter(pairs, lambda p: F.array_contains(F.col("own"), p["class"]) & F.array_contains(F.col("own"), p["other"]))
    return sets.select("id", F.inline(both))


def violations(relations: DataFrame) -> DataFrame:
    """Pairs linked both ways by a relation that is asymmetric."""
    own = relations.where(F.col("relation").isin(sorted(ASYMMETRIC)))
    back = own.select(F.col("object").alias("subject"), "relation", F.col("subject").alias("object"))
    return own.join(back, ["subject", "relation", "object"], "left_semi")


def individual_relations(relations: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Temporal, spatial, event and component edges of individuals, without the super-properties
    and without edges to themselves."""
    from .objects import only

    concrete = sorted({r for rs in SUPERS.values() for r in rs})
    own = relations.where(F.col("relation").isin(concrete) & (F.col("subject") != F.col("object")))
    return only(own.withColumnRenamed("subject", "object_id"), "object_id", ids).select(F.col("object_id").alias("subject"), "relation", "object").distinct()


def individual_events(events: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    from .objects import only

    return only(events.where(F.col("event_type") != "Event"), "object_id", ids).select("object_id", "event_type", "at").distinct()


def related_objects(relations: DataFrame, facts: DataFrame, relation: str, valid: Column, database: Column, property_: str) -> DataFrame:
    """Objects linked by a relation with a property's value as of two instants."""
    state = facts.where((F.col("property") == property_) & as_of(valid, database)).select(F.col("object_id").alias("object"), "value")
    return relations.where(F.col("relation") == relation).join(state, "object").select("subject", "object", "value")


def contributes_to(facts: DataFrame, property_: str, ids: DataFrame | None = None) -> DataFrame:
    """Edges of the given individuals to every one with the same literal, oneself included. Without ids it is
    all of them, and a literal that many share gives as many edges as it has pairs."""
    from .objects import only

    every = facts.where(F.col("property") == property_).select("object_id", "value").distinct()
    own = only(every, "object_id", ids)
    other = every.select(F.col("object_id").alias("object"), "value")
    return own.join(other, "value").select(F.col("object_id").alias("subject"), F.lit("CONTRIBUTES_TO").alias("relation"), "object")


def concept_relations(members: DataFrame, classes: DataFrame, strength: float, ids: DataFrame | None = None) -> DataFrame:
    """Individuals of one class that share a concept with at least the given strength: the partners of the
    given ones, or all pairs."""
    from .objects import only

    every = members.where(F.col("strength") >= strength).select("collection_id", "object_id").join(classes, "object_id")
    own = only(every, "object_id", ids)
    other = every.select("collection_id", "class", F.col("object_id").alias("object"))
    pairs = own.join(other, ["collection_id", "class"]).where(F.col("object_id") != F.col("object"))
    return pairs.select(F.col("object_id").alias("subject"), "object").distinct()


def split_merge_events(objects: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Events, components and edges of splits and merges. ``changes``: event_type, subject, component,
    strength. A split happens at the subject's end, a merge at its start; ``changes`` whose subject
    has no such time are left out: see ``undated_changes``."""
    life = objects.select(F.col("object_id").alias("subject"), "exists_from", "exists_to", "exists_at")
    at = F.coalesce(F.when(F.col("event_type") == "SPLIT", F.col("exists_to")).when(F.col("event_type") == "MERGED", F.col("exists_from")), F.col("exists_at"))
    dated = changes.where(F.col("event_type").isin("SPLIT", "MERGED")).join(life, "subject").withColumn("at", at).where(F.col("at").isNotNull())
    name = event_id(F.col("subject"), F.lower("event_type"))
    events = dated.groupBy(name.alias("event_id"), F.col("subject").alias("object_id"), "event_type", "at").agg(F.max("strength").alias("strength"))
    components = dated.select(name.alias("event_id"), F.col("component").alias("object_id")).distinct()
    edges = events.select(F.col("object_id").alias("subject"), F.col("event_type").alias("relation"), F.col("event_id").alias("object")).unionByName(
        components.select(F.col("object_id").alias("subject"), F.lit("COMPONENT_OF").alias("relation"), F.col("event_id").alias("object"))
    )
    return events, components, edges


def undated_changes(objects: DataFrame, changes: DataFrame) -> DataFrame:
    life = objects.select(F.col("object_id").alias("subject"), "exists_to", "exists_at")
    return changes.where(F.col("event_type") == "SPLIT").join(life, "subject").where(F.col("exists_to").isNull() & F.col("exists_at").isNull()).select(*changes.columns)


def add_event(events: DataFrame, new: DataFrame) -> DataFrame:
    """Only CREATED and DESTROYED can be added alone."""
    if not new.where(~F.col("event_type").isin("CREATED", "DESTROYED")).isEmpty():
        raise ValueError("only CREATED and DESTROYED events can be added alone")
    return events.unionByName(new.select(*TABLES["events"].names)).dropDuplicates(["event_id"])


def adjust_events(events: DataFrame, objects: DataFrame) -> DataFrame:
    """CREATED and DESTROYED moved to the bounds of the lifetimes as they are now."""
    life = objects.select("object_id", "exists_from", "exists_to")
    at = F.when(F.col("event_type") == "CREATED", F.coalesce("exists_from", "at")).when(F.col("event_type") == "DESTROYED", F.coalesce("exists_to", "at")).otherwise(F.col("at"))
    return events.join(life, "object_id", "left").withColumn("at", at).select(*TABLES["events"].names)


def add_overlaps(overlaps: DataFrame, report: DataFrame) -> DataFrame:
    """Reified overlaps of a spatial report (a, b, overlap, overlap_wkt), one for each ordered pair. Further columns that
    both have come along. The report is asked for the stored ids, so that its many rows need no shuffle."""
    names = TABLES["overlaps"].names
    more = [c for c in overlaps.columns if c in report.columns and c not in names]
    name = F.concat_ws(":", F.lit("overlap"), "a", "b")
    new = report.where(F.col("overlap_wkt").isNotNull()).select(name.alias("overlap_id"), "a", "b", F.col("overlap_wkt").alias("wkt"), F.col("overlap").alias("pct"), *more)
    replaced = new.select("overlap_id").join(overlaps.select("overlap_id"), "overlap_id", "left_semi")
    return overlaps.join(replaced, "overlap_id", "left_anti").select(*names, *more).unionByName(new)


def report_edges(report: DataFrame) -> DataFrame:
    """Edges of a spatial and temporal report: equality, the spatial and the temporal relation."""
    names = F.array_compact(F.array(F.when(F.col("equality").isNotNull(), F.lit("SPATIAL_EQUALS")), "relation", "temporal"))
    return report.select(F.col("a").alias("subject"), F.explode(names).alias("relation"), F.col("b").alias("object")).distinct()


def orphans(objects: DataFrame, relations: DataFrame, order: list[str]) -> DataFrame:
    """Objects without any split or merge, in order."""
    changed = relations.where(F.col("relation").contains("SPLIT") | F.col("relation").contains("MERGE")).select(F.col("subject").alias("object_id")).distinct()
    return objects.join(changed, "object_id", "left_anti").orderBy(*order)
