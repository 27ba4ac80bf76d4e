"""Reading objects and facts, and writing, removing and updating them as whole-table steps."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identifiers import event_id
from ..functions.temporal import Span, adjusted, as_of
from ..schema import TABLES, DatasetSchema, datatype_of, typed

COMPARISONS = {
    "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
}


def only(df: DataFrame, column: str, ids: Iterable[str] | DataFrame | None) -> DataFrame:
    """Rows whose ``column`` is among ids: a literal list, or a DataFrame's first column."""
    if ids is None:
        return df
    if isinstance(ids, DataFrame):
        return df.join(ids.select(F.col(ids.columns[0]).alias(column)).distinct(), column, "left_semi")
    return df.where(F.col(column).isin(list(ids)))


# --- scans -------------------------------------------------------------------------------


def triples(objects: DataFrame, facts: DataFrame, relations: DataFrame) -> DataFrame:
    """Everything as subject, predicate, object."""
    return (
        objects.select(F.col("object_id").alias("subject"), F.lit("type").alias("predicate"), F.col("class").alias("object"))
        .unionByName(facts.select(F.col("object_id").alias("subject"), F.col("property").alias("predicate"), F.col("value").alias("object")))
        .unionByName(relations.select("subject", F.col("relation").alias("predicate"), "object"))
    )


def match(statements: DataFrame, subject: str | None = None, predicate: str | None = None, object_: str | None = None) -> DataFrame:
    for name, value in (("subject", subject), ("predicate", predicate), ("object", object_)):
        if value is not None:
            statements = statements.where(F.col(name) == value)
    return statements


def instances(objects: DataFrame, class_: str, datasets: DataFrame | None = None) -> DataFrame:
    """Ids of a class; with ``datasets`` (class, parent) also of its subclasses."""
    if datasets is None:
        return objects.where(F.col("class") == class_).select("object_id")
    below = datasets.where(F.col("parent") == class_).select("class").distinct()
    direct = objects.where(F.col("class") == class_)
    return direct.unionByName(objects.where(F.col("class") != class_).join(below, "class", "left_semi").select(*objects.columns)).select("object_id")


def dataset_list(objects: DataFrame, registered: DataFrame) -> DataFrame:
    """Registered classes that have objects."""
    return registered.select("class").distinct().join(objects.select("class").distinct(), "class", "left_semi")


def dataset_properties(objects: DataFrame, facts: DataFrame, class_: str) -> DataFrame:
    ids = objects.where(F.col("class") == class_).select("object_id")
    return facts.join(ids, "object_id", "left_semi").select("property").distinct().orderBy("property")


def data_properties(facts: DataFrame, ids: Iterable[str] | DataFrame, properties: Sequence[str] | None = None) -> DataFrame:
    found = only(facts, "object_id", ids)
    if properties is not None:
        found = found.where(F.col("property").isin(list(properties)))
    return found.select("object_id", "property", "value", "datatype", "lang")


def object_properties(relations: DataFrame, ids: Iterable[str] | DataFrame, relation: str | None = None) -> DataFrame:
    found = only(relations.withColumnRenamed("subject", "object_id"), "object_id", ids).withColumnRenamed("object_id", "subject")
    return (found if relation is None else found.where(F.col("relation") == relation)).select("subject", "relation", "object")


def contains_resource(statements: DataFrame, subject: str) -> bool:
    return not statements.where(F.col("subject") == subject).limit(1).isEmpty()


# --- facts and objects ---------------------------------------------------------------------


def facts_as_of(
    facts: DataFrame,
    valid: Column,
    database: Column,
    ids: Iterable[str] | DataFrame | None = None,
    properties: Sequence[str] | None = None,
    distinct: bool = False,
) -> DataFrame:
    """Facts of objects as of two instants: a filter, without a shuffle. Facts are kept unique when they are
    written; ``distinct`` is for tables that weren't."""
    found = only(facts, "object_id", ids)
    if properties is not None:
        found = found.where(F.col("property").isin(list(properties)))
    found = found.where(as_of(valid, database))
    return found.distinct() if distinct else found


def temporal_properties(properties: DataFrame, hierarchy: DataFrame, include: bool) -> DataFrame:
    """Rows whose property is (not) below Temporal_Property in ``hierarchy`` (property, ancestor)."""
    below = hierarchy.where(F.col("ancestor") == "Temporal_Property").select("property").distinct()
    return properties.join(below, "property", "left_semi" if include else "left_anti")


def read_objects(
    facts: DataFrame, properties: Sequence[str], valid: Column, database: Column, ids: Iterable[str] | DataFrame | None = None, complete: bool = True
) -> DataFrame:
    """One row for each object with a column for each property. ``complete`` drops objects
    that lack one of them: they have no valid state at that time."""
    current = facts_as_of(facts, valid, database, ids, properties)
    # aggregates by condition: one pass, no pivot job to list the values
    wide = current.groupBy("object_id").agg(*[F.min(F.when(F.col("property") == p, F.col("value"))).alias(p) for p in properties])
    return wide.dropna(subset=list(properties)) if complete else wide


def state_window(facts: DataFrame, valid: Column, database: Column, ids=None) -> DataFrame:
    """How long each object's state holds: the latest start and the earliest end of its facts."""
    return (
        facts_as_of(facts, valid, database, ids)
        .groupBy("object_id")
        .agg(
            F.max("valid_from").alias("valid_from"),
            F.min("valid_to").alias("valid_to"),  # an open end is the largest: ignored unless all are
            F.max("db_from").alias("db_from"),
            F.min("db_to").alias("db_to"),
        )
    )


def with_linked(objects: DataFrame, relations: DataFrame, linked: DataFrame, relation: str, name: str) -> DataFrame:
    """Nested objects: an array of the structs of the objects that ``relation`` links."""
    nested = (
        relations.where(F.col("relation") == relation)
        .join(linked.select(F.col("object_id").alias("object"), F.struct(*linked.columns).alias("_nested")), "object")
        .groupBy(F.col("subject").alias("object_id"))
        .agg(F.array_sort(F.collect_list("_nested")).alias(name))
    )
    return objects.join(nested, "object_id", "left")


def header(objects: DataFrame, class_: str, ids) -> DataFrame:
    return (
        only(objects.where(F.col("class") == class_), "object_id", ids)
        .groupBy("object_id")
        .agg(F.min(F.struct("exists_from", "exists_to")).alias("h"))
        .select("object_id", "h.exists_from", "h.exists_to")
    )


def existence(objects: DataFrame, ids) -> DataFrame:
    return only(objects, "object_id", ids).select("object_id", "exists_at", "exists_from", "exists_to")


def individual(facts: DataFrame, relations: DataFrame, events: DataFrame, ids=None) -> DataFrame:
    """All facts at all times, relations and events of each object."""
    f = only(facts, "object_id", ids).groupBy("object_id").agg(
        F.array_sort(F.collect_list(F.struct("property", "valid_from", "db_from", "value", "valid_to", "db_to"))).alias("facts")
    )
    r = only(relations.withColumnRenamed("subject", "object_id"), "object_id", ids).groupBy("object_id").agg(
        F.array_sort(F.collect_set(F.struct("relation", "object"))).alias("relations")
    )
    e = only(events, "object_id", ids).groupBy("object_id").agg(F.array_sort(F.collect_set(F.struct("event_type", "at"))).alias("events"))
    return f.join(r, "object_id", "full").join(e, "object_id", "full")


def sample_values(objects: DataFrame, facts: DataFrame, class_: str, property_: str, n: int) -> DataFrame:
    """The first n distinct values of a property, in order."""
    ids = objects.where(F.col("class") == class_).select("object_id")
    own = facts.where(F.col("property") == property_).join(ids, "object_id", "left_semi")
    return own.select("value").distinct().orderBy("value").limit(n)


def search(objects: DataFrame, needle: str, class_: str | None = None, n: int = 10) -> DataFrame:
    """The first n ids that contain the needle; ids are lower-cased, the needle is not."""
    found = objects if class_ is None else objects.where(F.col("class") == class_)
    return found.where(F.lower("object_id").contains(needle)).select("object_id").distinct().orderBy("object_id").limit(n)


def having(facts: DataFrame, property_: str, value: str) -> DataFrame:
    return facts.where((F.col("property") == property_) & (F.col("value") == value)).select("object_id").distinct()


def comparing(facts: DataFrame, property_: str, op: str, value, ids: DataFrame | None = None, datatype: str = "xsd:double") -> DataFrame:
    """Objects with a typed value of the property in the given relation to ``value``."""
    own = facts.where(F.col("property") == property_)
    own = own if ids is None else own.join(ids, "object_id", "left_semi")
    return own.where(COMPARISONS[op](typed(F.col("value"), datatype), F.lit(value))).select("object_id").distinct()


def existing(objects: DataFrame, op: str, start: Column, least_end: Column) -> DataFrame:
    """Objects whose lifetime begins in relation ``op`` to start and has not ended before ``least_end``."""
    keep = COMPARISONS[op](F.col("exists_from"), start) & (F.col("exists_to").isNull() | (F.col("exists_to") >= least_end))
    return objects.where(keep).select("object_id", "exists_from", "exists_to")


def at_adjusted_time(objects: DataFrame, t: Column, unit: str = "1 MICROSECOND") -> DataFrame:
    """Each object's time of reading: t moved into its lifetime."""
    at = F.when(F.col("exists_at").isNotNull(), F.col("exists_at")).otherwise(adjusted(Span.of("exists"), t, unit))
    return objects.select("object_id", at.alias("read_at"))


def facts_at_adjusted_time(facts: DataFrame, objects: DataFrame, t: Column, database: Column) -> DataFrame:
    """Facts of each object at its own adjusted time."""
    return facts.join(at_adjusted_time(objects, t), "object_id").where(as_of(F.col("read_at"), database))


# --- writing -----------------------------------------------------------------------------


def decompose(df: DataFrame, schema: DatasetSchema, database: Column, database_end: Column | None = None) -> dict[str, DataFrame]:
    """Rows of a registered dataset as new objects, facts, relations and events."""
    schema.validate(df.columns)
    start, end, at = schema.lifetime()
    rows = df.withColumns({"_id": F.col(schema.identifier).cast("string"), "_from": start, "_to": end, "_at": at})
    objects = rows.select(
        F.col("_id").alias("object_id"), F.lit(schema.name).alias("class"), F.col("_from").alias("exists_from"), F.col("_to").alias("exists_to"), F.col("_at").alias("exists_at")
    ).distinct()
    members = []
    for f in schema.facts:
        kind = f.datatype or datatype_of(df.schema[f.column].dataType)
        lang = (f.language or schema.default_language) if kind in ("xsd:string", "rdf:langString") else None
        members.append((f.property, F.col(f.column).cast("string"), "rdf:langString" if lang else kind, lang))
    if schema.spatial:
        members.append(("asWKT", F.concat(F.lit(f"<http://www.opengis.net/def/crs/EPSG/0/{schema.srid}> "), F.col(schema.spatial)), "geosparql:wktLiteral", None))
    structs = [
        F.struct(F.lit(p).alias("property"), v.alias("value"), F.lit(k).alias("datatype"), F.lit(lang).cast("string").alias("lang")) for p, v, k, lang in members
    ]
    none = F.lit(None).cast("timestamp_ntz")
    facts = (
        rows.select("_id", "_from", "_to", "_at", F.inline(F.array(*structs)))
        .where(F.col("value").isNotNull())
        .select(
            F.col("_id").alias("object_id"),
            "property",
            "value",
            "datatype",
            "lang",
            F.col("_from").alias("valid_from"),
            F.col("_to").alias("valid_to"),
            F.col("_at").alias("valid_at"),
            database.alias("db_from"),
            (none if database_end is None else database_end).alias("db_to"),
        )
        .distinct()
    )
    edges = [
        rows.where(F.col(c).isNotNull()).select(F.col("_id").alias("subject"), F.lit(r).alias("relation"), F.col(c).cast("string").alias("object"))
        for c, r in schema.links.items()
    ]
    out = {"objects": objects, "facts": facts, "events": lifecycle_events(objects)}
    if edges:
        for e in edges[1:]:
            edges[0] = edges[0].unionByName(e)
        out["relations"] = edges[0].distinct()
    return out


def lifecycle_events(objects: DataFrame) -> DataFrame:
    """CREATED at the start of each lifetime, DESTROYED at its end if it has one."""
    born, died = F.coalesce("exists_from", "exists_at"), F.coalesce("exists_to", "exists_at")
    rows = objects.select(
        "object_id",
        F.inline(F.array(F.struct(F.lit("CREATED").alias("event_type"), born.alias("at")), F.struct(F.lit("DESTROYED").alias("event_type"), died.alias("at")))),
    ).where(F.col("at").isNotNull())
    return rows.select(event_id(F.col("object_id"), F.lower("event_type")).alias("event_id"), "object_id", "event_type", "at", F.lit(None).cast("double").alias("strength"))


def remove(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """All tables without the objects and what belongs to them."""
    gone = ids.select(F.col(ids.columns[0]).alias("_gone")).distinct()
    keys = {"objects": ["object_id"], "facts": ["object_id"], "events": ["object_id"], "event_components": ["object_id"], "relations": ["subject", "object"], "overlaps": ["a", "b"], "collection_members": ["object_id"]}
    out = {}
    for name, df in tables.items():
        for k in keys.get(name, ()):
            df = df.join(gone, df[k] == gone["_gone"], "left_anti")
        out[name] = df
    return out


def update_properties(facts: DataFrame, changes: DataFrame) -> DataFrame:
    """Replace values: ``changes`` has object_id, property and value, one row for each pair."""
    new = changes.select(F.col("object_id").alias("_o"), F.col("property").alias("_p"), F.col("value").alias("_v"))
    hit = (F.col("object_id") == F.col("_o")) & (F.col("property") == F.col("_p"))
    return facts.join(new, hit, "left").withColumn("value", F.when(F.col("_o").isNotNull(), F.col("_v")).otherwise(F.col("value"))).select(*TABLES["facts"].names)


def sequence_of(facts: DataFrame) -> DataFrame:
    """Versions of each property in order, with a number from 1."""
    w = Window.partitionBy("object_id", "property").orderBy("valid_from", "db_from")
    return facts.withColumn("version", F.row_number().over(w))
