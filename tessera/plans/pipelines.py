"""Multi-step jobs: regional integration, zone change, county population, case counts, analyses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import geoid
from ..geometry import udfs
from ..operators import graph, merge, spatial

#: The countries that the regional integration takes by default.
COUNTRIES = (6, 29, 49, 59, 68, 74, 170, 182, 253)
#: Census region and division codes.
REGIONS = {"1": "Northeast", "2": "Midwest", "3": "South", "4": "West"}
DIVISIONS = {
    "1": "New England", "2": "Middle Atlantic", "3": "East North Central", "4": "West North Central", "5": "South Atlantic",
    "6": "East South Central", "7": "West South Central", "8": "Mountain", "9": "Pacific",
}


def _coded(column: Column, table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for p in table.items() for x in p])[column.cast("string")]


def region_filter(rows: DataFrame, countries: tuple[int, ...] = COUNTRIES, code: int | None = None) -> DataFrame:
    """Undisputed regions of the countries, or one code, with their lifetime: January of the first
    year to January after the last."""
    keep = F.col("code") == code if code is not None else (F.col("disputed") == "NO") & F.col("country").isin(*countries)
    return rows.where(keep).withColumns({"start": F.make_date("first_year", F.lit(1), F.lit(1)), "end": F.make_date(F.col("last_year") + 1, F.lit(1), F.lit(1))})


def out_of_range(wkt: Column) -> Column:
    """Whether a shape's first coordinate is no longitude."""
    x = F.regexp_extract(wkt, r"(-?\d+(?:\.\d+)?)\s", 1).try_cast("double")
    return ~x.between(-180, 180)


def incomplete(rows: DataFrame, key: str, first: int, last: int) -> DataFrame:
    """Regions that don't cover all configured years; the others are written without matching."""
    years = rows.groupBy(key).agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    return years.where(~((F.col("first_year") <= first) & (F.col("last_year") >= last)))


def lifetime_by(rows: DataFrame, key: str, first: int, last: int) -> DataFrame:
    """Rows and years of life of each key, clamped to the configured years."""
    return rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), (F.least(F.max("year"), F.lit(last)) - F.greatest(F.min("year"), F.lit(first))).alias("lifetime")
    )


def yearly(tables: dict[int, DataFrame]) -> DataFrame:
    """One table of all years' tables, with the year; columns are matched by name."""
    parts = [df.withColumn("tbl_year", F.lit(y)) for y, df in sorted(tables.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def integrate_regions(rows: DataFrame, members: DataFrame, threshold: float = 0.7, match: float = 0.9) -> dict[str, DataFrame]:
    """Regional integration as set operations. ``rows``: object_id, code, year, wkt, exists_from, exists_to.

    Consecutive equal shapes of a code collapse; new objects join the collections whose members'
    envelope they share (weight: common area over the larger); objects of one code that meet in
    time are compared pairwise, both ways, and overlaps of more than 0.1 % are kept."""
    shaped = udfs.with_envelope(rows.withColumn("shape_hash", F.xxhash64("wkt")), "wkt")
    versions = merge.collapse(shaped, ["code"], ["year"], "shape_hash").drop("shape_hash")
    strong = members.where(F.col("strength") >= threshold)
    hulls = strong.join(versions, "object_id").groupBy("collection_id").agg(
        *[f(c).alias(c) for c, f in zip(spatial.ENVELOPE, (F.min, F.min, F.max, F.max), strict=True)]
    )
    near = spatial.grid_join(hulls, versions.select("object_id", *spatial.ENVELOPE))
    weight = spatial.membership_weight(spatial.Box.of("a_"), spatial.Box.of("b_"))
    joined = near.select(F.col("a_collection_id").alias("collection_id"), F.col("b_object_id").alias("object_id"), F.lit("SEMANTIC").alias("relation_type"), weight.alias("strength"))
    joined = joined.where(F.col("strength") > 0).join(members.select("collection_id", "object_id"), ["collection_id", "object_id"], "left_anti")
    relations = spatial.spatio_temporal_relations(versions.select("object_id", *spatial.ENVELOPE, "exists_from", "exists_to"), 0.0, match)
    return {"versions": versions, "members": joined, "relations": relations.where(F.col("overlap").isNull() | (F.col("overlap") > 0.001))}


def summary_lines(rows: DataFrame) -> DataFrame:
    """``country:name:code-name:start:end`` lines."""
    text = F.concat_ws(":", "country", "name", F.concat_ws("-", F.col("code").cast("string"), "name"), F.col("start").cast("string"), F.col("end").cast("string"))
    return rows.select(text.alias("value"))


def zone_change(shapes: DataFrame, key: str, year: str, wkt: str = "wkt") -> DataFrame:
    """How far each zone's later shapes leave its first: the recurrence over (A - A and Bi) / A."""
    first = shapes.groupBy(key).agg(F.min(F.struct(year, wkt)).alias("f")).select(key, F.col(f"f.{year}").alias("_y"), F.col(f"f.{wkt}").alias("_a"))
    later = shapes.join(first, key).where(F.col(year) > F.col("_y"))
    ratio = 1 - udfs.common_area(F.col("_a"), F.col(wkt)) / udfs.area(F.col("_a"))
    return spatial.change_metric(later.select(key, F.col(year).alias("o"), ratio.alias("x")), key, "o", "x")


def counties(shapes: DataFrame, population: DataFrame) -> DataFrame:
    """County shapes with population rows of summary level 50, joined on numeric codes; names of
    regions and divisions; the record's year gives its start."""
    p = population.where(F.col("sumlev").cast("int") == 50).select(
        F.col("state").cast("int").alias("_s"), F.col("county").cast("int").alias("_c"), *[c for c in population.columns if c not in ("state", "county", "sumlev")]
    )
    joined = shapes.join(p, (shapes["statefp"].cast("int") == F.col("_s")) & (shapes["countyfp"].cast("int") == F.col("_c")))
    return joined.withColumns(
        {"region": _coded(F.col("region"), REGIONS), "division": _coded(F.col("division"), DIVISIONS), "geoid": F.concat(geoid(F.col("statefp"), 2), geoid(F.col("countyfp"), 3))}
    ).drop("_s", "_c")


def case_counts(rows: DataFrame) -> DataFrame:
    """Confirmed cases by place and time. A row without a county code counts for its state."""
    state, county = geoid(F.col("state_fips"), 2), geoid(F.col("county_fips"), 3)
    whole = F.col("county_fips").try_cast("int").isNull()
    return rows.where(F.col("state_fips").try_cast("int").isNotNull()).select(
        F.when(whole, state).otherwise(F.concat(state, county)).alias("geoid"),
        F.when(whole, "state").otherwise("county").alias("level"),
        F.col("confirmed").try_cast("int").alias("confirmed"),
        F.try_to_timestamp(F.regexp_replace("updated", " UTC$", "+0000"), F.lit("yyyy-MM-dd HH:mmZ")).alias("at"),
    )


def size_distribution(objects: DataFrame, key: str, wkt: str) -> DataFrame:
    """Count and areas in square kilometres by group."""
    return objects.withColumn("_km2", udfs.area_km2(F.col(wkt))).groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.min("_km2").alias("least"), F.avg("_km2").alias("mean"), F.max("_km2").alias("largest")
    )


def regionalize(relations: DataFrame, nodes: DataFrame, value: str, regions: int) -> DataFrame:
    """Groups of neighbours of like value: a spanning forest over |difference| without its heaviest
    edges. Returns ``node, region``; ``regions`` counts the edges to cut."""
    edges = graph.spatial_graph(relations, nodes, lambda a, b: F.abs(a(value) - b(value)).cast("double"))
    forest = graph.spanning_forest(edges)
    cut = forest.orderBy(F.desc("weight"), "from", "to").limit(max(regions - 1, 0))
    left = forest.join(cut, ["from", "to"], "left_anti").select("from", "to")
    keep = graph.checkpointer(nodes.sparkSession)
    labels = graph.component_labels(left, keep) if not left.isEmpty() else None
    ids = nodes.select(F.col("object_id").alias("node"))
    if labels is None:
        return ids.withColumn("region", F.col("node"))
    return ids.join(labels, F.col("node") == F.col("node_"), "left").select("node", F.coalesce("least", "node").alias("region"))
