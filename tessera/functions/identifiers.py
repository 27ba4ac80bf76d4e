"""Identifiers, text normalisation and literals as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CRS = "http://www.opengis.net/def/crs/EPSG/0/"


def millis(t: Column) -> Column:
    return F.unix_millis(t.cast("timestamp"))


def versioned(object_id: Column, valid: Column, database: Column, fact: Column | None = None) -> Column:
    """``V1:{object}[@fact]:{valid millis}:{database millis}``."""
    name = object_id if fact is None else F.concat(object_id, F.lit("@"), fact)
    return F.concat_ws(":", F.lit("V1"), name, millis(valid).cast("string"), millis(database).cast("string"))


def parse_versioned(identifier: Column) -> Column:
    """Struct of object_id, fact, valid and database (instants); null for other text."""
    shape = r"^V1:([^@]+?)(?:@([^:@]+))?:(-?\d+):(-?\d+)$"
    part = lambda i: F.regexp_extract(identifier, shape, i)
    at = lambda i: F.timestamp_millis(part(i).try_cast("long")).cast("timestamp_ntz")
    parsed = F.struct(
        part(1).alias("object_id"), F.nullif(part(2), F.lit("")).alias("fact"), at(3).alias("valid"), at(4).alias("database")
    )
    return F.when(identifier.rlike(shape), parsed)


def relation_id(collection: Column, object_id: Column) -> Column:
    return F.concat_ws(":", F.lit("relation"), collection, object_id)


def overlap_id(a: Column, b: Column) -> Column:
    return F.concat_ws(":", F.lit("overlap"), a, b)


def event_id(object_id: Column, event_type: Column) -> Column:
    return F.concat_ws(":", object_id, event_type, F.lit("event"))


def with_crs(wkt: Column, srid: int | Column) -> Column:
    code = F.lit(str(srid)) if isinstance(srid, int) else srid.cast("string")
    return F.concat(F.lit(f"<{CRS}"), code, F.lit("> "), wkt)


def split_crs(literal: Column) -> Column:
    """Struct of srid (4326 where none is given) and wkt."""
    shape = r"^\s*(?:<[^>]*?/(\d+)>)?\s*(.*?)\s*$"
    return F.struct(
        F.coalesce(F.regexp_extract(literal, shape, 1).try_cast("int"), F.lit(4326)).alias("srid"),
        F.regexp_extract(literal, shape, 2).alias("wkt"),
    )


def choose_language(explicit: Column, default: str | None) -> Column:
    return F.coalesce(F.nullif(explicit, F.lit("")), F.lit(default))


def normal_id(text: Column) -> Column:
    """White space to underscores."""
    return F.regexp_replace(F.trim(text), r"\s+", "_")


def member_name(accessor: Column) -> Column:
    """``getAdmCode`` to ``admCode``."""
    bare = F.regexp_replace(accessor, r"^(?:get|is)(?=[A-Z])", "")
    return F.concat(F.lower(F.substring(bare, 1, 1)), F.substring(bare, 2, 10_000))


def nearest(word: Column, options: list[str]) -> Column:
    """The option of least edit distance, for hints in messages."""
    scored = F.array(*[F.struct(F.levenshtein(word, F.lit(o)).alias("d"), F.lit(o).alias("o")) for o in options])
    return F.array_min(scored)["o"]


def geoid(code: Column, width: int) -> Column:
    return F.lpad(F.trim(code.cast("string")), width, "0")
