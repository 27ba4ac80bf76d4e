"""Text formats: GeoJSON features, KML placemarks, N-Triples, CSV; and the archives around them."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class UnsupportedFormat(ValueError):
    pass


def coordinates(wkt: Column) -> Column:
    """WKT's parentheses and blanks as JSON brackets and commas."""
    body = F.regexp_extract(wkt, r"^[^(]*(\(.*\))\s*$", 1)
    point = F.regexp_replace(body, r"(-?[\d.]+(?:[eE][-+]?\d+)?)\s+(-?[\d.]+(?:[eE][-+]?\d+)?)(?:\s+-?[\d.]+)?", "[$1,$2]")
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(point, r"\(", "["), r"\)", "]"), r",\s+", ",")
    # a point has one pair of brackets too many
    single = F.regexp_replace(text, r"^\[(\[[^\[\]]*\])\]$", "$1")
    return F.when(wkt.rlike(r"(?i)^\s*(?:<[^>]*>)?\s*POINT"), single).otherwise(text)


def geometry(wkt: Column) -> Column:
    names = {"POINT": "Point", "LINESTRING": "LineString", "LINEARRING": "LineString", "POLYGON": "Polygon", "MULTIPOINT": "MultiPoint", "MULTILINESTRING": "MultiLineString", "MULTIPOLYGON": "MultiPolygon"}
    kind = F.upper(F.regexp_extract(wkt, r"^\s*(?:<[^>]*>)?\s*([A-Za-z]+)", 1))
    table = F.create_map(*[F.lit(x) for p in names.items() for x in p])
    return F.concat(F.lit('{"type":"'), table[kind], F.lit('","coordinates":'), coordinates(F.regexp_replace(wkt, r"^\s*<[^>]*>\s*", "")), F.lit("}"))


def feature(object_id: Column, wkt: Column | None, properties: dict[str, Column]) -> Column:
    """A GeoJSON feature; nulls are left out of the properties."""
    own = F.to_json(F.struct(*[c.alias(k) for k, c in properties.items()])) if properties else F.lit("{}")
    shape = F.lit("") if wkt is None else F.concat(F.lit(',"geometry":'), F.coalesce(geometry(wkt), F.lit("null")))
    listed = F.to_json(F.array(object_id.cast("string")))
    quoted = F.substring(listed, F.lit(2), F.length(listed) - 2)
    return F.concat(F.lit('{"type":"Feature","id":'), quoted, F.lit(',"properties":'), own, shape, F.lit("}"))


def geojson_lines(df: DataFrame, object_id: str, wkt: str, properties: list[str]) -> DataFrame:
    """One feature for each row: newline-delimited GeoJSON, written by all executors."""
    return df.select(feature(F.col(object_id), F.col(wkt), {p: F.col(p) for p in properties}).alias("value"))


def geojson_collection(df: DataFrame, object_id: str, wkt: str, properties: list[str]) -> str:
    """A FeatureCollection as one text; for results that a caller shows, not for whole datasets."""
    rows = geojson_lines(df, object_id, wkt, properties).toLocalIterator()
    return '{"type":"FeatureCollection","features":[' + ",".join(r["value"] for r in rows) + "]}"


def _escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def placemark(object_id: Column, wkt: Column, properties: dict[str, Column]) -> Column:
    """A KML placemark of a point, ring, polygon or multipolygon."""
    kind = F.upper(F.regexp_extract(wkt, r"^\s*(?:<[^>]*>)?\s*([A-Za-z]+)", 1))
    body = F.regexp_extract(wkt, r"^[^(]*\((.*)\)\s*$", 1)

    def ring(text: Column) -> Column:
        flat = F.regexp_replace(F.regexp_replace(text, r"[()]", ""), r"\s*,\s*", "\n")
        return F.regexp_replace(F.trim(flat), r"(\S+)[ \t]+(\S+)(?:[ \t]+\S+)?", "$1,$2")

    def tag(name: str, c: Column) -> Column:
        return F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))

    def polygon(text: Column) -> Column:
        rings = F.regexp_extract_all(text, F.lit(r"\(([^()]+)\)"), F.lit(1))
        shaped = F.transform(
            rings, lambda r, i: tag_if(i, tag("LinearRing", tag("coordinates", ring(r))))
        )
        return tag("Polygon", F.array_join(shaped, ""))

    def tag_if(i: Column, c: Column) -> Column:
        return F.when(i == 0, tag("outerBoundaryIs", c)).otherwise(tag("innerBoundaryIs", c))

    parts = F.regexp_extract_all(body, F.lit(r"(\((?:\s*\([^()]*\)\s*,?)+\))"), F.lit(1))
    shape = (
        F.when(kind == "POINT", tag("Point", tag("coordinates", ring(body))))
        .when(kind == "LINEARRING", tag("LinearRing", tag("coordinates", ring(body))))
        .when(kind == "POLYGON", polygon(body))
        .when(kind == "MULTIPOLYGON", tag("MultiGeometry", F.array_join(F.transform(parts, polygon), "")))
        .otherwise(F.raise_error(F.concat(F.lit("KML has no "), kind)))
    )
    data = [
        F.concat(F.lit(f'<Data name="{k}"><value>'), _escaped(F.coalesce(c.cast("string"), F.lit(""))), F.lit("</value></Data>")) for k, c in properties.items()
    ]
    return tag("Placemark", F.concat(tag("name", _escaped(object_id.cast("string"))), tag("ExtendedData", F.concat(*data) if data else F.lit("")), shape))


def kml(df: DataFrame, object_id: str, wkt: str, properties: list[str]) -> str:
    rows = df.select(placemark(F.col(object_id), F.col(wkt), {p: F.col(p) for p in properties}).alias("v")).toLocalIterator()
    body = "".join(r["v"] for r in rows)
    return f'<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document>{body}</Document></kml>'


def kmz(text: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("doc.kml", text)
    return out.getvalue()


def ntriples(facts: DataFrame, relations: DataFrame, prefix: str = "urn:") -> DataFrame:
    def node(c: str) -> Column:
        return F.concat(F.lit(f"<{prefix}"), F.col(c), F.lit(">"))

    text = F.col("value")
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(a), F.lit(b))
    literal = F.concat(F.lit('"'), text, F.lit('"'), F.when(F.col("lang").isNotNull(), F.concat(F.lit("@"), "lang")).otherwise(""))
    a = facts.select(F.concat_ws(" ", node("object_id"), node("property"), literal, F.lit(".")).alias("line"))
    return a.unionByName(relations.select(F.concat_ws(" ", node("subject"), node("relation"), node("object"), F.lit(".")).alias("line")))


def write_lines(df: DataFrame, path: str) -> None:
    df.select(F.col(df.columns[0]).alias("value")).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]").csv(path)


def export(df: DataFrame, kind: str, object_id: str = "object_id", wkt: str = "wkt", properties: list[str] | None = None) -> str | bytes:
    """Objects in one of the formats; rows without a shape have no place in any of them."""
    df = df.where(F.col(wkt).isNotNull())
    properties = properties if properties is not None else [c for c in df.columns if c not in (object_id, wkt)]
    if kind == "GEOJSON":
        return geojson_collection(df, object_id, wkt, properties)
    if kind == "KML":
        return kml(df, object_id, wkt, properties)
    if kind == "KMZ":
        return kmz(kml(df, object_id, wkt, properties))
    if kind == "SHAPEFILE":
        from .shapefile import shapefile_zip

        return shapefile_zip([r.asDict() for r in df.select(object_id, wkt, *properties).toLocalIterator()], object_id, wkt)
    raise UnsupportedFormat(f"no export to {kind}")
