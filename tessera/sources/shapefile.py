"""Shapefiles of points, lines and polygons: read from binary files, written as a zip."""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..geometry import polygon as g

WGS84 = 'GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]]'
_NULL, _POINT, _LINE, _POLYGON, _MULTIPOINT = 0, 1, 3, 5, 8


def _clockwise(ring: g.Ring) -> bool:
    return sum((b[0] - a[0]) * (b[1] + a[1]) for a, b in zip(ring, ring[1:], strict=False)) > 0


def read_shapes(data: bytes) -> Iterator[str | None]:
    """WKT of every record of a .shp file; null shapes are None."""
    if len(data) < 100 or struct.unpack(">i", data[:4])[0] != 9994:
        raise g.GeometryError("not a shapefile")
    at = 100
    while at + 12 <= len(data):
        _, words = struct.unpack(">2i", data[at : at + 8])
        body = data[at + 8 : at + 8 + 2 * words]
        at += 8 + 2 * words
        kind = struct.unpack("<i", body[:4])[0] % 10  # Z and M kinds hold the plane first
        if kind == _NULL:
            yield None
        elif kind == _POINT:
            yield g.write(g.Shape("POINT", [[[struct.unpack("<2d", body[4:20])]]]))
        elif kind == _MULTIPOINT:
            n = struct.unpack("<i", body[36:40])[0]
            xy = struct.unpack(f"<{2 * n}d", body[40 : 40 + 16 * n])
            yield g.write(g.Shape("MULTIPOINT", [[[p]] for p in zip(xy[::2], xy[1::2], strict=True)]))
        elif kind in (_LINE, _POLYGON):
            parts, n = struct.unpack("<2i", body[36:44])
            first = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), n]
            xy = struct.unpack(f"<{2 * n}d", body[44 + 4 * parts : 44 + 4 * parts + 16 * n])
            points = list(zip(xy[::2], xy[1::2], strict=True))
            rings = [points[a:b] for a, b in zip(first, first[1:], strict=False)]
            if kind == _LINE:
                yield g.write(g.Shape("MULTILINESTRING" if len(rings) > 1 else "LINESTRING", [[r] for r in rings]))
                continue
            shells = [[r] for r in rings if _clockwise(r)] or [[rings[0]]]
            for hole in (r for r in rings if not _clockwise(r) and [r] not in shells):
                home = next((s for s in shells if g.inside(g.Shape("POLYGON", [[s[0]]]), *hole[0]) >= 0), shells[0])
                home.append(hole)
            yield g.write(g.Shape("POLYGON" if len(shells) == 1 else "MULTIPOLYGON", shells))
        else:
            raise g.GeometryError(f"shape type {kind} is not supported")


def read_table(data: bytes, encoding: str = "utf-8") -> Iterator[dict[str, str | None]]:
    """Rows of a .dbf file as text."""
    n, head, size = struct.unpack("<IHH", data[4:12])
    fields, at, pos = [], 32, 1
    while data[at] != 0x0D:
        name = data[at : at + 11].split(b"\0")[0].decode(encoding)
        fields.append((name, pos, data[at + 16]))
        pos += data[at + 16]
        at += 32
    for i in range(n):
        row = data[head + i * size : head + (i + 1) * size]
        if row[:1] == b"*":
            continue
        yield {name: row[p : p + w].decode(encoding, "replace").strip() or None for name, p, w in fields}


def read(spark: SparkSession, path: str, columns: dict[str, str], year_pattern: str | None = None) -> DataFrame:
    """Shapes below a folder with the named attributes (name: Spark type), one row a record.

    The .shp and .dbf of one name are brought to one task; files are read whole, so a file is
    the unit of parallelism. ``year_pattern`` takes a year from the path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{shp,dbf}").load(path)
    stem, kind = F.regexp_replace("path", r"\.\w+$", ""), F.lower(F.regexp_extract("path", r"\.(\w+)$", 1))
    pairs = files.groupBy(stem.alias("stem")).agg(
        F.max(F.when(kind == "shp", F.col("content"))).alias("shp"), F.max(F.when(kind == "dbf", F.col("content"))).alias("dbf")
    )

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stem_, shp, dbf in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if shp is None:
                    continue
                shapes = list(read_shapes(shp))
                rows = list(read_table(dbf)) if dbf is not None else [{} for _ in shapes]
                yield pa.record_batch(
                    [pa.array([stem_] * len(shapes)), pa.array(shapes, pa.string()), *[pa.array([r.get(c) for r in rows], pa.string()) for c in columns]],
                    names=["path", "wkt", *columns],
                )

    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("path", "wkt", *columns)])
    out = pairs.mapInArrow(parse, schema)
    year = {} if year_pattern is None else {"year": F.regexp_extract("path", year_pattern, 1).try_cast("int")}
    return out.withColumns({c: F.col(c).try_cast(t) for c, t in columns.items()} | year)


def _record(shape: g.Shape) -> tuple[int, bytes]:
    if shape.kind == "POINT":
        return _POINT, struct.pack("<i2d", _POINT, *shape.rings[0][0])
    rings = []
    for p in shape.parts:
        for k, r in enumerate(p):
            r = r if r[0] == r[-1] or not shape.is_area else [*r, r[0]]
            rings.append(r if not shape.is_area or _clockwise(r) == (k == 0) else r[::-1])
    kind = _POLYGON if shape.is_area else _LINE
    n = sum(map(len, rings))
    starts = [sum(len(r) for r in rings[:i]) for i in range(len(rings))]
    body = struct.pack("<i4d2i", kind, *shape.envelope, len(rings), n) + struct.pack(f"<{len(rings)}i", *starts)
    return kind, body + b"".join(struct.pack("<2d", *p) for r in rings for p in r)


def shapefile_parts(rows: list[dict], object_id: str, wkt: str) -> dict[str, bytes]:
    """.shp, .shx, .dbf and .prj of the rows. What the format can't hold (values over 254 bytes, names over
    10 characters or equal ones) raises an error."""
    shapes = [g.parse(r[wkt]) for r in rows]
    records = [_record(s) for s in shapes]
    kinds = {k for k, _ in records}
    if len(kinds) > 1:
        raise g.GeometryError("a shapefile holds shapes of one type")
    boxes = [s.envelope for s in shapes]
    bounds = (min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes)) if boxes else (0.0,) * 4

    def head(size: int) -> bytes:
        return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, size // 2) + struct.pack("<2i8d", 1000, *(kinds or {_NULL}), *bounds, 0, 0, 0, 0)

    shp, shx, at = b"", b"", 100
    for i, (_, body) in enumerate(records):
        shp += struct.pack(">2i", i + 1, len(body) // 2) + body
        shx += struct.pack(">2i", at // 2, len(body) // 2)
        at += 8 + len(body)
    fields = [c for c in (rows[0] if rows else {object_id: None}) if c != wkt]
    text = [[("" if r[c] is None else str(r[c])).encode() for c in fields] for r in rows]
    if long := {c for t in text for c, v in zip(fields, t, strict=True) if len(v) > 254}:
        raise g.GeometryError(f"a shapefile holds 254 bytes of a value: {', '.join(sorted(long))}")
    names = [re.sub(r"\W", "_", c, flags=re.A) for c in fields]
    if any(len(n) > 10 for n in names) or len(set(names)) < len(names):
        raise g.GeometryError(f"a shapefile's attributes have names of at most 10 letters, digits or _, all different: {', '.join(fields)}")
    widths = [max([1, *(len(t[k]) for t in text)]) for k in range(len(fields))]
    dbf = struct.pack("<4BIHH20x", 3, 100, 1, 1, len(rows), 33 + 32 * len(fields), 1 + sum(widths))
    for c, w in zip(names, widths, strict=True):
        dbf += struct.pack("<11sc4xBB14x", c.encode(), b"C", w, 0)
    dbf += b"\r" + b"".join(b" " + b"".join(v.ljust(w) for v, w in zip(t, widths, strict=True)) for t in text) + b"\x1a"
    return {"shp": head(100 + len(shp)) + shp, "shx": head(100 + len(shx)) + shx, "dbf": dbf, "prj": WGS84.encode()}


def shapefile_zip(rows: list[dict], object_id: str, wkt: str, name: str = "export") -> bytes:
    """The parts in one archive: an export that a person opens, built on the driver."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for suffix, data in shapefile_parts(rows, object_id, wkt).items():
            z.writestr(f"{name}.{suffix}", data)
    return out.getvalue()


def write(df: DataFrame, path: str, object_id: str, wkt: str, rows_a_file: int = 50_000) -> DataFrame:
    """Shapefiles of a whole dataset below a folder that executors share, each written by the task that has its
    rows: ``file, rows`` of those that finished tasks report. Rows without a shape have no place in them."""
    import pyarrow.fs as pafs

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, base = pafs.FileSystem.from_uri(path)
        fs.create_dir(base, recursive=True)
        task, count, held = TaskContext.get(), 0, []

        def flush() -> pa.RecordBatch:
            nonlocal count
            name, n = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{count:03d}", len(held)
            for suffix, data in shapefile_parts(held, object_id, wkt).items():
                with fs.open_output_stream(f"{base}/{name}.{suffix}") as out:
                    out.write(data)
            count += 1
            held.clear()
            return pa.record_batch([pa.array([name]), pa.array([n], pa.int64())], names=["file", "rows"])

        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                held += batch.slice(i, 1000).to_pylist()
                if len(held) >= rows_a_file:
                    yield flush()
        if held:
            yield flush()

    return df.where(F.col(wkt).isNotNull()).mapInArrow(parts, T.StructType([T.StructField("file", T.StringType()), T.StructField("rows", T.LongType())]))
