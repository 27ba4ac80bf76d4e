"""Arrow-batched functions over WKT columns. Callers filter by envelope first: the envelope is
computed once and kept as four columns, which Parquet statistics can skip by."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import polygon as g

# types as objects: executors import this module without a session, which parsing text needs
_DOUBLE, _BOOLEAN, _STRING = T.DoubleType(), T.BooleanType(), T.StringType()
_ENVELOPE = T.StructType([T.StructField(c, _DOUBLE) for c in ("xmin", "ymin", "xmax", "ymax")])
_REPORT = T.StructType([T.StructField("equality", _DOUBLE), T.StructField("relation", _STRING), T.StructField("overlap", _DOUBLE), T.StructField("overlap_wkt", _STRING), T.StructField("common", _DOUBLE)])


def _pair(f):
    def over(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(g.parse(x), g.parse(y)) for x, y in zip(a, b, strict=True)])

    return over


@F.pandas_udf(_ENVELOPE)
def envelope(wkt: pd.Series) -> pd.DataFrame:
    rows = [(np.nan,) * 4 if w is None or not g.parse(w).parts else g.parse(w).envelope for w in wkt]
    return pd.DataFrame(rows, columns=["xmin", "ymin", "xmax", "ymax"])


@F.pandas_udf(_DOUBLE)
def area(wkt: pd.Series) -> pd.Series:
    return pd.Series([None if w is None else g.area(g.parse(w)) for w in wkt], dtype="float64")


@F.pandas_udf(_DOUBLE)
def area_km2(wkt: pd.Series) -> pd.Series:
    return pd.Series([None if w is None else g.area_km2(g.parse(w)) for w in wkt], dtype="float64")


@F.pandas_udf(_DOUBLE)
def common_area(a: pd.Series, b: pd.Series) -> pd.Series:
    return _pair(g.common_area)(a, b).astype("float64")


@F.pandas_udf(_DOUBLE)
def equality(a: pd.Series, b: pd.Series) -> pd.Series:
    return _pair(g.equality)(a, b).astype("float64")


@F.pandas_udf(_BOOLEAN)
def intersects(a: pd.Series, b: pd.Series) -> pd.Series:
    return _pair(g.intersects)(a, b)


@F.pandas_udf(_STRING)
def simplify(wkt: pd.Series) -> pd.Series:
    return wkt.map(lambda w: None if w is None else g.simplify(w))


def reproject(srid: int):
    @F.pandas_udf(_STRING)
    def to(wkt: pd.Series) -> pd.Series:
        return wkt.map(lambda w: None if w is None else g.write(g.reproject(g.parse(w), srid)))

    return to


def _report(p: g.Shape, q: g.Shape, common: float | None, threshold: float) -> tuple:
    """Equality, relation, overlap, its WKT and the common area of one pair; ``common`` where it is known."""
    if not p.parts or not q.parts or not g.envelopes_meet(p, q):
        return None, None, None, None, 0.0
    if common is None:
        common = g.common_area(p, q)
    if common <= g.EPS and not g.intersects(p, q):
        return None, None, None, None, 0.0
    sp, sq = g.area(p), g.area(q)
    equal = common / max(sp, sq) if max(sp, sq) else 0.0
    equal = equal if equal >= threshold else None
    areas = p.is_area and q.is_area
    if common <= g.EPS * max(1.0, min(sp, sq)) if areas else g.touches(p, q):
        return equal, "SPATIAL_MEETS", None, None, common
    if common >= sq - g.EPS * max(1.0, sq) if areas else g.covers(p, q):
        return equal, "COVERS", sq / sp, g.write(q), common
    shape = g.intersection_shape(p, q)
    return equal, "SPATIAL_OVERLAPS", common / sp if sp else None, g.write(shape) if shape else None, common


def comparison(threshold: float):
    """Struct of equality, relation, overlap and overlap_wkt, as the rectangle operator gives, and the common area.
    The common areas of a batch's convex pairs are computed together."""

    @F.pandas_udf(_REPORT)
    def compare(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        left = [g.parse(x) for x in a]
        right = [g.reproject(g.parse(y), p.srid) if g.parse(y).srid != p.srid else g.parse(y) for p, y in zip(left, b, strict=True)]
        common: list[float | None] = [None] * len(left)
        convex = [i for i, (p, q) in enumerate(zip(left, right, strict=True)) if p.convex and q.convex]
        if convex:
            for i, x in zip(convex, g.convex_common_areas([left[i].convex for i in convex], [right[i].convex for i in convex]).tolist(), strict=True):
                common[i] = x
        out = [_report(p, q, c, threshold) for p, q, c in zip(left, right, common, strict=True)]
        kinds = {"equality": "float64", "overlap": "float64", "common": "float64"}
        return pd.DataFrame(out, columns=["equality", "relation", "overlap", "overlap_wkt", "common"]).astype(kinds)

    return compare


def containment(threshold: float):
    @F.pandas_udf(_STRING)
    def contain(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(p: g.Shape, q: g.Shape) -> str:
            q = g.reproject(q, p.srid)
            sa, sb = g.area(p), g.area(q)
            if not min(sa, sb) or g.common_area(p, q) / min(sa, sb) < threshold:
                return "NONE"
            return "WITHIN" if sa <= sb else "CONTAINS"

        return _pair(one)(a, b)

    return contain


@F.pandas_udf(_DOUBLE)
def union_area(wkts: pd.Series) -> float:
    """Aggregate: area of the union of a group's shapes, outer rings only."""
    return g.union_area([g.exterior(g.parse(w)) for w in wkts if w is not None])


@F.pandas_udf(_DOUBLE)
def union_area_within(wkts: pd.Series, x: pd.Series, y: pd.Series, size: pd.Series) -> float:
    """Aggregate: the part of that area that lies in the square with its lower left corner at x, y."""
    x0, y0, x1, y1 = float(x.iloc[0]), float(y.iloc[0]), float(x.iloc[0] + size.iloc[0]), float(y.iloc[0] + size.iloc[0])
    square = g.Shape("POLYGON", [[[(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]]])
    return g.unions_common_area([square], [g.exterior(g.parse(w)) for w in set(wkts.dropna())])


def with_envelope(df: DataFrame, wkt: str) -> DataFrame:
    return df.withColumn("_env", envelope(F.col(wkt))).select(*df.columns, "_env.xmin", "_env.ymin", "_env.xmax", "_env.ymax")


def intersecting(df: DataFrame, wkt: str, shape: str, buffer: float = 0.0) -> DataFrame:
    """Rows of a frame with envelope columns whose shape meets ``shape`` grown by the buffer: the
    envelope filter is pushed to the scan, the exact test runs on what is left."""
    target = g.parse(shape)
    x0, y0, x1, y1 = target.envelope
    near = df.where((F.col("xmin") <= x1 + buffer) & (F.col("xmax") >= x0 - buffer) & (F.col("ymin") <= y1 + buffer) & (F.col("ymax") >= y0 - buffer))

    @F.pandas_udf(_BOOLEAN)
    def exact(w: pd.Series) -> pd.Series:
        return w.map(lambda x: x is not None and g.within_distance(target, g.parse(x), buffer))

    return near.where(exact(F.col(wkt)))
