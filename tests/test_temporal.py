import itertools
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessera.functions import identifiers as ident
from tessera.functions import temporal as t


def iv(a, b):
    at = lambda x: F.lit(None).cast("timestamp_ntz") if x is None else F.lit(f"2000-01-{x:02d}").cast("timestamp_ntz")
    return t.Span(at(a), at(b))


def pt(a):
    return t.Span(at=F.lit(f"2000-01-{a:02d}").cast("timestamp_ntz"))


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        (("iv", 1, 5), ("iv", 1, 5), "EQUALS"),
        (("iv", 1, None), ("iv", 1, None), "EQUALS"),
        (("iv", 1, 5), ("iv", 5, 9), "TEMPORAL_MEETS"),
        (("iv", 1, 3), ("iv", 1, 5), "STARTS"),
        (("iv", 1, 3), ("iv", 1, None), "STARTS"),
        (("iv", 3, 5), ("iv", 1, 5), "FINISHES"),
        (("iv", 2, 3), ("iv", 1, 5), "DURING"),
        (("iv", 1, 2), ("iv", 4, 5), "BEFORE"),
        (("iv", 6, 7), ("iv", 1, 3), "AFTER"),
        (("iv", 2, 7), ("iv", 1, 3), "AFTER"),
        (("iv", 1, 4), ("iv", 2, 6), None),
        (("pt", 3), ("pt", 3), "EQUALS"),
        (("pt", 1), ("iv", 1, 5), "TEMPORAL_MEETS"),
        (("pt", 3), ("iv", 1, 5), "DURING"),
        (("pt", 7), ("iv", 1, 5), "AFTER"),
        (("pt", 1), ("iv", 2, 5), "BEFORE"),
    ],
)
def test_relation(spark, a, b, want):
    span = lambda x: iv(*x[1:]) if x[0] == "iv" else pt(x[1])
    assert value(spark, t.relation(span(a), span(b))) == want


def test_allen_is_total_and_has_inverses(spark):
    inverse = {
        "EQUALS": "EQUALS", "BEFORE": "AFTER", "MEETS": "MET_BY", "STARTS": "STARTED_BY", "FINISHES": "FINISHED_BY", "DURING": "CONTAINS", "OVERLAPS": "OVERLAPPED_BY",
    }
    inverse |= {b: a for a, b in inverse.items()}
    spans = [(a, b) for a, b in itertools.combinations(range(1, 6), 2)] + [(2, None), (4, None)]
    pairs = list(itertools.product(spans, spans))
    row = spark.range(1).select(*[t.allen(iv(*p), iv(*q)).alias(f"c{i}") for i, (p, q) in enumerate(pairs)]).first()
    got = dict(zip(pairs, row, strict=True))
    assert all(got[(q, p)] == inverse[r] for (p, q), r in got.items()) and len(set(got.values())) == 13


def test_adjusted_time(spark):
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    span = t.Span(at("2018-03-11"), at("2019-01-11"))
    assert value(spark, t.adjusted(span, at("2020-01-01"))) == datetime(2019, 1, 10, 23, 59, 59, 999999)
    assert value(spark, t.adjusted(span, at("2020-01-01"), "1 DAY")) == datetime(2019, 1, 10)
    assert value(spark, t.adjusted(span, at("2017-01-01"))) == datetime(2018, 3, 11)
    assert value(spark, t.adjusted(span, at("2018-06-01"))) == datetime(2018, 6, 1)
    assert value(spark, t.adjusted(t.Span(at=at("2018-06-01")), at("2017-01-01"))) == datetime(2018, 6, 1)


def test_history_modes(spark):
    rows = [("a", "2000-01-01", "2000-01-10"), ("b", "2000-01-05", "2000-01-30"), ("c", "2000-01-12", None), ("d", "2000-02-01", None)]
    df = spark.createDataFrame(rows, "v string, f string, e string").select(
        "v", F.col("f").cast("timestamp_ntz").alias("valid_from"), F.col("e").cast("timestamp_ntz").alias("valid_to"), F.lit(None).cast("timestamp_ntz").alias("valid_at"),
        F.col("f").cast("timestamp_ntz").alias("db_from"),
    )
    at = t.instant
    ask = lambda **k: sorted(r.v for r in df.where(t.history_mode(**k)).collect())
    assert ask(start=at("2000-01-04"), end=at("2000-01-20")) == ["b", "c"]
    assert ask(start=at("2000-01-04"), end=at("2000-01-20"), mode="overlap") == ["a", "b", "c"]
    assert ask(start=at("2000-01-04"), end=None) == ["b", "c", "d"]
    assert ask(start=at("2000-01-04"), end=None, database=at("2000-01-12")) == ["c", "d"]


def test_identifiers(spark):
    v, d = (F.lit(x).cast("timestamp_ntz") for x in ("2000-01-01", "2001-01-01"))
    text = value(spark, ident.versioned(F.lit("obj:1"), v, d, F.lit("name")))
    assert text == "V1:obj:1@name:946684800000:978307200000"
    back = value(spark, ident.parse_versioned(F.lit(text)))
    assert (back.object_id, back.fact, back.valid, back.database) == ("obj:1", "name", datetime(2000, 1, 1), datetime(2001, 1, 1))
    assert value(spark, ident.parse_versioned(F.lit("V2:x"))) is None
    assert value(spark, ident.split_crs(F.lit("<http://www.opengis.net/def/crs/EPSG/0/4269> POINT (1 2)"))).asDict() == {"srid": 4269, "wkt": "POINT (1 2)"}
    assert value(spark, ident.split_crs(F.lit("POINT (1 2)"))).srid == 4326
    assert value(spark, ident.member_name(F.lit("getAdmCode"))) == "admCode"
    assert value(spark, ident.nearest(F.lit("populaton"), ["area", "population"])) == "population"
    assert value(spark, ident.geoid(F.lit(7), 3)) == "007"


def test_zones_and_precision(spark):
    day = F.lit("2000-07-01").cast("date")
    assert value(spark, t.to_utc(day, "America/Los_Angeles")) == datetime(2000, 7, 1, 7)
    a, b = (F.lit(x).cast("timestamp_ntz") for x in ("2000-01-01 05:00:00", "2000-01-01 09:00:00"))
    assert value(spark, t.compare_instants(a, b)) == -1 and value(spark, t.compare_instants(a, b, "DAY")) == 0
    none = F.lit(None).cast("timestamp_ntz")
    got = value(spark, t.from_properties((a, none, none), (none, none, b), (a, none)))
    assert (got.scope, got["at"]) == ("VALID", datetime(2000, 1, 1, 9))
    assert value(spark, t.from_properties((a, b, none), (none, none, none), (a, none))).scope == "EXISTS"
