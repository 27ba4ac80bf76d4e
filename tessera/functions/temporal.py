"""Time as columns: three half-open axes (exists, valid, database), all built-in expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def instant(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def to_utc(local: Column, zone: str | Column = "UTC") -> Column:
    """A local date or time of a zone as the stored instant; dates count from the start of day."""
    return F.to_utc_timestamp(local.cast("timestamp"), zone).cast("timestamp_ntz")


def compare_instants(a: Column, b: Column, precision: str = "MICROSECOND") -> Column:
    """-1, 0 or 1; with precision DAY both are cut to their date, as for plain dates."""
    if precision != "MICROSECOND":
        a, b = F.date_trunc(precision, a.cast("timestamp")), F.date_trunc(precision, b.cast("timestamp"))
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0)


def from_properties(exists: tuple[Column, Column, Column], valid: tuple[Column, Column, Column], database: tuple[Column, Column]) -> Column:
    """The time a row stands for, from (from, to, at) of each axis: valid before exists before
    database, an interval before a point. Struct of scope, start, end and at."""

    def span(scope: str, start: Column, end: Column, at: Column | None = None) -> Column:
        none = F.lit(None).cast("timestamp_ntz")
        return F.struct(F.lit(scope).alias("scope"), start.alias("start"), end.alias("end"), (none if at is None else at).alias("at"))

    none = F.lit(None).cast("timestamp_ntz")
    return (
        F.when(valid[0].isNotNull(), span("VALID", valid[0], valid[1]))
        .when(valid[2].isNotNull(), span("VALID", none, none, valid[2]))
        .when(exists[0].isNotNull(), span("EXISTS", exists[0], exists[1]))
        .when(exists[2].isNotNull(), span("EXISTS", none, none, exists[2]))
        .when(database[0].isNotNull(), span("DATABASE", database[0], database[1]))
    )


@dataclass(frozen=True)
class Span:
    """An interval [start, end), open if end is null, or a point if ``at`` is given."""

    start: Column | None = None
    end: Column | None = None
    at: Column | None = None

    @classmethod
    def of(cls, prefix: str, alias: str = "") -> Span:
        """The columns ``{prefix}_from`` and ``{prefix}_to``."""
        dot = f"{alias}." if alias else ""
        return cls(F.col(f"{dot}{prefix}_from"), F.col(f"{dot}{prefix}_to"))

    @property
    def is_point(self) -> bool:
        return self.at is not None

    @property
    def first(self) -> Column:
        return self.at if self.is_point else self.start


def as_of(valid: Column, database: Column) -> Column:
    """Facts true at ``valid`` as the database knew at ``database``."""
    c = F.col
    return (
        (c("valid_from").isNull() | (c("valid_from") <= valid))
        & (c("valid_to").isNull() | (c("valid_to") > valid))
        & (c("valid_at").isNull() | (c("valid_at") == valid))
        & known_at(database)
    )


def known_at(database: Column) -> Column:
    c = F.col
    return (c("db_from").isNull() | (c("db_from") <= database)) & (c("db_to").isNull() | (c("db_to") > database))


def valid_within(valid: Column) -> Column:
    """The spatial queries' filter: an end without a start doesn't count."""
    c = F.col
    return (c("valid_from").isNull() | ((c("valid_from") <= valid) & (c("valid_to").isNull() | (c("valid_to") > valid)))) & (
        c("valid_at").isNull() | (c("valid_at") == valid)
    )


def position(span: Span, t: Column) -> Column:
    """1 if the span lies after t, -1 if it ended by then, 0 if it holds t."""
    if span.is_point:
        return F.when(span.at > t, 1).when(span.at < t, -1).otherwise(0)
    return F.when(span.start > t, 1).when(span.end <= t, -1).otherwise(0)


def during(a: Span, b: Span) -> Column:
    if a.is_point:
        if b.is_point:
            return a.at == b.at
        return (b.start <= a.at) & (b.end.isNull() | (a.at < b.end))
    if b.is_point:
        return F.lit(False)
    return (a.start >= b.start) & (b.end.isNull() | (a.end.isNotNull() & (a.end <= b.end)))


def meets(a: Span, b: Span) -> Column:
    if a.is_point:
        return a.at == b.first
    return ~during(a, b) & a.end.isNotNull() & F.coalesce(a.end == b.first, F.lit(False))


def starts(a: Span, b: Span) -> Column:
    if a.is_point or b.is_point:
        return F.lit(False)
    return during(a, b) & (a.start == b.start)


def finishes(a: Span, b: Span) -> Column:
    if a.is_point or b.is_point:
        return F.lit(False)
    return during(a, b) & F.coalesce(a.end == b.end, F.lit(False))


def same(a: Span, b: Span) -> Column:
    if a.is_point != b.is_point:
        return F.lit(False)
    return a.at.eqNullSafe(b.at) if a.is_point else a.start.eqNullSafe(b.start) & a.end.eqNullSafe(b.end)


def relation(a: Span, b: Span) -> Column:
    """At most one relation of a to b, the first that holds; null if none does."""
    where = position(a, b.first)
    return (
        F.when(same(a, b), "EQUALS")
        .when(meets(a, b), "TEMPORAL_MEETS")
        .when(starts(a, b), "STARTS")
        .when(finishes(a, b), "FINISHES")
        .when(during(a, b), "DURING")
        .when(where == -1, "BEFORE")
        .when(where == 1, "AFTER")
    )


def allen(a: Span, b: Span) -> Column:
    """All thirteen interval relations; an open end lies after every instant."""
    never = instant("9999-12-31 23:59:59.999999")
    ae, be = F.coalesce(a.end, never), F.coalesce(b.end, never)
    return (
        F.when((a.start == b.start) & (ae == be), "EQUALS")
        .when(ae < b.start, "BEFORE")
        .when(be < a.start, "AFTER")
        .when(ae == b.start, "MEETS")
        .when(be == a.start, "MET_BY")
        .when((a.start == b.start) & (ae < be), "STARTS")
        .when((a.start == b.start) & (ae > be), "STARTED_BY")
        .when((ae == be) & (a.start > b.start), "FINISHES")
        .when((ae == be) & (a.start < b.start), "FINISHED_BY")
        .when((a.start > b.start) & (ae < be), "DURING")
        .when((a.start < b.start) & (ae > be), "CONTAINS")
        .when(a.start < b.start, "OVERLAPS")
        .otherwise("OVERLAPPED_BY")
    )


def adjusted(span: Span, t: Column, unit: str = "1 MICROSECOND") -> Column:
    """t moved into the span: its start, or the last instant before its end."""
    if span.is_point:
        return span.at
    return F.when(span.end <= t, span.end - F.expr(f"INTERVAL {unit}")).when(span.start > t, span.start).otherwise(t)


def history_mode(start: Column, end: Column | None, database: Column | None = None, mode: str = "reference") -> Column:
    """Filter of a fact's history. ``reference``: versions that begin inside the window and
    outlive it (without an end: begin at or after the start). ``overlap``: all versions that
    share an instant with the window. A database time asks for versions recorded since."""
    c = F.col
    if mode == "overlap":
        keep = (c("valid_to").isNull() | (c("valid_to") > start)) & (c("valid_at").isNull() | (c("valid_at") >= start))
        if end is not None:
            keep &= (c("valid_from").isNull() | (c("valid_from") < end)) & (c("valid_at").isNull() | (c("valid_at") < end))
    elif end is None:
        keep = (c("valid_from").isNull() | (c("valid_from") >= start)) & (c("valid_at").isNull() | (c("valid_at") >= start))
    else:
        inside = (start <= c("valid_from")) & (c("valid_from") < end) & (c("valid_to").isNull() | (c("valid_to") > end))
        keep = (c("valid_from").isNull() | inside) & (c("valid_at").isNull() | ((start <= c("valid_at")) & (c("valid_at") < end)))
    return keep if database is None else keep & (c("db_from") >= database)
