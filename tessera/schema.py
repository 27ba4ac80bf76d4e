"""The stored model: table schemas, scalar types, dataset registration and identifiers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


_KINDS = {"string": T.StringType(), "timestamp_ntz": T.TimestampNTZType(), "double": T.DoubleType(), "long": T.LongType()}


def _table(columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (c.split() for c in columns.split(", "))])


#: Timestamps carry no zone: instants are normalised to UTC when they are written.
TABLES = {
    "objects": _table("object_id string, class string, exists_from timestamp_ntz, exists_to timestamp_ntz, exists_at timestamp_ntz"),
    "facts": _table(
        "object_id string, property string, value string, datatype string, lang string, "
        "valid_from timestamp_ntz, valid_to timestamp_ntz, valid_at timestamp_ntz, db_from timestamp_ntz, db_to timestamp_ntz"
    ),
    "events": _table("event_id string, object_id string, event_type string, at timestamp_ntz, strength double"),
    "event_components": _table("event_id string, object_id string"),
    "relations": _table("subject string, relation string, object string"),
    "overlaps": _table("overlap_id string, a string, b string, wkt string, pct double"),
    "collection_members": _table("collection_id string, object_id string, relation_type string, strength double"),
    "metrics": _table("metric_id long, metric string"),
    "gauges": _table("metric_id long, ts timestamp_ntz, value double"),
    "counters": _table("metric_id long, ts timestamp_ntz, value long"),
    "datasets": _table("class string, parent string"),
}

#: Literal datatype, Spark type.
DATATYPES: dict[str, T.DataType] = {
    "xsd:int": T.IntegerType(),
    "xsd:short": T.ShortType(),
    "xsd:byte": T.ByteType(),
    "xsd:long": T.LongType(),
    "xsd:integer": T.DecimalType(38, 0),
    "xsd:decimal": T.DecimalType(38, 18),
    "xsd:float": T.FloatType(),
    "xsd:double": T.DoubleType(),
    "xsd:boolean": T.BooleanType(),
    "xsd:string": T.StringType(),
    "rdf:langString": T.StringType(),
    "xsd:date": T.DateType(),
    "xsd:dateTime": T.TimestampNTZType(),
    "geosparql:wktLiteral": T.StringType(),
}


def datatype_of(kind: T.DataType) -> str:
    """The literal datatype of a Spark type; unknown types are stored as strings."""
    if isinstance(kind, T.DecimalType):
        return "xsd:integer" if kind.scale == 0 else "xsd:decimal"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return "xsd:dateTime"
    return next((name for name, t in DATATYPES.items() if type(t) is type(kind) and name != "rdf:langString"), "xsd:string")


def typed(value: Column, datatype: str) -> Column:
    """A literal as its Spark type; null where it doesn't parse."""
    return value.try_cast(DATATYPES.get(datatype, T.StringType()))


class TypeCodecs:
    """User datatypes: a pair of column functions registered by name."""

    def __init__(self) -> None:
        self._codecs: dict[str, tuple] = {
            "uuid": (lambda c: F.lower(c.cast("string")), lambda c: F.when(c.rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), c))
        }

    def register(self, name: str, encode, decode) -> None:
        if name in self._codecs:
            raise ValueError(f"datatype {name} is registered already")
        self._codecs[name] = (encode, decode)

    def encode(self, name: str, value: Column) -> Column:
        return self._codecs[name][0](value)

    def decode(self, name: str, value: Column) -> Column:
        return self._codecs[name][1](value)


class RegistrationError(ValueError):
    """A dataset schema that can't be registered."""


@dataclass(frozen=True)
class Fact:
    column: str
    name: str | None = None
    datatype: str | None = None
    language: str | None = None
    related: bool = False

    @property
    def property(self) -> str:
        return self.name or self.column


@dataclass(frozen=True)
class DatasetSchema:
    """How the columns of a DataFrame become objects of one class."""

    name: str
    identifier: str
    facts: Sequence[Fact] = ()
    spatial: str | None = None
    srid: int = 4326
    start: str | None = None
    end: str | None = None
    point: str | None = None
    #: with ``start`` and no ``end``: how long an object lives; none or not positive leaves it open
    duration: str | None = None
    zone: str = "UTC"
    default_language: str | None = None
    multi_language: bool = True
    links: dict[str, str] = field(default_factory=dict)  # column with another object's id: relation

    def validate(self, columns: Sequence[str]) -> DatasetSchema:
        named = [self.identifier, *(f.column for f in self.facts), *filter(None, (self.spatial, self.start, self.end, self.point)), *self.links]
        if missing := [c for c in named if c not in columns]:
            raise RegistrationError(f"{self.name}: no such columns: {', '.join(missing)}")
        if not self.name:
            raise RegistrationError("a dataset needs a name")
        if self.identifier in (f.column for f in self.facts):
            raise RegistrationError(f"{self.name}: the identifier can't be a fact too")
        if bool(self.start) == bool(self.point):
            raise RegistrationError(f"{self.name}: give either a start or a point in time")
        if self.end and (not self.start or self.duration):
            raise RegistrationError(f"{self.name}: an end needs a start and excludes a duration")
        names = [f.property for f in self.facts]
        if len(set(names)) < len(names) and not self.multi_language:
            raise RegistrationError(f"{self.name}: a property occurs twice")
        for f in self.facts:
            if f.datatype is not None and f.datatype not in DATATYPES:
                raise RegistrationError(f"{self.name}: unknown datatype {f.datatype}")
            for lang in filter(None, (f.language, self.default_language)):
                if not _is_language(lang):
                    raise RegistrationError(f"{self.name}: {lang} is no language code")
        return self

    def lifetime(self) -> tuple[Column, Column, Column]:
        """exists_from, exists_to, exists_at; dates count from the start of day."""
        none = F.lit(None).cast("timestamp_ntz")
        if self.point:
            return none, none, F.col(self.point).cast("timestamp_ntz")
        start = F.col(self.start).cast("timestamp_ntz")
        if self.end:
            return start, F.col(self.end).cast("timestamp_ntz"), none
        if self.duration and not self.duration.strip().startswith(("-", "0 ")):
            return start, (start + F.expr(f"INTERVAL {self.duration}")).cast("timestamp_ntz"), none
        return start, none, none


def _is_language(code: str) -> bool:
    parts = code.split("-")
    return 2 <= len(parts[0]) <= 3 and parts[0].isalpha() and all(2 <= len(p) <= 8 and p.isalnum() for p in parts[1:])


class Catalog:
    """Registered datasets."""

    def __init__(self) -> None:
        self._schemas: dict[str, DatasetSchema] = {}

    def register(self, schema: DatasetSchema, df: DataFrame) -> DatasetSchema:
        self._schemas[schema.name] = schema.validate(df.columns)
        return schema

    def remove(self, name: str) -> None:
        self._schemas.pop(name, None)

    def __getitem__(self, name: str) -> DatasetSchema:
        if name not in self._schemas:
            raise RegistrationError(f"{name} is not registered")
        return self._schemas[name]

    def names(self) -> list[str]:
        return sorted(self._schemas)


def empty(spark: SparkSession, table: str) -> DataFrame:
    """An empty table that the planner knows to be empty."""
    return spark.createDataFrame([], TABLES[table]).where("false")
