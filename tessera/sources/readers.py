"""Readers: Parquet stores, delimited files, JDBC by year, cases by position."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import TABLES, empty


class WriteConflict(RuntimeError):
    """Someone else published a version since this step read the tables."""


class Store:
    """The stored tables below one folder; a table that isn't there is empty.

    A write makes a new folder beside the old ones. What is current is said by small files in
    ``_versions``, one for each step, which are created once and never changed: the newest whole one
    counts. So a step shows all its tables at once or none, a crash leaves the version before it, readers of
    old versions are not disturbed, and of two writers that began alike one gets WriteConflict."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _steps(self) -> list[str]:
        """Names of the version files, newest first."""
        fs, at = self._fs(f"{self.path}/_versions")
        return sorted((f.getPath().getName() for f in fs.listStatus(at)), reverse=True) if fs.exists(at) else []

    def _read_step(self, name: str) -> dict | None:
        fs, at = self._fs(f"{self.path}/_versions/{name}")
        file = fs.open(at)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8"))
        except ValueError:  # its writer died in between
            return None
        finally:
            file.close()

    def _newest(self) -> tuple[int, dict]:
        """The number of the newest step, whole or not, and what the newest whole one says."""
        steps = self._steps()
        found = next((x for x in map(self._read_step, steps) if x is not None), None)
        return int(steps[0]) if steps else 0, found or {"tables": {}, "marks": {}}

    def version(self, table: str) -> int:
        return self._newest()[1]["tables"].get(table, [0])[0]

    def mark(self, name: str):
        """What a step noted under a name, or None."""
        return self._newest()[1]["marks"].get(name)

    def _load(self, table: str, folder: str) -> DataFrame:
        return self.spark.read.schema(TABLES[table]).parquet(f"{self.path}/{folder}")

    def read(self, table: str, version: int | None = None) -> DataFrame:
        steps = [self._newest()[1]] if version is None else filter(None, map(self._read_step, self._steps()))
        for step in steps:
            v, folder = step["tables"].get(table, (0, ""))
            if v and version in (None, v):
                return self._load(table, folder)
        return empty(self.spark, table)

    def step(self) -> Step:
        return Step(self)

    def write(self, table: str, df: DataFrame, partition_by: list[str] | None = None) -> int:
        step = self.step()
        step.stage(table, df, partition_by)
        step.publish()
        return step.tables[table][0]

    def initialize(self) -> None:
        """Empty tables: everything stored before stays in its old versions only."""
        step = self.step()
        for name in TABLES:
            step.stage(name, empty(self.spark, name))
        step.publish()

    def register_views(self) -> None:
        """All tables as temporary views, for plain SQL."""
        for name in TABLES:
            self.read(name).createOrReplaceTempView(name)


class Step:
    """New versions of some tables that become current together."""

    def __init__(self, store: Store) -> None:
        self.store = store
        self.number, before = store._newest()
        self.tables, self.marks = dict(before["tables"]), dict(before["marks"])

    def stage(self, table: str, df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        """Write a table's next version, which nobody sees yet; gives it back as read."""
        v = self.tables.get(table, [0])[0] + 1
        folder = f"{table}/v{v}-{uuid.uuid4().hex[:8]}"
        writer = df.select(*TABLES[table].names).write
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.store.path}/{folder}")
        self.tables[table] = [v, folder]
        return self.store._load(table, folder)

    def publish(self, **marks) -> None:
        fs, at = self.store._fs(f"{self.store.path}/_versions/{self.number + 1:012d}")
        if fs.exists(at):
            raise WriteConflict(f"{at} is there already")
        try:
            file = fs.create(at, False)  # fails if it exists
        except Py4JJavaError as e:
            raise WriteConflict(str(at)) from e
        file.write(json.dumps({"tables": self.tables, "marks": self.marks | marks}).encode())
        file.close()


def delimited(spark: SparkSession, path: str, schema: str | T.StructType, sep: str = ";", header: bool = False) -> DataFrame:
    return spark.read.schema(schema).option("sep", sep).option("header", header).option("quote", '"').option("mode", "PERMISSIVE").csv(path)


def polygons(spark: SparkSession, path: str) -> DataFrame:
    """``id;wkt`` files without a header."""
    return delimited(spark, path, "id int, wkt string")


def object_rows(spark: SparkSession, path: str) -> DataFrame:
    """``code;name;start;end;wkt`` files; rows whose code is no number are dropped."""
    rows = delimited(spark, path, "code string, name string, start date, end date, wkt string")
    return rows.withColumn("code", F.col("code").try_cast("int")).where(F.col("code").isNotNull())


def case_rows(spark: SparkSession, path: str) -> DataFrame:
    """Case files by position: county, -, confirmed, -, -, -, -, -, updated, state and county codes."""
    names = ["county", "c1", "confirmed", "c3", "c4", "c5", "c6", "c7", "updated", "state_fips", "county_fips"]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = spark.read.schema(schema).option("sep", ",").csv(path)
    return rows.where(F.col("county").isNull() | (F.lower("county") != "county name")).select("county", "confirmed", "updated", "state_fips", "county_fips")


def jdbc_by_year(spark: SparkSession, url: str, query: str, tables: dict[int, str], **options: str) -> DataFrame:
    """One query for each year's shape table (``<shapetable>`` in the text), united with the year."""
    parts = []
    for year, table in sorted(tables.items()):
        text = query.replace("<shapetable>", table)
        df = spark.read.format("jdbc").option("url", url).option("query", text).options(**options).load()
        parts.append(df.withColumn("year", F.lit(year)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
