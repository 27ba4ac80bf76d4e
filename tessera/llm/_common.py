"""Helpers shared by the training-data operators: tokenising expressions,
let-bindings, intermediate tables and size-checked joins.

Intermediate results live in the folder that ``spark.checkpoint.dir`` names, as
Parquet, so that they outlive any executor. Where that setting is absent, local mode
uses a temporary folder; a cluster, whose machines don't share one, gets an error.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
SPACE = "[\\x20\\x09-\\x0D]+"
NOT_SPACE = "[^\\x20\\x09-\\x0D]+"
NOT_ALNUM = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: A side of a join is broadcast only if it was counted to hold no more rows than this, ...
BROADCAST_ROWS = 400_000
#: ... and measured to hold no more bytes in its strings, arrays and binaries.
BROADCAST_BYTES = 64 << 20


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only, as every contract of this package asks."""
    return F.translate(text, UPPER, LOWER)


def space_words(text: Column) -> Column:
    """Words between ASCII white space; an empty array for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def alnum_words(text: Column) -> Column:
    """Lower-cased runs of a-z, 0-9 and non-ASCII characters; an empty array for null."""
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), NOT_ALNUM), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``; the optimiser can't inline it
    into an inner lambda, which would evaluate it again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def upto(n: Column) -> Column:
    """0, 1, ... n-1 as an array; empty for n <= 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


_stashed: list[tuple[SparkSession, str]] = []
_own: dict[str, str] = {}


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended: the cluster's own clean-up removes the folder
        pass


@atexit.register
def _tidy() -> None:
    while _stashed:
        _remove(*_stashed.pop())


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or _own.get(spark.sparkContext.applicationId)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = _own[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="tessera-")
        _stashed.append((spark, base))
    return base.rstrip("/")


class Scratch:
    """Tables of one run of an operator, written to the shared folder."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        _stashed.append((spark, self.path))

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write and read back: cuts the lineage and is computed once."""
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str) -> None:
        """Give back the disk of a table that nothing reads any more."""
        _remove(self.spark, f"{self.path}/{name}")


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, extra: Column | None = None) -> DataFrame:
    """Marks a table for broadcast after counting its rows and summing ``extra``, the bytes of its columns
    of varying length; a larger one is left to a shuffled join."""
    n, size = df.agg(F.count(F.lit(1)), F.sum(F.lit(0) if extra is None else extra.cast("long"))).first()
    return F.broadcast(df) if n <= rows and (size or 0) <= BROADCAST_BYTES else df


def small_or_salted(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str = "left",
    limit: int = BROADCAST_ROWS,
    salts: int = 64,
    extra: Column | None = None,
    null_safe: bool = True,
) -> DataFrame:
    """Join ``left`` to a table with one row for each key.

    The right side is measured as in ``broadcast_if_small``: up to ``limit`` rows it is broadcast; beyond
    that it is copied once for each salt and the left rows are dealt over the salts, so that a key
    with a third of all rows is spread over ``salts`` tasks. Keys compare null-safe unless told otherwise.
    """
    n, size = right.agg(F.count(F.lit(1)), F.sum(F.lit(0) if extra is None else extra.cast("long"))).first()
    if n <= limit and (size or 0) <= BROADCAST_BYTES:
        right = F.broadcast(right)
        keys = on
    else:
        left = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
        right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        keys = [*on, "_salt"]
    right = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"_r_{k}"]) if null_safe else left[k] == right[f"_r_{k}"] for k in keys])
    return left.join(right, cond, how).drop(*[f"_r_{k}" for k in keys], "_salt")


def text_key(text: Column) -> Column:
    """With the id, tells rows of the same id but other text apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")), F.isnull(text))


def one_of_each(df: DataFrame, keys: list[str], scratch: Scratch, name: str) -> DataFrame:
    """``df`` with one row for each value of ``keys``, which hold no nulls: of rows that repeat them the one
    whose columns hash least. Only such rows are shuffled; where none repeats, ``df`` itself is given back."""
    again = scratch.keep(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > 1).drop("_c"), f"{name}-again")
    if again.isEmpty():
        return df
    again = broadcast_if_small(again)
    one = df.join(again, keys, "left_semi").groupBy(*keys).agg(F.min_by(F.struct(*df.columns), F.xxhash64(*df.columns)).alias("_x"))
    one = scratch.keep(one.select("_x.*"), name)
    return df.join(again, keys, "left_anti").select(*df.columns).unionByName(one)
