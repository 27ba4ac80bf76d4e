"""Connected components of an edge table by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch


SALTS = 32


def with_least(rows: DataFrame, key: str, value: str, rows_at_least: int = 1) -> DataFrame:
    """Rows of keys that have at least so many, with ``m``, the least ``value`` of their key.

    Keys are reduced before the shuffle, to the least and a bit for each of SALTS parts in which a row's
    value falls; a key's least then goes back to those parts only, at most once for each row, so a hub's
    rows are dealt over as many tasks."""
    salt = F.pmod(F.xxhash64(value), F.lit(SALTS)).cast("int")
    parts = rows.select(F.col(key).alias("_k"), F.col(value).alias("_v"), salt.alias("_s"))
    whole = parts.groupBy("_k").agg(F.min("_v").alias("m"), F.count(F.lit(1)).alias("_c"), F.bit_or(F.expr("shiftleft(1L, _s)")).alias("_bits"))
    whole = whole.where(F.col("_c") >= rows_at_least).select("_k", "m", F.explode(F.expr(f"filter(sequence(0, {SALTS - 1}), i -> getbit(_bits, i) = 1)")).alias("_t"))
    return rows.join(whole, (F.col(key) == F.col("_k")) & (salt == F.col("_t"))).drop("_k", "_t")


def _with_least(edges: DataFrame) -> DataFrame:
    """``u, v`` and ``m``: the least of u and all its neighbours."""
    return with_least(edges, "u", "v").select("u", "v", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    linked = _with_least(down)
    ends = linked.select("v", "m").unionByName(linked.select(F.col("u").alias("v"), "m"))
    return ends.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def components(edges: DataFrame, scratch: Scratch, name: str, max_rounds: int = 60) -> DataFrame:
    """``node, component`` (the least node reachable) of every node of the edges ``u, v``;
    nodes that are their own component's least node included."""

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    edges = scratch.keep(
        edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        f"{name}-0",
    )
    before = mark(edges)
    for i in range(1, max_rounds + 1):
        if not before[0]:
            break
        edges = scratch.keep(_small_star(_large_star(edges)), f"{name}-{i}")
        scratch.drop(f"{name}-{i - 1}")
        now = mark(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not converge")
    tops = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)
