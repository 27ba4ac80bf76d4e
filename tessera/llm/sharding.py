"""Sharding by sampled splitters.

Records are ordered by (CRC-32 of the text, hash of the id) and cut into shards of near
equal bytes. A size-weighted sample of the keys gives quantile boundaries for many narrow
ranges; the records of each range are counted exactly. Ranges are subdivided on a regular grid of
CRCs whose cells shrink as the input grows, so that none holds much more than ``cell_bytes`` at any
size; a text with so many copies that its one CRC holds more than twice that is subdivided by the hash
of the id. Running sums over the ranges, and inside each range over its records, give every
record its exact position in the whole order without sorting all records in one place;
a record goes to the shard that holds the middle of its bytes. The splitters only balance
the work: the result depends on the order alone, so reruns agree.

Law ``bytes``: shard sizes differ by less than the largest record. Equal texts stand together, but a
group of them that lies across one of the borders between shards is cut there: at most one group for each
border. Defined results: a null
text has size 1 and CRC 0 like an empty one, but keeps its own row; null ids sort first;
equal rows are interchangeable; no documents give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import Scratch, broadcast_if_small


def _splitters(slim: DataFrame, total: int, ranges: int, per_range: int) -> list[float]:
    """Quantiles of the CRC, weighted by size: a row is drawn with probability size * rate, at
    most 1, by a hash of its key. About ranges * per_range rows are drawn, whatever the input."""
    rate = ranges * per_range / max(total, 1)
    u = (F.pmod(F.xxhash64("_crc", "_salt", F.lit(7)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    drawn = slim.where(u < F.col("_size") * rate)
    weight = F.greatest(F.lit(1), F.round(F.col("_size") * rate)).cast("long")
    at = [(i + 1) / ranges for i in range(ranges - 1)]
    row = drawn.agg(F.percentile("_crc", F.array(*[F.lit(x) for x in at]), weight).alias("q")).first()
    return sorted({float(x) for x in row["q"] or []})


def _range_of(key: Column, splitters: list[float]) -> Column:
    """How many splitters are at most ``key``: two levels, so about 2 * sqrt(ranges) comparisons."""
    step = max(1, int(len(splitters) ** 0.5))
    coarse = splitters[::step]
    fine = [splitters[i : i + step] for i in range(0, len(splitters), step)]

    def count(values: Column) -> Column:
        return F.size(F.filter(values, lambda x: x <= key))

    if not splitters:
        return F.lit(0)
    top = count(F.array(*[F.lit(x) for x in coarse]))
    groups = F.array(*[F.array(*[F.lit(x) for x in g]) for g in fine])
    return F.when(top == 0, 0).otherwise((top - 1) * step + count(F.get(groups, top - 1)))


def shards(
    documents: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    n_shards: int = 16,
    ranges: int = 512,
    sample_per_range: int = 40,
    cell_bytes: int = 512 << 20,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` for every document, and the columns of
    ``carry``, which have other names; ``slot`` counts each shard's rows from 0 in key order."""
    scratch = Scratch(documents.sparkSession, "sharding")
    crc, salt = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")), F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    records = documents.select(
        F.col(doc_id).alias("_doc"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long").alias("_size"),
        crc.alias("_crc"),
        salt.alias("_salt"),
        *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)],
    )
    slim = scratch.keep(records.select("_doc", "_size", "_crc", "_salt"), "slim")
    total = slim.agg(F.sum("_size")).first()[0] or 0
    share = max(1.0, min(total / ranges, cell_bytes))
    cells = -(-total // cell_bytes)  # of the whole space of CRCs
    cell = F.expr(f"_crc * {max(cells, 1)}L div {1 << 32}L")
    cuts = _splitters(slim, total, ranges, sample_per_range)

    # overfull units: a CRC of over two shares gets a range of its own, in parts by the id's hash
    ranged = slim.withColumn("_range", _range_of(F.col("_crc").cast("double"), cuts)).withColumn("_cell", cell)
    overfull = ranged.groupBy("_range", "_cell").agg(F.sum("_size").alias("b")).where(F.col("b") > 2 * share).select("_range", "_cell")
    hot = {
        r["_crc"]: math.ceil(r["b"] / share)
        for r in ranged.join(broadcast_if_small(overfull), ["_range", "_cell"], "left_semi")
        .groupBy("_crc")
        .agg(F.sum("_size").alias("b"))
        .where(F.col("b") > 2 * share)
        .collect()  # each holds over two shares: at most half as many as there are shares
    }
    cuts = sorted({*cuts, *map(float, hot), *(h + 1.0 for h in hot)})
    part = F.lit(0)
    if hot:
        n_parts = F.create_map(*[x for k, v in hot.items() for x in (F.lit(k).cast("long"), F.lit(v))])[F.col("_crc")]
        digits = F.conv(F.substring("_salt", 1, 7), 16, 10).cast("long")
        part = F.coalesce(F.floor(digits * n_parts / float(1 << 28)), F.lit(0)).cast("int")

    def placed(rows: DataFrame) -> DataFrame:
        return rows.withColumns({"_range": _range_of(F.col("_crc").cast("double"), cuts), "_cell": cell, "_part": part})

    def before(value: str, window) -> Column:
        return F.coalesce(F.sum(value).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    unit = ["_range", "_cell", "_part"]
    units = scratch.keep(placed(slim).groupBy(*unit).agg(F.sum("_size").alias("b"), F.count(F.lit(1)).alias("n")), "units")
    over = Window.orderBy("_range")  # as many rows as ranges
    tops = units.groupBy("_range").agg(F.sum("b").alias("b"), F.sum("n").alias("n"))
    tops = tops.select("_range", before("b", over).alias("_b"), before("n", over).alias("_n"))
    inner = Window.partitionBy("_range").orderBy("_cell", "_part")
    units = units.select(*unit, before("b", inner).alias("b"), before("n", inner).alias("n")).join(F.broadcast(tops), "_range")
    units = units.select(*unit, (F.col("b") + F.col("_b")).alias("_bytes0"), (F.col("n") + F.col("_n")).alias("_row0"))
    order = Window.partitionBy(*unit).orderBy("_crc", "_salt", "_doc", "_size")
    ahead = F.col("_bytes0") + F.coalesce(F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    located = (
        placed(records if carry else slim)
        .join(broadcast_if_small(units), unit)
        .withColumn("_ahead", ahead)
        .withColumn("_row", F.col("_row0") + F.row_number().over(order) - 1)
        .withColumn("shard", F.expr(f"cast(({n_shards} * (2 * _ahead + _size)) div {2 * max(total, 1)} as int)"))
        .drop(*unit, "_bytes0", "_row0", "_ahead", "_salt")
    )
    located = scratch.keep(located, "located")
    first = F.broadcast(located.groupBy("shard").agg(F.min("_row").alias("_first")))  # n_shards rows
    return located.join(first, "shard").select(
        F.col("_doc").alias(doc_id),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        "shard",
        (F.col("_row") - F.col("_first")).cast("long").alias("slot"),
        *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)],
    )
