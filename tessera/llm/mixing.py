"""Mixing sources to target weights by capped water-filling.

Each source has a weight and can be repeated at most ``epochs`` times. The budget (the
size of all documents) is filled proportionally to the weights; a source whose share
exceeds ``epochs`` times its size is clamped there and its excess goes to the others by
weight, round by round, until none is above. Sources are numbered by a distributed sort and
each round is one aggregate over them, so there may be as many of them as web sites.

A source with target t and size s is taken floor(t / s) whole times; of the rest, a
seeded order of its documents is taken up to the exact word: documents before the cut
once more, the one at the cut in part. The cut is found by a histogram over 65,536 hash
buckets for each source, summed in two steps of 256, so a hot source is never ordered in one task.

Defined results: a null text has size 0; documents without a source are a source of
their own, last in order; sources of size 0 have target 0; no documents give no rows;
identical rows are interchangeable. The order depends on seed, id and text alone, and rows
that agree in these are numbered by a hash of all their columns, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import NOT_SPACE, Scratch, small_or_salted, space_words

WEIGHTS = (5, 2, 1)


def _ranked(sizes: DataFrame, scratch: Scratch) -> DataFrame:
    """``sizes`` with ``_rank``, the place of each source in order of code points, null last, from 0."""
    at = scratch.keep(sizes.orderBy(F.asc_nulls_last("source")).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part, place = F.shiftright("_at", 33).cast("int"), F.col("_at").bitwiseAND((1 << 33) - 1)
    # one row for each partition of the sort
    counts = {r["p"]: r["n"] for r in at.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = [], 0
    for p in range(max(counts, default=0) + 1):
        before.append(total)
        total += counts.get(p, 0)
    return at.withColumn("_rank", F.get(F.array(*[F.lit(x).cast("long") for x in before]), part) + place).drop("_at")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = 3) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``: one row for each source."""
    ranked = _ranked(sizes, Scratch(sizes.sparkSession, "targets"))
    weight = F.get(F.array(*[F.lit(w) for w in weights]), F.pmod("_rank", F.lit(len(weights))).cast("int"))
    ranked = ranked.select("source", "source_size", weight.cast("long").alias("w"), (epochs * F.col("source_size")).alias("cap"))
    budget, all_weights = ranked.agg(F.sum("source_size"), F.sum("w")).first()
    if not all_weights:
        return ranked.select("source", "source_size", F.lit(0.0).alias("target"))
    left, wsum = budget, all_weights
    while True:
        # share > cap, without rounding and without overflow
        above = F.col("cap").cast("decimal(38,0)") * F.lit(wsum) < F.col("w").cast("decimal(38,0)") * F.lit(left)
        cap, w = ranked.where(above).agg(F.coalesce(F.sum("cap"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
        if (budget - cap, all_weights - w) == (left, wsum) or w == all_weights:
            break
        left, wsum = budget - cap, all_weights - w
    share = (F.col("w") * F.lit(left)).cast("double") / F.lit(float(wsum))
    return ranked.select("source", "source_size", F.when(above, F.col("cap").cast("double")).otherwise(share).alias("target"))


def _order(seed: int, doc_id: Column, text: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))))


def mix(
    documents: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    epochs: int = 3,
    seed: int = 17,
) -> DataFrame:
    """``doc_id, source, order, size, source_size, target, whole, part, taken`` per document;
    ``order`` is the document's seeded key, ``taken = whole * size + part``."""
    scratch = Scratch(documents.sparkSession, "mixing")
    slim = scratch.keep(
        documents.select(
            F.col(doc_id).alias("doc_id"),
            F.col(source).alias("source"),
            F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(NOT_SPACE)).cast("long").alias("size"),
            _order(seed, F.col(doc_id), F.col(text)).alias("order"),
        ),
        "slim",
    )
    by_source = targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.round("target") / F.col("source_size"))).otherwise(0).cast("long")
    by_source = scratch.keep(
        by_source.withColumn("whole", whole).withColumn(
            "quota", F.round("target").cast("long") - F.col("whole") * F.col("source_size")
        ),
        "targets",
    )
    slim = slim.withColumn("bucket", F.substring("order", 1, 4))
    buckets = slim.groupBy("source", "bucket", F.substring("order", 1, 2).alias("top")).agg(F.sum("size").alias("bucket_size"))
    buckets = scratch.keep(buckets, "buckets")

    def before(total: str, *keys: str, by: str) -> Column:
        return F.coalesce(F.sum(total).over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    # both windows run over at most 256 rows for each key
    tops = buckets.groupBy("source", "top").agg(F.sum("bucket_size").alias("top_size"))
    tops = tops.select(F.col("source").alias("_ts"), F.col("top").alias("_t"), before("top_size", "source", by="top").alias("top_start"))
    buckets = buckets.withColumn("start", before("bucket_size", "source", "top", by="bucket"))
    buckets = buckets.join(tops, buckets.source.eqNullSafe(F.col("_ts")) & (buckets.top == F.col("_t"))).select(
        F.col("source").alias("_s"), F.col("bucket").alias("_b"), (F.col("start") + F.col("top_start")).alias("start")
    )
    placed = slim.join(buckets, slim.source.eqNullSafe(F.col("_s")) & (slim.bucket == F.col("_b"))).drop("_s", "_b")
    within = Window.partitionBy("source", "bucket").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("before", F.col("start") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = small_or_salted(placed, by_source, ["source"], "inner")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("quota") - F.col("before")))
    return placed.withColumn("part", part.cast("long")).select(
        "doc_id",
        "source",
        "order",
        "size",
        "source_size",
        "target",
        "whole",
        "part",
        (F.col("whole") * F.col("size") + F.col("part")).alias("taken"),
    )


def _key(order: Column, source: Column) -> Column:
    """One key without nulls for a document: its order already stands for id and text."""
    return F.concat(order, F.when(source.isNull(), "-").otherwise(F.concat(F.lit("+"), source)))


def mixed_documents(documents: DataFrame, **options) -> DataFrame:
    """The mixture itself: every document as often as it is taken, with all its columns; the
    partly taken document of a source is cut after its last taken word."""
    doc_id, text, source = (options.get(k, k) for k in ("doc_id", "text", "source"))
    seed = options.get("seed", 17)
    # rows that repeat a document are numbered on both sides; the join's keys are the window's, so
    # the texts are shuffled once
    plan = (
        mix(documents, **options)
        .where(F.col("taken") > 0)
        .groupBy(_key(F.col("order"), F.col("source")).alias("_k"))
        .agg(F.sort_array(F.collect_list(F.struct("whole", "part", "size")), asc=False).alias("rows"))
        .select("_k", F.posexplode("rows").alias("_at", "_row"))
    )
    keyed = documents.withColumn("_k1", _key(_order(seed, documents[doc_id], documents[text]), documents[source]))
    keyed = keyed.withColumn("_n", F.row_number().over(Window.partitionBy("_k1").orderBy(F.xxhash64(*documents.columns))))
    joined = keyed.join(plan, (F.col("_k1") == F.col("_k")) & (F.col("_n") - F.col("_at") == 1))
    size, whole, part = (F.col("_row")[c] for c in ("size", "whole", "part"))
    lengths = F.concat(F.array_repeat(size, whole.cast("int")), F.filter(F.array(part), lambda p: p > 0))
    cut = F.array_join(F.slice(space_words(F.col(text)), F.lit(1), F.col("_len").cast("int")), " ")
    return (
        joined.withColumn("_len", F.explode(lengths))
        .withColumn(text, F.when(F.col("_len") < size, cut).otherwise(F.col(text)))
        .select(*documents.columns)
    )
