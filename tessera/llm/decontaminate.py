"""Benchmark decontamination by winnowing.

Every text is cut into k-grams of words and each k-gram is hashed. Over every
sliding window of ``span`` consecutive words only the minimum of its
``span - gram + 1`` k-gram hashes is kept as fingerprint. The minimum depends on
nothing but the window's words, so two texts that share ``span`` consecutive words
always share that window's fingerprint: joining fingerprints loses no shared span.

1. Benchmark windows, their fingerprints and the items that hold them.
2. One pass over the documents: distinct fingerprints of each, joined with the
   benchmark's. Only documents with a common fingerprint go on.
3. In those, windows with a common fingerprint are compared word for word with the
   benchmark's windows; overlapping windows extend to maximal hit intervals.

Items of fewer than ``span`` words are one window of their own length; for each such
length (at most ``span - 1`` of them) the documents' runs of that many words are
fingerprinted by their hash.

Defined results: a null or empty text has no words, is never hit and an item without
words matches nothing; an item with a null id marks words as hit but is not counted
among the items; rows that repeat an id or a whole document each get their own row;
an empty benchmark leaves all clean. Columns other than id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import BROADCAST_ROWS, Scratch, alnum_words, broadcast_if_small, let, small_or_salted, text_key, upto


def _run(words: Column, start: Column, length: int) -> list[Column]:
    """The words from ``start`` on, one by one: slice() would copy the whole array each time."""
    return [F.get(words, start + k) for k in range(length)]


def _grams(words: Column, gram: int) -> Column:
    return F.transform(upto(F.size(words) - (gram - 1)), lambda i: F.xxhash64(*_run(words, i, gram)))


def _minima(words: Column, span: int, gram: int) -> Column:
    """The fingerprint of each window of ``span`` words, by start; empty for shorter texts."""
    width = span - gram + 1
    return let(
        _grams(words, gram),
        lambda h: F.transform(upto(F.size(h) - (width - 1)), lambda j: F.least(*_run(h, j, width))),
    )


def _short(words: Column, length: int) -> Column:
    """Hash of each run of ``length`` words, by start."""
    return F.transform(
        upto(F.size(words) - (length - 1)), lambda j: F.xxhash64(F.lit(length), *_run(words, j, length))
    )


def _window(words: Column, start: Column, length: int) -> Column:
    return F.concat_ws(" ", *_run(words, start, length))


def _benchmark_windows(benchmark: DataFrame, item: str, text: str, span: int, gram: int) -> DataFrame:
    words = F.col("words")
    n = F.size(words)
    items = (
        benchmark.select(F.col(item).cast("string").alias("item"), alnum_words(F.col(text)).alias("words"))
        .where(n > 0)
        .distinct()
    )
    long = items.where(n >= span).select(
        "item",
        F.lit(span).alias("len"),
        F.inline(
            F.transform(
                _minima(words, span, gram),
                lambda fp, j: F.struct(fp.alias("fp"), _window(words, j, span).alias("window")),
            )
        ),
    )
    short = items.where(n < span).select(
        "item", n.alias("len"), F.xxhash64(n, words).alias("fp"), F.array_join(words, " ").alias("window")
    )
    return (
        long.unionByName(short)
        .groupBy("len", "fp", "window")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
        .withColumn("set_id", F.xxhash64("items"))
    )


def _intervals(at: Column, back: int) -> Column:
    """Maximal intervals of windows sorted by start. A window reaches at most ``span``
    words, so the furthest end before position i is among the ``back`` windows before it."""

    def reach(i: Column) -> Column:
        ends = [F.get(at, i - 1 - k)["end"] for k in range(back)]
        return F.greatest(*ends) if back > 1 else ends[0]

    opens = F.filter(at, lambda x, i: (i == 0) | (x["start"] > reach(i)))
    last = F.transform(at, lambda x, i: F.struct(F.get(at, i + 1)["start"].alias("next"), reach(i + 1).alias("end")))
    closes = F.filter(last, lambda x: x["next"].isNull() | (x["next"] > x["end"]))
    return F.zip_with(opens, closes, lambda a, b: F.struct(a["start"].alias("start"), b["end"].alias("end")))


def contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    span: int = 13,
    gram: int = 7,
    ratio: int = 20,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, n_items, items`` (sorted array of
    item ids as strings), ``hits`` (maximal hit intervals ``start, end`` in words, end
    exclusive), ``contaminated`` (n_hit > 0 and ratio * n_hit >= n_words)."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "decontaminate")
    windows = scratch.keep(_benchmark_windows(benchmark, item_id, item_text, span, gram), "windows")
    lengths = sorted(r[0] for r in windows.where(F.col("len") < span).select("len").distinct().collect())  # < span rows
    prints = windows.select("fp").distinct().withColumn("hit", F.lit(True))

    words = alnum_words(F.col(text))

    def fingerprints(w: Column) -> Column:
        parts = [_minima(w, span, gram), *[_short(w, k) for k in lengths]]
        return F.array_distinct(F.concat(*parts))

    docs = documents.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"), text_key(F.col(text)).alias("tk"))
    first = docs.select(
        "doc", "tk", let(words, lambda w: F.struct(F.size(w).alias("n"), fingerprints(w).alias("fps"))).alias("x")
    ).select("doc", "tk", "x.n", F.posexplode_outer("x.fps").alias("at", "fp"))
    seen = scratch.keep(
        small_or_salted(first, prints, ["fp"], limit=broadcast_rows, null_safe=False)
        .where(F.coalesce("at", F.lit(0)).eqNullSafe(0) | F.col("hit"))
        .groupBy("doc", "tk")
        .agg(
            F.max("n").cast("long").alias("n_words"),
            F.count(F.when(F.coalesce("at", F.lit(0)) == 0, 1)).alias("copies"),
            F.collect_set(F.when(F.col("hit"), F.col("fp"))).alias("fps"),
        ),
        "seen",
    )

    suspects = seen.where(F.size("fps") > 0).select(F.col("doc").alias("_d"), F.col("tk").alias("_t"), "fps")
    # few documents are suspects: the texts stay where they are unless their list is large
    suspects = broadcast_if_small(suspects, broadcast_rows, 8 * F.size("fps"))
    joined = docs.join(suspects, docs.doc.eqNullSafe(F.col("_d")) & (docs.tk == F.col("_t")))

    def candidates(w: Column, fps: Column) -> Column:
        def of(values: Column, length: int) -> Column:
            marked = F.transform(values, lambda v, j: F.struct(v.alias("fp"), j.alias("start")))
            return F.transform(
                F.filter(marked, lambda m: F.array_contains(fps, m["fp"])),
                lambda m: F.struct(
                    F.lit(length).alias("len"),
                    m["fp"].alias("fp"),
                    m["start"].alias("start"),
                    _window(w, m["start"], length).alias("window"),
                ),
            )

        return F.concat(of(_minima(w, span, gram), span), *[of(_short(w, k), k) for k in lengths])

    found = joined.select("doc", "tk", F.inline(let(words, lambda w: candidates(w, F.col("fps")))))
    hits = scratch.keep(
        small_or_salted(
            found, windows.select("len", "fp", "window", "set_id"), ["len", "fp", "window"], "inner", broadcast_rows, extra=F.octet_length("window"), null_safe=False
        )
        .groupBy("doc", "tk")
        .agg(
            F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("len")).alias("end")))).alias("at"),
            F.collect_set("set_id").alias("sets"),
        ),
        "hits",
    )
    # each window adds the words beyond the furthest end before it
    covered = F.aggregate(
        "at",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda s, x: F.struct(
            (s["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(s["end"], x["start"]))).alias("n"),
            F.greatest(s["end"], x["end"]).alias("end"),
        ),
        lambda s: s["n"].cast("long"),
    )
    sets = windows.select("set_id", "items").dropDuplicates(["set_id"])
    item_bytes = F.aggregate("items", F.lit(0), lambda n, x: n + 8 + F.octet_length(x))
    items = (
        small_or_salted(hits.select("doc", "tk", F.explode("sets").alias("set_id")), sets, ["set_id"], "inner", broadcast_rows, extra=item_bytes, null_safe=False)
        .select("doc", "tk", F.explode("items").alias("item"))
        .groupBy("doc", "tk")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    spans = hits.select(
        F.col("doc").alias("_hd"), F.col("tk").alias("_ht"), covered.alias("n_hit"), _intervals(F.col("at"), span * (len(lengths) + 1) if lengths else 1).alias("hits")
    )
    items = items.select(F.col("doc").alias("_id"), F.col("tk").alias("_it"), "items")
    return (
        seen.join(spans, seen.doc.eqNullSafe(F.col("_hd")) & (seen.tk == F.col("_ht")), "left")
        .join(items, seen.doc.eqNullSafe(F.col("_id")) & (seen.tk == F.col("_it")), "left")
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .select(
            F.col("doc").alias(doc_id),
            "tk",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
            F.coalesce("hits", F.array().cast("array<struct<start:int,end:int>>")).alias("hits"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("_any"),
        )
        .withColumn("contaminated", F.col("_any") & (ratio * F.col("n_hit") >= F.col("n_words")))
        .drop("_any")
    )


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    doc_id, text = options.get("doc_id", "doc_id"), options.get("text", "text")
    bad = (
        contamination(documents, benchmark, **options)
        .where("contaminated")
        .select(F.col(doc_id).alias("_bad_id"), F.col("tk").alias("_bad_tk"))
        .distinct()
    )
    bad = broadcast_if_small(Scratch(documents.sparkSession, "contaminated").keep(bad, "bad"), options.get("broadcast_rows", BROADCAST_ROWS))
    match = documents[doc_id].eqNullSafe(F.col("_bad_id")) & (text_key(documents[text]) == F.col("_bad_tk"))
    return documents.join(bad, match, "left_anti")
