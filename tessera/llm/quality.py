"""Quality rules whose cutoffs are chosen under a risk bound.

Each rule is a percentage computed from the text (symbols, repeated lines, ...); a
document breaks the rule if its value reaches the rule's cutoff. Cutoffs are chosen for
each stratum (language) and rule on labelled holdouts: a cutoff is admissible if the exact
(Clopper-Pearson) upper bound for its rate of false rejections among good documents stays
within the rule's share of the risk. With k false rejections among n good documents that
holds exactly if P(Bin(n, risk) <= k) <= delta', so one number k* for each stratum says which
cutoffs pass. A rule's cutoffs are nested, so they are tested in a fixed order from the
mildest on until one fails, each at the full delta' (fixed-sequence testing): since a stricter
cutoff rejects no fewer, those that pass are the ones with at most k* false rejections. Over
rules and strata delta' is delta / (strata x rules) (Bonferroni); hence with probability
1 - delta no stratum loses more than ``risk`` of its good documents.
Among the admissible cutoffs the one with most rejected bad documents less ``price`` times
the rejected good ones is taken, the mildest on ties; if none is admissible or none helps,
the rule is off there.

Defined results: a null or empty text has no words and fails the base rule; a null
language is a stratum of its own; labels without a document or with a null quality are
ignored, a document with several labels counts as good only if all of them say so; with
no labels at all every rule is off and the base rule alone decides. Rows that repeat an
id each get their own row. 3-word windows are compared by 64-bit hash within a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import Scratch, let, small_or_salted, space_words, upto

RULES = ("symbols", "dup_lines", "repeats", "shouting", "marks", "few_words")


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur at least twice in the text."""

    def covered(tri: Column) -> Column:
        pairs = F.sort_array(F.transform(tri, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = let(
            pairs,
            lambda p: F.sort_array(
                F.transform(
                    F.filter(
                        p,
                        lambda x, i: F.coalesce(F.get(p, i - 1)["h"] == x["h"], F.lit(False))
                        | F.coalesce(F.get(p, i + 1)["h"] == x["h"], F.lit(False)),
                    ),
                    lambda x: x["i"],
                )
            ),
        )
        return F.aggregate(
            again,
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
            lambda s, i: F.struct((s["n"] + i + 3 - F.greatest(s["end"], i)).alias("n"), (i + 3).alias("end")),
            lambda s: s["n"],
        )

    # element by element: slice() would copy the whole array for every position
    tri = F.transform(upto(F.size(words) - 2), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(3)]))
    return let(tri, lambda t: F.when(F.size(F.array_distinct(t)) == F.size(t), F.lit(0)).otherwise(covered(t)))


def measures(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """``doc_id, stratum``, the counts of the base rule and each rule's percentage."""
    body = F.coalesce(F.col(text), F.lit(""))
    words = space_words(body)
    lines = F.filter(F.split(body, "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)
    of_words = let(
        words,
        lambda w: F.struct(
            F.size(w).alias("n_words"),
            F.size(F.array_distinct(w)).alias("n_distinct"),
            _repeat_words(w).alias("n_repeat_words"),
        ),
    )
    of_lines = let(
        lines,
        lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")),
    )
    counts = documents.select(
        F.col(doc_id).alias("doc_id"),
        F.col(stratum).alias("stratum"),
        of_words.alias("w"),
        of_lines.alias("l"),
        F.length(F.translate(body, " \t\n\x0b\x0c\r", "")).alias("word_chars"),
        F.regexp_count(body, F.lit("[#*$%&|<>]")).alias("n_symbols"),
        F.regexp_count(body, F.lit("\\p{Lu}")).alias("n_upper"),
        F.regexp_count(body, F.lit("[!?\\u00a1\\u00bf|]")).alias("n_marks"),
    ).select("doc_id", "stratum", "w.*", "l.*", "word_chars", "n_symbols", "n_upper", "n_marks")

    def percent(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, F.least(F.floor(100 * part / whole), F.lit(100))).otherwise(0).cast("int")

    c = F.col
    values = {
        "symbols": percent(c("n_symbols"), c("word_chars")),
        "dup_lines": percent(c("n_dup_lines"), c("n_lines")),
        "repeats": percent(c("n_repeat_words"), c("n_words")),
        "shouting": percent(c("n_upper"), c("word_chars")),
        "marks": percent(c("n_marks"), c("n_words")),
        "few_words": percent(c("n_words") - c("n_distinct"), c("n_words")),
    }
    longs = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return counts.select(
        "doc_id", "stratum", *[c(x).cast("long").alias(x) for x in longs], *[values[r].alias(r) for r in RULES]
    ).withColumn("base_failed", (c("n_words") < 50) | (100 * c("n_repeat_words") > 50 * c("n_words")))


def _log_gamma(x: Column) -> Column:
    """ln gamma(x) for x >= 1: Stirling's series at x + 8, stepped back down."""
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    for k in range(8):
        series = series - F.log(x + k)
    return series


def most_rejections(n: Column, risk: float, delta: Column) -> Column:
    """The largest k with P(Bin(n, risk) <= k) <= delta; -1 if there is none.

    Below n * risk - 12 standard deviations - 60 a term is under 1e-25 of the largest,
    so the sum starts there; it ends at the mean, where the tail exceeds any delta < 0.4."""
    nd = n.cast("double")
    mean = nd * risk
    start = F.greatest(F.lit(0), F.floor(mean - 12 * F.sqrt(mean) - 60)).cast("long")
    i0 = start.cast("double")
    first = (
        _log_gamma(nd + 1) - _log_gamma(i0 + 1) - _log_gamma(nd - i0 + 1) + i0 * F.log(F.lit(risk)) + (nd - i0) * F.log(F.lit(1 - risk))
    )
    odds = risk / (1 - risk)
    # p: the log of the next term; cdf: the sum before it; k: the last index within delta
    return F.aggregate(
        F.sequence(start, F.greatest(start, F.ceil(mean).cast("long"))),
        F.struct(first.alias("p"), F.lit(0.0).alias("cdf"), F.lit(-1).cast("long").alias("k")),
        lambda s, i: F.struct(
            (s["p"] + F.log(F.greatest(nd - i, F.lit(0.5)) / (i + 1)) + F.log(F.lit(odds))).alias("p"),
            (s["cdf"] + F.exp(s["p"])).alias("cdf"),
            F.when(s["cdf"] + F.exp(s["p"]) <= delta, i).otherwise(s["k"]).alias("k"),
        ),
        lambda s: F.least(s["k"], n),
    )


def cutoffs(measured: DataFrame, labels: DataFrame, *, risk: float = 0.05, delta: float = 0.05, price: int = 20) -> DataFrame:
    """``stratum, rule, cutoff, n_good, k_max, n_false, n_caught``: a row for each rule that is on."""
    rule_risk = risk / len(RULES)
    truth = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("good"))
    )
    long = (
        measured.where(~F.col("base_failed"))
        .join(truth, "doc_id")
        .select("stratum", "good", F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("bin")) for r in RULES])))
    )
    bins = long.groupBy("stratum", "rule", "bin").agg(
        F.sum(F.when(F.col("good") == 1, 1).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("good") == 0, 1).otherwise(0)).alias("bad"),
    )
    # at most 101 bins for each stratum and rule
    down = Window.partitionBy("stratum", "rule").orderBy(F.desc("bin"))
    whole = Window.partitionBy("stratum", "rule")
    steps = bins.select(
        "stratum",
        "rule",
        "bin",
        F.sum("good").over(down).alias("n_false"),
        F.sum("bad").over(down).alias("n_caught"),
        F.sum("good").over(whole).alias("n_good"),
    )
    strata = bins.select("stratum").distinct().agg(F.count(F.lit(1)).alias("n_strata"))
    tests = F.lit(len(RULES)) * F.col("n_strata")  # the cutoffs of a rule are one sequence
    best = Window.partitionBy("stratum", "rule").orderBy(F.desc("gain"), F.desc("bin"))
    return (
        steps.join(F.broadcast(strata))  # one row
        .withColumn("k_max", most_rejections(F.col("n_good"), rule_risk, F.lit(delta) / tests))
        .withColumn("gain", F.col("n_caught") - price * F.col("n_false"))
        .where((F.col("bin") >= 1) & (F.col("n_false") <= F.col("k_max")) & (F.col("gain") > 0))
        .withColumn("_rank", F.row_number().over(best))
        .where(F.col("_rank") == 1)
        .select("stratum", "rule", F.col("bin").alias("cutoff"), "n_good", "k_max", "n_false", "n_caught")
    )


def judge(
    documents: DataFrame, labels: DataFrame, *, risk: float = 0.05, delta: float = 0.05, price: int = 20, stratum: str = "lang"
) -> DataFrame:
    """All measures of every document, ``base_failed``, ``broken`` (rules broken, sorted) and ``kept``."""
    scratch = Scratch(documents.sparkSession, "quality")
    measured = scratch.keep(measures(documents, stratum=stratum), "measures")
    chosen = scratch.keep(
        cutoffs(measured, labels, risk=risk, delta=delta, price=price)
        .groupBy("stratum")
        .agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cuts")),
        "cutoffs",
    )
    broken = F.array_compact(
        F.array(*[F.when(F.col(r) >= F.col("cuts")[r], F.lit(r)) for r in sorted(RULES)])
    )
    return (
        small_or_salted(measured, chosen, ["stratum"])
        .withColumn("broken", F.when(F.col("cuts").isNull(), F.array().cast("array<string>")).otherwise(broken))
        .withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))
        .drop("cuts")
    )
