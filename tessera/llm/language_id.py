"""Language ID by prediction by partial matching.

For each language a tree of byte contexts of length ``order``, ... 1, 0 counts which symbol
follows. A symbol is coded in the longest context that the tree knows; one that this context
has not seen is coded by an escape (method C: as likely as the context has kinds of symbols)
and the next shorter context, and below length 0 the symbols left are equally likely.
Statistics are frozen after training, so a text's code length under each language is a sum over
its symbols, over the whole text. The language with the shortest code wins.

Symbols: lower-cased bytes; digits, white space and other ASCII characters are one symbol
each. Nothing else is merged: all bytes of other scripts are kept apart.

The trees are hashed tables of fixed size. A slot belongs to the string that is most frequent in
training among those that fall there, is checked by 16 more bits of its hash, and holds one value
for each language; what finds no slot is coded by escape. All tables together have about ``cells``
values (more only with over a thousand languages): slots grow fewer as languages grow more, and no
language is left out. Bound on training: about ``per_language`` texts of each, drawn by a hash of the id.

Defined results: ``und`` with score 0 for a null text, one without letters, or if there is
nothing to learn from; ties go to the first language in order. A null id counts as an empty
string. ``score`` is the winner's share of 2**-bits over the languages, the evidence scaled
down to that of 64 symbols, so long texts don't all score 1. Rows that repeat get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from . import _bytes
from ._common import Scratch

UNKNOWN = "und"
#: More than there are symbols: a string of symbols is a number in this base.
_BASE = 160
_SYMBOL = np.zeros(256, dtype=np.uint8)
_SYMBOL[:128] = 28
_SYMBOL[[9, 10, 11, 12, 13, 32]] = 26
_SYMBOL[48:58] = 27
_SYMBOL[97:123] = np.arange(26)
_SYMBOL[65:91] = np.arange(26)
_SYMBOL[128:] = np.arange(29, 29 + 128)
_BLANK = 26
_KINDS = 157
#: Bytes worked on at once: bounds the temporary arrays, however long a text is.
_STEP = 1 << 16


def remainder(doc_id: Column) -> Column:
    """crc32 of the id's text, modulo 4."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4))


def _slots(codes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Place of a string in its table, and 16 bits that tell it from others there."""
    h = _bytes.mix64(codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return (h >> np.uint64(64 - bits)).astype(np.int64), (h & np.uint64(0xFFFF)).astype(np.uint16)


def _strings(symbols: np.ndarray, starts: np.ndarray, lo: int, hi: int, order: int) -> np.ndarray:
    """For the symbols lo..hi-1, the number of the string of order + 1 symbols that ends there; texts, whose starts
    are given, begin after blanks. Modulo a power of the base it is that of a shorter string."""
    left = max(lo - order, 0)
    near = np.full(order + hi - lo, _BLANK, dtype=np.int64)
    near[order - (lo - left) :] = symbols[left:hi]
    code = near[order:].copy()
    for k in range(1, order + 1):
        code += near[order - k : len(near) - k] * _BASE**k
    for j in range(order - 1, -1, -1):  # a text's first symbols: what comes before is another text's
        at = starts + (j - lo)
        at = at[(at >= 0) & (at < hi - lo)]
        code[at] = code[at] % _BASE ** (j + 1) + sum(_BLANK * _BASE**k for k in range(j + 1, order + 1))
    return code


def _full(offsets: np.ndarray) -> np.ndarray:
    """Numbers of the texts that are not empty."""
    return np.flatnonzero(np.diff(offsets))


def _counter(order: int, bits: int):
    """mapInArrow: ``lang, text`` to counts of strings with their slots and those of their contexts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            lower = pc.utf8_lower(batch.column(1))
            for lang in sorted(set(langs)):
                raw, offsets = _bytes.text_buffers(lower.filter(pa.array(langs == lang)))
                full = _full(offsets)
                symbols = _SYMBOL[raw]
                for lo in range(0, len(raw), 8 * _STEP):
                    whole = _strings(symbols, offsets[full], lo, min(lo + 8 * _STEP, len(raw)), order)
                    for k in range(order + 1):
                        code, n = np.unique(whole % _BASE ** (k + 1), return_counts=True)
                        context = code // _BASE if k else np.zeros_like(code)
                        # the number of a string with its last symbol cut off is that of its context
                        yield pa.record_batch(
                            [pa.array([lang] * len(code)), pa.array(np.full(len(code), k, np.int32)), pa.array(code), pa.array(_slots(code, bits)[0]),
                             pa.array(context), pa.array(_slots(context, bits)[0]), pa.array(n)],
                            names=["lang", "k", "code", "slot", "ctx", "ctx_slot", "n"],
                        )
            _bytes.trim()

    return count


@dataclass(frozen=True)
class Model:
    """For each order from 1 on two tables of slots by languages with 16 bits for each slot: the code lengths of
    strings, escapes included where a language has to escape, and those of escapes from contexts."""

    languages: tuple[str, ...]
    order: int
    bits: int
    single: np.ndarray  # symbol, language
    strings: tuple[tuple[np.ndarray, np.ndarray], ...] = ()
    escapes: tuple[tuple[np.ndarray, np.ndarray], ...] = ()


def train(
    documents: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    per_language: int = 2000,
    order: int = 4,
    cells: int = 1 << 23,
) -> Model:
    """Learn from texts whose language is known and whose ``remainder`` is not 2."""
    known = documents.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"), F.col(lang).alias("lang")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("doc")) != 2)
    )
    sizes = known.groupBy("lang").count().collect()  # one row for each language
    names = tuple(sorted(r["lang"] for r in sizes))
    if not names:
        return Model((), order, 1, np.zeros((_BASE, 0), dtype=np.float32))
    bits = min(18, max(10, int(np.log2(cells / (2 * order * len(names))))))
    rate = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], per_language / r["count"])])[F.col("lang")]
    u = (F.pmod(F.xxhash64(F.col("doc").cast("string"), F.lit("train")), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    drawn = known.where(u < rate).select("lang", "text")
    scratch = Scratch(documents.sparkSession, "language")
    keys = ["lang", "k", "code", "slot", "ctx", "ctx_slot"]
    counts = drawn.mapInArrow(_counter(order, bits), "lang string, k int, code long, slot long, ctx long, ctx_slot long, n long")
    counts = scratch.keep(counts.groupBy(*keys).agg(F.sum("n").alias("n")), "counts")
    contexts = counts.groupBy("lang", "k", "ctx", "ctx_slot").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
    contexts = scratch.keep(contexts, "contexts")

    def owners(rows: DataFrame, code: str, slot: str, n: str) -> DataFrame:
        """The most frequent string of each slot, over all languages."""
        whole = rows.where("k > 0").groupBy("k", slot, code).agg(F.sum(n).alias("t"))
        return whole.groupBy("k", slot).agg(F.max_by(code, F.struct("t", code)).alias(code))

    coded = counts.join(contexts.select("lang", "k", "ctx", "total", "kinds"), ["lang", "k", "ctx"])
    coded = coded.withColumn("b", F.log2((F.col("total") + F.col("kinds")) / F.col("n")))
    escaped = contexts.withColumn("b", F.log2((F.col("total") + F.col("kinds")) / F.col("kinds")))
    # at most ``cells`` rows in all
    strings = coded.join(owners(counts, "code", "slot", "n"), ["k", "slot", "code"]).select("lang", "k", "slot", "code", "b").toArrow()
    escapes = escaped.join(owners(contexts, "ctx", "ctx_slot", "total"), ["k", "ctx_slot", "ctx"])
    escapes = escapes.select("lang", "k", F.col("ctx_slot").alias("slot"), F.col("ctx").alias("code"), "b").toArrow()
    lowest = coded.where("k = 0").select("lang", "code", "b", "total", "kinds").toArrow()

    def which(table: pa.Table) -> np.ndarray:
        return np.searchsorted(np.array(names), np.array(table["lang"].to_pylist(), dtype=str))

    single = np.full((_BASE, len(names)), np.nan)
    at = which(lowest)
    code, b, total, kinds = (lowest[c].to_numpy() for c in ("code", "b", "total", "kinds"))
    for i in range(len(names)):
        own = at == i
        if own.any():
            n, seen = total[own][0], kinds[own][0]
            single[:, i] = np.log2((n + seen) / seen * max(1, _KINDS - seen))
            single[code[own], i] = b[own]
    single = np.where(np.isnan(single), np.log2(_KINDS), single)  # a language none of whose texts was drawn

    def rows_of(table: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct strings of an order and their bits by language, NaN where one hasn't seen them."""
        own = table.filter(pc.equal(table["k"], k))
        code, back = np.unique(own["code"].to_numpy(), return_inverse=True)
        values = np.full((len(code), len(names)), np.nan, dtype=np.float32)
        values[back, which(own)] = own["b"].to_numpy()
        return code, values

    def table(code: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slot, tag = _slots(code, bits)
        out, tags = np.zeros((1 << bits, len(names)), dtype=np.float32), np.zeros(1 << bits, dtype=np.uint16)
        out[slot], tags[slot] = values, tag
        return out, tags

    model = Model(names, order, bits, single.astype(np.float32))
    for k in range(1, order + 1):
        code, values = rows_of(escapes, k)
        escape = table(code, np.nan_to_num(values))
        code, values = rows_of(strings, k)
        below = code_lengths(model, code % _BASE**k, k - 1)
        below = np.where(np.isnan(values), below + _looked_up(escape, bits, code // _BASE), values)
        model = Model(names, order, bits, model.single, (*model.strings, table(code, below)), (*model.escapes, escape))
    scratch.drop("counts")
    scratch.drop("contexts")
    return model


def _looked_up(table: tuple[np.ndarray, np.ndarray], bits: int, code: np.ndarray) -> np.ndarray:
    """Rows of a table, zero where the slot is another string's."""
    slot, tag = _slots(code, bits)
    return np.where((table[1][slot] == tag)[:, None], np.take(table[0], slot, axis=0), np.float32(0))


def code_lengths(model: Model, code: np.ndarray, order: int) -> np.ndarray:
    """Bits of the last symbol of strings of order + 1 symbols under each language: those of the longest string that
    the tables hold, after the escapes from the contexts that are longer."""
    cost = np.zeros((len(code), len(model.languages)), dtype=np.float32)
    left = np.arange(len(code))
    for k in range(order, 0, -1):
        values, tags = model.strings[k - 1]
        slot, tag = _slots(code, model.bits)
        hit = tags[slot] == tag
        if hit.all():
            cost[left] += np.take(values, slot, axis=0)
            return cost
        cost[left[hit]] += np.take(values, slot[hit], axis=0)
        left, code = left[~hit], code[~hit]
        cost[left] += _looked_up(model.escapes[k - 1], model.bits, code // _BASE)
        code = code % _BASE**k
    cost[left] += model.single[code]
    return cost


def _text_scores(model: Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Index of the winning language, -1 for und, and the score."""
    best, score = np.full(len(column), -1), np.zeros(len(column))
    if not model.languages:
        return best, score
    lower = pc.utf8_lower(column.cast(pa.large_string()))
    raw, offsets = _bytes.text_buffers(lower)
    full = _full(offsets)
    if not len(full):
        return best, score
    symbols, starts = _SYMBOL[raw], offsets[full]
    total = np.zeros((len(full), len(model.languages)))
    letters = np.zeros(len(full), dtype=np.int64)
    for lo in range(0, len(raw), _STEP):
        hi = min(lo + _STEP, len(raw))
        first = int(np.searchsorted(starts, lo, side="right")) - 1
        last = int(np.searchsorted(starts, hi, side="left"))
        cut = np.maximum(starts[first:last], lo) - lo
        total[first:last] += np.add.reduceat(code_lengths(model, _strings(symbols, starts, lo, hi, model.order), model.order), cut, axis=0, dtype=np.float64)
        letters[first:last] += np.add.reduceat((symbols[lo:hi] < 26).astype(np.int64), cut)
    gap = total - total.min(axis=1, keepdims=True)
    gap *= np.minimum(1.0, 64.0 / np.diff(np.append(starts, len(raw))))[:, None]
    best[full] = total.argmin(axis=1)
    score[full] = 1.0 / np.exp2(-gap).sum(axis=1)
    for k in full[letters == 0].tolist():
        if not any(map(str.isalpha, lower[k].as_py())):
            best[k], score[k] = -1, 0.0
    return best, score


def identify(documents: DataFrame, model: Model, *, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns of ``documents`` and the prediction in two more, named ``names``."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index(text)
    fields = [pa.field(names[0], pa.string()), pa.field(names[1], pa.float64())]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        labels = np.array([*own.languages, UNKNOWN], dtype=object)
        for batch in batches:
            best, score = _text_scores(own, batch.column(at))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(labels[best], pa.string()), pa.array(score)],
                schema=pa.schema([*batch.schema, *fields]),
            )

    more = [StructField(names[0], StringType()), StructField(names[1], DoubleType())]
    return documents.mapInArrow(predict, StructType([*documents.schema.fields, *more]))


def predictions(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **options) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``; trained on the rows that are not held out."""
    model = train(documents, doc_id=doc_id, text=text, lang=lang, **options)
    slim = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return identify(slim, model).select("doc_id", (remainder(F.col("doc_id")) == 2).alias("held_out"), "lang_pred", "score")


def keep_identified(documents: DataFrame, *, text: str = "text", least: float = 0.4, **options) -> DataFrame:
    """The documents with a language that scores at least ``least``, with all their columns. A text that two
    languages explain equally well scores one half and stays."""
    model = train(documents, text=text, **options)
    found = identify(documents, model, text=text, names=("_lang_pred", "_lang_score"))
    return found.where((F.col("_lang_pred") != UNKNOWN) & (F.col("_lang_score") >= least)).select(*documents.columns)
