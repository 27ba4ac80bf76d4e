"""Near-duplicate groups by MinHash.

1. Each text becomes the set of its distinct shingles (64-bit hashes) and a signature: the
   minima of ``bands * rows`` universal hash functions over the set, folded into one key
   for each band, and one bit of each minimum. Texts with equal sets are one class from here on.
2. Classes that share a band key are candidates. Each is tied to its bucket's least class
   only, so a bucket makes one row for each member. Connected components of these ties
   (large-star, small-star) hold all candidate pairs; with the defaults a pair of
   similarity 0.8 shares no band with probability 3e-6.
3. The full sets of each candidate component meet, and a search from member to member
   compares each reached one with all that are not reached yet: every link at or above the
   threshold counts, also between texts that are not like the component's least one, and
   copies that are reached are not compared again. Of those not reached, sets are compared
   only where their sizes and the bits of their minima allow the threshold: a component that
   a common line makes has many members and few links. A component of more than ``limit``
   shingles is split into blocks of members and every pair of blocks is searched.
4. Components of the confirmed links are the groups.

Defined results: words are separated by ASCII white space, A-Z lower-cased; a text with
fewer words than a shingle has its whole word sequence as the only one; without words or
text the set is empty and linked with nothing; rows without an id are groups of their own
and keep a null id; rows that repeat an id are one node. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes
from ._common import BROADCAST_ROWS, Scratch, broadcast_if_small, one_of_each, text_key
from ._graph import components, with_least


def _distinct(hashes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text, and how many each has."""
    owner = np.repeat(np.arange(len(n), dtype=np.int64), n)
    order = np.argsort(hashes)
    order = order[np.argsort(owner[order], kind="stable")]
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.bincount(owner[new], minlength=len(n))


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks of rows ``i, j`` with the concatenated distinct shingles of their texts and their sizes."""
    raw, offsets = _bytes.text_buffers(column)
    for i, j in _bytes.blocks(offsets):
        lo, hi = offsets[i], offsets[j]
        words, counts, _, _ = _bytes.words(raw[lo:hi], offsets[i : j + 1] - lo, fold=True)
        grams, n = _bytes.runs(words, counts, width)
        short = (counts > 0) & (counts < width)
        if short.any():
            first = np.concatenate(([0], np.cumsum(counts)))
            whole = np.flatnonzero(short)
            extra = _bytes.range_hashes(words, first[whole], first[whole + 1])
            at = np.cumsum(n)[whole]  # such a text has no runs, so its place is between its neighbours'
            grams = np.insert(grams, at, extra)
            n = n + short
        yield (i, j, *_distinct(grams, n))


def _lists(values: np.ndarray, full: np.ndarray, n: int) -> pa.ListArray:
    """Rows of ``values`` as the lists of rows ``full`` of ``n``; the others' are empty."""
    sizes = np.zeros(n + 1, dtype=np.int32)
    sizes[full + 1] = values.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), pa.array(values[full].reshape(-1).view(np.int64)))


def _signer(width: int, bands: int, rows: int, seed: int):
    """mapInArrow: ``doc, text`` to ``doc, n, h1, h2, bands, signs``."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(seed)
        mul = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        add = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
        for batch in batches:
            ids = batch.column(0)
            for i, j, sets, n in shingle_sets(batch.column(1), width):
                full = np.flatnonzero(n)
                keys, signs = np.zeros((j - i, bands), dtype=np.uint64), np.zeros((j - i, -(-bands * rows // 64)), dtype=np.uint64)
                sums = np.zeros((2, j - i), dtype=np.uint64)
                if len(full):
                    starts = np.concatenate(([0], np.cumsum(n[full])[:-1]))
                    for k, salt in enumerate((0x243F6A8885A308D3, 0x13198A2E03707344)):
                        sums[k, full] = np.add.reduceat(_bytes.mix64(sets ^ np.uint64(salt)), starts)
                    _minima(sets, starts, mul, add, bands, rows, keys, signs, full)
                yield pa.record_batch(
                    [
                        ids.slice(i, j - i),
                        pa.array(n.astype(np.int64)),
                        pa.array(sums[0].view(np.int64)),
                        pa.array(sums[1].view(np.int64)),
                        _lists(keys, full, j - i),
                        _lists(signs, full, j - i),
                    ],
                    names=["doc", "n", "h1", "h2", "bands", "signs"],
                )
            _bytes.trim()

    return sign


def _minima(sets, starts, mul, add, bands, rows, keys, signs, full, step: int = 1 << 15) -> None:
    """Fill ``keys[full]`` and ``signs[full]``; works on runs of whole texts that fit a core's cache."""
    ends = np.append(starts[1:], len(sets))
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + step, side="right")))
        part, at = sets[starts[i] : ends[j - 1]], starts[i:j] - starts[i]
        room, least = np.empty_like(part), np.empty((bands * rows, j - i), dtype=np.uint64)
        for b in range(bands):
            key = np.full(j - i, b + 1, dtype=np.uint64)
            for r in range(b * rows, b * rows + rows):
                np.multiply(part, mul[r], out=room)
                np.add(room, add[r], out=room)
                least[r] = np.minimum.reduceat(room, at)
                key = _bytes.mix64(key * np.uint64(0x9E3779B97F4A7C15) ^ least[r])
            keys[full[i:j], b] = key
        bits = np.zeros((j - i, 64 * signs.shape[1]), dtype=bool)
        bits[:, : bands * rows] = (_bytes.mix64(least) >> np.uint64(63)).T
        signs[full[i:j]] = np.packbits(bits, axis=1).view(np.uint64)
        i = j


def _packer(width: int):
    """mapInArrow: ``pc, ks, cls, signs, text`` to the same with the packed set for the text."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, sets, n in shingle_sets(batch.column("text"), width):
                ends = np.concatenate(([0], np.cumsum(n))) * 8
                rows = batch.slice(i, j - i)
                blob = pa.Array.from_buffers(
                    pa.large_binary(), j - i, [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(sets.tobytes())]
                ).cast(pa.binary())
                yield pa.record_batch([*(rows.column(c) for c in ("pc", "ks", "cls", "signs")), blob], names=["pc", "ks", "cls", "signs", "blob"])
            _bytes.trim()

    return pack


def least_common(minima: int, percent: int, risk: float = 1e-9) -> int:
    """How many of the minima's bits a pair of similarity ``percent`` has in common, but for this risk."""
    same, below = (1 + percent / 100) / 2, 0.0
    for k in range(minima + 1):
        below += comb(minima, k) * same**k * (1 - same) ** (minima - k)
        if below > risk:
            return k
    return minima


class _Open:
    """Members of which half at least are not reached yet, by size: their signs word by word, their sets end to end.
    ``n``: how many are not reached."""

    def __init__(self, at: np.ndarray, sizes: np.ndarray, signs: np.ndarray, codes: np.ndarray, starts: np.ndarray) -> None:
        self.at, self.sizes, self.n = at, sizes[at], len(at)
        self.signs = np.ascontiguousarray(signs[at].T)
        self.ends = np.cumsum(self.sizes)
        self.codes = codes[_ranges(starts[at], self.sizes)]

    def common(self, rows: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """Marked shingles of each of these rows, which are in order."""
        sizes = self.sizes[rows]
        lo, hi = self.ends[rows[0]] - sizes[0], self.ends[rows[-1]]
        if 2 * int(sizes.sum()) > hi - lo:  # most of what lies between: read it in one go
            sums = np.concatenate(([0], np.cumsum(marks[self.codes[lo:hi]], dtype=np.int64)))
            return sums[self.ends[rows] - lo] - sums[self.ends[rows] - sizes - lo]
        sums = np.concatenate(([0], np.cumsum(marks[self.codes[_ranges(self.ends[rows] - sizes, sizes)]], dtype=np.int64)))
        ends = np.cumsum(sizes)
        return sums[ends] - sums[ends - sizes]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, end to end."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def reach(ids: np.ndarray, sets: list[np.ndarray], signs: np.ndarray, percent: int, differ: int) -> list[tuple[int, int]]:
    """Links that connect what pairs of similarity >= percent connect: (member, least member reached). Pairs of which
    more than ``differ`` bits of the signs differ are taken for less similar."""
    sizes = np.array([len(s) for s in sets])
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    marks = np.zeros(codes.max() + 1, dtype=bool)
    reached, links = np.zeros(len(ids), dtype=bool), []
    left = _Open(np.argsort(sizes, kind="stable"), sizes, signs, codes, starts)

    for seed in np.argsort(ids, kind="stable").tolist():
        frontier = [] if reached[seed] else [seed]
        left.n -= len(frontier)
        reached[seed] = True
        while frontier and left.n:
            x = frontier.pop()
            if 2 * left.n < len(left.at):
                left = _Open(left.at[~reached[left.at]], sizes, signs, codes, starts)
            n = int(sizes[x])
            lo = int(np.searchsorted(left.sizes, -(-percent * n // 100)))
            hi = int(np.searchsorted(left.sizes, 100 * n // percent, side="right")) if percent > 0 else len(left.sizes)
            apart = sum(np.bitwise_count(own ^ word[lo:hi]).astype(np.int16) for own, word in zip(signs[x], left.signs, strict=True))
            found = lo + np.flatnonzero(apart <= differ)
            found = found[~reached[left.at[found]]]
            if not len(found):
                continue
            own = codes[starts[x] : starts[x] + n]
            marks[own] = True
            common = left.common(found, marks)
            marks[own] = False
            found = found[100 * common >= percent * (n + left.sizes[found] - common)]
            more = left.at[found]
            reached[more] = True
            frontier += more.tolist()
            links += [(int(ids[y]), int(ids[seed])) for y in more]
            left.n -= len(more)
    return links


def _linker(percent: int, differ: int):
    """mapInArrow over partitions sorted by ``pc, k``: confirmed links ``u, v`` of each group."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, sets, signs, out = None, [], [], [], []

        def done() -> list[tuple[int, int]]:
            return reach(np.array(ids), sets, np.array(signs), percent, differ) if len(ids) > 1 else []

        for batch in batches:
            keys = zip(batch.column("pc").to_pylist(), batch.column("k").to_pylist(), strict=True)
            words = batch.column("signs").flatten().to_numpy().view(np.uint64).reshape(len(batch), -1).copy()
            for key, cls, sign, blob in zip(keys, batch.column("cls").to_pylist(), words, batch.column("blob"), strict=True):
                if key != group:
                    out += done()
                    group, ids, sets, signs = key, [], [], []
                ids.append(cls)
                signs.append(sign)
                sets.append(np.frombuffer(blob.as_buffer(), dtype=np.uint64).copy())
            _bytes.trim()
            if out:
                yield pa.record_batch([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["u", "v"])
                out = []
        if out := done():
            yield pa.record_batch([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["u", "v"])

    return link


#: Shingles that a member of a search counts as at least: short sets cost time by their number.
LEAST = 64


def near_duplicates(
    documents: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    width: int = 5,
    percent: int = 80,
    bands: int = 32,
    rows: int = 5,
    seed: int = 5,
    limit: int = 4_000_000,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row; ``component_id`` is the least id of
    its group. ``limit``: shingles of the members that one search holds in memory; a member counts as ``LEAST`` at least."""
    scratch = Scratch(documents.sparkSession, "near-dedup")
    docs = documents.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    signed = scratch.keep(
        docs.mapInArrow(_signer(width, bands, rows, seed), "doc long, n long, h1 long, h2 long, bands array<long>, signs array<long>"), "signed"
    )
    classes = scratch.keep(
        signed.where((F.col("n") > 0) & F.col("doc").isNotNull())
        .groupBy("h1", "h2", "n")
        .agg(F.min(F.struct("doc", "bands", "signs")).alias("x"), F.count(F.lit(1)).alias("members"))
        .select("h1", "h2", "n", "members", F.col("x.doc").alias("cls"), "x.bands", "x.signs"),
        "classes",
    )

    keyed = classes.select("cls", F.explode("bands").alias("key"))
    ties = with_least(keyed, "key", "cls", 2).where(F.col("cls") != F.col("m")).select(F.col("cls").alias("u"), F.col("m").alias("v"))
    candidates = components(ties, scratch, "ties").select(F.col("node").alias("cls"), F.col("component").alias("pc"))
    candidates = scratch.keep(candidates.join(classes.select("cls", "n", "signs"), "cls"), "candidates")

    # components too large for one search: blocks of members, a search for each pair of blocks
    large = (
        candidates.groupBy("pc").agg(F.sum(F.greatest("n", F.lit(LEAST))).alias("total")).where(F.col("total") > limit)
        .select("pc", F.ceil(2 * F.col("total") / limit).cast("int").alias("cut"))
    )
    large = scratch.keep(large, "large")
    many = candidates.join(broadcast_if_small(large, broadcast_rows), "pc", "left")
    block = F.pmod(F.xxhash64("cls"), F.col("cut")).cast("int")
    pairs = F.when(F.col("cut").isNull(), F.array(F.lit(0))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("cut") - 1), lambda o: F.least(block, o) * F.col("cut") + F.greatest(block, o))
    )
    many = many.select("pc", "cls", "signs", pairs.alias("ks"))  # ``cut`` pairs for each member
    many = broadcast_if_small(many, broadcast_rows, 4 * F.size("ks") + 8 * F.size("signs"))
    sets = docs.join(many, F.col("doc") == F.col("cls")).select("pc", "ks", "cls", "signs", "text")
    packed = sets.mapInArrow(_packer(width), "pc long, ks array<int>, cls long, signs array<long>, blob binary")
    links = packed.select("pc", F.explode("ks").alias("k"), "cls", "signs", "blob")  # packed once, then copied
    differ = bands * rows - least_common(bands * rows, percent)
    links = links.repartition("pc", "k").sortWithinPartitions("pc", "k").mapInArrow(_linker(percent, differ), "u long, v long")
    groups = components(links, scratch, "links").select(F.col("node").alias("cls"), F.col("component"))
    labelled = (
        classes.select("h1", "h2", "n", "members", "cls")
        .join(groups, "cls", "left")
        .select("h1", "h2", "n", "members", "cls", F.coalesce("component", "cls").alias("component"))
        .where((F.col("members") > 1) | (F.col("component") != F.col("cls")))
        .drop("cls")
    )
    labelled = scratch.keep(labelled, "labelled")
    return (
        _labelled(signed.drop("bands", "signs"), labelled, broadcast_rows)
        .select(
            F.col("doc").alias(doc_id),
            F.col("n").alias("n_shingles"),
            F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc")).alias("component_id"),
        )
        .withColumn("kept", F.col(doc_id).eqNullSafe(F.col("component_id")))
    )


def _labelled(signed: DataFrame, labelled: DataFrame, broadcast_rows: int, hot: int = 100_000) -> DataFrame:
    """Rows with their class's ``component``. Classes are broadcast if they are few; otherwise only those of
    more than ``hot`` members are (a row in ``hot`` at most), and rows found there are dealt by their id in
    the shuffled join that follows, where they need nothing more."""
    on = ["h1", "h2", "n"]
    if labelled.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return signed.join(F.broadcast(labelled.drop("members")), on, "left")
    large = labelled.where(F.col("members") > hot).select(*on, F.col("component").alias("_hot"))
    marked = signed.join(broadcast_if_small(large, broadcast_rows), on, "left").withColumnRenamed("h1", "_h1")
    marked = marked.withColumn("h1", F.when(F.col("_hot").isNull(), F.col("_h1")).otherwise(F.xxhash64("doc")))
    return marked.join(labelled.drop("members"), on, "left").withColumn("component", F.coalesce("_hot", "component"))


def drop_near_duplicates(documents: DataFrame, **options) -> DataFrame:
    """One document of each group, with all columns: the one whose id is the group's.

    Where ids repeat or are missing, a document is an id with a text: its copies are one, and it is numbered
    in order of id (none comes last) and text key, so that groups are made of these numbers."""
    doc_id, text = options.get("doc_id", "doc_id"), options.get("text", "text")
    ids = documents.select(F.col(doc_id).cast("long").alias("_d"))
    if not ids.groupBy("_d").count().where("`count` > 1 or _d is null").isEmpty():
        return _drop_numbered(documents, doc_id, text, options)
    gone = near_duplicates(documents, **options).where(~F.col("kept")).select(F.col(doc_id).alias("_gone"))
    gone = broadcast_if_small(Scratch(documents.sparkSession, "near-gone").keep(gone, "gone"), options.get("broadcast_rows", BROADCAST_ROWS))
    return documents.join(gone, documents[doc_id].cast("long") == F.col("_gone"), "left_anti")


def _drop_numbered(documents: DataFrame, doc_id: str, text: str, options: dict) -> DataFrame:
    scratch = Scratch(documents.sparkSession, "numbered")
    key = F.col(doc_id).cast("long")
    docs = documents.withColumns({"_none": key.isNull(), "_d": F.coalesce(key, F.lit(0)), "_tk": text_key(F.col(text))})
    keys = ["_none", "_d", "_tk"]
    docs = one_of_each(docs, keys, scratch, "copies")
    # after a sort these numbers increase with the rows
    numbers = scratch.keep(docs.select(*keys).orderBy(*keys).withColumn("_row", F.monotonically_increasing_id()), "numbers")
    docs = scratch.keep(docs.join(numbers, keys).drop(*keys), "documents")
    gone = near_duplicates(docs, **{**options, "doc_id": "_row"}).where(~F.col("kept")).select("_row")
    return docs.join(gone, "_row", "left_anti").select(*documents.columns)
