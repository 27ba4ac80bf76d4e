"""Substring dedup: every window of ``width`` consecutive words is hashed and counted.

1. Documents are read in chunks. Rabin-Karp style rolling sums give two hashes of each window,
   80 bits together; inside a chunk, in order of (id, start), only a hash's first window goes on
   and the others are marked. The hashes of a chunk are sorted, cut into buckets of the hash space
   and shuffled as packed arrays (differences of sorted hashes, the second hash and window numbers,
   about 11 bytes a window), so a passage that a third of all documents share is one entry for each
   chunk.
2. Each bucket, which holds about ``bucket_windows`` entries at any input size, finds hashes
   seen by several chunks and marks all but the earliest window. The number of tasks follows the
   input: ``task_bytes`` of text for each, times the root of the input in TB beyond the first, so that
100 TB make some hundred thousand tasks.
3. The marks go back to their chunk, where windows that touch or overlap merge into maximal
   removal intervals for each document; these are joined to the texts.

Defined results: null and empty texts and texts of fewer than ``width`` words lose nothing;
documents without an id come after all others; rows that repeat both id and text (also
without an id) are hashed once, as one document, and all get its result; an empty table
gives no rows. Other columns are not read. Windows are compared by 80 bits: among the 3e13 windows
of 100 TB some hundred pairs of different ones are expected to agree. A task that is run again must
find the same rows in the same order, as it does in a table in files; ``store=True`` writes any other
input to such a table first.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes
from ._common import BROADCAST_ROWS, Scratch, broadcast_if_small, one_of_each, text_key

NO_ID = (1 << 63) - 1


def _narrow(values: np.ndarray) -> bytes:
    """Unsigned integers in as few bytes each as the largest needs; the width comes first."""
    values = values.astype("<u8")
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return bytes([width]) + np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _widen(blob: memoryview, n: int) -> tuple[np.ndarray, int]:
    width = blob[0]
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(blob, np.uint8, n * width, 1).reshape(n, width)
    return out.reshape(-1).view("<u8").astype(np.uint64), 1 + n * width


def _pack(hashes: np.ndarray, seconds: np.ndarray, index: np.ndarray, doc_first: np.ndarray, doc_ids: np.ndarray) -> bytes:
    """A bucket of a chunk: sorted hashes, second hashes, window numbers and the documents they lie in."""
    used = np.unique(np.searchsorted(doc_first, index, side="right") - 1)
    first, ids = doc_first[used], doc_ids[used]
    docs = zlib.compress(np.diff(first, prepend=0).astype("<u4").tobytes() + np.diff(ids, prepend=0).astype("<i8").tobytes(), 1)
    head = np.array([len(hashes), len(used), len(docs)], dtype="<u4").tobytes()
    return head + docs + _narrow(np.diff(hashes, prepend=np.uint64(0))) + _narrow(index) + seconds.astype("<u2").tobytes()


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, second hashes, window numbers, document ids and starts."""
    n, k, size = np.frombuffer(blob, "<u4", 3).tolist()
    raw = zlib.decompress(blob[12 : 12 + size])
    first = np.cumsum(np.frombuffer(raw, "<u4", k).astype(np.int64))
    ids = np.cumsum(np.frombuffer(raw, "<i8", k, 4 * k))
    rest = memoryview(blob)[12 + size :]
    gaps, at = _widen(rest, n)
    index, end = _widen(rest[at:], n)
    seconds = np.frombuffer(rest, "<u2", n, at + end)
    index = index.astype(np.int64)
    doc = np.searchsorted(first, index, side="right") - 1
    return np.cumsum(gaps), seconds, index, ids[doc], index - first[doc]


def _two_hashes(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64 and 16 bits of every window, from the words' hashes in two different guises; windows of each text."""
    hashes, n = _bytes.runs(words, counts, width)
    seconds, _ = _bytes.runs(_bytes.mix64(words ^ np.uint64(0xA4093822299F31D0)), counts, width)
    return hashes, (seconds >> np.uint64(48)).astype(np.uint16), n


def _sorted_by_both(hashes: np.ndarray, seconds: np.ndarray) -> np.ndarray:
    """A stable order by both hashes; the second only counts where first ones agree, which is rare."""
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    tied = np.zeros(len(order), dtype=bool)
    tied[1:] |= same
    tied[:-1] |= same
    at = np.flatnonzero(tied)
    if len(at):
        few = order[at]
        order[at] = few[np.lexsort((few, seconds[few], hashes[few]))]
    return order


_SENT = "chunk long, bucket long, blob binary"


def _batch(chunks: list[int], buckets: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    return pa.record_batch(
        [pa.array(chunks, pa.int64()), pa.array(buckets, pa.int64()), pa.array(blobs, pa.binary())], names=["chunk", "bucket", "blob"]
    )


def _hasher(width: int, buckets: int, chunk_windows: int):
    """mapInArrow: ``doc, tk, text`` to packed buckets. Two rows of each chunk wait for its marks,
    with negative bucket numbers of their own, which spread them over the partitions: the
    list of documents (odd) and the windows that repeat inside the chunk (even)."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held, number = [], 0, TaskContext.get().partitionId() << 32
        shift = np.uint64(64 - (buckets.bit_length() - 1))

        def flush() -> pa.RecordBatch:
            ids, tks = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            counts, hashes, seconds = (np.concatenate([h[k] for h in held]) for k in (2, 3, 4))
            order = np.lexsort((tks, ids))
            starts = np.cumsum(counts) - counts
            total = int(counts.sum())
            new_counts = counts[order]
            new_first = np.cumsum(new_counts) - new_counts
            moved = np.arange(total) - np.repeat(new_first, new_counts) + np.repeat(starts[order], new_counts)
            hashes, seconds = hashes[moved], seconds[moved]
            del moved
            ids, tks = ids[order], tks[order]
            by_hash = _sorted_by_both(hashes, seconds)
            hashes, seconds = hashes[by_hash], seconds[by_hash]
            new = np.ones(total, dtype=bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (seconds[1:] != seconds[:-1])
            doc_list = np.concatenate([ids, tks, new_counts]).astype("<i8").tobytes()
            rows = [(-2 * number - 1, zlib.compress(doc_list, 1))]
            if not new.all():
                repeats = np.sort(by_hash[~new])
                rows.append((-2 * number - 2, np.diff(repeats, prepend=0).astype("<u4").tobytes()))
            hashes, seconds, by_hash = hashes[new], seconds[new], by_hash[new]
            owner = hashes >> shift if buckets > 1 else np.zeros(len(hashes), np.uint64)
            cut = np.flatnonzero(np.diff(owner, prepend=owner[0])) if len(owner) else []
            edges = [0, *np.asarray(cut).tolist(), len(hashes)]
            rows += [
                (int(owner[i]), _pack(hashes[i:j], seconds[i:j], by_hash[i:j], new_first, ids)) for i, j in zip(edges, edges[1:], strict=False) if j > i
            ]
            return _batch([number] * len(rows), [r[0] for r in rows], [r[1] for r in rows])

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            tks = batch.column(1).to_numpy(zero_copy_only=False)
            raw, offsets = _bytes.text_buffers(batch.column(2))
            for i, j in _bytes.blocks(offsets):
                lo, hi = offsets[i], offsets[j]
                words, counts, _, _ = _bytes.words(raw[lo:hi], offsets[i : j + 1] - lo)
                hashes, seconds, n = _two_hashes(words, counts, width)
                some = n > 0
                if not some.any():
                    continue
                if held and n_held + len(hashes) > chunk_windows:
                    yield flush()
                    held, n_held, number = [], 0, number + 1
                held.append((ids[i:j][some], tks[i:j][some], n[some], hashes, seconds))
                n_held += len(hashes)
            del batch, raw, offsets
            _bytes.trim()
        if held:
            yield flush()

    return send


def _finder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over partitions sorted by bucket: the windows to mark, for each chunk."""
    bucket, held = None, []

    def marks() -> Iterator[pa.RecordBatch]:
        if len(held) < 2:
            return
        parts = [_unpack(blob) for _, blob in held]
        chunk = np.repeat(np.arange(len(held), dtype=np.int32), [len(p[0]) for p in parts])
        hashes, seconds = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        order = np.argsort(hashes, kind="stable")
        same = hashes[order[1:]] == hashes[order[:-1]]
        twice = np.zeros(len(hashes), dtype=bool)
        twice[1:] |= same
        twice[:-1] |= same
        order = order[twice]
        if not len(order):
            return
        hashes, seconds = hashes[order], seconds[order]
        index, docs, starts = (np.concatenate([p[k] for p in parts])[order] for k in (2, 3, 4))
        chunk = chunk[order]
        names = np.array([c for c, _ in held])
        rank = np.lexsort((names[chunk], starts, docs, seconds, hashes))
        hashes, seconds, chunk, index = hashes[rank], seconds[rank], chunk[rank], index[rank]
        later = np.zeros(len(hashes), dtype=bool)
        later[1:] = (hashes[1:] == hashes[:-1]) & (seconds[1:] == seconds[:-1])
        chunk, index = chunk[later], index[later]
        rank = np.lexsort((index, chunk))
        chunk, index = chunk[rank], index[rank]
        cut = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
        spans = [(i, j) for i, j in zip(cut, cut[1:], strict=False) if j > i]
        if spans:
            yield _batch(
                [int(names[chunk[i]]) for i, _ in spans],
                [-2] * len(spans),
                [np.diff(index[i:j], prepend=0).astype("<u4").tobytes() for i, j in spans],
            )

    for batch in batches:
        for chunk, b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if b < 0:
                yield _batch([chunk], [b], [blob])
                continue
            if b != bucket:
                yield from marks()
                bucket, held = b, []
            held.append((chunk, blob))
        _bytes.trim()
    yield from marks()


_CUTS = "doc long, tk long, n_removed long, cuts binary"


def _merger(width: int):
    """mapInArrow over partitions sorted by chunk: removal intervals of documents that lose words."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, listed, marked = None, None, []

        def intervals() -> Iterator[pa.RecordBatch]:
            if listed is None or not marked:
                return
            ids, tks, counts = np.frombuffer(zlib.decompress(listed), "<i8").reshape(3, -1)
            first = np.cumsum(counts) - counts
            index = np.sort(np.concatenate([np.cumsum(np.frombuffer(m, "<u4").astype(np.int64)) for m in marked]))
            doc = np.searchsorted(first, index, side="right") - 1
            start = index - first[doc]
            opens = np.ones(len(index), dtype=bool)
            opens[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + width)
            at = np.flatnonzero(opens)
            end = start[np.append(at[1:], len(index)) - 1] + width
            begin, owner = start[at], doc[at]
            cut = np.concatenate(([0], np.flatnonzero(np.diff(owner)) + 1, [len(owner)]))
            pairs = np.stack([begin, end], axis=1).astype("<i8")
            removed = np.add.reduceat(end - begin, cut[:-1])
            own = owner[cut[:-1]]
            blobs = [pairs[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.record_batch(
                [pa.array(ids[own]), pa.array(tks[own]), pa.array(removed), pa.array(blobs, pa.binary())], names=["doc", "tk", "n_removed", "cuts"]
            )

        for batch in batches:
            for c, b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if c != chunk:
                    yield from intervals()
                    chunk, listed, marked = c, None, []
                if b % 2:
                    listed = blob
                else:
                    marked.append(blob)
        yield from intervals()

    return merge


def removals(
    documents: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    width: int = 20,
    chunk_windows: int = 1_200_000,
    bucket_windows: int = 1_000_000,
    task_bytes: int = 16 << 20,
    store: bool = False,
) -> DataFrame:
    """``doc, tk, n_removed, cuts`` of the documents that lose words; ``cuts`` packs pairs of
    64-bit word numbers (start, end). ``doc`` is NO_ID for documents without an id."""
    scratch = Scratch(documents.sparkSession, "substring")
    doc = F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID))
    docs = documents.select(doc.alias("doc"), text_key(F.col(text)).alias("tk"), F.col(text).alias("text"))
    docs = scratch.keep(docs, "documents") if store else docs
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 << max(4, (total // 6 // bucket_windows).bit_length())
    tasks = max(4, math.ceil(total / (task_bytes * max(1.0, math.sqrt(total / 1e12)))))
    # a copy must not count as a repeat of its own document
    docs = one_of_each(docs, ["doc", "tk"], scratch, "copies")
    sent = docs.mapInArrow(_hasher(width, buckets, chunk_windows), _SENT)
    found = sent.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(_finder, _SENT)
    back = found.repartition(tasks, "chunk").sortWithinPartitions("chunk")
    cuts = back.mapInArrow(_merger(width), _CUTS)
    return scratch.keep(cuts, "cuts")


def _cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: ``doc, text, n_removed, cuts`` to ``doc, n_words, n_removed, kept``."""
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            batch = whole.slice(at, 1000)
            n_words, removed, kept = [], [], []
            for text, gone, cuts in zip(batch.column("text"), batch.column("n_removed").to_pylist(), batch.column("cuts"), strict=True):
                words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                n_words.append(len(words))
                removed.append(gone or 0)
                if gone:
                    for start, end in np.frombuffer(cuts.as_buffer(), "<i8").reshape(-1, 2)[::-1].tolist():
                        del words[start:end]
                kept.append(b" ".join(words))
            yield pa.record_batch(
                [batch.column("doc"), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["doc", "n_words", "n_removed", "kept"],
            )
        _bytes.trim()


def deduplicated(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", broadcast_rows: int = BROADCAST_ROWS, **options) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` for every document; ``kept``: the words that stay, joined by a space."""
    cuts = broadcast_if_small(removals(documents, doc_id=doc_id, text=text, **options), broadcast_rows, F.octet_length("cuts"))
    docs = documents.select(F.col(doc_id).cast("long").alias("doc"), text_key(F.col(text)).alias("tk"), F.col(text).alias("text"))
    cuts = cuts.select(F.col("doc").alias("_d"), F.col("tk").alias("_t"), "n_removed", "cuts")
    joined = docs.join(cuts, (F.coalesce("doc", F.lit(NO_ID)) == F.col("_d")) & (docs.tk == F.col("_t")), "left")
    out = joined.select("doc", "text", "n_removed", "cuts").mapInArrow(_cutter, "doc long, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("doc", doc_id)
