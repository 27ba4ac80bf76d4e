"""The pipeline over empty tables, nulls, repeats and columns of its own names."""

import corpus_pipeline

from .conftest import DOCS

BENCH = "item_id long, text string"


def tables(spark, path, rows, items):
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, BENCH).write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_empty(spark, tmp_path):
    for i, items in enumerate(([], [(1, "a b c")])):
        out = corpus_pipeline.run(spark, tables(spark, tmp_path / str(i), [], items))
        assert out.count() == 0 and out.columns == [*[c for c in DOCS.names if c != "size"], "size", "text_crc32", "shard", "slot"]


def test_nulls_and_repeats(spark, tmp_path):
    word = lambda p, n: " ".join(f"{p}{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}" for i in range(n))
    more = (0, "t", "s", "x")
    rows = [(i, word(c, 60), "en", src, *more) for i, (c, src) in enumerate([("u", "a"), ("v", "b"), ("w", None), ("x", "a"), ("y", "b"), ("z", None)])]
    rows += [rows[0], rows[0], (None, word("q", 40), None, "a", *more), (None, word("q", 40), None, "a", *more), (9, word("u", 60), "en", "b", *more)]
    rows += [(20, None, "en", "a", *more), (21, "", "en", "a", *more), (22, "12 34", None, None, *more), (None, None, None, None, None, None, None, None)]
    rows += [(30, word("r", 30), "en", "a", *more)]
    out = corpus_pipeline.run(spark, tables(spark, tmp_path, rows, [(1, word("r", 15)), (None, None), (2, "")]))
    got = out.collect()
    texts = {r.text for r in got}
    whole = {word(c, n) for c, n in (("u", 60), ("v", 60), ("w", 60), ("x", 60), ("y", 60), ("z", 60), ("q", 40))}
    # a source's last text may be cut, nothing else comes in
    assert all(any(w.startswith(t) for w in whole) for t in texts) and len(texts & whole) >= 4
    assert not any(r.doc_id in (9, 20, 21, 22, 30) for r in got)
    slots = {}
    for r in got:
        assert r.size == len(r.text.encode()) + 1
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
