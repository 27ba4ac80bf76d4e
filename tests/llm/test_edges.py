"""Repeated rows, very long texts, and the joins of tables too large to broadcast."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import _common, _graph, html_extract, language_id, licenses, mixing, near_dedup, quality, queries, substring_dedup, warc

from . import brute

WORDS = "the cat and the dog sat on a mat with some hats while it rained all day".split()
LONG = " ".join(WORDS[i * i % 15] + ("" if i % 7 else ".") for i in range(150_000))


def test_repeated_rows(spark):
    """Each of equal rows gets a result of its own, and all get the same."""
    texts = ["the cat and the dog " * 20, "released under the MIT License", None, ""]
    rows = [(i % 4, texts[i % 4], "en", "x") for i in range(12)] + [(None, texts[0], None, None)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(0, 1)], "doc_id long, quality int")
    for out in (language_id.predictions(df), quality.judge(df, labels), licenses.scan(df), mixing.mix(df).drop("part", "taken")):
        got = out.groupBy(*[c for c in out.columns if c not in ("detections", "broken")]).count().collect()
        assert sorted(r["count"] for r in got) == [2, 3, 3, 3, 3], out.columns
    pages = spark.createDataFrame([(i % 2, "u", f"<p>Page {i % 2}, and text.</p>") for i in range(6)], "page_id long, url string, html string")
    assert sorted(r["count"] for r in html_extract.extract(pages).groupBy("page_id", "text").count().collect()) == [3, 3]


def test_long_texts(spark, tmp_path):
    rows = [(i, " ".join(WORDS[: 3 + i % 9]), "en") for i in range(40)] + [(100, LONG, "en"), (101, LONG + " mit license", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.predictions(df).where("doc_id >= 100").collect()}
    assert got[100].lang_pred == got[101].lang_pred == "en"
    seen = {r.doc_id: r for r in licenses.scan(df).where("doc_id >= 100").collect()}
    assert (seen[100].n_words, seen[100].labels) == (150_000, "") and (seen[101].first_word, seen[101].labels) == (150_000, "mit")
    measured = {r.doc_id: r for r in quality.measures(df).where("doc_id = 100").collect()}[100]
    assert (measured.n_words, measured.n_repeat_words) == brute.base_quality(LONG)[0:5:4]
    html = f"<body><nav><a href=/>x</a></nav><article><p>{LONG}</p></article></body>"
    pages = spark.createDataFrame([(1, "http://a.b/", html), (2, "http://a.b/" + "y" * 100_000, html)], "page_id long, url string, html string")
    assert {r.n for r in html_extract.extract(pages).select(F.length("text").alias("n")).collect()} == {len(LONG)}
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    out = sorted((r.page_id, r.payload_bytes, r.record_type) for r in queries.op6_warc(spark, str(tmp_path)).collect())
    assert out == [(1, len(html), "response"), (2, len(html), "revisit")]
    assert language_id._text_scores(language_id.Model((), 4, 1, None), pa.array([LONG]))[0].tolist() == [-1]


@pytest.mark.parametrize("limit", [10, 0])
def test_hot_keys_of_a_salted_join(spark, limit):
    left = spark.createDataFrame([("hot" if i % 3 else None if i % 2 else f"k{i}", i) for i in range(300)], "key string, n long")
    right = spark.createDataFrame([("hot", 1), (None, 2), ("k6", 3)], "key string, v long")
    got = {(r.n, r.v) for r in _common.small_or_salted(left, right, ["key"], limit=limit).collect()}
    assert got == {(i, 1 if i % 3 else 2 if i % 2 else 3 if i == 6 else None) for i in range(300)}
    inner = _common.small_or_salted(left, right, ["key"], "inner", limit=limit)
    assert inner.columns == ["key", "n", "v"] and inner.count() == sum(v is not None for _, v in got)


def test_hot_classes_are_dealt(spark):
    """Classes of very many members are found by a broadcast, the others by a shuffled join."""
    signed = spark.createDataFrame([(i, 7 if i < 50 else i, 1, 3) for i in range(100)], "doc long, h1 long, h2 long, n long")
    classes = signed.groupBy("h1", "h2", "n").agg(F.min("doc").alias("component"), F.count(F.lit(1)).alias("members")).where("h1 < 80")
    plain = near_dedup._labelled(signed, classes, 10**6).select("doc", "component")
    for hot in (10, 10**6):
        assert sorted(near_dedup._labelled(signed, classes, 0, hot).select("doc", "component").collect()) == sorted(plain.collect())


def test_least_of_a_hub(spark):
    rows = spark.createDataFrame([(0, i) for i in range(5, 400)] + [(1, 9), (2, 8), (2, 3)], "u long, v long")
    got = {(r.u, r.v): r.m for r in _graph.with_least(rows, "u", "v").collect()}
    assert got == {(0, i): 5 for i in range(5, 400)} | {(1, 9): 9, (2, 8): 3, (2, 3): 3}
    assert {r.u for r in _graph.with_least(rows, "u", "v", 2).collect()} == {0, 2}


def test_cuts_that_are_not_broadcast(spark, docs):
    df, rows = docs
    out = substring_dedup.deduplicated(df, broadcast_rows=0, store=True, task_bytes=1000).collect()
    want = {d: x[1] for d, *x in brute.repeated([(r[0], r[1]) for r in rows])}
    assert {r[0]: r.n_removed for r in out} == want


def test_second_hashes_decide():
    """Windows whose first hashes agree are told apart by the second ones."""
    import numpy as np

    hashes, seconds = np.array([5, 3, 5, 5, 3], np.uint64), np.array([2, 1, 1, 2, 1], np.uint16)
    assert substring_dedup._sorted_by_both(hashes, seconds).tolist() == [1, 4, 2, 0, 3]
    blob = substring_dedup._pack(hashes[[1, 2]], seconds[[1, 2]], np.array([4, 9]), np.array([0, 6]), np.array([11, 12]))
    got = [x.tolist() for x in substring_dedup._unpack(blob)]
    assert got == [[3, 5], [1, 1], [4, 9], [11, 12], [4, 3]]
    assert warc.key_of("http://a.b/") == "b,a)/"
