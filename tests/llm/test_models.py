"""Language ID, HTML extraction, WARC archives and the pipeline."""

import math
import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import html_extract, language_id, warc
from tessera.llm import queries as q

from . import brute


def test_language_holdout_and_edges(spark, no_docs):
    out = q.op2_language_id(spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rate = out.join(truth, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert rate > 0.97
    rows = [(1, "the cat and the dog", "en"), (None, "der hund und die katze", "de"), (3, None, "en"), (4, "12 34 !!", "en"), (5, "", None), (6, "日本", None)] + [
        (100 + i, "the cat is on the mat and it is there", "en") for i in range(8)
    ]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predictions(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[3] == got[4] == got[5] == ("und", 0.0) and got[1][0] == "en" and got[6][0] in ("en", "de")
    assert language_id.predictions(no_docs).count() == 0
    kept = language_id.keep_identified(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert kept.columns == ["doc_id", "text", "lang"] and {3, 4, 5}.isdisjoint(r.doc_id for r in kept.collect())
    unknown = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert language_id.predictions(unknown).first().lang_pred == "und"


def test_marginals_equal_enumeration():
    rng = random.Random(3)
    for n in (1, 2, 5, 7):
        parent = [-1] + [rng.randrange(i) for i in range(1, n)]
        kinds = [rng.randrange(2) for _ in range(n)]
        unary = [rng.uniform(-2, 2) for _ in range(n)]
        pair = [[math.exp(rng.uniform(-1, 1)) for _ in range(4)] for _ in range(2)]
        total, one = 0.0, [0.0] * n
        for y in product((0, 1), repeat=n):
            w = math.exp(sum(u * v for u, v in zip(unary, y, strict=True)))
            for i in range(1, n):
                w *= pair[kinds[i]][2 * y[parent[i]] + y[i]]
            total += w
            one = [a + w * b for a, b in zip(one, y, strict=True)]
        got, joints = html_extract.marginals(parent, kinds, unary, pair)
        assert got == pytest.approx([x / total for x in one])
        assert all(sum(j) == pytest.approx(1) for j in joints[1:])


@pytest.fixture(scope="module")
def html_model():
    return html_extract.train()


def test_html_held_out_pages(html_model):
    wrong = blocks = 0
    for page in html_extract._labelled_pages(40, seed=77):
        tree = html_extract.Page(page)
        kept = html_extract.main_blocks(page, html_model)
        want = [b for n, b in tree.blocks if tree.label[n]]
        blocks += len(tree.blocks)
        wrong += len(set(kept) ^ set(want))
    assert wrong < 0.06 * blocks


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<nav><a href=/>Home</a></nav><article><h1>Title</h1><p>First, a sentence.<p>Second &amp; <b>bold</b><br>line</article><footer>&copy; x</footer>", ["Title", "First, a sentence.", "Second & bold line"]),
        ('<main><p>Text of it, and more.</p><div class="ad">Buy it now!</div><script>if (a<b) {}</script></main><section class="comments"><p>I like it, really.</p></section>', ["Text of it, and more."]),
        ("<article><p>cut at the e&am", ["cut at the e&am"]),
        ("<article><p>unfinished tag</p><foo", ["unfinished tag"]),
        ("<!-- <p>no</p> --><article><p hidden>secret</p><p>shown text.</p></article>", ["shown text."]),
        ("", []),
    ],
)
def test_html_cases(html_model, page, want):
    assert html_extract.main_blocks(page, html_model) == want


def test_html_table(spark, html_model):
    rows = [(1, "u", "<article><p>Body,  text\n here.</p></article>", "t"), (2, None, None, "t"), (None, "v", "", "t")]
    out = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), model=html_model)
    assert {(r.page_id, r.text) for r in out.collect()} == {(1, "Body, text here."), (2, ""), (None, "")}
    assert html_extract.extract(spark.createDataFrame([], out.schema.add("html", "string")), model=html_model).count() == 0


def test_warc_keys():
    assert warc.key_of("http://www.Example.com:80/a?b=1#c") == "com,example)/a?b=1"
    assert warc.key_of("https://m.example.org:8443") == "org,example,m:8443)/"
    assert warc.key_of(None) == "" and " " not in warc.key_of("http://a.b/x y\n")


def pages_of(spark, n=40):
    rng = random.Random(5)
    rows = [(i, f"http://h{rng.randrange(6)}.example.com/p{rng.randrange(12)}", rng.choice(["<p>a</p>", "<p>ü</p>" * 50, f"<p>{i}</p>", None, ""]), "k") for i in range(n)]
    rows += [(100, None, "<p>a</p>", "k"), (101, "no host", "<p>b \r\n\r\n c</p>", "k"), (1, "http://x.org/", "other", "k")]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string, key string").repartition(3)


@pytest.mark.parametrize("options", [{"block_lines": 3, "file_bytes": 900}, {"broadcast_rows": 0, "block_lines": 7}])
def test_warc_round_trip(spark, tmp_path, options):
    rows, df = pages_of(spark)
    base = f"file://{tmp_path}/w"
    warc.write_archives(df, base, **options)
    index = warc.CaptureIndex(spark, base)
    assert [d[0] for d in index.directory] == sorted(d[0] for d in index.directory) and len(index.directory) > 3
    got = index.read(index.lookup(df.select("url"))).collect()
    first = {}
    for r in sorted(rows, key=lambda r: r[0]):
        first.setdefault((r[2] or "").encode(), r[0])
    want = []
    for page, url, html, _ in rows:
        raw = (html or "").encode()
        again = first[raw] != page
        want.append((str(page), url, len(raw), warc.digest_of(raw), "revisit" if again else "response", str(first[raw]) if again else None, None if again else raw))
    have = [(r.page, r.url, r.bytes, r.digest, r.kind, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got]
    norm = lambda x: sorted((a, b.replace(" ", "%20") if b else "", *map(str, c)) for a, b, *c in x)
    assert norm(have) == norm(want)
    url = rows[0][1]
    assert {x["page"] for x in index.get(url)} == {str(r[0]) for r in rows if warc.key_of(r[1]) == warc.key_of(url)}
    assert index.get("http://nowhere.example.net/") == []


def test_warc_empty(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_and_read(none).count() == 0


def test_pipeline(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "mixing", "sharding"]
    after = docs
    texts = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, after, sf)
        assert after.columns == docs.columns, name
        after = after.cache()
        texts[name] = [tuple(r) for r in after.select("doc_id", "text", "source").collect()]
    ids = {n: {r[0] for r in rows} for n, rows in texts.items()}
    assert len(ids["language_id"]) >= 0.99 * docs.count()

    def five(text):
        w = brute.space_words((text or "").translate(brute.UP))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    old, brute.shingles = brute.shingles, five
    try:
        groups = brute.components([r[:2] for r in texts["language_id"]])
    finally:
        brute.shingles = old
    assert ids["near_dedup"] == {d for d, (_, c) in groups.items() if c == d}
    bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    flagged = {r[0] for r in brute.contamination([r[:2] for r in texts["near_dedup"]], bench) if r[-1]}
    assert flagged and ids["decontamination"] == ids["near_dedup"] - flagged
    size = {s: sum(len(brute.space_words(t)) for _, t, x in texts["decontamination"] if x == s) for s in {r[2] for r in texts["decontamination"]}}
    from .test_operators import fill

    for s, target in fill(size).items():
        assert abs(sum(len(brute.space_words(t)) for _, t, x in texts["mixing"] if x == s) - target) <= 1
    out = corpus_pipeline.run(spark, sf)
    assert out.count() == len(texts["mixing"]) and out.columns == [*docs.columns, "size", "text_crc32", "shard", "slot"]


ORACLES = sorted(q.oracle_sql())


@pytest.mark.parametrize("name", ORACLES)
def test_queries_against_sql(spark, name):
    from tests.compare import same

    same(spark, q.queries()[name], q.oracle_sql()[name], "/root/testdata/sf0.001")
