"""Keys and ids that hold line separators, blanks or nothing; through the query too."""

from tessera.llm import queries, warc

ODD = ["http://a.b/x y", "http://a.b/x\x85y", "http://ä.b/ü z", "http://a.b/" + "q" * 5000, "http://a.b/" + "q" * 5001, "no host\n", "", None]


def test_keys_are_one_word():
    for url in ODD:
        key = warc.key_of(url)
        assert key.isascii() and len(key.split()) <= 1 and key.splitlines() in ([], [key])
    assert warc.key_of("http://Ä.b/") == warc.key_of("http://ä.b/")


def test_odd_urls_and_ids(spark, tmp_path):
    rows = [(f"id {i} >" if i % 2 else str(i), url, f"<p>{i // 3}</p>") for i, url in enumerate(ODD * 3)]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string")
    base = f"file://{tmp_path}/w"
    warc.write_archives(pages, base, block_lines=2)
    index = warc.CaptureIndex(spark, base)
    assert max(len(d[0]) for d in index.directory) == warc.KEY_CHARS
    assert sorted(r.page for r in index.read(index.lookup(pages.select("url"))).collect()) == sorted(r[0] for r in rows)
    assert {x["page"] for x in index.get(ODD[3])} == {rows[i][0] for i in (3, 11, 19)}


def test_query_with_a_null_id(spark, tmp_path):
    rows = [(None, "http://a.b/", "<p>a</p>"), (3, "http://a.b/", "<p>a</p>"), (4, None, None), (3, "http://a.b/", "<p>a</p>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in queries.op6_warc(spark, str(tmp_path)).collect()), key=str)
    assert got == [(0, 8, "revisit", 3), (3, 8, "response", None), (3, 8, "response", None), (4, 0, "response", None)]
