"""Every operator against its plain version, over nulls, empty and long texts, copies and clashing columns."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, licenses, mixing, near_dedup, quality, sharding, substring_dedup

from . import brute

BENCH = "item_id long, text string, fp string, len string"


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


def bench_rows(rows, seed=0):
    """Items cut from the texts, short ones, a null id and text, and a repeated item."""
    rng = random.Random(seed)
    texts = [brute.alnum_words(r[1]) for r in rows if r[1] and len(brute.alnum_words(r[1])) > 30]
    items = []
    for k in range(8):
        w = rng.choice(texts)
        at = rng.randint(0, len(w) - 20)
        items.append((k, " ".join(w[at : at + rng.choice([3, 12, 13, 14, 20])]), "f", "l"))
    return [*items, (items[0][0], items[0][1], "f", "l"), (50, None, "f", "l"), (51, "", "f", "l"), (52, "w1 w2", "f", "l"), (53, "no such words here", "f", "l")]


@pytest.mark.parametrize("limit", [10**6, 0])
def test_contamination(spark, docs, limit):
    df, rows = docs
    items = bench_rows(rows)
    out = decontaminate.contamination(df, spark.createDataFrame(items, BENCH), broadcast_rows=limit)
    got = {
        r.doc_id: (r.n_words, r.n_hit, r.n_items, r.sha, r.contaminated)
        for r in out.withColumn("sha", F.sha2(F.concat_ws(",", "items"), 256)).collect()
    }
    want = {d: tuple(x) for d, *x in brute.contamination(pairs(rows), [(i[0], i[1]) for i in items])}
    assert got == want and any(v[1] for v in want.values())
    for r in out.collect():
        spans = [(s.start, s.end) for s in r.hits]
        assert sum(b - a for a, b in spans) == r.n_hit
        assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))
    kept = decontaminate.drop_contaminated(df, spark.createDataFrame(items, BENCH))
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, v in want.items() if not v[4]}


def test_contamination_edges(spark, docs, no_docs):
    df, rows = docs
    empty = spark.createDataFrame([], BENCH)
    assert decontaminate.contamination(df, empty).where("n_hit > 0 or contaminated").count() == 0
    assert decontaminate.contamination(no_docs, spark.createDataFrame(bench_rows(rows), BENCH)).count() == 0
    twice = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (1, "x")], "doc_id long, text string")
    item = spark.createDataFrame([(None, "b c", "", "")], BENCH)
    out = decontaminate.contamination(twice, item).collect()
    assert sorted((r.n_words, r.n_hit, r.n_items) for r in out) == [(1, 0, 0), (3, 2, 0), (3, 2, 0), (3, 2, 0)]


def test_quality(spark, docs, no_docs):
    df, rows = docs
    labels = spark.createDataFrame([(d, 1, 0) for d, _ in pairs(rows)] + [(0, None, 0), (None, 1, 1), (10**6, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.judge(df, labels).collect()}
    assert got == {d: brute.base_quality(t) for d, t in pairs(rows)}
    none = labels.limit(0)
    assert quality.judge(df, none).where("kept = base_failed").count() == 0
    assert quality.judge(no_docs, labels).count() == 0


def test_quality_risk(spark):
    """k* is the largest with an exact tail within delta; chosen cutoffs keep to it."""
    from math import comb

    for n, risk, delta in [(5, 0.1, 0.05), (100, 0.05, 0.05), (400, 0.05, 1e-3), (2000, 0.01, 1e-4)]:
        tail, k = 0.0, -1
        for i in range(n + 1):
            tail += comb(n, i) * risk**i * (1 - risk) ** (n - i)
            if tail > delta:
                break
            k = i
        got = spark.range(1).select(quality.most_rejections(F.lit(n).cast("long"), risk, F.lit(delta)).alias("k")).first().k
        assert got == k, (n, risk, delta, got, k)
    big = spark.range(1).select(quality.most_rejections(F.lit(10**7).cast("long"), 0.01, F.lit(1e-6)).alias("k")).first().k
    assert 10**5 - 1700 < big < 10**5 - 1300
    good = [(i, " ".join(f"w{i}x{k}" for k in range(60)), "en") for i in range(3000)]
    bad = [(10_000 + i, " ".join(f"w{i}x{k}###" for k in range(60)), "en") for i in range(100)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, lang string")
    labels = docs.select("doc_id", F.when(F.col("doc_id") < 10_000, 1).otherwise(0).alias("quality"))
    out = quality.judge(docs, labels)
    assert out.where("kept").count() == 3000 and out.where("doc_id >= 10000 and kept").count() == 0
    assert [r.broken for r in out.where("doc_id = 10000").collect()] == [["symbols"]]


def fill(sizes, weights=(5, 2, 1), epochs=3):
    """Water-filling by rounds, from the description."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        total = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / total > epochs * sizes[s] + 1e-9}
        if not over:
            target |= {s: left * w[s] / total for s in free}
            break
        for s in over:
            target[s] = float(epochs * sizes[s])
            left -= target[s]
        free -= over
    return target


def test_mixing(spark, docs, no_docs):
    df, rows = docs
    size = {r[0]: len(brute.space_words(r[1])) for r in rows}
    by_source = {}
    for r in rows:
        by_source[r[3]] = by_source.get(r[3], 0) + size[r[0]]
    want = fill(by_source)
    out = mixing.mix(df).collect()
    assert sorted(r.doc_id for r in out) == sorted(size)
    taken = {}
    for r in out:
        assert r.size == size[r.doc_id] and r.source_size == by_source[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in taken.items():
        assert abs(t - want[s]) <= 1
    assert {(r.doc_id, r.taken) for r in mixing.mix(df).collect()} == {(r.doc_id, r.taken) for r in out}
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    words = {}
    for r in mixed.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(brute.space_words(r.text))
    assert words == {r.doc_id: r.taken for r in out if r.taken}
    assert mixing.mix(no_docs).count() == 0


def test_mixing_clamps(spark):
    rows = [(i, "a b c d", "big") for i in range(300)] + [(1000 + i, "x y", "tiny") for i in range(2)] + [(2000, None, "zero"), (2000, None, "zero")]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = {r.source: (r.target, r.taken) for r in out.groupBy("source").agg(F.max("target").alias("target"), F.sum("taken").alias("taken")).collect()}
    assert got["tiny"] == (12.0, 12) and got["zero"] == (0.0, 0) and got["big"] == (1192.0, 1192)


@pytest.mark.parametrize("options", [{}, {"limit": 400, "broadcast_rows": 0}])
def test_near_duplicates(docs, no_docs, options):
    df, rows = docs
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df, width=2, **options).collect()}
    want = {d: (n, c, c == d) for d, (n, c) in brute.components(pairs(rows)).items()}
    assert got == want and sum(not k for _, _, k in want.values()) > 3
    assert near_dedup.near_duplicates(no_docs).count() == 0


def test_near_duplicates_chain(spark):
    """Members that are linked only through others, a null id, and repeated ids."""
    base = [f"t{i}" for i in range(60)]
    rows = [(10 * k, " ".join(base[3 * k : 3 * k + 40])) for k in range(6)] + [(None, " ".join(base[:40])), (7, ""), (7, "only"), (8, "only"), (9, None)]
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()
    assert {r.component_id for r in out if r.doc_id in (10, 20, 30, 40, 50)} == {0}
    assert [(r.component_id, r.kept) for r in out if r.doc_id is None] == [(None, True)]
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in out if r.doc_id in (7, 8, 9)} == {(7, 0, 7), (7, 1, 7), (8, 1, 7), (9, 0, 9)}


@pytest.mark.parametrize("options", [{}, {"chunk_windows": 50, "bucket_windows": 20}])
def test_substrings(docs, no_docs, options):
    df, rows = docs
    out = substring_dedup.deduplicated(df, **options).withColumn("sha", F.sha2("kept", 256)).collect()
    got = {r.doc_id: (r.n_words, r.n_removed, r.sha) for r in out}
    want = {d: tuple(x) for d, *x in brute.repeated(pairs(rows))}
    assert got == want and sum(n > 0 for _, n, _ in want.values()) > 5
    assert substring_dedup.deduplicated(no_docs).count() == 0


def test_substrings_edges(spark, tmp_path):
    text = " ".join(f"k{i}" for i in range(30))
    rows = [(5, text), (5, text), (None, text), (1, "z " + text), (2, " ".join(["a"] * 45))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/t")
    out = substring_dedup.deduplicated(spark.read.parquet(f"{tmp_path}/t"))
    got = sorted((r.doc_id or -1, r.n_removed, len(r.kept.split())) for r in out.collect())
    assert got == [(-1, 30, 0), (1, 0, 31), (2, 44, 1), (5, 30, 0), (5, 30, 0)]


def test_licenses(spark, docs, no_docs):
    df, rows = docs
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan(df).collect()}
    assert got == {d: brute.base_licenses(t) for d, t in pairs(rows)}
    assert licenses.scan(no_docs).count() == 0


def test_license_rules(spark):
    cases = {
        "Licensed under the Apache License, Version 2.0": {"apache-2.0"},
        "GNU Lesser General Public License v3": {"lgpl-3.0"},
        "GNU Affero General Public License version 3": {"agpl-3.0"},
        "released under the terms of the Mozilla Public License 2.0": {"mpl-2.0"},
        "SPDX-License-Identifier: BSD-3-Clause": {"bsd-3-clause"},
        "Permission is hereby granted, free of charge,\nto any person obtaining a copy": {"mit"},
        "Creative Commons Attribution-ShareAlike 4.0 International License": {"cc-by-sa-4.0"},
        "a plain text about summer": set(),
    }
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    for r in licenses.scan(df).collect():
        assert {d.label for d in r.detections} == list(cases.values())[r.doc_id], r
    assert len(licenses.rules()) > 250


def test_shards(docs, no_docs):
    df, rows = docs
    out = sharding.shards(df).collect()
    assert sorted(r.doc_id for r in out) == sorted(r[0] for r in rows)
    brute.check_shards([(r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in out], dict(pairs(rows)))
    assert sharding.shards(no_docs).count() == 0


def test_shards_of_a_hot_text(spark):
    """A third of all rows hold one text: its range is subdivided by the id, sizes stay even."""
    rows = [(i, "hot text of some length" if i % 3 == 0 else f"text number {i}") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sharding.shards(df, ranges=64, sample_per_range=20)
    got = [(r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in out.collect()]
    brute.check_shards(got, dict(rows))
    assert {(r[0], r[3], r[4]) for r in got} == {(r.doc_id, r.shard, r.slot) for r in sharding.shards(df).collect()}
    odd = spark.createDataFrame([(None, None), (None, None), (1, "a"), (1, "a")], "doc_id long, text string")
    assert sorted(r.size for r in sharding.shards(odd, n_shards=2).collect()) == [1, 1, 2, 2]


def test_loose_rules_decide(spark):
    """At the sf of the correctness gate cutoffs are on, so SQL and Spark are compared where they decide."""
    from tessera.llm import queries

    out = queries.quality_rules_loose(spark, "/root/testdata/sf0.01")
    assert out.where("not base_failed and not kept").count() > 20
