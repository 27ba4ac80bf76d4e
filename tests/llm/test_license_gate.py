"""License rules: keywords keep no text from them, and a plain scanner finds the same."""

import random
import re

from tessera.llm import licenses, queries

from . import brute

SRE = re._parser


def sample(tree, rng, least):
    """A text that the parsed regex matches; ``least``: optional parts are left out."""
    out = ""
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name == "IN":
            kind, x = arg[0]
            out += chr(x if str(kind) == "LITERAL" else rng.randint(*x))
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            lo, hi, inner = arg
            out += "".join(sample(inner, rng, least) for _ in range(lo if least else rng.randint(lo, min(hi, lo + 1))))
        elif name == "SUBPATTERN":
            out += sample(arg[-1], rng, least)
        elif name == "BRANCH":
            out += sample(rng.choice(arg[1]), rng, least)
        else:
            raise AssertionError(name)
    return out


def test_without_the_word_license(spark):
    cases = {
        "This library is released under the GPL 3": "gpl-3.0",
        "It is distributed under the BSD": "bsd",
        "The figures were published under CC BY 4.0.": "cc-by-4.0",
        "PROVIDED under\n the terms of the MPL-2.0": "mpl-2.0",
        "covered under an EPL": "epl",
        "available under PHP": "php-3.01",
        "subject to the terms of the Artistic 2.0": "artistic-2.0",
        "code: MPL 1.1": "mpl-1.1",
    }
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    assert [r.labels for r in licenses.scan(df).orderBy("doc_id").collect() if r.score > 0] == list(cases.values())


def test_every_match_holds_a_keyword(spark):
    rng = random.Random(3)
    pairs = {(sample(SRE.parse(r[1]), rng, least), r[2]) for r in licenses.rules() for least in (True, True, True, True, False)}
    assert [x for x in sorted(pairs) if not any(k in f" {x[0]} " for k in x[1].split("|"))] == []
    some = rng.sample(sorted({t for t, _ in pairs}), 120)
    df = spark.createDataFrame([(i, t.upper() + ".") for i, t in enumerate(some)], "doc_id long, text string")
    assert [some[r.doc_id] for r in licenses.scan(df).where("score = 0").collect()] == []


def plain_scan(text):
    """Every rule over the whole text, every pair of detections compared; no keyword, no neighbourhood."""
    words = brute.alnum_words(text)
    padded = f" {' '.join(words)} "
    hits = set()
    for label, regex, _, rank, sure in licenses.rules():
        for m in re.finditer(f" (?:{regex})(?= )", padded):
            start = padded[: m.start()].count(" ")
            hits.add((start, start + m[0].count(" "), rank, label, sure))

    def inside(d, o):
        return o[0] <= d[0] and o[1] >= d[1] and (o[2] < d[2] or (o[2] == d[2] and (o[0] < d[0] or o[1] > d[1])))

    kept = [d for d in hits if not any(inside(d, o) for o in hits)]
    base = set(filter(None, brute.base_licenses(text)[4].split(",")))
    return ",".join(sorted({d[3] for d in kept} | base)), max((d[4] for d in kept), default=0.0), sorted((d[0], d[1], d[3]) for d in kept)


def test_against_a_plain_scanner(spark):
    rng = random.Random(8)
    parts = [sample(SRE.parse(r[1]), rng, False) for r in licenses.rules() for _ in range(2)]
    texts = [None, "", "no such thing here", "MIT", " ".join(["gnu lesser general public license v3"] * 300)]
    texts += [" ".join(rng.choice([*rng.sample(parts, 3), "x y", "under the", "license", "Ünder"]) for _ in range(rng.choice([1, 3, 12, 60]))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in licenses.scan(df).collect():
        got = r.labels, r.score, sorted((d.start, d.end, d.label) for d in r.detections)
        assert got == plain_scan(texts[r.doc_id]), texts[r.doc_id]


def test_query_against_a_plain_scanner(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op7_licenses(spark, sf).collect()
    assert len(got) == len(texts) and any(r.score > 0 for r in got)
    for r in got:
        n, k, first, last, base = brute.base_licenses(texts[r.doc_id])
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (n, k, first, last, base)
        assert (r.labels, r.score) == plain_scan(texts[r.doc_id])[:2]


def test_everyday_words_are_no_names(spark):
    df = spark.createDataFrame([(1, "my licenses: ruby, and a license is vim like"), (2, "License: GPL"), (3, "released under the MIT")], "doc_id long, text string")
    assert [r.labels for r in licenses.scan(df).orderBy("doc_id").collect()] == ["", "gpl", "mit"]
