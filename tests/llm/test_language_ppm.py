"""Language ID against prediction by partial matching written out plainly."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import language_id, queries

BLANK, KINDS = 26, 157


def symbols(text):
    """Letters, blank, digit and other as one symbol each, bytes of other scripts kept apart."""
    out = []
    for x in text.lower().encode():
        c = chr(x)
        out.append(x - 97 if "a" <= c <= "z" else 26 if x in (9, 10, 11, 12, 13, 32) else 27 if "0" <= c <= "9" else 28 if x < 128 else 29 + x - 128)
    return out


class Plain:
    """One language's tree as dictionaries."""

    def __init__(self, texts, order):
        self.order, self.seen = order, defaultdict(Counter)
        for t in texts:
            s = [BLANK] * order + symbols(t)
            for i in range(order, len(s)):
                for k in range(order + 1):
                    self.seen[tuple(s[i - k : i])][s[i]] += 1

    def bits(self, text):
        s, total = [BLANK] * self.order + symbols(text), 0.0
        for i in range(self.order, len(s)):
            for k in range(self.order, -1, -1):
                here = self.seen.get(tuple(s[i - k : i]))
                if here is None:
                    continue
                n = sum(here.values()) + len(here)
                if s[i] in here:
                    total -= math.log2(here[s[i]] / n)
                    break
                total -= math.log2(len(here) / n)
                if k == 0:
                    total += math.log2(KINDS - len(here))
        return total


WORDS = {"xx": "the cat and dog sat on mat with hat".split(), "yy": "der hund und die katze saßen große".split(), "zz": "猫 と 犬 が います 日本語 です".split()}


@pytest.mark.parametrize("order", [1, 4])
def test_code_lengths(spark, order):
    rng = random.Random(order)
    rows = [(i, " ".join(rng.choices(WORDS[lang], k=rng.randint(0, 30))) + rng.choice(["", " 12", "!?"]), lang) for i, lang in enumerate(list(WORDS) * 40)]
    df = spark.createDataFrame([*rows, (None, None, "xx"), (7, "a", None)], "doc_id long, text string, lang string")
    used = [r for r in rows if __import__("zlib").crc32(str(r[0]).encode()) % 4 != 2]
    model = language_id.train(df, order=order)
    assert model.languages == tuple(WORDS)
    plain = [Plain([t for _, t, x in used if x == lang], order) for lang in WORDS]
    texts = [t for _, t, _ in rows] + ["", "the hund 猫!", "q", "unseen \t 9 øøø", "ü", "x" * 70_000]
    best, _ = language_id._text_scores(model, pa.array(texts))
    for text, b in zip(texts, best.tolist(), strict=True):
        want = [p.bits(text) for p in plain]
        raw = np.frombuffer(text.lower().encode(), np.uint8)
        if len(raw):
            code = language_id._strings(language_id._SYMBOL[raw], np.zeros(1, np.int64), 0, len(raw), order)
            got = language_id.code_lengths(model, code, order).astype(float).sum(axis=0)
            assert got == pytest.approx(want, rel=1e-4), text
            if b >= 0 and sorted(want)[1] - min(want) > 1e-2:
                assert b == int(np.argmin(want))


def test_texts_of_a_batch_are_apart(monkeypatch):
    """Neither the texts before nor the step of the work change a text's strings."""
    rng = random.Random(4)
    texts = ["".join(rng.choices("abc é", k=rng.choice([0, 1, 2, 3, 9]))) for _ in range(200)]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.cumsum([0, *(len(t.encode()) for t in texts)])
    starts = np.array([a for a, b in zip(at[:-1], at[1:], strict=True) if b > a])
    s = language_id._SYMBOL[raw]
    want = []
    for t in texts:
        x = [BLANK] * 4 + symbols(t)
        want += [sum(c * 160**k for k, c in enumerate(reversed(x[i - 4 : i + 1]))) for i in range(4, len(x))]
    for step in (1, 7, 10_000):
        got = np.concatenate([language_id._strings(s, starts, lo, min(lo + step, len(s)), 4) for lo in range(0, len(s), step)])
        assert got.tolist() == want


def test_few_slots_keep_all_languages(spark):
    rows = [(i, f"{chr(97 + i % 20) * 3} {chr(98 + i % 19) * 2} w{i % 20}", f"l{i % 20:02}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(df, cells=1)
    assert len(model.languages) == 20 and model.bits == 10
    out = language_id.identify(df, model)
    assert out.where("lang = lang_pred").count() > 360


def test_query_against_plain_trees(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()
    got = {r.doc_id: r for r in queries.op2_language_id(spark, sf).collect()}
    held = lambda r: __import__("zlib").crc32(str(r.doc_id).encode()) % 4 == 2
    names = sorted({r.lang for r in rows if r.lang is not None})
    plain = [Plain([r.text for r in rows if r.text is not None and r.lang == x and not held(r)], 4) for x in names]
    assert len(got) == len(rows)
    for r in rows[:60]:
        assert got[r.doc_id].held_out == held(r) and 0 <= got[r.doc_id].score <= 1
        bits = [p.bits(r.text or "") for p in plain]
        assert got[r.doc_id].lang_pred == (names[int(np.argmin(bits))] if any(map(str.isalpha, r.text or "")) else "und")
