"""Rows that repeat an id, a text or both."""

import pytest

from tessera.llm import near_dedup, substring_dedup

T, U = (" ".join(f"{c}{i}" for i in range(30)) for c in "tu")


@pytest.mark.parametrize("options", [{}, {"chunk_windows": 5, "bucket_windows": 20}])
def test_substrings_of_equal_rows(spark, tmp_path, options):
    """A text that occurs nowhere else stays in all copies; what it repeats itself goes from all."""
    again = f"{U} x {U}"
    rows = [(5, T), (5, T), (None, again), (None, again), (None, again), (6, "v " + T), (6, "v " + T), (7, "few words"), (7, "few words")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/t")
    out = substring_dedup.deduplicated(spark.read.parquet(f"{tmp_path}/t"), **options).collect()
    got = sorted((r.doc_id or 99, r.n_words, r.n_removed, r.kept) for r in out)
    assert got == [(5, 30, 0, T)] * 2 + [(6, 31, 30, "v")] * 2 + [(7, 2, 0, "few words")] * 2 + [(99, 61, 30, f"{U} x")] * 3


def test_near_duplicates_dropped(spark):
    """One document of each group stays, also where ids repeat with the same or another text or are missing."""
    a, b, c, d = T, U, " ".join(f"c{i}" for i in range(30)), " ".join(f"d{i}" for i in range(30))
    rows = [(3, a), (7, a), (7, b), (7, a), (8, c), (8, c), (None, d), (None, d), (None, a), (None, c + " more"), (None, None), (9, ""), (9, "")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, lang string")
    out = near_dedup.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    got = sorted((r.doc_id or 99, r.text or "") for r in out.collect())
    assert got == sorted([(3, a), (7, b), (8, c), (99, d), (99, ""), (9, "")])
