import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that the operators use for themselves
        T.StructField("tk", T.StringType()),
        T.StructField("size", T.StringType()),
        T.StructField("score", T.StringType()),
    ]
)


def make_docs(seed: int, n: int = 60):
    """Texts with shared passages, copies, near copies, repeated lines, odd white space, null and empty ones."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["Été", "naïve", "MIT", "license", "Apache", "general", "PUBLIC", "x#y", "日本"]
    words = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passages = [words(rng.randint(13, 40)) for _ in range(4)]
    rows = []
    for i in range(n):
        w = words(rng.choice([0, 1, 2, 5, 12, 13, 25, 60, 120]))
        if rng.random() < 0.5:
            at = rng.randint(0, len(w))
            w[at:at] = rng.choice(passages)
        text = "".join(x + rng.choice([" ", " ", " ", "\n", "\t ", " \x0b", "\r\n"]) for x in w)
        if rows and rng.random() < 0.3:
            text = rng.choice(rows)[1] or ""
            if rng.random() < 0.6:
                text = text + " " + " ".join(words(2))
        if rng.random() < 0.05:
            text = None
        rows.append((i, text))
    long = words(30_000)
    long[100:140] = passages[0] + ["q"] * (40 - len(passages[0]))
    rows += [(n, " ".join(long)), (n + 1, ""), (n + 2, " \n\t "), (n + 3, "MIT License"), (n + 4, "mit license MIT LICENSE")]
    order = list(range(len(rows)))
    rng.shuffle(order)
    langs, sources = ["en", "de", None], ["a", "b", "c", "d", None]
    return [(*rows[i], rng.choice(langs), rng.choice(sources), 0, "t", "s", "x") for i in order]


@pytest.fixture(scope="session", params=[1, 2])
def docs(request, spark, tmp_path_factory):
    """As a table in files, and as plain rows."""
    rows = make_docs(request.param)
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(rows, DOCS).repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), rows


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
