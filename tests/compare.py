"""A Spark query and its DuckDB SQL over the same tables."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _text(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return "null"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def _normal(df):
    df = df[sorted(df.columns)].map(_text)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def same(spark, query, sql, sf_dir):
    got = query(spark, sf_dir).toPandas()
    with duckdb.connect() as c:
        c.execute("SET TimeZone = 'UTC'")
        for t in TABLES:
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        want = c.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    pd.testing.assert_frame_equal(_normal(got), _normal(want))
