import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.functions.temporal import as_of, instant
from tessera.operators import merge
from tessera.schema import TABLES


def day(n):
    return datetime(2000, 1, 1) + timedelta(days=n)


def facts(spark, rows):
    """object, property, value, from, to, db from, db to as day numbers."""
    out = [(o, p, v, "xsd:string", None, day(a), None if b is None else day(b), None, day(c), None if d is None else day(d)) for o, p, v, a, b, c, d in rows]
    return spark.createDataFrame(out, TABLES["facts"])


def objects(spark, rows):
    return spark.createDataFrame([(o, "T", day(a), None if b is None else day(b), None) for o, a, b in rows], TABLES["objects"])


def rows_of(df):
    return {(r.object_id, r.property, r.value, r.valid_from, r.valid_to, r.db_from, r.db_to) for r in df.collect()}


def test_existing(spark):
    old = facts(spark, [("a", "p", "1", 0, None, 0, None), ("a", "q", "x", 0, None, 0, None), ("b", "p", "1", 0, None, 0, None)])
    new = facts(spark, [("a", "p", "2", 10, None, 0, None), ("a", "q", "x", 10, None, 0, None)])
    out = rows_of(merge.merge_existing(old, new, instant("2000-02-01")))
    d = datetime(2000, 2, 1)
    assert out == {
        ("a", "p", "1", day(0), None, day(0), d),
        ("a", "p", "1", day(0), day(10), d, None),
        ("a", "p", "2", day(10), None, d, None),
        ("a", "q", "x", day(0), None, day(0), None),
        ("b", "p", "1", day(0), None, day(0), None),
    }


def test_strategies_reject(spark):
    closed = facts(spark, [("a", "p", "1", 0, 20, 0, None)])
    new = facts(spark, [("a", "p", "2", 10, None, 0, None)])
    life = objects(spark, [("a", 0, None)])
    at = instant("2000-02-01")
    with pytest.raises(merge.MergeConflict, match="ended"):
        merge.merge(life, closed, new, at)
    merge.merge(life, closed, new, at, strategy=merge.MergeStrategy.EXISTING)
    with pytest.raises(merge.MergeConflict, match="already"):
        merge.merge(life, closed, new, at, strategy=merge.MergeStrategy.NO_MERGE)
    short = objects(spark, [("a", 0, 5)])
    with pytest.raises(merge.MergeConflict, match="outside"):
        merge.merge(short, closed.limit(0), new, at)
    with pytest.raises(merge.MergeConflict, match="open fact"):
        merge.merge(short, closed.limit(0), new, at, existence=merge.ExistenceStrategy.EXTEND)
    with pytest.raises(merge.MergeConflict, match="datatype"):
        merge.add_facts(life, closed, new, {"p": "xsd:int"}, at)


def test_extend(spark):
    life = objects(spark, [("a", 5, 10), ("b", 5, 10), ("c", 5, None)])
    new = facts(spark, [("a", "p", "1", 1, 20, 0, None), ("b", "p", "1", 6, 7, 0, None), ("c", "p", "1", 3, None, 0, None)])
    got = {r.object_id: (r.exists_from, r.exists_to) for r in merge.extended_existence(life, new).collect()}
    assert got == {"a": (day(1), day(20) + timedelta(microseconds=1)), "b": (day(5), day(10)), "c": (day(3), None)}


def test_chain_equals_single_merges(spark):
    """The batch form leaves what merging one version after another leaves, and as-of reads agree."""
    rng = random.Random(1)
    values = [rng.choice("ab") for _ in range(8)]
    df = spark.createDataFrame([("a", "p", "xsd:string", v, day(10 * i)) for i, v in enumerate(values)], "object_id string, property string, datatype string, value string, at timestamp_ntz")
    chain = merge.version_chain(df, ["object_id", "property", "datatype"], "value", "at")
    table = facts(spark, [("a", "p", values[0], 0, None, 1, None)])
    for i, v in enumerate(values[1:], 1):
        table = merge.merge_existing(table, facts(spark, [("a", "p", v, 10 * i, None, 0, None)]), F.lit(day(10 * i + 1)).cast("timestamp_ntz"))
        table = spark.createDataFrame(table.collect(), TABLES["facts"])
    assert rows_of(table) == {(r.object_id, r.property, r.value, r.valid_from, r.valid_to, r.db_from, r.db_to) for r in chain.collect()}
    for n in range(0, 90, 7):
        for known in (n, 200):
            seen = [r.value for r in table.where(as_of(F.lit(day(n)).cast("timestamp_ntz"), F.lit(day(known)).cast("timestamp_ntz"))).collect()]
            assert len(seen) <= 1
            if known == 200:
                assert seen == [values[n // 10 if n < 80 else 7]]
