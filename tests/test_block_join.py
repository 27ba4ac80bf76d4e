"""Equal shapes joined as blocks: the same pairs as by the grid join, with one report for a pair of blocks."""

import random

import duckdb
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tessera.operators import relations, spatial
from tessera.plans import more  # noqa: F401  registers its queries
from tessera.plans.queries import ORACLE, QUERIES
from tessera.schema import TABLES as TABLES_OF
from tessera.schema import empty

from .compare import TABLES, same


def _rectangles(spark, tag, n, rng):
    rows = []
    for i in range(n):
        x, y = float(rng.randint(0, 3) * 2), float(rng.randint(-1, 1))
        rows.append((f"{tag}{i // 2}", i % 5, x, y, x + rng.choice([1.0, 3.0]), y + 1))
    rows += [(f"{tag}hot", i, 1.0, 0.0, 2.0, 2.0) for i in range(60)] + [(f"{tag}same", 0, 1.0, 0.0, 2.0, 2.0)] * 3 + [(f"{tag}none", 0, None, 0.0, 1.0, 1.0)]
    return spark.createDataFrame(rows, "object_id string, k int, xmin double, ymin double, xmax double, ymax double")


@pytest.mark.parametrize(("block", "group"), [(1024, 65536), (7, 20), (1, 1)])
def test_pairs_are_those_of_the_grid_join(spark, monkeypatch, block, group):
    monkeypatch.setattr(spatial, "BLOCK", block)
    monkeypatch.setattr(spatial, "GROUP", group)
    rng = random.Random(3)
    a, b = _rectangles(spark, "A", 80, rng), _rectangles(spark, "B", 50, rng)
    pairs = spatial.block_join(a, b)
    assert pairs.agg(F.max(F.greatest(F.size("a_rows"), F.size("b_rows")))).first()[0] <= block
    bounds = [s + c for s in ("a_", "b_") for c in spatial.ENVELOPE]
    got = spatial.expand(pairs).select("a.object_id", "a.k", "b.object_id", "b.k", *bounds).collect()
    want = spatial.grid_join(a, b).select("a_object_id", "a_k", "b_object_id", "b_k", *bounds).collect()
    assert len(want) > 3000 and sorted(map(tuple, got)) == sorted(map(tuple, want))


@pytest.fixture(scope="module")
def copies(sf, tmp_path_factory):
    """Suppliers and parts of three shapes: 40 and 60 rows of each."""
    d = tmp_path_factory.mktemp("copies")
    for t in TABLES:
        (d / f"{t}.parquet").symlink_to(f"{sf}/{t}.parquet")
    for t, key, n in (("supplier", "s_suppkey", 40), ("part", "p_partkey", 60)):
        (d / f"{t}.parquet").unlink()
        duckdb.sql(f"COPY (SELECT t.* REPLACE ({key} + 360 * i AS {key}) FROM range({n}) r(i), '{sf}/{t}.parquet' t WHERE {key} BETWEEN 3 AND 5) TO '{d}/{t}.parquet'")
    return str(d)


def _stages(spark):
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    none = jvm.java.util.ArrayList()
    found = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, gateway.new_array(jvm.double, 0), none)
    return [found.apply(i) for i in range(found.size())]


PAIRS = ["common_area_shapes", "compare_shapes", "write_overlaps", "compare_polygons", "compare_rect", "spatial_equality_rect", "relation_calc_rect", "containment_rect"]


@pytest.mark.parametrize("name", PAIRS)
def test_equal_shapes_are_reported_once(spark, copies, name):
    """What is dealt over the tasks are pairs of shapes; their rows are made behind it."""
    same(spark, QUERIES[name], ORACLE[name], copies)
    before = max(s.stageId() for s in _stages(spark))
    seen = Observation()
    QUERIES[name](spark, copies).observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    read = [s.shuffleReadRecords() for s in _stages(spark) if s.stageId() > before]
    assert seen.get["n"] >= 3 * 40 * 39 and 0 < sum(read) < 1500


def test_pairs_of_blocks_are_made_a_row_at_a_time(spark):
    """Of a pair of blocks whose pairs are read one by one, those of a single row are made at once."""
    rows = lambda n: F.transform(F.sequence(F.lit(1), F.col("id").cast("int") + n), lambda k: F.struct(k.alias("k")))
    first = spatial.expand(spark.range(0, 1, 1, 1).select(rows(50).alias("a_rows"), rows(20).alias("b_rows"))).limit(1)
    assert len(first.collect()) == 1
    node, made = first._jdf.queryExecution().executedPlan(), []
    while node.children().nonEmpty():
        if node.nodeName() == "Generate":
            made.append(node.metrics().apply("numOutputRows").value())
        node = node.children().head()
    assert len(made) == 2 and 0 < max(made) <= 50


def test_overlaps_are_rounded_on_blocks(spark, sf):
    """Not once for each of their pairs."""
    plan = QUERIES["write_overlaps"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "round(" in plan and "round(" not in plan[: plan.index("Generate")]


def test_stored_overlaps_are_replaced_without_dealing_the_new_ones(spark):
    """Rows of the same name go; further columns that both have are kept."""
    old = spark.createDataFrame([("overlap:a:b", "a", "b", "old", 0.1, 1.0), ("overlap:a:c", "a", "c", "old", 0.2, 2.0)], "overlap_id string, a string, b string, wkt string, pct double, area double")
    report = spark.createDataFrame([("a", "b", 0.5, "new", 5.0), ("a", "d", 0.6, "new", 6.0), ("a", "e", None, None, None)], "a string, b string, overlap double, overlap_wkt string, area double")
    got = {(r.overlap_id, r.wkt, r.pct, r.area) for r in relations.add_overlaps(old, report).collect()}
    assert got == {("overlap:a:b", "new", 0.5, 5.0), ("overlap:a:d", "new", 0.6, 6.0), ("overlap:a:c", "old", 0.2, 2.0)}
    assert relations.add_overlaps(old.drop("area"), report).columns == TABLES_OF["overlaps"].names
    plan = relations.add_overlaps(empty(spark, "overlaps"), report)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
