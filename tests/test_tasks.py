"""Costly or large steps are dealt over tasks that follow the input."""

import os

from tessera.geometry import polygon
from tessera.plans import more  # noqa: F401  registers its queries
from tessera.plans import views
from tessera.plans.queries import ORACLE, QUERIES

from .compare import same


def test_simplification_is_dealt_over_all_tasks(spark, sf):
    assert QUERIES["simplified_shapes"](spark, sf).rdd.getNumPartitions() == 4


def test_few_long_shapes_are_kept():
    for k in range(600):
        assert len(polygon.parse(f"LINESTRING ({', '.join(f'{k} {i}' for i in range(300))})").rings[0]) == 300
    kept = [f.cache_info() for f in (polygon._kept, polygon._kept_long)]
    assert kept[1].currsize <= 256 < kept[0].maxsize and polygon.parse("POINT (1 2)") is polygon.parse("POINT (1 2)")


def test_tasks_of_facts_follow_the_input(spark, sf, monkeypatch):
    monkeypatch.setattr(views, "TASK_BYTES", 2000)
    tasks = views.Views(spark, sf).facts().rdd.getNumPartitions()
    assert 4 < tasks == -(-os.path.getsize(f"{sf}/orders.parquet") // 2000)
    for name in ("stored_asof", "merge_chain"):
        same(spark, QUERIES[name], ORACLE[name], sf)
