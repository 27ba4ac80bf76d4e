"""Every registered query of the engine against DuckDB, and the entry points."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from tessera.plans.queries import ORACLE, QUERIES

from .compare import same

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    same(spark, QUERIES[name], ORACLE[name], sf)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["object_id", "orderpriority", "orderstatus", "priceband"] and df.limit(1).count() == 1


def test_entry_works_without_the_training_package(tmp_path):
    """As if the package, its tests and the pipeline had been deleted."""
    for name in ("__spark_entry__.py", "tessera"):
        (tmp_path / name).symlink_to(ROOT / name)
    code = (
        "import sys, importlib.abc\n"
        "class Gone(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('tessera.llm'): raise ModuleNotFoundError(name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "q = e.queries()\n"
        "assert 'asof_facts' in q and 'pipeline' not in q and not any(n.startswith('op1_') for n in q), sorted(q)\n"
        "assert set(e.oracle_sql()) <= set(q)\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_nothing_imports_the_training_package():
    for p in (ROOT / "tessera").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT / "tessera").parts:
            assert "llm" not in p.read_text(), p


def test_filters_reach_the_scan(spark, sf):
    """Envelope and key filters and column pruning show in the plan."""
    from tessera.plans.views import Views

    v = Views(spark, sf)
    plan = v.table("orders").where("o_orderstatus = 'F'").select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in plan and "o_totalprice" not in plan


@pytest.mark.parametrize("name", ["asof_facts", "compare_rect", "temporal_relations", "contributes_to"])
def test_no_cartesian_products(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
