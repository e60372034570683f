"""Optional parts, shared results and the keys of hot joins."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

from depsight.operators import dependencies
from depsight.sources import scratch

from .graphs import graph

ROOT = Path(__file__).resolve().parents[1]


def test_entry_without_the_training_data_operators(tmp_path):
    (tmp_path / "__spark_entry__.py").symlink_to(ROOT / "__spark_entry__.py")
    package = tmp_path / "depsight"
    package.mkdir()
    for p in (ROOT / "depsight").iterdir():
        if p.name != "llm":
            (package / p.name).symlink_to(p)
    (package / "llm" / "__pycache__").mkdir(parents=True)  # what a deleted folder may leave
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not [k for k in q if k.startswith('op') or k == 'pipeline']; e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, timeout=120, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_kept_is_written_once_for_each_state(spark, tmp_path):
    source, calls = tmp_path / "t", []
    spark.range(3).write.parquet(str(source))
    make = lambda to: (calls.append(to), spark.read.parquet(str(source)).write.parquet(to))
    one = scratch.kept(spark, "x", [str(source)], make)
    assert scratch.kept(spark, "x", [str(source)], make) == one and len(calls) == 1
    spark.range(9).write.mode("overwrite").parquet(str(source))
    assert spark.read.parquet(scratch.kept(spark, "x", [str(source)], make)).count() == 9 and len(calls) == 2


@pytest.mark.parametrize("bins", [1, 3, 256])
def test_hot_artifacts_are_binned_without_loss(spark, monkeypatch, bins):
    g = graph(spark)
    want = sorted(map(tuple, dependencies.release_graph(g).collect()))
    monkeypatch.setattr(dependencies, "HOT_PAIRS", 1)
    monkeypatch.setattr(dependencies, "BINS", bins)
    assert sorted(map(tuple, dependencies.release_graph(g).collect())) == want and want
