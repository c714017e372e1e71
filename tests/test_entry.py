"""The entry without the llm subpackage; queries whose result may not hang on partitions."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest

from millrace.plans.registry import queries

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = """
import __spark_entry__ as e
from millrace.session import session
names = e.queries()
assert len(names) > 200 and set(e.oracle_sql()) <= set(names)
assert not [n for n in names if n == "pipeline" or n.startswith("op") and n[2:3].isdigit()]
spark = session("local[2]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2"})
assert e.entry(spark).count() > 0
"""


@pytest.mark.parametrize("also", [[], ["corpus_pipeline.py"]])
def test_entry_without_llm(tmp_path, also):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache", *also))
    run = subprocess.run([sys.executable, "-c", ASK], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]


def test_integrated_mixture_whatever_the_partitions(spark, sf):
    had, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    for n in ("1", "4", "211"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append(sorted(map(tuple, queries()["integrated_mixture"](spark, sf).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", had)
    assert seen[0] == seen[1] == seen[2]
