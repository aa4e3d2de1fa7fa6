"""The engine without the operators for training text."""

import os
import shutil
import subprocess
import sys

import pytest

TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAY = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op') or n == 'pipeline' for n in e.queries()))"


@pytest.mark.parametrize("pipeline", [True, False])
def test_engine_queries_without_llm(tmp_path, pipeline):
    from shardloom.plans import catalogue

    copy = tmp_path / "repo"
    shutil.copytree(TOP, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache", *([] if pipeline else ["corpus_pipeline.py"])))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SAY], cwd=copy, env=env, capture_output=True, text=True, check=True)
    assert out.stdout.split() == [str(len(catalogue.QUERIES)), str(len(catalogue.ORACLE_SQL)), "False"]
