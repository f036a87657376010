"""The driver's contract, with and without the subpackage for training data."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as e

from .conftest import ROOT


def test_contract():
    queries, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(queries) and all(map(callable, queries.values())) and all(s.strip() for s in sql.values())


@pytest.mark.skipif(not os.path.isdir(e.SMOKE), reason="no tables here")
def test_entry(spark):
    df = e.entry(spark)
    assert df.count() > 0 and df.columns == ["subject", "key", "value", "authority"]


def bare(tmp_path, without):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "tests", "__pycache__"))
    for name in without:
        path = copy / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    return subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries())"], cwd=copy, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})


@pytest.mark.parametrize("without", [["millrace/llm"], ["millrace/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_imports_without_the_subpackage(tmp_path, without):
    run = bare(tmp_path, without)
    assert run.returncode == 0, run.stderr
    assert "claim_winner" in run.stdout and "pipeline" not in run.stdout
