"""The driver contract, with the training-data subpackage and without."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
LOOK = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q), sum(n.startswith('op') or n == 'pipeline' for n in q))"


@pytest.mark.parametrize("gone", [("obliva/llm", "tests/llm"), ("obliva/llm", "tests/llm", "corpus_pipeline.py")])
def test_entry_without_the_subpackage(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json", "*.md", "spark-warehouse"))
    for name in gone:
        path = copy / name
        shutil.rmtree(path, ignore_errors=True) if path.is_dir() or not path.suffix else path.unlink(missing_ok=True)
    out = subprocess.run([sys.executable, "-c", LOOK], cwd=copy, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy)}, capture_output=True, text=True, check=True)
    total, ours = map(int, out.stdout.split())
    assert total > 60
    assert ours == 0
