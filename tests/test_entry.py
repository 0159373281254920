"""The driver's entry without the optional corpus folders."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest

TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("pipeline", [False, True])
def test_queries_load_without_the_corpus_folders(tmp_path, pipeline):
    for name in ("sparkbars", "oracle"):
        shutil.copytree(f"{TOP}/{name}", tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py"] + ["corpus_pipeline.py"] * (pipeline and os.path.exists(f"{TOP}/corpus_pipeline.py")):
        shutil.copy(f"{TOP}/{name}", tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(q) == set(o) and len(q) > 215 and 'pipeline' not in q"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    ran = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert ran.returncode == 0, ran.stderr
