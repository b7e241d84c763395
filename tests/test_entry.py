"""The entry file without the optional folders."""

import os
import shutil
import subprocess
import sys

from catalog.queries import QUERIES

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LISTS = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"


def test_entry_without_the_optional_folders(tmp_path):
    """Deleting them leaves every query over event logs, whether or not the pipeline's file stays."""
    away = shutil.ignore_patterns("llm", "__pycache__", ".git")
    for name in ("ticketloom", "catalog", "__spark_entry__.py", "corpus_pipeline.py"):
        source, target = os.path.join(ROOT, name), tmp_path / name
        if os.path.isdir(source):
            shutil.copytree(source, target, ignore=away)
        elif os.path.exists(source):
            shutil.copy(source, target)
    run = subprocess.run([sys.executable, "-c", LISTS], cwd=tmp_path, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr
    queries, oracles = map(int, run.stdout.split())
    assert queries == len(QUERIES) and oracles <= queries
