"""The driver's contract holds with and without the corpus operators."""

import os
import shutil
import subprocess
import sys

import pytest

from .conftest import ROOT

PROGRAM = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as e
from gneiss.session import session
names = e.queries()
assert len(names) > 50 and set(e.oracle_sql()) <= set(names)
print(sorted(n for n in names if n.startswith("op") and n[2].isdigit() or n == "pipeline"))
if {run}:
    spark = session(2, **{{"spark.sql.shuffle.partitions": "2", "spark.checkpoint.dir": {root!r} + "/shared"}})
    print("rows", e.entry(spark).count())
"""


@pytest.mark.parametrize("gone", [["gneiss/llm", "tests/llm"], ["gneiss/llm", "tests/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_entry_without_the_corpus_operators(tmp_path, gone):
    root = str(tmp_path / "tree")
    shutil.copytree(ROOT, root, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in gone:
        path = os.path.join(root, name)
        shutil.rmtree(path, ignore_errors=True) if not name.endswith(".py") else os.remove(path)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": root}
    done = subprocess.run([sys.executable, "-c", PROGRAM.format(root=root, run=len(gone) == 2)], cwd=root, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    there = os.path.isdir(os.path.join(ROOT, "gneiss", "llm")) and "gneiss/llm" not in gone
    assert ("op9_neardup" in done.stdout) == there and "pipeline" not in done.stdout
    assert "rows 500" in done.stdout or len(gone) != 2
