"""The library without its optional subpackage: everything else imports and runs."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

CODE = """
import __spark_entry__ as e
names = set(e.queries())
assert not any(n.startswith("op") and n[2].isdigit() for n in names) and "pipeline" not in names, names
assert set(e.oracle_sql()) <= names and len(names) > 100
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
assert e.queries()["dominance_guard"](s, "/root/testdata/sf0.001").count() == 1
print("whole")
"""


def test_rest_without_the_subpackage(tmp_path):
    skip = shutil.ignore_patterns("llm", ".git", "__pycache__", "corpus_pipeline.py", ".pytest_cache")
    shutil.copytree(ROOT, tmp_path / "copy", ignore=skip)
    run = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path / "copy", env=os.environ | {"PYTHONPATH": str(tmp_path / "copy")}, capture_output=True, text=True, timeout=300)
    assert run.stdout.strip().endswith("whole"), run.stderr[-2000:]


def test_a_broken_import_is_not_passed_over(tmp_path):
    """Only a missing subpackage is; what it needs must be there."""
    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    queries = tmp_path / "copy/rankloom/llm/queries.py"
    if queries.exists():
        queries.write_text("import no_such_module\n")
        run = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path / "copy", env=os.environ | {"PYTHONPATH": str(tmp_path / "copy")}, capture_output=True, text=True, timeout=120)
        assert run.returncode and "no_such_module" in run.stderr
