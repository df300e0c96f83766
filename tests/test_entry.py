"""The driver contract holds where the text operators, or what they need, cannot be imported."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("blocked", ["numpy", "millrace.llm", "corpus_pipeline"])
def test_a_missing_dependency_costs_its_own_queries_only(blocked):
    code = f"""
import sys, importlib.abc
class Block(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name == {blocked!r} or name.startswith({blocked!r} + "."):
            raise ImportError(name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as e
names = set(e.queries())
assert "window_summary" in names and set(e.oracle_sql()) <= names
assert "pipeline" not in names
"""
    if blocked == "numpy":
        code = code.replace("sys.meta_path.insert", "import pyspark.sql, numpy\nfor k in [k for k in sys.modules if k.startswith('millrace')]: del sys.modules[k]\nimport millrace.plans.catalogue\ndel sys.modules['numpy']\nsys.meta_path.insert")
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
