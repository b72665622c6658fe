import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_names():
    found = entry.queries()
    assert set(entry.oracle_sql()) <= set(found)
    assert all(callable(f) for f in found.values())


def test_imports_without_the_subpackage(tmp_path):
    """The queries of the table engine don't need the training-data operators."""
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; print('FOUND', len(e.queries()), 'pipeline' in e.queries())"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", env=os.environ | {"PYTHONPATH": str(tmp_path / "r")}, capture_output=True, text=True, timeout=120)
    assert f"FOUND {len(entry.catalogue.QUERIES)} False" in out.stdout, out.stderr


def test_nothing_else_imports_the_subpackage():
    for folder, _, names in os.walk(os.path.join(ROOT, "tidemark")):
        if os.sep + "llm" in folder:
            continue
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(folder, name)) as f:
                    assert "llm" not in f.read(), name
