"""The entry module imports where nothing but the repository can be read."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]

BLIND = """
import glob, zipfile
def refuse(*_, **__):
    raise OSError("not here")
zipfile.ZipFile = refuse
glob.glob = lambda *_, **__: []
import __spark_entry__ as entry
assert len(entry.queries()) >= len(entry.oracle_sql()) >= 86
"""


def test_entry_imports_without_spark_jars():
    done = subprocess.run([sys.executable, "-c", BLIND], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


@pytest.mark.parametrize("library", ["xxhash", "tokenizers", "ahocorasick", "corpus_pipeline"])
def test_a_missing_library_costs_only_its_group(library):
    code = f"""
import sys
sys.modules[{library!r}] = None
import __spark_entry__ as entry
from checks import registry
assert set(registry.QUERIES) <= set(entry.queries()) and len(entry.queries()) >= 92
assert set(entry.oracle_sql()) <= set(entry.queries())
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
