"""The entry module with the training-data operators and without them."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent

CODE = """
import importlib.abc, sys
class Gone(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path, target=None):
        if name in {gone!r}:
            raise ImportError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as entry
queries, checks = entry.queries(), entry.oracle_sql()
assert callable(queries["event_pipeline"]) and "clinical_study_table" in queries
assert set(checks) <= set(queries)
print(len(queries), any(name.startswith("op") and name[2].isdigit() for name in queries))
"""


@pytest.mark.parametrize("gone", [["anchorset.llm", "corpus_pipeline"], ["corpus_pipeline"], ["ahocorasick"], ["public_tokenizers"]])
def test_queries_of_the_library_remain(gone):
    """Whatever the training-data operators lack, the library's own queries are there."""
    done = subprocess.run([sys.executable, "-c", CODE.format(gone=gone)], cwd=ROOT, capture_output=True, text=True, check=True)
    number, with_operators = done.stdout.split()
    assert int(number) > 50 and with_operators == "False"


def test_the_library_does_not_import_the_operators():
    for source in (ROOT / "anchorset").rglob("*.py"):
        if "llm" not in source.parts:
            text = source.read_text()
            assert "llm" not in text, source
