"""The driver's contract, with and without the training-data subpackage."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_flagship(spark):
    assert entry.entry(spark).columns == ["doc_id"]


def test_sql_has_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_alone():
    code = "import sys; sys.modules['corpusmill.llm'] = None; import __spark_entry__ as e; print(len(e.queries()), any(q[:1] == 'p' and q[1:2].isdigit() for q in e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    assert done.stdout.split()[1] == "False"


def test_nothing_imports_the_subpackage():
    for p in (ROOT / "corpusmill").rglob("*.py"):
        if "llm" not in p.parts:
            assert "corpusmill.llm" not in p.read_text()
