"""The driver's contract, with and without the training-data subpackage."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry
from graphloom.plans import queries

ROOT = Path(__file__).resolve().parents[1]


def test_flagship_runs(spark):
    rows = entry.entry(spark).collect()
    assert rows and {"src", "dst", "imports", "visibility"} <= set(rows[0].asDict())


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(queries.QUERIES) == set(queries.SQL) <= set(entry.queries())


def test_the_rest_works_without_the_subpackage():
    code = "import sys; sys.modules['graphloom.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert len(e.queries()) == len(e.oracle_sql()) > 50; assert not [q for q in e.queries() if q[:2] == 'op']"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_nothing_else_imports_the_subpackage():
    for p in (ROOT / "graphloom").rglob("*.py"):
        if "llm" not in p.parts:
            text = p.read_text()
            assert "graphloom.llm" not in text and "import llm" not in text and ".llm" not in text, p
