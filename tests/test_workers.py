"""Operators that start Python workers bring this package with them: nothing else puts it on the workers' path."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
CODE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
from graphloom.operators import cycles, modules
from graphloom.sources import extract
edges = spark.createDataFrame([("s", "ab", "a", "b"), ("s", "ba", "b", "a"), ("s", "bc", "b", "c")], "snapshot_id string, id string, `from` string, `to` string")
assert [r["modules"] for r in cycles.cycles(edges).collect()] == [["a", "b"]]
files = spark.createDataFrame([("s", "src/modules/x/index.ts"), ("s", "src/y.ts")], "snapshot_id string, path string")
assert modules.infer_modules(files, {{}})[0].count() == 2
assert extract.extract(files.withColumn("text", F.lit('import "z"'))).count() == 2
{more}
"""


def run(more: str, tmp_path) -> None:
    done = subprocess.run([sys.executable, "-c", CODE.format(root=str(ROOT), more=more)], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-3000:]


def test_core_operators_elsewhere(tmp_path):
    run("", tmp_path)
