"""Sessions: settings that plans rely on, and the package on the executors' path."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parents[1]


#: Rows, and bytes, that a batch between Spark and a Python worker holds, where the session has Spark's own defaults: whole
#: texts travel in them, on both sides and outside the heap.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": (None, str(16 << 20))}


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once per application, so that Python operators import there; bound their batches."""
    sc = spark.sparkContext
    for name, (default, own) in BATCHES.items():
        if spark.conf.get(name, default) == default:
            spark.conf.set(name, own)
    if not getattr(sc, "_graphloom_shipped", False):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(PACKAGE.rglob("*.py")):
                z.write(p, p.relative_to(PACKAGE.parent))
        path = os.path.join(tempfile.mkdtemp(prefix="graphloom-"), "graphloom.zip")
        Path(path).write_bytes(data.getvalue())
        sc.addPyFile(path)
        sc._graphloom_shipped = True
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The application's folder below the one that ``spark.checkpoint.dir`` names.

    Only on one machine (a local master, as in tests) a temporary folder may take its place: on a cluster every executor
    would write to its own.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder: for loops, as a checkpoint keeps the estimated size of its plan, which joins
    of one round's result with itself square each time."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
