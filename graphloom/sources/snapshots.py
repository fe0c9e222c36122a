"""Snapshots as documents and as tables: reading, checking, receipts."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canonical import canonical_json, sha256
from . import schemas
from .schemas import IR_CONTRACT, IR_VERSION, LAYERS, TABLES, TOOL  # noqa: F401


class SnapshotShapeError(ValueError):
    code = "INVALID_ARCHITECTURE_IR"

    def __init__(self, issues: str, context: str = "Architecture snapshot"):
        super().__init__(f"{context} is not an Architecture IR {IR_VERSION} snapshot. {issues}")
        self.issues = [issues]


class SnapshotReceiptError(ValueError):
    code = "INVALID_SNAPSHOT_RECEIPT"

    def __init__(self, context: str = "Architecture snapshot"):
        super().__init__(f"{context} has an invalid snapshot receipt.")


def validate_snapshot(value, context: str = "Architecture snapshot", tool: str = TOOL) -> dict:
    if issues := schemas.issues(schemas.snapshot_shape(tool), value):
        raise SnapshotShapeError(issues, context)
    return value


def snapshot_id(document: dict) -> str:
    return sha256({**document, "receipt": {**document["receipt"], "snapshotId": ""}})


def verify_receipt(document: dict, context: str = "Architecture snapshot") -> None:
    if snapshot_id(document) != document["receipt"]["snapshotId"]:
        raise SnapshotReceiptError(context)


def assert_snapshot(value, context: str = "Architecture snapshot", tool: str = TOOL) -> dict:
    verify_receipt(validate_snapshot(value, context, tool), context)
    return value


def load_snapshot(path: str, tool: str = TOOL) -> dict:
    """A snapshot's document from a file, checked for shape and receipt."""
    try:
        document = json.loads(Path(path).read_text("utf-8"))
    except (OSError, ValueError) as e:
        raise ValueError(f"Could not read architecture snapshot '{path}'. {e}") from e
    return assert_snapshot(document, f"'{path}'", tool)


def _row(value, kind: T.DataType):
    """JSON data as a row of a schema: missing fields are null, a map's values are JSON texts."""
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        return tuple(_row(value.get(f.name), f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return [_row(v, kind.elementType) for v in value]
    if isinstance(kind, T.MapType):
        return {k: canonical_json(v) for k, v in value.items()}
    return int(value) if isinstance(kind, (T.IntegerType, T.LongType)) else value


def tables(spark: SparkSession, document: dict) -> dict[str, DataFrame]:
    """The document's collections as tables, its metrics, and ``snapshots``: the header that comparability looks at."""
    key = document["receipt"]["snapshotId"]
    rows = {name: document[layer][part] for name, (layer, part) in LAYERS.items()} | {"metrics": [document["analysis"]["metrics"]]}
    out = {}
    for name, ddl in TABLES.items():
        kind = T.StructType.fromDDL(ddl)
        out[name] = spark.createDataFrame([_row({**r, "snapshot_id": key}, kind) for r in rows[name]], kind)
    receipt, project = document["receipt"], document["project"]
    header = [(key, document["irVersion"], receipt["toolVersion"], receipt["configHash"], receipt["compilerOptionsHash"], project["tsconfig"], project["sourceRoot"], list(document["policy"]["failOn"]))]
    out["snapshots"] = spark.createDataFrame(header, "snapshot_id string, irVersion string, toolVersion string, configHash string, compilerOptionsHash string, tsconfig string, sourceRoot string, fail_on array<string>")
    return out


def write_tables(found: dict[str, DataFrame], path: str) -> None:
    """The tables of one or many snapshots as Parquet, each split by snapshot, so that a diff reads two of them alone."""
    for name, df in found.items():
        df.write.mode("append").partitionBy("snapshot_id").parquet(f"{path}/{name}")


def read_tables(spark: SparkSession, path: str, key: str) -> dict[str, DataFrame]:
    return {name: spark.read.schema(TABLES[name]).parquet(f"{path}/{name}").where(F.col("snapshot_id") == key) for name in TABLES}
