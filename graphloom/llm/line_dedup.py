"""Line dedup: lines that many documents share go, the others stay in place."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common


def line_keys(text: str | None) -> list[bytes]:
    """128-bit hashes of the normalised lines; an empty key stands for lines shorter than one code point."""
    lines = (text or "").encode().lower().split(b"\n")
    return [hashlib.blake2b(k, digest_size=16).digest() if (k := x.strip(common.BLANKS)) else b"" for x in lines]


def shared_lines(docs: DataFrame, min_docs: int) -> DataFrame:
    """``(key)`` of the non-empty lines that at least ``min_docs`` distinct documents hold."""

    def explode(batches):
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            rows, keys = [], []
            for i, t in enumerate(texts):
                own = set(line_keys(t)) - {b""}
                rows += [i] * len(own)
                keys += own
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), ids.take(pa.array(rows, pa.int64()))], names=["key", "doc_id"])

    lines = common.mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), explode, "key binary, doc_id long")
    return lines.distinct().groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("key")


def drop_shared_lines(docs: DataFrame, min_docs: int = 10, counts: bool = True) -> DataFrame:
    """Rows of ``docs`` (all its columns) with ``text`` rebuilt from the lines kept, plus ``n_lines`` and ``n_dropped``.

    A null or empty text is one empty line, kept; a null text becomes an empty one.  A line's key is the line without
    the blanks at both ends and with A-Z in lower case; empty keys always stay.  Documents are counted by distinct
    doc_id (null ids as one document), so that repeated rows neither add up nor merge.  A text whose lines all go
    becomes empty.
    The shared keys meet the lines, not the texts: hot lines are split by AQE, and every text moves once, to the list
    of its document's shared keys.  Columns n_lines and n_dropped of the input are replaced, or stay if ``counts`` is
    false, where no columns are added.  An empty table gives an empty one; a text of any length is taken whole by one task.
    """
    docs = docs.drop("n_lines", "n_dropped") if counts else docs
    names = docs.columns
    own_id, list_of_gone = common.unused(docs, "__id", "__gone")
    shared = common.checkpoint(shared_lines(docs, min_docs))

    def explode(batches):
        for b in batches:
            keys = [set(line_keys(t)) - {b""} for t in b.column(1).to_pylist()]
            rows = [i for i, own in enumerate(keys) for _ in own]
            yield pa.RecordBatch.from_arrays([pa.array([k for own in keys for k in own], pa.binary()), b.column(0).take(pa.array(rows, pa.int64()))], names=["key", "id"])

    lines = docs.select(F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(explode, "key binary, id long")
    gone = lines.join(shared, "key", "left_semi").groupBy("id").agg(F.collect_set("key").alias("gone"))
    gone = gone.select(F.col("id").alias(own_id), F.col("gone").alias(list_of_gone))
    met = docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col(own_id)), "left")
    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name == "text" else f.dataType) for f in docs.schema])
    if counts:
        schema = schema.add("n_lines", "long").add("n_dropped", "long")
    at = names.index("text")

    def rebuild(batches):
        for b in batches:
            texts, total, dropped = [], [], []
            for text, out in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist()):
                text = text or ""
                total.append(text.count("\n") + 1)
                if out:
                    out, lines = set(out), text.split("\n")
                    kept = [x for x, k in zip(lines, line_keys(text)) if k not in out]
                    text = "\n".join(kept)
                    dropped.append(len(lines) - len(kept))
                else:
                    dropped.append(0)
                texts.append(text)
            columns = [b.column(i) if i != at else pa.array(texts, pa.string()) for i in range(len(names))]
            columns += [pa.array(total, pa.int64()), pa.array(dropped, pa.int64())] if counts else []
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return met.select(*names, list_of_gone).mapInArrow(rebuild, schema)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_shared_lines(common.table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos,
         unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
keyed AS (
  SELECT doc_id, pos, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
shared AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT *, k IN (SELECT k FROM shared) AS gone FROM keyed)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
