"""Embedding near-duplicates: random-hyperplane tables, exact cosines inside the buckets, connected components."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common


def plan_tables(rows: int, cosine: float, bucket_rows: int = 256, miss: float = 1e-6) -> tuple[int, int]:
    """``(bits, tables)``: bits so that a bucket has about ``bucket_rows``, tables so that a pair at the threshold is
    missed with a chance of at most ``miss`` (pairs above it less often)."""
    bits = min(30, max(1, math.ceil(math.log2(max(2, rows) / bucket_rows))))
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-agree)))


def close_pairs(x: np.ndarray, left: slice, right: slice, cosine: float):
    """Arrays ``(a, b)`` of rows of the two slices whose cosine, in double precision, is at least ``cosine``, tile by tile.

    ``x`` is scaled to largest components of one.  Single precision with a margin finds what is worth the exact product.
    """
    d = x.shape[1]
    length = np.sqrt((x * x).sum(1))
    rough = (x / length[:, None]).astype(np.float32)
    margin = cosine - 1e-5 - 2e-7 * d
    for k in range(left.start, left.stop, 512):
        end = min(k + 512, left.stop)
        a, b = np.nonzero(rough[k:end] @ rough[right].T >= margin)
        if len(a) * d > 4_000_000:
            exact = (x[k:end] @ x[right].T)[a, b]
            a, b = a + k, b + right.start
        else:
            a, b = a + k, b + right.start
            exact = (x[a] * x[b]).sum(1)
        own = exact / (length[a] * length[b]) >= cosine
        yield a[own], b[own]


BUCKET = ["t", "d", "code", "i", "j", "label"]


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, block: int = 2048, seed: int = 5) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors(vec_id, label, embedding)``.

    Vectors of equal label (not null) and equal dimension link if their cosine, in double precision, is at least
    ``cosine``.  Null, empty, zero and non-finite vectors and those without a label link with nothing and stand alone.
    Rows of equal vec_id count as vectors of their own, each with its own links; a row with a null vec_id links with
    nothing and has null component_id and kept.  Exact copies are counted once with a weight, so their links are not
    expanded.  Other columns are not read; an empty table gives an empty result.

    Different vectors are numbered by their place in a checkpoint.  A pair meets in every table in which both have the
    same code; it is counted in the first of them, which both rows' codes tell, so no pair leaves its task: a task
    returns counts and a spanning star.  Buckets of more than ``block`` rows are dealt as pairs of blocks.  Nothing is
    dropped from a bucket.  Vectors travel in the precision in which they came.
    """
    kind = vectors.schema["embedding"].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    real, size = (np.float32, 4) if single else (np.float64, 8)
    typed = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast(f"array<{'float' if single else 'double'}>").alias("e"))
    fine = F.expr("vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL AND size(e) > 0 AND NOT exists(e, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity')) AND exists(e, x -> x <> 0)")
    keyed = typed.select("vec_id", F.when(F.coalesce(fine, F.lit(False)), F.struct(F.xxhash64("label", "e").alias("a"), F.xxhash64(F.lit(seed), "e", "label").alias("b"))).alias("key"), "label", "e")
    reps = keyed.where("key IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("w"), F.first("label").alias("label"), F.first("e").alias("e"))
    most = typed.where("label IS NOT NULL").groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = plan_tables(most, cosine)
    powers = 1 << np.arange(bits, dtype=np.int64)

    def code(batches):
        planes = {}
        for b in batches:
            lengths = np.asarray(b.column(4).value_lengths())
            flat = np.asarray(b.column(4).flatten())
            ends = np.cumsum(lengths)
            codes, signs, raw = [None] * len(lengths), [None] * len(lengths), [None] * len(lengths)
            for d in np.unique(lengths):
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, int(d)]).standard_normal((int(d), tables * bits))
                own = np.flatnonzero(lengths == d)
                x = flat[(ends[own] - d)[:, None] + np.arange(d)]
                on = (x / np.abs(x).max(1, keepdims=True).astype(np.float64)) @ planes[d] > 0
                for i, row, sign, v in zip(own, on.reshape(len(own), tables, bits) @ powers, np.packbits(on, axis=1), x):
                    codes[i], signs[i], raw[i] = row.astype(np.int32), sign.tobytes(), v.tobytes()
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(raw, pa.binary()), pa.array(signs, pa.binary()), pa.array(codes, pa.list_(pa.int32()))], names=["key", "rep", "w", "label", "v", "signs", "codes"])

    coded = common.mapped(reps.select("key", "rep", "w", "label", "e"), code, "key struct<a:long,b:long>, rep long, w long, label string, v binary, signs binary, codes array<int>")
    coded = common.checkpoint(coded).withColumn("no", F.monotonically_increasing_id())
    at = coded.select("no", "label", F.length("v").alias("d"), F.posexplode("codes").alias("t", "code"))
    large = common.checkpoint(at.groupBy("label", "d", "t", "code").count().where(F.col("count") > block))
    slots = coded.select("no", "w", "label", "v", "signs", F.length("v").alias("d"), F.posexplode("codes").alias("t", "code"))
    if large.isEmpty():
        slots = slots.withColumns({"mine": F.lit(0), "i": F.lit(0), "j": F.lit(0)})
    else:
        split = at.join(large, ["label", "d", "t", "code"]).groupBy("no").agg(F.map_from_entries(F.collect_list(F.struct("t", F.ceil(F.col("count") / block).cast("int")))).alias("split"))
        slots = slots.join(split, "no", "left").withColumn("parts", F.coalesce(F.try_element_at("split", F.col("t")), F.lit(1)))
        slots = slots.withColumn("mine", F.pmod(F.xxhash64("no"), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        slots = slots.withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other"))

    def bucket(rows: pa.RecordBatch):
        """``(no, n, root)`` of the linked rows of one bucket, or of two blocks of one."""
        t, d, i, j = (rows.column(c)[0].as_py() for c in ("t", "d", "i", "j"))
        rows = rows.take(pa.compute.sort_indices(rows.column("mine"))) if i != j else rows
        x = np.frombuffer(b"".join(rows.column("v").to_pylist()), real).reshape(len(rows), d // size).astype(np.float64)
        x /= np.abs(x).max(1, keepdims=True)
        signs = np.frombuffer(b"".join(rows.column("signs").to_pylist()), np.uint8).reshape(len(rows), -1)
        codes = np.unpackbits(signs, axis=1, count=t * bits).reshape(len(rows), t, bits) @ powers
        w, mine = np.asarray(rows.column("w")), np.asarray(rows.column("mine"))
        cut = int((mine == i).sum())
        n, forest = np.zeros(len(rows), np.int64), common.Forest(len(rows))
        for a, b in close_pairs(x, slice(0, cut), slice(0 if i == j else cut, len(rows)), cosine):
            if i == j:
                a, b = a[a < b], b[a < b]
            if len(a):
                new = (codes[a] != codes[b]).all(1)
                a, b = a[new], b[new]
                n += np.bincount(a, w[b], len(n)).astype(np.int64) + np.bincount(b, w[a], len(n)).astype(np.int64)
                forest.link(a, b)
        no, met = np.asarray(rows.column("no")), np.flatnonzero(n)
        return no[met], n[met], no[forest.root[met]]

    def count(batches):
        def done(rows):
            label = np.asarray(rows.column("label").dictionary_encode().indices)
            new = np.ones(rows.num_rows, bool)
            new[1:] = label[1:] != label[:-1]
            for c in BUCKET[:-1]:
                x = np.asarray(rows.column(c))
                new[1:] |= x[1:] != x[:-1]
            starts = np.append(np.flatnonzero(new), rows.num_rows)
            for a, z in zip(starts[:-1].tolist(), starts[1:].tolist()):
                yield a, z, rows.slice(a, z - a)

        def result(found):
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*found)], names=["no", "n", "root"])

        held = None
        for b in batches:
            rows = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            runs = list(done(rows))
            found = [bucket(x) for a, z, x in runs[:-1] if z - a > 1]
            held = runs[-1][2] if runs else None
            if found:
                yield result(found)
        if held is not None and held.num_rows > 1:
            yield result([bucket(held)])

    slots = slots.select(*BUCKET, "mine", "no", "w", "v", "signs")
    found = common.checkpoint(common.mapped(slots.repartition(*BUCKET).sortWithinPartitions(*BUCKET), count, "no long, n long, root long"))
    links = found.groupBy("no").agg(F.sum("n").alias("n"))
    groups = common.connected_components(found, "no", "root")
    classes = coded.select("key", "rep", "w", "no").join(links, "no", "left").join(groups, F.col("no") == groups.node, "left")
    classes = common.checkpoint(classes.select("key", "rep", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n"), F.coalesce("component_id", "no").alias("c")))
    least = classes.groupBy("c").agg(F.min("rep").alias("least"))
    out = keyed.select("vec_id", "key").join(classes.join(least, "c").select("key", "n", "least"), "key", "left")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("least", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "embeddings"))


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND list_sum(list_transform(embedding, lambda x: CASE WHEN x IS NULL OR isnan(x) OR isinf(x) THEN 1 ELSE 0 END)) = 0
    AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (
  SELECT vec_id AS node, vec_id AS root FROM embeddings
  UNION SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.node),
classes AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node),
degrees AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e LEFT JOIN degrees d ON d.a = e.vec_id LEFT JOIN classes c ON c.node = e.vec_id
"""
