"""Quality classifier: random-indexing word vectors, pooled per document, and a calibrated two-layer network."""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

BLOCKS = 64


def index_vectors(buckets: int, dims: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places and two signs per bucket: the sparse random vector that a word adds to its neighbours."""
    rng = np.random.default_rng(seed)
    first = rng.integers(0, dims, buckets)
    return np.stack([first, (first + rng.integers(1, dims, buckets)) % dims]), rng.choice([-1.0, 1.0], (2, buckets))


def word_vectors(docs: DataFrame, buckets: int = 16_384, dims: int = 32, window: int = 2, seed: int = 11) -> np.ndarray:
    """Context vectors ``(buckets, dims)`` over all rows of ``docs(text)``, of length one.

    Each token adds its random index vector to the tokens up to ``window`` places away.  Words share vectors by hash,
    so what a task returns, and what the driver gets, has a fixed size (``buckets * dims`` floats).
    """
    place, sign = index_vectors(buckets, dims, seed)

    def run(batches):
        total, mask = np.zeros(buckets * dims), np.uint64(buckets - 1)
        for b in batches:
            texts = [(t or "").encode() for t in b.column(0).to_pylist()]
            for _, pieces in common.blocks(texts):
                tokens = common.Tokens(pieces)
                w = (tokens.hash & mask).astype(np.int64)
                for o in range(1, window + 1):
                    same = tokens.doc[o:] == tokens.doc[:-o]
                    a, c = w[:-o][same], w[o:][same]
                    for to, of in ((a, c), (c, a)):
                        for k in (0, 1):
                            total += np.bincount(to * dims + place[k][of], sign[k][of], buckets * dims)
        size = buckets * dims // BLOCKS
        yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([total[k * size : (k + 1) * size].astype(np.float32).tobytes() for k in range(BLOCKS)], pa.binary())], names=["block", "value"])

    parts = common.summed(docs.select("text"), run).collect()
    out = np.zeros((BLOCKS, buckets * dims // BLOCKS), np.float32)
    for r in parts:
        out[r["block"]] = np.frombuffer(r["value"], np.float32)
    out = out.reshape(buckets, dims)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


SHAPES = 10


def shapes(t: common.Tokens) -> list[np.ndarray]:
    """Per token: punctuation, runs of it, bars, capitals, repeats of the last and second last token, length, scripts, digits."""
    first = t.bytes[t.start] if len(t.start) else np.zeros(0, np.uint8)
    second = t.bytes[np.minimum(t.start + 1, len(t.bytes) - 1)] if len(t.start) else first
    upper = lambda c: ((c >= 65) & (c <= 90)).astype(float)

    def again(o: int) -> np.ndarray:
        return np.concatenate([np.zeros(min(o, len(t.hash))), ((t.hash[o:] == t.hash[:-o]) & (t.doc[o:] == t.doc[:-o])).astype(float)])

    marks = t.kind == 2
    return [marks, marks & (t.length > 1), marks & (first == ord("|")), upper(first), upper(first) * upper(second), again(1), again(2), np.minimum(t.length, 30), first >= 128, (first >= 48) & (first <= 57)]


def width(vectors: np.ndarray) -> int:
    return 2 * vectors.shape[1] + SHAPES + 1


def pooled(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """A row per text: mean word vector, its square, size, and shares of surface forms.  Whole texts, in blocks of bytes."""
    n = len(texts)
    count, total, forms = np.zeros(n), np.zeros((n, vectors.shape[1])), np.zeros((n, SHAPES))
    for owners, pieces in common.blocks(texts):
        t = common.Tokens(pieces)
        own = np.bincount(t.doc, minlength=len(pieces))
        has = np.flatnonzero(own)
        if not len(has):
            continue
        starts = np.cumsum(own[has]) - own[has]
        to = owners[has]
        np.add.at(count, to, own[has])
        np.add.at(total, to, np.add.reduceat(vectors[(t.hash & np.uint64(len(vectors) - 1)).astype(np.int64)], starts, axis=0))
        np.add.at(forms, to, np.stack([np.add.reduceat(x.astype(float), starts) for x in shapes(t)], axis=1))
    some = np.maximum(count, 1)[:, None]
    mean = total / some
    return np.concatenate([mean, mean * mean, np.log1p(count)[:, None], forms / some], axis=1).astype(np.float32)


@dataclasses.dataclass
class Network:
    """Two layers over standardised inputs; ``temperature`` divides the logits."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 30, batch: int = 256, rate: float = 3e-3, decay: float = 1e-4, seed: int = 1) -> Network:
    """Adam on four fifths of the rows; the temperature is the one of a grid with the least loss on the last fifth."""
    rng = np.random.default_rng(seed)
    x, y = x.astype(np.float64), y.astype(np.float64)
    mean, scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), np.zeros(hidden), np.zeros(1)]
    if len(np.unique(y)) < 2:  # nothing to tell apart: the share of ones, smoothed
        share = (y.sum() + 1) / (len(y) + 2)
        return Network(mean, scale, p[0], p[1], p[2], float(np.log(share / (1 - share))))
    order = rng.permutation(len(x))
    held, own = order[: len(x) // 5], order[len(x) // 5 :]
    z = (x - mean) / scale
    first, second = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    step = 0
    for epoch in range(max(epochs, min(300, 60_000 // max(1, len(own) // batch * 20 + 1)))):
        for k in range(0, len(own), batch):
            rows = own[(k + np.arange(min(batch, len(own)))) % len(own)]
            h = np.tanh(z[rows] @ p[0] + p[1])
            g = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - y[rows]) / len(rows)
            back = np.outer(g, p[2]) * (1 - h * h)
            grads = [z[rows].T @ back + decay * p[0], back.sum(0), h.T @ g + decay * p[2], np.array([g.sum()])]
            step += 1
            for i, gi in enumerate(grads):
                first[i] += 0.1 * (gi - first[i])
                second[i] += 0.001 * (gi * gi - second[i])
                p[i] = p[i] - rate * first[i] / (1 - 0.9**step) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]))
    if len(held):
        logits = net.logits(x[held])
        loss = lambda t: np.mean(np.logaddexp(0, -np.where(y[held] > 0, 1, -1) * logits / t))
        net.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return net


def labelled_sample(labels: DataFrame, column: str, folds: int, held_out: int, most: int) -> DataFrame:
    """``(id, y)`` of at most ``most`` labelled documents outside the held-out fold, chosen by a hash of their ids.

    Null labels and ids go; where rows of a document disagree, the mean decides.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(column).cast("double").alias("y")).where(f"id IS NOT NULL AND y IS NOT NULL AND NOT ({fold('id', folds)} = {held_out})")
    return rows.groupBy("id").agg((F.avg("y") >= 0.5).cast("int").alias("y")).orderBy(F.xxhash64("id"), "id").limit(most)


def fold(column: str, folds: int) -> str:
    return f"crc32(CAST({column} AS STRING)) % {folds}"


def collected(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """Rows ``(text, y)`` of the sample; it is bounded, so it is broadcast and texts stay where they are."""
    return docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(sample), "id").select("id", "text", "y")


def fit(docs: DataFrame, labels: DataFrame, most: int = 20_000, folds: int = 3, held_out: int = 1) -> tuple[np.ndarray, Network]:
    """Word vectors of all of ``docs``, and a network fitted on at most ``most`` labelled rows outside the held-out fold.

    Whole texts count, in blocks of bytes, however long they are; null texts are empty.  Rows of a repeated doc_id all
    enter with its label; rows without an id give words, but have no label.  Without labels, or labels of one kind,
    the network gives every text the smoothed share of ones (0.5 for empty tables).  Columns but doc_id and text, and
    doc_id and the labels' column, are not read.
    """
    vectors = word_vectors(docs)

    def run(batches):
        for b in batches:
            x = pooled([(t or "").encode() for t in b.column(1).to_pylist()], vectors)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "y", "x"])

    sample = collected(docs, labelled_sample(labels, "quality", folds, held_out, most))
    rows = sorted(common.mapped(sample, run, "id long, y int, x binary").collect())
    x = np.array([np.frombuffer(r["x"], np.float32) for r in rows]).reshape(len(rows), -1) if rows else np.zeros((0, width(vectors)))
    return vectors, train(x, np.array([r["y"] for r in rows]))


def score(docs: DataFrame, vectors: np.ndarray, net: Network) -> DataFrame:
    """``docs`` with ``score`` (chance of quality 1) and ``predicted``; columns of these names are replaced.

    Null and empty texts are scored as texts without tokens, texts of any length whole, in blocks of bytes.  Repeated
    rows are scored each, alike; other columns, null ids too, pass through; an empty table gives an empty result.
    """
    docs = docs.drop("score", "predicted")
    at, names = docs.columns.index("text"), [*docs.columns, "score", "predicted"]
    held = docs.sparkSession.sparkContext.broadcast((vectors, net))

    def run(batches):
        vectors, net = held.value
        for b in batches:
            p = net.score(pooled([(t or "").encode() for t in b.column(at).to_pylist()], vectors))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=names)

    return common.mapped(docs, run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def accepted(docs: DataFrame, vectors: np.ndarray, net: Network) -> DataFrame:
    """Rows of ``docs``, with all their columns and no others, whose chance of quality 1 is 0.5 at least."""
    at, names = docs.columns.index("text"), docs.columns
    held = docs.sparkSession.sparkContext.broadcast((vectors, net))

    def run(batches):
        vectors, net = held.value
        for b in batches:
            p = net.score(pooled([(t or "").encode() for t in b.column(at).to_pylist()], vectors))
            yield pa.RecordBatch.from_arrays(b.filter(pa.array(p >= 0.5)).columns, names=names)

    return common.mapped(docs, run, docs.schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents, scored as ``score`` says by what ``fit`` learns; held_out is false where doc_id is null."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, *fit(docs, common.table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.expr(f"coalesce({fold('doc_id', 3)} = 1, false)").alias("held_out"), "score", "predicted")
