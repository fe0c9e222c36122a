"""What several operators share: lineage cuts, distributed connected components, and byte-level tokens in numpy."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import checkpoint, shared_folder, ship  # noqa: F401

#: The six characters [\x20\x09-\x0D].
BLANKS = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def mapped(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow``, after this package has been sent to the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of ``df`` has, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below the application's checkpoint folder, and read again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest node reachable, for every node of ``edges``: ``(node long, component_id long)``.

    Alternating large-star and small-star rounds.  A round only takes minima per node (combined map-side) and joins
    them back, so that a node with a third of all links is split by AQE's skew join; nothing reaches the driver but
    a count and a checksum.  Null ends and self-links are ignored; an empty input gives an empty result.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), (F.col(a).isNotNull() & F.col(b).isNotNull()).alias("ok"))
    e = checkpoint(e.where("ok and u <> v").select("u", "v").distinct())
    state = None
    while True:
        now = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == state or not now[0]:
            break
        state = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(least, "u")
        small = pairs.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        e = checkpoint(small.where("u <> v").distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("component_id")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component_id")).distinct())


class Forest:
    """Union-find over 0..n-1 that takes links as arrays; keeps the smallest member of each class as its root."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.root[i], self.root[j]
            differ = a != b
            if not differ.any():
                return
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up


# Byte classes: 0 separates tokens, 1 is in words, 2 is in runs of punctuation.
CLASS = np.full(256, 2, np.uint8)
CLASS[list(BLANKS) + list(range(0x1C, 0x20)) + [0]] = 0
CLASS[[c for c in range(256) if chr(c).isalnum() and c < 128 or c >= 128]] = 1
LOWER = np.arange(256, dtype=np.uint64)
LOWER[65:91] += 32
POWERS = np.random.default_rng(20240229).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit hashes."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


class Tokens:
    """Tokens of a batch of texts: maximal runs of word bytes or of punctuation, with a 64-bit hash of each.

    ``doc`` has each token's text, ``hash`` that of its bytes in lower case (A-Z), ``kind`` 1 for words and 2 for
    punctuation, ``start`` and ``length`` its place in ``bytes``.
    """

    def __init__(self, texts: list[bytes]):
        self.n = len(texts)
        data = b"\0".join([*texts, b""])
        self.bytes = np.frombuffer(data, np.uint8)
        self.ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, self.n))
        if not len(data):
            self.start = self.length = self.doc = np.zeros(0, np.int64)
            self.hash, self.kind, self.low = np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, np.uint64)
            return
        kinds = CLASS[self.bytes]
        start = np.concatenate([[0], np.flatnonzero(kinds[1:] != kinds[:-1]) + 1])
        length = np.diff(np.concatenate([start, [len(data)]]))
        self.low = LOWER[self.bytes]
        place = np.arange(len(data), dtype=np.int64) - np.repeat(start, length)
        sums = np.add.reduceat(self.low * POWERS[place & 63] + (place >> 6).astype(np.uint64), start)
        keep = kinds[start] != 0
        self.start, self.length, self.kind = start[keep], length[keep], kinds[start[keep]]
        self.hash = mixed(sums[keep] + self.length.astype(np.uint64))
        self.doc = np.searchsorted(self.ends, self.start, side="right")

    def prefix(self, k: int) -> np.ndarray:
        """Hash of each token's first k bytes in lower case; 0 where the token is not longer than k."""
        far = np.minimum(self.start, len(self.low) - k) if len(self.low) >= k else np.zeros_like(self.start)
        h = np.full(len(self.start), k, np.uint64)
        for i in range(k if len(self.low) >= k else 0):
            h = h * np.uint64(1099511628211) + self.low[far + i]
        return np.where((self.length > k) & (self.kind == 1), mixed(h), np.uint64(0))


def blocks(texts: list[bytes], most: int = 1_000_000):
    """``(owners, pieces)`` of about ``most`` bytes each: whole texts, and parts of longer ones, cut before a blank.

    owners: the place in ``texts`` of each piece's text.  A word without end is cut at twice the size.
    """
    owners, pieces, total = [], [], 0
    for j, t in enumerate(texts):
        at = 0
        while True:
            end = len(t)
            if end - at > most:
                end = at + most
                while end < min(len(t), at + 2 * most) and t[end] not in BLANKS:
                    end += 1
            if pieces and total + end - at > most:
                yield np.array(owners), pieces
                owners, pieces, total = [], [], 0
            owners.append(j)
            pieces.append(t[at:end])
            total += end - at
            at = end
            if at >= len(t):
                break
    if pieces:
        yield np.array(owners), pieces


def summed(rows: DataFrame, run) -> DataFrame:
    """Add the float32 vectors ``value`` (binary) of equal ``block`` that ``run`` makes of batches: first by task, then by block.

    What a task has made goes to one of the shuffle's partitions as a whole; each adds up as a stream what it is dealt, so
    that a block then meets as many parts as there are partitions, however many tasks there were.
    """

    def numbered(batches):
        task = TaskContext.get().partitionId()
        for b in run(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, task, np.int32))], names=["block", "value", "task"])

    def add(batches):
        total = {}
        for b in batches:
            for block, value in zip(b.column(0).to_pylist(), b.column(1)):
                x = np.frombuffer(value.as_buffer(), np.float32)
                if block in total:
                    total[block] += x
                else:
                    total[block] = x.astype(np.float64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.astype(np.float32).tobytes() for x in total.values()], pa.binary())], names=["block", "value"])

    by_task = mapped(rows, numbered, "block int, value binary, task int").repartition("task").select("block", "value").mapInArrow(add, "block int, value binary")
    return by_task.repartition("block").mapInArrow(add, "block int, value binary")
