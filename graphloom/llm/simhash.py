"""Near-duplicates by word shingles, linked by sharded vantage-point trees: SimHash fingerprints, or exact Jaccard similarity."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)


def fingerprint(text: str | None, words: int = 3, block: int = 4_000_000) -> int:
    """64-bit fingerprint; whole text, in blocks of bytes so that memory stays bounded for very long texts."""
    import xxhash

    data, carry, n = (text or "").encode().lower(), [], 0  # bytes.lower() takes A-Z alone, bytes.split() [\x20\x09-\x0D]
    counts, digest, at = np.zeros((8, 256), np.int64), xxhash.xxh64_digest, 0
    while at < len(data):
        end = at + block
        while end < len(data) and data[end] not in common.BLANKS:
            end += 1
        found = carry + data[at:end].split()
        at = end
        if len(found) < words and (at < len(data) or n):
            carry = found
            continue
        if not found:
            break
        joined, size = b" ".join(found), np.fromiter(map(len, found), np.int64, len(found)) + 1
        ends = np.cumsum(size)
        starts, ends = ends - size, ends - 1
        if len(found) >= words:
            starts, ends = starts[: len(found) - words + 1], ends[words - 1 :]
        else:
            starts, ends = starts[:1], ends[-1:]
        hashes = np.frombuffer(b"".join([digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends.tolist())]), np.uint8).reshape(-1, 8)
        n += len(hashes)
        for k in range(8):
            counts[k] += np.bincount(hashes[:, k], minlength=256)
        carry = found[len(found) - words + 1 :] if words > 1 else []
    return int.from_bytes(np.packbits((counts @ BITS > n / 2).ravel()).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``(doc_id, fp long)``, fp with the fingerprint's bits; null and blank texts have 0."""

    def run(batches):
        for b in batches:
            found = np.array([fingerprint(t, words) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return common.mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, fp long")


class Tree:
    """A vantage-point tree of a given depth over half fingerprints (32 bits), fitted on a sample; its leaves are shards.

    Two fingerprints within ``2r+1`` bits are within ``r`` in one of their halves, so a search of radius r in a tree over
    either half finds all.  A smaller radius crosses fewer boundaries: at 32 bits and r=1 a query follows both
    branches a little over a quarter of the time, at 64 bits and r=3 more than half of the time.
    """

    def __init__(self, sample: np.ndarray, depth: int, seed: int):
        self.depth, n = depth, 2**depth - 1
        rng = np.random.default_rng(seed)
        self.point = rng.integers(0, 2**32, n, dtype=np.uint32)
        self.cut = np.full(n, 15, np.int16)
        held = {0: sample}
        for node in range(n):
            own = held.pop(node, sample[:0])
            if len(own) > 3:
                self.point[node] = own[rng.integers(len(own))]
                d = np.bitwise_count(own ^ self.point[node])
                self.cut[node] = np.median(d)
                held[2 * node + 1], held[2 * node + 2] = own[d <= self.cut[node]], own[d > self.cut[node]]

    def leaves(self, x: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, shards, and whether the shard is the row's own; of other shards within reach those before its own."""
        row, node, own = np.arange(len(x)), np.zeros(len(x), np.int64), np.ones(len(x), bool)
        for _ in range(self.depth):
            d = np.bitwise_count(x[row] ^ self.point[node]).astype(np.int16)
            near = d <= self.cut[node]
            # A row of the far side also looks at the near side if its ball reaches it; the reverse isn't needed.
            also = ~near & (d - r <= self.cut[node])
            other = near & ~own & (d + r > self.cut[node])
            row = np.concatenate([row, row[also], row[other]])
            node, own = np.concatenate([2 * node + 1 + ~near, 2 * node[also] + 1, 2 * node[other] + 2]), np.concatenate([own, np.zeros(also.sum() + other.sum(), bool)])
        return row, node - (2**self.depth - 1), own


def near(full: np.ndarray, half: np.ndarray, own: np.ndarray, r: int, bits: int, forest: common.Forest, rng, leaf: int = 256, also=None) -> None:
    """Link all pairs of one shard within ``bits`` bits of which one is its own: a vantage-point search in memory.

    ``also`` tells of arrays of such pairs which ones count.

    Goes down the tree with members and queries at once.  Where half fingerprints no longer divide the members, whole
    ones do with the whole radius; where neither does, blocks are compared.
    """
    stack = [(np.flatnonzero(own), np.arange(len(full)), 0)]
    while stack:
        members, queries, failed = stack.pop()
        if not len(members) or not len(queries):
            continue
        if len(members) <= leaf or failed > 5:
            for i in range(0, len(queries), 1024):
                for j in range(0, len(members), 4096):
                    q, m = queries[i : i + 1024], members[j : j + 4096]
                    a, b = np.nonzero(np.bitwise_count(full[q][:, None] ^ full[m][None, :]) <= bits)
                    a, b = q[a], m[b]
                    if also:
                        keep = also(a, b)
                        a, b = a[keep], b[keep]
                    forest.link(a, b)
            continue
        space, radius = (half, r) if failed < 3 else (full, bits)
        point = space[members[rng.integers(len(members))]]
        dm, dq = np.bitwise_count(space[members] ^ point).astype(np.int16), np.bitwise_count(space[queries] ^ point).astype(np.int16)
        cut = int(np.median(dm))
        close = dm <= cut
        if close.all():
            cut -= 1
            close = dm <= cut
        worse = failed + 1 if max(close.sum(), (~close).sum()) > 0.9 * len(members) else failed if failed >= 3 else 0
        stack += [(members[close], queries[dq <= cut + radius], worse), (members[~close], queries[dq > cut - radius], worse)]


def dealt_shards(rows: DataFrame, node: str, stars, most: int, schema: str) -> DataFrame:
    """What ``stars`` returns for each shard ``(tree, shard)`` of ``rows``; shards of over ``most`` rows come as pairs of blocks.

    Blocks go by a hash of ``node``, so that equal or close fingerprints, of which no tree can divide a crowd, are spread
    over many tasks; each task links all pairs within two blocks.
    """
    rows = common.checkpoint(rows)
    large = rows.groupBy("tree", "shard").count().where(F.col("count") > most).select("tree", "shard", F.ceil(F.col("count") / most).cast("int").alias("blocks"))
    dealt = rows.join(large, ["tree", "shard"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64(node), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other"))
    return dealt.drop("blocks", "mine", "other").groupBy("tree", "shard", "i", "j").applyInPandas(stars, schema)


def link_fingerprints(fps: DataFrame, bits: int = 3, leaf_rows: int = 20_000, sample_rows: int = 200_000, max_depth: int = 16, most: int = 200_000) -> DataFrame:
    """Links ``(a, b)`` between representatives (column ``rep``) of distinct fingerprints (``fp``).

    Chained links connect exactly the fingerprints that differ in at most ``bits`` bits: each shard returns a spanning
    star of every class it found, not the pairs of a class, so a group of copies costs as many rows as members.
    The trees are fitted on a sample of at most ``sample_rows`` fingerprints, taken by hash; all rows are indexed.
    Shards of more than ``most`` rows are dealt as pairs of blocks.
    """
    r, n = bits // 2, fps.count()
    depth = min(max_depth, max(0, int(np.ceil(np.log2(max(1, n) / leaf_rows)))))
    spread = max(1, -(-n // max(1, min(sample_rows, 64 * 2**depth))))
    sample = np.array([x[0] for x in fps.where(F.expr(f"pmod(xxhash64(fp, 'sample'), {spread}) = 0")).select("fp").limit(sample_rows).collect()] if depth else [], np.int64).view(np.uint64)
    trees = [Tree((sample >> np.uint64(32 * k)).astype(np.uint32), depth, 7 + k) for k in (0, 1)]

    def shards(batches):
        for b in batches:
            x = np.asarray(b.column(0)).view(np.uint64)
            for k, tree in enumerate(trees):
                row, leaf, own = tree.leaves((x >> np.uint64(32 * k)).astype(np.uint32), r)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), k, np.int32)), pa.array(leaf.astype(np.int32)), b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(own)], names=["tree", "shard", "fp", "rep", "own"])

    def stars(pdf):
        k, full, own, rep = int(pdf["tree"].iloc[0]), pdf["fp"].to_numpy().view(np.uint64), pdf["own"].to_numpy(), pdf["rep"].to_numpy()
        forest = common.Forest(len(full))
        near(full, (full >> np.uint64(32 * k)).astype(np.uint32), own, r, bits, forest, np.random.default_rng(3))
        child = np.flatnonzero(forest.root != np.arange(len(full)))
        return type(pdf)({"a": rep[child], "b": rep[forest.root[child]]})

    dealt = common.mapped(fps.select("fp", "rep"), shards, "tree int, shard int, fp long, rep long, own boolean")
    return dealt_shards(dealt, "rep", stars, most, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 3) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs(doc_id, text, ...)``.

    Fingerprints of at most ``bits`` differing bits link, chains included; component_id is the smallest doc_id of the
    class.  Null, empty and blank texts have fingerprint zero and link like any other.  A row with a null doc_id is
    kept and takes its fingerprint's class (null if no row of the class has an id); repeated rows stay repeated, and rows
    of one id with different texts each have their own fingerprint's class.  Texts of any length are read whole, in
    blocks of bytes.  Other columns, whatever their names, are not read; an empty table gives an empty result.
    """
    own = common.checkpoint(fingerprints(docs, words))
    fps = common.checkpoint(own.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    groups = common.connected_components(link_fingerprints(fps, bits))
    classes = fps.join(groups, fps.rep == groups.node, "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"))
    return own.join(classes, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of runs of ``words`` words; fewer words are one run, null and blank texts have none."""
    import xxhash

    found, digest = (text or "").encode().lower().split(), xxhash.xxh64_digest
    runs = [b" ".join(found[k : k + words]) for k in range(max(1, len(found) - words + 1))] if found else []
    return np.unique(np.frombuffer(b"".join([digest(x, 42) for x in runs]), np.uint64))


def plan_parts(similarity: float, miss: float = 1e-6) -> tuple[int, int]:
    """``(fingerprints, differ)``: a pair of that similarity has no equal half fingerprint, or more than ``differ`` other bits, with a chance of ``miss`` each at most.

    A half has the bytes of 4 smallest hashes, so it is equal with a chance of at least similarity^4; of the 8 other bits
    a fingerprint, each differs with a chance of (1-similarity)/2.
    """
    parts = max(1, math.ceil(math.log(miss) / math.log1p(-(similarity**4)) / 2)) if 0 < similarity < 1 else 1
    n, p = 8 * parts, (1 - similarity) / 2
    tail, k = 1.0, -1
    while tail > miss / 10 and k < n:
        k += 1
        tail -= math.comb(n, k) * p**k * (1 - p) ** (n - k)
    return parts, k


def sketch(own: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """``parts`` fingerprints (64 bits: bytes of the smallest shingle under 8 orders each) and as many times 8 other bits of them."""
    rng = np.random.default_rng(17)
    salt, factor = rng.integers(0, 2**63, (2, 8 * parts, 1), dtype=np.uint64)
    least = np.full(8 * parts, 2**64 - 1, np.uint64)
    for k in range(0, len(own), 8192):
        np.minimum(least, ((own[k : k + 8192] ^ salt) * (factor | np.uint64(1))).min(1), out=least)
    least = common.mixed(least)
    return (least & np.uint64(255)).astype(np.uint8).view(np.uint64), np.packbits(((least >> np.uint64(8)) & np.uint64(1)).astype(np.uint8))


def similar(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Smallest member of each set's class, where pairs of at least that Jaccard similarity link: a search that meets linked sets no more."""
    size = np.array([len(x) for x in sets])
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    start = np.cumsum(size) - size
    root, mark = np.arange(len(sets)), np.zeros(len(code), bool)
    left = np.arange(len(sets))
    flat = code
    queue: list[int] = []
    while len(left):
        if not queue:
            queue, flat, left = [int(left[0])], flat[size[left[0]] :], left[1:]
            continue
        x = queue.pop()
        own = code[start[x] : start[x] + size[x]]
        mark[own] = True
        shared = np.add.reduceat(mark[flat].astype(np.int64), np.cumsum(size[left]) - size[left])
        mark[own] = False
        close = shared / (size[x] + size[left] - shared) >= similarity
        if close.any():
            root[left[close]] = root[x]
            queue += left[close].tolist()
            flat, left = flat[np.repeat(~close, size[left])], left[~close]
    return root


def similar_texts(docs: DataFrame, words: int = 5, similarity: float = 0.8, block: int = 1024, leaf_rows: int = 20_000, sample_rows: int = 200_000, max_depth: int = 16, most: int = 200_000) -> DataFrame:
    """``(a, b, doc_id, class long)`` of each different ``(doc_id, text)`` of ``docs``; a and b are two hashes of it (``row_key``).

    Texts link if the Jaccard similarity of their sets of ``words`` words is at least ``similarity``, chains included.
    Null, empty and blank texts are copies of each other.  Rows are told apart by id and text, so texts that share an
    id, or have none, each have a class of their own.

    Every text has several fingerprints, each of other parts of its shingles; halves of them are searched by
    vantage-point trees within one bit, so that a pair at the threshold is missed with a chance of 1e-6 (``plan_parts``).
    What meets is a candidate; classes of candidates are compared by their whole shingle sets.  Classes of more
    than ``block`` texts are dealt as pairs of blocks, shards of more than ``most`` too; nothing is dropped.
    """
    parts, differ = plan_parts(similarity)
    a, b = row_key()
    spread = docs.select(a.alias("a"), b.alias("b"), F.col("doc_id").cast("long").alias("doc_id"), "text")

    def keyed(whole):
        import xxhash

        def run(batches):
            for b in batches:
                keys, out, more = [], [], []
                for text in b.column(3).to_pylist():
                    own = shingles(text, words)
                    keys.append(xxhash.xxh3_128_digest(own.tobytes()))
                    x, c = (own, None) if whole or not len(own) else sketch(own, parts)
                    out.append(x.tobytes())
                    more.append(c is not None and c.tobytes() or b"")
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(keys, pa.binary()), pa.array(out, pa.binary()), pa.array(more, pa.binary())], names=["a", "b", "doc_id", "key", "data", "bits"])

        return run

    schema = "a long, b long, doc_id long, key binary, data binary, bits binary"
    own = common.checkpoint(common.mapped(spread, keyed(False), schema))
    nodes = common.checkpoint(own.groupBy("key").agg(F.first("data").alias("data"), F.first("bits").alias("bits"), F.min(F.struct("a", "b")).alias("of")))
    nodes = nodes.withColumn("no", F.monotonically_increasing_id())  # places in the checkpoint: they stay
    full = nodes.where("length(data) > 0")
    n = full.count()
    depth = min(max_depth, max(0, int(np.ceil(np.log2(max(1, n) / leaf_rows)))))
    every = max(1, -(-n // max(1, min(sample_rows, 64 * 2**depth))))
    sample = [bytes(x[0]) for x in full.where(F.expr(f"pmod(xxhash64(key, 'sample'), {every}) = 0")).select("data").limit(sample_rows).collect()] if depth else []
    sample = np.frombuffer(b"".join(sample), np.uint32).reshape(-1, 2 * parts)
    trees = [Tree(sample[:, k], depth, 7 + k) for k in range(2 * parts)]

    def shards(batches):
        for b in batches:
            if not b.num_rows:
                continue
            halves = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(b.num_rows, -1)
            for k, tree in enumerate(trees):
                row, leaf, mine = tree.leaves(halves[:, k], 1)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), k, np.int32)), pa.array(leaf.astype(np.int32)), pa.array(halves[row, k].astype(np.int64)), b.column(0).take(at), b.column(2).take(at), pa.array(mine)], names=["tree", "shard", "half", "no", "bits", "own"])

    def stars(pdf):
        half, no = pdf["half"].to_numpy().astype(np.uint32), pdf["no"].to_numpy()
        bits = np.frombuffer(b"".join(x.ljust(-(-parts // 8) * 8, b"\0") for x in pdf["bits"]), np.uint64).reshape(len(pdf), -1)
        forest = common.Forest(len(pdf))
        near(half, half, pdf["own"].to_numpy(), 1, 1, forest, np.random.default_rng(3), also=lambda a, b: np.bitwise_count(bits[a] ^ bits[b]).sum(1) <= differ)
        child = np.flatnonzero(forest.root != np.arange(len(pdf)))
        return type(pdf)({"a": no[child], "b": no[forest.root[child]]})

    dealt = common.mapped(full.select("no", "data", "bits"), shards, "tree int, shard int, half long, no long, bits binary, own boolean")
    met = common.connected_components(dealt_shards(dealt, "no", stars, most, "a long, b long"))
    met = common.checkpoint(met.select(F.col("node").alias("no"), F.col("component_id").alias("c")))
    many = met.groupBy("c").count().select("c", F.ceil(F.col("count") / block).cast("int").alias("parts"))
    wanted = full.select("no", "of.a", "of.b").join(met, "no").join(many, "c")
    sets = common.mapped(spread.join(wanted.select("a", "b"), ["a", "b"], "left_semi"), keyed(True), schema)
    sets = sets.select("a", "b", "data").dropDuplicates(["a", "b"]).join(wanted, ["a", "b"])
    mine = F.pmod(F.xxhash64("no"), "parts").cast("int")
    sets = sets.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    sets = sets.select("c", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "no", "data")

    def confirm(pdf):
        no, root = pdf["no"].to_numpy(), similar([np.frombuffer(x, np.uint64) for x in pdf["data"]], similarity)
        child = np.flatnonzero(root != np.arange(len(root)))
        return type(pdf)({"a": no[child], "b": no[root[child]]})

    groups = common.connected_components(sets.groupBy("c", "i", "j").applyInPandas(confirm, "a long, b long"))
    groups = nodes.select("key", "no").join(groups, F.col("no") == F.col("node"), "left").select("key", F.coalesce("component_id", "no").alias("class"))
    return own.select("a", "b", "doc_id", "key").dropDuplicates(["a", "b"]).join(groups, "key").select("a", "b", "doc_id", "class")


def row_key() -> tuple:
    """Two 64-bit hashes of a row's id and text; a null text counts as empty."""
    text, doc_id = F.coalesce("text", F.lit("")), F.col("doc_id").cast("long")
    return F.xxhash64(text, doc_id, doc_id.isNull()), F.xxhash64(F.lit("row"), doc_id, text, doc_id.isNull())


def similar_documents(docs: DataFrame, **how) -> DataFrame:
    """``(doc_id, component_id)`` of each different (doc_id, text): the smallest doc_id of its class, null if it has none."""
    found = common.checkpoint(similar_texts(docs, **how))
    least = found.groupBy("class").agg(F.min("doc_id").alias("component_id"))
    return found.join(least, "class").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """Of each class of ``similar_texts`` one row of ``docs``, with all its columns: that of smallest id, null ids last.

    Where an id has several texts of the class, the text of smallest hash stays; of rows equal in id and text the one of
    smallest hash over all columns.  Texts of other classes stay, whatever their ids.  Null and empty texts are one
    class.  An empty table gives an empty one; columns may have any names.
    """
    found = common.checkpoint(similar_texts(docs, **how))
    kept = found.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "a", "b")).alias("x")).select("x.a", "x.b")
    names = common.unused(docs, "a", "b")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    hashable = [F.to_json(F.struct(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema]
    a, b = row_key()
    rows = docs.withColumns(dict(zip(names, (a, b)))).groupBy(*names).agg(F.min_by(whole, F.xxhash64(*hashable)).alias("row"))
    return rows.join(kept.toDF(*names), names, "left_semi").select("row.*")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))
