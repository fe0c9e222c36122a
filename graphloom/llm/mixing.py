"""Mixing sources to target weights with a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: At most so many times may a document be used.
MOST_TIMES = 3
#: Tables of so many sources at most are broadcast; larger ones are shuffled.
FEW = 100_000


def few(sources: DataFrame, n: int) -> DataFrame:
    return F.broadcast(sources) if n <= FEW else sources


def targets(sizes: list[int], weights: list[float], total: float | None = None, most: float = MOST_TIMES) -> list[float]:
    """Share ``total`` (100 % of all sizes) by weight; nobody gets over ``most`` times its size, others get the excess."""
    total = float(sum(sizes) if total is None else total)
    out, free = [0.0] * len(sizes), [i for i in range(len(sizes))]
    while free:
        left, share = total - sum(out), sum(weights[i] for i in free)
        want = {i: left * weights[i] / share if share else 0.0 for i in free}
        over = [i for i in free if want[i] > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = want[i]
            break
        for i in over:
            out[i] = float(most * sizes[i])
        free = [i for i in free if i not in set(over)]
    return out


def radical_inverse(n: np.ndarray) -> np.ndarray:
    """Van der Corput points in base 2: the bits of n mirrored behind the binary point."""
    n, x, scale = n.astype(np.uint64), np.zeros(len(n)), 0.5
    while n.any():
        x += (n & np.uint64(1)) * scale
        n, scale = n >> np.uint64(1), scale / 2
    return x


def offsets(rows: DataFrame, by: list[str], parts: str, order: list[str], size: str) -> DataFrame:
    """Add ``start``: the sum of ``size`` over the rows before, within each group of ``by``, ordered by ``order``.

    ``order[0]`` must be a hash spread evenly over all longs.  Each group is cut into ``parts`` (a column) ranges of
    it, whose sums come first, so a group of any size is never sorted in one task.
    """
    part = F.floor((F.col(order[0]).cast("double") / 2.0**64 + 0.5) * F.col(parts)).cast("long")
    dealt = rows.withColumn("__part", part)
    before = F.sum("__sum").over(Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    sums = dealt.groupBy(*by, "__part").agg(F.sum(size).alias("__sum")).select(*by, "__part", F.coalesce(before, F.lit(0)).alias("__before"))
    own = F.sum(size).over(Window.partitionBy(*by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return dealt.join(sums, [*by, "__part"]).withColumn("start", F.col("__before") + F.coalesce(own, F.lit(0))).drop("__part", "__before")


def schedule(spark: SparkSession, plan: list[dict], slots: int, block: int) -> DataFrame:
    """``(slot, source_no, rank, pass, block, words)``: which block of which source each slot of the mix takes.

    Point n of the van der Corput sequence falls into the source whose share of the cumulative targets holds it; the
    slots of a source are ranked (by chunks of slots, then within each), and its rank-th block is due, around its
    shuffled blocks again and again.  A source that misses a few words after the last slot gets its last blocks at
    the end; one that has had its target leaves the slot empty (the row goes).
    """
    edges = np.cumsum([p["target"] for p in plan])
    edges = edges / edges[-1] if len(edges) and edges[-1] else edges
    spread = 4096

    def points(batches):
        for b in batches:
            n = np.asarray(b.column(0))
            s = np.minimum(np.searchsorted(edges, radical_inverse(n), side="right"), len(edges) - 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s.astype(np.int32)), pa.array(n // spread)], names=["slot", "source_no", "chunk"])

    drawn = common.mapped(spark.range(slots if len(plan) else 0), points, "slot long, source_no int, chunk long")
    counts = drawn.groupBy("source_no", "chunk").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("before", F.coalesce(before, F.lit(0)))
    ranked = drawn.join(counts, ["source_no", "chunk"]).withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("source_no", "chunk").orderBy("slot")) - 1)
    needs = spark.createDataFrame([(i, int(p["words"]), int(p["size"]), _ranks(p["words"], p["size"], block)) for i, p in enumerate(plan)], "source_no int, wanted long, size long, due long")
    had = needs.join(counts.groupBy("source_no").agg(F.sum("n").alias("had")), "source_no", "left").withColumn("had", F.coalesce("had", F.lit(0)))
    late = had.where("had < due").select("source_no", F.explode(F.sequence("had", F.col("due") - 1)).alias("rank")).select(F.lit(None).cast("long").alias("slot"), "source_no", "rank")
    all_ranks = ranked.select("slot", "source_no", "rank").unionByName(late).join(few(needs, len(plan)), "source_no").where("rank < due")
    blocks = F.expr(f"(size + {block} - 1) div {block}")
    out = all_ranks.withColumn("pass", F.expr(f"rank div ((size + {block} - 1) div {block})")).withColumn("block", F.col("rank") % blocks)
    words = F.least(F.lit(block), F.col("size") - F.col("block") * block, F.col("wanted") - F.col("pass") * F.col("size") - F.col("block") * block)
    return out.withColumn("words", words.cast("long")).select("slot", "source_no", "rank", "pass", "block", "words")


def _ranks(words: int, size: int, block: int) -> int:
    """Slots that ``words`` of a source of ``size`` words take, each pass ending in a shorter block."""
    return (words // size) * -(-size // block) + -(-(words % size) // block) if size else 0


def places(docs: DataFrame, by: list[str], seed: int = 17) -> list:
    """Two hashes of a row over the columns ``by``: the first is its place in the shuffled order, both name it."""
    own = [F.to_json(F.struct(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema if f.name in by]
    nulls = F.concat(*[F.when(c.isNull(), "0").otherwise("1") for c in own])  # the hash passes over nulls
    return [F.xxhash64(*own, nulls, F.lit(seed)), F.xxhash64(F.lit(seed), nulls, *own)]


def mix(docs: DataFrame, weights: list[float] | None = None, slots: int = 65_536, most_block: int = 4096, by: tuple[str, ...] = ("doc_id", "source", "text")) -> tuple[DataFrame, DataFrame]:
    """``(documents, schedule)``: ``(h, g, doc_id, source, size, source_size, target, taken)`` for every row, and the slots.

    Sizes are counts of ``[^\\x20\\x09-\\x0D]+`` (null text: 0).  Sources in order of code points, null last, have the
    weights in turn (1, 2, 3).  ``taken`` counts the words the mix takes of a document, repeats included, and is at
    most 3 times its size; a source takes its target to the word (rounded down).  Documents are shuffled by a hash of
    the columns ``by``, so reruns agree, in whatever order the rows come; repeated rows are mixed like different ones.
    Empty texts have size and taken 0, texts of any length are counted whole; an empty table gives an empty result;
    other columns are ignored here.
    The list of sources (name, size) is held on the driver: it grows with the number of sources, not of documents.  A
    block has about 1/65,536 of all words, 1 at least and 4,096 at most; for larger inputs there are more slots.
    """
    spark, weights = docs.sparkSession, weights or [1, 2, 3]
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    h, g = places(docs, list(by))
    rows = common.checkpoint(docs.select(h.alias("h"), g.alias("g"), "doc_id", F.col("source").cast("string").alias("source"), words.alias("size")))
    found = sorted(((r[0], int(r[1] or 0), r[2]) for r in rows.groupBy("source").agg(F.sum("size"), F.count("*")).collect()), key=lambda x: (x[0] is None, x[0] or ""))
    own = targets([x[1] for x in found], [weights[i % len(weights)] for i in range(len(found))])
    plan = [{"source": s, "size": n, "rows": k, "target": t, "words": min(int(t + 1e-6), MOST_TIMES * n)} for (s, n, k), t in zip(found, own)]
    total = sum(x[1] for x in found)
    block = min(most_block, max(1, total // slots))
    due = schedule(spark, plan, -(-total // block), block)
    info = spark.createDataFrame([(i, p["source"], p["size"], float(p["target"]), min(65_536, -(-p["rows"] // 2000))) for i, p in enumerate(plan)], "source_no int, __source string, source_size long, target double, parts long")
    named = rows.join(few(info, len(plan)), F.expr("source <=> __source")).drop("__source")
    placed = common.checkpoint(offsets(named.where("size > 0"), ["source_no"], "parts", ["h", "g", "size"], "size"))
    pieces = placed.select("source_no", "start", "size", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")).alias("block"))
    uses = due.groupBy("source_no", "block", "words").agg(F.count("*").alias("times"))
    begin, end = F.greatest("start", F.col("block") * block), F.least(F.col("start") + F.col("size"), F.col("block") * block + F.col("words"))
    taken = pieces.join(uses, ["source_no", "block"]).groupBy("source_no", "start").agg(F.sum(F.greatest(end - begin, F.lit(0)) * F.col("times")).alias("taken"))
    used = placed.join(taken, ["source_no", "start"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
    empty = named.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    out = ["h", "g", "doc_id", "source", "size", "source_size", "target", "taken"]
    return used.select(*out).unionByName(empty.select(*out)), due


def apply_mix(docs: DataFrame, chunk: int = 1000) -> DataFrame:
    """``docs`` as mixed, with its own columns: each row as many times as the mix takes it, to the nearest whole time.

    Only the last document that a source takes in its last pass can be cut by its target; all others are taken whole.
    Rows that are equal in all columns are interchangeable: what is taken of them is summed, each stays the whole part
    of an equal share of it, and the rest are further copies of one, made in chunks of ``chunk`` by many tasks.  So no task
    gathers or orders equal rows, and reruns agree.  Empty texts are never taken; an empty table gives an empty one;
    columns may have any names.
    """
    names = docs.columns
    taken, _ = mix(docs, by=tuple(names))
    times = F.expr("bigint(round(taken / size))")
    h, g, whole, more = common.unused(docs, "__h", "__g", "__times", "__more")
    due = taken.where("size > 0").groupBy("h", "g").agg(F.count("*").alias("n"), F.sum(times).alias("t")).where("t > 0")
    due = common.checkpoint(due.select(F.col("h").alias(h), F.col("g").alias(g), F.expr("t div n").alias(whole), F.expr("t % n").alias(more)))
    rows = docs.withColumns(dict(zip((h, g), places(docs, names))))
    each = rows.join(due.where(F.col(whole) > 0).select(h, g, whole), [h, g])
    each = each.withColumn(whole, F.explode(F.sequence(F.lit(1), F.col(whole)))).select(*names)
    first = rows.join(due.where(F.col(more) > 0).select(h, g, more), [h, g]).groupBy(h, g, more).agg(F.first(F.struct(*[f"`{c}`" for c in names])).alias("row"))
    first = first.select("row", F.col(more).alias("more"), F.explode(F.expr(f"sequence(0, (`{more}` - 1) div {chunk})")).alias("k"))
    first = first.repartition("k", F.xxhash64("k", "more", F.col("row")[names[0]])).select("row", F.explode(F.expr(f"sequence(1, least({chunk}, more - k * {chunk}))")))
    return each.unionByName(first.select("row.*"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, _ = mix(common.table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")
