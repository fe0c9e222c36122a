"""Strongly connected components of module graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import checkpoint as cut
from ..plans.session import ship, written
from . import edges as E

BY = E.BY


def components(links: list[tuple[str, str]]) -> dict[str, str]:
    """Smallest member of the strongly connected component of each node: two passes, forward and backward, no recursion."""
    after, before = {}, {}
    for a, b in links:
        after.setdefault(a, []).append(b)
        before.setdefault(b, []).append(a)
    finished, seen = [], set()
    for start in sorted({*after, *before}):
        stack = [] if start in seen else [(start, iter(after.get(start, ())))]
        seen.add(start)
        while stack:
            node, rest = stack[-1]
            step = next((x for x in rest if x not in seen), None)
            if step is None:
                finished.append(node)
                stack.pop()
            else:
                seen.add(step)
                stack.append((step, iter(after.get(step, ()))))
    root = {}
    for start in reversed(finished):
        if start in root:
            continue
        own, queue = [], [start]
        root[start] = start
        while queue:
            own.append(node := queue.pop())
            for x in before.get(node, ()):
                if x not in root:
                    root[x] = start
                    queue.append(x)
        least = min(own)
        root.update(dict.fromkeys(own, least))
    return root


def _local(pairs: DataFrame) -> DataFrame:
    def run(pdf):
        root = components(list(zip(pdf["from"], pdf["to"])))
        return type(pdf)({BY: pdf[BY].iloc[0], "module": list(root), "component": list(root.values())})

    ship(pairs.sparkSession)
    return pairs.groupBy(BY).applyInPandas(run, f"{BY} string, module string, component string")


def _spread(pairs: DataFrame, source: str, target: str) -> DataFrame:
    """``(snapshot_id, module, label)``: the smallest node that reaches each node along the pairs, itself included.

    What reaches a node's label reaches the node, too: after each step every node also takes its label's label, so that
    labels cross long paths by doubling.
    """
    nodes = pairs.select(BY, F.explode(F.array("from", "to")).alias("module")).distinct()
    labels, state = nodes.withColumn("label", F.col("module")), None
    while True:
        sent = pairs.select(BY, "from", "to").join(labels.withColumnRenamed("module", source), [BY, source]).select(BY, F.col(target).alias("module"), "label")
        near = written(labels.unionByName(sent).groupBy(BY, "module").agg(F.min("label").alias("label")), "near")
        beyond = near.select(BY, F.col("module").alias("at"), F.col("label").alias("further"))
        labels = written(near.withColumnRenamed("label", "at").join(beyond, [BY, "at"]).select(BY, "module", F.least("at", "further").alias("label")), "labels")
        now = labels.agg(F.count("*"), F.expr("bit_xor(xxhash64(*))")).first()
        if now == state:
            return labels
        state = now


def _distributed(pairs: DataFrame) -> DataFrame:
    """The smallest node that reaches a node and the smallest that it reaches are equal only in that node's component.

    A component has both in common, so only links whose ends agree in both stay for the next round; a node without
    such links is alone.  The first node's component is found in each round, and paths fall apart at once.
    Nodes are ordered by hashes: along a path in order of names, labels would move by one node a round.
    """
    mixed = lambda end: F.concat(F.lpad(F.hex(F.xxhash64(end)), 16, "0"), F.col(end)).alias(end)
    found, left = None, cut(pairs.where("from <> to").select(BY, mixed("from"), mixed("to")).distinct())
    while not left.isEmpty():
        same = written(_agreeing(left, _spread(left, "from", "to")), "same")
        back = _spread(same, "to", "from")
        ends = same.select(BY, F.explode(F.array("from", "to")).alias("module"), F.col("label").alias("component")).distinct()
        own = ends.join(back, [BY, "module"]).where("label = component").select(BY, "module", "component")
        found = written(own if found is None else found.unionByName(own), "found")
        left = written(_agreeing(same.withColumnRenamed("label", "c"), back).where("label <> c").select(BY, "from", "to"), "left")
    nodes = pairs.select(BY, F.explode(F.array("from", "to")).alias("module")).distinct()
    if found is None:
        return nodes.withColumn("component", F.col("module"))
    found = found.select(BY, F.expr("substr(module, 17)").alias("module"), F.col("component").alias("c"))
    found = found.join(found.groupBy(BY, "c").agg(F.min("module").alias("component")), [BY, "c"]).drop("c")
    return nodes.join(found, [BY, "module"], "left").withColumn("component", F.coalesce("component", "module"))


def _agreeing(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Links whose ends have the same label, with it."""
    a, b = (labels.select(BY, F.col("module").alias(end), F.col("label").alias(name)) for end, name in (("from", "label"), ("to", "other")))
    return links.join(a, [BY, "from"]).join(b, [BY, "to"]).where("label = other").drop("other")


def strong_components(pairs: DataFrame, local: int = 200_000) -> DataFrame:
    """``(snapshot_id, module, component)`` of every end of ``pairs(snapshot_id, from, to)``; component: its smallest module.

    Graphs of up to ``local`` links are solved whole, each in a task; larger ones by label propagation over tables.
    """
    pairs = cut(pairs.select(F.col(BY).cast("string").alias(BY), "from", "to").where("from IS NOT NULL AND to IS NOT NULL").distinct())
    most = pairs.groupBy(BY).count().agg(F.max("count")).first()[0] or 0
    return _local(pairs) if most <= local else _distributed(pairs)


def cycles(edges: DataFrame, modules: DataFrame | None = None, local: int = 200_000) -> DataFrame:
    """Components of more than one module: id (members joined by NUL), modules, edgeIds, provenance.

    Edges out of undeclared modules are ignored if ``modules`` is given; edges into them count.
    """
    used = edges if modules is None else edges.join(modules.select(BY, F.col("id").alias("from")), [BY, "from"], "left_semi")
    member = strong_components(used, local)
    groups = member.groupBy(BY, "component").agg(F.array_sort(F.collect_set("module")).alias("modules")).where("size(modules) > 1")
    a = member.select(BY, F.col("module").alias("from"), "component")
    b = member.select(BY, F.col("module").alias("to"), "component")
    inner = edges.join(a, [BY, "from"]).join(b, [BY, "to", "component"]).groupBy(BY, "component").agg(F.array_sort(F.collect_set("id")).alias("edgeIds"))
    proof = F.transform("edgeIds", lambda i: E.evidence("module-edge", i))
    return groups.join(inner, [BY, "component"], "left").select(BY, F.array_join("modules", "\0").alias("id"), "modules", "edgeIds", E.provenance("derived", "tarjan-scc", evidence=proof, derived=F.col("edgeIds")).alias("provenance"))
