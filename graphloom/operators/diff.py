"""Keyed differences between two snapshots, and what they say about regressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import paths
from . import rules
from .edges import COUNTERS


def comparable(row: Column, kind: T.StructType, leave_out: Sequence[str] = ()) -> Column:
    """A row as something that can be compared for equality: maps become sorted entries."""
    out = []
    for f in kind.fields:
        if f.name not in leave_out:
            c = row[f.name]
            out.append((F.array_sort(F.map_entries(c)) if isinstance(f.dataType, T.MapType) else c).alias(f.name))
    return F.struct(*out)


def diff_collection(before: DataFrame, after: DataFrame, key: Column | str, after_key: Column | str | None = None, leave_out: Sequence[str] = (), order: str | None = None) -> DataFrame:
    """``(change, key, before, after)``: added, removed and changed rows by key; equal rows are left out.

    Of rows with equal keys the last by ``order`` counts (without it, the greatest).  Rows are equal if all their columns
    are, apart from ``leave_out``; null equals null.  Keys must not be null.  One full outer join on the key: both sides
    are shuffled once, already reduced to a row per key; what is compared is made of the rows where they meet.
    """
    sides, shapes = [], []
    for df, k, name in ((before, key, "before"), (after, key if after_key is None else after_key, "after")):
        kind = T.StructType([f for f in df.schema.fields if f.name != order])
        row, whole = F.struct(*kind.names), not leave_out and not any(isinstance(f.dataType, T.MapType) for f in kind)
        kept = df.select((F.col(k) if isinstance(k, str) else k).alias("key"), row.alias("row"), *([F.col(order).alias("__order")] if order else []))
        rank = [F.col("__order")] if order else []
        if whole:
            last = F.max(F.struct(*rank, "row"))["row"]
        else:
            last = F.max_by("row", F.struct(*rank, comparable(F.col("row"), kind, leave_out)))
        sides.append(kept.groupBy("key").agg(last.alias(name)))
        shapes.append(comparable(F.col(name), kind, leave_out))
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(~shapes[0].eqNullSafe(shapes[1]), "changed")
    return sides[0].join(sides[1], "key", "full_outer").withColumn("change", change).where("change IS NOT NULL").select("change", "key", "before", "after")


def module_keys(modules: DataFrame) -> DataFrame:
    """``(id, stable)``: the key of a module that outlives its name; of equal ids the last by key counts."""
    return modules.select("id", F.coalesce("stableId", "root", "id").alias("stable")).groupBy("id").agg(F.max("stable").alias("stable"))


def with_edge_key(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """Edges with ``key``: the stable keys of both ends (an end that is no module keeps its name)."""
    keys = module_keys(modules)
    for end in ("from", "to"):
        edges = edges.join(keys.select(F.col("id").alias(end), F.col("stable").alias(f"__{end}")), end, "left")
    return edges.withColumn("key", paths.joined(F.coalesce("__from", "from"), F.coalesce("__to", "to"))).drop("__from", "__to")


def with_cycle_key(cycles: DataFrame, modules: DataFrame) -> DataFrame:
    """Cycles with ``key``: the stable keys of their members, sorted."""
    members = cycles.select(F.col("id").alias("cycle"), F.explode("modules").alias("id")).join(module_keys(modules), "id", "left")
    keys = members.groupBy("cycle").agg(F.array_join(F.array_sort(F.collect_list(F.coalesce("stable", "id"))), "\0").alias("key"))
    return cycles.join(keys.withColumnRenamed("cycle", "id"), "id").select(*cycles.columns, "key")


def metric_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(metric, before, after, delta)`` of the eleven counters; a missing one counts as 0."""

    def tall(df: DataFrame, name: str) -> DataFrame:
        stack = ", ".join(f"'{c}', coalesce({c}, 0)" for c in COUNTERS)
        return df.select(F.expr(f"stack({len(COUNTERS)}, {stack}) AS (metric, {name})"))

    return tall(before, "before").join(tall(after, "after"), "metric").withColumn("delta", F.col("after") - F.col("before"))


def comparability(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(reasons array)``: why two snapshots (header rows) can't be compared; empty if they can."""
    texts = {"irVersion": "IR {} != {}", "toolVersion": "tool {} != {}", "configHash": "analysis configuration differs", "compilerOptionsHash": "compiler options differ", "tsconfig": "tsconfig path differs", "sourceRoot": "source root differs"}
    a, b = before.select(F.struct(*texts).alias("a")), after.select(F.struct(*texts).alias("b"))
    reasons = []
    for c, text in texts.items():
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        shown = F.concat_ws("", F.lit(text.split("{}")[0]), x, F.lit(" != "), y) if "{}" in text else F.lit(text)
        reasons.append(F.when(~x.eqNullSafe(y), shown))
    return a.join(b, F.lit(True)).select(F.array_compact(F.array(*reasons)).alias("reasons"))  # one row each


def diff_snapshots(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Differences of the seven collections, metric deltas, and the introduced and resolved violations.

    Both are tables of one snapshot each (files, imports, modules, ownership, module_edges, cycles, metrics, findings).
    """
    own = [{k: t.drop("snapshot_id") for k, t in side.items()} for side in (before, after)]
    b, a = own

    def keyed(side: dict, name: str, how) -> DataFrame:
        return how(side[name], side["modules"])

    def stable(name: str, how) -> DataFrame:
        x, y = keyed(b, name, how), keyed(a, name, how)
        return diff_collection(x.withColumnRenamed("key", "__key"), y.withColumnRenamed("key", "__key"), "__key", leave_out=["__key"])

    modules_key = F.coalesce("stableId", "root", "id")
    out = {
        "modules": diff_collection(b["modules"], a["modules"], modules_key, leave_out=["stableId"]),
        "ownership": diff_collection(b["ownership"], a["ownership"], "file"),
        "files": diff_collection(b["files"], a["files"], "path"),
        "imports": diff_collection(b["imports"], a["imports"], "id", leave_out=["resolutionConfidence"]),
        "module_edges": stable("module_edges", with_edge_key),
        "cycles": stable("cycles", with_cycle_key),
        "findings": diff_collection(b["findings"], a["findings"], rules.finding_key()),
        "metrics": metric_deltas(b["metrics"], a["metrics"]),
    }
    out["introduced"] = out["findings"].where("change = 'added' AND after.category = 'violation'").select("key", "after.*")
    out["resolved"] = out["findings"].where("change = 'removed' AND before.category = 'violation'").select("key", "before.*")
    return out


def has_regressions(diff: dict[str, DataFrame]) -> bool:
    """A new cycle, or an introduced violation; looks for one row, no more."""
    return bool(diff["cycles"].where("change = 'added'").take(1)) or bool(diff["introduced"].take(1))
