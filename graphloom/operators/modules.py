"""Modules inferred from paths and configuration."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..plans.session import ship
from . import edges as E

BY = E.BY


def _root_length(root: str) -> int:
    return 0 if root == "." else len(root) + 1


def _join(root: Column, name: Column) -> Column:
    return F.when(root == ".", name).otherwise(F.concat(root, F.lit("/"), name))


def _base(root: Column, project: str) -> Column:
    return F.when(root == ".", F.lit(project)).otherwise(F.element_at(F.split(root, "/"), -1))


def candidate_roots(files: DataFrame, config: dict, source_root: str, roots: list[str], project: str) -> DataFrame:
    """Files with their candidate module: ``base_id, root, declared, public`` (null, or the declared entrypoints).

    By precedence: the declared module of the longest root that holds the file; the child directory of the longest
    configured root that does; the child of the source root; outside of it, the first directory below the project.
    A child that looks like a source file stands for the directory itself.
    """
    path = F.col("path")
    declared = sorted(((id, posixpath.normpath(m["root"]), m.get("publicEntrypoints")) for id, m in config.get("modules", {}).items()), key=lambda m: (-_root_length(m[1]), m[0].casefold(), m[0]))
    explicit = F.lit(None).cast("struct<base_id:string,root:string,declared:boolean,public:array<string>>")
    for id, root, public in reversed(declared):
        own = F.struct(F.lit(id).alias("base_id"), F.lit(root).alias("root"), F.lit(True).alias("declared"), (F.lit(None) if public is None else F.array(*map(F.lit, public))).cast("array<string>").alias("public"))
        explicit = F.when(paths.within(F.lit(root), path), own).otherwise(explicit)
    selected = F.lit(None).cast("string")
    for root in sorted(roots, key=_root_length):
        selected = F.when(paths.within(F.lit(root), path), F.lit(root)).otherwise(selected)
    chosen = F.coalesce("selected", F.when(paths.within(F.lit(source_root), path), F.lit(source_root)))
    below = F.when(chosen == ".", path).otherwise(F.substring(path, F.length(chosen) + 2, F.lit(2**31 - 1)))
    child = F.split(below, "/")[0]
    named = (child != "") & ~child.rlike(f"(?i){paths.SOURCE}\\z")
    first = F.split(path, "/")[0]
    outside = (first == "") | first.rlike(f"(?i){paths.SOURCE}\\z")

    def found(base: Column, root: Column) -> Column:
        return F.struct(base.alias("base_id"), root.alias("root"), F.lit(False).alias("declared"), F.lit(None).cast("array<string>").alias("public"))

    inside = F.when(named, found(child, _join(chosen, child))).otherwise(found(_base(chosen, project), chosen))
    away = F.when(outside, found(F.lit("root"), F.lit("."))).otherwise(found(first, first))
    rows = files.withColumn("selected", selected)
    return rows.withColumn("c", F.coalesce(explicit, F.when(chosen.isNotNull(), inside).otherwise(away))).drop("selected").select(*files.columns, "c.*")


def distinct_roots(candidates: DataFrame) -> DataFrame:
    """A row per root: the first file's candidate, or the first declared one if there is any."""
    best = F.min_by(F.struct("base_id", "declared", "public"), F.struct(~F.col("declared"), F.col("path")))
    return candidates.groupBy(BY, "root").agg(best.alias("c")).select(BY, "root", "c.*")


def collisions(roots: DataFrame) -> DataFrame:
    """Roots with ``same``: how many inferred ones have the same base id."""
    return roots.withColumn("same", F.count_if(~F.col("declared")).over(Window.partitionBy(BY, "base_id")))


def assign_ids(roots: DataFrame, source_root: str, strategy: str = "compact") -> DataFrame:
    """Roots with unique ``id``: declared names first, then by root; a name that is taken gives way to the path.

    Each id depends on those before it, so each snapshot's roots (as many as it has modules) are named in one task.
    """
    root = F.col("root")
    below = F.when((root != source_root) & paths.within(F.lit(source_root), root), root if source_root == "." else F.substring(root, len(source_root) + 2, 2**31 - 1))
    fallback = F.coalesce(below, F.when(root == ".", "root").otherwise(root))
    preferred = F.when(F.col("declared") | F.lit(strategy != "relative-path") & (F.col("same") <= 1), F.col("base_id")).otherwise(fallback)
    place = F.when(root == ".", "").otherwise(F.concat(F.lit("/"), root))
    order = Window.partitionBy(BY).orderBy(~F.col("declared"), paths.by_locale(place), place, "base_id")
    rows = collisions(roots).select(BY, "root", fallback.alias("fallback"), preferred.alias("preferred"), F.row_number().over(order).alias("ord"))

    def name(pdf):
        used, ids = set(), []
        pdf = pdf.sort_values("ord")
        for want, other in zip(pdf["preferred"], pdf["fallback"]):
            options = (f"{other}#{k}" for k in range(2, len(pdf) + 3))
            id = next(x for x in (want, other, *options) if x not in used)
            used.add(id)
            ids.append(id)
        return pdf[[BY, "root"]].assign(id=ids)

    ship(rows.sparkSession)
    named = rows.groupBy(BY).applyInPandas(name, f"{BY} string, root string, id string")
    return roots.join(named, [BY, "root"])


def infer_modules(files: DataFrame, config: dict, source_root: str = "src", roots: list[str] | None = None, project: str = "project") -> tuple[DataFrame, DataFrame]:
    """``(modules, ownership)`` of files(snapshot_id, path).

    Modules: id, stableId, root, files, entrypoints, provenance; only those that own files.  ownership: file, module.
    Entrypoints are the files named ``index`` at any depth, unless some are declared or configured (an empty list
    counts): then those of them that the module has.
    """
    roots = roots or [source_root]
    named = assign_ids(distinct_roots(candidate_roots(files.select(BY, "path"), config, source_root, roots, project)), source_root, config.get("moduleIdStrategy", "compact"))
    owner = E.longest_prefix(files, named)
    inferred = F.col("file").rlike(rf"(?:\A|/)index(?:(?i){paths.SOURCE})\z")
    grouped = owner.groupBy(BY, F.col("module").alias("id")).agg(F.array_sort(F.collect_set("file")).alias("files"), F.array_sort(F.collect_set(F.when(inferred, F.col("file")))).alias("index"))
    configured = F.lit(None).cast("array<string>")
    for id, listed in config.get("publicEntrypoints", {}).items():
        configured = F.when(F.col("id") == id, F.array(*map(F.lit, listed)).cast("array<string>")).otherwise(configured)
    clean = F.transform(F.coalesce("public", configured), lambda f: F.regexp_replace(f, r"\A(?:\./)+", ""))
    own = F.array_sort(F.filter(clean, lambda f: F.array_contains("files", f)))
    met = grouped.join(named, [BY, "id"])
    proof = F.when(F.col("declared"), F.array(E.evidence("config", F.concat(F.lit("module:"), F.col("id"))))).otherwise(F.transform("files", lambda f: E.evidence("file", f, f)))
    proof = E.provenance("inferred", "module-inference", evidence=proof)
    proof = F.struct(F.when(F.col("declared"), "declared").otherwise("inferred").alias("origin"), *[proof[c].alias(c) for c in ("analyzer", "rule", "evidence", "derivedFrom")])
    modules = met.select(BY, "id", F.col("root").alias("stableId"), "root", "files", F.coalesce(own, "index").alias("entrypoints"), proof.alias("provenance"))
    return modules, owner


def entrypoint_rows(modules: DataFrame) -> DataFrame:
    return modules.select(BY, F.col("id").alias("module"), F.explode("entrypoints").alias("file"))


def ownership_rows(owner: DataFrame) -> DataFrame:
    proof = F.array(E.evidence("file", F.col("file"), F.col("file")))
    return owner.select(BY, "file", "module", E.provenance("inferred", "module-inference", evidence=proof).alias("provenance"))
