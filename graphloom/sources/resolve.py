"""Specifiers resolved to files: ranked candidates meet the inventory in one equi-join.

Covered: relative and absolute specifiers, extension substitution, index files, ``baseUrl`` and ``paths``, installed
packages by directory, above the project too.  Not covered: ``exports`` and ``imports`` of package.json, its ``main``, ``rootDirs``, symbolic links.
"""

from __future__ import annotations

import os
import posixpath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import edges as E
from ..plans.session import checkpoint, ship
from .project import Project, inventory

BY = E.BY
# Extensions tried for a script's extension, and those added to a bare path.
SUBSTITUTES = {".js": (".ts", ".tsx", ".d.ts"), ".jsx": (".tsx", ".ts", ".d.ts"), ".mjs": (".mts", ".d.mts"), ".cjs": (".cts", ".d.cts"), ".ts": (".ts", ".tsx", ".d.ts"), ".tsx": (".tsx", ".ts", ".d.ts"), ".mts": (".mts", ".d.mts"), ".cts": (".cts", ".d.cts")}
TYPED, PLAIN = (".ts", ".tsx", ".d.ts"), (".js", ".jsx")


def path_candidates(path: str) -> list[str]:
    """Files that a path may mean, typed ones first."""
    stem, end = posixpath.splitext(path)
    typed = [stem + e for e in SUBSTITUTES.get(end, ())] + [path + e for e in TYPED] + [f"{path}/index{e}" for e in TYPED]
    plain = ([path] if end in (*SUBSTITUTES, ".json") else []) + [path + e for e in PLAIN] + [f"{path}/index{e}" for e in PLAIN]
    return typed + plain


def mapped(specifier: str, options: dict) -> list[str]:
    """Paths that the ``paths`` pattern of the longest prefix gives (relative to the project)."""
    base = options.get("baseUrl", options.get("pathsBase", "."))
    best = None
    for pattern, targets in (options.get("paths") or {}).items():
        head, star, tail = pattern.partition("*")
        if not star and specifier == pattern:
            best = (float("inf"), "", targets)
        elif star and specifier.startswith(head) and specifier.endswith(tail) and len(specifier) >= len(head) + len(tail):
            hit = (len(head), specifier[len(head) : len(specifier) - len(tail)], targets)
            best = hit if best is None or hit[0] > best[0] else best
    return [posixpath.normpath(posixpath.join(base, t.replace("*", best[1], 1))) for t in best[2]] if best else []


def candidates(directory: str, specifier: str, options: dict, root: str) -> list[str]:
    """Ranked places that a specifier in a directory may mean, relative to the project; packages as directories."""
    if specifier in (".", "..") or specifier.startswith(("./", "../")):
        return path_candidates(posixpath.normpath(posixpath.join(directory, specifier)))
    if specifier.startswith("/"):
        return path_candidates(os.path.relpath(specifier, root))
    found = [c for p in mapped(specifier, options) for c in path_candidates(p)]
    if "baseUrl" in options:
        found += path_candidates(posixpath.normpath(posixpath.join(options["baseUrl"], specifier)))
    if specifier.startswith(("#", "node:")):
        return found
    parts = specifier.split("/")
    package = "/".join(parts[: 2 if specifier.startswith("@") else 1])
    up = directory.split("/") if directory not in ("", ".") else []
    above = [up[:k] for k in range(len(up), -1, -1)] + [[".."] * k for k in range(1, root.strip("/").count("/") + 2)]
    return found + [posixpath.normpath("/".join([*at, "node_modules", package])) for at in above]


def beyond(places: list[str], root: str) -> list[tuple[bool, str, bool]]:
    """Which of the places above the project exist: files, and packages as directories."""
    out = []
    for p in places:
        full = os.path.normpath(os.path.join(root, p))
        package = "node_modules" in p.split("/") and not p.endswith(tuple(SUBSTITUTES))
        if os.path.isdir(full) if package else os.path.isfile(full):
            out.append((not package, p, False))
    return out


def resolve(spark: SparkSession, project: Project, found: DataFrame) -> DataFrame:
    """``resolve_among`` the files of a project on disk, the places above it that specifiers lead to, and installed packages."""
    owners = spark.createDataFrame(list(project.owner.items()) or [("", 0)], "fromFile string, config int")
    known = spark.createDataFrame([(k == "file", p, p in project.owner) for k, p in inventory(project)] or [(True, "", False)], "is_file boolean, place string, inside boolean")
    return resolve_among(found, owners, known, project.configurations, project.root, lambda places: beyond(places, project.root))


def resolve_among(found: DataFrame, owners: DataFrame, known: DataFrame, configurations: list[dict], root: str = "/", look=None) -> DataFrame:
    """Imports (as extracted) with ``toFile``, resolution, confidence, id, location and provenance.

    ``owners(fromFile, config)`` gives files their configuration, ``known(is_file, place, inside)`` what specifiers may lead
    to.  Each pair of directory and specifier is resolved once; then all its imports are joined with the answer.  Places
    above the project that are asked for and not known go to ``look``, in a list on the driver, where the project lies.
    """
    spark = found.sparkSession
    directory = F.when(F.col("fromFile").contains("/"), F.regexp_replace("fromFile", r"/[^/]*\z", "")).otherwise("")
    rows = found.join(owners, "fromFile", "left").withColumn("directory", directory).withColumn("config", F.coalesce("config", F.lit(0)))

    def rank(batches):
        for b in batches:
            lists = [candidates(d, s, configurations[c], root) for d, s, c in zip(*(b.column(k).to_pylist() for k in range(3)))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lists, pa.list_(pa.string()))], names=["directory", "specifier", "config", "places"])

    ship(spark)
    asked = rows.select("directory", "specifier", "config").distinct()
    ranked = asked.mapInArrow(rank, "directory string, specifier string, config int, places array<string>").select("directory", "specifier", "config", F.posexplode("places").alias("rank", "place"))
    if look:
        ranked = checkpoint(ranked)
        above = [r[0] for r in ranked.where("place LIKE '../%'").select("place").distinct().join(known, "place", "left_anti").collect()]
        known = known.unionByName(spark.createDataFrame(look(above) or [(True, "", False)], known.schema))
    answer = ranked.join(known, "place").groupBy("directory", "specifier", "config").agg(F.min_by(F.struct("place", "is_file", "inside"), "rank").alias("hit"))
    met = rows.join(answer, ["directory", "specifier", "config"], "left")
    hit, spec, kind = F.col("hit"), F.col("specifier"), F.col("importKind")
    is_found = hit.isNotNull()
    internal = F.coalesce(hit["inside"], F.lit(False))
    asset = paths.is_asset(spec) | F.coalesce(paths.is_asset(hit["place"]), F.lit(False))
    outside = is_found & ~internal & paths.is_local(spec) & ~F.coalesce(paths.in_node_modules(hit["place"]), F.lit(False))
    made = met.select(
        BY, "fromFile", "ord", F.when(internal | outside, hit["place"]).alias("toFile"), "specifier", "importKind",
        paths.resolution(internal, asset, outside, is_found, spec, kind).alias("resolution"), paths.confidence(is_found, spec, kind).alias("resolutionConfidence"), "typeOnly", "line", "column",
    )
    seen = E.occurrence(made, ["ord"])
    proof = E.provenance("observed", "typescript-import-resolver", evidence=F.array(E.evidence("file", F.col("fromFile"), F.col("fromFile"), F.col("line"))))
    return seen.select(BY, E.import_id(F.col("occurrence")).alias("id"), "fromFile", "toFile", "specifier", "importKind", "resolution", "resolutionConfidence", "typeOnly", F.struct("line", "column").alias("location"), proof.alias("provenance"), F.struct("fromFile", F.col("ord").alias("n")).alias("ord"))
