"""A project analysed into a snapshot, snapshots compared, Git refs read."""

from __future__ import annotations

import hashlib
import os
import shutil
import subprocess
import tempfile
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.canonical import canonical_json, sha256
from ..operators import cycles as G
from ..operators import diff as D
from ..operators import edges as E
from ..operators import modules as M
from ..operators import rules as R
from ..sources import extract, project, resolve, snapshots
from ..sources.schemas import IR_VERSION, LAYERS, TOOL, TOOL_VERSION
from . import render


class SnapshotComparisonError(ValueError):
    code = "INCOMPARABLE_SNAPSHOTS"

    def __init__(self, reasons: list[str]):
        super().__init__(f"Snapshots are not comparable: {'; '.join(reasons)}")
        self.reasons = reasons


@dataclass
class Analysis:
    """The tables of one snapshot, and what its document needs besides."""

    project: project.Project
    contents: DataFrame
    tables: dict[str, DataFrame]


def analyze_tables(spark: SparkSession, start: str = ".", key: str = "current", selection=None) -> Analysis:
    """All facts of a project as lazy tables keyed by ``key``."""
    p = project.discover(start)
    contents = project.contents(spark, p, key)
    files = spark.createDataFrame([(key, f) for f in p.files], "snapshot_id string, path string")
    modules, owner = M.infer_modules(files, p.config, p.source_root, p.module_roots, os.path.basename(p.root) or "root")
    modules, owner = G.cut(modules), G.cut(owner)
    imports = G.cut(resolve.resolve(spark, p, extract.extract(contents)))
    owned = E.owned_imports(imports, owner, M.entrypoint_rows(modules))
    edges = G.cut(E.module_edges(owned))
    cycles = G.cut(G.cycles(edges, modules))
    path = F.col("path")
    proof = E.provenance("observed", "typescript-source", evidence=F.array(E.evidence("file", path, path)))
    seen = contents.select(E.BY, "path", paths.language(path).alias("language"), paths.line_count(F.col("text")).alias("lines"), proof.alias("provenance"))
    tables = {
        "files": seen, "imports": imports.drop("ord"), "modules": modules, "ownership": M.ownership_rows(owner), "module_edges": edges, "cycles": cycles,
        "metrics": E.metrics(spark.createDataFrame([(key,)], "snapshot_id string"), files, modules, imports, edges, cycles),
        "findings": R.evaluate_rules(p.config, owned, modules, cycles, selection),
    }
    return Analysis(p, contents, tables)


#: Order of each table in the document.
ORDERS = {
    "files": [paths.by_locale, str], "imports": [paths.by_locale, str], "modules": [paths.by_locale, str], "ownership": [paths.by_locale, str], "module_edges": [str], "cycles": [str],
}
KEYS = {"files": "path", "ownership": "file"}


def _ordered(name: str, df: DataFrame) -> DataFrame:
    if name == "findings":
        return df.orderBy(*R.finding_order(), R.finding_key())
    return df.orderBy(*[how(KEYS.get(name, "id")) for how in ORDERS[name]])


def input_hash(contents: DataFrame) -> str:
    """Hash of the canonical JSON of all paths and texts, in order of paths; one file at a time passes the driver."""
    h, sep = hashlib.sha256(b"["), ""
    for r in contents.select("path", "text").orderBy("path").toLocalIterator():
        h.update((sep + canonical_json({"path": r["path"], "content": r["text"]})).encode())
        sep = ","
    h.update(b"]")
    return h.hexdigest()


def document(analysis: Analysis, tool: str = TOOL) -> dict:
    """The snapshot's document: ordered, with its receipt, checked.  As large as its module graph and imports."""
    p, layers = analysis.project, {}
    for name, (layer, part) in LAYERS.items():
        layers.setdefault(layer, {})[part] = [render.record(name, r) for r in _ordered(name, analysis.tables[name]).collect()]
    metrics = render.record("metrics", analysis.tables["metrics"].first())
    configurations = sorted({canonical_json(p.configurations[i]) for i in set(p.owner.values())})
    receipt = {
        "snapshotId": "", "tool": tool, "toolVersion": TOOL_VERSION, "irVersion": IR_VERSION, "configHash": sha256(p.config),
        "compilerOptionsHash": sha256({"default": p.options, "configurations": configurations}), "inputHash": input_hash(analysis.contents),
    }
    proof = lambda origin, analyzer: {"origin": origin, "analyzer": analyzer}
    out = {
        "irVersion": IR_VERSION, "receipt": receipt, "project": {"root": ".", "tsconfig": p.relative(p.tsconfig), "sourceRoot": p.source_root},
        "policy": {"failOn": sorted(p.config.get("failOn", [])), "provenance": {**proof("declared", project.CONFIG_NAME), "evidence": [{"kind": "config", "id": "policy"}]}},
        "source": {**layers["source"], "provenance": proof("observed", "typescript-source")},
        "architecture": {**layers["architecture"], "provenance": proof("derived", "module-projection")},
        "analysis": {"cycles": layers["analysis"]["cycles"], "metrics": metrics, "findings": layers["analysis"]["findings"], "provenance": proof("derived", "architecture-analysis")},
    }
    receipt["snapshotId"] = snapshots.snapshot_id(out)
    return snapshots.assert_snapshot(out, "Generated architecture snapshot", tool)


def analyze_project(spark: SparkSession, start: str = ".", selection=None, tool: str = TOOL) -> dict:
    return document(analyze_tables(spark, start, selection=selection), tool)


def analyze_git_ref(spark: SparkSession, ref: str, start: str = ".", tool: str = TOOL) -> dict:
    """The project as it was at a Git ref; the work tree is left alone.

    The ref is unpacked beside the session's shared folder if there is one: executors have to see it.
    """
    at = os.path.abspath(start)
    run = lambda *a, **k: subprocess.run(a, capture_output=True, check=True, **k).stdout
    try:
        top = run("git", "rev-parse", "--show-toplevel", cwd=at).decode().strip()
    except (OSError, subprocess.CalledProcessError) as e:
        raise ValueError(f"Could not locate a Git repository from '{at}'. {e}") from e
    shared = (spark.sparkContext.getConf().get("spark.checkpoint.dir") or "").removeprefix("file://")
    place = tempfile.mkdtemp(prefix="git-", dir=shared if os.path.isdir(shared) else None)
    try:
        run("tar", "-xf", "-", "-C", place, input=run("git", "archive", ref, cwd=top))
        return analyze_project(spark, os.path.normpath(os.path.join(place, os.path.relpath(os.path.realpath(at), os.path.realpath(top)))), tool=tool)
    except Exception as e:
        reason = e.stderr.decode().strip() if isinstance(e, subprocess.CalledProcessError) else str(e)
        raise ValueError(f"Could not analyze Git ref '{ref}'. {reason}") from e
    finally:
        shutil.rmtree(place, ignore_errors=True)


def diff_snapshots(spark: SparkSession, before: dict, after: dict, base: str = "base", current: str = "current") -> dict:
    """The difference of two documents as a document."""
    b, a = snapshots.tables(spark, before), snapshots.tables(spark, after)
    if reasons := D.comparability(b["snapshots"], a["snapshots"]).first()["reasons"]:
        raise SnapshotComparisonError(reasons)
    return render.diff_document(D.diff_snapshots(b, a), after["policy"]["failOn"], base, current, before["irVersion"])
