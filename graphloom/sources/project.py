"""A TypeScript project on disk: its configuration files, the files in scope, and their texts.

Metadata (configurations, names of files) is read on the driver; texts are read by Spark.
"""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import globs, paths
from . import schemas

# Name of the configuration file, extensions, folders left out.
CONFIG_NAME = "arch.config.json"
TS, JS = (".ts", ".tsx", ".mts", ".cts"), (".js", ".jsx", ".mjs", ".cjs")
OUTSIDE = ("node_modules", "bower_components", "jspm_packages")


def find_tsconfig(start: str) -> str:
    """The nearest tsconfig.json in a directory (or a file's directory) or above it."""
    at = os.path.abspath(start)
    at = at if os.path.isdir(at) else os.path.dirname(at)
    while True:
        if os.path.exists(found := os.path.join(at, "tsconfig.json")):
            return found
        if at == (at := os.path.dirname(at)):
            raise FileNotFoundError(f"Could not find tsconfig.json from {start}")


def read_config(root: str) -> dict:
    """The project's own configuration; none is an empty one."""
    path = os.path.join(root, CONFIG_NAME)
    if not os.path.exists(path):
        return {}
    try:
        config = json.loads(Path(path).read_text("utf-8-sig"))
    except ValueError as e:
        raise ValueError(f"Could not read {CONFIG_NAME}. {e}") from e
    if faults := schemas.issues(schemas.CONFIG, config):
        raise ValueError(f"Invalid {CONFIG_NAME}: {faults}")
    return config


_JSONC = re.compile(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?\*/|,(?=(?:\s|//[^\n]*|/\*.*?\*/)*[}\]])', re.S)


def read_jsonc(path: str) -> Any:
    """JSON with comments and final commas."""
    text = Path(path).read_text("utf-8-sig")
    try:
        return json.loads(_JSONC.sub(lambda m: m[1] or "", text) or "{}")
    except ValueError as e:
        raise ValueError(f"Failed to parse file '{path}': {e}") from e


def compiler_options(path: str, raw: dict, seen: tuple = ()) -> dict:
    """Options of a configuration with those it extends; paths in them are made absolute."""
    here, out = os.path.dirname(path), {}
    extends = raw.get("extends") or []
    for e in [extends] if isinstance(extends, str) else extends:
        base = os.path.normpath(os.path.join(here, e)) if e.startswith(".") or os.path.isabs(e) else os.path.join(here, "node_modules", e)
        base = base if base.endswith(".json") else f"{base}.json"
        if os.path.exists(base) and base not in seen:
            parent = read_jsonc(base)
            out |= compiler_options(base, parent, (*seen, base))
            for k in ("include", "exclude", "files"):
                if k in parent and k not in raw:
                    raw[k] = [os.path.join(os.path.dirname(base), x) for x in parent[k]]
    own = dict(raw.get("compilerOptions") or {})
    for k in ("rootDir", "baseUrl", "outDir", "declarationDir"):
        if k in own:
            own[k] = os.path.normpath(os.path.join(here, own[k]))
    if "paths" in own:
        own["pathsBase"] = here
    return out | own


def _matcher(here: str, patterns: list[str]) -> re.Pattern:
    """A configuration's patterns as one regex over absolute paths; a plain last part stands for a directory, too."""
    bodies = []
    for p in patterns:
        full = os.path.normpath(os.path.join(here, p)).replace("\\", "/")
        last = full.rsplit("/", 1)[-1]
        if not re.search(r"[*?]", last) and "." not in last or last == "**":
            full = full.removesuffix("/**") + "/**/*"
        bodies.append(globs.path_glob(full))
        if full.endswith("/**/*"):
            bodies.append(globs.path_glob(full.removesuffix("/**/*")))
    return re.compile("|".join(f"(?:{b})" for b in bodies) or r"(?!)")


def config_files(path: str, raw: dict, options: dict) -> list[str]:
    """Files that a configuration names or includes, sorted."""
    here = os.path.dirname(path)
    named = [os.path.normpath(os.path.join(here, f)) for f in raw.get("files", [])]
    include = raw.get("include", [] if "files" in raw else ["**/*"])
    exclude = raw.get("exclude") or [*OUTSIDE, *(options[k] for k in ("outDir", "declarationDir") if k in options)]
    wanted, unwanted = _matcher(here, include), _matcher(here, [x if x not in OUTSIDE else f"**/{x}" for x in exclude])
    ends = (*TS, *JS) if options.get("allowJs") or options.get("checkJs") else TS
    found = set(named)
    for at, dirs, files in os.walk(here) if include else ():
        dirs[:] = sorted(d for d in dirs if d not in OUTSIDE and not d.startswith(".") and not unwanted.fullmatch(os.path.join(at, d)))
        for f in files:
            full = os.path.join(at, f)
            if f.endswith(ends) and not f.startswith(".") and wanted.fullmatch(full) and not unwanted.fullmatch(full):
                found.add(full)
    # A script next to a source of the same name is its output.
    return sorted(f for f in found if not f.endswith(JS) or f in named or not any(os.path.splitext(f)[0] + e in found for e in (".ts", ".tsx")))


@dataclass
class Project:
    """What the driver knows of a project.  Files are relative to its root; ``owner`` gives each file's configuration."""

    root: str
    tsconfig: str
    source_root: str
    config: dict
    options: dict
    configurations: list[dict] = field(default_factory=list)
    files: list[str] = field(default_factory=list)
    owner: dict[str, int] = field(default_factory=dict)
    module_roots: list[str] = field(default_factory=list)

    def relative(self, path: str) -> str:
        return os.path.relpath(path, self.root).replace(os.sep, "/")


def _relative_options(options: dict, root: str) -> dict:
    """Options with paths relative to the project, so that equal projects in different places agree."""
    made = {k: os.path.relpath(v, root) if isinstance(v, str) and os.path.isabs(v) else v for k, v in options.items()}
    return made


def discover(start: str = ".") -> Project:
    """Follow a project's configurations and their references (each once), and find its files in scope.

    The first configuration that names a file owns it; later configurations' options override the project's.
    """
    tsconfig = find_tsconfig(start)
    root = os.path.dirname(tsconfig)
    config = read_config(root)
    seen, owner, merged, configurations = set(), {}, {}, []
    queue = [tsconfig]
    while queue:
        path = os.path.normpath(queue.pop(0))
        if path in seen:
            continue
        seen.add(path)
        raw = read_jsonc(path)
        options = compiler_options(path, raw)
        found = config_files(path, raw, options)
        references = [r["path"] for r in raw.get("references", []) if isinstance(r, dict) and isinstance(r.get("path"), str)]
        if not found and not references and raw.get("files") != []:
            raise ValueError(f"No inputs were found in config file '{path}'.")
        configurations.append(options)
        for f in found:
            if re.search(f"(?i){paths.SOURCE}$", f) and not f.endswith(".d.ts"):
                owner.setdefault(f, len(configurations) - 1)
        merged |= options
        near = []
        for r in references:
            target = os.path.normpath(os.path.join(os.path.dirname(path), r))
            target = os.path.join(target, "tsconfig.json") if os.path.isdir(target) else target if target.endswith(".json") else f"{target}.json"
            near += [target] if os.path.exists(target) else []
        queue = near + queue
    absolute = sorted(owner)
    out = Project(root, tsconfig, root, config, _relative_options(merged, root), [_relative_options(o, root) for o in configurations])
    include, exclude = ([re.compile("|".join(f"(?:{globs.path_regex(p)})" for p in ps) or r"(?!)") for ps in (config.get("include", []), [*globs.DEFAULT_EXCLUDES, *config.get("exclude", [])])])
    for f in absolute:
        r = out.relative(f)
        if (not config.get("include") or include.fullmatch(r)) and not exclude.fullmatch(r):
            out.files.append(r)
            out.owner[r] = owner[f]
    kept = [os.path.join(root, f) for f in out.files]
    if "rootDir" in merged:
        base = merged["rootDir"]
    elif any("/src/" in f for f in kept):
        base = os.path.join(root, "src")
    else:
        base = os.path.commonpath([os.path.dirname(f) for f in kept]) if kept else os.getcwd()
    out.source_root = out.relative(base)
    if config.get("moduleRoots"):
        found = [os.path.normpath(os.path.join(root, r)) for r in config["moduleRoots"]]
        out.module_roots = [out.relative(r) for r in found if os.path.exists(r)]
    else:
        usual = [os.path.join(base, d) for d in ("modules", "features", "app", "shared")]
        out.module_roots = [out.relative(r) for r in usual if os.path.exists(r)] or [out.source_root]
    return out


def inventory(project: Project) -> list[tuple[str, str]]:
    """``(kind, path)`` of all that specifiers may lead to: files on disk (in scope or not) and installed packages."""
    found = []
    for at, dirs, files in os.walk(project.root):
        if os.path.basename(at) == "node_modules":
            for d in sorted(dirs):
                for name in (os.path.join(d, x) for x in sorted(os.listdir(os.path.join(at, d)))) if d.startswith("@") else (d,):
                    found.append(("package", project.relative(os.path.join(at, name))))
            dirs[:] = []
            continue
        dirs[:] = sorted(d for d in dirs if d != ".git")
        found += [("file", project.relative(os.path.join(at, f))) for f in files if f.endswith((*TS, *JS, ".json"))]
    known = {p for _, p in found}
    return found + [("file", f) for f in project.files if f not in known]


def contents(spark: SparkSession, project: Project, snapshot: str) -> DataFrame:
    """``(snapshot_id, path, text)`` of the files in scope; broken UTF-8 is repaired, a leading mark left out.
    Files that are empty (Spark's reader skips them) or gone have an empty text.

    Whole binary files: a text reader would drop final line breaks.
    """
    if not project.files:
        return spark.createDataFrame([], "snapshot_id string, path string, text string")
    escaped = [re.sub(r"([\[\]{}*?\\])", r"\\\1", os.path.join(project.root, f)) for f in project.files]
    raw = spark.read.format("binaryFile").load(escaped)
    path = F.regexp_replace("path", r"\Afile:/*", "/")
    text = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "\\A\ufeff", "")
    found = raw.select(F.substring(path, len(project.root) + 2, 2**31 - 1).alias("path"), text.alias("text"))
    named = spark.createDataFrame([(snapshot, f) for f in project.files], "snapshot_id string, path string")
    return named.join(found, "path", "left").select("snapshot_id", "path", F.coalesce("text", F.lit("")).alias("text"))
