"""Strict shapes of configurations, rules and snapshots, and the Spark schemas of their tables.

A shape is checked on the driver before any table is made of it: Spark's own readers would ignore unknown fields.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

IR_VERSION, TOOL_VERSION = "0.3", "0.3.0"
IR_CONTRACT = {"version": IR_VERSION, "compatibility": "exact", "unknownFields": "reject", "receipt": "required"}
#: Name of the tool in receipts; snapshots of other tools are read by giving theirs.
TOOL = "graphloom"


class Shape:
    def check(self, value: Any, path: tuple, out: list[tuple[tuple, str]]) -> None:
        raise NotImplementedError


def _kind(v: Any) -> str:
    if v is None:
        return "null"
    return {bool: "boolean", int: "number", float: "number", str: "string", list: "array", tuple: "array", dict: "object"}.get(type(v), "object")


@dataclass
class Is(Shape):
    """A JSON type, with bounds for numbers and texts."""

    kind: str
    least: int | None = None
    whole: bool = False
    pattern: str | None = None

    def check(self, value, path, out):
        if _kind(value) != self.kind:
            out.append((path, f"Invalid input: expected {self.kind}, received {_kind(value)}"))
        elif self.whole and (isinstance(value, float) and not value.is_integer()):
            out.append((path, "Invalid input: expected int, received number"))
        elif self.least is not None and (value if self.kind == "number" else len(value)) < self.least:
            unit = "" if self.kind == "number" else " characters" if self.kind == "string" else " items"
            out.append((path, f"Too small: expected {self.kind} to {'be' if not unit else 'have'} >={self.least}{unit}"))
        elif self.pattern and not re.fullmatch(self.pattern, value):
            out.append((path, f"Invalid string: must match pattern /{self.pattern}/"))


@dataclass
class OneOf(Shape):
    values: tuple

    def check(self, value, path, out):
        if not isinstance(value, str) or value not in self.values:
            shown = "|".join(f'"{v}"' for v in self.values)
            out.append((path, f"Invalid option: expected one of {shown}" if len(self.values) > 1 else f"Invalid input: expected {shown}"))


@dataclass
class Many(Shape):
    item: Shape
    least: int = 0

    def check(self, value, path, out):
        if not isinstance(value, (list, tuple)):
            out.append((path, f"Invalid input: expected array, received {_kind(value)}"))
            return
        if len(value) < self.least:
            out.append((path, f"Too small: expected array to have >={self.least} items"))
        for k, v in enumerate(value):
            self.item.check(v, (*path, k), out)


@dataclass
class Named(Shape):
    """An object with any keys."""

    item: Shape
    least_key: int = 0

    def check(self, value, path, out):
        if not isinstance(value, dict):
            out.append((path, f"Invalid input: expected record, received {_kind(value)}"))
            return
        for k, v in value.items():
            if len(k) < self.least_key:
                out.append(((*path, k), "Invalid key in record"))
            self.item.check(v, (*path, k), out)


class Fields(Shape):
    """An object with these fields and no others; ``optional`` may lack."""

    def __init__(self, required: dict[str, Shape], optional: dict[str, Shape] | None = None):
        self.required, self.optional = required, optional or {}

    def check(self, value, path, out):
        if not isinstance(value, dict):
            out.append((path, f"Invalid input: expected object, received {_kind(value)}"))
            return
        for k, shape in {**self.required, **self.optional}.items():
            if k in value:
                shape.check(value[k], (*path, k), out)
            elif k in self.required:
                expected = shape.kind if isinstance(shape, Is) else "object" if isinstance(shape, Fields) else "array" if isinstance(shape, Many) else "value"
                out.append(((*path, k), f"Invalid input: expected {expected}, received undefined"))
        if unknown := [k for k in value if k not in self.required and k not in self.optional]:
            out.append((path, f"Unrecognized key{'s' * (len(unknown) > 1)}: " + ", ".join(f'"{k}"' for k in unknown)))


@dataclass
class Either(Shape):
    shapes: tuple

    def check(self, value, path, out):
        for s in self.shapes:
            own: list = []
            s.check(value, path, own)
            if not own:
                return
        out.append((path, "Invalid input"))


@dataclass
class Nothing(Shape):
    def check(self, value, path, out):
        if value is not None:
            out.append((path, "Invalid input"))


class Anything(Shape):
    def check(self, value, path, out):
        pass


def issues(shape: Shape, value: Any) -> str:
    """All faults as ``path: message``, joined by a semicolon; empty if there are none."""
    out: list[tuple[tuple, str]] = []
    shape.check(value, (), out)
    return "; ".join(f"{'.'.join(map(str, path)) or '<root>'}: {text}" for path, text in out)


TEXT, SOME, FLAG = Is("string"), Is("string", least=1), Is("boolean")
COUNT, PLACE, HASH = Is("number", 0, True), Is("number", 1, True), Is("string", pattern="[a-f0-9]{64}")
TEXTS, SOMES = Many(TEXT), Many(SOME)

# Fields and options of configurations and rules.
REF = Fields({"field": SOME})
SOURCE = OneOf(("cycles", "imports", "forbiddenDependencies", "modules"))
FLAGS = OneOf(("noCycles", "noDeepImports", "forbiddenDependencies"))
OPERATOR = OneOf(("eq", "neq", "truthy", "falsy", "startsWith", "includes", "gt", "gte", "lt", "lte"))
CONDITION = Fields({"field": SOME, "operator": OPERATOR}, {"value": Either((TEXT, Is("number"), FLAG, Nothing(), REF))})
FINDING_SPEC = Fields({"category": OneOf(("violation", "observation")), "level": OneOf(("error", "warning", "info")), "message": TEXT}, {"file": REF, "line": REF, "related": REF, "data": Named(REF)})
RULE = Fields({"code": SOME, "source": SOURCE, "finding": FINDING_SPEC}, {"enabledBy": FLAGS, "where": Many(CONDITION)})
RULES = Many(RULE)
RULE_PACK = Fields({"id": SOME, "version": SOME, "requiredFacts": Many(SOURCE), "rules": RULES})
RULE_PACKS = Many(RULE_PACK)
ZONE = Fields({"from": Many(SOME, 1)}, {"allow": SOMES, "deny": SOMES, "message": TEXT})
ID_STRATEGY = OneOf(("compact", "relative-path"))
CONFIG = Fields({}, {
    "include": TEXTS, "exclude": TEXTS, "moduleRoots": TEXTS, "moduleIdStrategy": ID_STRATEGY, "modules": Named(Fields({"root": SOME}, {"publicEntrypoints": TEXTS})),
    "publicEntrypoints": Named(TEXTS), "noCycles": FLAG, "noDeepImports": FLAG, "failOn": TEXTS, "forbiddenDependencies": Many(Fields({"from": SOME, "to": SOME}, {"message": TEXT})),
    "boundaryZones": Named(ZONE, 1), "rules": RULES, "rulePacks": RULE_PACKS,
})

# Fields and options of snapshots.
PROOF = Fields({"kind": OneOf(("file", "source-edge", "module", "module-edge", "config", "rule")), "id": TEXT}, {"file": TEXT, "line": COUNT})
PROVENANCE = Fields({"origin": OneOf(("observed", "declared", "inferred", "derived"))}, {"analyzer": TEXT, "rule": TEXT, "evidence": Many(PROOF), "derivedFrom": TEXTS})
FILE = Fields({"path": TEXT, "language": OneOf(("typescript", "javascript")), "lines": COUNT, "provenance": PROVENANCE})
IMPORT = Fields(
    {"id": TEXT, "fromFile": TEXT, "specifier": TEXT, "importKind": OneOf(("static", "export", "dynamic", "require")), "resolution": OneOf(("internal", "external", "asset", "unresolved", "out-of-scope")), "typeOnly": FLAG, "location": Fields({"line": PLACE, "column": COUNT}), "provenance": PROVENANCE},
    {"toFile": TEXT, "resolutionConfidence": OneOf(("exact", "syntactic", "ambiguous"))},
)
MODULE = Fields({"id": TEXT, "root": TEXT, "files": TEXTS, "entrypoints": TEXTS, "provenance": PROVENANCE}, {"stableId": TEXT})
OWNER = Fields({"file": TEXT, "module": TEXT, "provenance": PROVENANCE})
EDGE = Fields({"id": TEXT, "from": TEXT, "to": TEXT, "imports": COUNT, "publicApiImports": COUNT, "deepImports": COUNT, "files": TEXTS, "sourceEdgeIds": TEXTS, "visibility": OneOf(("public", "deep", "mixed")), "provenance": PROVENANCE})
CYCLE = Fields({"id": TEXT, "modules": TEXTS, "edgeIds": TEXTS, "provenance": PROVENANCE})
TOP = Either((Nothing(), Fields({"module": TEXT, "value": COUNT})))
METRICS = Fields({**{k: COUNT for k in ("sourceFiles", "modules", "imports", "internalImports", "externalImports", "assetImports", "unresolvedImports", "moduleEdges", "cycles", "deepImports")}, "maxFanIn": TOP, "maxFanOut": TOP, "provenance": PROVENANCE}, {"outOfScopeImports": COUNT})
FINDING = Fields({"code": TEXT, "category": OneOf(("violation", "observation")), "level": OneOf(("error", "warning", "info")), "message": TEXT, "provenance": PROVENANCE}, {"file": TEXT, "line": PLACE, "related": TEXTS, "data": Named(Anything())})


def snapshot_shape(tool: str = TOOL) -> Fields:
    receipt = Fields({"snapshotId": HASH, "tool": OneOf((tool,)), "toolVersion": OneOf((TOOL_VERSION,)), "irVersion": OneOf((IR_VERSION,)), "configHash": HASH, "compilerOptionsHash": HASH, "inputHash": HASH})
    return Fields({
        "irVersion": OneOf((IR_VERSION,)), "receipt": receipt, "project": Fields({"root": TEXT, "tsconfig": TEXT, "sourceRoot": TEXT}), "policy": Fields({"failOn": TEXTS, "provenance": PROVENANCE}),
        "source": Fields({"files": Many(FILE), "imports": Many(IMPORT), "provenance": PROVENANCE}),
        "architecture": Fields({"modules": Many(MODULE), "ownership": Many(OWNER), "moduleEdges": Many(EDGE), "provenance": PROVENANCE}),
        "analysis": Fields({"cycles": Many(CYCLE), "metrics": METRICS, "findings": Many(FINDING), "provenance": PROVENANCE}),
    })


_PROV = "STRUCT<origin:STRING,analyzer:STRING,rule:STRING,evidence:ARRAY<STRUCT<kind:STRING,id:STRING,file:STRING,line:INT>>,derivedFrom:ARRAY<STRING>>"
_TOP = "STRUCT<module:STRING,value:BIGINT>"
_COUNTERS = ("sourceFiles", "modules", "imports", "internalImports", "externalImports", "assetImports", "unresolvedImports", "outOfScopeImports", "moduleEdges", "cycles", "deepImports")

#: Spark schemas of the tables, each with the key of its snapshot first.
TABLES = {
    "files": f"path STRING, language STRING, lines INT, provenance {_PROV}",
    "imports": f"id STRING, fromFile STRING, toFile STRING, specifier STRING, importKind STRING, resolution STRING, resolutionConfidence STRING, typeOnly BOOLEAN, location STRUCT<line:INT,column:INT>, provenance {_PROV}",
    "modules": f"id STRING, stableId STRING, root STRING, files ARRAY<STRING>, entrypoints ARRAY<STRING>, provenance {_PROV}",
    "ownership": f"file STRING, module STRING, provenance {_PROV}",
    "module_edges": f"id STRING, from STRING, to STRING, imports BIGINT, publicApiImports BIGINT, deepImports BIGINT, files ARRAY<STRING>, sourceEdgeIds ARRAY<STRING>, visibility STRING, provenance {_PROV}",
    "cycles": f"id STRING, modules ARRAY<STRING>, edgeIds ARRAY<STRING>, provenance {_PROV}",
    "metrics": ", ".join(f"{c} BIGINT" for c in _COUNTERS) + f", maxFanIn {_TOP}, maxFanOut {_TOP}, provenance {_PROV}",
    "findings": f"code STRING, category STRING, level STRING, message STRING, file STRING, line INT, related ARRAY<STRING>, data MAP<STRING,STRING>, provenance {_PROV}",
}
TABLES = {k: f"snapshot_id STRING, {v}" for k, v in TABLES.items()}
#: Where each table's rows are in the document.
LAYERS = {"files": ("source", "files"), "imports": ("source", "imports"), "modules": ("architecture", "modules"), "ownership": ("architecture", "ownership"), "module_edges": ("architecture", "moduleEdges"), "cycles": ("analysis", "cycles"), "findings": ("analysis", "findings")}
