"""The declarative rule language, compiled to column expressions.

Each of the four collections is scanned once for all its rules (forbidden dependencies together with the imports).
"""

from __future__ import annotations

import functools
import json
import operator
import re
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import globs, paths
from ..sources import schemas
from . import edges as E

BY = E.BY
LEVELS = ("error", "warning", "info")

# Fields of the collections and their types.
FIELDS: dict[str, dict[str, str]] = {
    "cycles": {"id": "string", "modules": "array", "edgeIds": "array"},
    "imports": {
        "id": "string", "fromFile": "string", "toFile": "string", "specifier": "string", "line": "number", "resolution": "string",
        "resolutionConfidence": "string", "importKind": "string", "fromModule": "string", "toModule": "string", "target": "string",
        "isInternal": "boolean", "isCrossModule": "boolean", "isPublicApi": "boolean", "isUnresolvedInternal": "boolean", "isOutOfScope": "boolean",
        "isDynamic": "boolean", "isBoundaryViolation": "boolean", "boundaryZone": "string", "boundaryMessage": "string",
    },
    "modules": {"moduleId": "string", "hasPublicEntrypoint": "boolean", "hasPeers": "boolean", "related": "array"},
}
FIELDS["forbiddenDependencies"] = FIELDS["imports"]


def _f(name: str) -> dict:
    return {"field": name}


def _is(name: str, value) -> dict:
    return {"field": name, "operator": "eq", "value": value}


def _rule(code, source, category, level, message, where=None, enabled=None, **finding) -> dict:
    out = {"code": f"architecture/{code}", "source": source, "finding": {"category": category, "level": level, "message": message, **finding}}
    return out | ({"where": where} if where else {}) | ({"enabledBy": enabled} if enabled else {})


_AT = {"file": _f("fromFile"), "line": _f("line")}

# Codes, messages and predicates of the built-in rules.
BUILTIN_RULES = [
    _rule("cycle", "cycles", "violation", "error", "Module dependency strongly-connected component: ${modules}.", enabled="noCycles", related=_f("modules"), data={"modules": _f("modules"), "edgeIds": _f("edgeIds")}),
    _rule("unresolved-import", "imports", "observation", "warning", "Could not resolve internal import '${specifier}'.", [_is("isUnresolvedInternal", True)], **_AT, data={"specifier": _f("specifier")}),
    _rule("out-of-scope-import", "imports", "observation", "warning", "Internal import '${specifier}' resolves outside the analysis scope.", [_is("isOutOfScope", True)], **_AT, data={"specifier": _f("specifier"), "target": _f("target")}),
    _rule("dynamic-import-ambiguous", "imports", "observation", "warning", "Dynamic dependency '${specifier}' could not be resolved statically.", [_is("isDynamic", True), _is("resolutionConfidence", "ambiguous")], **_AT, data={"specifier": _f("specifier"), "importKind": _f("importKind")}),
    _rule("boundary-violation", "imports", "violation", "error", "${boundaryMessage}", [_is("isBoundaryViolation", True)], **_AT, related=_f("toModule"), data={"from": _f("fromModule"), "to": _f("toModule"), "boundaryZone": _f("boundaryZone"), "specifier": _f("specifier"), "message": _f("boundaryMessage")}),
    _rule("deep-import", "imports", "violation", "warning", "${fromModule} imports ${target} instead of ${toModule}'s public entrypoint.", [_is("isInternal", True), _is("isCrossModule", True), _is("isPublicApi", False)], "noDeepImports", **_AT, data={"from": _f("fromModule"), "to": _f("toModule"), "target": _f("target")}),
    _rule("forbidden-dependency", "forbiddenDependencies", "violation", "error", "${fromModule} is not allowed to depend on ${toModule}.", enabled="forbiddenDependencies", **_AT, data={"from": _f("fromModule"), "to": _f("toModule")}),
    _rule("no-public-entrypoint", "modules", "observation", "info", "Module '${moduleId}' has no index entrypoint; cross-module imports cannot be checked as public API.", [_is("hasPublicEntrypoint", False), _is("hasPeers", True)], related=_f("related")),
]
BUILTIN_RULE_PACK = {"id": "graphloom/core", "version": "0.3.0", "requiredFacts": ["cycles", "imports", "forbiddenDependencies", "modules"], "rules": BUILTIN_RULES}


# ---------------------------------------------------------------- registry


@dataclass(frozen=True)
class Registry:
    packs: list[dict]
    rules: list[dict]
    required_facts: list[str]


def create_registry(packs: list[dict], order=lambda text: (text.casefold(), text)) -> Registry:
    """Packs by id and version, checked: shape, unique ids, unique rule codes, declared facts."""
    if issues := schemas.issues(schemas.RULE_PACKS, packs):
        raise ValueError(f"Invalid rule pack: {issues}")
    packs, rules, ids, codes = sorted(packs, key=lambda p: (order(p["id"]), order(p["version"]))), [], set(), set()
    for p in packs:
        if p["id"] in ids:
            raise ValueError(f"Duplicate rule pack id: {p['id']}")
        ids.add(p["id"])
        for r in p["rules"]:
            if r["source"] not in p["requiredFacts"]:
                raise ValueError(f"Rule pack '{p['id']}' does not declare required fact '{r['source']}'.")
            if r["code"] in codes:
                raise ValueError(f"Duplicate rule code: {r['code']}")
            codes.add(r["code"])
            rules.append(r)
    return Registry(packs, rules, sorted({f for p in packs for f in p["requiredFacts"]}))


def _pack(id: str, version: str, rules: list[dict]) -> dict:
    return {"id": id, "version": version, "requiredFacts": sorted({r["source"] for r in rules}), "rules": list(rules)}


def select_registry(config: dict, selection=None) -> Registry:
    """The configuration's packs (built-ins first); or a registry; or a list of rules, which replaces the built-ins."""
    if selection is None:
        own = [_pack("project/rules", "config", config["rules"])] if config.get("rules") else []
        return create_registry([BUILTIN_RULE_PACK, *own, *config.get("rulePacks", [])])
    if isinstance(selection, Registry):
        return create_registry(selection.packs)
    if not isinstance(selection, (list, tuple)):
        raise ValueError("Invalid rule selection.")
    if issues := schemas.issues(schemas.RULES, list(selection)):
        raise ValueError(f"Invalid rule specification: {issues}")
    return create_registry([_pack("runtime/inline", "runtime", selection)])


# ---------------------------------------------------------------- compiler


@dataclass(frozen=True)
class Term:
    """A side of a condition: its type (``undefined`` if it can have no value), its column, and its name if it is a field."""

    kind: str
    column: Column | None = None
    name: str | None = None
    value: object = field(default=None, compare=False)


def _term(fields: dict[str, str], name: str) -> Term:
    return Term(fields[name], F.col(name), name) if name in fields else Term("undefined")


def _expected(fields: dict[str, str], condition: dict) -> Term:
    if "value" not in condition:
        return Term("undefined")
    v = condition["value"]
    if isinstance(v, dict):
        return _term(fields, v["field"])
    if v is None:
        return Term("null")
    kind = "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string"
    return Term(kind, F.lit(v), None, v)


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _missing(t: Term) -> Column:
    return F.lit(True) if t.kind == "undefined" else F.lit(False) if t.kind == "null" else t.column.isNull()


def _equal(a: Term, b: Term) -> Column:
    """Strict equality: of one type, or both missing; an array only equals itself."""
    both = _missing(a) & _missing(b)
    if a.kind != b.kind or a.kind in ("undefined", "null"):
        return both
    if a.kind == "array":
        return F.lit(True) if a.name == b.name else both
    return a.column.eqNullSafe(b.column)


def _number(v) -> str:
    return str(int(v)) if float(v).is_integer() else repr(v)


def _text(t: Term) -> Column:
    """A value as a script's String() gives it."""
    if t.kind in ("undefined", "null"):
        return F.lit(t.kind)
    if t.kind == "number" and t.name is None:
        return F.lit(_number(t.value))
    plain = F.array_join(t.column, ",") if t.kind == "array" else t.column.cast("string")
    return F.coalesce(plain, F.lit("undefined"))


def _truthy(a: Term) -> Column:
    if a.kind == "undefined":
        return F.lit(False)
    return _sure({"string": lambda c: c != "", "number": lambda c: c != 0, "boolean": lambda c: c, "array": lambda c: c.isNotNull()}[a.kind](a.column))


_COMPARE = {"gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le}


def condition(fields: dict[str, str], spec: dict) -> Column:
    """A condition as a boolean column that is never null; what types decide is folded here."""
    a, b, op = _term(fields, spec["field"]), _expected(fields, spec), spec["operator"]
    if op in ("eq", "neq"):
        return _equal(a, b) if op == "eq" else ~_equal(a, b)
    if op in ("truthy", "falsy"):
        return _truthy(a) if op == "truthy" else ~_truthy(a)
    if op == "startsWith":
        return _sure(a.column.startswith(b.column)) if a.kind == b.kind == "string" else F.lit(False)
    if op == "includes":
        if a.kind == "array":
            return _sure(F.array_contains(a.column, b.column)) if b.kind == "string" else F.lit(False)
        return _sure(F.contains(a.column, _text(b))) if a.kind == "string" else F.lit(False)
    return _sure(_COMPARE[op](a.column, b.column)) if a.kind == b.kind == "number" else F.lit(False)


def message(fields: dict[str, str], template: str) -> Column:
    """``${name}`` replaced: arrays joined by a comma and a space, missing values by nothing."""
    parts = []
    for k, piece in enumerate(re.split(r"\$\{([^}]+)\}", template)):
        if k % 2 == 0:
            parts.append(F.lit(piece))
        elif piece in fields:
            c = F.array_join(piece, ", ") if fields[piece] == "array" else F.col(piece).cast("string")
            parts.append(F.coalesce(c, F.lit("")))
    return F.concat(*parts)


def _json(kind: str, c: Column) -> Column:
    if kind in ("boolean", "number"):
        return c.cast("string")
    return F.to_json(c) if kind == "array" else F.regexp_extract(F.to_json(F.array(c)), r"(?s)\A\[(.*)\]\z", 1)


def _data(fields: dict[str, str], spec: dict | None) -> Column:
    if spec is None:
        return F.lit(None).cast("map<string,string>")
    known = {k: v["field"] for k, v in spec.items() if v["field"] in fields}
    entries = [F.struct(F.lit(k).alias("key"), F.when(F.col(f).isNotNull(), _json(fields[f], F.col(f))).alias("value")) for k, f in known.items()]
    if not entries:
        return F.create_map().cast("map<string,string>")
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))


def finding_parts(fields: dict[str, str], rule: dict) -> dict[str, Column]:
    """Columns of the finding that a rule makes of a record, without its provenance."""
    spec = rule["finding"]

    def ref(name: str, kind: str, cast: str) -> Column:
        f = spec.get(name, {}).get("field")
        return F.col(f).cast(cast) if f in fields and fields[f] == kind else F.lit(None).cast(cast)

    related = spec.get("related", {}).get("field")
    listed = F.lit(None).cast("array<string>")
    if related in fields and fields[related] == "array":
        listed = F.filter(related, lambda x: x.isNotNull())
    elif related in fields and fields[related] == "string":
        listed = F.when(F.col(related).isNotNull(), F.array(related))
    return {
        "code": F.lit(rule["code"]), "category": F.lit(spec["category"]), "level": F.lit(spec["level"]), "message": message(fields, spec["message"]),
        "file": ref("file", "string", "string"), "line": ref("line", "number", "int"), "related": listed, "data": _data(fields, spec.get("data")),
    }


def _provenance(code: Column) -> Column:
    evidence, derived = (F.when(F.size(c) > 0, F.col(c)) for c in ("__evidence", "__derived"))
    return E.provenance("derived", "architecture-rules", rule=code, evidence=evidence, derived=derived).alias("provenance")


def findings_of(records: DataFrame, rules: list[tuple[dict, Column | None]]) -> DataFrame:
    """Findings of one collection's rules, each with how often a match counts (None: once).

    The numbers of the rules that a record matches are exploded, and a finding's columns chosen by number afterwards:
    one scan, all in generated code, and a column that nobody reads is not made.
    """
    hits = []
    for k, (r, times) in enumerate(rules):
        fields = FIELDS[r["source"]]
        hit = functools.reduce(operator.and_, [condition(fields, c) for c in r.get("where", [])], F.lit(True))
        number = F.when(hit, k)
        hits.append(F.array(number) if times is None else F.array_repeat(number, times))
    matched = records.withColumn("__rule", F.explode(F.concat(*hits))).where("__rule IS NOT NULL")
    parts = [finding_parts(FIELDS[r["source"]], r) for r, _ in rules]
    chosen = {}
    for name in parts[0]:
        chosen[name] = functools.reduce(lambda c, k: c.when(F.col("__rule") == k, parts[k][name]), range(1, len(parts)), F.when(F.col("__rule") == 0, parts[0][name]))
    return matched.select(BY, *[c.alias(name) for name, c in chosen.items()], _provenance(chosen["code"]))


# ---------------------------------------------------------------- records


def _inside(zones: dict[str, dict], columns: list[Column]) -> Column:
    """Numbers, in order of ids, of the zones that a module (id, stable id, root) lies in."""
    return F.array_compact(F.array(*[F.when(globs.selects(columns, z["from"]), k) for k, (_, z) in enumerate(sorted(zones.items()))]))


def _barred(zones: dict[str, dict], columns: list[Column]) -> Column:
    """Numbers of the zones that may not depend on a module."""
    hits = []
    for k, (_, zone) in enumerate(sorted(zones.items())):
        denied = globs.selects(columns, zone.get("deny", []))
        hits.append(F.when(denied | ~globs.selects(columns, zone["allow"]) if "allow" in zone else denied, k))
    return F.array_compact(F.array(*hits))


def _violated(zones: dict[str, dict], inside: Column, barred: Column, a: Column, b: Column) -> Column:
    first, out = F.array_min(F.array_intersect(inside, barred)), F.lit(None).cast("struct<zone:string,message:string>")
    for k, (name, zone) in enumerate(sorted(zones.items())):
        text = F.lit(zone["message"]) if zone.get("message") else F.format_string(f"%s is not allowed to depend on %s in boundary zone '{name.replace('%', '%%')}'.", a, b)
        out = F.when(first == k, F.struct(F.lit(name).alias("zone"), text.alias("message"))).otherwise(out)
    return out


def boundary(zones: dict[str, dict] | None) -> Column:
    """Struct (zone, message) of the first zone, by id, that the pair of modules violates; null if none does.

    The modules' ids, stable ids and roots are in the structs ``from`` and ``to``.
    """
    a, b = ([F.col(f"{side}.{c}") for c in ("id", "stableId", "root")] for side in ("from", "to"))
    return _violated(zones, _inside(zones, a), _barred(zones, b), a[0], b[0]) if zones else F.lit(None).cast("struct<zone:string,message:string>")


def import_records(owned: DataFrame, modules: DataFrame, zones: dict[str, dict] | None = None) -> DataFrame:
    """Records of the imports.  A module alone decides which zones it lies in and which it is barred from, so selectors
    are tried on modules, each once, not on imports or pairs; the imports are read once."""
    if zones:
        columns = [F.col(c) for c in ("id", "stableId", "root")]
        for end, numbers in (("from", _inside), ("to", _barred)):
            met = modules.select(BY, F.col("id").alias(f"{end}Module"), numbers(zones, columns).alias(f"__{end}")).where(F.size(f"__{end}") > 0)
            owned = owned.join(met, [BY, f"{end}Module"], "left")
        pair = _violated(zones, F.col("__from"), F.col("__to"), F.col("fromModule"), F.col("toModule"))
        owned = owned.withColumn("b", F.when(F.col("fromModule") != F.col("toModule"), pair))
    else:
        owned = owned.withColumn("b", F.lit(None).cast("struct<zone:string,message:string>"))
    cross = _sure(F.col("fromModule") != F.col("toModule")) & (F.col("fromModule") != "") & (F.col("toModule") != "")
    line = F.col("location.line") if "location" in owned.columns else F.col("line")
    columns = {
        "line": line, "target": F.coalesce("toFile", "specifier"), "isInternal": F.col("resolution") == "internal", "isCrossModule": _sure(cross),
        "isUnresolvedInternal": (F.col("resolution") == "unresolved") & paths.is_local(F.col("specifier")), "isOutOfScope": F.col("resolution") == "out-of-scope",
        "isDynamic": F.col("importKind").isin("dynamic", "require"), "isBoundaryViolation": F.col("b").isNotNull(), "boundaryZone": F.col("b.zone"), "boundaryMessage": F.col("b.message"),
    }
    proof = F.array(E.evidence("source-edge", F.col("id"), F.col("fromFile"), line))
    own = [columns.get(f, F.col(f)).alias(f) for f in FIELDS["imports"]]
    return owned.select(BY, *own, F.array("id").alias("__derived"), proof.cast(E.EVIDENCE).alias("__evidence"))


def forbidden_times(forbidden: list[dict]) -> Column:
    """How many configured pairs an import record matches: a look-up in a literal, as the pairs are a driver's list."""
    counts = Counter((f["from"], f["to"]) for f in forbidden)
    if not counts:
        return F.lit(0)
    known = F.create_map(*[F.lit(x) for (a, b), n in sorted(counts.items()) for x in (f"{a}\0{b}", n)])
    return F.when(F.col("isInternal"), F.coalesce(F.try_element_at(known, F.concat_ws("\0", "fromModule", "toModule")), F.lit(0))).otherwise(0)


def forbidden_records(records: DataFrame, forbidden: list[dict]) -> DataFrame:
    """Internal import records, once for every configured pair that they match.

    Before pairs are looked up, each end has to be one that is configured: that much can be asked before imports are joined.
    """
    ends = [F.col(f"{side}Module").isin(*sorted({f[side] for f in forbidden})) for side in ("from", "to")] if forbidden else []
    near = records.where(functools.reduce(operator.and_, ends, F.col("isInternal")))
    return near.withColumn("__n", F.explode(F.array_repeat(F.lit(1), forbidden_times(forbidden)))).drop("__n")


def cycle_records(cycles: DataFrame) -> DataFrame:
    proof = F.transform("edgeIds", lambda i: E.evidence("module-edge", i))
    return cycles.select(BY, "id", "modules", "edgeIds", F.col("edgeIds").alias("__derived"), proof.cast(E.EVIDENCE).alias("__evidence"))


def module_records(modules: DataFrame) -> DataFrame:
    n = modules.groupBy(BY).agg(F.count("*").alias("n"))
    own = modules.join(n, BY)
    return own.select(BY, F.col("id").alias("moduleId"), (F.size("entrypoints") > 0).alias("hasPublicEntrypoint"), (F.col("n") > 1).alias("hasPeers"), F.array("id").alias("related"), F.array().cast("array<string>").alias("__derived"), F.array(E.evidence("module", F.col("id"))).cast(E.EVIDENCE).alias("__evidence"))


@dataclass(frozen=True)
class Context:
    flags: dict[str, bool]
    collections: dict[str, DataFrame]
    #: How often an import is a forbidden dependency, if that collection is made of the imports: both are scanned at once.
    forbidden: Column | None = None


def create_context(config: dict, owned: DataFrame, modules: DataFrame, cycles: DataFrame) -> Context:
    imports = import_records(owned, modules, config.get("boundaryZones"))
    flags = {"noCycles": config.get("noCycles", True), "noDeepImports": config.get("noDeepImports", True), "forbiddenDependencies": bool(config.get("forbiddenDependencies"))}
    pairs = config.get("forbiddenDependencies", [])
    return Context(flags, {"cycles": cycle_records(cycles), "imports": imports, "forbiddenDependencies": forbidden_records(imports, pairs), "modules": module_records(modules)}, forbidden_times(pairs))


def evaluate(registry: Registry, context: Context) -> DataFrame:
    """Findings of all rules whose flag is set: snapshot_id, code, category, level, message, file, line, related, data, provenance."""
    if missing := [f for f in registry.required_facts if f not in context.collections]:
        raise ValueError(f"Rule registry requires unavailable facts: {', '.join(missing)}.")
    built: dict[str, list] = {}
    for r in registry.rules:
        if not r.get("enabledBy") or context.flags.get(r["enabledBy"]) is True:
            joint = r["source"] == "forbiddenDependencies" and context.forbidden is not None and "imports" in context.collections
            built.setdefault("imports" if joint else r["source"], []).append((r, context.forbidden if joint else None))
    if not built:  # no rule is left: an empty table of the usual columns
        rule = {"code": "", "source": "cycles", "finding": {"category": "", "level": "", "message": ""}}
        return findings_of(context.collections["cycles"].where("false"), [(rule, None)])
    return functools.reduce(DataFrame.unionByName, [findings_of(context.collections[source], rules) for source, rules in sorted(built.items())])


def evaluate_rules(config: dict, owned: DataFrame, modules: DataFrame, cycles: DataFrame, selection=None) -> DataFrame:
    return evaluate(select_registry(config, selection), create_context(config, owned, modules, cycles))


# ---------------------------------------------------------------- order, keys, policies


def level_rank(level: str = "level") -> Column:
    return functools.reduce(lambda c, k: c.when(F.col(level) == LEVELS[k], k), range(1, 3), F.when(F.col(level) == LEVELS[0], 0))


def finding_order() -> list[Column]:
    return [level_rank(), F.col("code"), F.coalesce("file", F.lit("")), F.coalesce("line", F.lit(0)), F.col("message")]


def finding_key() -> Column:
    derived = F.coalesce(F.col("provenance.derivedFrom"), F.array().cast("array<string>"))
    head = F.array(F.col("code"), F.col("category"), F.coalesce("file", F.lit("")), F.coalesce(F.col("line").cast("string"), F.lit("0")), F.col("message"))
    return F.array_join(F.concat(head, derived), "\0")


def finding_digest() -> Column:
    """SHA-256 of the key, 32 bytes where the key holds texts twice over: to group and join by."""
    return F.unhex(F.sha2(finding_key(), 256))


# Other names of codes.
ALIASES = {"cycles": "architecture/cycle", "cycle": "architecture/cycle", "deep-imports": "architecture/deep-import", "deep-import": "architecture/deep-import", "forbidden-dependencies": "architecture/forbidden-dependency", "forbidden-dependency": "architecture/forbidden-dependency"}


def matches_fail_on(fail_on: list[str]) -> Column:
    """Findings that a policy selects: all or violations (by category), an alias, a code, a code without its prefix."""
    violation = F.col("category") == "violation"
    if not fail_on or "all" in fail_on:
        return violation if fail_on else F.lit(False)
    codes = sorted({ALIASES.get(s, s) for s in fail_on})
    chosen = F.col("code").isin(*codes) | F.replace(F.col("code"), F.lit("architecture/"), F.lit("")).isin(*codes)
    return violation | chosen if "violations" in fail_on else chosen


def data_json(value) -> dict:
    """A finding's data map with its JSON texts parsed."""
    return {k: json.loads(v) for k, v in value.items()}
