"""Reports of snapshots and differences: text, JSON, DOT, SARIF."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import rules
from ..operators.edges import BY, COUNTERS
from ..sources.schemas import TOOL, TOOL_VERSION

# ---------------------------------------------------------------- DOT

# Frame of the DOT document.
DOT_HEAD = ["digraph architecture {", "  rankdir=LR;", '  graph [fontname="sans-serif", bgcolor="transparent"];', '  node [shape=box, fontname="sans-serif"];', '  edge [fontname="sans-serif"];']


def _quoted(text: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), text, F.lit('"'))


def dot_lines(modules: DataFrame, edges: DataFrame, cycles: DataFrame) -> DataFrame:
    """``(snapshot_id, part, key, line)``: nodes (part 0) and edges (part 1); members of cycles are marked."""
    member = cycles.select(BY, F.explode("modules").alias("id")).distinct().withColumn("marked", F.lit(True))
    n = F.size("files")
    label = F.concat("id", F.lit("\n"), n.cast("string"), F.when(n == 1, " file").otherwise(" files"))
    mark = F.when(F.col("marked"), ', color="#dc2626", penwidth="2"').otherwise("")
    nodes = modules.join(member, [BY, "id"], "left").select(BY, F.lit(0).alias("part"), F.col("id").alias("key"), F.concat(F.lit("  "), _quoted(F.col("id")), F.lit(" [label="), _quoted(label), mark, F.lit("];")).alias("line"))
    share = F.when(F.col("publicApiImports") == F.col("imports"), "").otherwise(F.concat_ws("", "publicApiImports", F.lit("/"), "imports", F.lit(" ")))
    text = F.concat(F.col("imports").cast("string"), F.lit(" ("), share, F.lit("public API)"))
    links = edges.select(BY, F.lit(1).alias("part"), F.col("id").alias("key"), F.concat(F.lit("  "), _quoted(F.col("from")), F.lit(" -> "), _quoted(F.col("to")), F.lit(" [label="), _quoted(text), F.lit("];")).alias("line"))
    return nodes.unionByName(links)


def dot(modules: DataFrame, edges: DataFrame, cycles: DataFrame) -> str:
    """The DOT document of one snapshot, as long as it has modules and edges."""
    lines = dot_lines(modules, edges, cycles).orderBy("part", "key").select("line").collect()
    return "\n".join([*DOT_HEAD, *(r[0] for r in lines), "}"]) + "\n"


# ---------------------------------------------------------------- SARIF


def _sarif_level(level: Column) -> Column:
    return F.when(level == "info", "note").otherwise(level)


def sarif_rules(findings: DataFrame) -> DataFrame:
    """``(code, level)``: every code once, with the level of its first finding by key."""
    return findings.groupBy("code").agg(F.min_by("level", rules.finding_key()).alias("level")).withColumn("level", _sarif_level(F.col("level")))


def sarif_results(findings: DataFrame) -> DataFrame:
    """Columns of the results, and the fingerprint: the hash of the key as a JSON text."""
    key = rules.finding_key()
    return findings.select("code", _sarif_level(F.col("level")).alias("level"), F.when(F.col("category") == "violation", "fail").otherwise("informational").alias("kind"), "message", "file", "line", "data", key.alias("key"))


def sarif_log(findings: DataFrame, tool: str = TOOL, fingerprint: str = "graphloomFinding") -> dict[str, Any]:
    from ..functions.canonical import sha256

    results = []
    for r in sarif_results(findings).orderBy("key").collect():
        out: dict[str, Any] = {"ruleId": r["code"], "level": r["level"], "kind": r["kind"], "message": {"text": r["message"]}}
        data = None if r["data"] is None else rules.data_json(r["data"])
        if r["file"]:
            place: dict[str, Any] = {"artifactLocation": {"uri": r["file"]}}
            if r["line"]:
                column = (data or {}).get("column")
                number = isinstance(column, (int, float)) and not isinstance(column, bool) and column
                place["region"] = {"startLine": r["line"]} | ({"startColumn": column} if number else {})
            out["locations"] = [{"physicalLocation": place}]
        out["partialFingerprints"] = {fingerprint: sha256(r["key"])}
        if data is not None:
            out["properties"] = data
        results.append(out)
    listed = [{"id": r["code"], "shortDescription": {"text": r["code"]}, "defaultConfiguration": {"level": r["level"]}} for r in sarif_rules(findings).orderBy("code").collect()]
    return {"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{"tool": {"driver": {"name": tool, "version": TOOL_VERSION, "rules": listed}}, "results": results}]}


def pretty(value: Any) -> str:
    return json.dumps(value, indent=2, ensure_ascii=False) + "\n"


def sarif(findings: DataFrame, **names) -> str:
    return pretty(sarif_log(findings, **names))


# ---------------------------------------------------------------- text


def short_import(i: dict) -> str:
    return f"{i['fromFile']} → {i.get('toFile') or i['specifier']}"


def short_finding(f: dict) -> str:
    place = f" ({f['file']}{':%d' % f['line'] if f.get('line') else ''})" if f.get("file") else ""
    return f"[{f['level']}] {f['code']}: {f['message']}{place}"


def _policy(fail_on: list[str]) -> str:
    return "Policy: " + (", ".join(fail_on) or "report-only")


def text(snapshot: dict) -> str:
    m, findings = snapshot["analysis"]["metrics"], snapshot["analysis"]["findings"]
    top = lambda t: f"{t['module']} ({t['value']})" if t else "-"
    lines = [
        "Architecture inspection",
        f"Project: {snapshot['project']['root']}",
        f"Snapshot: {snapshot['receipt']['snapshotId']}",
        f"Files: {m['sourceFiles']}",
        f"Modules: {m['modules']}",
        f"Imports: {m['imports']} ({m['internalImports']} internal, {m['externalImports']} external, {m['assetImports']} assets, {m['unresolvedImports']} unresolved, {m.get('outOfScopeImports', 0)} out-of-scope)",
        f"Module edges: {m['moduleEdges']}",
        f"Cycles: {m['cycles']}",
        f"Deep imports: {m['deepImports']}",
        f"Max fan-in: {top(m['maxFanIn'])}",
        f"Max fan-out: {top(m['maxFanOut'])}",
        _policy(snapshot["policy"]["failOn"]),
    ]
    return "\n".join(lines + (["", "Findings:", *(f"- {short_finding(f)}" for f in findings)] if findings else []))


def diff_text(diff: dict) -> str:
    lines = [f"Architecture diff: {diff['base']} → {diff['current']}", _policy(diff["policy"]["failOn"])]
    arrow = lambda a, b: lambda x: f"{x[a]} → {x[b]}"
    sections = [
        ("Modules", diff["architecture"]["modules"], lambda x: x["id"]), ("Files", diff["source"]["files"], lambda x: x["path"]),
        ("Module ownership", diff["architecture"]["ownership"], arrow("file", "module")), ("Module edges", diff["architecture"]["moduleEdges"], arrow("from", "to")),
        ("Import edges", diff["source"]["imports"], short_import), ("Cycles", {**diff["analysis"]["cycles"], "changed": []}, lambda x: ", ".join(x["modules"])), ("Findings", diff["analysis"]["findings"], short_finding),
    ]
    for title, part, show in sections:
        own = [f"+ {show(x)}" for x in part["added"]] + [f"- {show(x)}" for x in part["removed"]] + [f"~ {show(x['after'])} changed" for x in part["changed"]]
        lines += ["", f"{title}:", *own] if own else []
    moved = [f"- {k}: {v['before']} → {v['after']} ({v['delta']:+d})" for k, v in diff["analysis"]["metrics"].items() if v["delta"]]
    lines += ["", "Metrics:", *moved] if moved else []
    return "\n".join([*lines, "", "Result: regressions introduced" if diff["hasRegressions"] else "Result: no introduced violations"])


# ---------------------------------------------------------------- documents


def _plain(value: Any) -> Any:
    """A row as JSON data: null fields are left out."""
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items() if v is not None}
    return [_plain(v) for v in value] if isinstance(value, list) else value


def record(name: str, row: Any) -> dict:
    """A row of a snapshot's table as its document has it."""
    row = row.asDict() if hasattr(row, "asDict") else dict(row)
    row.pop(BY, None)
    data = row.pop("data", None)
    out = _plain(row)
    if data is not None:
        out["data"] = rules.data_json(data)
    if name == "metrics":
        out = {k: out.get(k, 0) for k in COUNTERS} | {"maxFanIn": out.get("maxFanIn"), "maxFanOut": out.get("maxFanOut"), "provenance": out["provenance"]}
    return out


def diff_document(diff: dict[str, DataFrame], fail_on: list[str], base: str = "base", current: str = "current", version: str = "0.3") -> dict:
    """A difference as one document, ordered by key."""

    def part(name: str, table: str | None = None) -> dict:
        out: dict[str, list] = {"added": [], "removed": [], "changed": []}
        for r in diff[name].orderBy("key").collect():
            before, after = (None if r[s] is None else record(name, {k: v for k, v in r[s].asDict().items() if k != "__key"}) for s in ("before", "after"))
            out[r["change"]].append({"before": before, "after": after} if r["change"] == "changed" else after if r["change"] == "added" else before)
        return out

    def violations(name: str) -> list[dict]:
        return [record("findings", {k: v for k, v in r.asDict().items() if k != "key"}) for r in diff[name].orderBy("key").collect()]

    deltas = {r["metric"]: {"before": r["before"], "after": r["after"], "delta": r["delta"]} for r in diff["metrics"].collect()}
    out = {
        "irVersion": version, "base": base, "current": current, "policy": {"failOn": list(fail_on)}, "comparability": {"status": "comparable", "reasons": []},
        "source": {"files": part("files"), "imports": part("imports")},
        "architecture": {"modules": part("modules"), "ownership": part("ownership"), "moduleEdges": part("module_edges")},
        "analysis": {"cycles": part("cycles"), "findings": part("findings"), "metrics": {k: deltas[k] for k in COUNTERS}},
        "introducedViolations": violations("introduced"), "resolvedViolations": violations("resolved"),
    }
    return out | {"hasRegressions": bool(out["analysis"]["cycles"]["added"] or out["introducedViolations"])}
