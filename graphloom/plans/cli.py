"""Command line: inspect, graph, check, diff and audit."""

from __future__ import annotations

import json
import os
import sys
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import SparkSession

from ..operators import rules
from ..sources import snapshots
from . import analyze, render

COMMANDS = ("inspect", "graph", "check", "diff", "audit", "help", "--help", "-h")
USAGE = """Usage:
  graphloom inspect [project] [--json|--sarif] [--out <file>]
  graphloom graph [project] [--json] [--out <file>]
  graphloom check [project] [--json|--sarif] [--out <file>] [--fail-on <selector,...>]
  graphloom diff <git-ref|snapshot.json> [project] [--json|--sarif] [--out <file>] [--check] [--fail-on <selector,...>]
  graphloom audit [git-ref|snapshot.json] [project] [--json|--sarif] [--out <file>] [--fail-on <selector,...>]

Selectors: all, violations, cycles, deep-imports, forbidden-dependency, or the code of a rule.
check only reports unless --fail-on or the project's failOn selects findings.
audit fails on violations that the base does not have.
Exit codes: 0 fine, 1 selected findings, 2 error, 3 snapshots that can't be compared."""


@dataclass
class Arguments:
    command: str = "inspect"
    project: str = "."
    base: str = "HEAD"
    json: bool = False
    sarif: bool = False
    check: bool = False
    fail_on: list[str] | None = None
    out: str | None = None


def parse(args: list[str]) -> Arguments:
    """Unknown options are ignored; values of --fail-on add up."""
    a = Arguments(args[0] if args else "inspect")
    if a.command not in COMMANDS:
        raise ValueError(f"Unknown command '{a.command}'.\n\n{USAGE}")
    rest, places, selectors = list(args[1:]), [], []
    while rest:
        x = rest.pop(0)
        if x in ("--out", "-o"):
            if not rest or rest[0].startswith("--") or not rest[0]:
                raise ValueError("--out requires a file path.")
            a.out = rest.pop(0)
        elif x == "--fail-on" or x.startswith("--fail-on="):
            if x == "--fail-on" and (not rest or not rest[0] or rest[0].startswith("--")):
                raise ValueError("--fail-on requires a comma-separated selector list.")
            value = rest.pop(0) if x == "--fail-on" else x.partition("=")[2]
            selectors += [s.strip() for s in value.split(",") if s.strip()]
            a.fail_on = sorted(set(selectors))
        elif not x.startswith("--"):
            places.append(x)
    a.json, a.sarif = "--json" in args, "--sarif" in args
    if a.json and a.sarif:
        raise ValueError("--json and --sarif are mutually exclusive output formats.")
    if a.sarif and a.command == "graph":
        raise ValueError("--sarif is not available for the graph command.")
    if a.command in ("diff", "audit"):
        a.check = a.command == "audit" or "--check" in args
        a.base, places = places[0] if places else "HEAD", places[1:]
    a.project = places[0] if places else "."
    return a


def _selected(spark: SparkSession, findings: list[dict], fail_on: list[str]) -> bool:
    """Whether the policy selects one of the findings of a document."""
    rows = [(f["code"], f["category"]) for f in findings]
    return bool(rows) and bool(spark.createDataFrame(rows, "code string, category string").where(rules.matches_fail_on(fail_on)).take(1))


def _findings_table(spark: SparkSession, document: dict, findings: list[dict]):
    return snapshots.tables(spark, {**document, "analysis": {**document["analysis"], "findings": findings}})["findings"]


def _compare(spark: SparkSession, a: Arguments) -> tuple[str, int]:
    current = analyze.analyze_project(spark, a.project)
    before = snapshots.load_snapshot(a.base) if os.path.isfile(a.base) else analyze.analyze_git_ref(spark, a.base, a.project)
    diff = analyze.diff_snapshots(spark, before, current, a.base, "working tree")
    if a.sarif:
        shown = diff["introducedViolations"] if a.command == "audit" else diff["analysis"]["findings"]["added"]
        output = render.sarif(_findings_table(spark, current, shown))
    else:
        output = render.pretty(diff) if a.json else render.diff_text(diff) + "\n"
    if a.out:
        Path(a.out).write_text(output if a.sarif else render.pretty(diff), "utf-8")
    policy = a.fail_on if a.fail_on is not None else ["all"] if a.check else current["policy"]["failOn"]
    failed = (a.check or a.fail_on is not None) and _selected(spark, diff["introducedViolations"], policy)
    return output, int(failed)


def _inspect(spark: SparkSession, a: Arguments) -> tuple[str, int]:
    snapshot = analyze.analyze_project(spark, a.project)
    if a.sarif:
        output = render.sarif(_findings_table(spark, snapshot, snapshot["analysis"]["findings"]))
    elif a.json:
        output = render.pretty(snapshot)
    elif a.command == "graph":
        t = snapshots.tables(spark, snapshot)
        output = render.dot(t["modules"], t["module_edges"], t["cycles"])
    else:
        output = render.text(snapshot) + "\n"
    if a.out:
        Path(a.out).write_text(output if a.sarif or a.command == "graph" and not a.json else render.pretty(snapshot), "utf-8")
    policy = snapshot["policy"]["failOn"] if a.fail_on is None else a.fail_on
    return output, int(a.command == "check" and _selected(spark, snapshot["analysis"]["findings"], policy))


def run(args: list[str], spark: SparkSession | None = None) -> tuple[str, int]:
    """What a command prints, and its exit code; errors are part of the output."""
    try:
        a = parse(args)
        if a.command in ("help", "--help", "-h"):
            return USAGE + "\n", 0
        spark = spark or SparkSession.builder.appName("graphloom").getOrCreate()
        return (_compare if a.command in ("diff", "audit") else _inspect)(spark, a)
    except Exception as e:  # noqa: BLE001  (every failure has the same envelope)
        apart = isinstance(e, analyze.SnapshotComparisonError)
        text = json.dumps({"error": True, "code": e.code if apart else "ANALYSIS_ERROR", "message": str(e)}, ensure_ascii=False, separators=(",", ":")) if "--json" in args else str(e)
        return text + "\n", 3 if apart else 2


def main() -> None:
    output, code = run(sys.argv[1:])
    (sys.stderr if code >= 2 and "--json" not in sys.argv else sys.stdout).write(output)
    sys.exit(code)


if __name__ == "__main__":
    main()
