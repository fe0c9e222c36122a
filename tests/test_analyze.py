"""End-to-end analyses of generated projects."""

import json
import subprocess

import pytest

from graphloom import analyze_git_ref, analyze_project
from graphloom.plans import analyze, cli, render


def by(rows, key):
    return {r[key]: r for r in rows}


def test_sample_project(spark, sample):
    s = analyze_project(spark, sample())
    assert [m["id"] for m in s["architecture"]["modules"]] == ["garden", "robot", "util", "weather"]
    counted = {k: s["analysis"]["metrics"][k] for k in ("sourceFiles", "imports", "internalImports", "moduleEdges", "deepImports", "cycles")}
    assert counted == {"sourceFiles": 7, "imports": 8, "internalImports": 8, "moduleEdges": 5, "deepImports": 3, "cycles": 1}
    assert [s["analysis"]["metrics"][k] for k in ("maxFanIn", "maxFanOut")] == [{"module": "weather", "value": 2}, {"module": "garden", "value": 2}]
    found = {i["specifier"]: (i["resolution"], i["toFile"], i["location"]["line"], i["typeOnly"]) for i in s["source"]["imports"]}
    assert found["@garden"] == ("internal", "src/features/garden/index.ts", 1, False)
    assert found["~weather/model/forecast"] == ("internal", "src/features/weather/model/forecast.ts", 1, True)
    assert found["../weather/model/forecast"][2:] == (2, False)
    shown = {(e["from"], e["to"]): (e["imports"], e["publicApiImports"], e["visibility"]) for e in s["architecture"]["moduleEdges"]}
    assert shown == {("garden", "robot"): (1, 1, "public"), ("garden", "weather"): (1, 0, "deep"), ("robot", "util"): (1, 0, "deep"), ("robot", "weather"): (1, 0, "deep"), ("util", "garden"): (1, 1, "public")}
    assert [c["modules"] for c in s["analysis"]["cycles"]] == [["garden", "robot", "util"]]
    codes = [f["code"].split("/")[1] for f in s["analysis"]["findings"]]
    assert codes.count("cycle") == 1 and codes.count("deep-import") == 3
    assert by(s["source"]["files"], "path")["src/features/garden/beds.ts"]["lines"] == 5


def test_same_project_gives_same_bytes(spark, sample):
    a, b = (render.pretty(analyze_project(spark, sample(name=n))) for n in ("one", "two"))
    assert a == b


def test_scope_declared_module_and_assets(spark, make_project):
    files = {
        "src/money/ledger/api.ts": "export const total = 7;\n", "src/money/ledger/rows/table.ts": "export const rows = [];\n", "src/money/drafts/old.ts": 'import "nowhere";\n',
        "src/money/main.ts": 'import "./ledger.svg";\nimport { rows } from "./ledger/rows/table";\nexport { total } from "./ledger/api";\n',
    }
    config = {"exclude": ["**/drafts/**"], "modules": {"books": {"root": "src/money/ledger", "publicEntrypoints": ["src/money/ledger/api.ts"]}}}
    s = analyze_project(spark, make_project(files, config))
    origin = {m["id"]: m["provenance"]["origin"] for m in s["architecture"]["modules"]}
    assert origin.pop("books") == "declared" and list(origin.values()) == ["inferred"]
    (other,) = origin
    m = s["analysis"]["metrics"]
    assert [m[k] for k in ("sourceFiles", "imports", "assetImports", "internalImports", "unresolvedImports", "deepImports")] == [3, 3, 1, 2, 0, 1]
    (edge,) = s["architecture"]["moduleEdges"]
    assert [edge[k] for k in ("from", "to", "imports", "publicApiImports", "visibility")] == [other, "books", 2, 1, "mixed"]
    assert any(f["code"] == "architecture/deep-import" for f in s["analysis"]["findings"])


def test_colliding_names_and_strategy(spark, make_project):
    files = {f"src/{kind}/{name}/index.ts": "" for kind in ("modules", "features") for name in ("mail", "queue")} | {"src/features/lamp/index.ts": ""}
    s = analyze_project(spark, make_project(files))
    assert [m["id"] for m in s["architecture"]["modules"]] == ["features/mail", "features/queue", "lamp", "modules/mail", "modules/queue"]
    assert {m["stableId"] for m in s["architecture"]["modules"]} == {p.rsplit("/", 1)[0] for p in files}
    s = analyze_project(spark, make_project(files, {"moduleIdStrategy": "relative-path"}, name="two"))
    assert "features/lamp" in {m["id"] for m in s["architecture"]["modules"]}


def test_out_of_scope_dynamic_and_external(spark, make_project):
    files = {
        "src/a.ts": 'import { h } from "./hidden";\nimport "left-pad";\nimport fs from "node:fs";\nconst p = (n: string) => import(`./pages/${n}.js`);\nrequire(h);\nrequire("./missing");\n',
        "src/hidden.ts": "export const h = 'x';\n", 
    }
    s = analyze_project(spark, make_project(files, {"include": ["src/a.ts"]}))
    seen = {(i["specifier"], i["resolution"], i["resolutionConfidence"]) for i in s["source"]["imports"]}
    assert seen == {("./hidden", "out-of-scope", "exact"), ("left-pad", "external", "syntactic"), ("node:fs", "external", "exact"), ("./pages/*.js", "unresolved", "ambiguous"), ("<dynamic>", "unresolved", "ambiguous"), ("./missing", "unresolved", "ambiguous")}
    assert next(i for i in s["source"]["imports"] if i["specifier"] == "./hidden")["toFile"] == "src/hidden.ts"
    codes = [f["code"].split("/")[1] for f in s["analysis"]["findings"]]
    assert sorted(codes) == ["dynamic-import-ambiguous"] * 3 + ["out-of-scope-import"] + ["unresolved-import"] * 2


def test_boundary_zone(spark, make_project):
    files = {"src/modules/ui/index.ts": 'import "../infra";\nimport "../domain";\n', "src/modules/infra/index.ts": "", "src/modules/domain/index.ts": ""}
    zones = {"ui": {"from": ["ui"], "allow": ["domain"], "deny": ["infra"], "message": "UI must use domain."}}
    found = [f for f in analyze_project(spark, make_project(files, {"boundaryZones": zones}))["analysis"]["findings"] if f["code"].endswith("boundary-violation")]
    assert len(found) == 1 and found[0]["message"] == "UI must use domain." and found[0]["data"]["boundaryZone"] == "ui" and found[0]["related"] == ["infra"]


def test_bad_configuration(spark, sample):
    with pytest.raises(ValueError, match="noCycles"):
        analyze_project(spark, sample({"noCycles": "yes"}))


def test_configured_rules(spark, sample):
    def rule(code, name):
        return {"code": code, "source": "imports", "where": [{"field": "isInternal", "operator": "eq", "value": True}], "finding": {"category": "observation", "level": "info", "message": "${fromModule} imports ${toModule}."}}

    pack = {"id": "own", "version": "1", "requiredFacts": ["imports"], "rules": [rule("own/packed", "x")]}
    found = analyze_project(spark, sample({"rules": [rule("own/internal", "x")], "rulePacks": [pack]}))["analysis"]["findings"]
    assert sum(f["code"] == "own/internal" for f in found) == sum(f["code"] == "own/packed" for f in found) == 8
    assert any(f["message"] == "util imports garden." for f in found)


def test_references_extends_and_package(spark, make_project, tmp_path):
    root = make_project({"src/a.ts": 'import "pkg/x";\nimport "@s/p";\nimport "../lib/b";\n', "lib/b.ts": "", "node_modules/pkg/x.js": "", "node_modules/@s/p/index.js": ""})
    (tmp_path / "project/lib/tsconfig.json").write_text('{"extends": "../base.json", /* c */ "include": ["*.ts"],}')
    (tmp_path / "project/base.json").write_text('{"compilerOptions": {"allowJs": true}}')
    main = json.loads((tmp_path / "project/tsconfig.json").read_text())
    (tmp_path / "project/tsconfig.json").write_text(json.dumps(main | {"references": [{"path": "lib"}]}))
    s = analyze_project(spark, root)
    assert [f["path"] for f in s["source"]["files"]] == ["lib/b.ts", "src/a.ts"]
    assert {i["specifier"]: (i["resolution"], i["resolutionConfidence"]) for i in s["source"]["imports"]} == {"pkg/x": ("external", "exact"), "@s/p": ("external", "exact"), "../lib/b": ("internal", "exact")}


def test_places_above_the_project(spark, make_project):
    files = {"src/main.ts": 'import "../../../shared/index";\nimport "../../../shared/none";\nimport "hoisted";\nimport "@org/deep/part";\nimport "absent";\n', "../../shared/index.ts": "", "../../node_modules/hoisted/index.js": "", "../node_modules/@org/deep/part.js": ""}
    s = analyze_project(spark, make_project(files, name="mono/packages/app"))
    got = {i["specifier"]: (i["resolution"], i["resolutionConfidence"], i.get("toFile")) for i in s["source"]["imports"]}
    assert got == {
        "../../../shared/index": ("out-of-scope", "exact", "../../shared/index.ts"), "../../../shared/none": ("unresolved", "ambiguous", None),
        "hoisted": ("external", "exact", None), "@org/deep/part": ("external", "exact", None), "absent": ("external", "syntactic", None),
    }


def test_command_line(spark, sample, tmp_path):
    root = sample()
    out, code = cli.run(["graph", root], spark)
    assert code == 0 and out.startswith("digraph architecture {") and '"garden" [label="garden\\n3 files", color="#dc2626", penwidth="2"];' in out
    assert '"util" -> "garden" [label="1 (public API)"];' in out and '"robot" -> "weather" [label="1 (0/1 public API)"];' in out
    assert cli.run(["check", root], spark)[1] == 0
    assert cli.run(["check", root, "--fail-on", "deep-imports"], spark)[1] == 1
    out, _ = cli.run(["inspect", root], spark)
    assert "Imports: 8 (8 internal, 0 external, 0 assets, 0 unresolved, 0 out-of-scope)" in out and "Policy: report-only" in out
    log = json.loads(cli.run(["inspect", root, "--sarif"], spark)[0])
    assert log["version"] == "2.1.0" and log["runs"][0]["results"][0]["level"] == "error"
    assert len(log["runs"][0]["tool"]["driver"]["rules"]) == 3
    bad = sample({"noCycles": "yes"}, name="bad")
    out, code = cli.run(["inspect", bad, "--json"], spark)
    assert code == 2 and json.loads(out)["code"] == "ANALYSIS_ERROR"
    assert cli.run(["fly"], spark)[1] == 2 and cli.run(["help"], spark)[1] == 0
    assert cli.run(["graph", root, "--sarif"], spark)[1] == 2 and cli.run(["check", root, "--json", "--sarif"], spark)[1] == 2


def test_audit_against_snapshot_and_git(spark, make_project, tmp_path):
    files = {"src/modules/a/index.ts": 'import "../b";\n', "src/modules/b/index.ts": "", "src/modules/b/deep.ts": ""}
    root = make_project(files)
    git = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@example.org", *a], cwd=root, check=True, capture_output=True)
    git("init", "-q")
    git("add", "-A")
    git("commit", "-qm", "base")
    baseline = str(tmp_path / "base.json")
    assert cli.run(["inspect", root, "--json", "--out", baseline], spark)[1] == 0
    out, code = cli.run(["audit", baseline, root], spark)
    assert code == 0 and out.endswith("Result: no introduced violations\n")
    make_project({"src/modules/b/index.ts": 'import "../a";\n', "src/modules/a/index.ts": 'import "../b";\nimport "../b/deep";\n'})
    out, code = cli.run(["audit", baseline, root], spark)
    assert code == 1 and "+ b → a" in out and "+ a, b" in out and "Result: regressions introduced" in out and "- imports: 1 → 3 (+2)" in out
    diff = json.loads(cli.run(["diff", "HEAD", root, "--json"], spark)[0])
    assert diff["hasRegressions"] and len(diff["introducedViolations"]) == 2 and diff["analysis"]["metrics"]["cycles"]["delta"] == 1
    assert analyze_git_ref(spark, "HEAD", root)["analysis"]["metrics"]["imports"] == 1
    with pytest.raises(ValueError, match="Could not analyze Git ref 'nope'"):
        analyze_git_ref(spark, "nope", root)


def test_incomparable(spark, sample):
    a, b = analyze_project(spark, sample()), analyze_project(spark, sample({"noCycles": False}, name="two"))
    with pytest.raises(analyze.SnapshotComparisonError, match="analysis configuration differs"):
        analyze.diff_snapshots(spark, a, b)
