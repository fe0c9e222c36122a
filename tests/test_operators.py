"""Globs, paths, canonical JSON, edges, cycles, modules, differences, shapes."""

import copy
import json
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.functions import canonical, globs, paths
from graphloom.operators import cycles as G
from graphloom.operators import diff as D
from graphloom.operators import edges as E
from graphloom.operators import modules as M
from graphloom.sources import schemas, snapshots

EDGES = "snapshot_id string, id string, from string, to string"


@pytest.mark.parametrize(
    "pattern, yes, no",
    [
        ("src", ["src", "src/a", "src/a/b"], ["xsrc", "src2/a"]), ("src/**/*.ts", ["src/a.ts", "src/x/y/a.ts"], ["a.ts", "src/a.tsx"]), ("**/x", ["x", "a/x"], ["ax"]),
        ("./a?c", ["abc"], ["ac", "a/c", "abc/d"]), ("a*", ["a", "abc"], ["a/b"]), ("a**", ["a/b"], ["b"]), ("a+(b).ts", ["a+(b).ts"], ["aab.ts"]), ("a\\b", ["a/b", "a/b/c"], ["a"]), ("x.ts\n", ["x.ts\n"], ["x.ts"]),
    ],
)
def test_path_globs(spark, pattern, yes, no):
    df = spark.createDataFrame([(p,) for p in yes + no], "p string")
    got = [r[0] for r in df.select(globs.whole(F.col("p"), globs.path_regex(pattern))).collect()]
    assert got == [True] * len(yes) + [False] * len(no)


def test_scope(spark):
    df = spark.createDataFrame([(p,) for p in ("src/a.ts", "dist/a.ts", "src/node_modules/a.ts", "node_modules/a.ts", "src/gen/a.ts")], "p string")
    assert [r[0] for r in df.where(globs.in_scope(F.col("p"))).collect()] == ["src/a.ts", "src/node_modules/a.ts", "src/gen/a.ts"]
    assert [r[0] for r in df.where(globs.in_scope(F.col("p"), ["src"], ["src/gen"])).collect()] == ["src/a.ts", "src/node_modules/a.ts"]


def test_texts(spark):
    texts = ["", None, "a", "a\n", "a\r\nb", "\n\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(paths.line_count(F.col("t"))).collect()] == [0, 0, 1, 2, 2, 3]
    df = spark.createDataFrame([(t,) for t in ("a.PNG?x", "a.css#y", "#a.png", "a.pngx", "x.woff", "x.woff2", "a.png\n")], "t string")
    assert [r[0] for r in df.select(paths.is_asset(F.col("t"))).collect()] == [True, True, False, False, True, True, False]
    df = spark.createDataFrame([(t,) for t in ("a.d.ts", "a.d.mts", "a.TSX", "a.jsx", "a.json", "a.ts\n")], "t string")
    assert [r[0] for r in df.select(paths.is_source_file(F.col("t"))).collect()] == [False, True, True, True, False, False]


def test_canonical_json():
    value = {"b": [1, {"y": None, "x": "ü\u001f "}], "10": 1.0, "9": 2, "a": True, "\U0001f600": 1, "￿": 2}
    assert canonical.canonical_json(value) == '{"9":2,"10":1,"a":true,"b":[1,{"x":"ü\\u001f ","y":null}],"\U0001f600":1,"￿":2}'
    assert canonical.sha256("a") == "ac8d8342bbb2362d13f0a559a3621bb407011368895164b628a54f7fc33fc43c"


@settings(max_examples=50, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers(-(10**6), 10**6) | st.text(max_size=5), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3)))
def test_canonical_json_round_trip(value):
    text = canonical.canonical_json(value)
    assert json.loads(text) == value and canonical.canonical_json(json.loads(text)) == text


def test_longest_prefix(spark):
    files = spark.createDataFrame([("k", p) for p in ("src/a/x.ts", "src/ab/x.ts", "src/a/b/x.ts", "x.ts", "../y.ts")], "snapshot_id string, path string")
    roots = spark.createDataFrame([("k", "src/a", "A"), ("k", "src/a/b", "z"), ("k", "src/a/b", "B"), ("k", ".", "root"), ("other", "src", "no")], "snapshot_id string, root string, id string")
    assert {(r["file"], r["module"]) for r in E.longest_prefix(files, roots).collect()} == {("src/a/x.ts", "A"), ("src/ab/x.ts", "root"), ("src/a/b/x.ts", "B"), ("x.ts", "root")}


def test_occurrence_and_highest(spark):
    rows = [("k", "a", None, "static", "./x", False, 1), ("k", "a", None, "static", "./x", False, 2), ("k", "a", None, "static", "./x", True, 3), ("j", "a", None, "static", "./x", False, 1)]
    df = spark.createDataFrame(rows, "snapshot_id string, fromFile string, toFile string, importKind string, specifier string, typeOnly boolean, line int")
    got = {(r["snapshot_id"], r["line"]): r["id"] for r in E.occurrence(df, ["line"]).select("*", E.import_id(F.col("occurrence")).alias("id")).collect()}
    assert got == {("k", 1): "a\0\0static\0./x\0value\0" + "0", ("k", 2): "a\0\0static\0./x\0value\0" + "1", ("k", 3): "a\0\0static\0./x\0type\0" + "0", ("j", 1): "a\0\0static\0./x\0value\0" + "0"}
    fan = spark.createDataFrame([("k", "b", 2), ("k", "B", 2), ("k", "a", 1)], "snapshot_id string, module string, fan_in int")
    assert tuple(E.highest(fan, "fan_in", "top").first()["top"]) == ("b", 2)


def _brute(links):
    nodes = {x for e in links for x in e}
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in links:
            for n in nodes:
                if a in reach[n]:
                    reach[n] |= reach[b] | {b}
    return {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}


@pytest.mark.parametrize("seed", range(6))
def test_components_in_memory(seed):
    rng = random.Random(seed)
    links = sorted({(str(rng.randrange(9)), str(rng.randrange(9))) for _ in range(rng.randrange(1, 16))})
    assert G.components(links) == _brute(links)


def test_cycles_both_ways(spark):
    rng = random.Random(4)
    links = sorted({(str(rng.randrange(30)), str(rng.randrange(30))) for _ in range(38)})
    df = spark.createDataFrame([("k", f"{a}\0{b}", a, b) for a, b in links] + [("j", "a\0b", "a", "b")], EDGES)
    want = _brute(links)
    for local in (1000, 0):
        got = {r["module"]: r["component"] for r in G.strong_components(df, local).where("snapshot_id = 'k'").collect()}
        assert got == want
        found = G.cycles(df, local=local).collect()
        groups = {tuple(sorted(n for n in want if want[n] == c)) for c in set(want.values())}
        assert {tuple(r["modules"]) for r in found} == {g for g in groups if len(g) > 1}
        for r in found:
            assert r["edgeIds"] == sorted(f"{a}\0{b}" for a, b in links if {a, b} <= set(r["modules"]))


def test_a_long_chain_is_no_recursion():
    assert len(set(G.components([(f"{k:05}", f"{k + 1:05}") for k in range(20_000)]).values())) == 20_001


def test_long_circles_take_few_rounds(spark, monkeypatch):
    names = [f"{k:02}" for k in range(60)]
    ring = [("ring", a, b) for a, b in zip(names, names[1:] + names[:1])]
    mixed = random.Random(3).sample(names, len(names))
    ring += [("mixed", a, b) for a, b in zip(mixed, mixed[1:] + mixed[:1])] + [("path", a, b) for a, b in zip(names, names[1:])]
    rounds, written = [], G.written
    monkeypatch.setattr(G, "written", lambda df, name: rounds.append(name) or written(df, name))
    found = G.strong_components(spark.createDataFrame(ring, "snapshot_id string, from string, to string"), 0).collect()
    assert {(r["snapshot_id"], r["module"]): r["component"] for r in found} == {(s, n): n if s == "path" else "00" for s in ("ring", "mixed", "path") for n in names}
    assert rounds.count("labels") < 40


def test_no_edges(spark):
    none = spark.createDataFrame([], EDGES)
    assert G.cycles(none).count() == 0 and G.cycles(none, local=-1).count() == 0


def test_module_names_that_are_taken(spark):
    roots = spark.createDataFrame([("k", "src/a", "m", True), ("k", "src/m", "m", False), ("k", "m", "x", False), ("k", ".", "m", False)], "snapshot_id string, root string, base_id string, declared boolean").withColumn("public", F.lit(None).cast("array<string>"))
    got = {r["root"]: r["id"] for r in M.assign_ids(roots, "src").collect()}
    assert got == {"src/a": "m", ".": "root", "m": "x", "src/m": "m#2"}


def test_entrypoints(spark):
    files = spark.createDataFrame([("k", p) for p in ("src/a/index.ts", "src/a/deep/index.tsx", "src/b/x.ts", "src/b/Index.ts", "src/c/index.ts")], "snapshot_id string, path string")
    config = {"publicEntrypoints": {"b": ["./src/b/x.ts", "src/b/none.ts"], "c": []}}
    modules, owner = M.infer_modules(files, config, "src", ["src"])
    assert {r["id"]: r["entrypoints"] for r in modules.collect()} == {"a": ["src/a/deep/index.tsx", "src/a/index.ts"], "b": ["src/b/x.ts"], "c": []}
    assert owner.count() == 5


def test_diff_collection(spark):
    schema = "k string, v int, m map<string,string>, o int"
    before = spark.createDataFrame([("a", 1, {"x": "1", "y": "2"}, 1), ("b", 1, None, 1), ("c", 1, {}, 1), ("c", 2, {}, 2), ("d", None, None, 1)], schema)
    after = spark.createDataFrame([("a", 1, {"y": "2", "x": "1"}, 1), ("c", 3, {}, 1), ("d", None, None, 1), ("e", 1, None, 1)], schema)
    got = {r["key"]: (r["change"], r["before"] and r["before"]["v"], r["after"] and r["after"]["v"]) for r in D.diff_collection(before, after, "k", order="o").collect()}
    assert got == {"b": ("removed", 1, None), "c": ("changed", 2, 3), "e": ("added", None, 1)}
    assert D.diff_collection(before, after, "k", order="o", leave_out=["v"]).where("change = 'changed'").count() == 0


@pytest.fixture
def document():
    proof = {"origin": "observed"}
    f = lambda p, n: {"path": p, "language": "typescript", "lines": n, "provenance": proof}
    m = lambda i, r: {"id": i, "stableId": r, "root": r, "files": [f"{r}/index.ts"], "entrypoints": [], "provenance": proof}
    i = {"id": "i1", "fromFile": "src/a/index.ts", "toFile": "src/b/index.ts", "specifier": "../b", "importKind": "static", "resolution": "internal", "typeOnly": False, "location": {"line": 1, "column": 1}, "provenance": proof}
    edge = {"id": "a\0b", "from": "a", "to": "b", "imports": 1, "publicApiImports": 0, "deepImports": 1, "files": ["src/a/index.ts"], "sourceEdgeIds": ["i1"], "visibility": "deep", "provenance": proof}
    finding = {"code": "architecture/deep-import", "category": "violation", "level": "warning", "message": "m", "file": "src/a/index.ts", "line": 1, "data": {"n": 1, "l": ["x"]}, "provenance": {**proof, "derivedFrom": ["i1"]}}
    counts = {k: 1 for k in E.COUNTERS if k != "outOfScopeImports"}
    doc = {
        "irVersion": "0.3", "receipt": {"snapshotId": "", "tool": "graphloom", "toolVersion": "0.3.0", "irVersion": "0.3", "configHash": "a" * 64, "compilerOptionsHash": "b" * 64, "inputHash": "c" * 64},
        "project": {"root": ".", "tsconfig": "tsconfig.json", "sourceRoot": "src"}, "policy": {"failOn": [], "provenance": proof},
        "source": {"files": [f("src/a/index.ts", 1), f("src/b/index.ts", 1)], "imports": [i], "provenance": proof},
        "architecture": {"modules": [m("a", "src/a"), m("b", "src/b")], "ownership": [{"file": "src/a/index.ts", "module": "a", "provenance": proof}], "moduleEdges": [edge], "provenance": proof},
        "analysis": {"cycles": [{"id": "a\0b", "modules": ["a", "b"], "edgeIds": [], "provenance": proof}], "metrics": {**counts, "maxFanIn": None, "maxFanOut": {"module": "a", "value": 1}, "provenance": proof}, "findings": [finding], "provenance": proof},
    }
    doc["receipt"]["snapshotId"] = snapshots.snapshot_id(doc)
    return doc


def _signed(doc):
    doc["receipt"]["snapshotId"] = snapshots.snapshot_id(doc)
    return doc


def test_diff_of_documents(spark, document):
    from graphloom.plans import analyze, render

    same = analyze.diff_snapshots(spark, document, document)
    assert not same["hasRegressions"] and not any(part[k] for layer in ("source", "architecture") for part in same[layer].values() for k in part)
    now = copy.deepcopy(document)
    for m in now["architecture"]["modules"]:  # renamed modules keep their keys
        m["id"] = "new-" + m["id"]
    e = now["architecture"]["moduleEdges"][0]
    e.update({"id": "x", "from": "new-a", "to": "new-b"})
    now["analysis"]["cycles"][0]["modules"] = ["new-a", "new-b"]
    now["source"]["imports"][0]["location"]["line"] = 11
    now["analysis"]["findings"][0]["line"] = 11
    now["analysis"]["metrics"]["imports"] = 3
    d = analyze.diff_snapshots(spark, document, _signed(now), "v1", "v2")
    assert [len(d["source"]["imports"][k]) for k in ("added", "removed", "changed")] == [0, 0, 1]
    assert [len(d["architecture"]["modules"][k]) for k in ("added", "removed", "changed")] == [0, 0, 2] == [len(d["architecture"]["moduleEdges"][k]) for k in ("added", "removed")] + [2]
    assert not d["analysis"]["cycles"]["added"] and len(d["introducedViolations"]) == len(d["resolvedViolations"]) == 1 and d["hasRegressions"]
    assert d["introducedViolations"][0]["data"] == {"n": 1, "l": ["x"]} and d["analysis"]["metrics"]["imports"] == {"before": 1, "after": 3, "delta": 2}
    text = render.diff_text(d)
    assert text.startswith("Architecture diff: v1 → v2\nPolicy: report-only\n") and "~ src/a/index.ts → src/b/index.ts changed" in text and "- imports: 1 → 3 (+2)" in text
    now["receipt"]["configHash"] = "d" * 64
    with pytest.raises(analyze.SnapshotComparisonError, match="not comparable: analysis configuration differs"):
        analyze.diff_snapshots(spark, document, _signed(now))


def test_snapshot_checks(spark, document, tmp_path):
    path = tmp_path / "s.json"
    path.write_text(json.dumps(document))
    assert snapshots.load_snapshot(str(path)) == document
    path.write_text(json.dumps({**document, "policy": {**document["policy"], "failOn": ["all"]}}))
    with pytest.raises(snapshots.SnapshotReceiptError):
        snapshots.load_snapshot(str(path))
    broken = copy.deepcopy(document)
    broken["source"]["files"][0]["lines"] = -1
    broken["more"] = 1
    with pytest.raises(snapshots.SnapshotShapeError, match=r'source.files.0.lines: Too small.*<root>: Unrecognized key: "more"'):
        snapshots.validate_snapshot(broken)
    with pytest.raises(snapshots.SnapshotShapeError, match="irVersion"):
        snapshots.validate_snapshot({**document, "irVersion": "0.2"})
    with pytest.raises(snapshots.SnapshotShapeError, match="receipt.tool"):
        snapshots.validate_snapshot(document, tool="another")
    path.write_text("{")
    with pytest.raises(ValueError, match="Could not read architecture snapshot"):
        snapshots.load_snapshot(str(path))
    t = snapshots.tables(spark, document)
    snapshots.write_tables({k: v for k, v in t.items() if k != "snapshots"}, str(tmp_path / "store"))
    back = snapshots.read_tables(spark, str(tmp_path / "store"), document["receipt"]["snapshotId"])
    assert back["findings"].first()["data"] == {"n": "1", "l": '["x"]'} and back["imports"].first()["location"]["line"] == 1


def test_shapes():
    assert schemas.issues(schemas.CONFIG, {}) == ""
    assert schemas.issues(schemas.CONFIG, {"noCycles": "yes"}) == "noCycles: Invalid input: expected boolean, received string"
    assert "boundaryZones.z.from: Too small" in schemas.issues(schemas.CONFIG, {"boundaryZones": {"z": {"from": []}}})
    assert schemas.issues(schemas.CONFIG, {"moduleIdStrategy": "long"}) == 'moduleIdStrategy: Invalid option: expected one of "compact"|"relative-path"'
    assert "forbiddenDependencies.0.to" in schemas.issues(schemas.CONFIG, {"forbiddenDependencies": [{"from": "a"}]})


def test_imports_without_target_are_dealt(spark):
    """They have no key in common, so that no task gets all of them; what owners they have stays the same."""
    rows = [("s", f"f{k}", f"f{k + 1}" if k % 4 == 0 else None) for k in range(400)] + [("s", "f1", "\0f3"), ("s", "f2", "away")]
    imports = spark.createDataFrame(rows, "snapshot_id string, fromFile string, toFile string")
    owners = spark.createDataFrame([("s", f"f{k}", f"m{k % 3}") for k in range(401)] + [("s", "\0f3", "odd")], "snapshot_id string, file string, module string")
    public = owners.where("module = 'm1'").select("snapshot_id", "module", "file")
    own = {r["file"]: r["module"] for r in owners.collect()}
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "4"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        found = E.owned_imports(imports, owners, public).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = sorted((f, t or "", own[f], own.get(t) or "", own.get(t) == "m1") for _, f, t in rows)
    assert sorted((r["fromFile"], r["toFile"] or "", r["fromModule"], r["toModule"] or "", r["isPublicApi"]) for r in found) == want
    sizes = Counter(r["task"] for r in found if r["toFile"] is None)
    assert len(sizes) == 4 and max(sizes.values()) < 150


@pytest.mark.parametrize("snapshots", [["all"], ["s", "1:s", ":"]])
def test_tasks_do_not_grow_with_stored_imports(spark, tmp_path, monkeypatch, snapshots):
    """Stored imports are dealt by their size, once a join, not over the session's number of partitions alone."""
    rows = [(s, f"f{k}" if k % 50 else None, f"f{k * 7 % 900}" if k % 3 else None) for s in snapshots for k in range(2400)] + [(snapshots[-1], "f1" + snapshots[0], "away")]
    own = [(s, f"f{k}", f"{s}/m{k % 5}") for s in snapshots for k in range(800)] + [(snapshots[0], "f1" + snapshots[-1], "odd")]
    spark.createDataFrame(rows, "s string, fromFile string, toFile string").coalesce(1).write.parquet(f"{tmp_path}/imports")
    spark.createDataFrame(own, "s string, file string, module string").coalesce(1).write.parquet(f"{tmp_path}/owners")
    name = F.lit("all") if len(snapshots) == 1 else F.col("s")
    imports, owners = (spark.read.parquet(f"{tmp_path}/{t}").withColumn("snapshot_id", name).drop("s") for t in ("imports", "owners"))
    public, known = owners.where("module LIKE '%m1'").select("snapshot_id", "module", "file"), {(s, f): m for s, f, m in own}
    monkeypatch.setattr(E, "SHARE", 1000, raising=False)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "4"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        owned = E.owned_imports(imports, owners, public)
        counts = E.edge_counts(owned.withColumn("resolution", F.lit("internal"))).collect()
        found = owned.withColumn("task", F.spark_partition_id()).collect()
        plan = owned._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = [(s, f or "", t or "", known.get((s, f)) or "", known.get((s, t)) or "", (known.get((s, t)) or "").endswith("m1")) for s, f, t in rows]
    assert sorted((r["snapshot_id"], r["fromFile"] or "", r["toFile"] or "", r["fromModule"] or "", r["toModule"] or "", r["isPublicApi"]) for r in found) == sorted(want)
    pairs = Counter((s, a, b) for s, _, t, a, b, _ in want if t and a and b and a != b)
    assert {(r["snapshot_id"], r["from"], r["to"]): r["imports"] for r in counts} == pairs
    sizes = Counter(r["task"] for r in found if r["fromFile"])
    assert len(sizes) > 8 and max(sizes.values()) < len(rows) / 8
    assert plan.count("REPARTITION_BY_NUM") == 4 and plan.count("SortMergeJoin") == 3 and plan.count("ENSURE_REQUIREMENTS") == 3


def test_known_keys_do_not_gather_rows(spark, tmp_path, monkeypatch):
    """Rows meet the list of known keys dealt by size where the list is too large to travel whole, and as they lie where it is not."""
    rows = [(k, k * 11 % 700 if k % 40 else None) for k in range(3000)]
    spark.createDataFrame(rows, "id int, key int").coalesce(1).write.parquet(f"{tmp_path}/rows")
    spark.createDataFrame([(k,) for k in [*range(500), 3, None]], "known int").coalesce(1).write.parquet(f"{tmp_path}/known")
    monkeypatch.setattr(E, "SHARE", 1000)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "4"}
    before = {k: spark.conf.get(k) for k in conf}
    for limit in ("-1", "10MB"):
        for k, v in (conf | {"spark.sql.autoBroadcastJoinThreshold": limit}).items():
            spark.conf.set(k, v)
        try:
            met = E.among(spark.read.parquet(f"{tmp_path}/rows"), "key", spark.read.parquet(f"{tmp_path}/known")).withColumn("task", F.spark_partition_id())
            found, plan = met.collect(), met._jdf.queryExecution().executedPlan().toString()
        finally:
            for k, v in before.items():
                spark.conf.set(k, v)
        assert sorted((r["id"], r["key"]) for r in found) == [(a, b) for a, b in rows if b is not None and b < 500]
        if limit == "-1":
            sizes = Counter(r["task"] for r in found)
            assert len(sizes) > 8 and max(sizes.values()) < len(rows) / 8 and plan.count("Exchange") == 2
        else:
            assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
