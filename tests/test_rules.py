"""Predicates, templates, registry, boundaries, policies."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators import rules as R

FIELDS = {"s": "string", "t": "string", "n": "number", "b": "boolean", "a": "array", "c": "array"}
ROWS = [
    ("abc", "abc", 5, True, ["a"], ["a"]),
    ("", "x", 0, False, [], ["x"]),
    (None, None, None, None, None, None),
]
OMIT = object()


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(ROWS)], "i int, s string, t string, n int, b boolean, a array<string>, c array<string>")


CASES = [
    ("s", "eq", "abc", [1, 0, 0]), ("s", "eq", "", [0, 1, 0]), ("s", "eq", None, [0, 0, 0]), ("s", "neq", None, [1, 1, 1]), ("s", "eq", OMIT, [0, 0, 1]), ("s", "neq", OMIT, [1, 1, 0]),
    ("n", "eq", 5, [1, 0, 0]), ("n", "eq", "5", [0, 0, 0]), ("n", "neq", "5", [1, 1, 1]), ("b", "eq", True, [1, 0, 0]), ("b", "eq", False, [0, 1, 0]), ("b", "eq", 1, [0, 0, 0]),
    ("a", "eq", "a", [0, 0, 0]), ("a", "eq", {"field": "a"}, [1, 1, 1]), ("a", "eq", {"field": "c"}, [0, 0, 1]), ("s", "eq", {"field": "t"}, [1, 0, 1]), ("s", "eq", {"field": "n"}, [0, 0, 1]),
    ("s", "eq", {"field": "nope"}, [0, 0, 1]), ("nope", "eq", OMIT, [1, 1, 1]), ("nope", "neq", "x", [1, 1, 1]),
    ("s", "truthy", OMIT, [1, 0, 0]), ("n", "truthy", OMIT, [1, 0, 0]), ("b", "truthy", OMIT, [1, 0, 0]), ("a", "truthy", OMIT, [1, 1, 0]), ("nope", "truthy", OMIT, [0, 0, 0]),
    ("s", "falsy", OMIT, [0, 1, 1]), ("n", "falsy", OMIT, [0, 1, 1]), ("b", "falsy", OMIT, [0, 1, 1]), ("a", "falsy", OMIT, [0, 0, 1]), ("nope", "falsy", OMIT, [1, 1, 1]),
    ("s", "startsWith", "a", [1, 0, 0]), ("s", "startsWith", "", [1, 1, 0]), ("s", "startsWith", {"field": "t"}, [1, 0, 0]), ("n", "startsWith", "5", [0, 0, 0]), ("s", "startsWith", 1, [0, 0, 0]),
    ("s", "includes", "b", [1, 0, 0]), ("a", "includes", "a", [1, 0, 0]), ("a", "includes", 1, [0, 0, 0]), ("c", "includes", {"field": "t"}, [0, 1, 0]), ("s", "includes", OMIT, [0, 0, 0]), ("n", "includes", "5", [0, 0, 0]),
    ("n", "gt", 0, [1, 0, 0]), ("n", "gte", 0, [1, 1, 0]), ("n", "lt", 5, [0, 1, 0]), ("n", "lte", 5, [1, 1, 0]), ("n", "gt", "0", [0, 0, 0]), ("s", "gt", 0, [0, 0, 0]), ("n", "lt", OMIT, [0, 0, 0]), ("n", "gte", {"field": "n"}, [1, 1, 0]), ("n", "lt", 0.5, [0, 1, 0]),
]


def test_predicates(rows):
    found = [R.condition(FIELDS, {"field": f, "operator": op} | ({} if v is OMIT else {"value": v})).alias(f"c{k}") for k, (f, op, v, _) in enumerate(CASES)]
    got = rows.select("i", *found).orderBy("i").collect()
    for k, case in enumerate(CASES):
        assert [int(r[f"c{k}"]) for r in got] == case[3], case[:3]


def test_includes_of_missing_value_searches_its_name(spark):
    df = spark.createDataFrame([("is undefined", True)], "s string, b boolean")
    own = {"s": "string", "b": "boolean"}
    assert df.where(R.condition(own, {"field": "s", "operator": "includes"})).count() == 1
    assert df.where(R.condition(own, {"field": "s", "operator": "includes", "value": {"field": "b"}})).count() == 0


def test_message(rows):
    got = [r[0] for r in rows.select(R.message(FIELDS, "$${s}|${n}|${b}|${a}|${nope}|{s}")).collect()]
    assert got == ["$abc|5|true|a||{s}", "$|0|false|||{s}", "$|||||{s}"]


def test_finding_parts(rows, monkeypatch):
    monkeypatch.setitem(R.FIELDS, "imports", FIELDS)
    rule = {"code": "x", "source": "imports", "finding": {"category": "violation", "level": "error", "message": "m", "file": {"field": "n"}, "line": {"field": "n"}, "related": {"field": "s"}, "data": {"q": {"field": "s"}, "l": {"field": "a"}, "z": {"field": "nope"}}}}
    other = {"code": "y", "source": "imports", "where": [{"field": "b", "operator": "truthy"}], "finding": {"category": "observation", "level": "info", "message": "${a}", "related": {"field": "a"}}}
    df = rows.withColumns({"snapshot_id": F.lit("k"), "__derived": F.array(F.lit("e")), "__evidence": F.array().cast("array<struct<kind:string,id:string,file:string,line:int>>")})
    found = R.findings_of(df, [(rule, None), (other, F.lit(2))]).collect()
    got = sorted((r for r in found if r["code"] == "x"), key=lambda r: str(r["line"]))
    assert [g["file"] for g in got] == [None] * 3 and [(g["line"], g["related"], g["data"]) for g in got] == [(0, [""], {"q": '""', "l": "[]"}), (5, ["abc"], {"q": '"abc"', "l": '["a"]'}), (None, None, {})]
    assert got[0]["provenance"]["derivedFrom"] == ["e"] and got[0]["provenance"]["evidence"] is None and got[0]["provenance"]["rule"] == "x"
    assert [(r["message"], r["related"], r["data"]) for r in found if r["code"] == "y"] == [("a", ["a"], None)] * 2


def _spec(code="own/a", source="imports", **more):
    return {"code": code, "source": source, "finding": {"category": "observation", "level": "info", "message": "m"}, **more}


def test_registry():
    pack = {"id": "own", "version": "1", "requiredFacts": ["imports"], "rules": [_spec()]}
    r = R.create_registry([pack, R.BUILTIN_RULE_PACK])
    assert [p["id"] for p in r.packs] == ["graphloom/core", "own"] and len(r.rules) == 9
    assert r.required_facts == ["cycles", "forbiddenDependencies", "imports", "modules"]
    for bad, text in (([pack, pack], "Duplicate rule pack id"), ([pack, {**pack, "id": "two"}], "Duplicate rule code"), ([{**pack, "requiredFacts": []}], "does not declare required fact 'imports'"), ([{**pack, "extra": 1}], "Invalid rule pack: 0: Unrecognized key"), ([{**pack, "rules": [_spec(where=[{"field": "x", "operator": "like"}])]}], "Invalid rule pack: 0.rules.0.where.0.operator")):
        with pytest.raises(ValueError, match=text):
            R.create_registry(bad)
    assert [p["id"] for p in R.select_registry({}, [_spec()]).packs] == ["runtime/inline"]
    assert [p["id"] for p in R.select_registry({"rules": [_spec()]}).packs] == ["graphloom/core", "project/rules"]
    with pytest.raises(ValueError, match="Invalid rule specification: 0.source"):
        R.select_registry({}, [_spec(source="nothing")])
    with pytest.raises(ValueError, match="unavailable facts: cycles"):
        R.evaluate(R.create_registry([R.BUILTIN_RULE_PACK]), R.Context({}, {"imports": None, "forbiddenDependencies": None, "modules": None}))


def test_gates_and_no_rules(spark):
    cycles = spark.createDataFrame([("k", "a\0b", ["a", "b"], ["e"])], "snapshot_id string, id string, modules array<string>, edgeIds array<string>")
    registry = R.select_registry({}, [r for r in R.BUILTIN_RULES if r["source"] == "cycles"])
    records = {"cycles": R.cycle_records(cycles)}
    assert R.evaluate(registry, R.Context({"noCycles": False}, records)).count() == 0
    found = R.evaluate(registry, R.Context({"noCycles": True}, records)).collect()
    assert found[0]["message"] == "Module dependency strongly-connected component: a, b." and found[0]["data"] == {"modules": '["a","b"]', "edgeIds": '["e"]'}


@pytest.mark.parametrize(
    "zone, expected",
    [
        ({"from": ["a"], "deny": ["b"]}, "z"), ({"from": ["a"], "deny": ["c"]}, None), ({"from": ["a"], "allow": []}, "z"), ({"from": ["a"]}, None), ({"from": ["b"], "deny": ["b"]}, None),
        ({"from": ["src/**"], "allow": ["src/mod*/b"]}, None), ({"from": ["src/modules/?"], "deny": ["**/b"]}, "z"), ({"from": ["src\\modules\\a"], "allow": ["b"], "deny": ["b"]}, "z"),
    ],
)
def test_zones(spark, zone, expected):
    m = lambda i: f"named_struct('id', '{i}', 'stableId', CAST(NULL AS STRING), 'root', 'src/modules/{i}')"
    got = spark.sql(f"SELECT {m('a')} AS `from`, {m('b')} AS `to`").select(R.boundary({"z": zone}).alias("b")).first()["b"]
    assert (got and got["zone"]) == expected
    if got:
        assert got["message"] == "a is not allowed to depend on b in boundary zone 'z'."


def test_first_zone_and_empty_message(spark):
    m = lambda i: f"named_struct('id', '{i}', 'stableId', '{i}', 'root', '{i}')"
    zones = {"y": {"from": ["a"], "deny": ["b"], "message": "second"}, "B": {"from": ["a"], "deny": ["b"], "message": ""}}
    got = spark.sql(f"SELECT {m('a')} AS `from`, {m('b')} AS `to`").select(R.boundary(zones).alias("b")).first()["b"]
    assert tuple(got) == ("B", "a is not allowed to depend on b in boundary zone 'B'.")


def test_policies(spark):
    df = spark.createDataFrame([("architecture/cycle", "violation"), ("architecture/deep-import", "violation"), ("own/x", "observation")], "code string, category string")
    chosen = lambda p: sorted(r[0] for r in df.where(R.matches_fail_on(p)).collect())
    assert chosen([]) == [] and chosen(["all"]) == chosen(["violations"]) == ["architecture/cycle", "architecture/deep-import"]
    assert chosen(["cycles"]) == chosen(["cycle"]) == chosen(["architecture/cycle"]) == ["architecture/cycle"]
    assert chosen(["own/x", "deep-imports"]) == ["architecture/deep-import", "own/x"] and chosen(["violations", "own/x"]) == ["architecture/cycle", "architecture/deep-import", "own/x"] and chosen(["all", "own/x"]) == chosen(["all"])
