"""What travels: how often imports are read, which columns and rows reach a join, and what is sorted how often."""

import re

import pytest
from pyspark.sql import functions as F

from graphloom.operators import edges as E
from graphloom.operators import rules as R
from graphloom.plans import queries, trade

DATA = "/root/testdata/sf0.001"


def plan(df) -> list[str]:
    return df._jdf.queryExecution().optimizedPlan().toString().split("\n")


def below_joins(df) -> list[str]:
    lines = plan(df)
    return lines[next(k for k, x in enumerate(lines) if " Join " in x or x.startswith("Join ")) :]


def test_texts_of_imports_are_made_after_the_joins(spark):
    owned = trade.owned(spark, DATA).select("id", "specifier", "importKind", "fromModule", "toModule")
    assert any("@scope/part" in x for x in plan(owned)) and not any("@scope/part" in x or "dynamic" in x for x in below_joins(owned))


def test_line_items_travel_by_order_and_target_only(spark):
    """Files and customers meet orders: no join of line items has a file that imports as its key."""
    lines = plan(trade.owned(spark, DATA))
    joins = [k for k, x in enumerate(lines) if "Join " in x and any("l_orderkey" in y and "Relation" in y for y in lines[k:])]
    assert [x for x in (lines[k] for k in joins) if "fromFile" in x and "__key" not in x and "toFile" not in x and "o_orderkey" not in x] == [] and joins


def test_line_items_and_orders_meet_known_files_by_size(spark, monkeypatch):
    """Where suppliers or customers are too many to travel whole, no task's part of the line items or orders grows with them."""
    want = sorted(map(tuple, queries.QUERIES["rule_falsy"](spark, DATA).collect()))
    monkeypatch.setattr(E, "SHARE", 10_000)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "4"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        found = queries.QUERIES["rule_falsy"](spark, DATA)
        dealt = dict(re.findall(r"hashpartitioning\((l_suppkey|o_custkey)#\d+L, (\d+)\)", found._jdf.queryExecution().executedPlan().toString()))
        got = sorted(map(tuple, found.collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(dealt) == 2 and int(dealt["l_suppkey"]) > 8 and int(dealt["o_custkey"]) > 4
    assert got == want


@pytest.mark.parametrize("zones", [None, queries.ZONES])
def test_zones_read_imports_once(spark, zones):
    records = R.import_records(trade.owned(spark, DATA), trade.modules(spark, DATA), zones).select("id", "boundaryZone", "boundaryMessage")
    assert sum("Relation" in x and "l_orderkey" in x for x in plan(records)) == 1


def test_forbidden_ends_are_asked_before_imports_are_joined(spark):
    lines = below_joins(queries.forbidden_dependencies(spark, DATA))
    assert any("IN (NATION_1,NATION_5)" in x for x in lines) and any("IN (NATION_0,NATION_2)" in x for x in lines)


def test_forbidden_pairs(spark):
    rows = [("a", "b", True), ("a", "b", False), ("a", "c", True), ("b", "a", True), (None, "b", True), ("a", None, True), ("c", "c", True)]
    records = spark.createDataFrame(rows, "fromModule string, toModule string, isInternal boolean")
    pairs = [{"from": "a", "to": "b"}, {"from": "a", "to": "b", "message": "m"}, {"from": "c", "to": "c"}]
    assert sorted(tuple(r) for r in R.forbidden_records(records, pairs).collect()) == [("a", "b", True)] * 2 + [("c", "c", True)]
    assert R.forbidden_records(records, []).collect() == []


def test_findings_are_counted_by_short_keys(spark):
    assert any("unhex(sha2(" in x for x in plan(queries.finding_keys(spark, DATA)))
    assert dict(queries.finding_keys(spark, DATA).dtypes) == {"key": "string", "n": "bigint"}


@pytest.mark.parametrize("name", ["introduced_violations", "resolved_violations", "has_regressions"])
def test_differences_carry_what_is_answered(spark, name):
    rows = [x for x in plan(queries.QUERIES[name](spark, DATA)) if "Project [" in x and " AS row#" in x]
    assert len(rows) == 2 and not any("provenance" in x or "data" in x for x in rows)


def test_places_need_one_shuffle(spark):
    rows = spark.range(0, 5000, 1, 7).select((F.col("id") * 37 % 500).alias("a"), (F.col("id") % 3).cast("string").alias("b"))
    found = queries.numbered(rows, ["a", "b"], "place")
    assert not any(x.strip(" :+-").startswith("Window") and "row_number" in x for x in plan(found))
    got = [(r["place"], r["a"], r["b"]) for r in found.orderBy("place").collect()]
    want = sorted((r["a"], r["b"]) for r in rows.collect())
    assert got == [(k + 1, *r) for k, r in enumerate(want)] and set(found.columns) == {"a", "b", "place"} and dict(found.dtypes)["place"] == "bigint"
