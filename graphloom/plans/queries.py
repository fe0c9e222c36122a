"""Queries over the star schema, one or more for every operator that tables can show, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import globs, paths
from ..operators import cycles as G
from ..operators import diff as D
from ..operators import edges as E
from ..operators import modules as M
from ..operators import rules as R
from ..sources import extract, resolve
from . import render, trade
from .session import written
from .trade import TRADE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, with_trade: bool = True):
    """Register a query under its function's name; its SQL may use the tables of ``TRADE``."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            recursive = "RECURSIVE " if "reach" in sql else ""
            SQL[f.__name__] = f"WITH {recursive}{TRADE}{'' if sql.lstrip().startswith(',') else ' '}{sql}" if with_trade else sql
        return f

    return add


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows with their place (from 1) in the order of the columns: sorted by ranges, written once, and numbered from the
    place in their task and the sizes of the tasks before (a row each, hence the hint)."""
    dealt = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    dealt = dealt.select("*", F.shiftright("__at", 33).alias("__range"))
    sizes = dealt.groupBy("__range").agg(F.count("*").alias("n"))
    before = sizes.select("__range", F.coalesce(F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    within = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return dealt.join(F.broadcast(before), "__range").withColumn(name, within + F.col("__before")).drop("__range", "__before", "__at")


def _edges(spark, d) -> DataFrame:
    return E.edge_counts(trade.owned(spark, d))


# ---------------------------------------------------------------- edges and metrics


@query("SELECT fromModule AS src, toModule AS dst, imports, publicApi AS public_api, deep, files AS n_files, CASE WHEN publicApi > 0 AND deep > 0 THEN 'mixed' WHEN publicApi > 0 THEN 'public' ELSE 'deep' END AS visibility FROM edges")
def module_edges(spark, d):
    return _edges(spark, d).select(F.col("from").alias("src"), F.col("to").alias("dst"), "imports", F.col("publicApiImports").alias("public_api"), F.col("deepImports").alias("deep"), F.col("files").alias("n_files"), "visibility")


@query(", ids AS (SELECT DISTINCT fromModule, toModule, id FROM owned WHERE resolution = 'internal' AND fromModule <> toModule) SELECT fromModule AS src, toModule AS dst, count(*) AS n_ids, sha256(string_agg(id, ';' ORDER BY id)) AS ids FROM ids GROUP BY ALL")
def edge_provenance(spark, d):
    derived = F.col("provenance.derivedFrom")
    return E.module_edges(trade.owned(spark, d)).select(F.col("from").alias("src"), F.col("to").alias("dst"), F.size(derived).cast("long").alias("n_ids"), F.sha2(F.array_join(derived, ";"), 256).alias("ids"))


@query("SELECT DISTINCT fromModule AS src, toModule AS dst, id, fromFile AS file FROM owned WHERE resolution = 'internal' AND fromModule <> toModule")
def edge_members(spark, d):
    return E.edge_members(trade.owned(spark, d)).select(F.col("from").alias("src"), F.col("to").alias("dst"), "id", F.col("fromFile").alias("file"))


@query("SELECT CASE WHEN publicApi > 0 AND deep > 0 THEN 'mixed' WHEN publicApi > 0 THEN 'public' ELSE 'deep' END AS visibility, count(*) AS n FROM edges GROUP BY 1")
def edge_visibility(spark, d):
    return _edges(spark, d).groupBy("visibility").agg(F.count("*").alias("n"))


_FANS = ", fan AS (SELECT id AS module, (SELECT count(*) FROM edges WHERE toModule = id) AS fan_in, (SELECT count(*) FROM edges WHERE fromModule = id) AS fan_out FROM mods)"


@query(_FANS + " SELECT * FROM fan")
def fan_in_out(spark, d):
    return E.fans(trade.modules(spark, d), _edges(spark, d)).drop("snapshot_id")


def _highest(spark, d, column):
    return E.highest(E.fans(trade.modules(spark, d), _edges(spark, d)), column, "top").select("top.module", F.col("top.value").alias(column))


@query(_FANS + " SELECT module, fan_in FROM fan ORDER BY fan_in DESC, module LIMIT 1")
def max_fan_in(spark, d):
    return _highest(spark, d, "fan_in")


@query(_FANS + " SELECT module, fan_out FROM fan ORDER BY fan_out DESC, module LIMIT 1")
def max_fan_out(spark, d):
    return _highest(spark, d, "fan_out")


def _metrics(spark, d, where="true"):
    owned = trade.owned(spark, d).where(where)
    edges, mods = G.cut(E.edge_counts(owned).select("snapshot_id", "id", "from", "to", "deepImports")), trade.modules(spark, d)
    return E.metrics(mods, trade.files(spark, d), mods, trade.resolved(spark, d).where(where), edges, G.cycles(edges))


@query("SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM mods) AS modules, count(*) AS imports, count(*) FILTER (resolution = 'internal') AS internal, count(*) FILTER (resolution = 'external') AS \"external\", count(*) FILTER (resolution = 'asset') AS asset, count(*) FILTER (resolution = 'unresolved') AS unresolved, count(*) FILTER (resolution = 'out-of-scope') AS out_of_scope, (SELECT count(*) FROM edges) AS edges, (SELECT sum(deep)::BIGINT FROM edges) AS deep_imports FROM owned")
def import_metrics(spark, d):
    names = dict(zip(("files", "modules", "imports", "internal", "external", "asset", "unresolved", "out_of_scope", "edges", "deep_imports"), [c for c in E.COUNTERS if c != "cycles"]))
    return _metrics(spark, d).select(*[F.col(v).alias(k) for k, v in names.items()])


@query("SELECT coalesce(sum(deep), 0)::BIGINT AS deep_imports FROM edges")
def deep_import_total(spark, d):
    return _edges(spark, d).agg(F.coalesce(F.sum("deepImports"), F.lit(0)).alias("deep_imports"))


@query(", seen AS (SELECT *, row_number() OVER (PARTITION BY fromFile, coalesce(toFile, ''), importKind, specifier, typeOnly ORDER BY ord, line, part, l_extendedprice, quantity) - 1 AS occurrence FROM imports) SELECT fromFile AS src, coalesce(toFile, '') AS dst, importKind AS kind, specifier, typeOnly AS type_only, ord, line, occurrence, concat_ws('|', fromFile, coalesce(toFile, ''), importKind, specifier, CASE WHEN typeOnly THEN 'type' ELSE 'value' END, occurrence) AS id FROM seen")
def import_occurrence(spark, d):
    seen = E.occurrence(trade.resolved(spark, d), ["order", "line", "part", "l_extendedprice", "quantity"])
    id = F.translate(E.import_id(F.col("occurrence")), "\0", "|")
    return seen.select(F.col("fromFile").alias("src"), F.coalesce("toFile", F.lit("")).alias("dst"), F.col("importKind").alias("kind"), "specifier", F.col("typeOnly").alias("type_only"), F.col("order").alias("ord"), "line", F.col("occurrence").cast("long").alias("occurrence"), id.alias("id"))


# ---------------------------------------------------------------- classification and paths


@query("SELECT resolution, importKind AS kind, line, count(*) AS n FROM imports GROUP BY ALL")
def resolution_class(spark, d):
    return trade.resolved(spark, d).groupBy("resolution", F.col("importKind").alias("kind"), "line").agg(F.count("*").alias("n"))


@query("SELECT confidence, importKind AS kind, line, count(*) AS n FROM imports GROUP BY ALL")
def confidence_class(spark, d):
    return trade.resolved(spark, d).groupBy(F.col("resolutionConfidence").alias("confidence"), F.col("importKind").alias("kind"), "line").agg(F.count("*").alias("n"))


@query("SELECT specifier, count(*) AS n FROM raw WHERE regexp_matches(lower(regexp_extract(specifier, '^[^?#]*')), '\\.(png|scss|css|svg|jpe?g)$') GROUP BY 1")
def asset_filter(spark, d):
    return trade.imports(spark, d).where(paths.is_asset(F.col("specifier"))).groupBy("specifier").agg(F.count("*").alias("n"))


@query("SELECT specifier IN ('fs', 'node:path') AS builtin, regexp_matches(specifier, '^[./#]') AS local, count(*) AS n FROM raw GROUP BY ALL")
def specifier_kind(spark, d):
    s = F.col("specifier")
    return trade.imports(spark, d).groupBy(paths.is_builtin(s).alias("builtin"), paths.is_local(s).alias("local")).agg(F.count("*").alias("n"))


@query("SELECT path, CASE WHEN regexp_matches(path, '\\.(jsx?|mjs|cjs)$', 'i') THEN 'javascript' ELSE 'typescript' END AS language FROM files WHERE regexp_matches(path, '\\.(tsx?|mts|cts|jsx?|mjs|cjs)$', 'i') AND NOT path LIKE '%.d.ts'")
def language_class(spark, d):
    p = F.col("path")
    return trade.files(spark, d).where(paths.is_source_file(p)).select("path", paths.language(p).alias("language"))


@query("SELECT path FROM files WHERE (path LIKE 'src/asia/%' OR regexp_matches(path, '^src/[^/]*/nation_1[^/]/.*$')) AND NOT (regexp_matches(path, '^(.*/)?[^/]*\\.test\\.ts$') OR regexp_matches(path, '^src/asia/nation_2/.*$'))")
def glob_scope(spark, d):
    scope = globs.in_scope(F.col("path"), ["src/asia", "./src/*/nation_1?/**"], ["**/*.test.ts", "src\\asia\\nation_2"])
    return trade.files(spark, d).where(scope).select("path")


@query("SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(string_split(text, chr(10))) END AS n_lines FROM documents", with_trade=False)
def line_count(spark, d):
    return trade.table(spark, d, "documents").select("doc_id", paths.line_count(F.col("text")).cast("long").alias("n_lines"))


@query('SELECT doc_id, sha256(\'"\' || replace(replace(replace(text, chr(92), chr(92) || chr(92)), \'"\', chr(92) || \'"\'), chr(10), chr(92) || \'n\') || \'"\') AS hash FROM documents', with_trade=False)
def content_hash(spark, d):
    quoted = F.regexp_extract(F.to_json(F.array("text")), r"(?s)\A\[(.*)\]\z", 1)
    return trade.table(spark, d, "documents").select("doc_id", F.sha2(quoted, 256).alias("hash"))


@query("SELECT page_id, i AS place, m AS href FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS m, generate_subscripts(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1), 1) - 1 AS i FROM pages)", with_trade=False)
def href_extract(spark, d):
    found = trade.table(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("place", "href"))
    return found.withColumn("place", F.col("place").cast("long"))


# ---------------------------------------------------------------- joins


def _roots(spark, d) -> DataFrame:
    """Regions and every second nation as roots, so that files below differ in their deepest one."""
    mods = trade.modules(spark, d)
    region = F.substring_index("root", "/", 2)
    regions = mods.select("snapshot_id", F.concat(F.lit("R:"), region).alias("id"), region.alias("root")).distinct()
    return mods.where("key % 2 = 0").select("snapshot_id", "id", "root").unionByName(regions)


@query(", roots AS (SELECT id, root FROM mods WHERE key % 2 = 0 UNION SELECT 'R:' || regexp_extract(root, '^src/[^/]*'), regexp_extract(root, '^src/[^/]*') FROM mods) SELECT path AS file, (SELECT id FROM roots WHERE starts_with(path, root || '/') ORDER BY length(root) DESC, id LIMIT 1) AS module FROM files")
def longest_prefix_owner(spark, d):
    return E.longest_prefix(trade.files(spark, d), _roots(spark, d)).select("file", "module")


@query("SELECT fromModule AS src, coalesce(toModule, '') AS dst, isPublicApi AS public, count(*) AS n FROM owned GROUP BY ALL")
def public_api_flag(spark, d):
    return trade.owned(spark, d).groupBy(F.col("fromModule").alias("src"), F.coalesce("toModule", F.lit("")).alias("dst"), F.col("isPublicApi").alias("public")).agg(F.count("*").alias("n"))


ZONES = {
    "asia-only": {"from": ["src/asia/**"], "allow": ["src/asia/*", "NATION_1?"], "message": "Asia stays in Asia."},
    "no-europe": {"from": ["src/*/nation_1*", "NATION_3"], "deny": ["src/europe/**"]},
}
_PAIRS = ", pairs AS (SELECT f.id AS a, t.id AS b, f.root AS ra, t.root AS rb FROM mods f JOIN mods t ON f.id <> t.id), zones AS (SELECT a, b, CASE WHEN ra LIKE 'src/asia/%' AND NOT (rb LIKE 'src/asia/%' OR regexp_matches(b, '^NATION_1.$')) THEN 'asia-only' WHEN (regexp_matches(ra, '^src/[^/]*/nation_1[^/]*$') OR a = 'NATION_3') AND rb LIKE 'src/europe/%' THEN 'no-europe' END AS zone FROM pairs)"


def _records(spark, d, zones=None) -> DataFrame:
    return R.import_records(trade.owned(spark, d), trade.modules(spark, d), zones)


@query(_PAIRS + " SELECT o.fromModule AS src, o.toModule AS dst, z.zone, CASE z.zone WHEN 'asia-only' THEN 'Asia stays in Asia.' ELSE o.fromModule || ' is not allowed to depend on ' || o.toModule || ' in boundary zone ''no-europe''.' END AS message, count(*) AS n FROM owned o JOIN zones z ON z.a = o.fromModule AND z.b = o.toModule WHERE z.zone IS NOT NULL GROUP BY ALL")
def boundary_violations(spark, d):
    bad = _records(spark, d, ZONES).where("isBoundaryViolation AND toModule IS NOT NULL")
    return bad.groupBy(F.col("fromModule").alias("src"), F.col("toModule").alias("dst"), F.col("boundaryZone").alias("zone"), F.col("boundaryMessage").alias("message")).agg(F.count("*").alias("n"))


FORBIDDEN = [{"from": "NATION_1", "to": "NATION_2"}, {"from": "NATION_1", "to": "NATION_2", "message": "twice"}, {"from": "NATION_5", "to": "NATION_0"}]


@query("SELECT o.id, o.fromModule AS src, o.toModule AS dst, o.line FROM owned o JOIN (VALUES ('NATION_1', 'NATION_2'), ('NATION_1', 'NATION_2'), ('NATION_5', 'NATION_0')) f(a, b) ON o.fromModule = a AND o.toModule = b WHERE resolution = 'internal'")
def forbidden_dependencies(spark, d):
    return R.forbidden_records(_records(spark, d), FORBIDDEN).select("id", F.col("fromModule").alias("src"), F.col("toModule").alias("dst"), "line")


# ---------------------------------------------------------------- rules


def _matching(name: str, condition: dict, where: str):
    """A query that counts the records a condition matches, by resolution and line."""

    def f(spark, d):
        hit = R.condition(R.FIELDS["imports"], condition)
        return _records(spark, d).where(hit).groupBy("resolution", "line").agg(F.count("*").alias("n"))

    f.__name__ = name
    query(f"SELECT resolution, line, count(*) AS n FROM owned WHERE {where} GROUP BY ALL")(f)


def _c(field, operator, *value) -> dict:
    return {"field": field, "operator": operator} | ({"value": value[0]} if value else {})


_matching("rule_eq", _c("resolution", "eq", "internal"), "resolution = 'internal'")
_matching("rule_eq_missing", _c("toModule", "eq"), "toModule IS NULL")
_matching("rule_neq", _c("toModule", "neq", "NATION_3"), "toModule IS DISTINCT FROM 'NATION_3'")
_matching("rule_neq_type", _c("line", "neq", "1"), "true")
_matching("rule_truthy", _c("toFile", "truthy"), "coalesce(toFile <> '', false)")
_matching("rule_falsy", _c("isPublicApi", "falsy"), "NOT isPublicApi")
_matching("rule_starts_with", _c("specifier", "startsWith", "./"), "starts_with(specifier, './')")
_matching("rule_includes", _c("specifier", "includes", 1), "contains(specifier, '1')")
_matching("rule_gt", _c("line", "gt", 4), "line > 4")
_matching("rule_gte", _c("line", "gte", 4), "line >= 4")
_matching("rule_lt", _c("line", "lt", 4), "line < 4")
_matching("rule_lte", _c("line", "lte", 4), "line <= 4")
_matching("rule_field_ref", _c("fromModule", "eq", {"field": "toModule"}), "fromModule IS NOT DISTINCT FROM toModule")

_DEEP = "resolution = 'internal' AND fromModule <> toModule AND NOT isPublicApi"
_FOUND = (
    _PAIRS
    + f""", f AS (
  SELECT 'architecture/unresolved-import' AS code, 'observation' AS category, 'warning' AS level, 'Could not resolve internal import ''' || specifier || '''.' AS message, fromFile AS file, line, id FROM owned WHERE resolution = 'unresolved' AND regexp_matches(specifier, '^[./#]')
  UNION ALL SELECT 'architecture/out-of-scope-import', 'observation', 'warning', 'Internal import ''' || specifier || ''' resolves outside the analysis scope.', fromFile, line, id FROM owned WHERE resolution = 'out-of-scope'
  UNION ALL SELECT 'architecture/dynamic-import-ambiguous', 'observation', 'warning', 'Dynamic dependency ''' || specifier || ''' could not be resolved statically.', fromFile, line, id FROM owned WHERE importKind <> 'static' AND confidence = 'ambiguous'
  UNION ALL SELECT 'architecture/deep-import', 'violation', 'warning', fromModule || ' imports ' || toFile || ' instead of ' || toModule || '''s public entrypoint.', fromFile, line, id FROM owned WHERE {_DEEP}
  UNION ALL SELECT 'architecture/forbidden-dependency', 'violation', 'error', fromModule || ' is not allowed to depend on ' || toModule || '.', fromFile, line, id FROM owned JOIN (VALUES ('NATION_1', 'NATION_2'), ('NATION_1', 'NATION_2'), ('NATION_5', 'NATION_0')) v(a, b) ON fromModule = a AND toModule = b WHERE resolution = 'internal'
  UNION ALL SELECT 'architecture/boundary-violation', 'violation', 'error', CASE zone WHEN 'asia-only' THEN 'Asia stays in Asia.' ELSE fromModule || ' is not allowed to depend on ' || toModule || ' in boundary zone ''no-europe''.' END, fromFile, line, id FROM owned JOIN zones ON a = fromModule AND b = toModule WHERE zone IS NOT NULL
  UNION ALL SELECT 'architecture/no-public-entrypoint', 'observation', 'info', 'Module ''' || id || ''' has no index entrypoint; cross-module imports cannot be checked as public API.', NULL, NULL, NULL FROM mods WHERE id NOT IN (SELECT module FROM files WHERE public))"""
)
CONFIG = {"boundaryZones": ZONES, "forbiddenDependencies": FORBIDDEN, "noCycles": False}


def _findings(spark, d) -> DataFrame:
    owned = trade.owned(spark, d)
    own = trade.entrypoints(spark, d).groupBy("snapshot_id", F.col("module").alias("id")).agg(F.collect_list("file").alias("entrypoints"))
    mods = trade.modules(spark, d).join(own, ["snapshot_id", "id"], "left").withColumn("entrypoints", F.coalesce("entrypoints", F.array().cast("array<string>")))
    none = spark.createDataFrame([], "snapshot_id string, id string, modules array<string>, edgeIds array<string>")
    return R.evaluate_rules(CONFIG, owned, mods, none)


@query(_FOUND + " SELECT code, category, level, message, coalesce(file, '') AS file, coalesce(line, 0) AS line, count(*) AS n FROM f GROUP BY ALL")
def builtin_findings(spark, d):
    f = _findings(spark, d).select("code", "category", "level", "message", F.coalesce("file", F.lit("")).alias("file"), F.coalesce("line", F.lit(0)).alias("line"))
    return f.groupBy(*f.columns).agg(F.count("*").alias("n"))


@query(_FOUND + " SELECT message, count(*) AS n FROM f WHERE code = 'architecture/deep-import' GROUP BY 1")
def finding_message(spark, d):
    return _findings(spark, d).where("code = 'architecture/deep-import'").groupBy("message").agg(F.count("*").alias("n"))


@query(_FOUND + ", k AS (SELECT row_number() OVER (ORDER BY CASE level WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, code, coalesce(file, ''), coalesce(line, 0), message) AS place, code, coalesce(file, '') AS file, coalesce(line, 0) AS line, message FROM f) SELECT * FROM k")
def finding_order(spark, d):
    rows = _findings(spark, d).select(R.level_rank().alias("rank"), "code", F.coalesce("file", F.lit("")).alias("file"), F.coalesce("line", F.lit(0)).alias("line"), "message")
    return numbered(rows, ["rank", "code", "file", "line", "message"], "place").drop("rank")


@query(_FOUND + " SELECT code, count(*) AS n FROM f WHERE code IN ('architecture/deep-import', 'architecture/out-of-scope-import') GROUP BY 1")
def fail_on_gate(spark, d):
    return _findings(spark, d).where(R.matches_fail_on(["deep-imports", "out-of-scope-import"])).groupBy("code").agg(F.count("*").alias("n"))


@query(_FOUND + " SELECT DISTINCT code, CASE level WHEN 'info' THEN 'note' ELSE level END AS level FROM f")
def sarif_rules(spark, d):
    return render.sarif_rules(_findings(spark, d)).select("code", "level")


# ---------------------------------------------------------------- cycles


def _daily(spark, d, where="true") -> DataFrame:
    """Module edges of every day's imports, a snapshot each: the graph of all days together is one cycle."""
    owned = trade.owned(spark, d).where(where).withColumn("snapshot_id", F.date_format("day", "yyyy-MM-dd"))
    return E.edge_counts(owned).select("snapshot_id", "id", "from", "to", "imports")


def _scc(name: str = "", where: str = "true") -> str:
    """Components of every day's edges, in SQL."""
    return f"""daily{name} AS (SELECT DISTINCT strftime(day, '%Y-%m-%d') AS d, fromModule AS a, toModule AS b FROM owned WHERE resolution = 'internal' AND fromModule <> toModule AND {where}),
reach{name} AS (SELECT d, a, b FROM daily{name} UNION SELECT r.d, r.a, t.b FROM reach{name} r JOIN daily{name} t ON r.d = t.d AND r.b = t.a),
comp{name} AS (SELECT x.d, x.a AS module, least(x.a, min(x.b)) AS component FROM reach{name} x JOIN reach{name} y ON x.d = y.d AND x.a = y.b AND x.b = y.a GROUP BY x.d, x.a),
grp{name} AS (SELECT d, component, count(*) AS n, string_agg(module, ',' ORDER BY module) AS members FROM comp{name} GROUP BY d, component HAVING count(*) > 1)"""


@query(", " + _scc() + " SELECT d AS day, members, n FROM grp")
def scc_cycles(spark, d):
    return G.cycles(_daily(spark, d)).select(F.col("snapshot_id").alias("day"), F.array_join("modules", ",").alias("members"), F.size("modules").cast("long").alias("n"))


@query(", " + _scc() + " SELECT g.d AS day, g.members, t.a AS src, t.b AS dst FROM grp g JOIN comp x ON x.d = g.d AND x.component = g.component JOIN comp y ON y.d = g.d AND y.component = g.component JOIN daily t ON t.d = g.d AND t.a = x.module AND t.b = y.module")
def scc_edges(spark, d):
    e = G.cycles(_daily(spark, d)).select(F.col("snapshot_id").alias("day"), F.array_join("modules", ",").alias("members"), F.explode("edgeIds").alias("e"))
    return e.select("day", "members", F.substring_index("e", "\0", 1).alias("src"), F.substring_index("e", "\0", -1).alias("dst"))


@query(", " + _scc() + " SELECT 'Module dependency strongly-connected component: ' || replace(members, ',', ', ') || '.' AS message, count(*) AS n FROM grp GROUP BY 1")
def cycle_findings(spark, d):
    registry = R.select_registry({}, [r for r in R.BUILTIN_RULES if r["source"] == "cycles"])
    found = R.evaluate(registry, R.Context({"noCycles": True}, {"cycles": R.cycle_records(G.cycles(_daily(spark, d)))}))
    return found.groupBy("message").agg(F.count("*").alias("n"))


_WHOLE = """, reach AS (SELECT fromModule AS a, toModule AS b FROM edges UNION SELECT r.a, t.toModule FROM reach r JOIN edges t ON r.b = t.fromModule)"""


@query(_WHOLE + """ SELECT line FROM (SELECT '  "' || id || '" [label="' || id || chr(92) || 'n' || (SELECT count(*) FROM files WHERE module = id) || ' files"' || CASE WHEN id IN (SELECT a FROM reach WHERE a = b) THEN ', color="#dc2626", penwidth="2"' ELSE '' END || '];' AS line FROM mods
UNION ALL SELECT '  "' || fromModule || '" -> "' || toModule || '" [label="' || imports || ' (' || CASE WHEN publicApi = imports THEN '' ELSE publicApi || '/' || imports || ' ' END || 'public API)"];' FROM edges)""")
def dot_lines(spark, d):
    edges = G.cut(_edges(spark, d).select("snapshot_id", "id", "from", "to", "imports", "publicApiImports"))
    own = trade.files(spark, d).groupBy("snapshot_id", F.col("module").alias("id")).agg(F.collect_list("file").alias("files"))
    mods = trade.modules(spark, d).join(own, ["snapshot_id", "id"], "left").withColumn("files", F.coalesce("files", F.array().cast("array<string>")))
    return render.dot_lines(mods, edges, G.cycles(edges)).select("line")


# ---------------------------------------------------------------- differences

_BASE, _NOW = "day < TIMESTAMP '1999-06-01'", "day >= TIMESTAMP '1996-01-01'"


def _order_rows(spark, d):
    """Orders of two overlapping spans; in the later one those of a fifth of the customers have changed."""
    o = trade.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("cust"), F.col("o_orderdate").alias("day"))
    status = F.when(F.col("cust") % 5 == 0, "X").otherwise(F.col("status"))
    return o.where(_BASE).select("k", "status", "price"), o.where(_NOW).select("k", status.alias("status"), "price")


_ORDERS = "WITH b AS (SELECT o_orderkey::VARCHAR AS k, o_orderstatus AS status FROM orders WHERE o_orderdate < TIMESTAMP '1999-06-01'), a AS (SELECT o_orderkey::VARCHAR AS k, CASE WHEN o_custkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS status FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01') "


def _order_diff(spark, d, change):
    before, after = _order_rows(spark, d)
    return D.diff_collection(before, after, "k").where(F.col("change") == change).select("key", F.col("before.status").alias("was"), F.col("after.status").alias("is"))


@query(_ORDERS + "SELECT a.k AS key, NULL::VARCHAR AS was, a.status AS \"is\" FROM a WHERE k NOT IN (SELECT k FROM b)", with_trade=False)
def diff_added(spark, d):
    return _order_diff(spark, d, "added")


@query(_ORDERS + "SELECT b.k AS key, b.status AS was, NULL::VARCHAR AS \"is\" FROM b WHERE k NOT IN (SELECT k FROM a)", with_trade=False)
def diff_removed(spark, d):
    return _order_diff(spark, d, "removed")


@query(_ORDERS + "SELECT a.k AS key, b.status AS was, a.status AS \"is\" FROM a JOIN b USING (k) WHERE a.status <> b.status", with_trade=False)
def diff_changed(spark, d):
    return _order_diff(spark, d, "changed")


_TWO = f""", e1 AS (SELECT f.root AS a, t.root AS b, count(*) AS n FROM owned o JOIN mods f ON f.id = o.fromModule JOIN mods t ON t.id = o.toModule WHERE resolution = 'internal' AND fromModule <> toModule AND {_BASE} GROUP BY ALL),
e2 AS (SELECT f.root AS a, t.root AS b, count(*) AS n FROM owned o JOIN mods f ON f.id = o.fromModule JOIN mods t ON t.id = o.toModule WHERE resolution = 'internal' AND fromModule <> toModule AND {_NOW} GROUP BY ALL)"""


@query(_TWO + " SELECT coalesce(e1.a, e2.a) || '>' || coalesce(e1.b, e2.b) AS key, CASE WHEN e1.a IS NULL THEN 'added' WHEN e2.a IS NULL THEN 'removed' ELSE 'changed' END AS change, e1.n AS before, e2.n AS after FROM e1 FULL JOIN e2 USING (a, b) WHERE e1.n IS DISTINCT FROM e2.n")
def edge_diff_stable_key(spark, d):
    """Edges by stable keys; on the later side modules are renamed, which their keys outlive."""
    mods = trade.modules(spark, d)
    renamed = mods.withColumn("id", F.concat(F.lit("new:"), "id"))
    before, after = (E.edge_counts(trade.owned(spark, d).where(s)).select("from", "to", "imports") for s in (_BASE, _NOW))
    after = after.select(F.concat(F.lit("new:"), "from").alias("from"), F.concat(F.lit("new:"), "to").alias("to"), "imports")
    a, b = D.with_edge_key(before, mods), D.with_edge_key(after, renamed)
    found = D.diff_collection(a, b, "key", leave_out=["from", "to", "key"])
    return found.select(F.translate("key", "\0", ">").alias("key"), "change", F.col("before.imports").alias("before"), F.col("after.imports").alias("after"))


_KINDS = {"imports": "true", "internalImports": "resolution = 'internal'", "externalImports": "resolution = 'external'", "assetImports": "resolution = 'asset'", "unresolvedImports": "resolution = 'unresolved'", "outOfScopeImports": "resolution = 'out-of-scope'"}


@query(", m AS (" + " UNION ALL ".join(f"SELECT '{k}' AS metric, count(*) FILTER ({w} AND {_BASE}) AS before, count(*) FILTER ({w} AND {_NOW}) AS after FROM owned" for k, w in _KINDS.items()) + ") SELECT *, after - before AS delta FROM m")
def metric_deltas(spark, d):
    before, after = (_metrics(spark, d, s) for s in (_BASE, _NOW))
    return D.metric_deltas(before, after).where(F.col("metric").isin(*_KINDS))


def _keyed_violations(where: str) -> str:
    return f", v AS (SELECT DISTINCT id, fromModule || ' imports ' || toFile || ' instead of ' || toModule || '''s public entrypoint.' AS message, {where} AS side FROM owned WHERE {_DEEP})"


def _violations(spark, d) -> tuple[DataFrame, DataFrame]:
    registry = R.select_registry({}, [r for r in R.BUILTIN_RULES if r["code"].endswith("/deep-import")])
    out = []
    for s in (_BASE, _NOW):
        records = R.import_records(trade.owned(spark, d).where(s), trade.modules(spark, d))
        out.append(R.evaluate(registry, R.Context({"noDeepImports": True}, {"imports": records})).drop("snapshot_id"))
    return out[0], out[1]


_DEEPS = f", s AS (SELECT id, fromModule || ' imports ' || toFile || ' instead of ' || toModule || '''s public entrypoint.' AS message, {_BASE} AS b, {_NOW} AS a FROM owned WHERE {_DEEP}), v AS (SELECT id, message, bool_or(b) AS b, bool_or(a) AS a FROM s GROUP BY ALL)"


def _violation_diff(spark, d, change, side):
    """Rows of one change: only what is answered travels, by digests of the keys."""
    own = ["category", "message", F.col("provenance.derivedFrom")[0].alias("id"), R.finding_digest().alias("key")]
    found = D.diff_collection(*(v.select(*own) for v in _violations(spark, d)), "key")
    return found.where((F.col("change") == change) & (F.col(f"{side}.category") == "violation")).select(f"{side}.id", f"{side}.message")


@query(_DEEPS + " SELECT id, message FROM v WHERE a AND NOT b")
def introduced_violations(spark, d):
    return _violation_diff(spark, d, "added", "after")


@query(_DEEPS + " SELECT id, message FROM v WHERE b AND NOT a")
def resolved_violations(spark, d):
    return _violation_diff(spark, d, "removed", "before")


@query(_DEEPS + " SELECT count(*) > 0 AS has_regressions FROM v WHERE a AND NOT b")
def has_regressions(spark, d):
    return introduced_violations(spark, d).agg((F.count("*") > 0).alias("has_regressions"))


@query("SELECT b.r_name AS base, c.r_name AS current, concat_ws('; ', CASE WHEN b.r_name <> c.r_name THEN 'tool ' || b.r_name || ' != ' || c.r_name END, CASE WHEN b.r_regionkey % 2 <> c.r_regionkey % 2 THEN 'analysis configuration differs' END) AS reasons FROM (SELECT * FROM region WHERE r_regionkey = 0) b, (SELECT * FROM region WHERE r_regionkey = 3) c", with_trade=False)
def comparability(spark, d):
    r = trade.table(spark, d, "region").select(F.col("r_name").alias("toolVersion"), (F.col("r_regionkey") % 2).cast("string").alias("configHash"), "r_regionkey", *[F.lit("x").alias(c) for c in ("irVersion", "compilerOptionsHash", "tsconfig", "sourceRoot")])
    a, b = r.where("r_regionkey = 0"), r.where("r_regionkey = 3")
    names = a.select(F.col("toolVersion").alias("base")).join(b.select(F.col("toolVersion").alias("current")), F.lit(True))
    return D.comparability(a, b).join(names, F.lit(True)).select("base", "current", F.concat_ws("; ", "reasons").alias("reasons"))


# ---------------------------------------------------------------- modules


def _candidates(spark, d) -> DataFrame:
    return M.candidate_roots(trade.files(spark, d).select("snapshot_id", "path"), {"modules": {"far": {"root": "src/asia/nation_2"}}}, "src", ["src/asia", "src/europe", "src/africa"], "shop")


_CAND = ", cand AS (SELECT path, CASE WHEN path LIKE 'src/asia/nation_2/%' THEN 'far' WHEN regexp_matches(path, '^src/(asia|europe|africa)/') THEN split_part(path, '/', 3) ELSE split_part(path, '/', 2) END AS base_id, CASE WHEN regexp_matches(path, '^src/(asia|europe|africa)/') THEN regexp_extract(path, '^src/[^/]*/[^/]*') ELSE regexp_extract(path, '^src/[^/]*') END AS root, path LIKE 'src/asia/nation_2/%' AS declared FROM files)"


@query(_CAND + " SELECT path, base_id, root, declared FROM cand")
def module_candidates(spark, d):
    return _candidates(spark, d).select("path", "base_id", "root", "declared")


@query(_CAND + " SELECT root, arg_min(base_id, path) AS base_id, bool_or(declared) AS declared FROM cand GROUP BY root")
def module_dedup_root(spark, d):
    return M.distinct_roots(_candidates(spark, d)).select("root", "base_id", "declared")


@query(_CAND + ", u AS (SELECT DISTINCT root, CASE WHEN declared THEN base_id ELSE 'm' || length(root) END AS base_id, declared FROM cand) SELECT root, base_id, count(*) FILTER (NOT declared) OVER (PARTITION BY base_id) AS same FROM u")
def module_id_collisions(spark, d):
    """Roots of equal length share a name here, so that some collide."""
    base = F.when(F.col("declared"), F.col("base_id")).otherwise(F.concat(F.lit("m"), F.length("root")))
    return M.collisions(M.distinct_roots(_candidates(spark, d)).withColumn("base_id", base)).select("root", "base_id", "same")


@query(_CAND + " SELECT base_id AS id, root, count(*) AS n_files, count(*) FILTER (regexp_matches(path, '/index\\.')) AS n_entrypoints FROM cand GROUP BY ALL")
def module_inference(spark, d):
    found, _ = M.infer_modules(trade.files(spark, d).select("snapshot_id", "path"), {"modules": {"far": {"root": "src/asia/nation_2"}}}, "src", ["src/asia", "src/europe", "src/africa"], "shop")
    return found.select("id", "root", F.size("files").cast("long").alias("n_files"), F.size("entrypoints").cast("long").alias("n_entrypoints"))


# ---------------------------------------------------------------- keys, selectors, more collections


@query(_FOUND + ", k AS (SELECT concat_ws('|', code, category, coalesce(file, ''), coalesce(line, 0), message) || CASE WHEN id IS NULL THEN '' ELSE '|' || id END AS key FROM f) SELECT sha256(key) AS key, count(*) AS n FROM k GROUP BY 1")
def finding_keys(spark, d):
    key = F.translate(R.finding_key(), "\0", "|")
    counts = _findings(spark, d).groupBy(F.unhex(F.sha2(key, 256)).alias("digest")).agg(F.count("*").alias("n"))
    return counts.select(F.lower(F.hex("digest")).alias("key"), "n")


@query(_FOUND + " SELECT code, CASE level WHEN 'info' THEN 'note' ELSE level END AS level, CASE category WHEN 'violation' THEN 'fail' ELSE 'informational' END AS kind, file IS NULL AS nowhere, count(*) AS n FROM f GROUP BY ALL")
def sarif_results(spark, d):
    return render.sarif_results(_findings(spark, d)).groupBy("code", "level", "kind", F.col("file").isNull().alias("nowhere")).agg(F.count("*").alias("n"))


@query("SELECT id, regexp_matches(root, '^src/[^/]*/nation_.$') OR regexp_matches(id, '^NATION_1.*$') AS star, regexp_matches(root, '^src/.*/nation_2[^/]*$') AS deep, root LIKE 'src/europe/%' AS below FROM mods")
def selector_match(spark, d):
    columns = [F.col("id"), F.col("stableId"), F.col("root")]
    found = {"star": ["src/*/nation_?", "NATION_1**"], "deep": ["src/**/nation_2*"], "below": ["src\\europe/**"]}
    return trade.modules(spark, d).select("id", *[globs.selects(columns, v).alias(k) for k, v in found.items()])


@query("SELECT path, CASE WHEN regexp_matches(path, '\\.(jsx?|mjs|cjs)$', 'i') THEN 'javascript' ELSE 'typescript' END AS language, 'observed' AS origin, path AS evidence FROM files")
def file_facts(spark, d):
    path = F.col("path")
    proof = E.provenance("observed", "typescript-source", evidence=F.array(E.evidence("file", path, path)))
    facts = trade.files(spark, d).select("path", paths.language(path).alias("language"), proof.alias("p"))
    return facts.select("path", "language", "p.origin", F.col("p.evidence")[0]["id"].alias("evidence"))


@query("SELECT line, importKind AS kind, count(*) AS n FROM owned WHERE line > 2 AND starts_with(specifier, '.') AND importKind <> 'static' GROUP BY ALL")
def rule_conjunction(spark, d):
    rule = {"code": "own/x", "source": "imports", "where": [_c("line", "gt", 2), _c("specifier", "startsWith", "."), _c("isDynamic", "truthy")], "finding": {"category": "observation", "level": "info", "message": "${importKind}", "line": {"field": "line"}}}
    found = R.evaluate(R.select_registry({}, [rule]), R.Context({}, {"imports": _records(spark, d)}))
    return found.groupBy("line", F.col("message").alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM owned")
def rule_without_conditions(spark, d):
    rule = {"code": "own/all", "source": "imports", "finding": {"category": "observation", "level": "info", "message": "m"}}
    return R.evaluate(R.select_registry({}, [rule]), R.Context({}, {"imports": _records(spark, d)})).agg(F.count("*").alias("n"))


@query(", " + _scc() + " SELECT g.d AS day, members FROM grp g JOIN mods m ON m.key = day(strptime(g.d, '%Y-%m-%d')) % 25 WHERE contains(',' || members || ',', ',' || m.id || ',')")
def rule_includes_member(spark, d):
    """Cycles that hold the nation whose number is the day of the month (of 25); it stands in a field, which the rule refers to."""
    records = R.cycle_records(G.cycles(_daily(spark, d)))
    nation = trade.modules(spark, d).select(F.col("key").alias("nation"), F.col("id").alias("named"))
    records = records.join(nation, F.dayofmonth(F.to_date("snapshot_id")) % 25 == F.col("nation")).drop("id").withColumnRenamed("named", "id")
    hit = R.condition(R.FIELDS["cycles"], _c("modules", "includes", {"field": "id"}))
    return records.where(hit).select(F.col("snapshot_id").alias("day"), F.array_join("modules", ",").alias("members"))


@query("SELECT id AS module, (SELECT count(*) FROM files WHERE module = id AND public) > 0 AS has_entrypoint, true AS has_peers FROM mods")
def module_records(spark, d):
    own = trade.entrypoints(spark, d).groupBy("snapshot_id", F.col("module").alias("id")).agg(F.collect_list("file").alias("entrypoints"))
    mods = trade.modules(spark, d).join(own, ["snapshot_id", "id"], "left").withColumn("entrypoints", F.coalesce("entrypoints", F.array().cast("array<string>")))
    return R.module_records(mods).select(F.col("moduleId").alias("module"), F.col("hasPublicEntrypoint").alias("has_entrypoint"), F.col("hasPeers").alias("has_peers"))


@query(", b AS (SELECT path, module FROM files WHERE path NOT LIKE '%.js'), a AS (SELECT path, CASE WHEN module = 'NATION_4' THEN 'NATION_5' ELSE module END AS module FROM files WHERE path NOT LIKE '%.tsx') SELECT coalesce(a.path, b.path) AS file, CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'removed' ELSE 'changed' END AS change, b.module AS was, a.module AS \"is\" FROM a FULL JOIN b USING (path) WHERE a.module IS DISTINCT FROM b.module")
def ownership_diff(spark, d):
    own = trade.files(spark, d).select(F.col("path").alias("file"), "module")
    moved = F.when(F.col("module") == "NATION_4", "NATION_5").otherwise(F.col("module")).alias("module")
    found = D.diff_collection(own.where("file NOT LIKE '%.js'"), own.where("file NOT LIKE '%.tsx'").select("file", moved), "file")
    return found.select(F.col("key").alias("file"), "change", F.col("before.module").alias("was"), F.col("after.module").alias("is"))


@query("SELECT 'src/' || lower(r_name) || '/' || lower(n_name) AS key, 'changed' AS change FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 3 = 0", with_trade=False)
def module_diff(spark, d):
    """Modules by root: every third has another name afterwards, all another stableId, which doesn't count."""
    mods = trade.modules(spark, d).select("id", "stableId", "root", "key")
    after = mods.select(F.when(F.col("key") % 3 == 0, F.concat("id", F.lit("'"))).otherwise(F.col("id")).alias("id"), F.col("stableId"), "root")
    return D.diff_collection(mods.select("id", "stableId", "root"), after, F.coalesce("stableId", "root", "id"), leave_out=["stableId"]).select("key", "change")


_LINES = ("line IN (1, 2)", "line IN (2, 5)")


def _keys(name: str) -> str:
    return f"keyed{name} AS (SELECT c.d || ':' || string_agg(root, ',' ORDER BY root) AS key FROM comp{name} c JOIN grp{name} g ON g.d = c.d AND g.component = c.component JOIN mods ON id = module GROUP BY c.d, c.component)"


@query(", " + ", ".join(x for n, w in zip("bn", _LINES) for x in (_scc("_" + n, w), _keys("_" + n))) + " SELECT coalesce(b.key, n.key) AS key, CASE WHEN b.key IS NULL THEN 'added' ELSE 'removed' END AS change FROM keyed_b b FULL JOIN keyed_n n ON b.key = n.key WHERE b.key IS NULL OR n.key IS NULL")
def cycle_diff_stable_key(spark, d):
    """Every day's cycles of the imports of two spans of lines, by the roots of their members."""
    mods, sides = trade.modules(spark, d), []
    for where in _LINES:
        found = G.cycles(_daily(spark, d, where))
        found = found.select(F.concat_ws("\0", "snapshot_id", "id").alias("id"), "modules", "snapshot_id")
        sides.append(D.with_cycle_key(found, mods).select(F.concat_ws(":", "snapshot_id", F.translate("key", "\0", ",")).alias("key"), "modules"))
    return D.diff_collection(*sides, "key").where("change <> 'changed'").select("key", "change")


# ---------------------------------------------------------------- sources made of documents


def _sources(spark, d) -> DataFrame:
    """A source file per document: imports of all kinds, and what only looks like them, by the remainders of its number."""
    n = F.col("doc_id")
    number = lambda k: (n % k).cast("string")
    parts = [
        F.concat(F.lit('import { a } from "./m'), number(7), F.lit('";')),
        F.when(n % 3 == 0, F.concat(F.lit('import type T from "t'), number(5), F.lit('";'))).otherwise('// import "no"'),
        F.concat(F.lit('const x = c ? import("a'), number(11), F.lit('") : import(`b${c}.js`);')),
        F.when(n % 4 == 0, "interface I { require(x: string): void }").otherwise(F.concat(F.lit('const r = require<R>("r'), number(4), F.lit('");'))),
        F.when(n % 6 == 1, "export { type A } from 'e';").otherwise('let y: Array<import("no").T> = /"import(1)/;'),
        F.when(n % 5 == 2, "  load(); import(name); /* end */").otherwise('const s = `import "no" ${require("s")}`;'),
    ]
    end = F.when(n % 2 == 0, "\r\n").otherwise("\n")
    return trade.table(spark, d, "documents").select(trade.snapshot(), F.concat(F.lit("src/d"), n, F.lit(".ts")).alias("path"), F.concat_ws("", *[x for p in parts for x in (p, end)]).alias("text"))


_IMPORTS = """WITH n AS (SELECT doc_id AS n FROM documents), found AS (
  SELECT n, './m' || (n % 7) AS specifier, 'static' AS kind, false AS type_only, 1 AS line, 1 AS col FROM n
  UNION ALL SELECT n, 't' || (n % 5), 'static', true, 2, 1 FROM n WHERE n % 3 = 0
  UNION ALL SELECT n, 'a' || (n % 11), 'dynamic', false, 3, 15 FROM n
  UNION ALL SELECT n, 'b*.js', 'dynamic', false, 3, 15 + length('import("a' || (n % 11) || '") : ') FROM n
  UNION ALL SELECT n, 'r' || (n % 4), 'require', false, 4, 11 FROM n WHERE n % 4 <> 0
  UNION ALL SELECT n, 'e', 'export', true, 5, 1 FROM n WHERE n % 6 = 1
  UNION ALL SELECT n, '<dynamic>', 'dynamic', false, 6, 11 FROM n WHERE n % 5 = 2
  UNION ALL SELECT n, 's', 'require', false, 6, 26 FROM n WHERE n % 5 <> 2) """


@query(_IMPORTS + "SELECT 'src/d' || n || '.ts' AS path, specifier, kind, type_only, line, col FROM found", with_trade=False)
def import_extract(spark, d):
    found = extract.extract(_sources(spark, d))
    return found.select(F.col("fromFile").alias("path"), "specifier", F.col("importKind").alias("kind"), F.col("typeOnly").alias("type_only"), "line", F.col("column").alias("col"))


@query(_IMPORTS + """, answers AS (SELECT *, CASE WHEN specifier IN ('./m0', './m1', './m2') THEN 'src/' || substr(specifier, 3) || '.ts' WHEN specifier IN ('./m3', './m4') THEN 'src/' || substr(specifier, 3) || '/index.tsx'
    WHEN specifier = './m5' THEN 'src/m5.d.ts' WHEN specifier IN ('a0', 'a1', 'a2') THEN 'lib/' || substr(specifier, 2) || '.ts' END AS hit, specifier IN ('t1', 't2', 'e', 'a7', 's') AS package FROM found)
SELECT 'src/d' || n || '.ts' AS path, line, col, specifier, coalesce(CASE WHEN specifier <> './m5' THEN hit WHEN specifier = './m5' THEN hit END, '') AS target,
  CASE WHEN specifier = './m5' THEN 'out-of-scope' WHEN hit IS NOT NULL THEN 'internal' WHEN package THEN 'external' WHEN kind IN ('dynamic', 'require') OR specifier LIKE './%' THEN 'unresolved' ELSE 'external' END AS resolution,
  CASE WHEN hit IS NOT NULL OR package THEN 'exact' WHEN kind IN ('dynamic', 'require') OR specifier LIKE './%' THEN 'ambiguous' ELSE 'syntactic' END AS confidence FROM answers""", with_trade=False)
def module_resolution(spark, d):
    """The imports of ``_sources`` among twelve known files and packages, with an alias."""
    known = [(True, f"src/m{k}.ts", True) for k in range(3)] + [(True, "src/m0.js", True), (True, "src/m0.d.ts", True)] + [(True, f"src/m{k}/index.tsx", True) for k in (3, 4)] + [(True, "src/m5.d.ts", False)]
    known += [(True, f"lib/{k}.ts", True) for k in range(3)] + [(False, f"{at}node_modules/{p}", False) for at, p in (("", "t1"), ("src/", "t2"), ("", "e"), ("", "a7"), ("../", "s"))]
    known = spark.createDataFrame(known, "is_file boolean, place string, inside boolean")
    sources = _sources(spark, d)
    owners = sources.select(F.col("path").alias("fromFile"), F.lit(0).alias("config"))
    found = resolve.resolve_among(extract.extract(sources), owners, known, [{"paths": {"a*": ["lib/*"]}}], "/above/project")
    return found.select(F.col("fromFile").alias("path"), "location.line", F.col("location.column").alias("col"), "specifier", F.coalesce("toFile", F.lit("")).alias("target"), "resolution", F.col("resolutionConfidence").alias("confidence"))
