"""The star schema read as a project: customers and suppliers are files, nations modules, line items imports.

``TRADE`` is the same reading in SQL, for the queries' oracles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import edges as E


def snapshot() -> Column:
    return F.lit("all").alias("snapshot_id")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations: id is the name, root and stableId say the region, too."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    root = F.concat_ws("/", F.lit("src"), F.lower("r_name"), F.lower("n_name"))
    return n.select(snapshot(), F.col("n_name").alias("id"), root.alias("stableId"), root.alias("root"), F.col("n_nationkey").alias("key"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers: name, path, nation and whether they are entrypoints (suppliers of a high balance)."""
    ends = {0: ".ts", 1: ".tsx", 2: ".js", 3: ".d.ts", 4: ".MJS", 5: ".json", 6: ".test.ts"}
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("file"), F.col("c_custkey").alias("n"), F.col("c_nationkey").alias("key"), F.lit(False).alias("public"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("file"), F.col("s_suppkey").alias("n"), F.col("s_nationkey").alias("key"), (F.col("s_acctbal") > 5000).alias("public"))
    end = F.element_at(F.create_map(*[F.lit(x) for kv in ends.items() for x in kv]), (F.col("n") % 7).cast("int"))
    m = modules(spark, sf_dir).select("key", F.col("id").alias("module"), "root")
    return c.unionByName(s).join(m, "key").select(snapshot(), "file", "module", "public", F.concat("root", F.lit("/"), "file", end).alias("path"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of known customers, by the file that all their line items are imports of."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    known = E.among(o.select("o_orderkey", "o_custkey", "o_orderdate"), "o_custkey", c.select("c_custkey"))
    return known.select(snapshot(), F.concat(F.lit("c"), "o_custkey").alias("fromFile"), "o_orderkey", "o_orderdate")


def _items(spark: SparkSession, sf_dir: str, orders: DataFrame) -> DataFrame:
    """Line items of these orders and of known suppliers, as narrow as the table holds them, with ``toFile``."""
    l, s = (table(spark, sf_dir, t) for t in ("lineitem", "supplier"))
    n, known = E.shares(l, orders), E.among(l, "l_suppkey", s.select("s_suppkey"))
    met = E.dealt(known, n, "l_orderkey").join(E.dealt(orders, n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return met.withColumn("toFile", F.when(_internal() | _outside(), F.concat(F.lit("s"), "l_suppkey")))


def _internal() -> Column:
    return F.col("l_linenumber").isin(1, 2, 5) & (F.col("l_quantity") >= 10)


def _outside() -> Column:
    return (F.col("l_linenumber") == 5) & (F.col("l_quantity") < 10)


def _shown(items: DataFrame, *more: str) -> DataFrame:
    """Line items as unresolved imports; texts are made here, after the joins, so that they don't travel."""
    part = F.col("l_partkey").cast("string")
    n = F.col("l_linenumber")
    specifier = (
        F.when(n == 1, F.concat(F.lit("./s"), "l_suppkey")).when(n == 2, F.concat(F.lit("@scope/part"), part)).when(n == 3, "fs").when(n == 4, F.concat(F.lit("../img/p"), part, F.lit(".PNG?x")))
        .when(n == 5, F.concat(F.lit("#lib/s"), "l_suppkey")).when(n == 6, "node:path").otherwise(F.concat(F.lit("/style/p"), part, F.lit(".scss")))
    )
    return items.select(
        "snapshot_id", "fromFile", F.concat(F.lit("s"), "l_suppkey").alias("target"), specifier.alias("specifier"),
        F.when(F.col("l_returnflag") == "N", "dynamic").when(F.col("l_returnflag") == "R", "require").otherwise("static").alias("importKind"),
        (F.col("l_linestatus") == "F").alias("typeOnly"), n.cast("int").alias("line"), F.col("l_quantity").alias("quantity"), F.col("o_orderdate").alias("day"),
        F.col("l_orderkey").alias("order"), F.col("l_partkey").alias("part"), "l_extendedprice", *more,
    )


def _resolved(items: DataFrame, *more: str) -> DataFrame:
    from ..functions import paths

    i = _shown(items, "toFile", _internal().alias("__internal"), _outside().alias("__outside"), *more)
    internal, outside, kind, spec = F.col("__internal"), F.col("__outside"), F.col("importKind"), F.col("specifier")
    return i.select(
        "*", paths.resolution(internal, paths.is_asset(spec), outside, internal | outside, spec, kind).alias("resolution"),
        paths.confidence(internal | outside, spec, kind).alias("resolutionConfidence"),
    ).drop("__internal", "__outside")


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of known customers and suppliers, unresolved: fromFile, target, specifier, importKind, typeOnly, line and more."""
    return _shown(_items(spark, sf_dir, _orders(spark, sf_dir)))


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports with toFile, resolution and confidence: local ones of larger orders are internal, small aliased ones out of scope."""
    return _resolved(_items(spark, sf_dir, _orders(spark, sf_dir)))


def ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("snapshot_id", "file", "module")


def entrypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).where("public").select("snapshot_id", "module", "file")


def owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved imports with both owners, and ids that tell their place apart.

    Orders learn the owner of their file before their line items, many times as many, are joined to them.
    """
    files_of = ownership(spark, sf_dir)
    items = _items(spark, sf_dir, E.from_owners(_orders(spark, sf_dir), files_of))
    i = _resolved(E.to_owners(items, files_of, entrypoints(spark, sf_dir)), "fromModule", "toModule", "isPublicApi")
    return i.withColumn("id", F.concat_ws("|", "fromFile", F.coalesce("toFile", F.lit("")), "importKind", "specifier", "order", "line"))


TRADE = """
mods AS (
  SELECT n_nationkey AS key, n_name AS id, 'src/' || lower(r_name) || '/' || lower(n_name) AS root
  FROM nation JOIN region ON n_regionkey = r_regionkey),
ends AS (
  SELECT 'c' || c_custkey AS file, c_custkey AS n, c_nationkey AS key, false AS public FROM customer
  UNION ALL SELECT 's' || s_suppkey, s_suppkey, s_nationkey, s_acctbal > 5000 FROM supplier),
files AS (
  SELECT file, id AS module, public, root || '/' || file
    || (CASE n % 7 WHEN 0 THEN '.ts' WHEN 1 THEN '.tsx' WHEN 2 THEN '.js' WHEN 3 THEN '.d.ts' WHEN 4 THEN '.MJS' WHEN 5 THEN '.json' ELSE '.test.ts' END) AS path
  FROM ends JOIN mods USING (key)),
raw AS (
  SELECT 'c' || o_custkey AS fromFile, 's' || l_suppkey AS target,
    CASE l_linenumber WHEN 1 THEN './s' || l_suppkey WHEN 2 THEN '@scope/part' || l_partkey WHEN 3 THEN 'fs'
      WHEN 4 THEN '../img/p' || l_partkey || '.PNG?x' WHEN 5 THEN '#lib/s' || l_suppkey WHEN 6 THEN 'node:path'
      ELSE '/style/p' || l_partkey || '.scss' END AS specifier,
    CASE l_returnflag WHEN 'N' THEN 'dynamic' WHEN 'R' THEN 'require' ELSE 'static' END AS importKind,
    l_linestatus = 'F' AS typeOnly, l_linenumber AS line, l_quantity AS quantity, o_orderdate AS day, l_orderkey AS ord, l_partkey AS part, l_extendedprice,
    l_linenumber IN (1, 2, 5) AND l_quantity >= 10 AS internal, l_linenumber = 5 AND l_quantity < 10 AS outside
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey),
imports AS (
  SELECT *, CASE WHEN internal OR outside THEN target END AS toFile,
    CASE WHEN internal THEN 'internal' WHEN line IN (4, 7) THEN 'asset' WHEN outside THEN 'out-of-scope' WHEN line IN (3, 6) THEN 'external'
      WHEN importKind <> 'static' OR line IN (1, 5) THEN 'unresolved' ELSE 'external' END AS resolution,
    CASE WHEN internal OR outside OR line IN (3, 6) THEN 'exact' WHEN importKind <> 'static' OR line <> 2 THEN 'ambiguous' ELSE 'syntactic' END AS confidence
  FROM raw),
owned AS (
  SELECT i.*, a.module AS fromModule, b.module AS toModule, coalesce(b.public, false) AS isPublicApi,
    concat_ws('|', i.fromFile, coalesce(toFile, ''), importKind, specifier, ord, line) AS id
  FROM imports i JOIN files a ON a.file = i.fromFile LEFT JOIN files b ON b.file = i.toFile),
edges AS (
  SELECT fromModule, toModule, count(*) AS imports, count(*) FILTER (isPublicApi) AS publicApi, count(*) FILTER (NOT isPublicApi) AS deep,
    count(DISTINCT fromFile) AS files
  FROM owned WHERE resolution = 'internal' AND fromModule <> toModule GROUP BY ALL)
"""
