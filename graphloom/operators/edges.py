"""Imports projected onto modules: ownership, edges, fan-in and fan-out, metrics.  All tables are keyed by snapshot_id.

No side of a join is broadcast by hint: with statistics or at run time Spark broadcasts small dimension tables by
itself, and falls back to shuffles beyond its threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths

BY = "snapshot_id"
EVIDENCE = "array<struct<kind:string,id:string,file:string,line:int>>"
#: Bytes of stored tables that one partition of a dealt join may stand for.
SHARE = 32 << 20
#: Order of the counters in reports and deltas.
COUNTERS = ("sourceFiles", "modules", "imports", "internalImports", "externalImports", "assetImports", "unresolvedImports", "outOfScopeImports", "moduleEdges", "cycles", "deepImports")


def provenance(origin: str, analyzer: str | None = None, rule=None, evidence=None, derived=None):
    none = F.lit(None).cast
    return F.struct(
        F.lit(origin).alias("origin"),
        F.lit(analyzer).alias("analyzer"),
        (none("string") if rule is None else rule).alias("rule"),
        (none(EVIDENCE) if evidence is None else evidence.cast(EVIDENCE)).alias("evidence"),
        (none("array<string>") if derived is None else derived).alias("derivedFrom"),
    )


def evidence(kind: str, id, file=None, line=None):
    none = F.lit(None)
    return F.struct(F.lit(kind).alias("kind"), id.alias("id"), (none.cast("string") if file is None else file).alias("file"), (none.cast("int") if line is None else line.cast("int")).alias("line"))


def longest_prefix(files: DataFrame, roots: DataFrame) -> DataFrame:
    """``(snapshot_id, file, module)``: the module of the deepest root that holds a file, ties by id.

    A file's ancestors are exploded and meet the roots in an equi-join, so no pair of file and root is tried.
    """
    places = files.select(BY, F.col("path").alias("file"), F.explode(paths.ancestors(F.col("path"))).alias("a")).select(BY, "file", F.col("a.dir").alias("root"), F.col("a.depth").alias("depth"))
    met = places.where("NOT (file LIKE '../%' AND root = '.')").join(roots.select(BY, "root", F.col("id").alias("module")), [BY, "root"])
    return met.groupBy(BY, "file").agg(F.min_by("module", F.struct(-F.col("depth"), F.col("module"))).alias("module"))


def shares(*tables: DataFrame) -> int | None:
    """Into how many partitions what is made of these tables is dealt: one for every ``SHARE`` bytes of the files below.

    None where the session's own number is as large.  With that number alone a task's rows, and what it takes to sort
    them, would grow with the input.  Tables of unknown size (made in memory, checkpoints) do not count.
    """
    size = 0
    for t in tables:
        leaves = t._jdf.queryExecution().analyzed().collectLeaves()
        found = [leaves.apply(k) for k in range(leaves.size())]
        size += sum(int(x.stats().sizeInBytes()) for x in found if x.nodeName() == "LogicalRelation")
    n = -(-size // SHARE)
    return n if n > int(tables[0].sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def dealt(table: DataFrame, n: int | None, *keys: str) -> DataFrame:
    return table if n is None else table.repartition(n, *keys)


def _travels_whole(table: DataFrame) -> bool:
    """Whether Spark, by its estimate, sends the table to every task of a join."""
    limit = table.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= limit


def among(rows: DataFrame, key: str, known: DataFrame) -> DataFrame:
    """Rows whose ``key`` is in the only column of ``known``: dealt by size, unless ``known`` is small enough to travel whole."""
    n, name = None if _travels_whole(known) else shares(rows, known), known.columns[0]
    return dealt(rows, n, key).join(dealt(known, n, name), F.col(key) == F.col(name), "left_semi")


def _place(file: Column) -> Column:
    """A file of a snapshot as one text, from whose end the snapshot can be told; null if either is."""
    return F.concat(file, F.col(BY), F.lit(":"), F.length(BY).cast("string"))


def _met(rows: DataFrame, file: Column, owners: DataFrame, also: Column) -> DataFrame:
    """Rows with the other columns of the owner of ``file`` in their snapshot, where ``also`` holds.

    Sides that are dealt meet by one key: of two, a constant snapshot is folded away in joins but not where rows are
    dealt, and they would be dealt twice.
    """
    n, columns = shares(rows, owners), [c for c in owners.columns if c not in (BY, "file")]
    if n is None:
        b = owners.select(F.col(BY).alias("__by"), F.col("file").alias("__file"), *columns)
        return rows.withColumn("__key", file).join(b, (F.col(BY) == F.col("__by")) & (F.col("__key") == F.col("__file")) & also, "left").drop("__key", "__by", "__file")
    a, b = rows.withColumn("__key", _place(file)), owners.select(_place(F.col("file")).alias("__place"), *columns)
    return dealt(a, n, "__key").join(dealt(b, n, "__place"), (F.col("__key") == F.col("__place")) & also, "left").drop("__key", "__place")


def from_owners(imports: DataFrame, ownership: DataFrame) -> DataFrame:
    """Rows with ``fromModule``, the owner of ``fromFile`` (null if it has none)."""
    return _met(imports, F.col("fromFile"), ownership.select(BY, "file", F.col("module").alias("fromModule")), F.lit(True))


def to_owners(imports: DataFrame, ownership: DataFrame, entrypoints: DataFrame) -> DataFrame:
    """Rows with ``toModule``, the owner of ``toFile``, and ``isPublicApi``.

    Owners learn first which of their files are entrypoints, so that the imports, the largest table, are joined once.
    Imports without a target, often most of them, would share one key and so one task: they are dealt by ``fromFile``.
    """
    public = entrypoints.select(BY, "module", "file", F.lit(True).alias("isPublicApi")).distinct()
    b = ownership.select(BY, "file", "module").join(public, [BY, "module", "file"], "left").select(BY, "file", F.col("module").alias("toModule"), "isPublicApi")
    file = F.coalesce("toFile", F.concat(F.lit("\0"), "fromFile"))
    return _met(imports, file, b, F.col("toFile").isNotNull()).withColumn("isPublicApi", F.coalesce("isPublicApi", F.lit(False)))


def owned_imports(imports: DataFrame, ownership: DataFrame, entrypoints: DataFrame) -> DataFrame:
    """Imports with ``fromModule``, ``toModule`` (null if a file has no owner) and ``isPublicApi``."""
    return to_owners(from_owners(imports, ownership), ownership, entrypoints)


def _crossing(owned: DataFrame) -> DataFrame:
    return owned.where("resolution = 'internal' AND toFile IS NOT NULL AND fromModule <> toModule")


def _visibility() -> Column:
    return F.when((F.col("publicApiImports") > 0) & (F.col("deepImports") > 0), "mixed").when(F.col("publicApiImports") > 0, "public").otherwise("deep")


def edge_counts(owned: DataFrame) -> DataFrame:
    """A row per pair of different modules of internal imports: id, from, to, counts, number of files, visibility.

    Counted by file first and then by pair, with partial sums: no row grows with the imports of a pair, no task with the input.
    """
    by_file = dealt(_crossing(owned), shares(owned), "fromFile").groupBy(BY, F.col("fromModule").alias("from"), F.col("toModule").alias("to"), "fromFile").agg(F.count("*").alias("n"), F.count_if("isPublicApi").alias("p"))
    sums = by_file.groupBy(BY, "from", "to").agg(F.sum("n").alias("imports"), F.sum("p").alias("publicApiImports"), F.sum(F.col("n") - F.col("p")).alias("deepImports"), F.count("*").alias("files"))
    return sums.select(BY, F.concat_ws("\0", "from", "to").alias("id"), "from", "to", "imports", "publicApiImports", "deepImports", "files", _visibility().alias("visibility"))


def edge_members(owned: DataFrame) -> DataFrame:
    """``(snapshot_id, from, to, id, fromFile)``: the imports that each module edge is made of, a row each."""
    return _crossing(owned).select(BY, F.col("fromModule").alias("from"), F.col("toModule").alias("to"), "id", "fromFile").distinct()


def module_edges(owned: DataFrame) -> DataFrame:
    """``edge_counts`` as documents hold them: with the lists of files and edge ids, and provenance.

    A row holds all ids of its pair, as the document does; what needs counts alone takes ``edge_counts``, what needs ids
    at any size ``edge_members``.  Evidence keeps the order in which imports were read (column ``ord``, if there is one, else their ids).
    """
    order = F.col("ord") if "ord" in owned.columns else F.col("id")
    grouped = _crossing(owned).groupBy(BY, F.col("fromModule").alias("from"), F.col("toModule").alias("to")).agg(
        F.count("*").alias("imports"), F.count_if("isPublicApi").alias("publicApiImports"), F.count_if(~F.col("isPublicApi")).alias("deepImports"),
        F.array_sort(F.collect_set("fromFile")).alias("files"), F.array_sort(F.collect_set("id")).alias("sourceEdgeIds"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("id").alias("id")))), lambda x: x["id"])).alias("read"),
    )
    proof = F.transform("read", lambda i: evidence("source-edge", i))
    return grouped.select(BY, F.concat_ws("\0", "from", "to").alias("id"), "from", "to", "imports", "publicApiImports", "deepImports", "files", "sourceEdgeIds", _visibility().alias("visibility"), provenance("derived", "module-projection", evidence=proof, derived=F.col("sourceEdgeIds")).alias("provenance"))


def fans(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """``(snapshot_id, module, fan_in, fan_out)`` of every module, 0 where it has no edges."""
    ends = edges.select(BY, F.explode(F.array(F.struct(F.col("from").alias("module"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("to").alias("module"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    sums = ends.groupBy(BY, "e.module").agg(F.sum("e.i").alias("fan_in"), F.sum("e.o").alias("fan_out"))
    return modules.select(BY, F.col("id").alias("module")).join(sums, [BY, "module"], "left").select(BY, "module", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))


def highest(fan: DataFrame, column: str, name: str) -> DataFrame:
    """``(snapshot_id, name struct<module, value>)``: the module of the highest value, ties by name."""
    key = F.struct(-F.col(column), paths.by_locale("module"), F.col("module"))
    return fan.groupBy(BY).agg(F.min_by(F.struct("module", F.col(column).alias("value")), key).alias(name))


def metrics(snapshots: DataFrame, files: DataFrame, modules: DataFrame, imports: DataFrame, edges: DataFrame, cycles: DataFrame) -> DataFrame:
    """One row per snapshot: the eleven counters and the modules of highest fan-in and fan-out."""
    kinds = {"internalImports": "internal", "externalImports": "external", "assetImports": "asset", "unresolvedImports": "unresolved", "outOfScopeImports": "out-of-scope"}
    parts = [
        files.groupBy(BY).agg(F.count("*").alias("sourceFiles")),
        modules.groupBy(BY).agg(F.count("*").alias("modules")),
        imports.groupBy(BY).agg(F.count("*").alias("imports"), *[F.count_if(F.col("resolution") == v).alias(k) for k, v in kinds.items()]),
        edges.groupBy(BY).agg(F.count("*").alias("moduleEdges"), F.sum("deepImports").alias("deepImports")),
        cycles.groupBy(BY).agg(F.count("*").alias("cycles")),
    ]
    out = snapshots.select(BY).distinct()
    for p in parts:
        out = out.join(p, BY, "left")
    fan = fans(modules, edges)
    out = out.join(highest(fan, "fan_in", "maxFanIn"), BY, "left").join(highest(fan, "fan_out", "maxFanOut"), BY, "left")
    return out.select(BY, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTERS], "maxFanIn", "maxFanOut", provenance("derived", "architecture-metrics").alias("provenance"))


def occurrence(imports: DataFrame, order: list) -> DataFrame:
    """Running number (from 0) of imports that agree in all but their place, in the order read within a file."""
    same = Window.partitionBy(BY, "fromFile", "toFile", "importKind", "specifier", "typeOnly").orderBy(*order)
    return imports.withColumn("occurrence", F.row_number().over(same) - 1)


def import_id(occurrence) -> Column:
    kind = F.when(F.col("typeOnly"), "type").otherwise("value")
    return paths.joined(F.col("fromFile"), F.col("toFile"), F.col("importKind"), F.col("specifier"), kind, occurrence)
