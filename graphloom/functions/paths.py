"""Column expressions over paths, specifiers and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Source extensions, builtin modules and asset extensions.
SOURCE = r"\.(?:tsx?|mts|cts|jsx?|mjs|cjs)"
BUILTINS = ("fs", "path", "url", "util", "events", "assert", "crypto", "stream", "os", "http", "https")
ASSETS = "css scss sass less styl pcss svg png jpe?g gif webp avif ico woff2? ttf eot mp4 webm mp3 wav".split()


def is_source_file(path: Column) -> Column:
    return path.rlike(f"(?i){SOURCE}\\z") & ~path.endswith(".d.ts")


def language(path: Column) -> Column:
    return F.when(path.rlike(r"(?i)\.(?:jsx?|mjs|cjs)\z"), "javascript").otherwise("typescript")


def line_count(text: Column) -> Column:
    """Lines as an editor counts them: none for an empty (or null) text, one more behind a final line break."""
    return F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(F.regexp_count(text, F.lit("\n")) + 1).cast("int")


def is_builtin(specifier: Column) -> Column:
    return specifier.startswith("node:") | specifier.isin(*BUILTINS)


def is_local(specifier: Column) -> Column:
    return specifier.rlike("^[./#]")


def is_asset(specifier: Column) -> Column:
    plain = F.lower(F.regexp_extract(specifier, r"\A[^?#]*", 0))
    return F.coalesce(plain.rlike(r"\.(?:" + "|".join(ASSETS) + r")\z"), F.lit(False))


def in_node_modules(path: Column) -> Column:
    return F.coalesce(F.array_contains(F.split(path, "/"), "node_modules"), F.lit(False))


def within(root: Column, path: Column) -> Column:
    """A path is in a directory, both relative to the project; ``.`` is the project itself."""
    return F.when(root == ".", ~path.startswith("../")).otherwise((path == root) | path.startswith(F.concat(root, F.lit("/"))))


def ancestors(path: Column) -> Column:
    """Array of structs (dir, depth): the path itself and every directory above it, ``.`` with depth 0."""
    parts = F.split(path, "/")
    own = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("dir"), i.alias("depth")))
    return F.concat(F.array(F.struct(F.lit(".").alias("dir"), F.lit(0).alias("depth"))), own)


def resolution(internal: Column, asset: Column, out_of_scope: Column, resolved: Column, specifier: Column, kind: Column) -> Column:
    loose = kind.isin("dynamic", "require") | is_local(specifier)
    return F.when(internal, "internal").when(asset, "asset").when(out_of_scope, "out-of-scope").when(resolved | is_builtin(specifier), "external").when(loose, "unresolved").otherwise("external")


def confidence(resolved: Column, specifier: Column, kind: Column) -> Column:
    loose = kind.isin("dynamic", "require") | is_local(specifier)
    return F.when(resolved | is_builtin(specifier), "exact").when(loose, "ambiguous").otherwise("syntactic")


def joined(*columns: Column, by: str = "\0") -> Column:
    """Texts joined; null counts as an empty text (concat_ws would leave it out)."""
    return F.concat_ws(by, *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])


def by_locale(column: str | Column) -> Column:
    """Order of the root locale; ties (say, texts that differ in ignorable characters) need a second key."""
    return F.collate(column, "UNICODE")
