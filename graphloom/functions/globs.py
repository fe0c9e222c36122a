"""Two glob dialects, compiled on the driver to anchored regular expressions that run inside the JVM."""

from __future__ import annotations

import functools
import operator
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Paths left out by default.
DEFAULT_EXCLUDES = ("node_modules/**", ".next/**", "dist/**", "build/**", "coverage/**", ".turbo/**", ".cache/**")

_TOKEN = re.compile(r"\*\*/|\*\*|\*|\?|[^*?]+")


def _compile(pattern: str, spanning: dict[str, str]) -> str:
    return "".join(spanning.get(t) or re.sub(r"([.+^${}()|\[\]\\])", r"\\\1", t) for t in _TOKEN.findall(pattern))


def path_glob(pattern: str) -> str:
    """Regex body of a path glob: ``**/`` may be empty, ``**`` crosses slashes, ``*`` and ``?`` don't."""
    normal = pattern.replace("\\", "/")
    normal = normal[2:] if normal.startswith("./") else normal
    return _compile(normal, {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"})


def selector_glob(pattern: str) -> str:
    """Regex body of a module selector: like a path glob, but ``**/`` keeps its slash."""
    return _compile(pattern.replace("\\", "/"), {"**/": ".*/", "**": ".*", "*": "[^/]*", "?": "[^/]"})


def path_regex(pattern: str) -> str:
    """Regex body of all that a path pattern selects; one without wildcards selects what lies below it, too."""
    body = path_glob(pattern)
    return body if re.search(r"[*?]", pattern) else f"{body}|{path_glob(pattern + '/**')}"


def whole(text: Column, *bodies: str) -> Column:
    """True if the whole text matches one of the regex bodies (never null)."""
    if not bodies:
        return F.lit(False)
    return F.coalesce(F.replace(text, F.lit("\\"), F.lit("/")).rlike(r"\A(?:" + "|".join(f"(?:{b})" for b in bodies) + r")\z"), F.lit(False))


def in_scope(path: Column, include=None, exclude=None) -> Column:
    """Included (all, without patterns) and not excluded by the defaults or by ``exclude``; one regex each way."""
    kept = whole(path, *map(path_regex, include)) if include else F.lit(True)
    return kept & ~whole(path, *map(path_regex, [*DEFAULT_EXCLUDES, *(exclude or ())]))


def selects(columns: list[Column], selectors) -> Column:
    """True if a selector matches any of the columns; null and empty columns match nothing."""
    bodies = [selector_glob(s) for s in selectors]
    return functools.reduce(operator.or_, [whole(F.when(c != "", c), *bodies) for c in columns], F.lit(False))
