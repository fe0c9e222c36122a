"""Canonical JSON and its hashes: sorted keys, no spaces, byte for byte what a JavaScript engine would write."""

from __future__ import annotations

import hashlib
import json
import re
from typing import Any

_INDEX = re.compile(r"0|[1-9]\d{0,9}")


def _order(key: str) -> tuple:
    """Object keys that are array indexes come first, by number; the others by UTF-16 code units."""
    if _INDEX.fullmatch(key) and int(key) < 2**32 - 1:
        return 0, int(key), b""
    return 1, 0, key.encode("utf-16-be", "surrogatepass")


def canonicalize(value: Any) -> Any:
    if isinstance(value, dict):
        return {k: canonicalize(value[k]) for k in sorted(value, key=_order)}
    if isinstance(value, (list, tuple)):
        return [canonicalize(x) for x in value]
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e21:
        return int(value)
    return value


def canonical_json(value: Any) -> str:
    text = json.dumps(canonicalize(value), ensure_ascii=False, separators=(",", ":"))
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", text)


def sha256(value: Any) -> str:
    """Hash of the canonical JSON; a text is hashed with its quotes."""
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()
