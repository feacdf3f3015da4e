"""Canonical form of JSON documents and its hash.

Strings and keys in Unicode NFC, keys sorted by code point, compact, no ASCII escapes, no NaN.
Volatile keys are stripped, except below opaque keys and as direct children of schema maps.
Arrays whose order means nothing are sorted by their members' name.
"""

from __future__ import annotations

import json
import unicodedata
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from driftloom.functions.fixed import OPAQUE_KEYS, SCHEMA_MAPS, SORTED_BY, SORTED_STRINGS, VOLATILE_KEYS


@dataclass(frozen=True)
class Policy:
    """What the canonical form strips and sorts; names are compared without case, - and _."""

    volatile: frozenset[str] = VOLATILE_KEYS
    schema_maps: frozenset[str] = SCHEMA_MAPS
    opaque: frozenset[str] = OPAQUE_KEYS
    sorted_by: dict[str, str] = field(default_factory=lambda: dict(SORTED_BY))
    sorted_strings: frozenset[str] = SORTED_STRINGS
    #: Exact paths to strip: tuples of keys, ``*`` for any key and ``[]`` for a place in an array.
    volatile_paths: frozenset[tuple[str, ...]] = frozenset()

    def strips(self, path: tuple[str, ...]) -> bool:
        return any(len(p) == len(path) and all(x in ("*", y) for x, y in zip(p, path)) for p in self.volatile_paths)


def dumps(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def canonical(value, policy: Policy = Policy(), parent: str = "", opaque: bool = False, path: tuple[str, ...] = ()):
    """The value in canonical form; keys that collide after normalization raise ValueError."""
    if isinstance(value, str):
        return unicodedata.normalize("NFC", value)
    if isinstance(value, list):
        items = [canonical(x, policy, "", opaque, (*path, "[]")) for x in value if not policy.strips((*path, "[]"))]
        by = policy.sorted_by.get(parent)
        if opaque or not items:
            return items
        if by and all(isinstance(x, dict) and isinstance(x.get(by), str) for x in items):
            return sorted(items, key=lambda x: (x[by], dumps(x).encode()))
        if parent in policy.sorted_strings and all(isinstance(x, str) for x in items):
            return sorted(items)
        return items
    if isinstance(value, dict):
        out = {}
        for key, item in value.items():
            name = unicodedata.normalize("NFC", key)
            plain = name.casefold().replace("-", "").replace("_", "")
            if not opaque and parent not in policy.schema_maps and plain in policy.volatile:
                continue
            if policy.strips((*path, name)):
                continue
            if name in out:
                raise ValueError(f"keys collide after normalization: {name!r}")
            out[name] = canonical(item, policy, name, opaque or name in policy.opaque, (*path, name))
        return out
    return value


def canonical_json(document: Column, policy: Policy = Policy()) -> Column:
    """Canonical text of a JSON document.

    Null where it is null, no JSON, nested beyond what Python reads, or holds half a surrogate pair.
    """

    def convert(documents: pa.Array) -> pa.Array:
        out = []
        for d in documents.to_pylist():
            try:
                text = None if d is None else dumps(canonical(json.loads(d), policy))
                out.append(text if text is None or text.encode() else None)
            except (ValueError, RecursionError):
                out.append(None)
        return pa.array(out, pa.string())

    return F.arrow_udf(convert, "string")(document)


def canonical_hash(document: Column, policy: Policy = Policy()) -> Column:
    """Lowercase hex SHA-256 of the canonical text."""
    return F.sha2(canonical_json(document, policy), 256)
