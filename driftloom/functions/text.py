"""Columns over texts: tokens, split names, phrase markers, growth; and the token diff."""

from __future__ import annotations

import difflib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\w+|[^\w\s]")


#: Python's classes of words and white space, which differ from Java's in marks, joiners and numerals.
_WORD = r"\p{L}\p{N}_"
_BLANK = r"\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"


def tokens(text: Column) -> Column:
    """Words and single other signs of a text, in order, as Python's ``\\w+|[^\\w\\s]``; none of a null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"[{_WORD}]+|[^{_WORD}{_BLANK}]"), F.lit(0)), F.array().cast("array<string>"))


def split_name(name: Column) -> Column:
    """A name in snake, kebab, dotted or camel case as words with spaces."""
    parts = F.split(name, rf"[_\-.{_BLANK}]+|(?<=[a-z0-9])(?=[A-Z])")
    return F.array_join(F.array_remove(parts, ""), " ")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is made once, however often a lambda in ``use`` names it."""
    return F.get(F.transform(F.array(value), use), 0)


def markers(text: Column, phrases: list[str]) -> Column:
    """Sorted phrases that a text holds, in any case."""
    held = lambda low: F.filter(F.array(*map(F.lit, sorted(phrases))), lambda p: F.contains(low, p))
    return once(F.lower(F.coalesce(text, F.lit(""))), held)


def grew_sharply(before: Column, after: Column) -> Column:
    """Whether a text that was not empty is at least twice as long."""
    return F.coalesce((F.length(before) > 0) & (F.length(after) >= 2 * F.length(before)), F.lit(False))


def token_diff(before: Column, after: Column) -> Column:
    """struct(added, removed, similarity): tokens of differing runs, and 2 * equal / all tokens.

    Longest-block matching is recursive, so this is the standard library's matcher in an Arrow UDF.
    Null texts count as empty; two empty texts have similarity 1.
    """
    kind = pa.struct([("added", pa.list_(pa.string())), ("removed", pa.list_(pa.string())), ("similarity", pa.float64())])

    def diff(old: pa.Array, new: pa.Array) -> pa.Array:
        out = []
        for a, b in zip(old.to_pylist(), new.to_pylist()):
            a, b = _TOKEN.findall(a or ""), _TOKEN.findall(b or "")
            m = difflib.SequenceMatcher(None, a, b, autojunk=False)
            row = {"added": [], "removed": [], "similarity": m.ratio()}
            for op, i, j, k, n in m.get_opcodes():
                if op != "equal":
                    row["removed"] += a[i:j]
                    row["added"] += b[k:n]
            out.append(row)
        return pa.array(out, kind)

    return F.arrow_udf(diff, "struct<added:array<string>,removed:array<string>,similarity:double>")(before, after)
