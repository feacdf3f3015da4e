"""Typed changes between consecutive documents: named members, parameters, renames.

Documents stay JSON text; members are exploded to rows and compared by full outer joins.
"""

from __future__ import annotations

import difflib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftloom.operators.listings import clean
from driftloom.session import own_folder, spread

#: Similarity of descriptions from which a removed and an added tool are one that was renamed.
RENAME_SIMILARITY = 0.6


def members(docs: DataFrame, keys: list[str], document: str, path: str, name: str) -> DataFrame:
    """(keys, name, value, at): named members of a JSON array; of equal names the last one wins."""
    items = F.from_json(F.get_json_object(document, f"$.{path}"), "array<string>")
    rows = docs.select(*keys, F.posexplode(items).alias("at", "value"))
    rows = rows.withColumn("name", clean(F.get_json_object("value", f"$.{name}"))).filter("name is not null")
    last = Window.partitionBy(*keys, "name").orderBy(F.desc("at"))
    return rows.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")


def landed_members(pairs: DataFrame, key: str, sides: list[str], lists: dict[str, str]) -> dict[tuple[str, str], DataFrame]:
    """``members`` of each list (its path and the path of its names) of both sides, read in one pass and landed.

    Documents are read once, however often their members are joined afterwards.
    """
    texts = [F.struct(F.lit(str(k)).alias("side"), F.lit(path).alias("path"), F.get_json_object(side, f"$.{path}").alias("text")) for k, side in enumerate(sides) for path in lists]
    rows = pairs.select(key, F.inline(F.array(*texts))).select(key, "side", "path", F.posexplode(F.from_json("text", "array<string>")).alias("at", "value"))
    named = [F.when(F.col("path") == path, F.get_json_object("value", f"$.{name}")) for path, name in lists.items()]
    rows = rows.withColumn("name", clean(F.coalesce(*named))).filter("name is not null")
    last = Window.partitionBy(key, "side", "path", "name").orderBy(F.desc("at"))
    rows = rows.withColumn("_n", F.row_number().over(last)).filter("_n = 1").select(key, "name", "value", "at", "side", "path")
    at = own_folder(pairs.sparkSession, "members") + "/rows"
    rows.write.partitionBy("side", "path").parquet(at)
    read = pairs.sparkSession.read.schema(rows.schema).parquet(at)
    return {(side, path): read.filter((F.col("side") == str(k)) & (F.col("path") == path)).drop("side", "path") for k, side in enumerate(sides) for path in lists}


def parameters(tools: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tool, name, value, required): parameters of each tool's input schema."""
    schema = F.get_json_object("value", "$.inputSchema")
    props = F.coalesce(F.from_json(F.get_json_object(schema, "$.properties"), "map<string,string>"), F.create_map().cast("map<string,string>"))
    need = F.coalesce(F.from_json(F.get_json_object(schema, "$.required"), "array<string>"), F.array().cast("array<string>"))
    rows = tools.select(*keys, F.col("name").alias("tool"), need.alias("need"), F.explode(props).alias("name", "value"))
    return rows.withColumn("required", F.array_contains("need", F.col("name"))).drop("need")


def _kind(cases: list[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(kind)) for test, kind in cases]))


def tool_changes(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tool, kind): tools added, removed, or changed in description, annotations or execution."""
    b = before.select(*keys, "name", F.col("value").alias("b"))
    a = after.select(*keys, "name", F.col("value").alias("a"))
    differ = lambda f: ~F.get_json_object("b", f"$.{f}").eqNullSafe(F.get_json_object("a", f"$.{f}"))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    kinds = _kind([
        (F.col("b").isNull(), "tool_added"), (F.col("a").isNull(), "tool_removed"),
        (both & differ("description"), "tool_description_changed"),
        (both & differ("annotations"), "annotation_changed"), (both & differ("execution"), "execution_changed"),
    ])
    return b.join(a, [*keys, "name"], "full_outer").select(*keys, F.col("name").alias("tool"), F.explode(kinds).alias("kind"))


def parameter_changes(before: DataFrame, after: DataFrame, keys: list[str], tools: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(keys, tool, name, kind) between the parameters of tools that both sides have.

    ``tools`` are the members of both sides; without them a tool is known by its parameters only.

    A rest of the schema that differs is told only where type and description are equal.
    """
    b = before.select(*keys, "tool", "name", F.col("value").alias("b"), F.col("required").alias("rb"))
    a = after.select(*keys, "tool", "name", F.col("value").alias("a"), F.col("required").alias("ra"))
    own = [t.select(*keys, F.col("name").alias("tool")) for t in tools] if tools else [b.select(*keys, "tool").distinct(), a.select(*keys, "tool").distinct()]
    there = own[0].join(own[1], [*keys, "tool"])
    differ = lambda f: ~F.get_json_object("b", f"$.{f}").eqNullSafe(F.get_json_object("a", f"$.{f}"))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    kinds = _kind([
        (F.col("b").isNull(), "schema_param_added"), (F.col("a").isNull(), "schema_param_removed"),
        (both & differ("type"), "param_type_changed"), (both & differ("description"), "param_description_changed"),
        (both & ~differ("type") & ~differ("description") & (F.col("a") != F.col("b")), "param_schema_changed"),
        (F.col("ra") & ~F.coalesce("rb", F.lit(False)), "param_became_required"),
        (both & F.col("rb") & ~F.col("ra"), "param_became_optional"),
    ])
    joined = b.join(a, [*keys, "tool", "name"], "full_outer").join(there, [*keys, "tool"], "left_semi")
    return joined.select(*keys, "tool", "name", F.explode(kinds).alias("kind"))


def _member_changes(before: DataFrame, after: DataFrame, keys: list[str], noun: str, edits: bool) -> DataFrame:
    b = before.select(*keys, "name", F.col("value").alias("b"))
    a = after.select(*keys, "name", F.col("value").alias("a"))
    cases = [(F.col("b").isNull(), f"{noun}_added"), (F.col("a").isNull(), f"{noun}_removed")]
    if edits:
        cases.append((F.col("a") != F.col("b"), f"{noun}_changed"))
    text = lambda side: F.get_json_object(side, "$.description")
    joined = b.join(a, [*keys, "name"], "full_outer")
    return joined.select(*keys, "name", text("b").alias("before"), text("a").alias("after"), F.explode(_kind(cases)).alias("kind"))


def prompt_changes(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, name, before, after, kind): prompts added, removed or changed in any part.

    ``before`` and ``after`` carry the descriptions only.
    """
    return _member_changes(before, after, keys, "prompt", edits=True)


def resource_changes(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, name, before, after, kind): resources added or removed, by URI; edits are not told."""
    return _member_changes(before, after, keys, "resource", edits=False)


def _similarity(a: str | None, b: str | None) -> float:
    cut = re.compile(r"\w+|[^\w\s]").findall
    return difflib.SequenceMatcher(None, cut(a or ""), cut(b or ""), autojunk=False).ratio()


def _alike(old: dict, new: dict) -> float:
    """1 for equal schemas that have parameters, else the similarity of descriptions that both have."""
    if old["schema"] and old["schema"] == new["schema"] and json.loads(old["schema"]).get("properties"):
        return 1.0
    return _similarity(old["text"], new["text"]) if old["text"] and new["text"] else 0.0


def _pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        out = []
        for r in f.itertuples():
            left = list(r.added)
            for old in r.removed:
                scored = [(_alike(old, x), k) for k, x in enumerate(left)]
                best = max(scored, key=lambda s: (s[0], -s[1]), default=(0.0, -1))
                if best[0] >= RENAME_SIMILARITY:
                    out.append((r.transition, old["name"], left.pop(best[1])["name"], best[0]))
        yield pd.DataFrame(out, columns=["transition", "old", "new", "similarity"])


def renames(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(transition, old, new, similarity): removed and added tools of one transition that are one.

    Removed tools choose in document order, each the most similar tool that is left. The sequence
    is of one document's tools, never of a table.
    """
    own = lambda t: t.select(F.col(key).cast("string").alias("transition"), "name", "at", F.get_json_object("value", "$.inputSchema").alias("schema"), clean(F.get_json_object("value", "$.description")).alias("text"))
    b, a = own(before), own(after)
    listed = lambda x, y, n: x.join(y.select("transition", "name"), ["transition", "name"], "left_anti").groupBy("transition").agg(F.array_sort(F.collect_list(F.struct("at", "name", "schema", "text"))).alias(n))
    both = listed(b, a, "removed").join(listed(a, b, "added"), "transition")
    return spread(both, "transition").mapInPandas(_pairs, "transition string, old string, new string, similarity double")
