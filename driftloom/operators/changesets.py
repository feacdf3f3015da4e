"""Change sets of documents: one row a change, with its kind, path, both sides and detail.

Documents are canonical JSON text, so sub-documents compare as text, in which strings keep their quotes. A change is a struct of
``at`` (its place in the report: section, name, step, part), ``kind``, ``path``, ``tool``,
``before``, ``after`` and ``detail``. Only named members are joined; what is inside one tool is
compared by array expressions, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.functions.fixed import MANIFEST_PARTS, TOOL_PARTS
from driftloom.functions.text import token_diff
from driftloom.functions.typed import changed_members, differing_members, object_text, typed_at, typed_members
from driftloom.operators import documents, listings
from driftloom.operators.severity import TEXT_KINDS
from driftloom.session import spread

CHANGE = "struct<at:struct<section:int,name:string,step:int,part:string>,kind:string,path:string,tool:string,before:string,after:string,detail:string>"


def parts_of(document: Column) -> Column:
    """Top-level members of a JSON object as a map of JSON texts; null and other values have none."""
    return F.coalesce(F.from_json(document, "map<string,string>"), F.create_map().cast("map<string,string>"))


def strings_of(document: Column) -> Column:
    return F.coalesce(F.from_json(document, "array<string>"), F.array().cast("array<string>"))


def set_detail(before: Column, after: Column) -> Column:
    """What entered and left a set: ``+a, b; -c``; ``reordered`` if its members are the same."""
    gained, lost = F.array_sort(F.array_except(after, before)), F.array_sort(F.array_except(before, after))
    told = F.concat_ws(
        "; ", F.when(F.size(gained) > 0, F.concat(F.lit("+"), F.array_join(gained, ", "))), F.when(F.size(lost) > 0, F.concat(F.lit("-"), F.array_join(lost, ", ")))
    )
    return F.when(told == "", F.lit("reordered")).otherwise(told)


def tool_fingerprint(document: Column) -> Column:
    """Sorted names of a manifest's tools, joined by ``|``."""
    tools = strings_of(F.get_json_object(document, "$.tools"))
    return F.array_join(F.array_sort(F.array_compact(F.transform(tools, lambda t: listings.clean(F.get_json_object(t, "$.name"))))), "|")


def _change(section: Column | int, name: Column, step: int, part: Column | None, kind: Column | str, path: Column, tool: Column | None, before: Column, after: Column, detail: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        F.struct(F.lit(section).alias("section"), name.alias("name"), F.lit(step).alias("step"), (none if part is None else part).alias("part")).alias("at"),
        (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), path.alias("path"), (none if tool is None else tool).alias("tool"),
        before.cast("string").alias("before"), after.cast("string").alias("after"), (none if detail is None else detail).alias("detail"),
    ).cast(CHANGE)


def _if(test: Column, change: Column) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), F.array(change)).otherwise(F.array().cast(f"array<{CHANGE}>"))


def _read_members(rows: DataFrame, b: Column, a: Column, known: tuple[str, ...]) -> DataFrame:
    """``rows`` with the members of two documents, each document read once: ``parts`` and ``typed`` of both sides, and ``changed`` but for ``known``."""
    read = rows.withColumns({f"parts_{k}": parts_of(x) for k, x in enumerate((b, a))})
    read = read.withColumns({f"typed_{k}": typed_members(x, F.col(f"parts_{k}")) for k, x in enumerate((b, a))})
    return read.withColumn("changed", F.array_except(differing_members(F.col("typed_0"), F.col("typed_1")), F.array(*map(F.lit, known))))


def _member_differs(b: Column, a: Column, name: str) -> Column:
    """Whether a member of two documents that ``_read_members`` has read differs; only texts that are not equal are read again."""
    item = F.try_element_at
    same = item(F.col("typed_0"), F.lit(name)).eqNullSafe(item(F.col("typed_1"), F.lit(name)))
    return F.when(same, F.lit(False)).otherwise(~typed_at(b, f"$.{name}").eqNullSafe(typed_at(a, f"$.{name}")))


def _read_tools(rows: DataFrame, b: Column, a: Column) -> DataFrame:
    """``rows`` with what ``_tool_changes`` reads of two states of a tool: ``_0`` before, ``_1`` after.

    Equal schemas have no changes: only those that differ are read, and their parts from them.
    """
    item, sides = F.try_element_at, (0, 1)
    read = _read_members(rows.withColumns({f"schema_{k}": F.get_json_object(x, "$.inputSchema") for k, x in enumerate((b, a))}), b, a, TOOL_PARTS)
    differs = {f"{f}_differs": _member_differs(b, a, f) for f, _ in _TOOL_KINDS}
    moved = [F.when(~F.col("schema_0").eqNullSafe(F.col("schema_1")), F.col(f"schema_{k}")) for k in sides]
    read = read.withColumns(differs | {f"within_{k}": parts_of(moved[k]) for k in sides})
    props, required = ([item(F.col(f"within_{k}"), F.lit(name)) for k in sides] for name in ("properties", "required"))
    read = read.withColumns({f"framed_{k}": typed_members(moved[k], F.col(f"within_{k}")) for k in sides} | {f"props_{k}": parts_of(props[k]) for k in sides})
    return read.withColumns(
        {f"whole_{k}": typed_members(props[k], F.col(f"props_{k}")) for k in sides} | {f"required_{k}": strings_of(required[k]) for k in sides}
        | {f"frame_{k}": object_text(F.map_filter(f"framed_{k}", lambda n, _: ~n.isin("properties", "required"))) for k in sides}
    )


_TOOL_KINDS = (("description", "tool_description_changed"), ("annotations", "annotation_changed"), ("execution", "execution_changed"))


def _tool_changes(section: Column, tool: Column, b: Column, a: Column) -> Column:
    """Changes between two states of one tool, in report order, from the columns of ``_read_tools``."""
    get, col = F.get_json_object, F.col
    at = lambda *names: F.concat_ws("/", F.lit("tools"), tool, *[F.lit(n) if isinstance(n, str) else n for n in names])
    out = [_if(col(f"{f}_differs"), _change(section, tool, k, None, kind, at(f), tool, get(b, f"$.{f}"), get(a, f"$.{f}"))) for k, (f, kind) in enumerate(_TOOL_KINDS)]
    pb, pa, whole_b, whole_a, rb, ra = (col(f"{name}_{k}") for name in ("props", "whole", "required") for k in (0, 1))
    kb, ka = F.map_keys(pb), F.map_keys(pa)
    where = lambda n: at("inputSchema", "properties", n)
    each = lambda names, f: F.transform(F.array_sort(names), f)
    item = F.try_element_at
    out.append(each(F.array_except(ka, kb), lambda n: _change(
        section, tool, 3, n, "schema_param_added", where(n), tool, F.lit(None), item(pa, n), F.when(F.array_contains(ra, n), "required").otherwise("optional"))))
    out.append(each(F.array_except(kb, ka), lambda n: _change(section, tool, 4, n, "schema_param_removed", where(n), tool, item(pb, n), F.lit(None))))
    both = F.array_intersect(kb, ka)
    # Most parameters are as they were: only of those whose text differs are the members read, each once.
    moved = F.filter(both, lambda n: ~item(pb, n).eqNullSafe(item(pa, n)) | ~item(whole_b, n).eqNullSafe(item(whole_a, n)))

    def sides(n: Column) -> Column:
        x, y = item(pb, n), item(pa, n)
        kind, text = (~typed_at(x, f"$.{f}").eqNullSafe(typed_at(y, f"$.{f}")) for f in ("type", "description"))
        return F.struct(n.alias("n"), x.alias("x"), y.alias("y"), kind.alias("kind"), text.alias("text"))

    def edited(s: Column) -> Column:
        n, x, y = s["n"], s["x"], s["y"]
        return F.concat(
            _if(s["kind"], _change(section, tool, 5, n, "param_type_changed", where(n), tool, get(x, "$.type"), get(y, "$.type"))),
            _if(s["text"], _change(section, tool, 5, n, "param_description_changed", where(n), tool, get(x, "$.description"), get(y, "$.description"))),
            _if(~s["kind"] & ~s["text"] & ~item(whole_b, n).eqNullSafe(item(whole_a, n)), _change(section, tool, 5, n, "param_schema_changed", where(n), tool, x, y)),
        )

    out.append(F.flatten(F.transform(each(moved, sides), edited)))
    out.append(each(F.array_intersect(F.array_except(ra, rb), ka), lambda n: _change(section, tool, 6, n, "param_became_required", where(n), tool, F.lit(None), F.lit(None))))
    out.append(each(F.array_intersect(F.array_except(rb, ra), both), lambda n: _change(section, tool, 7, n, "param_became_optional", where(n), tool, F.lit(None), F.lit(None))))
    out.append(_if(col("frame_0") != col("frame_1"), _change(section, tool, 8, None, "tool_field_changed", at("inputSchema"), tool, col("frame_0"), col("frame_1"))))
    tb, ta = col("parts_0"), col("parts_1")
    out.append(each(col("changed"), lambda n: _change(section, tool, 9, n, "tool_field_changed", at(n), tool, item(tb, n), item(ta, n))))
    return F.concat(*out)


def _told(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Change rows with the token diff of texts that both sides have."""
    flat = rows.select(*keys, "c.*")
    text = F.col("kind").isin(*TEXT_KINDS) & F.col("before").isNotNull() & F.col("after").isNotNull()
    told = flat.withColumn("diff", token_diff(F.when(text, F.col("before")), F.when(text, F.col("after"))))
    return told.withColumns({"diff": F.when(text, F.col("diff")), "tool": F.col("tool")})


def manifest_changes(pairs: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """(key, at, kind, path, tool, before, after, detail, diff): J10 to J29 of pairs of manifests.

    Tools that were renamed are paired first and compared under the new name; the rest are added,
    removed or compared by name. Of members with the same name the last one counts.
    Members are landed first, so this runs a job.
    """
    keys = [key]
    named = documents.landed_members(pairs, key, [before, after], {"tools": "name", "prompts": "name", "resources": "uri"})
    b, a = named[before, "tools"], named[after, "tools"]
    pair = documents.renames(b, a, key).select(F.col("transition"), F.col("old"), F.col("new"))
    old = b.join(pair, (F.col(key).cast("string") == F.col("transition")) & (F.col("name") == F.col("old")), "left")
    left = old.select(key, F.coalesce("new", "name").alias("name"), F.col("new").isNotNull().alias("renamed"), F.col("name").alias("was"), F.col("value").alias("b"))
    both = spread(left.join(a.select(key, "name", F.col("value").alias("a")), [key, "name"], "full_outer"), key, "name")
    tool, x, y = F.col("name"), F.col("b"), F.col("a")
    path = F.concat(F.lit("tools/"), tool)
    renamed, there = F.coalesce("renamed", F.lit(False)), x.isNotNull() & y.isNotNull()
    read = _read_tools(both.select(key, "name", "was", "b", "a", renamed.alias("renamed"), there.alias("there")), F.when(F.col("there"), x), F.when(F.col("there"), y))
    renamed, there = F.col("renamed"), F.col("there")
    none = F.array().cast(f"array<{CHANGE}>")
    compared = F.when(there, _tool_changes(F.when(renamed, F.lit(0)).otherwise(F.lit(3)), tool, x, y)).otherwise(none)
    found = F.concat(
        _if(renamed, _change(0, tool, -1, None, "tool_renamed", F.concat(F.lit("tools/"), F.col("was")), tool, F.col("was"), tool)),
        _if(x.isNull(), _change(1, tool, 0, None, "tool_added", path, tool, F.lit(None), y, listings.clean(F.get_json_object(y, "$.description")))),
        _if(y.isNull(), _change(2, tool, 0, None, "tool_removed", path, tool, x, F.lit(None))),
        compared,
    )
    rows = read.select(key, F.explode(found).alias("c"))
    for section, path_, changes in ((4, "prompts", documents.prompt_changes), (5, "resources", documents.resource_changes)):
        found = changes(named[before, path_], named[after, path_], keys)
        one = _change(section, F.col("name"), 0, None, F.col("kind"), F.concat(F.lit(f"{path_}/"), F.col("name")), None, F.col("before"), F.col("after"))
        rows = rows.unionByName(found.select(key, one.alias("c")))
    top = []
    whole = _read_members(pairs.select(key, F.col(before).alias("b"), F.col(after).alias("a")), F.col("b"), F.col("a"), MANIFEST_PARTS)
    for k, (part, kind) in enumerate((("serverInfo", "server_info_changed"), ("capabilities", "capabilities_changed"))):
        p, q = (F.get_json_object(x, f"$.{part}") for x in ("b", "a"))
        top.append(_if(_member_differs(F.col("b"), F.col("a"), part), _change(6, F.lit(None).cast("string"), k, None, kind, F.lit(part), None, p, q)))
    tb, ta = F.col("parts_0"), F.col("parts_1")
    top.append(F.transform("changed", lambda n: _change(7, n, 0, None, "manifest_field_changed", n, None, F.try_element_at(tb, n), F.try_element_at(ta, n))))
    return _told(rows.unionByName(whole.select(key, F.explode(F.concat(*top)).alias("c"))), keys)


def listing_rows(pairs: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """(key, at, kind, path, tool, before, after, detail, diff): J1 to J9 of pairs of listings."""
    get, none = F.get_json_object, F.lit(None).cast("string")
    # Each reading of a document is a column of its own: what ``found`` names often is made once.
    read = {
        "text": lambda x: listings.clean(get(x, "$.server.description")), "version": lambda x: listings.clean(get(x, "$.server.version")), "status": lambda x: get(x, listings.STATUS_PATH),
        "raw": lambda x: get(x, "$.server.packages"), "ends": listings.endpoints, "packages": listings.packages, "secrets": listings.secret_inputs, "repos": listings.repository,
        "parts": lambda x: parts_of(get(x, "$.server")),
    }
    sides = [F.col(before), F.col(after)]
    changed = F.array_except(changed_members(*[get(x, "$.server") for x in sides]), F.array(*map(F.lit, listings.MODELLED)))
    staged = pairs.select(key, changed.alias("changed"), *[f(x).alias(f"{name}_{k}") for name, f in read.items() for k, x in enumerate(sides)])
    joined = lambda x: F.array_join(x, ", ")
    one = lambda step, kind, path, test, x, y, detail=None: _if(test, _change(0, none, step, None, kind, F.lit(path), None, x, y, detail))
    differ = lambda x, y: ~x.eqNullSafe(y)
    text, version, status, raw, ends, packages, secrets, repos, (pb, pa) = ((F.col(f"{name}_0"), F.col(f"{name}_1")) for name in read)
    identity = packages[0] != packages[1]
    found = [
        one(0, "server_description_changed", "server/description", differ(*text), *text),
        one(1, "endpoint_changed", "server/remotes", ends[0] != ends[1], joined(ends[0]), joined(ends[1]), set_detail(*ends)),
        one(2, "repository_changed", "server/repository", differ(*repos), *repos),
        one(3, "package_identity_changed", "server/packages", identity, joined(packages[0]), joined(packages[1]), set_detail(*packages)),
        one(4, "package_changed", "server/packages", ~identity & differ(*raw), *raw),
        one(5, "auth_requirement_changed", "server/auth", secrets[0] != secrets[1], joined(secrets[0]), joined(secrets[1]), set_detail(*secrets)),
        one(6, "version_bumped", "server/version", differ(*version), *version),
        one(7, "registry_status_changed", "_meta/status", differ(*status), *status),
    ]
    found.append(F.transform("changed", lambda n: _change(1, n, 0, None, "server_field_changed", F.concat(F.lit("server/"), n), None, F.try_element_at(pb, n), F.try_element_at(pa, n))))
    return _told(staged.select(key, F.explode(F.concat(*found)).alias("c")), [key])


def change_sets(pairs: DataFrame, changes: DataFrame, key: str, include_unchanged: bool = False) -> DataFrame:
    """One row a pair with its distinct ``kinds`` and number of changes (DF4).

    A pair without any change stays only with ``include_unchanged``.
    """
    sets = changes.groupBy(key).agg(F.array_sort(F.collect_set("kind")).alias("kinds"), F.count("*").alias("n_changes"))
    if not include_unchanged:
        return pairs.join(sets, key)
    return pairs.join(sets, key, "left").withColumns({"kinds": F.coalesce("kinds", F.array().cast("array<string>")), "n_changes": F.coalesce("n_changes", F.lit(0).cast("long"))})
