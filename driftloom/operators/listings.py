"""Changes between two states of a published listing document, as native JSON expressions.

Documents are canonical JSON text, so sub-documents compare as text: ``1`` and ``1.0`` differ, and
a null value equals an absent one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.functions.typed import typed_at

# Modelled keys of the server object; the others are compared as they are.
MODELLED = ("$schema", "name", "description", "version", "repository", "remotes", "packages")
STATUS_PATH = "$._meta['io.modelcontextprotocol.registry/official'].status"
#: Preference of transports for the primary endpoint.
TRANSPORTS = ("streamable-http", "sse")


def clean(value: Column) -> Column:
    """A text without surrounding white space of any kind; null if nothing is left."""
    return F.nullif(F.regexp_replace(value, r"(?U)^\s+|\s+$", ""), F.lit(""))


def _items(document: Column, path: str) -> Column:
    return F.coalesce(F.from_json(F.get_json_object(document, path), "array<string>"), F.array().cast("array<string>"))


def repository(document: Column) -> Column:
    """Repository URL, given as an object's ``url`` or as a bare string."""
    raw = F.get_json_object(document, "$.server.repository")
    return clean(F.when(raw.startswith("{"), F.get_json_object(raw, "$.url")).otherwise(raw))


def endpoints(document: Column, distinct: bool = False) -> Column:
    """Sorted URLs of the remotes; repeated URLs count, but not in the set form."""
    urls = F.transform(_items(document, "$.server.remotes"), lambda r: clean(F.get_json_object(r, "$.url")))
    found = F.array_sort(F.array_compact(urls))
    return F.array_distinct(found) if distinct else found


def primary_endpoint(document: Column) -> Column:
    """URL of the remote with the best transport; the first of several."""

    def ranked(r: Column, at: Column) -> Column:
        kind = F.get_json_object(r, "$.type")
        rank = F.lit(len(TRANSPORTS))
        for k, name in reversed(list(enumerate(TRANSPORTS))):
            rank = F.when(kind == name, k).otherwise(rank)
        return F.struct(rank.alias("rank"), at.alias("at"), clean(F.get_json_object(r, "$.url")).alias("url"))

    named = F.filter(F.transform(_items(document, "$.server.remotes"), ranked), lambda x: x["url"].isNotNull())
    return F.array_min(named)["url"]


def packages(document: Column) -> Column:
    """Sorted ``type:identifier`` of the packages; the name stands in for a missing identifier."""

    def identity(p: Column) -> Column:
        name = F.coalesce(clean(F.get_json_object(p, "$.identifier")), clean(F.get_json_object(p, "$.name")), F.lit("?"))
        return F.concat(F.coalesce(clean(F.get_json_object(p, "$.registryType")), F.lit("?")), F.lit(":"), name)

    return F.array_sort(F.transform(_items(document, "$.server.packages"), identity))


def secret_inputs(document: Column) -> Column:
    """Sorted distinct names of secret headers and environment variables."""

    def secrets(item: Column, path: str, mark: str) -> Column:
        inputs = F.coalesce(F.from_json(F.get_json_object(item, path), "array<string>"), F.array().cast("array<string>"))
        # The JSON text of a true is not that of "true".
        own = lambda x: F.from_json(x, "map<string,string>")
        named = F.filter(inputs, lambda x: F.coalesce(x.rlike(r'"isSecret"\s*:\s*true\b') & (own(x)["isSecret"] == "true") & clean(own(x)["name"]).isNotNull(), F.lit(False)))
        return F.transform(named, lambda x: F.concat(F.lit(mark), clean(own(x)["name"])))

    headers = F.flatten(F.transform(_items(document, "$.server.remotes"), lambda r: secrets(r, "$.headers", "header:")))
    variables = F.flatten(F.transform(_items(document, "$.server.packages"), lambda p: secrets(p, "$.environmentVariables", "env:")))
    return F.array_sort(F.array_union(headers, variables))


def listing_changes(pairs: DataFrame, before: str, after: str) -> DataFrame:
    """Add ``kinds``: the kinds of change from document ``before`` to ``after``, in report order."""
    b, a = F.col(before), F.col(after)
    at = lambda path: ~clean(F.get_json_object(b, path)).eqNullSafe(clean(F.get_json_object(a, path)))
    identity = packages(b) != packages(a)
    raw_packages = ~F.get_json_object(b, "$.server.packages").eqNullSafe(F.get_json_object(a, "$.server.packages"))
    maps = [F.coalesce(F.from_json(F.get_json_object(x, "$.server"), "map<string,string>"), F.create_map().cast("map<string,string>")) for x in (b, a)]
    keys = F.array_except(F.array_union(F.map_keys(maps[0]), F.map_keys(maps[1])), F.array(*map(F.lit, MODELLED)))
    other = F.filter(F.array_sort(keys), lambda k: ~F.try_element_at(maps[0], k).eqNullSafe(F.try_element_at(maps[1], k)))
    cases = [
        (at("$.server.description"), "server_description_changed"),
        (endpoints(b) != endpoints(a), "endpoint_changed"),
        (~repository(b).eqNullSafe(repository(a)), "repository_changed"),
        (identity, "package_identity_changed"),
        (~identity & raw_packages, "package_changed"),
        (secret_inputs(b) != secret_inputs(a), "auth_requirement_changed"),
        (at("$.server.version"), "version_bumped"),
        (~F.get_json_object(b, STATUS_PATH).eqNullSafe(F.get_json_object(a, STATUS_PATH)), "registry_status_changed"),
    ]
    known = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(k)) for t, k in cases]))
    return pairs.withColumn("kinds", F.concat(known, F.transform(other, lambda k: F.concat(F.lit("server_field_changed:"), k))))


def replaced(before: Column, after: Column) -> Column:
    """Whether an entity became another: repository or first endpoint, set on both sides, differ."""
    moved = repository(before) != repository(after)
    first = F.get(endpoints(before), 0) != F.get(endpoints(after), 0)
    return F.coalesce(moved, F.lit(False)) | F.coalesce(first, F.lit(False))


def launch_arguments(package: Column) -> Column:
    """Texts of a package's own arguments in their order: names of named ones, and values or else defaults.

    A named argument without a name is left out, as is a positional one without a value; none is made up.
    """
    items = F.filter(F.from_json(F.get_json_object(package, "$.packageArguments"), "array<string>"), lambda i: i.startswith("{"))

    def told(item: Column, path: str) -> Column:
        word = F.get_json_object(item, path)
        return F.when(typed_at(item, path).isin("true", "false"), F.initcap(word)).otherwise(word)

    def texts(item: Column) -> Column:
        value, name = F.coalesce(told(item, "$.value"), told(item, "$.default")), told(item, "$.name")
        named = F.coalesce(F.get_json_object(item, "$.type") == "named", F.lit(False))
        return F.when(~named, F.array(value)).when(F.coalesce(name, F.lit("")) != "", F.array(name, value)).otherwise(F.array().cast("array<string>"))

    return F.coalesce(F.array_compact(F.flatten(F.transform(items, texts))), F.array().cast("array<string>"))
