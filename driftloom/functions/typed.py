"""JSON values with their types: members and paths as JSON text that keeps quotes, and two equalities.

``from_json`` to strings and ``get_json_object`` drop the quotes of strings, so ``"1"`` and ``1`` look
alike. Here VARIANT tells which values are strings, and the text tells the rest, as VARIANT itself has
no equality and reads ``1.0`` as ``1``. Null and absent members are alike: both are null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens of JSON text: a string, a number, a word, or a mark.
_TOKEN = r'"(?:[^"\\]|\\.)*"|-?[0-9][0-9.eE+-]*|[a-z]+|[\[\]{},:]'


def _text(value: Column, plain: Column) -> Column:
    return F.when(F.schema_of_variant(value) == "STRING", F.to_json(value)).otherwise(plain)


def typed_members(document: Column, plain: Column | None = None) -> Column:
    """Top-level members of a JSON object as a map of JSON texts; null and other values have none.

    ``plain`` is the map without types where it is already read: maps are zipped without codegen, so Spark would read it anew.
    """
    plain = F.from_json(document, "map<string,string>") if plain is None else plain
    typed = F.map_zip_with(plain, F.from_json(document, "map<string,variant>"), lambda _, text, value: _text(value, text))
    return F.coalesce(typed, plain, F.create_map().cast("map<string,string>"))


def typed_at(document: Column, path: str) -> Column:
    """JSON text of what lies at a path; null where there is nothing, or null."""
    return _text(F.try_variant_get(F.try_parse_json(document), path, "variant"), F.get_json_object(document, path))


def string_at(document: Column, path: str) -> Column:
    """A JSON string at a path; null for all else."""
    value = F.try_variant_get(F.try_parse_json(document), path, "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.get_json_object(document, path))


def quoted(text: Column) -> Column:
    """A string as JSON text."""
    return F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]$", "")


def object_text(members: Column) -> Column:
    """JSON text of a map of JSON texts, by name."""
    entries = F.transform(F.array_sort(F.map_entries(members)), lambda e: F.concat(quoted(e["key"]), F.lit(":"), F.coalesce(e["value"], F.lit("null"))))
    return F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}"))


def python_form(text: Column) -> Column:
    """Key-sorted JSON text in a form that is equal where Python's values are: 1, 1.0 and true are one."""

    def form(token: Column) -> Column:
        number = token.try_cast("double")
        whole = (number == F.floor(number)) & (F.abs(number) < 1e37)
        return (
            F.when(token == "true", "1").when(token == "false", "0")
            .when(token.rlike("^-?0+$"), "0").when(token.rlike("^-?[0-9]+$"), token)
            .when(token.rlike("^-?[0-9]") & whole, number.try_cast("decimal(38,0)").cast("string"))
            .when(token.rlike("^-?[0-9]"), number.cast("string"))
            .otherwise(token)
        )

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), form), "")


def changed_members(before: Column, after: Column, equality: str = "json") -> Column:
    """Sorted names of members that differ between two JSON objects.

    ``json``: as JSON text, so 1, 1.0, true and "1" are four values. ``python``: as Python compares.
    """
    return differing_members(typed_members(before), typed_members(after), equality)


def differing_members(before: Column, after: Column, equality: str = "json") -> Column:
    """``changed_members`` of two objects that ``typed_members`` has read."""
    form = {"json": lambda x: x, "python": python_form}[equality]
    both = F.map_zip_with(before, after, lambda _, b, a: ~form(b).eqNullSafe(form(a)))
    return F.array_sort(F.map_keys(F.map_filter(both, lambda _, differs: differs)))
