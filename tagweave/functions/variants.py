"""Open JSON: strict parsing and strictly typed reading of ``tags``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagweave.functions.tags import flatten_categories, keep_import_categories
from tagweave.functions.text import let


def schema_of(value: Column) -> Column:
    return F.schema_of_variant(value)


def is_string(value: Column) -> Column:
    return F.coalesce(schema_of(value) == "STRING", F.lit(False))


def is_array(value: Column) -> Column:
    return F.coalesce(F.startswith(schema_of(value), F.lit("ARRAY")), F.lit(False))


def is_object(value: Column) -> Column:
    return F.coalesce(F.startswith(schema_of(value), F.lit("OBJECT")), F.lit(False))


def is_integer(value: Column) -> Column:
    # Booleans count: the original check accepts them as integers.
    return F.coalesce(schema_of(value).isin("BIGINT", "BOOLEAN"), F.lit(False))


def parse_strict(text: Column) -> Column:
    """JSON value, or NULL when the text is not exactly one JSON value.

    ``try_parse_json`` ignores whatever follows the first value; wrapping the
    text in an array and in an object exposes such a tail.
    """
    in_array = F.try_variant_get(
        F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>"
    )
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return let(
        in_array,
        lambda items: F.when((F.size(items) == 1) & in_object.isNotNull(), F.get(items, F.lit(0))),
    )


def parse_object(text: Column) -> Column:
    """JSON object, or NULL for broken JSON and for every other kind of value."""
    # Failed parses are costly; most texts that are no object show it at the ends.
    bare = F.btrim(text, F.lit(" \t\r\n"))
    braced = F.startswith(bare, F.lit("{")) & F.endswith(bare, F.lit("}"))
    return F.when(
        braced, let(parse_strict(text), lambda value: F.when(is_object(value), value))
    )


def field(value: Column, name: str) -> Column:
    """One member of an object; NULL when absent."""
    return F.try_variant_get(value, f"$.{name}", "variant")


def _string_array(value: Column) -> Column:
    """array<string> when ``value`` is a list holding strings only, else NULL."""
    # Reading as array<string> would turn 1 into "1", so test every element.
    items = F.try_variant_get(value, "$", "array<variant>")
    return F.when(
        F.forall(items, is_string),
        F.transform(items, lambda item: F.variant_get(item, "$", "string")),
    )


def string_member(value: Column, name: str) -> Column:
    member = field(value, name)
    return F.when(is_string(member), F.try_variant_get(value, f"$.{name}", "string"))


def category_map(value: Column) -> Column:
    """map<string, array<string>> of a category object; NULL when any part is off."""
    members = F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))
    typed = F.transform(
        members,
        lambda m: F.struct(m["key"].alias("key"), _string_array(m["value"]).alias("value")),
    )
    return F.when(
        F.forall(typed, lambda m: m["value"].isNotNull()), F.map_from_entries(typed)
    )


def tags_of(value: Column) -> Column:
    """Tag list of a list-or-categories value; NULL marks an invalid value.

    Lists stay as they are, repeats included; category objects are flattened.
    """
    return F.coalesce(_string_array(value), flatten_categories(category_map(value)))


def import_tags_of(value: Column) -> Column:
    """As :func:`tags_of`, keeping only the categories an import takes over."""
    # Categories are chosen before their lists are checked.
    members = F.try_variant_get(value, "$", "map<string,variant>")
    chosen = keep_import_categories(members)
    typed = F.transform(
        F.map_entries(chosen),
        lambda m: F.struct(m["key"].alias("key"), _string_array(m["value"]).alias("value")),
    )
    flat = F.when(
        F.forall(typed, lambda m: m["value"].isNotNull()),
        flatten_categories(F.map_from_entries(typed)),
    )
    return F.coalesce(_string_array(value), flat)
