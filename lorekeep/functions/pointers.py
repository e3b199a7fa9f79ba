"""Values of JSON payloads by path, as column expressions over a payload that is parsed once.

A path reaches a value by type: text is only what is text in the JSON, a whole number what is one or is text that spells one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(payload: Column) -> Column:
    """The payload as a variant, null if it is no JSON. Make it a column of its own: every other function here takes that column."""
    return F.try_parse_json(payload)


def at(v: Column, path: str) -> Column:
    """Value at a path such as `payload.item.id`, objects and lists as JSON text; null if absent."""
    return F.try_variant_get(v, "$." + path, "string")


def raw_at(payload: Column, path: str) -> Column:
    """The part of unparsed JSON text at a path as it is written there, text without quotes; null if absent."""
    return F.get_json_object(payload, "$." + path)


def kind_at(v: Column, path: str) -> Column:
    """Type of the value at a path: STRING, BIGINT, BOOLEAN and so on; null if absent."""
    return F.schema_of_variant(F.try_variant_get(v, "$." + path, "variant"))


def _first(v: Column, paths: tuple[str, ...], pick: Callable[[Column], Column]) -> Column:
    """What pick makes of the first path for which it is not null. One array of values keeps the generated code small."""
    values = F.array(*(F.try_variant_get(v, "$." + p, "variant") for p in paths))
    return F.get(F.filter(F.transform(values, pick), lambda x: x.isNotNull()), F.lit(0))


def text_at(v: Column, *paths: str) -> Column:
    """The first of the paths that holds text, trimmed; empty text counts as absent, and so does what is not text."""
    said = lambda x: F.when(F.schema_of_variant(x) == "STRING", F.nullif(F.trim(F.try_variant_get(x, "$", "string")), F.lit("")))
    return _first(v, paths, said)


def bare_at(v: Column, *paths: str) -> Column:
    """The first of the paths that holds text that is not empty, as it is written."""
    return _first(v, paths, lambda x: F.when(F.schema_of_variant(x) == "STRING", F.nullif(F.try_variant_get(x, "$", "string"), F.lit(""))))


def long_at(v: Column, *paths: str) -> Column:
    """The first of the paths that holds a whole number, written as a number or as text."""
    spelled = lambda x: F.trim(F.when(F.schema_of_variant(x).isin("BIGINT", "STRING"), F.try_variant_get(x, "$", "string")))
    return _first(v, paths, lambda x: F.when(spelled(x).rlike("^[+-]?[0-9]+$"), spelled(x).try_cast("long")))


def true_at(v: Column, path: str) -> Column:
    """Whether the path holds a true boolean."""
    return F.coalesce((kind_at(v, path) == "BOOLEAN") & (at(v, path) == "true"), F.lit(False))
