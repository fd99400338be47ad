"""Filters and builders for JSON kept as text."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from dealweave.functions.order import as_col


def json_contains(doc: str | Column, wanted: dict) -> Column:
    """True when the JSON text holds every entry of ``wanted`` (containment, as a filter on metadata).

    Objects are compared key by key and have to be objects, a list asks for all of its elements in any order, other
    values for the same type and value: numbers by value (1 equals 1.0, not "1"), None for a JSON null that is there.
    NULL and text that is no JSON hold nothing.
    """
    return F.coalesce(_holds(F.try_parse_json(as_col(doc)), wanted), F.lit(False))


def _holds(found: Column, wanted) -> Column:
    """Does the variant value hold ``wanted``? NULL or false when it does not."""
    kind = F.schema_of_variant(found)
    if isinstance(wanted, dict):
        parts = [_holds(F.try_variant_get(found, f"$[{_quoted(key)}]", "variant"), v) for key, v in wanted.items()]
        return reduce(and_, parts, F.startswith(kind, F.lit("OBJECT")))
    if isinstance(wanted, (list, tuple)):
        items = F.try_variant_get(found, "$", "array<variant>")
        parts = [F.exists(items, _holder(v)) for v in wanted]
        return reduce(and_, parts, F.startswith(kind, F.lit("ARRAY")))
    if wanted is None:
        return kind == "VOID"
    if isinstance(wanted, bool):
        return (kind == "BOOLEAN") & (F.try_variant_get(found, "$", "boolean") == F.lit(wanted))
    if isinstance(wanted, str):
        return (kind == "STRING") & (F.try_variant_get(found, "$", "string") == F.lit(wanted))
    number = F.startswith(kind, F.lit("DECIMAL")) | kind.isin("BIGINT", "DOUBLE", "FLOAT")
    return number & (F.try_variant_get(found, "$", "double") == F.lit(float(wanted)))


def _holder(wanted):
    return lambda item: F.coalesce(_holds(item, wanted), F.lit(False))


def _quoted(key: str) -> str:
    return f'"{key}"' if '"' not in key else f"'{key}'"


def compact_json(**fields: Column) -> Column:
    """JSON object of the given fields; absent (NULL) fields are left out."""
    return F.to_json(F.struct(*[value.alias(name) for name, value in fields.items()]))
