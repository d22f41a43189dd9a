"""Reading model responses without trusting their shape.

A response is parsed once into a variant; every element stays a variant of its own, so
one malformed element costs one row and not its batch."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def unwrap_list(response: Column, key: str) -> Column:
    """array<variant> under `key`, or of a bare array; NULL for anything else."""
    doc = F.try_parse_json(response)
    return F.coalesce(
        F.try_variant_get(doc, f"$.{key}", "array<variant>"),
        F.try_variant_get(doc, "$", "array<variant>"),
    )


def field(element: Column, name: str, as_type: str = "string") -> Column:
    """A field of an object element; NULL where the element is no object."""
    return F.try_variant_get(element, f"$.{name}", as_type)


def is_object(element: Column) -> Column:
    return F.coalesce(F.schema_of_variant(element).startswith("OBJECT"), F.lit(False))


def integers(element: Column, name: str) -> Column:
    """The integer entries of an array field, in order."""
    values = F.try_variant_get(element, f"$.{name}", "array<variant>")
    whole = F.filter(values, lambda v: F.schema_of_variant(v) == "BIGINT")
    return F.transform(whole, lambda v: F.try_variant_get(v, "$", "bigint"))
