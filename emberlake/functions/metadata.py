"""Values of JSON metadata by path, with defaults for what is missing, null or of another type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlake.operators.stage import computed

#: What a value may be read as: type name to the kinds of JSON values that count as it.
TYPES = {"boolean": ("BOOLEAN",), "long": ("BIGINT",), "double": ("BIGINT", "DOUBLE", "DECIMAL"), "string": None}


def parsed(col: Column) -> Column:
    """Metadata text as a variant; null where it is no JSON."""
    return F.try_parse_json(col)


def value(variant: Column, path: str, kind: str, default: object = None) -> Column:
    """A value by its path (``$.a.b[0]``) as boolean, long, double or string.

    Missing paths, JSON nulls and values of another type give the default. As text, every
    scalar counts, written as JSON writes it, and objects and arrays come as JSON text.
    """
    at = F.try_variant_get(variant, path, "variant")
    shape = F.schema_of_variant(at)
    there = at.isNotNull() & ~F.is_variant_null(at)
    if kind == "string":
        nested = shape.startswith("OBJECT") | shape.startswith("ARRAY")
        found = F.when(there, F.when(nested, F.to_json(at)).otherwise(F.try_variant_get(variant, path, "string")))
    else:
        fits = F.lit(False)
        for name in TYPES[kind]:
            fits = fits | shape.startswith(name)
        found = F.when(there & fits, F.try_variant_get(variant, path, kind))
    return found if default is None else F.coalesce(found, F.lit(default))


def promoted(df: DataFrame, column: str, fields: dict[str, tuple[str, str, object]]) -> DataFrame:
    """Add typed columns from a JSON text column, parsed once a row: name to (path, kind, default)."""
    once = computed(df, _variant=parsed(F.col(column)))
    return once.withColumns({name: value(F.col("_variant"), *spec) for name, spec in fields.items()}).drop("_variant")
