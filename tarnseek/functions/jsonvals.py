"""JSON record values: lenient decode, dynamic projection, number narrowing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tarnseek.functions.columns import let

_LENIENT = {"allowSingleQuotes": "true", "allowUnquotedFieldNames": "true"}


def decode_object(value: Column) -> Column:
    """Record text → map of member name to text; NULL if it isn't an object.

    Nested objects and arrays keep their JSON text. A member that is JSON null
    is present in the map with a NULL value.
    """
    return F.from_json(value, "map<string,string>", _LENIENT)


def member(decoded: Column, name: str) -> Column:
    return F.try_element_at(decoded, F.lit(name))


def member_or_null_text(decoded: Column, name: str) -> Column:
    """The member as text; the text "null" when the record lacks it."""
    present = F.map_contains_key(decoded, name)
    return F.when(present, member(decoded, name)).otherwise(F.lit("null"))


def value_kind(value: Column, path: str) -> Column:
    """Type of a JSON value: int, long, double, string, boolean, array, object or null.

    A whole number is an int if it fits 32 bits, else a long if it fits 64,
    else a double.
    """
    variant = F.try_variant_get(F.try_parse_json(value), path, "variant")

    def classify(v: Column) -> Column:
        def named(kind: Column) -> Column:
            fits_int = F.try_variant_get(v, "$", "bigint").between(-(2**31), 2**31 - 1)
            return (
                F.when(kind == "BIGINT", F.when(fits_int, "int").otherwise("long"))
                .when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), "double")
                .when(kind.startswith("ARRAY"), "array")
                .when(kind.startswith("OBJECT"), "object")
                .when(kind == "VOID", "null")
                .otherwise(F.lower(kind))
            )

        return F.when(v.isNotNull(), let(F.schema_of_variant(v), named))

    return let(variant, classify)


def result_json(columns: list[str]) -> Column:
    """One result row as JSON text; a missing value is written as null."""
    return F.to_json(
        F.struct(*columns),
        {"ignoreNullFields": "false", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"},
    )
