"""Type tests on VARIANT values.

``from_json`` turns ``7`` into ``"7"`` when a string is asked for; the decoders
here must tell the two apart, so they look at the JSON type first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from driftpanel.functions.binding import bind

ABSENT = "VOID"
TEXT = "STRING"
WHOLE = "BIGINT"
FLAG = "BOOLEAN"
OBJECT = "OBJECT"
ARRAY = "ARRAY"
NUMBERS = ("BIGINT", "DECIMAL", "DOUBLE")


def at(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def fields(value: Column, *names: str) -> Column:
    """Struct of an object's fields, whatever the case of their names; null where absent.

    An object is opened once. Of names that differ in case only, the one that sorts
    last counts, so the lower-case one where it is there.
    """
    return lowered(opened(value), *names)


def opened(value: Column) -> Column:
    """An object's fields as a map; null if it is none."""
    return F.try_variant_get(value, "$", "map<string, variant>")


def nothing(value: Column) -> Column:
    """Absent or null."""
    return value.isNull() | F.is_variant_null(value)


def lowered(opened: Column, *names: str) -> Column:
    """Struct of a map's values by lower-case name; of several, the last."""
    def named(parts: Column) -> Column:
        # A position of 0, for a name that isn't there, reads as null.
        return F.struct(*[
            F.get(parts["values"], (F.array_position(parts["names"], name) - 1).cast("int")).alias(name) for name in names
        ])

    keys = F.transform(F.reverse(F.map_keys(opened)), F.lower)
    return bind(F.struct(keys.alias("names"), F.reverse(F.map_values(opened)).alias("values")), named)


def json_type(value: Column) -> Column:
    """Leading word of the value's type; a missing value and null are ``VOID``.

    Meant for single items and their fields: the type of a whole document would
    spell out everything in it.
    """
    spelled = F.coalesce(F.schema_of_variant(value), F.lit(ABSENT))
    return F.substring_index(F.substring_index(spelled, "<", 1), "(", 1)


def has_type(value: Column, *kinds: str) -> Column:
    """True when the value is absent, null, or one of ``kinds``."""
    return json_type(value).isin(ABSENT, *kinds)


def all_of(conditions) -> Column:
    return reduce(lambda left, right: left & right, conditions)


def text_at(value: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(value, path, "string"), F.lit(""))


def whole_at(value: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(value, path, "bigint"), F.lit(0).cast("bigint"))


def number_at(value: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(value, path, "double"), F.lit(0.0))


def flag_at(value: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(value, path, "boolean"), F.lit(False))


def list_at(value: Column, path: str) -> Column:
    """Elements of a JSON array; null when absent or not an array."""
    return F.try_variant_get(value, path, "array<variant>")
