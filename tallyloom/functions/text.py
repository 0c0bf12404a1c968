"""Text and JSON-value expressions.

Three notions of "nothing there" are kept apart:

* ``is_empty``  - null, ``""``, ``{}``, ``[]``
* ``is_falsy``  - additionally ``false`` and any numeric zero
* ``to_text``   - null becomes ``""``, strings are stripped, the rest is JSON text

JSON text comes from VARIANT, so object keys are sorted and the form is compact.
``functions.pretty`` offers the indented, source-ordered rendering.
"""

from pyspark.sql import Column, functions as F

from tallyloom.functions.fixed_values import WHITESPACE


def strip(text: Column) -> Column:
    """Remove Unicode whitespace at both ends; inspects only the edges."""
    return F.trim(text, F.lit(WHITESPACE))


def field(record: Column, key: str) -> Column:
    """``record[key]`` as VARIANT; SQL NULL when absent or ``record`` is no object."""
    return F.try_variant_get(record, f"$['{key}']", "variant")


def as_string(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def is_string(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))


def is_empty(value: Column) -> Column:
    kind = F.schema_of_variant(value)
    return (
        F.when(value.isNull() | kind.isin("VOID", "OBJECT<>"), F.lit(True))
        .when(kind == "STRING", as_string(value) == "")
        .when(kind == "ARRAY<VOID>", F.to_json(value) == "[]")  # also the kind of [null]
        .otherwise(F.lit(False))
    )


def is_falsy(value: Column) -> Column:
    kind = F.schema_of_variant(value)
    number = as_string(value).try_cast("double")
    return is_empty(value) | F.coalesce(
        F.when(kind == "STRING", F.lit(False)).when(kind == "BOOLEAN", as_string(value) == "false").otherwise(number == 0),
        F.lit(False),
    )


def _first(record: Column, keys, unwanted) -> Column:
    # A filter over the few candidates names each value once; a chain of
    # conditions would repeat its extraction in every test.
    values = F.array(*[field(record, k) for k in keys])
    return F.get(F.filter(values, lambda v: ~unwanted(v)), F.lit(0))


def first_filled(record: Column, keys) -> Column:
    """First value in key order that is not empty; SQL NULL if none is."""
    return _first(record, keys, is_empty)


def first_truthy(record: Column, keys) -> Column:
    """First value in key order that is not falsy; SQL NULL if none is."""
    return _first(record, keys, is_falsy)


def to_text(value: Column) -> Column:
    """Canonical text of a VARIANT value. JSON text has no blanks at its ends to lose."""
    return F.coalesce(strip(as_string(value)), F.lit(""))


# Equal objects must give equal text whatever their key order; VARIANT sorts keys.
stable_text = to_text


def blank_to_null(text: Column) -> Column:
    return F.when(text != "", text)
