"""Codes of named values."""

from itertools import chain

from pyspark.sql import functions as F


def _codes(names):
    return F.create_map(*chain.from_iterable((F.lit(n), F.lit(i)) for i, n in enumerate(names)))


def encode_enum(value, names, unknown):
    """Code of a name; `unknown` for a name that is not listed and for null."""
    return F.coalesce(F.try_element_at(_codes(names), value), F.lit(unknown))


def resolve_enum(value, names, unknown):
    """Code of a name in any case or of a number given as text; null stays null."""
    code = F.coalesce(
        F.try_element_at(_codes(names), F.lower(value)), value.try_cast("int"), F.lit(unknown)
    )
    return F.when(value.isNotNull(), code)
