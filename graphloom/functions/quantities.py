"""Quantities in base units, as column expressions over canonical literals (an extension)."""

from __future__ import annotations

from decimal import Decimal
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import UNITS
from .identity import content_digest

# How many base units (metre, radian, kilogram, second, newton, pascal) a unit is.
FACTORS = {
    "nm": "1e-9", "um": "1e-6", "mm": "1e-3", "cm": "1e-2", "m": "1", "in": "0.0254", "ft": "0.3048", "rad": "1", "deg": "0.017453292519943295",
    "mg": "1e-6", "g": "1e-3", "kg": "1", "ms": "1e-3", "s": "1", "min": "60", "N": "1", "Pa": "1", "MPa": "1e6",
}
#: Decimals of 38 digits, 20 of them behind the point, hold every unit's factor.
EXACT = "decimal(38,20)"


def _lookup(values: dict[str, str], key: Column, kind: str) -> Column:
    return F.try_element_at(F.create_map(*map(F.lit, chain.from_iterable(values.items()))), key).cast(kind)


def dimension(literal: Column) -> Column:
    """The dimension of a canonical literal with a known unit, else null."""
    return _lookup(UNITS, F.get_json_object(literal, "$.unit"), "string")


def in_base_units(literal: Column) -> Column:
    """The value of a canonical numeric literal in base units, or as it is without a unit; null if it is no
    number, has an unknown unit, or does not fit. Signs are unary operators, so literals are not negative."""
    unit = F.get_json_object(literal, "$.unit")
    value = F.get_json_object(literal, "$.value").try_cast(EXACT)
    known = {u: format(Decimal(f), "f") for u, f in FACTORS.items()}
    factor = F.when(unit.isNull(), F.lit("1").cast(EXACT)).otherwise(_lookup(known, unit, EXACT))
    return F.when(F.get_json_object(literal, "$.kind") == "literal", F.try_multiply(value, factor))


def value_digest(literal: Column) -> Column:
    """A digest of a literal's dimension and value in base units: the same for 10 mm and 1 cm, and for 0.1 and 0.10.
    Null for what is no number with a known unit or none."""
    plain = F.regexp_replace(in_base_units(literal).cast("string"), r"(\.[0-9]*?)0+$", "$1")
    return F.when(in_base_units(literal).isNotNull(), content_digest(F.coalesce(dimension(literal), F.lit("scalar")), F.rtrim(plain, F.lit("."))))
