"""Unit conversion rules.  The three water-height rules differ on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from isopleth.functions.stats import col

# Accepted spellings of water-height units, after lower-casing
# and removing blanks, "^" and "_".
SPELLINGS = {
    "mm": "mm",
    "millimeter": "mm",
    "millimeters": "mm",
    "mmequivalentwaterheight": "mm",
    "cm": "cm",
    "centimeter": "cm",
    "centimeters": "cm",
    "cmequivalentwaterheight": "cm",
    "kgm-2": "kg_m-2",
    "kg/m2": "kg_m-2",
    "kgm−2": "kg_m-2",
}
# Spellings of the rule that also accepts metres, and factors to mm.
WITH_METRE = {
    "mm": 1.0,
    "mmequivalentwaterheight": 1.0,
    "mmewh": 1.0,
    "kgm-2": 1.0,
    "kg/m2": 1.0,
    "cm": 10.0,
    "cmequivalentwaterheight": 10.0,
    "cmewh": 10.0,
    "m": 1000.0,
    "meter": 1000.0,
    "metre": 1000.0,
}
FEET_TO_METRES = 0.3048


def _compact(unit: Column | str) -> Column:
    lowered = F.replace(F.lower(F.trim(col(unit))), F.lit("²"), F.lit("2"))
    return F.translate(lowered, "^ _", "")


def _lookup(key: Column, table: dict[str, object]) -> Column:
    pairs: list[Column] = []
    for name, value in table.items():
        pairs += [F.lit(name), F.lit(value)]
    return F.try_element_at(F.create_map(*pairs), key)


def canonical(unit: Column | str, strict: bool = True) -> Column:
    """``mm``, ``cm`` or ``kg_m-2``; unknown spellings fail (or give NULL if not strict)."""
    found = _lookup(F.coalesce(_compact(unit), F.lit("")), SPELLINGS)
    if not strict:
        return found
    complaint = F.concat(F.lit("no factor to mm for unit "), F.coalesce(col(unit), F.lit("<none>")))
    return F.coalesce(found, F.raise_error(complaint).cast("string"))


def factor_to_mm(unit: Column | str, strict: bool = True) -> Column:
    name = canonical(unit, strict)
    return F.when(name == "cm", 10.0).when(name.isNotNull(), 1.0)


def factor_to_mm_with_metre(unit: Column | str) -> Column:
    """Also accepts ``mmEWH``, ``cmEWH`` and metres; NULL if unknown."""
    return _lookup(F.replace(F.lower(F.trim(col(unit))), F.lit(" "), F.lit("")), WITH_METRE)


def to_mm_by_substring(value: Column | str, unit: Column | str) -> Column:
    """Order matters: mass per area, then mm, then anything with an m (or no unit) is metres."""
    u = F.lower(F.coalesce(col(unit), F.lit("")))
    v = col(value)
    return (
        F.when(u.contains("kg m-2") | u.contains("kg m**-2"), v)
        .when(u.contains("mm"), v)
        .when(u.contains("m") | (u == ""), v * 1000.0)
        .otherwise(v)
    )


def depth_to_storage(value: Column | str, unit: Column | str, strict: bool = True) -> Column:
    """Depth below surface as a storage proxy in metres (sign flipped once).

    Strict: only ``ft`` and ``m``, anything else NULL.  Lenient: ``ft`` is
    converted, every other unit passes unchanged.
    """
    u, v = col(unit), col(value)
    if strict:
        return F.when(u == "ft", -(v * FEET_TO_METRES)).when(u == "m", -v)
    feet = F.lower(F.trim(F.coalesce(u, F.lit("")))) == "ft"
    return F.when(feet, -(v * FEET_TO_METRES)).otherwise(-v)
