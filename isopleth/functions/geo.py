"""Coordinate expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from isopleth.functions.stats import col

EARTH_RADIUS_KM = 6371.0088


def wrap_longitude(lon: Column | str) -> Column:
    """Longitude in [-180, 180)."""
    return F.pmod(col(lon) + 180.0, F.lit(360.0)) - 180.0


def area_weight(lat: Column | str) -> Column:
    """cos(latitude), never negative."""
    w = F.cos(F.radians(col(lat)))
    return F.when(w < 0, 0.0).otherwise(w)


def cell_area_km2(lat: Column | str, dlat: float, dlon: float) -> Column:
    """Spherical cell area in square kilometres."""
    return (
        F.lit(EARTH_RADIUS_KM**2)
        * F.radians(F.lit(dlat))
        * F.radians(F.lit(dlon))
        * F.cos(F.radians(col(lat)))
    )


def index_half_even(value: Column | str, first: float, step: float) -> Column:
    """Cell index by rounding, halves to the even index."""
    return F.rint((col(value) - F.lit(first)) / F.lit(step)).cast("int")


def index_floor(value: Column | str, first: float, step: float) -> Column:
    """Cell index by cell edges: the lower edge belongs to the cell."""
    return F.floor((col(value) - F.lit(first - step / 2)) / F.lit(step)).cast("int")


def box_index(value: Column | str, origin: float, size: float) -> Column:
    """Number of the fixed box a coordinate falls in."""
    return F.floor((col(value) - F.lit(origin)) / F.lit(size)).cast("long")


def box_id(lat: Column | str, lon: Column | str, size: float) -> Column:
    """Row-major id of ``size``-degree boxes anchored at (-90, -180)."""
    per_row = int(round(360.0 / size))
    return box_index(lat, -90.0, size) * F.lit(per_row) + box_index(lon, -180.0, size)


def quad_block_id(block: Column | str, per_row: int) -> Column:
    """Id of the 2x2 group of blocks a block belongs to."""
    b = col(block).cast("long")
    y, x = F.floor(b / per_row), F.pmod(b, F.lit(per_row))
    return (F.floor(y / 2) * F.lit(per_row // 2) + F.floor(x / 2)).cast("long")
