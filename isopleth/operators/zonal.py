"""Polygons on the grid.

A polygon is a set of edge rows ``(poly_id, x1, y1, x2, y2)``.  Cells inside
are found by scan lines: each edge gives its crossing with the rows of cell
centres it spans, and the gaps between paired crossings are filled.  The work
is edge-rows plus covered cells, never cells times edges.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isopleth.functions import geo
from isopleth.grid import Grid


def cells_inside(edges: DataFrame, poly: str, grid: Grid) -> DataFrame:
    """``(poly, iy, ix)`` of the cell centres inside each polygon (even-odd rule)."""
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    first = F.greatest(F.ceil((low - grid.lat0) / grid.dlat), F.lit(0)).cast("int")
    last = F.least(F.ceil((high - grid.lat0) / grid.dlat) - 1, F.lit(grid.ny - 1)).cast("int")
    rows = edges.where(F.col("y1") != F.col("y2")).where(first <= last).select(
        poly, "x1", "y1", "x2", "y2", F.explode(F.sequence(first, last)).alias("iy")
    )
    share = (grid.lat() - F.col("y1")) / (F.col("y2") - F.col("y1"))
    crossings = rows.select(poly, "iy", (F.col("x1") + share * (F.col("x2") - F.col("x1"))).alias("x"))
    order = Window.partitionBy(poly, "iy").orderBy("x")
    spans = (
        crossings.withColumn("k", F.floor((F.row_number().over(order) - 1) / 2))
        .groupBy(poly, "iy", "k")
        .agg(F.min("x").alias("a"), F.max("x").alias("b"))
    )
    left = F.greatest(F.ceil((F.col("a") - grid.lon0) / grid.dlon), F.lit(0)).cast("int")
    right = F.least(F.ceil((F.col("b") - grid.lon0) / grid.dlon) - 1, F.lit(grid.nx - 1)).cast("int")
    return spans.where(left <= right).select(poly, "iy", F.explode(F.sequence(left, right)).alias("ix"))


def cells_touched(edges: DataFrame, poly: str, grid: Grid) -> DataFrame:
    """``(poly, iy, ix)`` of the cells that a polygon touches: an edge runs through the cell, or its centre is inside.

    A cell holds its lower and left side.  An edge is cut at the grid rows it
    spans, and each part gives its range of columns.
    """
    south, west = grid.lat0 - grid.dlat / 2, grid.lon0 - grid.dlon / 2
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    first = F.greatest(F.floor((low - south) / grid.dlat), F.lit(0)).cast("int")
    last = F.least(F.floor((high - south) / grid.dlat), F.lit(grid.ny - 1)).cast("int")
    rows = edges.where(first <= last).select(poly, "x1", "y1", "x2", "y2", F.explode(F.sequence(first, last)).alias("iy"))
    bottom = F.greatest(low, south + F.col("iy") * grid.dlat)
    top = F.least(high, south + (F.col("iy") + 1) * grid.dlat)
    at = lambda y: F.col("x1") + (y - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))
    flat = F.col("y1") == F.col("y2")
    one = F.when(flat, F.col("x1")).otherwise(at(bottom))
    two = F.when(flat, F.col("x2")).otherwise(at(top))
    left = F.greatest(F.floor((F.least(one, two) - west) / grid.dlon), F.lit(0)).cast("int")
    right = F.least(F.floor((F.greatest(one, two) - west) / grid.dlon), F.lit(grid.nx - 1)).cast("int")
    crossed = rows.where(left <= right).select(poly, "iy", F.explode(F.sequence(left, right)).alias("ix"))
    return crossed.unionByName(cells_inside(edges, poly, grid)).distinct()


def cover_fraction(edges: DataFrame, poly: str, grid: Grid, n: int) -> DataFrame:
    """Share of an n x n sub-grid that polygons touch."""
    fine = replace(
        grid,
        ny=grid.ny * n,
        nx=grid.nx * n,
        lat0=grid.lat0 - grid.dlat / 2 + grid.dlat / (2 * n),
        lon0=grid.lon0 - grid.dlon / 2 + grid.dlon / (2 * n),
        dlat=grid.dlat / n,
        dlon=grid.dlon / n,
    )
    covered = cells_touched(edges, poly, fine).select("iy", "ix").distinct()
    return covered.groupBy(
        F.floor(F.col("iy") / n).cast("int").alias("iy"), F.floor(F.col("ix") / n).cast("int").alias("ix")
    ).agg((F.count("*") / F.lit(float(n * n))).alias("fraction"))


def burn(inside: DataFrame, shapes: DataFrame, poly: str, order: str, value: str) -> DataFrame:
    """Attribute of the last shape on each cell; ids of 0 or less are skipped."""
    kept = shapes.where(F.col(value) > 0).select(poly, order, value)
    return inside.join(kept, poly).groupBy("iy", "ix").agg(
        F.max(F.struct(order, value))[value].alias(value)
    )


def basin_attribute(columns: Sequence[str], n_sources: int, requested: str | None = None) -> str:
    """The id column to burn: unique across regions if several sources are merged."""
    if requested:
        return requested
    preferred = ("HYBAS_ID", "PFAF_ID") if n_sources > 1 else ("PFAF_ID", "HYBAS_ID")
    for name in preferred:
        if name in columns:
            return name
    raise KeyError(f"no basin id among {list(columns)}")


def _segment_distance(px: Column, py: Column) -> Column:
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    along = ((px - F.col("x1")) * dx + (py - F.col("y1")) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(along, F.lit(0.0))))
    ex, ey = F.col("x1") + t * dx - px, F.col("y1") + t * dy - py
    return F.sqrt(ex * ex + ey * ey)


def outlet_basin(edges: DataFrame, shapes: DataFrame, poly: str, outlets: Mapping[str, tuple[float, float]],
                 area: str, main: str, reach: float = 2.0) -> DataFrame:
    """Main basin of each named outlet.

    The polygon with most upstream area within ``reach`` degrees, else the
    nearest one.  A point inside a polygon has distance 0.
    """
    points = F.array(
        *[F.struct(F.lit(n).alias("outlet"), F.lit(x).alias("px"), F.lit(y).alias("py")) for n, (x, y) in outlets.items()]
    )
    tested = edges.withColumn("_p", F.explode(points)).select("*", "_p.*")
    spans = ((F.col("y1") <= F.col("py")) & (F.col("py") < F.col("y2"))) | (
        (F.col("y2") <= F.col("py")) & (F.col("py") < F.col("y1"))
    )
    x = F.col("x1") + (F.col("py") - F.col("y1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0)) * (
        F.col("x2") - F.col("x1")
    )
    per = tested.groupBy("outlet", poly).agg(
        F.min(_segment_distance(F.col("px"), F.col("py"))).alias("edge_distance"),
        (F.count_if(spans & (x > F.col("px"))) % 2 == 1).alias("inside"),
    )
    distance = F.when(F.col("inside"), 0.0).otherwise(F.col("edge_distance"))
    near = per.join(shapes.select(poly, area, main), poly).withColumn("distance", distance).withColumn(
        "within", F.col("distance") <= reach
    )
    rank = F.struct(
        (~F.col("within")).alias("far"),
        F.when(F.col("within"), -F.col(area)).otherwise(F.col("distance")).alias("key"),
        F.col(poly),
        F.col(main),
        F.col("distance"),
    )
    best = near.groupBy("outlet").agg(F.min(rank).alias("r"))
    return best.select(
        "outlet",
        F.col(f"r.{poly}").alias(poly),
        F.col(f"r.{main}").alias(main),
        F.col("r.distance").alias("distance"),
        F.when(F.col("r.far"), "nearest").otherwise("largest_within_reach").alias("method"),
    )


def basin_summary(selected: DataFrame, shapes: DataFrame, edges: DataFrame, inside: DataFrame, cells: DataFrame,
                  poly: str, main: str, grid: Grid) -> DataFrame:
    """Cells, area and bounds of every polygon group chosen for an outlet."""
    members = selected.select("outlet", main).join(shapes.select(poly, main), main).select("outlet", poly)
    bounds = edges.join(members, poly).groupBy("outlet").agg(
        F.min(F.least("x1", "x2")).alias("west"),
        F.max(F.greatest("x1", "x2")).alias("east"),
        F.min(F.least("y1", "y2")).alias("south"),
        F.max(F.greatest("y1", "y2")).alias("north"),
    )
    covered = inside.join(members, poly).select("outlet", "iy", "ix").distinct()
    land = grid.attach(covered, cells.where("land").select("iy", "ix", "lat"))
    counts = land.groupBy("outlet").agg(
        F.count("*").alias("n_cells"), F.sum(geo.cell_area_km2("lat", grid.dlat, grid.dlon)).alias("km2")
    )
    return bounds.join(counts, "outlet", "left").fillna({"n_cells": 0, "km2": 0.0})
