"""Overlapping square tiles of a grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isopleth.functions.stats import dense_index, scalar
from isopleth.functions.time import month_number
from isopleth.grid import Grid


def tile_starts(length: int, size: int, stride: int) -> list[int]:
    """Starts by stride, plus the last position that fits."""
    starts = list(range(0, length - size + 1, stride))
    last = length - size
    return starts if starts[-1] == last else [*starts, last]


def enumerate_tiles(months: DataFrame, grid: Grid, size: int, stride: int) -> DataFrame:
    ys = F.array(*[F.lit(v) for v in tile_starts(grid.ny, size, stride)])
    xs = F.array(*[F.lit(v) for v in tile_starts(grid.nx, size, stride)])
    return months.select("t", F.explode(ys).alias("y0")).select("t", "y0", F.explode(xs).alias("x0"))


def on_tiles(df: DataFrame, grid: Grid, size: int, stride: int) -> DataFrame:
    """Each cell once per tile that holds it (at most a few), found by arithmetic on its index."""

    def holding(index: str, length: int) -> Column:
        starts = F.array(*[F.lit(v) for v in tile_starts(length, size, stride)])
        return F.filter(starts, lambda s: (s <= F.col(index)) & (F.col(index) < s + size))

    return df.withColumn("y0", F.explode(holding("iy", grid.ny))).withColumn("x0", F.explode(holding("ix", grid.nx)))


def admit(df: DataFrame, grid: Grid, size: int, stride: int, valid: str, land: str, least: float = 0.05) -> DataFrame:
    """Tiles whose valid and land shares of all ``size**2`` cells reach the limit."""
    cells = float(size * size)
    return (
        on_tiles(df, grid, size, stride)
        .groupBy("t", "y0", "x0")
        .agg(
            (F.count_if(F.col(valid)) / cells).alias("valid_fraction"),
            (F.count_if(F.col(land)) / cells).alias("land_fraction"),
        )
        .where((F.col("valid_fraction") >= least) & (F.col("land_fraction") >= least))
    )


def stitch(tile_rows: DataFrame, keys: Sequence[str], value: str, mask: str) -> DataFrame:
    """Mean of overlapping tile values per cell, NULL outside the mask."""
    return tile_rows.groupBy(*keys, "iy", "ix").agg(
        F.avg(F.when(F.col(mask), F.col(value))).alias(value)
    )


def even_sample(tiles: DataFrame, grid: Grid, k: int) -> DataFrame:
    """The tiles at ``k`` evenly spaced positions (truncated) of the (t, y0, x0) order."""
    tile_id = (month_number("t").cast("long") * grid.ny + F.col("y0")) * grid.nx + F.col("x0")
    named = tiles.withColumn("tile", tile_id)
    positions = dense_index(named, "tile")
    total = positions.agg(F.max("idx").alias("m"))
    step = F.col("_last").cast("double") / F.lit(float(k - 1))
    j = F.ceil(F.col("idx") / step - F.lit(1e-9))
    hits = F.exists(F.array(j - 1, j, j + 1), lambda i: (i >= 0) & (i < k) & (F.floor(i * step) == F.col("idx")))
    chosen = positions.withColumn("_last", scalar(total)).where(hits).drop("_last")
    return named.join(chosen, "tile")
