"""Regular latitude-longitude grids and their coarse blocks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest cell table sent to every executor.  A half-degree globe has
#: 259,200 cells; ten numeric columns of it are about 20 MB.
BROADCAST_CELLS = 300_000


@dataclass(frozen=True)
class Grid:
    """Cell centres ``lat0 + iy*dlat`` and ``lon0 + ix*dlon``."""

    ny: int = 360
    nx: int = 720
    lat0: float = -89.75
    lon0: float = -179.75
    dlat: float = 0.5
    dlon: float = 0.5
    factor: int = 6

    @property
    def size(self) -> int:
        return self.ny * self.nx

    @property
    def block_columns(self) -> int:
        return -(-self.nx // self.factor)

    def lat(self, iy: Column | str = "iy") -> Column:
        return F.lit(self.lat0) + _col(iy) * F.lit(self.dlat)

    def lon(self, ix: Column | str = "ix") -> Column:
        return F.lit(self.lon0) + _col(ix) * F.lit(self.dlon)

    def cy(self, iy: Column | str = "iy") -> Column:
        return F.floor(_col(iy) / F.lit(self.factor)).cast("int")

    def cx(self, ix: Column | str = "ix") -> Column:
        return F.floor(_col(ix) / F.lit(self.factor)).cast("int")

    def block_id(self, iy: Column | str = "iy", ix: Column | str = "ix") -> Column:
        """``cy * (blocks per row) + cx``."""
        return (self.cy(iy).cast("long") * F.lit(self.block_columns) + self.cx(ix)).cast("long")

    def cell_id(self, iy: Column | str = "iy", ix: Column | str = "ix") -> Column:
        return (_col(iy).cast("long") * F.lit(self.nx) + _col(ix)).cast("long")

    def nearest_iy(self, lat: Column | str = "lat") -> Column:
        return nearest_index(lat, self.lat0, self.dlat, self.ny)

    def nearest_ix(self, lon: Column | str = "lon") -> Column:
        return nearest_index(lon, self.lon0, self.dlon, self.nx)

    def cells(self, spark: SparkSession) -> DataFrame:
        """Every cell of the grid, built on the executors from two sequences."""
        return (
            spark.range(0, self.ny)
            .select(F.col("id").cast("int").alias("iy"))
            .withColumn("ix", F.explode(F.sequence(F.lit(0), F.lit(self.nx - 1))))
            .withColumn("lat", self.lat())
            .withColumn("lon", self.lon())
        )

    def attach(self, df: DataFrame, cells: DataFrame, how: str = "inner") -> DataFrame:
        """Join per-cell columns to a field.

        The cell table is broadcast only when the grid itself bounds its size;
        on a larger grid both sides shuffle on the cell key.
        """
        side = F.broadcast(cells) if self.size <= BROADCAST_CELLS else cells
        return df.join(side, ["iy", "ix"], how)


def nearest_index(value: Column | str, first: float, step: float, count: int) -> Column:
    """Index of the closest centre; a tie goes to the lower index, ends are clamped."""
    raw = F.ceil((_col(value) - F.lit(first)) / F.lit(step) - F.lit(0.5)).cast("int")
    return F.when(raw < 0, 0).when(raw >= count, count - 1).otherwise(raw)


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value
