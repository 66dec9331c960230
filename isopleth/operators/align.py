"""Joining fields, calendars, static layers and stations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isopleth.grid import Grid


def align_inner(long: DataFrame, fields: Sequence[str], keys: Sequence[str], field: str = "field",
                value: str = "value") -> DataFrame:
    """A column per field on the keys all of them have.  One shuffle for any number of fields."""
    wide = long.where(F.col(field).isin(*fields) & F.col(value).isNotNull()).groupBy(*keys).agg(
        *[F.max(F.when(F.col(field) == f, F.col(value))).alias(f) for f in fields]
    )
    return wide.dropna(subset=list(fields))


def reindex_months(df: DataFrame, months: DataFrame, cells: Sequence[str]) -> DataFrame:
    """Every cell of the source on the given months; absent months have NULL values."""
    calendar = months.select(F.sort_array(F.collect_set("t")).alias("ts"))
    grid = df.select(*cells).distinct().withColumn("ts", calendar_array(calendar)).withColumn("t", F.explode("ts"))
    return grid.drop("ts").join(df, [*cells, "t"], "left")


def calendar_array(calendar: DataFrame) -> Column:
    """A one-row calendar (a few hundred months) as a value."""
    return calendar.scalar()


def month_lookup(wanted: DataFrame, released: DataFrame, order: str, policy: str = "drop") -> DataFrame:
    """Wanted months with the latest release of the same month.

    Months without one are left out (``drop``), fail the query (``error``), or
    stay with null values (``keep``); :func:`months_without_release` lists them.
    """
    if policy not in ("drop", "error", "keep"):
        raise ValueError(f"no policy {policy}")
    rest = [c for c in released.columns if c not in ("month", order)]
    last = released.groupBy("month").agg(F.max(F.struct(order, *rest)).alias("_r"))
    joined = wanted.join(last, "month", "inner" if policy == "drop" else "left")
    if policy == "error":
        broken = F.raise_error(F.concat(F.lit("no release for "), F.col("month").cast("string")))
        joined = joined.withColumn("_r", F.when(F.col("_r").isNull(), broken.cast(last.schema["_r"].dataType)).otherwise(F.col("_r")))
    return joined.select("month", F.col(f"_r.{order}").alias(order), *[F.col(f"_r.{c}").alias(c) for c in rest])


def months_without_release(wanted: DataFrame, released: DataFrame) -> DataFrame:
    """Wanted months that no release covers."""
    return wanted.select("month").distinct().join(released.select("month"), "month", "left_anti")


def nearest_series(sites: DataFrame, field: DataFrame, grid: Grid, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Field series of the cell nearest to each site, by an equi-join on the cell."""
    placed = sites.withColumns({"iy": grid.nearest_iy(lat), "ix": grid.nearest_ix(lon)})
    return placed.join(field, ["iy", "ix"])


def block_pairs(cells: DataFrame, block: str) -> DataFrame:
    """Unordered pairs of distinct cells of one block, in (iy, ix) order.

    ``cells`` has one row per cell, so a block contributes at most
    ``factor**2`` cells.
    """
    order = (F.col("a.iy") < F.col("b.iy")) | ((F.col("a.iy") == F.col("b.iy")) & (F.col("a.ix") < F.col("b.ix")))
    left, right = cells.alias("a"), cells.alias("b")
    return left.join(right, (F.col(f"a.{block}") == F.col(f"b.{block}")) & order).select(
        F.col(f"a.{block}").alias(block),
        F.col("a.iy").alias("iy_i"),
        F.col("a.ix").alias("ix_i"),
        F.col("b.iy").alias("iy_j"),
        F.col("b.ix").alias("ix_j"),
    )
