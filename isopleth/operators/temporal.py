"""Per-cell statistics over time.  A cell's series is bounded by the calendar."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isopleth.functions.stats import pearson, ratio, rmse, scalar, slope
from isopleth.functions.time import month_number

CELL = ("iy", "ix")


def in_window(start: str, end: str, t: str = "t") -> Column:
    return F.col(t).between(F.lit(start).cast("date"), F.lit(end).cast("date"))


def duplicate_month_mean(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values])


def duplicate_month_first(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """First present value per key; combined map-side as the least ``(order, value)``."""
    seen = F.when(F.col(value).isNotNull(), F.struct(*order, value))
    return df.groupBy(*keys).agg(F.min(seen)[value].alias(value))


def duplicate_month_last(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """Value of the latest record per key, and how many records it replaced."""
    return df.groupBy(*keys).agg(
        F.max(F.struct(*order, value))[value].alias(value), (F.count("*") - 1).alias("n_removed")
    )


def anomaly(df: DataFrame, value: str, start: str, end: str, cell: Sequence[str] = CELL) -> DataFrame:
    """Adds ``baseline`` (cell mean inside the window) and ``anomaly``."""
    over = Window.partitionBy(*cell)
    base = F.avg(F.when(in_window(start, end), F.col(value))).over(over)
    return df.withColumn("baseline", base).withColumn("anomaly", F.col(value) - F.col("baseline"))


def component_sum(layers: Sequence[tuple[str, float]]) -> Column:
    """Sum of scaled layers, NULL if any is missing."""
    total = F.lit(0.0)
    for name, factor in layers:
        total = total + F.col(name) * F.lit(factor)
    return total


def loss_positive(df: DataFrame, flux: str, out: str) -> DataFrame:
    """Flip a flux whose overall mean is negative."""
    mean = df.agg(F.avg(flux).alias("m"))
    return df.withColumn(out, F.when(scalar(mean) < 0, -F.col(flux)).otherwise(F.col(flux)))


def cumulative(df: DataFrame, value: Column, out: str, cell: Sequence[str] = CELL) -> DataFrame:
    """Running sum per cell in time order; a missing value adds nothing."""
    run = Window.partitionBy(*cell).orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.sum(F.coalesce(value, F.lit(0.0))).over(run))


def season_amplitude(df: DataFrame, values: Sequence[str], cell: Sequence[str] = CELL) -> DataFrame:
    """Half the range of the calendar-month climatology."""
    clim = df.groupBy(*cell, F.month("t").alias("_m")).agg(*[F.avg(v).alias(v) for v in values])
    return clim.groupBy(*cell).agg(*[((F.max(v) - F.min(v)) / 2).alias(v) for v in values])


def trend_compact(df: DataFrame, values: Sequence[str], cell: Sequence[str] = CELL) -> DataFrame:
    """Slope against 0..n-1 of each series' own present samples."""
    run = Window.partitionBy(*cell).orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = df.withColumns({f"_k_{v}": F.count(v).over(run) for v in values})
    return placed.groupBy(*cell).agg(*[slope(F.col(v), F.col(f"_k_{v}")).alias(v) for v in values])


def month_positions(df: DataFrame) -> DataFrame:
    """Months that occur, numbered 0.. in order; the calendar bounds this table."""
    return df.select("t").distinct().withColumn("pos", F.row_number().over(Window.orderBy("t")) - 1)


def trend_indexed(df: DataFrame, values: Sequence[str], cell: Sequence[str] = CELL, calendar: DataFrame | None = None) -> DataFrame:
    """Slope against the position in the whole month list, that of ``calendar`` if given."""
    return df.join(month_positions(df if calendar is None else calendar), "t").groupBy(*cell).agg(*[slope(v, "pos").alias(v) for v in values])


def trend_calendar(df: DataFrame, values: Sequence[str], cell: Sequence[str] = CELL) -> DataFrame:
    """Slope per year against real months."""
    return df.groupBy(*cell).agg(*[(slope(F.col(v), month_number("t")) * 12).alias(v) for v in values])


_TERMS = ("one", "t", "s1", "c1", "s2", "c2")


def harmonics(df: DataFrame, keys: Sequence[str], value: str, min_months: int = 24, origin: int = 2000) -> DataFrame:
    """Least squares on intercept, trend, annual and semi-annual waves of real months.

    The executors sum 27 products per series; only the 6x6 solves run in
    pandas batches.  Gives ``trend`` per year and the two amplitudes, NULL
    where there are too few months or the months do not determine the fit.
    Time counts from the year ``origin``, which changes the intercept only;
    one near the data keeps the sums well scaled.
    """
    year = (month_number("t") - month_number(F.make_date(F.lit(origin), F.lit(1), F.lit(1)))) / 12.0
    wave = 2 * math.pi
    series = df.where(F.col(value).isNotNull()).withColumn("_t", year).select(
        *keys,
        F.col(value).alias("_y"),
        F.lit(1.0).alias("one"),
        F.col("_t").alias("t_"),
        F.sin(F.col("_t") * wave).alias("s1"),
        F.cos(F.col("_t") * wave).alias("c1"),
        F.sin(F.col("_t") * (2 * wave)).alias("s2"),
        F.cos(F.col("_t") * (2 * wave)).alias("c2"),
    ).withColumnRenamed("t_", "t")
    sums = [
        F.sum(F.col(a) * F.col(b)).alias(f"p_{i}_{j}")
        for i, a in enumerate(_TERMS)
        for j, b in enumerate(_TERMS)
        if i <= j
    ] + [F.sum(F.col(a) * F.col("_y")).alias(f"q_{i}") for i, a in enumerate(_TERMS)]
    totals = series.groupBy(*keys).agg(F.count("*").alias("n"), *sums)
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in totals.schema if f.name in keys]
        + ["n long", "trend double", "annual double", "semiannual double"]
    )
    need = max(6, min_months)
    names = list(keys)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            k = len(pdf)
            normal = np.empty((k, 6, 6))
            right = np.empty((k, 6, 1))
            for i in range(6):
                right[:, i, 0] = pdf[f"q_{i}"]
                for j in range(i, 6):
                    normal[:, i, j] = normal[:, j, i] = pdf[f"p_{i}_{j}"]
            out = np.full((k, 3), np.nan)
            if k:
                spread = np.linalg.eigvalsh(normal)
                good = (pdf["n"].to_numpy() >= need) & (spread[:, 0] > 1e-12 * spread[:, -1])
                if good.any():
                    b = np.linalg.solve(normal[good], right[good])[:, :, 0]
                    out[good] = np.column_stack([b[:, 1], np.hypot(b[:, 2], b[:, 3]), np.hypot(b[:, 4], b[:, 5])])
            yield pdf[[*names, "n"]].assign(trend=out[:, 0], annual=out[:, 1], semiannual=out[:, 2])

    fitted = totals.mapInPandas(solve, schema)
    return fitted.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("trend", "annual", "semiannual")})


def consistency(df: DataFrame, reference: str, candidate: str, cell: Sequence[str]) -> DataFrame:
    """Correlation, trend and seasonal differences and scaled error of two coarse series."""
    pair = [reference, candidate]
    base = df.groupBy(*cell).agg(
        pearson(candidate, reference, 2).alias("corr"),
        ratio(rmse(candidate, reference), F.stddev_pop(reference)).alias("nrmse"),
    )
    trends = trend_compact(df, pair, cell).select(*cell, (F.col(candidate) - F.col(reference)).alias("trend_diff"))
    seasons = season_amplitude(df, pair, cell).select(
        *cell, (F.col(candidate) - F.col(reference)).alias("season_amp_diff")
    )
    return base.join(trends, list(cell)).join(seasons, list(cell))
