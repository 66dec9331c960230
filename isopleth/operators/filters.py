"""Spatial filters on masked fields: absent rows are masked cells.

A separable filter works line by line: the cells of a grid line meet in one
row, whose length the grid side bounds, and batches of lines are multiplied by
the filter's matrix.  Two passes shuffle the field twice.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isopleth.functions.stats import exact_median, exact_quantiles, ratio, scalar, spearman
from isopleth.grid import Grid
from isopleth.operators.lines import along_lines, cells_of


def gaussian_taps(size: int = 13, sigma: float = 3.0) -> list[float]:
    """Normalised weights for offsets 0..size//2."""
    half = size // 2
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(half + 1)]
    total = raw[0] + 2 * sum(raw[1:])
    return [r / total for r in raw]


def line_matrix(n: int, taps: Sequence[float], edge: str) -> np.ndarray:
    """Matrix of a filter on lines of ``n`` cells; ``taps[k]`` is the weight at distance k.

    Beyond the edge a line continues with its last cell (nearest), mirrored
    about it (reflect), or empty.
    """
    out, reach = np.zeros((n, n)), len(taps) - 1
    for i in range(n):
        for d in range(-reach, reach + 1):
            j = i + d
            if edge == "nearest":
                j = min(max(j, 0), n - 1)
            elif edge == "reflect" and not 0 <= j < n:
                j = -j if j < 0 else 2 * (n - 1) - j
            if 0 <= j < n:
                out[i, j] += taps[abs(d)]
    return out


def spread(df: DataFrame, keys: Sequence[str], axis: str, n: int, values: Sequence[str], taps: Sequence[float],
           edge: str) -> DataFrame:
    """Sum of ``tap * value`` along one axis, for every cell of a line that has any data."""
    matrix = line_matrix(n, taps, edge).T
    lines = along_lines(df, keys, axis, n, values, lambda stacks, _: [stacks[v] @ matrix for v in values], values)
    return cells_of(lines, keys, axis, values)


def blur(df: DataFrame, keys: Sequence[str], values: Sequence[str], grid: Grid, taps: Sequence[float], edge: str,
         floor: float) -> DataFrame:
    """Mask-normalised separable blur of several columns at the cells that have data."""
    ok = F.lit(True)
    for v in values:
        ok = ok & F.col(v).isNotNull()
    present = df.where(ok).withColumn("_w", F.lit(1.0)).select(*keys, "iy", "ix", *values, "_w")
    along = spread(present, [*keys, "iy"], "ix", grid.nx, [*values, "_w"], taps, edge)
    both = spread(along, [*keys, "ix"], "iy", grid.ny, [*values, "_w"], taps, edge)
    smooth = both.select(
        *keys, "iy", "ix", *[(F.col(v) / F.greatest("_w", F.lit(floor))).alias(f"{v}_low") for v in values]
    )
    return present.drop("_w").join(smooth, [*keys, "iy", "ix"])


def high_pass(df: DataFrame, keys: Sequence[str], value: str, grid: Grid, size: int = 13, sigma: float = 3.0,
              edge: str = "nearest", floor: float = 1e-12) -> DataFrame:
    """Field minus its blur, as ``high``."""
    out = blur(df, keys, [value], grid, gaussian_taps(size, sigma), edge, floor)
    return out.withColumn("high", F.col(value) - F.col(f"{value}_low"))


def sobel(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Sobel derivatives ``sx, sy`` (divided by 8, zeros outside) at the cells that have data."""
    taps = F.array(
        *[
            F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(kx).alias("kx"), F.lit(ky).alias("ky"))
            for dy in (-1, 0, 1)
            for dx in (-1, 0, 1)
            for kx, ky in [(dx * (2 - abs(dy)) / 8.0, dy * (2 - abs(dx)) / 8.0)]
        ]
    )
    sent = df.select(*keys, "iy", "ix", value, F.explode(taps).alias("k"))
    moved = sent.groupBy(
        *keys, (F.col("iy") - F.col("k.dy")).alias("iy"), (F.col("ix") - F.col("k.dx")).alias("ix")
    ).agg(
        F.sum(F.col(value) * F.col("k.kx")).alias("sx"),
        F.sum(F.col(value) * F.col("k.ky")).alias("sy"),
        F.max((F.col("k.dy") == 0) & (F.col("k.dx") == 0)).alias("_own"),
    )
    return moved.where("_own").drop("_own")


def rms_over_time(high: DataFrame, keys: Sequence[str], value: str = "high") -> DataFrame:
    return high.groupBy(*keys, "iy", "ix").agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"))


def rms_summary(rms: DataFrame, keys: Sequence[str], weight: str) -> DataFrame:
    """Median and mean RMS per group, and its rank correlation with a weight."""
    base = rms.groupBy(*keys).agg(F.avg("rms").alias("mean_rms"))
    return base.join(exact_median(rms, keys, "rms", "median_rms"), list(keys)).join(
        spearman(rms, keys, "rms", weight, "rho"), list(keys)
    )


def inherited_share(df: DataFrame, model: str, reference: str, prior: str, out: str = "hfi") -> DataFrame:
    """``(m^2 - r^2) / (p^2 - r^2)``, NULL where the denominator is below 1e-6 of the median prior energy."""
    sq = lambda c: F.col(c) * F.col(c)
    middle = exact_quantiles(df.where(F.col(prior) > 0).select(sq(prior).alias("e")), [], "e", {"m": 0.5})
    return share_with_floor(df, sq(model), sq(reference), sq(prior), scalar(middle), out)


def share_with_floor(df: DataFrame, m: Column, r: Column, p: Column, middle: Column, out: str) -> DataFrame:
    den = p - r
    return df.withColumn("_floor", middle * 1e-6).withColumn(
        out, F.when(F.abs(den) > F.col("_floor"), ratio(m - r, den))
    ).drop("_floor")


def by_model(df: DataFrame, keys: Sequence[str], value: str, names: Mapping[str, str], column: str = "model") -> DataFrame:
    """One column per listed member."""
    return df.groupBy(*keys).agg(*[F.max(F.when(F.col(column) == m, F.col(value))).alias(n) for m, n in names.items()])
