"""Resampling between regular grids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isopleth.grid import BROADCAST_CELLS, Grid
from isopleth.operators.lines import along_lines, cells_of


#: Most entries of a weight matrix that goes to every executor (some 30 MB); a half-degree globe has a million.
BROADCAST_WEIGHTS = 4 * BROADCAST_CELLS


def _hinted(mapping: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(mapping) if rows <= BROADCAST_CELLS else mapping


def _targets(spark: SparkSession, source: Grid, target: Grid) -> DataFrame:
    """Target cells inside the hull of the source centres, with fractional source indices."""
    cells = target.cells(spark).select(
        F.col("iy").alias("ty"),
        F.col("ix").alias("tx"),
        ((F.col("lat") - source.lat0) / source.dlat).alias("fy"),
        ((F.col("lon") - source.lon0) / source.dlon).alias("fx"),
    )
    return cells.where(F.col("fy").between(0, source.ny - 1) & F.col("fx").between(0, source.nx - 1))


def nearest(df: DataFrame, keys: Sequence[str], values: Sequence[str], source: Grid, target: Grid) -> DataFrame:
    """Value of the nearest source cell; nothing outside the source hull."""
    mapping = _targets(df.sparkSession, source, target).select(
        "ty", "tx", F.ceil(F.col("fy") - 0.5).cast("int").alias("iy"), F.ceil(F.col("fx") - 0.5).cast("int").alias("ix")
    )
    joined = df.join(_hinted(mapping, target.size), ["iy", "ix"])
    return joined.select(*keys, F.col("ty").alias("iy"), F.col("tx").alias("ix"), *values)


def bilinear(df: DataFrame, keys: Sequence[str], value: str, source: Grid, target: Grid) -> DataFrame:
    """Linear in both directions; missing if any of the four corners is.

    The weights are a sparse matrix, one row per source cell: of up to
    ``BROADCAST_WEIGHTS`` entries it goes to all tasks, so that the field of a
    half-degree globe is not shuffled before its shares are summed.
    """
    base = _targets(df.sparkSession, source, target).withColumns(
        {
            "y0": F.least(F.floor("fy"), F.lit(source.ny - 2)).cast("int"),
            "x0": F.least(F.floor("fx"), F.lit(source.nx - 2)).cast("int"),
        }
    ).withColumns({"ry": F.col("fy") - F.col("y0"), "rx": F.col("fx") - F.col("x0")})

    def corner(j: int, i: int) -> Column:
        wy = F.col("ry") if j else 1 - F.col("ry")
        wx = F.col("rx") if i else 1 - F.col("rx")
        return F.struct((F.col("y0") + j).alias("iy"), (F.col("x0") + i).alias("ix"), (wy * wx).alias("w"))

    corners = F.array(*[corner(j, i) for j in (0, 1) for i in (0, 1)])
    to = F.struct("ty", "tx", F.col("c.w").alias("w"))
    mapping = base.select("ty", "tx", F.explode(corners).alias("c")).groupBy("c.iy", "c.ix").agg(F.collect_list(to).alias("_to"))
    small = 4 * target.size <= BROADCAST_WEIGHTS
    joined = df.where(F.col(value).isNotNull()).join(F.broadcast(mapping) if small else mapping, ["iy", "ix"])
    # Each cell is read once and sends a weighted share to every target; shares are summed before they travel.
    shares = joined.select(*keys, F.col(value).alias("_v"), F.explode("_to").alias("_to"))
    summed = shares.groupBy(*keys, "_to.ty", "_to.tx").agg(F.sum(F.col("_v") * F.col("_to.w")).alias(value), F.count("*").alias("_n"))
    return summed.where("_n = 4").select(*keys, F.col("ty").alias("iy"), F.col("tx").alias("ix"), value)


def spline_matrix(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Weights of the not-a-knot cubic spline: ``target values = matrix @ source values``."""
    n = len(source)
    h = np.diff(source)
    lhs, rhs = np.zeros((n, n)), np.zeros((n, n))
    for i in range(1, n - 1):
        lhs[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        rhs[i, i - 1 : i + 2] = 6 / h[i - 1], -6 / h[i - 1] - 6 / h[i], 6 / h[i]
    lhs[0, :3] = h[1], -(h[0] + h[1]), h[0]
    lhs[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
    curvature = np.linalg.solve(lhs, rhs)
    k = np.clip(np.searchsorted(source, target, side="right") - 1, 0, n - 2)
    a, b = (source[k + 1] - target) / h[k], (target - source[k]) / h[k]
    eye = np.eye(n)
    scale = (h[k] ** 2 / 6)[:, None]
    out = a[:, None] * eye[k] + b[:, None] * eye[k + 1]
    out += scale * ((a**3 - a)[:, None] * curvature[k] + (b**3 - b)[:, None] * curvature[k + 1])
    return out


def _spline_pass(df: DataFrame, keys: list[str], along: str, value: str, n: int, matrix: np.ndarray,
                 inside: np.ndarray) -> DataFrame:
    """Interpolate every line; one with a gap gives nothing.  A batch of lines is one product with the matrix."""
    across = matrix.T

    def product(stacks: Mapping[str, np.ndarray], _: pa.RecordBatch) -> list[np.ndarray]:
        whole = np.isfinite(stacks[value]).all(axis=1)
        out = np.full((len(whole), across.shape[1]), np.nan)
        out[whole] = stacks[value][whole] @ across
        return [out]

    lines = along_lines(df, keys, along, n, [value], product, [value], absent=np.nan)
    places = F.array(*[F.lit(int(i)) for i in inside])
    cells = cells_of(lines, keys, "_at", [value]).where(~F.isnan(value))
    return cells.select(*keys, F.get(places, F.col("_at")).alias(along), value)


def spline_weights(source: Grid, target: Grid) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Per axis, y then x: the spline's matrix and the target indices inside the hull."""

    def axis(first: float, step: float, n: int, t_first: float, t_step: float, t_n: int) -> tuple[np.ndarray, np.ndarray]:
        points, wanted = first + step * np.arange(n), t_first + t_step * np.arange(t_n)
        inside = np.flatnonzero((wanted >= points[0]) & (wanted <= points[-1]))
        return spline_matrix(points, wanted[inside]), inside

    return (
        axis(source.lat0, source.dlat, source.ny, target.lat0, target.dlat, target.ny),
        axis(source.lon0, source.dlon, source.nx, target.lon0, target.dlon, target.nx),
    )


def cubic(df: DataFrame, keys: Sequence[str], value: str, source: Grid, target: Grid) -> DataFrame:
    """Separable cubic spline; a row or column with a gap gives nothing, as does the outside of the hull."""
    (my, iy), (mx, ix) = spline_weights(source, target)
    rows = _spline_pass(df, [*keys, "iy"], "ix", value, source.nx, mx, ix)
    return _spline_pass(rows, [*keys, "ix"], "iy", value, source.ny, my, iy)
