"""Radial power spectra of masked maps, transformed line by line, then wavenumber by wavenumber."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isopleth.operators.lines import along_lines, cells_of


def ring_members(ny: int, nx: int, k: int, rings: int) -> np.ndarray:
    """Which ring each wavenumber along y lies in, for wavenumber ``k`` along x, as an (ny, rings) matrix.

    Rings are equal steps of the radius from 0 to half a cycle per cell, their
    upper edge excluded.  A real map has the same power at ``-k``, so every
    ``k`` that stands for two counts twice.
    """
    radius = np.hypot(np.fft.fftfreq(ny), k / nx)
    edges = np.linspace(0.0, 0.5, rings + 1)
    inside = (radius[:, None] >= edges[:-1]) & (radius[:, None] < edges[1:])
    return inside * (1.0 if k == 0 or 2 * k == nx else 2.0)


def spectrum(df: DataFrame, keys: Sequence[str], value: str, ny: int, nx: int, y0: str | None = None,
             x0: str | None = None) -> DataFrame:
    """``wavenumber, power`` per map: mean power on rings of equal wavenumber, in cycles per cell.

    A map is taken without its mean where it has values and as zero elsewhere;
    power is divided by map size times number of values.  With fewer than four
    values it is null, at the wavenumbers 1, 2 ... over the shorter side.

    First every line along x is transformed, then for each wavenumber along x
    the line of its coefficients along y; what is left are sums per ring.  No
    row is larger than a grid line, so maps may be of any size.
    """
    keys, rings = list(keys), min(ny, nx) // 2
    y = F.col("iy") if y0 is None else F.col("iy") - F.col(y0)
    x = F.col("ix") if x0 is None else F.col("ix") - F.col(x0)
    cells = df.where(F.col(value).isNotNull()).select(*keys, y.cast("int").alias("_y"), x.cast("int").alias("_x"), F.col(value).alias("_v"))
    # A row per map, small next to its cells; Spark sends it to all tasks where it can.
    level = cells.groupBy(*keys).agg(F.avg("_v").alias("_mean"), F.count("*").alias("_n"))
    centred = cells.join(level, keys).select(*keys, "_n", "_y", "_x", (F.col("_v") - F.col("_mean")).alias("_v"))

    def rows(stacks: Mapping[str, np.ndarray], _: pa.RecordBatch) -> list[np.ndarray]:
        made = np.fft.rfft(stacks["_v"], axis=1)
        return [made.real, made.imag]

    along_x = along_lines(centred, [*keys, "_n", "_y"], "_x", nx, ["_v"], rows, ["_re", "_im"])
    waves = cells_of(along_x, [*keys, "_n", "_y"], "_k", ["_re", "_im"])

    def columns(stacks: Mapping[str, np.ndarray], batch: pa.RecordBatch) -> list[np.ndarray]:
        power = np.abs(np.fft.fft(stacks["_re"] + 1j * stacks["_im"], axis=1)) ** 2
        own = batch.column("_k").to_numpy()
        sums, counts = np.zeros((len(own), rings)), np.zeros((len(own), rings))
        for k in np.unique(own):
            member = ring_members(ny, nx, int(k), rings)
            sums[own == k] = power[own == k] @ member
            counts[own == k] = member.sum(axis=0)
        return [sums, counts]

    along_y = along_lines(waves, [*keys, "_n", "_k"], "_y", ny, ["_re", "_im"], columns, ["_s", "_c"])
    each = cells_of(along_y, [*keys, "_n"], "_ring", ["_s", "_c"])
    mean = each.groupBy(*keys, "_n", "_ring").agg((F.sum("_s") / F.sum("_c")).alias("_p"))
    few = F.col("_n") < 4
    wave = F.when(few, (F.col("_ring") + 1) / F.lit(min(ny, nx))).otherwise((F.col("_ring") + 0.5) * F.lit(0.5 / rings))
    return mean.select(*keys, wave.alias("wavenumber"), F.when(~few, F.col("_p") / (F.lit(ny * nx) * F.col("_n"))).alias("power"))


def summary(spectra: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Quartiles of power per wavenumber over months (the calendar bounds each group)."""
    return spectra.groupBy(*keys, "wavenumber").agg(
        F.percentile("power", F.lit(0.25)).alias("q25"),
        F.percentile("power", F.lit(0.5)).alias("q50"),
        F.percentile("power", F.lit(0.75)).alias("q75"),
    )


def band_energy(spectra: DataFrame, keys: Sequence[str], at_least: float = 1 / 6) -> DataFrame:
    """Power summed over wavenumbers from ``at_least``; NULL if the map had no spectrum."""
    high = F.when(F.col("wavenumber") >= at_least, F.col("power"))
    return spectra.groupBy(*keys).agg(
        F.when(F.count("power") > 0, F.coalesce(F.sum(high), F.lit(0.0))).alias("energy")
    )
