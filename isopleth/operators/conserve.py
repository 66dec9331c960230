"""Area-weighted means and the operators that conserve them.

Blocks hold at most ``factor**2`` cells, so block terms use windows.  Zones
can be of any size (one may hold most cells), so zone terms are aggregated
with map-side combining and joined back.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isopleth.functions.stats import clip, ratio
from isopleth.grid import Grid


def with_block(df: DataFrame, grid: Grid) -> DataFrame:
    return df.withColumns({"cy": grid.cy(), "cx": grid.cx()})


def masked_weight(weight: Column, *values: Column, valid: Column | None = None) -> Column:
    """The weight where it is positive and every value is present, else 0."""
    ok = weight > 0
    for v in values:
        ok = ok & v.isNotNull()
    if valid is not None:
        ok = ok & valid
    return F.when(ok, weight).otherwise(0.0)


def block_sums(df: DataFrame, keys: Sequence[str], values: Sequence[str], grid: Grid, weight: str,
               valid: str | None = None) -> DataFrame:
    """Weighted sums ``_s_<v>`` and weights ``_w_<v>`` per block, combined map-side."""
    sums: list[Column] = []
    ok = F.col(valid) if valid else None
    for v in values:
        w = masked_weight(F.col(weight), F.col(v), valid=ok)
        sums += [F.sum(F.coalesce(F.col(v), F.lit(0.0)) * w).alias(f"_s_{v}"), F.sum(w).alias(f"_w_{v}")]
    return with_block(df, grid).groupBy(*keys, "cy", "cx").agg(*sums)


def has_weight(value: str, eps: float = 1e-6) -> Column:
    return F.col(f"_w_{value}") > eps


def mean_of_sums(value: str, empty: str = "null", eps: float = 1e-6) -> Column:
    """Mean from :func:`block_sums`.

    A block without weight gives NULL (``null``, evaluation) or 0 (``zero``
    for training fields with ``eps=1e-12``, ``flag`` for pooling).
    """
    mean = F.when(has_weight(value, eps), ratio(F.col(f"_s_{value}"), F.col(f"_w_{value}")))
    return mean if empty == "null" else F.coalesce(mean, F.lit(0.0))


def block_mean(df: DataFrame, keys: Sequence[str], values: Sequence[str], grid: Grid, weight: str,
               valid: str | None = None, empty: str = "null", eps: float = 1e-6) -> DataFrame:
    """Weighted block means of several fields in one pass; ``flag`` adds ``<name>_valid``."""
    out: list[Column | str] = [*keys, "cy", "cx"]
    for v in values:
        out.append(mean_of_sums(v, empty, eps).alias(v))
        if empty == "flag":
            out.append(has_weight(v, eps).alias(f"{v}_valid"))
    return block_sums(df, keys, values, grid, weight, valid).select(*out)


def block_mean_plain(df: DataFrame, keys: Sequence[str], values: Sequence[str], grid: Grid) -> DataFrame:
    """Unweighted NULL-skipping block mean; a ragged edge is left out."""
    f = grid.factor
    inside = df.where((F.col("iy") < f * (grid.ny // f)) & (F.col("ix") < f * (grid.nx // f)))
    return with_block(inside, grid).groupBy(*keys, "cy", "cx").agg(*[F.avg(v).alias(v) for v in values])


def coarse_to_fine(fine: DataFrame, coarse: DataFrame, keys: Sequence[str], grid: Grid) -> DataFrame:
    """Attach each block's values to its cells (cells beyond the coarse grid are dropped)."""
    return with_block(fine, grid).join(coarse, [*keys, "cy", "cx"])


def zone_mean(df: DataFrame, keys: Sequence[str], zone: str, values: Sequence[str], weight: str,
              valid: str | None = None, eps: float = 1e-12) -> DataFrame:
    """Weighted mean per irregular zone with a ``<name>_valid`` flag; NULL zones are outside."""
    ok = F.col(valid) if valid else None
    sums: list[Column] = []
    for v in values:
        w = masked_weight(F.col(weight), F.col(v), valid=ok)
        sums += [
            F.sum(F.coalesce(F.col(v), F.lit(0.0)) * w).alias(f"_s_{v}"),
            F.sum(w).alias(f"_w_{v}"),
        ]
    summed = df.where(F.col(zone) > 0).groupBy(*keys, zone).agg(*sums)
    out: list[Column | str] = [*keys, zone]
    for v in values:
        seen = F.col(f"_w_{v}") > eps
        out += [
            F.when(seen, ratio(F.col(f"_s_{v}"), F.col(f"_w_{v}"))).alias(v),
            seen.alias(f"{v}_valid"),
        ]
    return summed.select(*out)


def zone_to_cells(cells: DataFrame, zones: DataFrame, keys: Sequence[str], zone: str, value: str,
                  fill: float | None = None) -> DataFrame:
    """Zone value on every cell of the zone, ``fill`` elsewhere."""
    joined = cells.join(zones.select(*keys, zone, value), [*keys, zone], "left")
    return joined if fill is None else joined.withColumn(value, F.coalesce(F.col(value), F.lit(fill)))


def area_mean(df: DataFrame, value: str, weight: Column) -> DataFrame:
    """One weighted mean over all rows with a positive weight."""
    w = F.when(F.col(value).isNotNull() & (weight > 0), weight)
    return df.agg(ratio(F.sum(F.col(value) * w), F.sum(w)).alias(value))


def project_blocks(df: DataFrame, keys: Sequence[str], value: str, target: DataFrame, target_col: str,
                   grid: Grid, weight: str, valid: str | None = None, passes: int = 2,
                   eps: float = 1e-12) -> DataFrame:
    """Shift the valid cells of each block so its weighted mean equals the target.

    Adds ``projected``, ``error_before`` and ``error_after``.  Blocks without
    weight or without target keep their values.  A second pass removes what
    rounding left.
    """
    w = masked_weight(F.col(weight), F.col(value), valid=F.col(valid) if valid else None)
    side = target.select(*keys, "cy", "cx", F.col(target_col).alias("_target"))
    block = Window.partitionBy(*keys, "cy", "cx")
    out = with_block(df, grid).join(side, [*keys, "cy", "cx"], "left").withColumn("_w", w)
    out = out.withColumns(
        {
            "projected": F.col(value),
            "_total": F.sum("_w").over(block),
            "_sum": F.sum(F.coalesce(F.col(value), F.lit(0.0)) * F.col("_w")).over(block),
        }
    )
    gap = F.col("_target") - F.when(F.col("_total") > eps, ratio(F.col("_sum"), F.col("_total")))
    out = out.withColumns({"_gap": gap, "error_before": F.abs(gap)})
    for _ in range(passes):
        shifted = F.when(F.col("_w") > 0, F.col("projected") + F.coalesce("_gap", F.lit(0.0))).otherwise(F.col("projected"))
        out = out.withColumn("projected", shifted)
        out = out.withColumn("_sum", F.sum(F.coalesce("projected", F.lit(0.0)) * F.col("_w")).over(block))
        out = out.withColumn("_gap", gap)
    return out.withColumn("error_after", F.abs("_gap")).drop("_target", "_w", "_total", "_sum", "_gap")


def blend_correct(df: DataFrame, keys: Sequence[str], value: str, target: str, grid: Grid,
                  blend: float = 1.0, cap: float | None = None) -> DataFrame:
    """Add a capped share of each block's mean residual to its cells, as ``corrected``.

    The block means use the mask alone, without area weights.
    """
    block = Window.partitionBy(*keys, "cy", "cx")
    gap = F.col("_gap") if cap is None else clip(F.col("_gap"), -cap, cap)
    residual = with_block(df, grid).withColumn("_gap", F.avg(target).over(block) - F.avg(value).over(block))
    return residual.withColumn(
        "corrected", F.col(value) + F.lit(blend) * F.coalesce(gap, F.lit(0.0))
    ).drop("_gap")


def blend_errors(df: DataFrame, keys: Sequence[str], target: str, before: str, after: str, grid: Grid) -> DataFrame:
    """Mean absolute block residual before and after a correction."""
    blocks = with_block(df, grid).groupBy(*keys, "cy", "cx").agg(
        F.abs(F.avg(target) - F.avg(before)).alias("_b"), F.abs(F.avg(target) - F.avg(after)).alias("_a")
    )
    return blocks.groupBy(*keys).agg(F.avg("_b").alias("error_before"), F.avg("_a").alias("error_after"))


def project_zones(df: DataFrame, keys: Sequence[str], value: str, target: DataFrame, target_col: str,
                  zone: str, weight: str, valid: str | None = None, passes: int = 2) -> DataFrame:
    """Block projection on irregular zones; zones without a target are left alone."""
    side = target.select(*keys, zone, F.col(target_col).alias("_target"))
    out = df.join(side, [*keys, zone], "left").withColumn("projected", F.col(value))
    for _ in range(passes):
        means = zone_mean(out, keys, zone, ["projected"], weight, valid).select(
            *keys, zone, F.col("projected").alias("_mean")
        )
        out = out.join(means, [*keys, zone], "left")
        inside = masked_weight(F.col(weight), F.col(value), valid=F.col(valid) if valid else None) > 0
        gap = F.coalesce(F.col("_target") - F.col("_mean"), F.lit(0.0))
        out = out.withColumn(
            "projected", F.when(inside, F.col("projected") + gap).otherwise(F.col("projected"))
        ).drop("_mean")
    return out.drop("_target")


def nullspace(df: DataFrame, keys: Sequence[str], value: str, zone: str, weight: str, valid: str | None = None,
              out: str = "detail") -> DataFrame:
    """The field minus its zone mean, on the zone's valid cells."""
    means = zone_mean(df, keys, zone, [value], weight, valid).select(*keys, zone, F.col(value).alias("_mean"))
    ok = F.col(value).isNotNull() & (F.col(valid) if valid else F.lit(True))
    return df.join(means, [*keys, zone], "left").withColumn(
        out, F.when(ok, F.col(value) - F.col("_mean"))
    ).drop("_mean")


def remaining_mean(df: DataFrame, keys: Sequence[str], detail: str, zone: str, weight: str,
                   valid: str | None = None) -> DataFrame:
    """Zones with valid cells and the largest absolute zone mean a detail field still has."""
    means = zone_mean(df, keys, zone, [detail], weight, valid).where(F.col(detail).isNotNull())
    return means.groupBy(*keys).agg(
        F.count("*").alias("n_zones"), F.max(F.abs(detail)).alias("max_abs_mean")
    )


def decompose(df: DataFrame, keys: Sequence[str], prior: str, target: DataFrame, target_col: str, zone: str,
              weight: str, detail_valid: str) -> tuple[DataFrame, DataFrame]:
    """Zone observation plus prior detail on a complete output support.

    ``df`` has one row per output cell; detail comes only from cells where
    ``detail_valid`` holds and is zero elsewhere.  Returns the cells with
    ``observation``, ``detail`` and ``reconstruction``, and per zone the
    closure error, the detail area fraction and whether detail was available.
    """
    side = target.select(*keys, zone, F.col(target_col).alias("observation"))
    cells = (
        nullspace(df.where(F.col(zone) > 0), keys, prior, zone, weight, detail_valid)
        .join(side, [*keys, zone], "left")
        .withColumn("detail", F.coalesce(F.col("detail"), F.lit(0.0)))
        .withColumn("reconstruction", F.col("observation") + F.col("detail"))
    )
    used = F.col(detail_valid) & F.col(prior).isNotNull()
    zones = cells.groupBy(*keys, zone).agg(
        ratio(F.sum(F.col("reconstruction") * F.col(weight)), F.sum(weight)).alias("reconstructed"),
        F.max("observation").alias("observation"),
        F.coalesce(ratio(F.sum(F.when(used, F.col(weight)).otherwise(0.0)), F.sum(weight)), F.lit(0.0)).alias(
            "detail_fraction"
        ),
    ).withColumn("closure", F.abs(F.col("reconstructed") - F.col("observation")))
    return cells, zones


def decomposition_counts(zones: DataFrame, keys: Sequence[str]) -> DataFrame:
    return zones.groupBy(*keys).agg(
        F.count_if(F.col("detail_fraction") > 0).alias("detail_supported"),
        F.count_if(F.col("reconstructed").isNotNull() & (F.col("detail_fraction") <= 0)).alias("observation_only"),
        F.max("closure").alias("closure_max"),
    )


def bin_average(points: DataFrame, keys: Sequence[str], value: str, iy: Column, ix: Column, grid: Grid) -> DataFrame:
    """Mean of the points that fall in each cell; points off the grid are dropped."""
    placed = points.where(F.col(value).isNotNull()).withColumns({"iy": iy, "ix": ix})
    on_grid = (F.col("iy") >= 0) & (F.col("iy") < grid.ny) & (F.col("ix") >= 0) & (F.col("ix") < grid.nx)
    return placed.where(on_grid).groupBy(*keys, "iy", "ix").agg(F.avg(value).alias(value))


def daily_then_monthly(days: DataFrame, month: Column, value: str) -> DataFrame:
    """Monthly mean of daily cell means: each day counts once however many points it had."""
    return days.groupBy(month.alias("month"), "iy", "ix").agg(
        F.avg(value).alias(value), F.count("*").alias("n_days")
    )


def zone_series(df: DataFrame, zone: str, values: Sequence[str], valid: str, min_cells: int) -> DataFrame:
    """Unweighted mean series of zones whose best month has ``min_cells`` valid cells."""
    ok = F.col(valid)
    series = df.where(F.col(zone) > 0).groupBy(zone, "t").agg(
        *[F.avg(F.when(ok, F.col(v))).alias(v) for v in values], F.count_if(ok).alias("n_cells")
    )
    large = series.groupBy(zone).agg(F.max("n_cells").alias("_m")).where(F.col("_m") >= min_cells)
    return series.join(large.select(zone), zone, "left_semi")


def box_membership(lat: Column, lon: Column, named: Mapping[str, tuple[float, float, float, float]],
                   fixed: Column | None = None) -> Column:
    """Array of box names holding a point: named (west, east, south, north) boxes and one fixed box."""
    tests = [
        F.when((lon >= w) & (lon < e) & (lat >= s) & (lat < n), F.lit(name)) for name, (w, e, s, n) in named.items()
    ]
    if fixed is not None:
        tests.append(fixed.cast("string"))
    return F.array_compact(F.array(*tests))


def box_series(df: DataFrame, keys: Sequence[str], value: str, weight: Column, boxes: Column) -> DataFrame:
    """Weighted mean series per box, and its z-score over time."""
    series = (
        df.withColumn("box", F.explode(boxes))
        .withColumn("_w", F.when(F.col(value).isNotNull(), weight))
        .groupBy(*keys, "box", "t")
        .agg(ratio(F.sum(F.col(value) * F.col("_w")), F.sum("_w")).alias("mean"))
    )
    over = Window.partitionBy(*keys, "box")
    z = ratio(F.col("mean") - F.avg("mean").over(over), F.stddev_pop("mean").over(over))
    return series.withColumn("standardized", z)
