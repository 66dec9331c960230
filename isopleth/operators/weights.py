"""Reliability weights from disagreement between fields."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isopleth.functions.stats import (
    bounded_median,
    clip,
    exact_quantiles,
    mae,
    pearson,
    ratio,
    rmse,
    scalar,
    spearman,
)
from isopleth.grid import Grid
from isopleth.operators.regrid import nearest
from isopleth.operators.neighbours import forward_difference
from isopleth.operators.temporal import season_amplitude, trend_indexed
from isopleth.session import pinned


def alpha_disagreement(df: DataFrame, cell: Sequence[str], a: str, b: str) -> DataFrame:
    """``alpha = 1 - sum|a-b| / sum(|a|+|b|)`` of the median-centred joint series; 0 if both are flat."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    over = Window.partitionBy(*cell)
    centred = both.select(
        *cell,
        (F.col(a) - bounded_median(a).over(over)).alias("_a"),
        (F.col(b) - bounded_median(b).over(over)).alias("_b"),
    )
    den = F.sum(F.abs("_a") + F.abs("_b"))
    d = F.when(den > 0, ratio(F.sum(F.abs(F.col("_a") - F.col("_b"))), den)).otherwise(1.0)
    out = centred.groupBy(*cell).agg(d.alias("disagreement"), F.count("*").alias("n_months"))
    return out.withColumn("disagreement", clip(F.col("disagreement"), 0.0, 1.0)).withColumn(
        "alpha", 1.0 - F.col("disagreement")
    )


def alpha_diagnostics(df: DataFrame, cell: Sequence[str], a: str, b: str) -> DataFrame:
    """Correlation, trend and amplitude differences and scaled error per cell with three joint months."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    base = both.groupBy(*cell).agg(
        pearson(a, b).alias("pcc"),
        ratio(rmse(a, b), F.stddev_pop(b)).alias("nrmse"),
        F.count("*").alias("n_months"),
    ).where("n_months >= 3")
    trend = trend_indexed(both, [a, b], cell, calendar=df).select(*cell, (F.col(a) - F.col(b)).alias("trend_difference"))
    season = season_amplitude(df, [a, b], cell).select(
        *cell, (F.col(a) - F.col(b)).alias("annual_amplitude_difference")
    )
    return base.join(trend, list(cell), "left").join(season, list(cell), "left")


def gradient_vectors(long: DataFrame, source: str, value: str, valid: Column | None = None) -> DataFrame:
    """Gradient vectors ``gx, gy`` of a long table of fields; only complete vectors."""
    diffs = forward_difference(long, [source, "t"], [value], valid)
    return diffs.where(F.col(f"{value}_dx").isNotNull() & F.col(f"{value}_dy").isNotNull()).select(
        source, "t", "iy", "ix", F.col(f"{value}_dx").alias("gx"), F.col(f"{value}_dy").alias("gy")
    )


def gradient_scales(vectors: DataFrame, source: str) -> DataFrame:
    """Median of the positive vector lengths per source."""
    lengths = vectors.withColumn("_g", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))
    return exact_quantiles(lengths.where("_g > 0"), [source], "_g", {"q": 0.5})


def gradient_disagreement(vectors: DataFrame, scales: DataFrame, source: str, prior: str) -> DataFrame:
    """Scaled vector difference of each source to the prior, in [0, 1]; two zero vectors agree."""
    scaled = vectors.join(scales, source).select(
        source, "t", "iy", "ix", (F.col("gx") / F.col("q")).alias("x"), (F.col("gy") / F.col("q")).alias("y")
    )
    base = scaled.where(F.col(source) == prior).select(
        "t", "iy", "ix", F.col("x").alias("px"), F.col("y").alias("py")
    )
    both = scaled.where(F.col(source) != prior).join(base, ["t", "iy", "ix"])
    num = F.sqrt(F.pow(F.col("px") - F.col("x"), 2) + F.pow(F.col("py") - F.col("y"), 2))
    den = F.sqrt(F.col("px") ** 2 + F.col("py") ** 2) + F.sqrt(F.col("x") ** 2 + F.col("y") ** 2)
    d = F.when(den == 0, 0.0).otherwise(clip(num / den, 0.0, 1.0))
    return both.select(source, "t", "iy", "ix", d.alias("d"))


def beta_from(disagreements: DataFrame, cell: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Median over sources per month, then over months: ``beta = 1 - D``, with the month count."""
    monthly = disagreements.where(F.col("d").isNotNull()).groupBy(*group, *cell, "t").agg(
        bounded_median("d").alias("d")
    )
    return monthly.groupBy(*group, *cell).agg(
        bounded_median("d").alias("disagreement"), F.count("*").alias("n_months")
    ).withColumn("beta", 1.0 - F.col("disagreement"))


def beta_on_land(beta: DataFrame, land: DataFrame, cell: Sequence[str]) -> DataFrame:
    """Beta for every land cell; a cell without evidence gets beta 0 and D 1."""
    return land.select(*cell).join(beta, list(cell), "left").select(
        *cell,
        F.coalesce("beta", F.lit(0.0)).alias("beta"),
        F.coalesce("disagreement", F.lit(1.0)).alias("disagreement"),
        F.coalesce("n_months", F.lit(0)).alias("n_months"),
    )


def leave_one_out(disagreements: DataFrame, sources: Sequence[str], land: DataFrame, cell: Sequence[str],
                  source: str = "field") -> DataFrame:
    """Mean absolute change and rank correlation of beta when each source is left out."""
    kept = F.filter(F.array(*[F.lit(s) for s in ("none", *sources)]), lambda s: s != F.col(source))
    fanned = disagreements.withColumn("left_out", F.explode(kept))
    betas = beta_from(fanned, cell, ["left_out"])
    lands = land.select(*cell)
    full = lands.join(betas.where("left_out = 'none'").select(*cell, F.col("beta").alias("full")), list(cell), "left")
    outs = lands.withColumn("left_out", F.explode(F.array(*[F.lit(s) for s in sources]))).join(
        betas.select(*cell, "left_out", F.col("beta").alias("part")), [*cell, "left_out"], "left"
    )
    pairs = outs.join(full, list(cell)).withColumns(
        {"part": F.coalesce("part", F.lit(0.0)), "full": F.coalesce("full", F.lit(0.0))}
    )
    pairs = pinned(pairs)
    errors = pairs.groupBy("left_out").agg(mae("part", "full").alias("mae"))
    return errors.join(spearman(pairs, ["left_out"], "part", "full", "rho"), "left_out")


def source_coverage(disagreements: DataFrame, cell: Sequence[str], source: str) -> DataFrame:
    return disagreements.groupBy(source, *cell).agg(
        F.count("d").alias("n_months"), F.min("t").alias("first_month"), F.max("t").alias("last_month")
    )


def source_histogram(coverage: DataFrame, land: DataFrame, cell: Sequence[str]) -> DataFrame:
    """Share of land cells by how many sources they have."""
    counts = coverage.where("n_months > 0").groupBy(*cell).agg(F.count("*").alias("n_sources"))
    filled = land.select(*cell).join(counts, list(cell), "left").withColumn(
        "n_sources", F.coalesce("n_sources", F.lit(0))
    )
    total = filled.agg(F.count("*").alias("n"))
    return filled.groupBy("n_sources").agg(F.count("*").alias("n_cells")).withColumn(
        "share", F.col("n_cells") / scalar(total)
    )


def min_max_score(df: DataFrame, values: Mapping[str, Column]) -> DataFrame:
    """Each expression scaled to [0, 1] by its own range; NULL gives 0, a flat field divides by 1."""
    named = df.withColumns({f"_{n}": c for n, c in values.items()})
    span = named.agg(
        *[F.min(f"_{n}").alias(f"lo_{n}") for n in values], *[F.max(f"_{n}").alias(f"hi_{n}") for n in values]
    )
    one = span.select(F.struct(*span.columns).alias("s"))
    out = named.withColumn("_s", scalar(one))
    for n in values:
        lo, hi = F.col(f"_s.lo_{n}"), F.col(f"_s.hi_{n}")
        width = F.when(F.abs(hi - lo) < 1e-12, 1.0).otherwise(hi - lo)
        out = out.withColumn(n, F.coalesce(clip((F.col(f"_{n}") - lo) / width, 0.0, 1.0), F.lit(0.0)))
    return out.drop("_s", *[f"_{n}" for n in values])


def on_cells(cells: DataFrame, layer: DataFrame | None, value: Column, source: Grid, target: Grid, name: str) -> DataFrame:
    """Cells with ``name``: a layer's aggregated value at the nearest source cell; null outside its hull or without a layer.

    ``value`` aggregates a source cell's rows, before anything is resampled.
    """
    if layer is None:
        return cells.withColumn(name, F.lit(None).cast("double"))
    reduced = layer.groupBy("iy", "ix").agg(value.cast("double").alias(name))
    return cells.drop(name).join(nearest(reduced, [], [name], source, target), ["iy", "ix"], "left")


def optional_penalty(cells: DataFrame, layer: DataFrame | None, value: str, source: Grid, target: Grid, name: str) -> DataFrame:
    """Cells with ``name``: the layer's mean over time, resampled, scaled to [0, 1]; 0 where it says nothing."""
    return min_max_score(on_cells(cells, layer, F.avg(value), source, target, f"{name}_raw"), {name: F.col(f"{name}_raw")}).drop(f"{name}_raw")


def land_mask(cells: DataFrame, layer: DataFrame | None, value: str, t: str, source: Grid, target: Grid, name: str = "land") -> DataFrame:
    """Cells with ``name``: 1 where the layer's first month is at least one half, 0 elsewhere; without a layer 1 everywhere."""
    if layer is None:
        return cells.withColumn(name, F.lit(1.0))
    first = layer.where(F.col(t) == scalar(layer.agg(F.min(t).alias("t"))))
    share = on_cells(cells, first, F.max(value), source, target, name)
    return share.withColumn(name, F.when(F.col(name) >= 0.5, 1.0).otherwise(0.0))


# Base, span and penalty coefficients of the two adaptive weights.
ADAPTIVE = {
    "alpha": (0.05, 0.95, {"trend": 0.60, "season": 0.40, "nrmse": 0.40, "arid": 0.35, "glacier": 0.75, "human": 0.50}),
    "beta": (0.10, 0.90, {"trend": 0.45, "season": 0.35, "nrmse": 0.30, "arid": 0.25, "glacier": 0.45, "human": 0.35}),
}


def adaptive_weight(kind: str, corr: str, penalties: Mapping[str, str], land: str) -> Column:
    """Correlation score damped by each penalty, clipped to [0.05, 1], zero off land."""
    base, span, factors = ADAPTIVE[kind]
    score = clip((clip(F.coalesce(F.col(corr), F.lit(0.0)), -1.0, 1.0) + 1.0) / 2.0, 0.0, 1.0)
    for name, k in factors.items():
        score = score * (1.0 - F.lit(k) * F.col(penalties[name]))
    return clip(F.lit(base) + F.lit(span) * score, 0.05, 1.0) * F.col(land).cast("double")


def ramp_above(x: Column, threshold: float) -> Column:
    return clip((clip(x, 0.0, 1.0) - threshold) / max(1.0 - threshold, 1e-6), 0.0, 1.0)


def ramp_below(x: Column, threshold: float) -> Column:
    return clip((F.lit(threshold) - clip(x, 0.0, 1.0)) / threshold, 0.0, 1.0)


def regional_adjust(weight: Column, glacier: Column, aridity: Column, human: Column, strength: Mapping[str, float],
                    arid_from: float = 0.5, humid_below: float = 0.1, human_from: float = 0.05,
                    glacier_floor: float | None = None) -> Column:
    """Reduce a weight by regional membership; optionally keep a share of it on glaciers."""
    ice = clip(glacier, 0.0, 1.0)
    member = {
        "glacier": ice,
        "arid": ramp_above(aridity, arid_from),
        "human": ramp_above(human, human_from),
        "humid": ramp_below(aridity, humid_below),
    }
    out = weight
    for name, m in member.items():
        out = out * (1.0 - clip(m * F.lit(strength.get(name, 0.0)), 0.0, 0.95))
    if glacier_floor is not None:
        out = F.when(ice > 0, F.greatest(out, weight * glacier_floor)).otherwise(out)
    return clip(out, 0.0, 1.0)


def aridity_penalty(layers: Sequence[Column], nodata: float = 65535.0, scale: float = 1e-4,
                    dryland: float = 0.65) -> tuple[Column, Column]:
    """Mean of the monthly index layers, and how far it is below the dryland limit.  Fixed values: the defaults."""
    real = [F.when(x < nodata, x * scale) for x in layers]
    n = sum((x.isNotNull().cast("int") for x in real), F.lit(0))
    total = sum((F.coalesce(x, F.lit(0.0)) for x in real), F.lit(0.0))
    index = ratio(total, n)
    penalty = F.when(index > 0, clip((F.lit(dryland) - index) / dryland, 0.0, 1.0)).otherwise(0.0)
    return index, penalty


def human_composite(irrigated_percent: Column, reservoir: Column) -> Column:
    """70 % irrigated share and 30 % reservoir presence (fixed values), missing counts as 0."""
    a = F.coalesce(clip(irrigated_percent / 100.0, 0.0, 1.0), F.lit(0.0))
    b = F.coalesce(clip(reservoir, 0.0, 1.0), F.lit(0.0))
    return clip(0.7 * a + 0.3 * b, 0.0, 1.0)


def unit_interval(x: Column, label: str, tolerance: float = 2e-6) -> Column:
    """Clamp rounding overshoot to [0, 1]; fail on anything further out."""
    outside = (x < -tolerance) | (x > 1.0 + tolerance)
    return F.when(outside, F.raise_error(F.lit(f"{label} leaves [0, 1]")).cast("double")).otherwise(clip(x, 0.0, 1.0))
