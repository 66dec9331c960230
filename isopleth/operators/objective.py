"""Training-objective terms evaluated on a table of predictions.

``df`` has one row per valid cell; ``keys`` name the sample or batch.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isopleth.functions.stats import clip, weighted_mean
from isopleth.grid import Grid
from isopleth.operators import filters
from isopleth.operators.conserve import block_mean
from isopleth.operators.neighbours import forward_difference

EPS = 1e-6


def masked_mean(value: Column, weight: Column) -> Column:
    return weighted_mean(value, weight, floor=EPS)


def huber(diff: Column) -> Column:
    """Smooth L1 with unit threshold."""
    a = F.abs(diff)
    return F.when(a < 1.0, 0.5 * a * a).otherwise(a - 0.5)


def coarse_mse(df: DataFrame, keys: Sequence[str], sample: str, value: str, target: str, grid: Grid,
               weight: str) -> DataFrame:
    """Squared error of block means over the blocks that have weight."""
    blocks = block_mean(df, [*keys, sample], [value, target], grid, weight)
    d = F.col(value) - F.col(target)
    return blocks.groupBy(*keys).agg(F.avg(d * d).alias("mass"))


def fine_mse(df: DataFrame, keys: Sequence[str], value: str, target: str) -> DataFrame:
    d = F.col(value) - F.col(target)
    return df.groupBy(*keys).agg(masked_mean(d * d, F.lit(1.0)).alias("fine"))


def value_huber(df: DataFrame, keys: Sequence[str], value: str, prior: str, alpha: str) -> DataFrame:
    return df.groupBy(*keys).agg(masked_mean(huber(F.col(value) - F.col(prior)), F.col(alpha)).alias("value_term"))


def gradient_l1(df: DataFrame, keys: Sequence[str], sample: str, value: str, prior: str, beta: str) -> DataFrame:
    """Mean of the x and y gradient differences, weighted by the mean beta of both ends."""
    group = list(dict.fromkeys([*keys, sample]))
    d = forward_difference(df, group, [value, prior], keep=[beta])

    def term(axis: str) -> Column:
        gap = F.abs(F.col(f"{value}_d{axis}") - F.col(f"{prior}_d{axis}"))
        return masked_mean(gap, F.when(gap.isNotNull(), 0.5 * (F.col(beta) + F.col(f"{beta}_{axis}"))))

    return d.groupBy(*keys).agg((0.5 * (term("x") + term("y"))).alias("gradient"))


def basin_mse(df: DataFrame, keys: Sequence[str], sample: str, basin: str, value: str, reference: str,
              min_cells: int) -> DataFrame:
    """Mean squared basin-mean difference over samples and basins with enough cells."""
    group = list(dict.fromkeys([*keys, sample]))
    per = df.where(F.col(basin) > 0).groupBy(*group, basin).agg(
        (F.avg(value) - F.avg(reference)).alias("_d"), F.count("*").alias("_n")
    ).where(F.col("_n") >= min_cells)
    return per.groupBy(*keys).agg(F.avg(F.col("_d") * F.col("_d")).alias("basin"))


def spectral(df: DataFrame, keys: Sequence[str], sample: str, value: str, low_ref: str, high_ref: str, beta: str,
             grid: Grid, size: int = 13, sigma: float = 3.0, w_low: float = 0.2, w_high: float = 0.1) -> DataFrame:
    """Low-pass error to one reference plus beta-weighted high-pass error to another."""
    group = list(dict.fromkeys([*keys, sample]))
    smooth = filters.blur(df, group, [value, low_ref, high_ref], grid, filters.gaussian_taps(size, sigma), "reflect", EPS)
    rows = smooth.join(df.select(*group, "iy", "ix", beta), [*group, "iy", "ix"])
    low = F.col(f"{value}_low") - F.col(f"{low_ref}_low")
    high = (F.col(value) - F.col(f"{value}_low")) - (F.col(high_ref) - F.col(f"{high_ref}_low"))
    out = rows.groupBy(*keys).agg(
        masked_mean(low * low, F.lit(1.0)).alias("low"), masked_mean(high * high, F.col(beta)).alias("high")
    )
    return out.withColumn("spectral", w_low * F.col("low") + w_high * F.col("high"))


def sobel_mse(df: DataFrame, keys: Sequence[str], sample: str, value: str, reference: str) -> DataFrame:
    """Half the squared Sobel difference, averaged over valid cells.  Sobel is linear, so one pass suffices."""
    group = list(dict.fromkeys([*keys, sample]))
    s = filters.sobel(df.withColumn("_d", F.col(value) - F.col(reference)), group, "_d")
    e = 0.5 * (F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy"))
    return s.groupBy(*keys).agg(F.avg(e).alias("sobel"))


# Canonical weight keys, their older spellings and defaults.
WEIGHT_KEYS = {
    "mass": ("mass_weight", "lambda_coarse", 1.0),
    "value_term": ("value_weight", "lambda_value", 0.0),
    "gradient": ("gradient_weight", "lambda_gradient", 0.0),
    "fine": ("fine_weight", "lambda_fine", 0.0),
    "spectral": ("spectral_weight", "lambda_spectral", 0.0),
    "basin": ("basin_weight", "lambda_basin", 0.0),
    "gate": ("gate_weight", "gate_weight", 0.0),
}


def term_weights(config: Mapping[str, float]) -> dict[str, float]:
    return {
        term: float(config.get(new, config.get(old, default))) for term, (new, old, default) in WEIGHT_KEYS.items()
    }


def total(terms: Sequence[DataFrame], keys: Sequence[str], config: Mapping[str, float]) -> DataFrame:
    """Join term tables by sample and add the weighted sum; an absent term counts 0."""
    joined = reduce(lambda a, b: a.join(b, list(keys), "left"), terms)
    weights = term_weights(config)
    parts = [F.lit(w) * F.coalesce(F.col(t), F.lit(0.0)) for t, w in weights.items() if t in joined.columns]
    return joined.withColumn("total", reduce(lambda a, b: a + b, parts))


def dynamic_total(terms: DataFrame, reconstruction: str, constraint: str, share: str) -> DataFrame:
    """``share * reconstruction + (1 - share) * constraint``."""
    k = F.col(share)
    return terms.withColumn("total", k * F.col(reconstruction) + (1.0 - k) * F.col(constraint))


def gate_terms(df: DataFrame, keys: Sequence[str], gate: str, truth: str, min_std: float = 0.10,
               saturation: float = 0.02, variance_weight: float = 0.0, mode: str = "binary_cross_entropy") -> DataFrame:
    """Supervision, spread and saturation of a reliability gate."""
    g, y = F.col(gate), clip(F.col(truth), 0.0, 1.0)
    p = clip(g, 1e-6, 1.0 - 1e-6)
    loss = -(y * F.log(p) + (1.0 - y) * F.log(1.0 - p)) if mode == "binary_cross_entropy" else huber(g - y)
    flat = (g <= saturation) | (g >= 1.0 - saturation)
    out = df.groupBy(*keys).agg(
        F.avg(loss).alias("supervision"),
        F.avg(F.abs(g - y)).alias("gate_mae"),
        F.sqrt(F.greatest(F.var_pop(g), F.lit(1e-12))).alias("gate_std"),
        F.avg(flat.cast("double")).alias("saturated_share"),
        F.avg(g).alias("gate_mean"),
        F.min(g).alias("gate_min"),
        F.max(g).alias("gate_max"),
    )
    short = F.greatest(F.lit(min_std) - F.col("gate_std"), F.lit(0.0))
    return out.withColumn("variance_penalty", short * short).withColumn(
        "gate", F.col("supervision") + variance_weight * F.col("variance_penalty")
    )


