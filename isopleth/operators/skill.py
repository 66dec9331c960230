"""Skill of predictions against references."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isopleth.functions.stats import (
    bias,
    clip,
    correlation_p_value,
    exact_median,
    exact_quantiles,
    mae,
    pearson,
    ratio,
    rmse,
    scalar,
    spearman,
)


def temporal_skill(df: DataFrame, keys: Sequence[str], value: str, ref: str, min_months: int = 24) -> DataFrame:
    """RMSE, MAE, bias, correlation and efficiency per series with enough joint months."""
    both = df.where(F.col(value).isNotNull() & F.col(ref).isNotNull())
    err = F.col(value) - F.col(ref)
    return both.groupBy(*keys).agg(
        F.count("*").alias("n_months"),
        rmse(value, ref).alias("rmse"),
        mae(value, ref).alias("mae"),
        bias(value, ref).alias("bias"),
        pearson(value, ref, 1).alias("pcc"),
        (1.0 - ratio(F.avg(err * err), F.var_pop(ref))).alias("nse"),
    ).where(F.col("n_months") >= min_months)


def monthly_skill(df: DataFrame, keys: Sequence[str], value: str, ref: str) -> DataFrame:
    """Error over space for each month."""
    return df.groupBy(*keys, "t").agg(
        rmse(value, ref).alias("rmse"), mae(value, ref).alias("mae"), bias(value, ref).alias("bias")
    )


def spatial_correlation(df: DataFrame, keys: Sequence[str], value: str, ref: str) -> DataFrame:
    return df.groupBy(*keys).agg(pearson(value, ref).alias("corr"), F.count("*").alias("n"))


def clipped_mean_correlation(df: DataFrame, keys: Sequence[str], sample: str, a: str, b: str,
                             eps: float = 1e-6) -> DataFrame:
    """Mean over samples of the spatial correlation of valid cells, clipped to [0, 1]."""
    n = F.count("*")

    def scale(x: str) -> Column:
        return F.sqrt(F.greatest(F.var_pop(x) * n, F.lit(eps)))

    per = df.groupBy(*keys, sample).agg(
        (F.covar_pop(a, b) * n / F.greatest(scale(a) * scale(b), F.lit(eps))).alias("_r")
    )
    return per.groupBy(*keys).agg(clip(F.avg("_r"), 0.0, 1.0).alias("corr"))


def anomaly_zscore(df: DataFrame, cell: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Adds ``<c>_anom`` and ``<c>_z`` over each cell's joint months; a flat series has no z."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull()
    over = Window.partitionBy(*cell)
    out = df.where(ok).withColumns(
        {
            **{f"{c}_anom": F.col(c) - F.avg(c).over(over) for c in columns},
            **{f"_sd_{c}": F.stddev_pop(c).over(over) for c in columns},
        }
    )
    scaled = out.withColumns({f"{c}_z": ratio(F.col(f"{c}_anom"), F.col(f"_sd_{c}")) for c in columns})
    return scaled.drop(*[f"_sd_{c}" for c in columns])


def external_monthly(z: DataFrame, keys: Sequence[str], a: str, b: str, n_cells: int) -> DataFrame:
    """Spatial correlation of anomalies, RMSE of z-scores and covered share per month."""
    return z.groupBy(*keys, "t").agg(
        pearson(f"{a}_anom", f"{b}_anom").alias("spatial_corr"),
        rmse(f"{a}_z", f"{b}_z").alias("rmse_z"),
        (F.count("*") / F.lit(float(n_cells))).alias("valid_fraction"),
    )


def per_cell_correlation(df: DataFrame, keys: Sequence[str], a: str, b: str, min_months: int) -> DataFrame:
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return both.groupBy(*keys).agg(F.count("*").alias("n_months"), pearson(a, b, 1).alias("pcc")).where(
        (F.col("n_months") >= min_months) & F.col("pcc").isNotNull()
    )


def location_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, exact median and count of a column per group of any size."""
    base = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    if not keys:
        middle = exact_median(df, [], value, "median")
        return base.withColumn("median", scalar(middle))
    return base.join(exact_median(df, keys, value, "median"), list(keys), "left")


def model_table(skill: DataFrame, cell: Sequence[str], models: Sequence[str], value: str = "pcc") -> DataFrame:
    """One row per cell with a column per model; only cells finite for every model."""
    wide = skill.groupBy(*cell).pivot("model", list(models)).agg(F.max(value))
    return wide.dropna(subset=list(models))


def basin_skill(series: DataFrame, zone: str, pred: str, refs: Sequence[str], sizes: DataFrame) -> DataFrame:
    """Correlation and RMSE of basin series against several references, largest basins first."""
    aggs: list[Column] = []
    for r in refs:
        aggs += [pearson(pred, r).alias(f"corr_{r}"), rmse(pred, r).alias(f"rmse_{r}")]
    return series.groupBy(zone).agg(*aggs).join(sizes, zone).orderBy(F.desc("n_cells"), zone)


def spearman_test(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Rank correlation with its two-sided p-value."""
    return spearman(df, keys, x, y).withColumn("p_value", correlation_p_value("rho", F.col("n").cast("double")))


def decile_medians(df: DataFrame, x: str, y: str, parts: int = 10) -> DataFrame:
    """Medians of x and y between consecutive quantile edges of x; an edge value counts in both bins."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    names = [f"e{i:02d}" for i in range(parts + 1)]
    edges = exact_quantiles(both, [], x, {n: i / parts for i, n in enumerate(names)})
    one = edges.select(F.array(*names).alias("a"))
    spans = F.transform(
        F.sequence(F.lit(0), F.lit(parts - 1)),
        lambda i: F.struct(i.alias("i"), F.col("_e")[i].alias("lo"), F.col("_e")[i + 1].alias("hi")),
    )
    hit = F.filter(spans, lambda s: (F.col(x) >= s["lo"]) & (F.col(x) <= s["hi"]))
    binned = both.withColumn("_e", scalar(one)).select(x, y, F.explode(hit).alias("_s")).select(
        x, y, F.col("_s.i").alias("bin")
    )
    counts = binned.groupBy("bin").agg(F.count("*").alias("n"))
    return counts.join(exact_median(binned, ["bin"], x, "x_median"), "bin").join(
        exact_median(binned, ["bin"], y, "y_median"), "bin"
    )


def min_max_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each column scaled by its range over the rows (models)."""
    span = df.agg(*[F.min(c).alias(f"lo_{c}") for c in columns], *[F.max(c).alias(f"hi_{c}") for c in columns])
    one = span.select(F.struct(*span.columns).alias("s"))
    scaled = df.withColumn("_s", scalar(one))
    return scaled.withColumns(
        {c: ratio(F.col(c) - F.col(f"_s.lo_{c}"), F.col(f"_s.hi_{c}") - F.col(f"_s.lo_{c}")) for c in columns}
    ).drop("_s")


def display_limit(df: DataFrame, value: str, low: float = 0.02, high: float = 0.98, least: float = 0.001) -> DataFrame:
    """Symmetric limit from two quantiles and how many values lie beyond it."""
    q = exact_quantiles(df, [], value, {"a": low, "b": high})
    limit = F.greatest(F.abs("a"), F.abs("b"), F.lit(least))
    one = q.select(limit.alias("m"))
    return df.withColumn("_m", scalar(one)).agg(
        F.max("_m").alias("symmetric_limit"), F.count_if(F.abs(value) > F.col("_m")).alias("n_clipped")
    )


def range_audit(df: DataFrame, keys: Sequence[str], value: str, limits: Mapping[str, tuple[float, float]],
                name: str) -> DataFrame:
    """Present values and how many fall outside each layer's limits."""
    low = F.create_map(*[x for n, (lo, _) in limits.items() for x in (F.lit(n), F.lit(lo))])
    high = F.create_map(*[x for n, (_, hi) in limits.items() for x in (F.lit(n), F.lit(hi))])
    return df.groupBy(*keys).agg(
        F.count(value).alias("n_finite"),
        F.count_if(F.col(value) < F.try_element_at(low, F.col(name))).alias("n_below"),
        F.count_if(F.col(value) > F.try_element_at(high, F.col(name))).alias("n_above"),
    )


def best_epoch(history: DataFrame, epoch: str, loss: str) -> DataFrame:
    """The epoch of the first strict minimum, with the loss."""
    best = F.min(F.when(F.col(loss).isNotNull(), F.struct(loss, epoch)))
    return history.agg(best.alias("b")).select(
        F.col(f"b.{epoch}").alias("best_epoch"), F.col(f"b.{loss}").alias("best_loss")
    )


def improvements(history: DataFrame, epoch: str, loss: str) -> DataFrame:
    """Marks epochs that beat every earlier one; the number of epochs bounds the window."""
    before = Window.orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.min(loss).over(before)
    return history.withColumn("improved", F.col(loss) < F.coalesce(earlier, F.lit(float("inf"))))
