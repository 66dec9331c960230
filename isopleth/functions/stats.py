"""Guarded statistics as aggregate expressions, and distributed exact quantiles.

All variances are population variances.  NULL means missing.  Division by
zero gives NULL rather than an ANSI error.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from isopleth.session import pinned


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def ratio(num: Column, den: Column) -> Column:
    """``num / den``, NULL where the denominator is zero."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """Clamp, leaving NULL as NULL."""
    out = x
    if low is not None:
        out = F.when(x < F.lit(low), F.lit(low)).otherwise(out)
    if high is not None:
        out = F.when(x > F.lit(high), F.lit(high)).otherwise(out)
    return F.when(x.isNotNull(), out)


def nan_to_null(x: Column | str) -> Column:
    return F.nanvl(col(x), F.lit(None).cast("double"))


def joint(x: Column, y: Column) -> tuple[Column, Column]:
    """Both values, each NULL unless both are present."""
    ok = x.isNotNull() & y.isNotNull()
    return F.when(ok, x), F.when(ok, y)


def pearson(x: Column | str, y: Column | str, min_n: int = 3) -> Column:
    """Aggregate: Pearson correlation over joint rows, NULL if n is small or a side is constant."""
    a, b = joint(col(x), col(y))
    return F.when(
        F.count(a) >= min_n,
        ratio(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)),
    )


def rmse(x: Column | str, y: Column | str) -> Column:
    d = col(x) - col(y)
    return F.sqrt(F.avg(d * d))


def mae(x: Column | str, y: Column | str) -> Column:
    return F.avg(F.abs(col(x) - col(y)))


def bias(x: Column | str, y: Column | str) -> Column:
    return F.avg(col(x) - col(y))


def weighted_mean(value: Column, weight: Column, floor: float | None = None) -> Column:
    """Aggregate: sum(v*w)/sum(w); ``floor`` keeps the denominator away from zero."""
    w = F.when(value.isNotNull() & weight.isNotNull(), weight)
    den = F.sum(w)
    if floor is not None:
        den = F.greatest(F.coalesce(den, F.lit(0.0)), F.lit(floor))
        return F.coalesce(F.sum(value * w), F.lit(0.0)) / den
    return ratio(F.sum(value * w), den)


def slope(y: Column | str, x: Column | str, min_n: int = 3) -> Column:
    """Aggregate: least-squares slope of y on x."""
    yy, xx = joint(col(y), col(x).cast("double"))
    return F.when(F.count(yy) >= min_n, F.regr_slope(yy, xx))


def bounded_median(value: Column | str) -> Column:
    """Exact median of a group whose size the calendar or the block geometry bounds."""
    return F.percentile(col(value), F.lit(0.5))


def scalar(df: DataFrame) -> Column:
    """A one-row, one-column result as a value usable in another plan."""
    return df.scalar()


def in_ranges(df: DataFrame, order: Sequence[str], bins: int | None = None) -> DataFrame:
    """The rows with ``_b``, a number that never decreases in the given order.

    Rows are range-partitioned, so a range holds about as many rows as any
    other whatever scales the values have, and ``_b`` is the partition.  The
    result is written (or cached), so every later use sees the same ranges.
    """
    cols = [F.col(c) for c in order]
    dealt = df.repartitionByRange(bins, *cols) if bins else df.repartitionByRange(*cols)
    return pinned(dealt.withColumn("_b", F.spark_partition_id()))


def _value_counts(df: DataFrame, keys: list[str], value: str, bins: int | None) -> DataFrame:
    """Distinct values per group with their count ``_c`` and range ``_b``; combined before the shuffle."""
    base = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    return in_ranges(base.groupBy(*keys, "_v").agg(F.count("*").alias("_c")), [*keys, "_v"], bins)


def _bin_offsets(ties: DataFrame, keys: list[str]) -> DataFrame:
    """Per bin: how many values lie in lower bins ``_off``, in it ``_m``, in the group ``_n``."""
    across = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    return (
        ties.groupBy(*keys, "_b")
        .agg(F.sum("_c").alias("_m"))
        .withColumn("_off", F.coalesce(F.sum("_m").over(across), F.lit(0)))
        .withColumn("_n", F.sum("_m").over(Window.partitionBy(*keys)))
    )


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    bins: int | None = None,
) -> DataFrame:
    """Exact linear quantiles of groups of any size, one row per group.

    Distinct values are counted (combined map-side), dealt to ranges of equal
    numbers of rows and summed per range; only the ranges that hold a requested
    rank are then ordered.  No task orders more than one range, even when one
    group has most of the rows.
    """
    keys = list(keys)
    ties = _value_counts(df, keys, value, bins)
    ranks: list[Column] = []
    for i, p in enumerate(probs.values()):
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        for side, rank in ((0, F.floor(pos)), (1, F.ceil(pos))):
            ranks.append(
                F.struct(
                    F.lit(2 * i + side).alias("i"),
                    rank.cast("long").alias("rank"),
                    (pos - F.floor(pos)).alias("frac"),
                )
            )
    targets = (
        _bin_offsets(ties, keys)
        .select(*keys, "_b", "_off", "_m", F.explode(F.array(*ranks)).alias("_q"))
        .where((F.col("_q.rank") >= F.col("_off")) & (F.col("_q.rank") < F.col("_off") + F.col("_m")))
        .groupBy(*keys, "_b", "_off")
        .agg(F.collect_list("_q").alias("_qs"))
    )
    inside = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    picked = (
        ties.join(targets, [*keys, "_b"])
        .withColumn("_end", F.col("_off") + F.sum("_c").over(inside))
        .select(*keys, "_v", "_end", (F.col("_end") - F.col("_c")).alias("_start"), F.explode("_qs").alias("_q"))
        .where((F.col("_start") <= F.col("_q.rank")) & (F.col("_q.rank") < F.col("_end")))
    )

    def at(i: int, field: str) -> Column:
        return F.max(F.when(F.col("_q.i") == i, F.col(field)))

    return picked.groupBy(*keys).agg(
        *[
            (at(2 * i, "_v") + (at(2 * i + 1, "_v") - at(2 * i, "_v")) * at(2 * i, "_q.frac")).alias(name)
            for i, name in enumerate(probs)
        ]
    )


def exact_median(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    return exact_quantiles(df, keys, value, {out: 0.5})


def rank_table(df: DataFrame, keys: Sequence[str], value: str, out: str, bins: int | None = None) -> DataFrame:
    """Distinct values of each group with their average rank (ties share the mean rank)."""
    keys = list(keys)
    ties = _value_counts(df, keys, value, bins)
    inside = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    return (
        ties.withColumn("_below", F.coalesce(F.sum("_c").over(inside), F.lit(0)))
        .join(_bin_offsets(ties, keys), [*keys, "_b"])
        .select(
            *keys,
            F.col("_v").alias(value),
            (F.col("_off") + F.col("_below") + (F.col("_c") + 1) / 2.0).alias(out),
        )
    )


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Add average ranks within each group of any size."""
    ranks = rank_table(df, keys, value, out)
    return df.where(F.col(value).isNotNull()).join(ranks, [*keys, value])


def ecdf(df: DataFrame, keys: Sequence[str], value: str, out: str = "fraction", bins: int | None = None) -> DataFrame:
    """Every present value with its position/n in sorted order; large groups are ordered by ranges."""
    keys = list(keys)
    ties = _value_counts(df, keys, value, bins)
    inside = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    placed = ties.withColumn("_below", F.coalesce(F.sum("_c").over(inside), F.lit(0))).join(
        _bin_offsets(ties, keys), [*keys, "_b"]
    )
    first = F.col("_off") + F.col("_below") + 1
    return placed.select(
        *keys,
        F.col("_v").alias(value),
        "_n",
        F.explode(F.sequence(first.cast("long"), (first + F.col("_c") - 1).cast("long"))).alias("_k"),
    ).select(*keys, value, (F.col("_k") / F.col("_n")).alias(out))


@F.pandas_udf(DoubleType())
def correlation_p_value(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of a correlation from the t distribution with n-2 degrees of freedom.

    The incomplete beta integral becomes an integral of sin**(n-3) and is
    evaluated with Gauss-Legendre nodes.
    """
    rho = r.to_numpy(dtype=float)
    df = n.to_numpy(dtype=float) - 2.0
    good = np.isfinite(rho) & (df > 0)
    out = np.full(len(rho), np.nan)
    nodes, node_weights = np.polynomial.legendre.leggauss(256)
    top = np.arcsin(np.sqrt(np.clip(1.0 - rho[good] ** 2, 0.0, 1.0)))[:, None]
    half = df[good][:, None] / 2
    log_beta = np.array([math.lgamma(h) + math.lgamma(0.5) - math.lgamma(h + 0.5) for h in half[:, 0]])[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        f = np.exp((2 * half - 1) * np.log(np.sin(0.5 * top * (nodes + 1.0))) - log_beta)
    p = np.minimum(1.0, top[:, 0] * (f @ node_weights))
    out[good] = np.where(top[:, 0] > 0, p, 0.0)
    return pd.Series(out)


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, out: str = "rho", min_n: int = 3) -> DataFrame:
    """Average-rank correlation of two columns per group, with the joint count ``n``."""
    keys = list(keys)
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        *keys, F.col(x).alias("_x1"), F.col(y).alias("_y1")
    )
    ranked = both.join(rank_table(both, keys, "_x1", "_rx"), [*keys, "_x1"]).join(
        rank_table(both, keys, "_y1", "_ry"), [*keys, "_y1"]
    )
    return ranked.groupBy(*keys).agg(
        pearson("_rx", "_ry", min_n).alias(out), F.count("*").alias("n")
    )


def dense_index(df: DataFrame, unit: str, keys: Sequence[str] = (), out: str = "idx", bins: int | None = None) -> DataFrame:
    """Distinct integer ``unit`` values per group with their 0-based position in sorted order.

    Positions come from counts per range of equal numbers of units, so no
    single task sees all units, and a far id changes nothing.
    """
    keys = list(keys)
    units = df.select(*keys, F.col(unit).cast("long").alias(unit)).where(F.col(unit).isNotNull()).distinct()
    placed = in_ranges(units, [*keys, unit], bins)
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(*keys, "_b").agg(F.count("*").alias("_c")).select(
        *keys, "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off")
    )
    inside = Window.partitionBy(*keys, "_b").orderBy(unit)
    return placed.join(offsets, [*keys, "_b"]).select(
        *keys, unit, (F.col("_off") + F.row_number().over(inside) - 1).cast("long").alias(out)
    )
