"""Contrasts between cells of one block, observed and modelled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isopleth.functions.stats import bounded_median, pearson
from isopleth.operators.align import block_pairs

PAIR = ["block", "iy_i", "ix_i", "iy_j", "ix_j"]


def contrasts(obs: DataFrame, models: DataFrame, models_n: int) -> DataFrame:
    """Per pair and common period the observed difference and, in one array, that of every member.

    A period counts for a cell only if every model and variant has a value
    there.  Pairs form inside one block and period, so at most ``factor**2``
    cells meet.  ``obs``: block, iy, ix, t, obs; ``models``: t, iy, ix,
    model, variant, value.
    """
    members = models.where(F.col("value").isNotNull()).groupBy("t", "iy", "ix").agg(
        F.collect_list(F.struct("model", "variant", "value")).alias("members")
    )
    complete = members.where(F.size("members") == models_n).withColumn("members", F.array_sort("members"))
    cells = obs.where(F.col("obs").isNotNull()).join(complete, ["t", "iy", "ix"])
    a, b = cells.alias("a"), cells.alias("b")
    order = (F.col("a.iy") < F.col("b.iy")) | ((F.col("a.iy") == F.col("b.iy")) & (F.col("a.ix") < F.col("b.ix")))
    met = a.join(b, (F.col("a.block") == F.col("b.block")) & (F.col("a.t") == F.col("b.t")) & order)
    both = F.zip_with(
        "a.members",
        "b.members",
        lambda x, y: F.struct(
            x["model"].alias("model"), x["variant"].alias("variant"), (x["value"] - y["value"]).alias("model_d")
        ),
    )
    return met.select(
        F.col("a.block").alias("block"),
        F.col("a.iy").alias("iy_i"),
        F.col("a.ix").alias("ix_i"),
        F.col("b.iy").alias("iy_j"),
        F.col("b.ix").alias("ix_j"),
        F.col("a.t").alias("t"),
        (F.col("a.obs") - F.col("b.obs")).alias("obs_d"),
        both.alias("members"),
    )


def _ranked(df: DataFrame, group: list[str], value: str, out: str) -> DataFrame:
    """Average ranks inside one pair's series, which the calendar bounds."""
    order = Window.partitionBy(*group).orderBy(value)
    ties = Window.partitionBy(*group, value)
    return df.withColumn(out, F.rank().over(order) + (F.count("*").over(ties) - 1) / 2.0)


def pair_table(series: DataFrame) -> DataFrame:
    """Correlation, rank correlation and sign agreement per pair and member, with spreads.

    ``series`` as of :func:`contrasts`.  The observation is ranked, and the
    periods are listed, once per pair; only then the members part.  All that
    follows groups by the pair and more, so the series travel once.
    """
    observed = _ranked(series, PAIR, "obs_d", "_ro")
    group = [*PAIR, "model", "variant"]
    members = observed.select(*PAIR, "t", "obs_d", "_ro", F.explode("members").alias("m")).select(*PAIR, "t", "obs_d", "_ro", "m.*")
    same = F.signum("obs_d") == F.signum("model_d")
    table = _ranked(members, group, "model_d", "_rm").groupBy(*group).agg(
        F.count("*").alias("n_common"),
        pearson("model_d", "obs_d", 1).alias("pearson_r"),
        pearson("_rm", "_ro", 1).alias("spearman_rho"),
        F.avg(same.cast("double")).alias("sign_agreement"),
        F.count_if(F.col("obs_d") == 0).alias("obs_zero"),
        F.stddev_pop("obs_d").alias("_so"),
        F.stddev_pop("model_d").alias("_sm"),
    )
    days = F.array_sort(F.collect_list(F.date_format("t", "yyyy-MM-dd")))
    periods = series.groupBy(*PAIR).agg(F.array_join(days, ";").alias("common_periods"))
    return table.join(periods, PAIR)


def judged(table: DataFrame, minimum: int) -> DataFrame:
    """Marks each row with the reason its pair cannot be used, NULL if it can."""
    constant = (F.col("_so") == 0) | (F.col("_sm") == 0)
    reason = F.when(F.col("n_common") < minimum, "insufficient_common_months").when(
        constant, "constant_difference_in_observation_or_model"
    )
    over = Window.partitionBy(*PAIR)
    return table.withColumn(
        "reason", F.array_join(F.array_sort(F.collect_set(reason).over(over)), ";")
    ).withColumn("reason", F.nullif("reason", F.lit("")))


def usable(judged_table: DataFrame, weights: DataFrame, weight: str = "beta") -> DataFrame:
    """Kept pairs with the mean weight of both ends."""
    end = lambda s: weights.select(
        F.col("iy").alias(f"iy_{s}"), F.col("ix").alias(f"ix_{s}"), F.col(weight).alias(f"{weight}_{s}")
    )
    kept = judged_table.where("reason IS NULL").drop("_so", "_sm", "reason")
    return (
        kept.join(end("i"), ["iy_i", "ix_i"], "left")
        .join(end("j"), ["iy_j", "ix_j"], "left")
        .withColumn(f"{weight}_pair", (F.col(f"{weight}_i") + F.col(f"{weight}_j")) / 2)
    )


def excluded(cells: DataFrame, judged_table: DataFrame) -> DataFrame:
    """Every pair that is not used, with its sorted distinct reasons."""
    reasons = judged_table.groupBy(*PAIR).agg(F.max("reason").alias("reason"), F.count("*").alias("_n"))
    joined = block_pairs(cells, "block").join(reasons, PAIR, "left")
    why = F.when(F.col("_n").isNull(), "insufficient_common_months").otherwise(F.col("reason"))
    return joined.select(*PAIR, why.alias("reason")).where("reason IS NOT NULL")


def thresholds(pairs: DataFrame, levels: Sequence[int], sites: DataFrame) -> DataFrame:
    """Blocks, pairs, cells and sites left at each minimum of common periods, per variant."""
    met = F.filter(F.array(*[F.lit(k) for k in levels]), lambda k: F.col("n_common") >= k)
    one = pairs.groupBy(*PAIR, "variant").agg(F.max("n_common").alias("n_common"))
    nested = one.withColumn("threshold", F.explode(met))
    keys = ["variant", "threshold"]
    base = nested.groupBy(*keys).agg(F.count("*").alias("n_pairs"), F.count_distinct("block").alias("n_blocks"))
    ends = F.array(*[F.struct(F.col(f"iy_{s}").alias("iy"), F.col(f"ix_{s}").alias("ix")) for s in "ij"])
    cells = nested.select(*keys, F.explode(ends).alias("c")).select(*keys, "c.*").distinct()
    counted = cells.join(sites, ["iy", "ix"], "left").groupBy(*keys).agg(
        F.count("*").alias("n_cells"), F.sum("n_total").alias("n_sites")
    )
    return base.join(counted, keys)


METRICS = {"pearson_r": "pcc", "spearman_rho": "spearman", "sign_agreement": "sign"}


def block_summary(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One median per block and model however many pairs the block has (at most a few hundred)."""
    ends = F.array(*[F.struct(F.col(f"iy_{s}").alias("iy"), F.col(f"ix_{s}").alias("ix")) for s in "ij"])
    return pairs.groupBy(*keys, "block", "model").agg(
        F.count("*").alias("n_pairs"),
        F.size(F.array_distinct(F.flatten(F.collect_set(ends)))).alias("n_cells"),
        *[bounded_median(m).alias(f"median_{n}") for m, n in METRICS.items()],
    )


def gains(summary: DataFrame, models: Sequence[str], best: str, keys: Sequence[str] = ()) -> DataFrame:
    """Per block the best model's median minus each other's; fails if a model is missing."""

    def of(m: str, metric: str) -> Column:
        found = F.max(F.when(F.col("model") == m, F.col(f"median_{metric}")))
        return F.coalesce(found, F.raise_error(F.lit(f"a block lacks model {m}")).cast("double"))

    return summary.groupBy(*keys, "block").agg(
        *[
            (of(best, metric) - of(m, metric)).alias(f"{metric}_gain_{m}")
            for metric in METRICS.values()
            for m in models
            if m != best
        ]
    )
