"""Regional and stratified summaries of model gains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isopleth.functions.stats import bounded_median, ratio


def long_gains(frame: DataFrame, keep: Sequence[str], best: str, others: Sequence[str]) -> DataFrame:
    """One row per cell and comparison with the two skills."""
    return frame.select(
        *keep,
        F.col(best).alias("best"),
        F.explode(
            F.array(*[F.struct(F.lit(f"{best}-{m}").alias("comparison"), F.col(m).alias("other")) for m in others])
        ).alias("c"),
    ).select(*keep, "best", "c.comparison", "c.other")


def regions(frame: DataFrame, box: Sequence[str], best: str, others: Sequence[str], covariates: Sequence[str],
            min_cells: int = 5) -> DataFrame:
    """Medians of gains per fixed box, ranked by the smallest gain.

    The size of a box bounds its cells, and the globe bounds the boxes.
    """
    gains = {m: bounded_median(F.col(best) - F.col(m)).alias(f"gain_{m}") for m in others}
    out = frame.groupBy(*box).agg(
        F.count("*").alias("n_cells"), *gains.values(), *[bounded_median(c).alias(f"median_{c}") for c in covariates]
    ).where(F.col("n_cells") >= min_cells)
    out = out.withColumn("s_min", F.least(*[F.col(f"gain_{m}") for m in others]))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("s_min"), *box)))


def top_and_bottom(ranked: DataFrame, top: int = 2) -> DataFrame:
    """The best regions with a positive smallest gain, and the worst with a negative one."""
    best = ranked.where("s_min > 0").orderBy("rank").limit(top)
    worst = ranked.where("s_min < 0").orderBy(F.desc("rank")).limit(1)
    return best.unionByName(worst)


def case_series(rows: DataFrame, region: str, value: str) -> DataFrame:
    """Mean series per region and model, and its z-score over time."""
    mean = rows.groupBy(region, "model", "t").agg(F.avg(value).alias("mean"))
    over = Window.partitionBy(region, "model")
    return mean.withColumn(
        "standardized", ratio(F.col("mean") - F.avg("mean").over(over), F.stddev_pop("mean").over(over))
    )
