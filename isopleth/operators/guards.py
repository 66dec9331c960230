"""Data contracts: counts of what breaks them, and checks that stop a run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isopleth.functions.stats import scalar

# Tokens that mark a source as unfit for weight building,
# because it is used for validation or is not independent of the target.
BANNED_TOKENS = ("smap", "groundwater", "well", "wgms", "glacier", "grace", "jpl", "csr", "gsfc")

# Attributes a weight file must carry.
FIT_KEYS = (
    "fit_start_requested",
    "fit_end_requested",
    "fit_start_effective",
    "fit_end_effective",
    "fit_n_months",
    "consistency_source_sha256",
)


def axis_mismatch(left: DataFrame, right: DataFrame, axes: Sequence[str], tolerance: float = 1e-8) -> DataFrame:
    """``axis, common, only_left, only_right``: distinct coordinates of each axis, equal within ``tolerance``.

    A coordinate lies in a bucket as wide as the tolerance, so its equals lie
    there or next to it: one equi-join on (axis, bucket), whatever the number
    of coordinates.  Null coordinates are none.
    """

    def points(df: DataFrame) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("double").alias("x")) for a in axes]))
        return df.select(each.alias("p")).select("p.*").where("x IS NOT NULL").distinct()

    bucket = F.floor(F.col("x") / F.lit(tolerance)).cast("long")
    a = points(left).withColumn("b", bucket)
    b = points(right).select("axis", F.col("x").alias("y"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("b"))
    # In the neighbouring bucket within the tolerance, give or take the rounding of the difference.
    near = a.join(b, ["axis", "b"]).where(F.abs(F.col("x") - F.col("y")) <= F.lit(tolerance))
    hits = near.select("axis", F.explode(F.array(F.struct(F.lit(1).alias("s"), "x"), F.struct(F.lit(2).alias("s"), F.col("y").alias("x")))).alias("p"))
    matched = hits.select("axis", "p.*").distinct().select("axis", "s", F.lit(1).alias("hit"), F.lit(0).alias("n"))
    every = a.select("axis", F.lit(1).alias("s"), F.lit(0).alias("hit"), F.lit(1).alias("n")).unionByName(
        points(right).select("axis", F.lit(2).alias("s"), F.lit(0).alias("hit"), F.lit(1).alias("n"))
    )
    only = lambda s: F.sum(F.when(F.col("s") == s, F.col("n") - F.col("hit")).otherwise(0))
    return every.unionByName(matched).groupBy("axis").agg(
        F.sum(F.when(F.col("s") == 1, F.col("hit")).otherwise(0)).alias("common"),
        only(1).alias("only_left"),
        only(2).alias("only_right"),
    )


def raster_faults(df: DataFrame, cell: Sequence[str], zone: str) -> DataFrame:
    """``cells, ambiguous, empty``: a zone raster has one zone per cell, at all times."""
    per = df.groupBy(*cell).agg(F.min(zone).alias("a"), F.max(zone).alias("b"))
    return per.agg(
        F.count("*").alias("cells"), F.count_if(F.col("a") != F.col("b")).alias("ambiguous"), F.count_if(F.col("a").isNull()).alias("empty")
    )


def require_same_grid(left: DataFrame, right: DataFrame, axes: Sequence[str], tolerance: float = 1e-8) -> DataFrame:
    """:func:`axis_mismatch`, failing the query where an axis differs."""
    found = axis_mismatch(left, right, axes, tolerance)
    broken = F.raise_error(F.concat(F.lit("grids differ along "), F.col("axis"))).cast("long")
    differs = (F.col("only_left") > 0) | (F.col("only_right") > 0)
    return found.withColumn("common", F.when(differs, broken).otherwise(F.col("common")))


def missing_months(spark: SparkSession, df: DataFrame, t: str, first: str, last: str) -> DataFrame:
    """Calendar months between the bounds without any row."""
    span = F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 month"))
    wanted = spark.range(1).select(F.explode(span).alias("month"))
    return wanted.join(df.select(F.col(t).alias("month")), "month", "left_anti")


def train_leakage(times: DataFrame, t: str, cutoff: str, expected: int | None = None) -> DataFrame:
    """Counts of what a training calendar must not have."""
    months = times.groupBy(F.trunc(t, "MM").alias("m")).agg(F.count("*").alias("n"))
    checks = months.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_times"),
        F.count_if(F.col("n") > 1).alias("duplicate_months"),
        F.count_if(F.col("m") > F.lit(cutoff).cast("date")).alias("after_cutoff"),
    )
    wrong = F.lit(False) if expected is None else F.col("n_times") != expected
    ok = (F.col("n_times") > 0) & (F.col("duplicate_months") == 0) & (F.col("after_cutoff") == 0) & ~wrong
    return checks.withColumn("ok", ok)


def provenance_report(attributes: DataFrame, cutoff: str, required: Sequence[str] = FIT_KEYS) -> DataFrame:
    """Per artefact: missing keys, whether the fit ends in time, and whether all share one source."""
    value = lambda k: F.max(F.when(F.col("key") == k, F.col("value")))
    per = attributes.groupBy("artefact").agg(
        (F.lit(len(required)) - F.count_distinct(F.when(F.col("key").isin(*required), F.col("key")))).alias("n_missing"),
        value("fit_end_effective").alias("_end"),
        value("consistency_source_sha256").alias("_hash"),
    )
    hashes = attributes.where("key = 'consistency_source_sha256'").agg(F.count_distinct("value").alias("n"))
    return per.select(
        "artefact",
        "n_missing",
        F.coalesce(F.col("_end").cast("date") <= F.lit(cutoff).cast("date"), F.lit(False)).alias("in_time"),
        (scalar(hashes) <= 1).alias("one_source"),
    )


def is_banned(*names: Column, tokens: Sequence[str] = BANNED_TOKENS) -> Column:
    text = F.lower(F.concat_ws(" ", *names))
    return F.exists(F.array(*[F.lit(t) for t in tokens]), lambda token: text.contains(token))


def baseline_complete(df: DataFrame, keys: Sequence[str], t: str, start: str, end: str, required: int) -> DataFrame:
    """Distinct baseline months per key and whether they are enough."""
    inside = F.col(t).between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return df.groupBy(*keys).agg(
        F.count_distinct(F.when(inside, F.col(t))).alias("n_months")
    ).withColumn("complete", F.col("n_months") >= required)
