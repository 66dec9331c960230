"""Point observations: quality control, gridding and skill at stations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isopleth.functions import units
from isopleth.functions.stats import bounded_median, exact_median, pearson, ratio, slope
from isopleth.functions.time import month_number
from isopleth.grid import Grid

# Qualifiers that make a water-level reading unusable, and the
# parameter code of depth to water level.
AFFECTED = (
    "Pumping",
    "NoMeasurement",
    "Dry",
    "Obstructed",
    "GWSWAffected",
    "ForeignSubstance",
    "Flowing",
    "Above",
    "Below",
    "Frozen",
    "GWTideAffected",
)
DEPTH_PARAMETER = "72019"


def first_record(df: DataFrame, key: str, order: Sequence[str] = ()) -> DataFrame:
    """One record per key: the first in ``order`` (then in all columns, so reruns agree)."""
    rest = [c for c in df.columns if c != key and c not in order]
    return df.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("_r")).select(
        *[F.col(c) if c == key else F.col(f"_r.{c}").alias(c) for c in df.columns]
    )


def qc_filter(raw: DataFrame, start: str, end: str, order: Sequence[str] = ()) -> DataFrame:
    """Adds ``reason`` (first rule broken, or ``kept``) and ``storage``, the negated depth in metres."""
    q = F.coalesce("qualifiers", F.array().cast("array<string>"))
    storage = units.depth_to_storage("value", "unit", strict=True)
    day = F.col("ts").cast("date")
    known_unit = F.col("unit").isin("ft", "m")
    in_time = day.between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    number = F.col("value").isNotNull() & ~F.isnan("value")
    reason = (
        F.when(~F.coalesce(F.col("parameter") == DEPTH_PARAMETER, F.lit(False)), "parameter")
        .when(~F.coalesce(F.col("status") == "Approved", F.lit(False)), "not_approved")
        .when(~F.array_contains(q, "Static"), "not_explicitly_static")
        .when(F.arrays_overlap(q, F.array(*[F.lit(a) for a in AFFECTED])), "affected_or_censored")
        .when(~F.coalesce(known_unit, F.lit(False)), "unit")
        .when(~F.coalesce(number & in_time, F.lit(False)), "invalid")
        .otherwise("kept")
    )
    return first_record(raw, "id", order).withColumns({"reason": reason, "storage": storage})


def reject_counts(qc: DataFrame) -> DataFrame:
    """Records by first reason and by qualifier."""
    by_reason = qc.groupBy(F.lit("reason").alias("kind"), F.col("reason").alias("name")).agg(F.count("*").alias("n"))
    by_flag = (
        qc.select(F.explode("qualifiers").alias("name"))
        .groupBy(F.lit("qualifier").alias("kind"), "name")
        .agg(F.count("*").alias("n"))
    )
    return by_reason.unionByName(by_flag)


def retained_counts(periods: DataFrame, thresholds: Sequence[int]) -> DataFrame:
    per_site = periods.groupBy("site").agg(F.count("*").alias("n"), F.sum("n_records").alias("r"))
    return per_site.agg(
        F.sum("r").alias("retained_records"),
        F.count("*").alias("retained_sites"),
        *[F.count_if(F.col("n") >= k).alias(f"sites_at_least_{k}") for k in thresholds],
    )


def station_period(kept: DataFrame, period: Column, how: str = "median", value: str = "storage") -> DataFrame:
    """Site value per period.  A site-period may hold very many records, so the median is distributed.

    The coordinates of one site take few distinct values, which is all the
    built-in median keeps.
    """
    rows = kept.withColumn("t", period)
    base = rows.groupBy("site", "t").agg(
        bounded_median("lat").alias("lat"),
        bounded_median("lon").alias("lon"),
        F.count("*").alias("n_records"),
        *([F.avg(value).alias("value")] if how == "mean" else []),
    )
    if how == "mean":
        return base
    return base.join(exact_median(rows, ["site", "t"], value, "value"), ["site", "t"])


def eligibility(periods: DataFrame, cells: DataFrame, grid: Grid, min_periods: int) -> DataFrame:
    """Per site: coordinates, count, deviation, nearest cell and whether it may be used."""
    sites = periods.groupBy("site").agg(
        bounded_median("lat").alias("lat"),
        bounded_median("lon").alias("lon"),
        F.count("value").alias("n_periods"),
        F.stddev_pop("value").alias("sd"),
        F.avg("value").alias("site_mean"),
    ).withColumns({"iy": grid.nearest_iy("lat"), "ix": grid.nearest_ix("lon")})
    inside = (F.abs(F.col("lat") - grid.lat()) <= grid.dlat / 2) & (F.abs(F.col("lon") - grid.lon()) <= grid.dlon / 2)
    placed = grid.attach(sites, cells.select("iy", "ix", "land"), "left")
    return placed.withColumns(
        {
            "block": grid.block_id(),
            "land": F.coalesce("land", F.lit(False)),
            "inside_cell": inside,
        }
    ).withColumn(
        "eligible", (F.col("n_periods") >= min_periods) & (F.col("sd") > 0) & F.col("land") & F.col("inside_cell")
    )


def standardize(periods: DataFrame, sites: DataFrame) -> DataFrame:
    """Z-scores of the eligible sites, with their cell and block."""
    keep = sites.where("eligible").select("site", "iy", "ix", "block", "site_mean", "sd")
    return periods.select("site", "t", "value").join(keep, "site").select(
        "site", "t", "iy", "ix", "block", ((F.col("value") - F.col("site_mean")) / F.col("sd")).alias("z")
    )


def grid_median(z: DataFrame) -> DataFrame:
    """Median z per cell and period, with the sites that contribute."""
    keys = ["block", "iy", "ix", "t"]
    n = z.groupBy(*keys).agg(F.count("*").alias("n_sites"))
    return n.join(exact_median(z, keys, "z", "obs"), keys)


def dense_calendar(series: DataFrame, sites: DataFrame, first: str, last: str, step: str = "1 month") -> DataFrame:
    """Every (cell, period): NULL value and zero count where nothing was observed."""
    totals = sites.where("eligible").groupBy("block", "iy", "ix").agg(F.count("*").alias("n_total"))
    span = F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr(f"interval {step}"))
    dense = totals.withColumn("t", F.explode(span))
    return dense.join(series, ["block", "iy", "ix", "t"], "left").withColumn(
        "n_sites", F.coalesce("n_sites", F.lit(0))
    )


def first_differences(df: DataFrame, keys: Sequence[str], columns: Sequence[str], number: Column) -> DataFrame:
    """Adds ``d_<column>``: change since the previous row, only where that row is the adjacent period."""
    run = Window.partitionBy(*keys).orderBy(number)
    adjacent = (number - F.lag(number).over(run)) == 1
    return df.withColumns({f"d_{c}": F.when(adjacent, F.col(c) - F.lag(c).over(run)) for c in columns})


def first_difference_corr(df: DataFrame, keys: Sequence[str], x: str, y: str, number: Column | None = None) -> DataFrame:
    """Correlation of adjacent-period changes; needs four joint rows and three changes."""
    joint = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    diffs = first_differences(joint, keys, [x, y], month_number("t") if number is None else number)
    return diffs.groupBy(*keys).agg(
        F.when(F.count("*") >= 4, pearson(f"d_{x}", f"d_{y}")).alias("first_difference_r"), F.count("*").alias("n")
    )


def site_skill(joined: DataFrame, keys: Sequence[str], model: str, observed: str, min_overlap: int,
               number: Column | None = None, per_year: float = 12.0) -> DataFrame:
    """Skill of standardised series per site and source."""
    number = month_number("t") if number is None else number
    rows = joined.where(F.col(model).isNotNull() & F.col(observed).isNotNull())
    over = Window.partitionBy(*keys)
    z = rows.withColumns(
        {
            "_n": F.count("*").over(over),
            "_m": ratio(F.col(model) - F.avg(model).over(over), F.stddev_pop(model).over(over)),
            "_o": ratio(F.col(observed) - F.avg(observed).over(over), F.stddev_pop(observed).over(over)),
        }
    ).where(F.col("_n") >= min_overlap)
    diffs = first_differences(z, keys, ["_m", "_o"], number)
    out = diffs.groupBy(*keys).agg(
        F.count("*").alias("n_overlap"),
        pearson("_m", "_o").alias("pearson_r"),
        F.when(F.count("*") >= 4, pearson("d__m", "d__o")).alias("first_difference_r"),
        (slope(F.col("_m"), number) * per_year).alias("model_trend"),
        (slope(F.col("_o"), number) * per_year).alias("site_trend"),
    )
    same = F.signum("model_trend") == F.signum("site_trend")
    return out.withColumn("trend_sign_match", F.coalesce(same, F.lit(False)).cast("int"))


def cell_medians(skill: DataFrame, keys: Sequence[str], cell: str = "cell") -> DataFrame:
    """Cell medians of the site correlations and mean sign match; a cell may hold many sites."""
    group = [*keys, cell]
    base = skill.groupBy(*group).agg(F.avg("trend_sign_match").alias("trend_sign_match"))
    for c in ("pearson_r", "first_difference_r"):
        base = base.join(exact_median(skill, group, c, c), group, "left")
    return base


def region_summary(skill: DataFrame, cell: str = "cell") -> DataFrame:
    """Wells, cells and medians per region and source, and over all regions.

    One pass with grouping sets for the counts; the medians of the expanded
    groups are distributed.
    """
    sites = skill.groupingSets(
        [["region", "source"], ["source"]], "region", "source"
    ).agg(F.count_distinct("site").alias("n_sites")).withColumn("region", F.coalesce("region", F.lit("ALL")))
    expanded = skill.withColumn("region", F.explode(F.array(F.col("region"), F.lit("ALL"))))
    cells = cell_medians(expanded, ["region", "source"], cell)
    keys = ["region", "source"]
    out = sites.join(
        cells.groupBy(*keys).agg(
            F.count("*").alias("n_cells"), F.avg("trend_sign_match").alias("mean_sign_match")
        ),
        keys,
    )
    for c, name in (("pearson_r", "median_pearson_r"), ("first_difference_r", "median_first_difference_r")):
        out = out.join(exact_median(cells, keys, c, name), keys, "left")
    return out


def separated(model: Column, prior_total: Column, prior_part: Column) -> Column:
    """Model storage minus everything of the prior that is not the wanted part."""
    return model - (prior_total - prior_part)


def half_day_mean(am: str, am_flag: str, pm: str, pm_flag: str) -> Column:
    """Mean of the two daily retrievals that are in [0, 1] with flag 0."""

    def good(v: str, flag: str) -> Column:
        return F.when(F.col(v).between(0.0, 1.0) & (F.col(flag) == 0), F.col(v))

    a, p = good(am, am_flag), good(pm, pm_flag)
    return F.coalesce((a + p) / 2, a, p)


def gnss_months(daily: DataFrame, max_sigma: float = 0.020, min_days: int = 15) -> DataFrame:
    """Monthly median height in mm of stations, loading removed; months with enough days.

    ``daily``: station, mjd, t, up, sigma, load_a, load_o (metres).  A month of
    one station has at most 31 days, so its median is bounded.
    """
    needed = ["mjd", "up", "sigma", "load_a", "load_o"]
    good = daily.dropna(subset=needed).where(
        (F.col("sigma") > 0) & (F.col("sigma") <= max_sigma)
    )
    order = F.struct("up", "sigma", "load_a", "load_o")
    once = good.groupBy("station", "mjd", "t").agg(F.min(order).alias("r"))
    height = (F.col("r.up") - F.col("r.load_a") - F.col("r.load_o")) * 1000
    return (
        once.groupBy("station", F.trunc("t", "MM").alias("month"))
        .agg(bounded_median(height).alias("up_mm"), F.count("*").alias("days"))
        .where(F.col("days") >= min_days)
    )


def gnss_eligibility(stations: DataFrame, months: DataFrame, steps: DataFrame, min_months: int) -> DataFrame:
    """Why each station is left out, or an empty reason.

    ``stations``: station, failed, known_schema; ``steps``: station, t.
    """
    counts = months.groupBy("station").agg(F.count("*").alias("valid_months"))
    listed = steps.where(F.col("t").isNotNull()).groupBy("station").agg(F.count_distinct("t").alias("n_steps"))
    joined = stations.join(counts, "station", "left").join(listed, "station", "left").withColumns(
        {"valid_months": F.coalesce("valid_months", F.lit(0)), "n_steps": F.coalesce("n_steps", F.lit(0))}
    )
    reason = (
        F.when(F.col("failed"), "download_failed")
        .when(~F.col("known_schema"), "unknown_schema")
        .when(F.col("n_steps") > 0, "listed_test_step")
        .when(F.col("valid_months") < min_months, "insufficient_months")
        .otherwise("")
    )
    return joined.withColumn("exclude", reason).withColumn("eligible", F.col("exclude") == "")
