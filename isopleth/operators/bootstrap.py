"""Cluster bootstrap with reproducible draws.

Draw ``k`` of replicate ``b`` is a hash of ``(seed, b, k)`` modulo the number
of units, so a recomputed task draws the same units.  Draws become
multiplicities before they meet the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isopleth.functions.stats import dense_index, exact_median, scalar, spearman
from isopleth.operators.masks import tertile_class, tertile_edges
from isopleth.session import pinned


def hashed_draw(seed: int, b: Column, k: Column, n: Column) -> Column:
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), b.cast("string"), k.cast("string")))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % n


def indexed_units(df: DataFrame, unit: str, keys: Sequence[str] = ()) -> DataFrame:
    """Units of each group with position ``idx`` and count ``n_units``."""
    index = dense_index(df, unit, keys)
    if keys:
        counts = index.groupBy(*keys).agg(F.count("*").alias("n_units"))
        return index.join(counts, list(keys))
    total = index.agg(F.count("*").alias("n"))
    return index.withColumn("n_units", total.scalar())


def multiplicities(units: DataFrame, keys: Sequence[str], replicates: int, seed: int) -> DataFrame:
    """How often each unit is drawn in each replicate: ``(keys, replicate, idx, copies)``."""
    b = F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))
    drawn = units.select(*keys, "n_units", F.col("idx").alias("_k"), b.alias("replicate"))
    return drawn.select(
        *keys, "replicate", hashed_draw(seed, F.col("replicate"), F.col("_k"), F.col("n_units")).alias("idx")
    ).groupBy(*keys, "replicate", "idx").agg(F.count("*").alias("copies"))


def interval(replicates: DataFrame, keys: Sequence[str], value: str = "stat") -> DataFrame:
    """2.5 % and 97.5 % points over the replicates (their number is fixed)."""
    return replicates.groupBy(*keys).agg(
        F.percentile(value, F.lit(0.025)).alias("lower"), F.percentile(value, F.lit(0.975)).alias("upper")
    )


def cluster_statistics(values: DataFrame, series: Sequence[str], unit: str, replicates: int, seed: int,
                       group: str | None = None) -> DataFrame:
    """Median and share above zero of one value per unit, with intervals.

    ``values`` has one row per series and unit; the grid bounds the number of
    units.  With ``group`` whole groups of units are resampled.  Intervals are
    NULL with fewer than two drawn units.
    """
    series = list(series)
    drawn_by = group or unit
    units = indexed_units(values, drawn_by)
    draws = multiplicities(units, [], replicates, seed)
    placed = values.join(units.select(drawn_by, "idx", "n_units"), drawn_by)
    per = placed.join(draws, "idx").groupBy(*series, "replicate").agg(
        F.percentile("value", F.lit(0.5), F.col("copies")).alias("median"),
        (F.sum(F.when(F.col("value") > 0, F.col("copies")).otherwise(0)) / F.sum("copies")).alias("share"),
    )
    base = placed.groupBy(*series).agg(
        F.percentile("value", F.lit(0.5)).alias("median"),
        F.avg((F.col("value") > 0).cast("double")).alias("share"),
        F.count("*").alias("n_values"),
        F.max("n_units").alias("n_units"),
    )
    out = base
    for stat in ("median", "share"):
        ci = interval(per, series, stat)
        out = out.join(
            ci.select(*series, F.col("lower").alias(f"{stat}_lower"), F.col("upper").alias(f"{stat}_upper")), series
        )
    two = F.col("n_units") >= 2
    return out.withColumns(
        {f"{s}_{e}": F.when(two, F.col(f"{s}_{e}")) for s in ("median", "share") for e in ("lower", "upper")}
    )


#: Value ranges that replicates are first counted in.
COARSE = 64


def replicate_medians(values: DataFrame, draws: DataFrame, keys: Sequence[str], bins: int = COARSE) -> DataFrame:
    """Exact median of each replicate when a unit may hold very many values.

    ``values``: keys, idx, value; ``draws``: keys, replicate, idx, copies.  A
    unit is one row with its counts in ``bins`` value ranges; a replicate adds
    these up, which shows in which range its middle lies, and only the values
    of that range are looked at one by one.  Drawn rows are units, not values.
    """
    keys = list(keys)
    counts = values.groupBy(*keys, "idx", "value").agg(F.count("*").alias("_c"))
    probs = [i / bins for i in range(1, bins)]
    edges = values.groupBy(*keys).agg(F.percentile_approx("value", probs, 10 * bins).alias("_e"))
    joined = counts.join(edges, keys) if keys else counts.withColumn("_e", edges.scalar())
    # Written: the edges are approximate, so every use has to see the same ones.
    place = F.aggregate("_e", F.lit(0), lambda a, e: a + F.when(F.col("value") > e, 1).otherwise(0))
    binned = pinned(joined.select(*keys, "idx", "value", "_c", place.alias("_b")))
    in_bin = lambda i: F.sum(F.when(F.col("_b") == i, F.col("_c")).otherwise(0))
    per_unit = binned.groupBy(*keys, "idx").agg(*[in_bin(i).alias(f"_n{i}") for i in range(bins)])
    drawn = per_unit.join(draws, [*keys, "idx"])
    totals = drawn.groupBy(*keys, "replicate").agg(
        F.array(*[F.sum(F.col(f"_n{i}") * F.col("copies")) for i in range(bins)]).alias("_m")
    )
    n = F.aggregate("_m", F.lit(0).cast("long"), lambda a, x: a + x)
    before = F.aggregate(
        "_m",
        F.array(F.lit(0).cast("long")),
        lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)),
    )
    placed = totals.select(*keys, "replicate", n.alias("_n"), before.alias("_cum")).withColumns(
        {"_l": F.floor((F.col("_n") - 1) / 2), "_h": F.ceil((F.col("_n") - 1) / 2)}
    )
    middle = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.struct(i.alias("b"), F.get("_cum", i).alias("s"), F.get("_cum", i + 1).alias("e"))),
        lambda x: ((x["s"] <= F.col("_l")) & (F.col("_l") < x["e"])) | ((x["s"] <= F.col("_h")) & (F.col("_h") < x["e"])),
    )
    wanted = placed.select(*keys, "replicate", F.explode(middle).alias("_x"), "_l", "_h").select(
        *keys, "replicate", F.col("_x.b").alias("_b"), F.col("_x.s").alias("_start"), "_l", "_h"
    )
    rows = (
        draws.join(wanted, [*keys, "replicate"])
        .join(binned, [*keys, "idx", "_b"])
        .groupBy(*keys, "replicate", "_b", "_start", "_l", "_h", "value")
        .agg(F.sum(F.col("_c") * F.col("copies")).alias("_m"))
    )
    inner = Window.partitionBy(*keys, "replicate", "_b").orderBy("value").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    ranked = rows.withColumn("_e", F.col("_start") + F.sum("_m").over(inner)).withColumn("_s", F.col("_e") - F.col("_m"))
    at = lambda r: F.max(F.when((F.col("_s") <= F.col(r)) & (F.col(r) < F.col("_e")), F.col("value")))
    return ranked.groupBy(*keys, "replicate").agg(((at("_l") + at("_h")) / 2).alias("stat"))


def paired_blocks(df: DataFrame, keys: Sequence[str], a: str, b: str, block: str, replicates: int, seed: int) -> DataFrame:
    """Median of ``a - b`` with an interval from resampling whole blocks with all their cells."""
    keys = list(keys)
    diffs = df.withColumn("value", F.col(a) - F.col(b)).where(F.col("value").isNotNull()).select(*keys, block, "value")
    units = indexed_units(diffs, block, keys)
    draws = multiplicities(units, keys, replicates, seed)
    placed = diffs.join(units, [*keys, block])
    base = placed.groupBy(*keys).agg(
        F.count("*").alias("n_grid"),
        F.max("n_units").alias("n_blocks"),
        F.avg((F.col("value") > 0).cast("double")).alias("positive_fraction"),
        F.avg((F.col("value") < 0).cast("double")).alias("negative_fraction"),
    )
    ci = interval(replicate_medians(placed.select(*keys, "idx", "value"), draws, keys), keys)
    out = base.join(exact_median(diffs, keys, "value", "median"), keys).join(ci, keys)
    two = F.col("n_blocks") >= 2
    return out.withColumns({"lower": F.when(two, F.col("lower")), "upper": F.when(two, F.col("upper"))})


def cell_median(values: DataFrame, keys: Sequence[str], cell: str, value: str, replicates: int, seed: int) -> DataFrame:
    """Median over cells with an interval from independent resampling; one cell gives no interval."""
    rows = values.where(F.col(value).isNotNull()).select(*keys, cell, F.col(value).alias("_v"), F.lit(0.0).alias("_z"))
    return paired_blocks(rows, keys, "_v", "_z", cell, replicates, seed).select(
        *keys, F.col("n_grid").alias("n_cells"), "median", "lower", "upper"
    )


def weighted_spearman(df: DataFrame, group: str, x: str, y: str, weight: str) -> DataFrame:
    """Rank correlation per replicate where each row counts ``weight`` times.

    A replicate has as many rows as there are pairs, which the blocks bound.
    """

    def ranked(value: str, out: str) -> DataFrame:
        ties = df.groupBy(group, value).agg(F.sum(weight).alias("_w"))
        run = Window.partitionBy(group).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        return ties.select(
            group, value, (F.coalesce(F.sum("_w").over(run), F.lit(0)) + (F.col("_w") + 1) / 2.0).alias(out)
        )

    rows = df.join(ranked(x, "_rx"), [group, x]).join(ranked(y, "_ry"), [group, y])
    w, rx, ry = F.col(weight), F.col("_rx"), F.col("_ry")
    means = rows.groupBy(group).agg(
        (F.sum(w * rx) / F.sum(w)).alias("_mx"), (F.sum(w * ry) / F.sum(w)).alias("_my")
    )
    dx, dy = rx - F.col("_mx"), ry - F.col("_my")
    return rows.join(means, group).groupBy(group).agg(
        F.try_divide(F.sum(w * dx * dy), F.sqrt(F.sum(w * dx * dx) * F.sum(w * dy * dy))).alias("stat")
    )


def association(pairs: DataFrame, block: str, x: str, y: str, replicates: int, seed: int, min_blocks: int = 10) -> DataFrame:
    """Rank correlation of x and y and medians of y per tertile of x, blocks resampled.

    Refuses (NULL estimates, a status) with too few blocks, fewer than three
    distinct x, or equal tertile edges.
    """
    rows = pinned(pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(block, x, y))
    edges = tertile_edges(rows, x)
    classed = rows.withColumn("_e", scalar(edges.select(F.struct("e0", "e1").alias("s")))).withColumn(
        "tertile", tertile_class(x, F.col("_e"))
    ).drop("_e")
    units = indexed_units(rows, block)
    drawn = classed.join(units, block).join(multiplicities(units, [], replicates, seed), "idx")
    names = F.array(F.lit("low"), F.lit("middle"), F.lit("high"))
    rho = interval(weighted_spearman(drawn, "replicate", x, y, "copies"), []).withColumn("statistic", F.lit("spearman"))
    medians = drawn.groupBy("tertile", "replicate").agg(F.percentile(y, F.lit(0.5), F.col("copies")).alias("stat"))
    bands = interval(medians, ["tertile"]).select(names[F.col("tertile")].alias("statistic"), "lower", "upper")
    point = spearman(rows, [], x, y, "estimate").select(F.lit("spearman").alias("statistic"), "estimate", "n")
    counts = classed.groupBy("tertile").agg(F.count("*").alias("n"))
    bins = exact_median(classed, ["tertile"], y, "estimate").join(counts, "tertile").select(
        names[F.col("tertile")].alias("statistic"), "estimate", "n"
    )
    checks = rows.agg(F.count_distinct(block).alias("blocks"), F.count_distinct(x).alias("levels")).select(
        F.struct("blocks", "levels").alias("s")
    )
    tied = edges.select(F.col("e0") == F.col("e1"))
    status = (
        F.when((F.col("_c.blocks") < min_blocks) | (F.col("_c.levels") < 3), "insufficient support")
        .when(scalar(tied), "tied tertile edges")
        .otherwise("exploratory")
    )
    out = point.unionByName(bins).join(rho.unionByName(bands), "statistic", "left").withColumn("_c", scalar(checks))
    out = out.withColumn("status", status).withColumn("n_blocks", F.col("_c.blocks")).drop("_c")
    fine = F.col("status") == "exploratory"
    return out.withColumns({c: F.when(fine, F.col(c)) for c in ("estimate", "lower", "upper")})
