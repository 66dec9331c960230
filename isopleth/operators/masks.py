"""Validity masks, common support, strata and quantile classes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isopleth.functions.stats import col, exact_quantiles, scalar


def valid_cells(fields: Sequence[str], capped: str, cap: float, land: str) -> Column:
    """All fields present, the capped one within its limit, and on land."""
    ok = F.col(land).cast("boolean") & (F.abs(F.col(capped)) <= cap)
    for name in fields:
        ok = ok & F.col(name).isNotNull()
    return F.coalesce(ok, F.lit(False))


def zero_filled(value: Column | str, mask: Column | str) -> Column:
    """The value where the mask holds, else 0."""
    return F.when(col(mask), F.coalesce(col(value), F.lit(0.0))).otherwise(0.0)


def common_support(df: DataFrame, keys: Sequence[str], member: Sequence[str], value: str, expected: int) -> DataFrame:
    """Keys at which every one of ``expected`` members (models, variants) has a value."""
    present = df.where(F.col(value).isNotNull())
    return (
        present.groupBy(*keys)
        .agg(F.count_distinct(*[F.col(m) for m in member]).alias("_n"))
        .where(F.col("_n") == expected)
        .drop("_n")
    )


def on_support(df: DataFrame, support: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(support, list(keys), "left_semi")


def external_evaluation(land: str = "land", glacier: str = "glacier", human: str = "human",
                        max_glacier: float = 0.05, max_human: float = 0.5) -> Column:
    return F.col(land).cast("boolean") & (F.col(glacier) <= max_glacier) & (F.col(human) <= max_human)


def named_regions(land: str = "land", aridity: str = "aridity", glacier: str = "glacier",
                  human: str = "human") -> dict[str, Column]:
    """Nine overlapping strata of land cells.  Fixed values: the names and cut-offs."""
    on, arid, ice, man = F.col(land).cast("boolean"), F.col(aridity), F.col(glacier), F.col(human)
    return {
        "global_land": on,
        "arid": on & (arid >= 0.5),
        "humid": on & (arid <= 0.1),
        "glacier_influenced": on & (ice >= 0.01),
        "non_glacier": on & (ice < 0.001),
        "high_human_activity": on & (man >= 0.05),
        "low_human_activity": on & (man <= 0.001),
        "arid_glacier": on & (arid >= 0.5) & (ice >= 0.01),
        "arid_human": on & (arid >= 0.5) & (man >= 0.05),
    }


def explode_strata(df: DataFrame, strata: Mapping[str, Column], out: str = "region") -> DataFrame:
    """One row per stratum a row belongs to."""
    flags = F.array(*[F.struct(F.lit(n).alias("n"), c.alias("c")) for n, c in strata.items()])
    member = F.transform(F.filter(flags, lambda s: s["c"]), lambda s: s["n"])
    return df.withColumn(out, F.explode(member))


def tertile_edges(df: DataFrame, value: str, where: Column | None = None) -> DataFrame:
    """One row ``(e0, e1)``: linear quantiles 1/3 and 2/3 of the present values."""
    rows = df if where is None else df.where(where)
    return exact_quantiles(rows, [], value, {"e0": 1 / 3, "e1": 2 / 3})


def tertile_class(value: Column | str, edges: Column) -> Column:
    """Class 0, 1 or 2; a value equal to an edge goes to the lower class."""
    v = col(value)
    return (v > edges["e0"]).cast("int") + (v > edges["e1"]).cast("int")


def with_tertile(df: DataFrame, value: str, out: str, where: Column | None = None) -> DataFrame:
    edges = tertile_edges(df, value, where).select(F.struct("e0", "e1").alias("s"))
    return df.withColumn("_e", scalar(edges)).withColumn(out, tertile_class(value, F.col("_e"))).drop("_e")
