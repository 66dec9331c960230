"""Forward differences between adjacent cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def forward_difference(df: DataFrame, keys: Sequence[str], values: Sequence[str], valid: Column | None = None,
                       keep: Sequence[str] = ()) -> DataFrame:
    """Adds ``<v>_dx`` and ``<v>_dy``: next cell minus this one, NULL unless both exist.

    Each cell is also sent to its left and lower neighbour and the three are
    merged by one aggregation, so there is one shuffle instead of two self
    joins and a gap in the grid is never bridged.  ``keep`` columns get their
    own value plus ``<c>_x`` and ``<c>_y`` from the neighbours.
    """
    rows = df if valid is None else df.where(valid)
    payload = [*values, *keep]
    places = F.array(
        F.struct(F.lit(0).alias("role"), F.col("iy").alias("iy"), F.col("ix").alias("ix")),
        F.struct(F.lit(1).alias("role"), F.col("iy").alias("iy"), (F.col("ix") - 1).alias("ix")),
        F.struct(F.lit(2).alias("role"), (F.col("iy") - 1).alias("iy"), F.col("ix").alias("ix")),
    )
    sent = rows.select(*keys, *payload, F.explode(places).alias("p"))

    def of(role: int, name: str) -> Column:
        return F.max(F.when(F.col("p.role") == role, F.col(name)))

    merged = sent.groupBy(*keys, F.col("p.iy").alias("iy"), F.col("p.ix").alias("ix")).agg(
        F.max(F.col("p.role") == 0).alias("_own"),
        *[of(r, v).alias(f"_{v}_{r}") for v in payload for r in (0, 1, 2)],
    )
    out: list[Column | str] = [*keys, "iy", "ix"]
    for v in values:
        own = F.col(f"_{v}_0")
        out += [own.alias(v), (F.col(f"_{v}_1") - own).alias(f"{v}_dx"), (F.col(f"_{v}_2") - own).alias(f"{v}_dy")]
    for c in keep:
        out += [F.col(f"_{c}_0").alias(c), F.col(f"_{c}_1").alias(f"{c}_x"), F.col(f"_{c}_2").alias(f"{c}_y")]
    return merged.where("_own").select(*out)


def gradient_mae(diffs: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Mean of the x and y mean absolute gradient differences (one side alone if the other is empty)."""
    x = F.avg(F.abs(F.col(f"{a}_dx") - F.col(f"{b}_dx")))
    y = F.avg(F.abs(F.col(f"{a}_dy") - F.col(f"{b}_dy")))
    both = diffs.groupBy(*keys).agg(x.alias("_x"), y.alias("_y"))
    return both.select(
        *keys, F.coalesce((F.col("_x") + F.col("_y")) / 2, F.col("_x"), F.col("_y")).alias("gradient_mae")
    )
