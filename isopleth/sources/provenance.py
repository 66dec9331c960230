"""Inventories, hashes and comparisons of two versions of a result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isopleth.sources import stores

def file_manifest(spark: SparkSession, path: str, pattern: str = "*", chunk: int = stores.CHUNK) -> DataFrame:
    """Path below the folder, bytes and SHA-256 of every file, of whatever size.

    Files are dealt to tasks and read there chunk by chunk; a file is never
    held as a whole.
    """
    made = stores.digests(stores.listed(spark, path, pattern), chunk)
    return made.select(stores.below(spark, path).alias("path"), "bytes", "sha256")


def folder_digest(files: DataFrame) -> DataFrame:
    """``sha256, n_files``: one hash of all names and sizes, in the order of the path's parts.

    ``files``: path below the folder, bytes; no content is needed.  The names
    of each sub-folder are merged on their own first; the sub-folders then
    follow each other as their names do, which is the order of all paths.  An
    empty folder has the hash of nothing.
    """
    parts = F.split("path", "/")
    entry = F.struct(parts.alias("parts"), F.concat("path", F.col("bytes").cast("string")).alias("said"))
    merged = files.groupBy(parts[0].alias("top")).agg(F.array_sort(F.collect_list(entry)).alias("entries"), F.count("*").alias("n"))
    said = merged.select("top", F.array_join("entries.said", "").alias("said"), "n")
    all_said = F.array_sort(F.collect_list(F.struct("top", "said")))
    return said.agg(F.sha2(F.array_join(all_said["said"], ""), 256).alias("sha256"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_files"))


def inventory_faults(inventory: DataFrame, present: DataFrame) -> DataFrame:
    """Inventory rows that are missing, have another size, or another hash."""
    found = present.select("path", F.col("bytes").alias("_bytes"), F.col("sha256").alias("_hash"))
    fault = (
        F.when(F.col("_bytes").isNull(), "missing")
        .when(F.col("_bytes") != F.col("bytes"), "size")
        .when(F.col("_hash") != F.col("sha256"), "hash")
    )
    return inventory.join(found, "path", "left").withColumn("fault", fault).where("fault IS NOT NULL").drop("_bytes", "_hash")


def upsert(inventory: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Replace or add records by key; new columns are NULL in old rows."""
    kept = inventory.join(records.select(key), key, "left_anti")
    return kept.unionByName(records, allowMissingColumns=True)


def extent(df: DataFrame, keys: Sequence[str], lat: Column, lon: Column) -> DataFrame:
    """First and last month and mean coordinate step per field.

    The mean step is the range over the number of steps between distinct
    values, so only bounds and distinct counts travel.
    """

    def step(name: str) -> Column:
        return F.round(F.try_divide(F.max(name) - F.min(name), F.count_distinct(name) - 1), 6)

    placed = df.select(*keys, "t", lat.alias("_lat"), lon.alias("_lon"))
    return placed.groupBy(*keys).agg(
        F.concat_ws(" to ", F.date_format(F.min("t"), "yyyy-MM"), F.date_format(F.max("t"), "yyyy-MM")).alias("time_range"),
        step("_lat").alias("lat_step"),
        step("_lon").alias("lon_step"),
    )


def reproduction(old: DataFrame, new: DataFrame, keys: Sequence[str], values: Sequence[str],
                 tolerance: float = 2e-6) -> DataFrame:
    """Largest difference and equality of gaps for each value; ``ok`` if both are fine."""
    keys = list(keys)
    a = old.select(*keys, *[F.col(v).alias(f"_o_{v}") for v in values])
    b = new.select(*keys, *[F.col(v).alias(f"_n_{v}") for v in values])
    aggs = []
    for v in values:
        o, n = F.col(f"_o_{v}"), F.col(f"_n_{v}")
        aggs += [F.max(F.abs(n - o)).alias(f"d_{v}"), F.bool_and(n.isNull() == o.isNull()).alias(f"m_{v}")]
    one = a.join(b, keys, "full").agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(v).alias("value"),
                F.col(f"d_{v}").alias("max_difference"),
                F.col(f"m_{v}").alias("identical_gaps"),
            )
            for v in values
        ]
    )
    return one.select(F.explode(rows).alias("r")).select("r.*").withColumn(
        "ok", F.col("identical_gaps") & (F.coalesce("max_difference", F.lit(0.0)) <= tolerance)
    )


def metric_recheck(first: DataFrame, second: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Rows compared and the largest difference of each metric."""
    keys = list(keys)
    joined = first.select(*keys, *values).join(
        second.select(*keys, *[F.col(v).alias(f"_{v}") for v in values]), keys
    )
    return joined.agg(
        F.count("*").alias("n_rows"), *[F.max(F.abs(F.col(v) - F.col(f"_{v}"))).alias(f"max_{v}") for v in values]
    )


def tables_equal(first: DataFrame, second: DataFrame, keys: Sequence[str], values: Sequence[str], rtol: float,
                 atol: float) -> DataFrame:
    """Keys on one side only, and values further apart than ``atol + rtol*|second|``."""
    keys = list(keys)
    a = first.select(*keys, *values, F.lit(True).alias("_a"))
    b = second.select(*keys, *[F.col(v).alias(f"_{v}") for v in values], F.lit(True).alias("_b"))
    far = F.lit(False)
    for v in values:
        gap = F.abs(F.col(v) - F.col(f"_{v}")) > atol + rtol * F.abs(F.col(f"_{v}"))
        far = far | F.coalesce(gap, F.col(v).isNull() != F.col(f"_{v}").isNull())
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return a.join(b, keys, "full").agg(
        F.count_if(both).alias("matched"),
        F.count_if(F.col("_b").isNull()).alias("only_first"),
        F.count_if(F.col("_a").isNull()).alias("only_second"),
        F.count_if(both & far).alias("differing"),
    )
