"""Writing results: aside first, in place only when complete."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession

#: What Spark leaves in a folder whose write has ended well.
MARKER = "_SUCCESS"


def _store(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished result is there; a folder without marker is what a broken write left."""
    place, store = _store(spark, f"{path.rstrip('/')}/{MARKER}")
    return bool(store.exists(place))


def _staged(df: DataFrame, path: str, overwrite: bool, save: Callable[[DataFrameWriter, str], None]) -> bool:
    """Write to a folder beside the target and rename it; true if the result is the new one.

    A finished result is kept unless ``overwrite``.  If the write fails, what
    was there stays as it was.  The old folder steps aside for the rename and
    is deleted last; if the rename fails it comes back.  A folder takes two
    renames, so a reader may find no table between them, but never a part of
    one.  Stores that copy to rename are no faster for it.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    if exists(spark, path) and not overwrite:
        return False
    mark = uuid.uuid4().hex
    (target, store), (fresh, _), (old, _) = (_store(spark, path + end) for end in ("", f".new-{mark}", f".old-{mark}"))
    try:
        save(df.write.mode("errorifexists"), fresh.toString())
        if not exists(spark, fresh.toString()):
            raise OSError(f"the write to {fresh} left no {MARKER}")
        replaced = store.exists(target)
        if replaced and not store.rename(target, old):
            raise OSError(f"{target} could not be moved aside")
        if not store.rename(fresh, target):
            if replaced:
                store.rename(old, target)
            raise OSError(f"{fresh} could not be moved to {target}")
    finally:
        if store.exists(fresh):
            store.delete(fresh, True)
    if replaced:
        store.delete(old, True)
    return True


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), overwrite: bool = False, fmt: str = "parquet") -> bool:
    """Write a table as a whole or not at all; a finished one is kept unless ``overwrite``.

    ``df`` may read the very table it replaces.
    """

    def save(writer: DataFrameWriter, folder: str) -> None:
        (writer.partitionBy(*partition_by) if partition_by else writer).format(fmt).save(folder)

    return _staged(df, path, overwrite, save)


def write_report(df: DataFrame, path: str, fmt: str = "csv", overwrite: bool = True) -> bool:
    """Metrics as CSV with a header, or JSON lines; committed like a table."""

    def save(writer: DataFrameWriter, folder: str) -> None:
        if fmt == "csv":
            writer.option("header", True).csv(folder)
        else:
            writer.json(folder)

    return _staged(df, path, overwrite, save)
