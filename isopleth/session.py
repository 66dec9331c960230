"""Session settings the operators rely on, and lineage cuts."""

from __future__ import annotations

import uuid
from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession
from pyspark.storagelevel import StorageLevel

#: Settings that matter for results (time zone) or for skewed inputs (AQE).
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

#: What :func:`pinned` and :func:`scratch` made, for :func:`release`.
_FOLDERS: list[str] = []
_CACHED: list[DataFrame] = []


def build(app: str = "isopleth", master: str | None = None, **extra: str) -> SparkSession:
    """A session with :data:`SETTINGS`; the cluster manager chooses the rest."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def configured_folder(spark: SparkSession) -> str | None:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``, if it names one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return named.rstrip("/") if named else None


def shared_folder(spark: SparkSession) -> str:
    """A folder that all executors can reach: the configured one, else one below the warehouse.

    Without a configured folder a ``file:`` warehouse is shared only if driver
    and executors are one process; on any other master it is refused.
    """
    named = configured_folder(spark)
    if named is None:
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        local = spark.sparkContext.master.split("[")[0] == "local"
        if (named.startswith("file:") or "://" not in named) and not local:
            raise ValueError("executors cannot share a local folder: set spark.checkpoint.dir")
    return named


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed by :func:`release`."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _FOLDERS.append(path)
    return path


def small_batches(spark: SparkSession, most: str = "4m") -> None:
    """Batches to Python workers of at most ``most`` bytes, so that long rows do not fill a worker.

    A setting of the session's own stays; Spark's default is 64 MB.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) in ("67108864b", "67108864", "64m"):
        spark.conf.set(name, most)


def written(df: DataFrame) -> DataFrame:
    """A result written to the shared folder and read back, which also cuts the lineage of loops."""
    path = scratch(df.sparkSession, "pinned")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pinned(df: DataFrame) -> DataFrame:
    """A result that several later plans read, computed once.

    With a configured shared folder it is written there and read back, so it
    outlives any one executor and later plans see its size and read only the
    columns they need.  Without one it is cached, and recomputed if lost.
    """
    spark = df.sparkSession
    if configured_folder(spark) is None:
        _CACHED.append(kept := df.persist(StorageLevel.MEMORY_AND_DISK))
        return kept
    return written(df)


def made() -> int:
    """How many folders there are so far, for :func:`release` to begin from."""
    return len(_FOLDERS)


def release(spark: SparkSession, since: int = 0, keep: Collection[str] = ()) -> None:
    """Forget cached results and delete the folders made ``since`` but for those to ``keep``.

    Nothing built on them works afterwards.
    """
    while _CACHED:
        _CACHED.pop().unpersist()
    jvm = spark.sparkContext._jvm
    stay, gone = [f for f in _FOLDERS[since:] if f in keep], [f for f in _FOLDERS[since:] if f not in keep]
    _FOLDERS[since:] = stay
    for folder in gone:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
