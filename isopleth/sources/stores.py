"""Files as tasks see them: opened through Arrow's file systems, read in chunks, one file at a time."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from fnmatch import fnmatchcase
from urllib.parse import quote

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isopleth.session import pinned

CHUNK = 1 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system and path for a path as Spark writes it: ``file:/a b``, ``hdfs://...``, ``s3a://...``."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    scheme, rest = path.split("://", 1)
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3", "gs": "gs"}.get(scheme, scheme) + "://" + quote(rest, safe="/:@"))


def listed(spark: SparkSession, folders: str | Sequence[str], pattern: str = "*") -> DataFrame:
    """``path, bytes`` of every file below the folders whose name fits, hidden and empty ones included.

    Folders are dealt to tasks, level by level, so no more than a level's
    folders wait at a time and the driver sees none of the names.
    """

    def children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, name = opened(path)
                infos = store.get_file_info([name])
                if infos[0].type == fs.FileType.NotFound:
                    raise FileNotFoundError(path)
                if infos[0].type == fs.FileType.Directory:
                    infos = store.get_file_info(fs.FileSelector(name))
                    names = [f"{path.rstrip('/')}/{i.base_name}" for i in infos]
                else:
                    names = [path]
                folder = [i.type == fs.FileType.Directory for i in infos]
                kept = [d or fnmatchcase(i.base_name, pattern) for i, d in zip(infos, folder)]
                rows = [(n, i.size, d) for n, i, d, k in zip(names, infos, folder, kept) if k]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.bool_()))]
                if rows:
                    yield pa.RecordBatch.from_arrays(columns, ["path", "bytes", "folder"])

    roots = [folders] if isinstance(folders, str) else list(folders)
    level = spark.createDataFrame([(qualified(spark, f),) for f in roots], "path string")
    out = None
    while True:
        tasks = max(1, min(level.count(), 4 * spark.sparkContext.defaultParallelism))
        found = pinned(level.repartition(tasks, "path").mapInArrow(children, "path string, bytes long, folder boolean"))
        files = found.where("NOT folder").select("path", F.coalesce("bytes", F.lit(0).cast("long")).alias("bytes"))
        out = files if out is None else out.unionByName(files)
        level = found.where("folder").select("path")
        if level.isEmpty():
            return out


def dealt(files: DataFrame, share: int = 256 << 20) -> DataFrame:
    """Listed files in as many tasks as their bytes need, whatever the size of their names."""
    n, total = files.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    wanted = max(files.sparkSession.sparkContext.defaultParallelism, math.ceil(total / share))
    return files.repartition(max(1, min(n, wanted)), "path")


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its store, as Spark writes it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return store.makeQualified(place).toString()


def below(spark: SparkSession, folder: str, path: str = "path") -> Column:
    """A path relative to the folder."""
    prefix = qualified(spark, folder).rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(prefix)), F.substring(path, len(prefix) + 1, 1 << 20)).otherwise(F.col(path))


def sha256_of(path: str, chunk: int = CHUNK) -> str:
    """Digest of a file, of which one chunk is held at a time."""
    store, name = opened(path)
    digest = hashlib.sha256()
    with store.open_input_stream(name) as stream:
        while part := stream.read(chunk):
            digest.update(part)
    return digest.hexdigest()


def digests(files: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``path, bytes, sha256`` of listed files of any size; a file is read by one task, chunk by chunk."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, path in enumerate(batch.column("path").to_pylist()):
                # A row as soon as its file is done, so that nothing piles up.
                row = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([row.column("path"), row.column("bytes"), pa.array([sha256_of(path, chunk)])], ["path", "bytes", "sha256"])

    return dealt(files.select("path", "bytes")).mapInArrow(digest, "path string, bytes long, sha256 string")


def read_attempts(files: DataFrame, fmt: str = "parquet", columns: Sequence[str] | None = None) -> DataFrame:
    """``path, n_rows, reason`` of listed files, each read to its end by one task.

    A file that cannot be read, or lacks a wanted column, has a reason (what
    the reader said of it) and null rows; a readable file without rows has 0.
    """
    wanted = list(columns) if columns is not None else None

    def attempt(path: str) -> tuple[int | None, str | None]:
        try:
            store, name = opened(path)
            scan = ds.dataset(name, filesystem=store, format=fmt).scanner(columns=wanted, batch_readahead=1, fragment_readahead=1)
            return sum(batch.num_rows for batch in scan.to_batches()), None
        except (OSError, pa.ArrowException, ValueError, KeyError) as problem:
            said = str(problem).replace(name, "file").splitlines()
            return None, f"{type(problem).__name__}: {said[0] if said else ''}"

    def attempts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, reason = attempt(path)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path]), pa.array([rows], pa.int64()), pa.array([reason], pa.string())], ["path", "n_rows", "reason"]
                )

    return dealt(files.select("path", "bytes")).mapInArrow(attempts, "path string, n_rows long, reason string")
