"""Work on whole grid lines: the cells of a line meet in one row, batches of lines are numpy stacks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cells held at once while a batch is worked on, whatever the batch size of the session.
STACK_CELLS = 1 << 20

Apply = Callable[[Mapping[str, np.ndarray], pa.RecordBatch], Sequence[np.ndarray]]


def along_lines(df: DataFrame, keys: Sequence[str], axis: str, n: int, values: Sequence[str], apply: Apply,
                outputs: Sequence[str], absent: float = 0.0) -> DataFrame:
    """The keys of every line with one array per output.

    A line is a group of ``keys``; its cells lie at ``axis`` 0 to n - 1, and
    places without a row hold ``absent``.  ``apply`` gets a (lines, n) stack
    per value and the batch with the keys, and returns a (lines, m) array per
    output.  A row is never larger than a line.
    """
    keys, names = list(keys), [*keys, *outputs]
    lines = df.groupBy(*keys).agg(F.collect_list(F.struct(axis, *values)).alias("_line"))
    flat = lines.select(*keys, *[F.col(f"_line.{c}").alias(c) for c in (axis, *values)])
    types = {f.name: f.dataType for f in df.schema.fields}
    schema = T.StructType([T.StructField(k, types[k]) for k in keys] + [T.StructField(v, T.ArrayType(T.DoubleType())) for v in outputs])
    step = max(1, STACK_CELLS // n)

    def worked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                at, k = part.column(axis), part.num_rows
                row = np.repeat(np.arange(k), np.diff(at.offsets.to_numpy()))
                place = at.flatten().to_numpy()
                stacks = {}
                for v in values:
                    stacks[v] = np.full((k, n), absent)
                    stacks[v][row, place] = part.column(v).flatten().to_numpy(zero_copy_only=False)
                made = [np.ascontiguousarray(a, dtype=float) for a in apply(stacks, part)]
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(k + 1, dtype=np.int32) * a.shape[1]), pa.array(a.ravel())) for a in made]
                yield pa.RecordBatch.from_arrays([*[part.column(key) for key in keys], *lists], names=names)

    return flat.mapInArrow(worked, schema)


def cells_of(lines: DataFrame, keys: Sequence[str], axis: str, values: Sequence[str]) -> DataFrame:
    """The arrays of :func:`along_lines` as one row per place."""
    cells = lines.select(*keys, F.posexplode(F.arrays_zip(*values)).alias(axis, "_cell"))
    return cells.select(*keys, axis, *[F.col(f"_cell.{v}").alias(v) for v in values])
