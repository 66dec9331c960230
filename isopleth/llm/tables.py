"""Joins with tables whose size is only known once they are written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a table of a few numbers goes to all executors (some 16 MB); larger ones are shuffled.
BROADCAST_ROWS = 500_000


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of narrow rows, marked for broadcast if its counted rows are few."""
    return F.broadcast(df) if df.count() <= rows else df
