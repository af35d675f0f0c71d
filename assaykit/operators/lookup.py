"""Joins with tables of distinct keys: broadcast up to a checked size, shuffled beyond it."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most rows of a table that is broadcast.
BROADCAST_ROWS = 1_000_000


def lookup_join(rows: DataFrame, table: DataFrame, on: str | list[str], how: str = "left", most: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` joined with ``table``, whose keys are distinct.

    The table is computed once and counted.  Up to ``most`` rows it is broadcast, so that rows of
    a frequent word are never gathered in one task (its blocks stay on disk until the session clears its cache); a larger one is joined by a shuffle, whose
    skewed partitions Spark splits.
    """
    table = table.persist(StorageLevel.DISK_ONLY)
    return rows.join(F.broadcast(table) if table.count() <= most else table, on, how)
