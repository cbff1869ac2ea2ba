"""Ordered scans over globally range-sorted data, with state carried across partitions.

A global sort splits even one hot entity over many partitions. What a partition has to know of the ones
before it is a summary of a few values a partition; the summaries are combined in order on the driver
(one row a partition, whatever the data's size) and each partition is then scanned on its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import checkpoint, shuffle_partitions

PID = "__pid"


def range_sorted(df: DataFrame, keys: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Rows range-partitioned and sorted by keys, kept by a checkpoint.

    The checkpoint matters for more than lineage: range bounds come from a sample, so two passes over an
    unmaterialised sort could see different partitions.
    """
    n = partitions or shuffle_partitions(df.sparkSession)
    return checkpoint(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys))


def partition_summaries(df: DataFrame, *aggregates) -> list[dict]:
    """One dict of aggregates for each partition that isn't empty, in partition order."""
    rows = df.withColumn(PID, F.spark_partition_id()).groupBy(PID).agg(*aggregates).collect()
    return sorted((r.asDict() for r in rows), key=lambda r: r[PID])
