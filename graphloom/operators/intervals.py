"""Overlapping and gapped intervals: continuous periods of an entity and the gaps between them.

Method: a global range sort by entity and start, a maximum-end summary of each partition, the summaries
combined in order, and a rescan with the carried state. A hot entity is split over partitions by the
sort, so no task holds it whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.ordered import PID, partition_summaries, range_sorted

E, S, T = "__entity", "__start", "__end"


def _sorted_spans(df: DataFrame, entity: str, start: str, end: str) -> DataFrame:
    spans = df.select(F.col(entity).cast("string").alias(E), F.col(start).cast("bigint").alias(S), F.col(end).cast("bigint").alias(T))
    return range_sorted(spans.where(F.col(E).isNotNull() & F.col(S).isNotNull() & (F.col(T) >= F.col(S))), [E, S, T])


def _carried_ends(spans: DataFrame) -> dict[int, tuple[str, int]]:
    """For each partition: the entity before it and the largest end of that entity so far."""
    carry: dict[int, tuple[str, int]] = {}
    entity, end = None, 0
    for r in partition_summaries(spans, F.max(F.struct(E, T)).alias("last")):
        if entity is not None:
            carry[r[PID]] = (entity, end)
        last, top = r["last"][E], r["last"][T]
        entity, end = last, max(end, top) if last == entity else top
    return carry


def _before(pdf: pd.DataFrame, entity: str | None, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sorted rows: whether the entity changes at a row, whether a row has spans before it, and their largest end."""
    e, t = pdf[E].to_numpy(), pdf[T].to_numpy().copy()
    fresh = np.empty(len(e), bool)
    fresh[0] = e[0] != entity
    fresh[1:] = e[1:] != e[:-1]
    first = t[0]
    if not fresh[0]:
        t[0] = max(first, end)
    top = pd.Series(t).groupby(np.cumsum(fresh)).cummax().to_numpy()
    before = np.empty(len(t), np.int64)
    before[0], before[1:] = end, top[:-1]
    return fresh, before, top


def gaps(df: DataFrame, entity: str, start: str, end: str) -> DataFrame:
    """Gaps between the periods of each entity: columns (entity, gap_start, gap_end).

    Rows with a null entity, start or end, or an end before the start, don't count; a span of no length
    does. Spans that share an instant are one period. Repeated rows change nothing, other columns are
    ignored, and an empty table gives no rows.
    """
    spans = _sorted_spans(df, entity, start, end)
    carry = _carried_ends(spans)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, top = carry.get(TaskContext.get().partitionId(), (None, 0))
        for pdf in batches:
            if len(pdf):
                fresh, before, tops = _before(pdf, last, top)
                hole = ~fresh & (pdf[S].to_numpy() > before)
                yield pd.DataFrame({"entity": pdf[E].to_numpy()[hole], "gap_start": before[hole], "gap_end": pdf[S].to_numpy()[hole]})
                last, top = pdf[E].iloc[-1], int(tops[-1])

    return spans.mapInPandas(scan, "entity string, gap_start bigint, gap_end bigint")


def periods(df: DataFrame, entity: str, start: str, end: str) -> DataFrame:
    """Continuous periods of each entity: columns (entity, period_start, period_end, n_spans).

    Rows count as in gaps(). Each row is labelled with the start of its island; an island that began in
    an earlier partition gets that start from a second carried summary.
    """
    spans = _sorted_spans(df, entity, start, end)
    carry = _carried_ends(spans)

    def islands(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
        last, top = carry.get(TaskContext.get().partitionId(), (None, 0))
        for pdf in batches:
            if len(pdf):
                fresh, before, tops = _before(pdf, last, top)
                yield pdf, fresh | (pdf[S].to_numpy() > before), tops
                last, top = pdf[E].iloc[-1], int(tops[-1])

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, at = None, None
        for pdf, opens, _ in islands(batches):
            last = pdf[E].iloc[-1]
            if opens.any():
                at = int(pdf[S].to_numpy()[np.flatnonzero(opens)[-1]])
        if last is not None:
            yield pd.DataFrame({"pid": [TaskContext.get().partitionId()], "entity": [last], "at": pd.array([at], "Int64")})

    labels: dict[int, int] = {}
    current = None
    for r in sorted(spans.mapInPandas(opened, "pid int, entity string, at bigint").collect(), key=lambda r: r.pid):
        if current is not None:
            labels[r.pid] = current
        current = current if r["at"] is None else r["at"]

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current = labels.get(TaskContext.get().partitionId())
        for pdf, opens, tops in islands(batches):
            s = pdf[S].to_numpy()
            at = np.maximum.accumulate(np.where(opens, np.arange(len(s)), -1))
            label = np.where(at >= 0, s[at], current if current is not None else s[0])
            current = int(label[-1])
            out = pd.DataFrame({"entity": pdf[E].to_numpy(), "period_start": label, "period_end": tops, "n_spans": 1})
            yield out.groupby(["entity", "period_start"], as_index=False, sort=False).agg({"period_end": "max", "n_spans": "sum"})

    pieces = spans.mapInPandas(label, "entity string, period_start bigint, period_end bigint, n_spans bigint")
    return pieces.groupBy("entity", "period_start").agg(F.max("period_end").alias("period_end"), F.sum("n_spans").alias("n_spans"))
