"""One row per entity from events of hundreds of types.

Types become indices; a partial aggregation by entity and type gives mergeable sparse vectors of counts,
totals and latest times, which are put together per entity and expanded into columns at the end. A hot
entity is no problem: its rows collapse, before any shuffle, to at most one for each type and task.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.session import small


def latest_state(df: DataFrame, key: str, order: Sequence[Column], keep: Sequence[str]) -> DataFrame:
    """One row per key: the one that is greatest by order, then by the kept columns, so that the choice is never left to chance.

    Rows with a null key name no record and are left out. Nulls sort lowest.
    """
    top = F.max(F.struct(*[c.alias(f"__o{i}") for i, c in enumerate(order)], *keep)).alias("__r")
    return df.where(F.col(key).isNotNull()).groupBy(F.unhex(F.md5(F.col(key).cast("string"))).alias("__k")).agg(top).select(*[f"__r.{c}" for c in keep])


def kind_codes(rows: DataFrame, kinds: Sequence[Column]) -> DataFrame:
    """(kind, code): the kinds of the rows, sorted and numbered from 0. Their number is that of the event types, not of the rows."""
    found = rows.select(F.explode(F.array(*kinds)).alias("kind")).where(F.col("kind").isNotNull()).distinct()
    names = sorted(r.kind for r in found.collect())
    return small(rows.sparkSession.createDataFrame(list(zip(names, range(len(names)), strict=True)), "kind string, code int"), len(names))


def sparse_features(events: DataFrame, entity: str, kinds: Sequence[Column], time: str, totals: Sequence[str], codes: DataFrame | None = None) -> DataFrame:
    """Long form of the vectors: (entity, kind, n, last, total_...).

    Each of kinds maps a row to the name of a kind, null for none; a row counts once for each. Rows with
    a null entity are left out; null totals add nothing, a kind without any value has a null total.

    codes: of kind_codes(), for these events or for more rows that are cheaper to read; made of the events
    if it is None. A kind that it lacks is an error. Only the codes are shuffled and merged.
    """
    codes = kind_codes(events, kinds) if codes is None else codes
    base = events.where(F.col(entity).isNotNull())
    aggs = [F.count(F.lit(1)).alias("n"), F.max(time).alias("last"), *[F.sum(t).alias(f"total_{t}") for t in totals]]
    fine = base.select(entity, time, *totals, *[k.alias(f"__k{i}") for i, k in enumerate(kinds)])
    for i in range(len(kinds)):
        fine = fine.join(codes.select(F.col("kind").alias(f"__k{i}"), F.col("code").alias(f"__c{i}")), f"__k{i}", "left")
        lost = F.raise_error(F.concat(F.lit("no code for the kind "), F.col(f"__k{i}"))).cast("int")
        fine = fine.withColumn(f"__c{i}", F.when(F.col(f"__k{i}").isNotNull(), F.coalesce(f"__c{i}", lost)))
    fine = fine.groupBy(entity, *[f"__c{i}" for i in range(len(kinds))]).agg(*aggs)
    merged = [F.sum("n").alias("n"), F.max("last").alias("last"), *[F.sum(f"total_{t}").alias(f"total_{t}") for t in totals]]
    each = fine.withColumn("code", F.explode(F.array(*[f"__c{i}" for i in range(len(kinds))]))).where(F.col("code").isNotNull())
    vectors = each.groupBy(entity, "code").agg(*merged)
    return vectors.join(codes, "code").select(entity, "kind", "n", "last", *[f"total_{t}" for t in totals])


def wide_features(sparse: DataFrame, entity: str, names: Sequence[str] | None = None) -> DataFrame:
    """The vectors as columns <kind>__<measure>; a kind without events has a count of 0 and nulls.

    names: the kinds, in the order of their columns; all kinds found, sorted, if it is None. Their
    number is that of the event types, not of the rows. What is no letter or digit is an underscore in a
    column's name; of kinds that would share one, all but the first have their number at its end. Each
    vector becomes one dense array, by repeated nulls between its sorted cells, from which columns are
    read by place.
    """
    measures = [c for c in sparse.columns if c not in (entity, "kind")]
    if names is None:
        names = sorted(r.kind for r in sparse.select("kind").distinct().collect())
    if not names:
        return sparse.select(entity).distinct()
    codes = sparse.sparkSession.createDataFrame(list(enumerate(names)), "__i int, kind string")
    cells = sparse.join(small(codes, len(names)), "kind").select(entity, "__i", F.struct(*measures).alias("__m"))
    rows = cells.groupBy(entity).agg(F.array_sort(F.collect_list(F.struct("__i", "__m"))).alias("__c"))
    none = F.lit(None).cast(cells.schema["__m"].dataType)

    def spaced(x: Column, at: Column) -> Column:
        before = F.coalesce(F.get("__c", at - 1)["__i"], F.lit(-1))
        return F.concat(F.array_repeat(none, x["__i"] - before - 1), F.array(x["__m"]))

    dense = rows.select(entity, F.flatten(F.transform("__c", spaced)).alias("__v"))
    labels, used = [], set()
    for i, k in enumerate(names):
        label = re.sub(r"[^0-9A-Za-z_]+", "_", k)
        while label.lower() in used:
            label = f"{label}_{i}"
        used.add(label.lower())
        labels.append(label)

    def column(m: str, label: str, i: int) -> Column:
        c = F.get("__v", F.lit(i))[m]
        return (F.coalesce(c, F.lit(0)) if m == "n" else c).alias(f"{label}__{m}")

    return dense.select(entity, *[column(m, k, i) for i, k in enumerate(labels) for m in measures])
