"""Operators around the graph: dictionary, adjacency and capability indexes, semi-join reduction, hydration, query log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.session import BROADCAST_ROWS, shuffle_partitions


class MissingPayload(LookupError):
    """A key that has no payload row; hydration is whole or fails."""


class ForbiddenPredicate(PermissionError):
    """A payload predicate that the principal may not read."""


def term_key(c: Column) -> Column:
    """The bytes that order terms: kind, then text, datatype and language, each ended by a zero."""
    zero = F.lit("\0")
    return F.concat(c["k"].cast("string"), zero, c["v"], zero, F.coalesce(c["d"], F.lit("")), zero, F.coalesce(c["l"], F.lit("")))


def dictionary(quads: DataFrame) -> DataFrame:
    """(term_key, as_predicate, id): ids from 1, dense, in the keys' order; as_predicate: whether a fact has the term as its predicate.

    A range sort and the counts of its partitions give each row its number; only one count a partition
    goes through the driver.
    """
    from graphloom.operators.ordered import PID, range_sorted

    roles = [(term_key(F.col("s")), False), (_predicate_key(F.col("p")), True), (term_key(F.col("o")), False)]
    places = F.inline(F.array(*[F.struct(k.alias("term_key"), F.lit(r).alias("as_predicate")) for k, r in roles]))
    keys = quads.select(places).groupBy("term_key").agg(F.bool_or("as_predicate").alias("as_predicate"))
    ordered = range_sorted(keys, ["term_key"], shuffle_partitions(quads.sparkSession)).withColumn(PID, F.spark_partition_id())
    counts = sorted((r[PID], r["count"]) for r in ordered.groupBy(PID).count().collect())
    before, total = {}, 0
    for pid, n in counts:
        before[pid] = total
        total += n
    starts = quads.sparkSession.createDataFrame(list(before.items()), f"{PID} int, start bigint")
    # within a partition ids count up in its order: the low bits of the built-in id
    numbered = ordered.withColumn("at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    return numbered.join(F.broadcast(starts), PID).select("term_key", "as_predicate", (F.col("start") + F.col("at") + 1).alias("id"))


def _predicate_key(p: Column) -> Column:
    """The term_key of a predicate's IRI."""
    return F.concat(F.lit("1\0"), p, F.lit("\0\0"))


def _counted(df: DataFrame) -> DataFrame:
    """One side of a join: broadcast if its rows were counted and are few, else shuffled and merged whatever its size is estimated as."""
    n = df.limit(BROADCAST_ROWS + 1).count()
    return F.broadcast(df) if n <= BROADCAST_ROWS else df.hint("merge")


def predicates(terms: DataFrame) -> DataFrame:
    """(p, iri) of a dictionary's predicates, as a side of a join."""
    return _counted(terms.where("as_predicate").select(F.col("id").alias("p"), F.split("term_key", "\0")[1].alias("iri")))


def encoded(quads: DataFrame, terms: DataFrame) -> DataFrame:
    """Facts by ids (s, p, o, g); every term must be in the dictionary.

    Predicates are few and broadcast. Subjects and objects are merged with the dictionary: it is a checkpoint,
    whose estimated size follows the tables' files and may be far below that of its terms, so an estimate
    must not choose a broadcast.
    """
    d = terms.select("term_key", "id")
    out = quads.select(term_key(F.col("s")).alias("ks"), F.col("p").alias("iri"), term_key(F.col("o")).alias("ko"), "g").join(predicates(terms), "iri")
    for c in ("s", "o"):
        out = out.join(d.select(F.col("term_key").alias(f"k{c}"), F.col("id").alias(c)).hint("merge"), f"k{c}")
    return out.select("s", "p", "o", "g")


def adjacency(facts: DataFrame, forward: bool = True) -> DataFrame:
    """Edges by (anchor, pred, other, graph), each once, laid out and sorted by their anchor."""
    a, b = ("s", "o") if forward else ("o", "s")
    edges = facts.select(F.col(a).alias("anchor"), F.col("p").alias("pred"), F.col(b).alias("other"), F.col("g").alias("graph")).distinct()
    return edges.repartitionByRange("anchor", "pred").sortWithinPartitions("anchor", "pred", "other", "graph")


def capability_index(quads: DataFrame) -> DataFrame:
    """Which graphs hold a predicate, and which a class: (kind, iri, graphs, n)."""
    from graphloom.plans.algebra import RDF_TYPE

    preds = quads.groupBy(F.lit("predicate").alias("kind"), F.col("p").alias("iri"), "g").agg(F.count(F.lit(1)).alias("n"))
    classes = quads.where(F.col("p") == RDF_TYPE).groupBy(F.lit("class").alias("kind"), F.col("o.v").alias("iri"), "g").agg(F.count(F.lit(1)).alias("n"))
    return preds.unionByName(classes).groupBy("kind", "iri").agg(F.array_join(F.sort_array(F.collect_set("g")), " ").alias("graphs"), F.sum("n").alias("n"))


def semijoin_reduce(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is among the keys, as often as they occur; the keys are broadcast only if they were counted and are few."""
    distinct = keys.select(*on).distinct()
    n = distinct.limit(BROADCAST_ROWS + 1).count()
    return df.join(F.broadcast(distinct) if n <= BROADCAST_ROWS else distinct, list(on), "left_semi")


def hydrate(keys: DataFrame, payload: DataFrame, key: str, columns: Sequence[str], labels: Column | None = None, forbidden: Sequence[str] = (), ordinal: str = "ordinal") -> DataFrame:
    """Payload columns for qualified keys (key, ordinal), with ordinals and multiplicity kept.

    Rows the principal may not see (labels false) are taken out first; a key without any visible row is
    an error when the result is read, and a forbidden column one at once.
    """
    if bad := sorted(set(columns) & set(forbidden)):
        raise ForbiddenPredicate(", ".join(bad))
    seen = payload if labels is None else payload.where(labels)
    joined = keys.select(ordinal, key).join(seen.select(key, *columns, F.lit(True).alias("__there")), key, "left")
    checked = F.when(F.col("__there").isNull(), F.raise_error(F.concat(F.lit("no payload for "), F.col(key).cast("string"))))
    first, *rest = columns
    out = joined.select(ordinal, key, F.when(F.col("__there"), F.col(first)).otherwise(checked.cast(payload.schema[first].dataType)).alias(first), *rest)
    return out.orderBy(ordinal, key, *columns)


def optional_context(df: DataFrame, order: Sequence[str], most: int) -> tuple[DataFrame, bool]:
    """The first rows of context that may be left out, and whether any was."""
    return df.orderBy(*order).limit(most), df.limit(most + 1).count() > most


def query_log(log: DataFrame, dataset: str | None = None, principal: str | None = None, status: str | None = None, since_ms: int | None = None, until_ms: int | None = None, least_ms: int | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """The log's rows that pass the filters, newest first and by id downwards; a listing, so with limit and offset."""
    c = F.lit(True)
    for column, value in (("dataset_id", dataset), ("principal_id", principal), ("status", status)):
        if value is not None:
            c = c & (F.col(column) == value)
    if since_ms is not None:
        c = c & (F.col("start_time_epoch_ms") >= since_ms)
    if until_ms is not None:
        c = c & (F.col("start_time_epoch_ms") < until_ms)
    if least_ms is not None:
        c = c & (F.col("total_duration_ms") >= least_ms)
    rows = log.where(c).orderBy(F.col("start_time_epoch_ms").desc_nulls_last(), F.col("query_execution_id").desc_nulls_last(), F.col("loaded_at").desc_nulls_last())
    return rows.offset(offset).limit(limit)


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float]) -> DataFrame:
    """Exact nearest-rank percentiles: (keys..., p<q>...). Null values are left out, null keys are a group.

    Equal values are counted before they are shuffled; a group's different values then pass in order with
    a running count, and may spill.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    by = Window.partitionBy(*keys)
    upto = by.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumns({"__upto": F.sum("__c").over(upto), "__n": F.sum("__c").over(by)})
    return ranked.groupBy(*keys).agg(*[F.min(F.when(F.col("__upto") >= F.greatest(F.lit(1), F.ceil(F.round(F.lit(q) * F.col("__n"), 9))), F.col(value))).alias(f"p{round(q * 100)}") for q in qs])
