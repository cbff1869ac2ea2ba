"""References to records that do not exist, are deleted or arrive later.

Keys of the parents and of the references are dictionary-encoded as integers by one aggregation over both.
For each range of 32,768 integers there is a bitmap of the keys that a parent has, and for each period,
compressed, those that are referred to, deleted or arrive. References AND NOT parents are the missing
ones; references AND those deleted by then or not yet arrived are candidates, whose times an exact
comparison settles.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.session import checkpoint, small

DAY_MS = 86_400_000
KEY = ["kind", "tenant", "key"]
#: Ids of a bitmap.
RANGE = 32_768


@dataclass(frozen=True)
class Reference:
    """A field of a table that refers to a kind of parent; time_ms is when the row refers to it."""

    table: str
    field: str
    kind: str
    row_id: str
    time_ms: str
    tenant: str = "tenant_id"
    loaded: str = "loaded_at"


def uuid_key(c: Column) -> Column:
    """A reference as 16 bytes, however its UUID is written; text that is no UUID becomes its own bytes behind a mark.

    Null for no reference: null, blank or all zeros. Accepted are any letter case, outer blanks, braces,
    a urn:uuid: prefix, and a UUID without hyphens.
    """
    text = F.lower(F.regexp_replace(c.cast("string"), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    bare = F.regexp_replace(F.regexp_replace(text, r"^urn:uuid:|^\{|\}$", ""), "-", "")
    key = F.when(bare.rlike("^[0-9a-f]{32}$"), F.unhex(bare)).otherwise(F.concat(F.lit("not a uuid ").cast("binary"), text.cast("binary")))
    return F.when(text.isNotNull() & (text != "") & ~F.regexp_replace(text, r"^urn:uuid:|[{}-]", "").rlike("^0*$"), key)


def parent_rows(df: DataFrame, kind: str, key: str, tenant: str = "tenant_id", deleted_ms: str = "deleted_at_epoch_ms", loaded: str = "loaded_at") -> DataFrame:
    """Rows of a parent table in the form that classify() takes; rows with a null key or tenant name no record."""
    return df.select(F.lit(kind).alias("kind"), F.md5(F.col(tenant).cast("string")).alias("tenant"), uuid_key(F.col(key)).alias("key"), F.col(deleted_ms).cast("bigint").alias("deleted_ms"), F.unix_micros(F.col(loaded).cast("timestamp")).alias("loaded_us")).where("key is not null and tenant is not null")


def reference_rows(df: DataFrame, refs: list[Reference]) -> DataFrame:
    """One row for each record and field of one table that holds a reference.

    Rows sent twice are one record: its first arrival and its earliest time count, and the greatest of its
    references if they differ. Records without an id or a tenant are left out.
    """
    r = refs[0]
    keys = [uuid_key(F.col(x.field)).alias(f"k{i}") for i, x in enumerate(refs)]
    rows = df.select(F.col(r.row_id).alias("row_id"), F.md5(F.col(r.tenant).cast("string")).alias("tenant"), F.col(r.time_ms).cast("bigint").alias("time_ms"), F.unix_micros(F.col(r.loaded).cast("timestamp")).alias("loaded_us"), *keys)
    rows = rows.where("row_id is not null and tenant is not null")
    records = rows.groupBy("row_id", "tenant").agg(F.min("time_ms").alias("time_ms"), F.min("loaded_us").alias("loaded_us"), *[F.max(f"k{i}").alias(f"k{i}") for i in range(len(refs))])
    each = F.array(*[F.struct(F.lit(x.table).alias("ref_table"), F.lit(x.field).alias("ref_field"), F.lit(x.kind).alias("kind"), F.col(f"k{i}").alias("key")) for i, x in enumerate(refs)])
    return records.select("row_id", "tenant", "time_ms", "loaded_us", F.inline(each)).where("key is not null")


def surviving_keys(dictionary: DataFrame) -> DataFrame:
    """Ids of keys that some period refers to in vain, or perhaps so: (id, missing).

    dictionary: id, present, loaded_day, deleted_day of each key and days, the set of (time_day,
    loaded_day) in which it is referred to. A period's keys of a range are kept as sorted positions, which
    a range of 32,768 ids spread over many periods fills sparsely; presence, which it fills densely, as
    bits. One task holds one range at a time, whose size is that of its keys and periods, not of the rows.
    """
    at = [F.bitmap_bucket_number("id").alias("bucket"), F.bitmap_bit_position("id").cast("int").alias("pos")]
    refs = dictionary.where(F.size("days") > 0).select(*at, F.explode("days").alias("d"))
    marks = refs.select("bucket", "pos", F.explode(F.array(*[F.struct(F.lit(n).alias("what"), F.col(f"d.{c}").alias("day")) for n, c in (("ref_time", "time_day"), ("ref_loaded", "loaded_day"))])).alias("m"))
    own = dictionary.where("present").select(*at, F.explode(F.array(F.struct(F.lit("present").alias("what"), F.lit(0).cast("bigint").alias("day")), F.struct(F.lit("deleted").alias("what"), F.col("deleted_day").alias("day")), F.struct(F.lit("loaded").alias("what"), F.col("loaded_day").alias("day")))).alias("m"))
    laid = marks.unionByName(own).select("bucket", "pos", "m.what", "m.day").where("day is not null").repartition("bucket")
    dense = F.col("what") == "present"
    maps = laid.groupBy("bucket", "what", "day").agg(F.collect_set(F.when(~dense, F.col("pos"))).alias("places"), F.bitmap_construct_agg(F.when(dense, F.col("pos").cast("bigint"))).alias("bits"))
    maps = maps.withColumn("bits", F.when(dense, F.col("bits")))

    def bucket(pdf: pd.DataFrame) -> pd.DataFrame:
        by = {w: g.sort_values("day") for w, g in pdf.groupby("what")}
        present = np.unpackbits(np.frombuffer(by["present"].bits.iloc[0], np.uint8), bitorder="little").astype(bool) if "present" in by else np.zeros(RANGE, bool)
        missing, perhaps, gone, seen = (np.zeros(RANGE, bool) for _ in range(4))

        def events(what: str) -> list[tuple[int, np.ndarray]]:
            return [(int(d), np.asarray(p, np.int64)) for d, p in zip(by[what].day, by[what].places, strict=True)] if what in by else []

        deleted, arrived, i = events("deleted"), events("loaded"), 0
        for day, refs in events("ref_time"):
            while i < len(deleted) and deleted[i][0] <= day:
                gone[deleted[i][1]] = True
                i += 1
            missing[refs] |= ~present[refs]
            perhaps[refs] |= gone[refs]
        i = 0
        for day, refs in events("ref_loaded"):
            while i < len(arrived) and arrived[i][0] < day:
                seen[arrived[i][1]] = True
                i += 1
            perhaps[refs] |= present[refs] & ~seen[refs]
        pos = np.flatnonzero(missing | perhaps)
        return pd.DataFrame({"id": (int(pdf.bucket.iloc[0]) - 1) * RANGE + pos + 1, "missing": missing[pos]})

    return maps.groupBy("bucket").applyInPandas(bucket, "id bigint, missing boolean")


def classify(references: DataFrame, parents: DataFrame) -> DataFrame:
    """Cases (ref_table, ref_field, row_id, case_kind, time_ms) of references in vain.

    The first that applies: missing, no parent row has the key in the reference's tenant; deleted, one of
    its rows was deleted at or before the reference's time; late, its first row arrived after the first
    row of the referring record. A null time is never after a deletion; a null arrival is never late.
    """
    day_us = DAY_MS * 1000
    references = checkpoint(references)
    none = F.lit(None)
    period = F.struct(F.coalesce(F.floor(F.col("time_ms") / DAY_MS).cast("bigint"), F.lit(-(1 << 40))).alias("time_day"), F.floor(F.col("loaded_us") / day_us).cast("bigint").alias("loaded_day"))
    asked = references.select(*KEY, period.alias("day"), none.cast("bigint").alias("deleted_ms"), none.cast("bigint").alias("loaded_us"), F.lit(False).alias("present"))
    own = parents.select(*KEY, none.cast(asked.schema["day"].dataType).alias("day"), "deleted_ms", "loaded_us", F.lit(True).alias("present"))
    keys = asked.unionByName(own).groupBy(*KEY).agg(F.collect_set("day").alias("days"), F.min("deleted_ms").alias("deleted_ms"), F.min("loaded_us").alias("loaded_us"), F.bool_or("present").alias("present"))
    keys = checkpoint(keys.where(F.size("days") > 0).withColumn("id", F.monotonically_increasing_id() + 1))
    dictionary = keys.select("id", "present", F.floor(F.col("loaded_us") / day_us).cast("bigint").alias("loaded_day"), F.floor(F.col("deleted_ms") / DAY_MS).cast("bigint").alias("deleted_day"), "days")
    survivors = checkpoint(surviving_keys(dictionary))
    n = survivors.count()
    vain = keys.select(*KEY, "id", "deleted_ms", F.col("loaded_us").alias("own_loaded_us")).join(small(survivors, n), "id").drop("id")
    cases = references.join(small(vain, n), KEY)
    kind = F.when(F.col("missing"), "missing").when(F.col("deleted_ms") <= F.col("time_ms"), "deleted").when(F.col("own_loaded_us") > F.col("loaded_us"), "late")
    return cases.select("ref_table", "ref_field", "row_id", kind.alias("case_kind"), "time_ms").where("case_kind is not null")


def per_period(cases: DataFrame) -> DataFrame:
    """Counts of the cases per table, field, kind and month of the reference; a null time has a null month."""
    month = F.date_format(F.timestamp_millis("time_ms"), "yyyy-MM").alias("period")
    return cases.groupBy("ref_table", "ref_field", "case_kind", month).agg(F.count(F.lit(1)).alias("n"))
