from datetime import datetime

import pytest
from pyspark.sql import functions as F

from graphloom.operators import references
from graphloom.operators.references import Reference

U = "0a0b0c0d-1111-4222-8333-%012x"
T0 = datetime(2026, 1, 1)
DAY = 86_400_000


@pytest.mark.parametrize("text", [U % 1, (U % 1).upper(), "{%s}" % (U % 1), "urn:uuid:" + (U % 1).upper(), f" {U % 1}\t", (U % 1).replace("-", "")])
def test_spellings_are_one_key(spark, text):
    df = spark.createDataFrame([(text, U % 1)], "a string, b string")
    assert df.select(references.uuid_key(F.col("a")) == references.uuid_key(F.col("b"))).first()[0]


def test_no_reference(spark):
    df = spark.createDataFrame([(x,) for x in (None, "", "  ", "0" * 32, "00000000-0000-0000-0000-000000000000", "{00000000-0000-0000-0000-000000000000}")], "a string")
    assert df.where(references.uuid_key(F.col("a")).isNotNull()).count() == 0


def _cases(spark, refs, parents):
    at = T0
    r = spark.createDataFrame([(t, i, k, ms, ld) for t, i, k, ms, ld in refs], "tenant_id string, id string, ref string, at_ms bigint, loaded_at timestamp")
    p = spark.createDataFrame(parents, "tenant_id string, key string, deleted_at_epoch_ms bigint, loaded_at timestamp")
    rows = references.reference_rows(r, [Reference("t", "ref", "k", "id", "at_ms")])
    assert at
    return {(x.row_id, x.case_kind) for x in references.classify(rows, references.parent_rows(p, "k", "key")).collect()}


def test_cases(spark):
    d = lambda n: datetime(2026, 1, n)
    parents = [("A", U % 1, None, d(1)), ("A", U % 2, 5 * DAY, d(1)), ("A", U % 2, None, d(2)), ("A", (U % 3).upper(), None, d(9)), ("A", U % 3, None, d(8)), ("B", U % 4, None, d(1)), (None, U % 5, None, d(1)), ("A", None, None, d(1))]
    refs = [
        ("A", "ok", U % 1, DAY, d(2)), ("A", "gone", U % 2, 5 * DAY, d(9)), ("A", "before", U % 2, 5 * DAY - 1, d(9)), ("A", "late", U % 3, DAY, d(7)), ("A", "sameday", U % 3, DAY, d(8)),
        ("A", "other tenant", U % 4, DAY, d(2)), ("A", "no uuid", "abc", DAY, d(2)), ("A", "none", None, DAY, d(2)), ("A", "zero", "0" * 32, DAY, d(2)),
        ("A", "twice", U % 3, DAY, d(9)), ("A", "twice", U % 3, DAY, d(7)), (None, "no tenant", U % 1, DAY, d(2)), ("A", None, U % 9, DAY, d(2)), ("A", "no time", U % 2, None, d(9)), ("A", "never loaded", U % 3, DAY, None),
    ]
    assert _cases(spark, refs, parents) == {("gone", "deleted"), ("late", "late"), ("other tenant", "missing"), ("no uuid", "missing"), ("twice", "late")}


def test_empty_sides(spark):
    assert _cases(spark, [], []) == set()
    assert _cases(spark, [("A", "x", U % 1, 1, T0)], []) == {("x", "missing")}


def test_bitmaps_over_many_ranges(spark):
    """Ids of several ranges and days, with few and many bits."""
    n = 70_000
    d = spark.range(1, n + 1).select("id", (F.col("id") % 3 != 0).alias("present"), (F.col("id") % 7).alias("loaded_day"), F.when(F.col("id") % 5 == 0, F.col("id") % 11).alias("deleted_day"), F.array(F.struct((F.col("id") % 4).alias("time_day"), (F.col("id") % 6).alias("loaded_day"))).alias("days"))
    got = {r.id for r in references.surviving_keys(d).collect()}
    want = {i for i in range(1, n + 1) if i % 3 == 0 or (i % 5 == 0 and i % 11 <= i % 4) or i % 7 >= i % 6}
    assert got == want
