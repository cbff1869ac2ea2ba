import math
import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import quantiles
from graphloom.llm.quantiles import Summary, _Stack

QS = (0.01, 0.25, 0.5, 0.9, 0.99, 1.0)


def ranks(values, v):
    s = np.sort(values)
    return int(np.searchsorted(s, v, "left")) + 1, int(np.searchsorted(s, v, "right"))


@pytest.mark.parametrize("shape", ["random", "ties", "sorted", "doubles"])
def test_bounds_hold_after_many_merges(shape):
    r = random.Random(1)
    values = np.array([r.randrange(10) if shape == "ties" else r.randrange(10**9) if shape == "random" else r.gauss(0, 1) if shape == "doubles" else i for i in range(20_000)])
    stack = _Stack(64)
    for i in range(0, len(values), 700):
        stack.add(Summary.of(values[i : i + 700]).compress(64))
    whole = stack.whole()
    assert whole.n == len(values) and len(whole.v) <= 65
    for q, v, error in zip(QS, *whole.quantiles(QS), strict=True):
        lo, hi = ranks(values, v)
        rank = math.ceil(q * len(values))
        assert max(lo - rank, rank - hi, 0) <= error <= 0.12 * len(values)


def test_small_groups_are_exact():
    stack = _Stack(8)
    for x in ([5, 1], [3], [3, 9]):
        stack.add(Summary.of(np.array(x)))
    assert stack.whole().quantiles((0.2, 0.5, 0.8, 1.0)) == ([1, 3, 5, 9], [0, 0, 0, 0])


def test_groups_nulls_and_parts(spark, rows):
    data = [("a", 1, v) for v in range(1, 101)] + [("a", 2, v) for v in range(101, 201)] + [(None, 1, 7), ("a", 1, None), ("b", 1, None)]
    df = spark.createDataFrame(data, "g string, part int, v bigint").repartition(5).selectExpr("*", "1 as n", "2 as lo")
    parts = quantiles.summaries(df, ["g", "part"], "v", F.col("v"))
    assert rows(quantiles.percentiles(quantiles.combine(parts, ["g"], "part"), ["g"], (0.5, 0.99))) == sorted([("a", 200, 100, 198, 0), (None, 1, 7, 7, 0)], key=repr)
    assert rows(quantiles.percentiles(quantiles.summaries(df.where("false"), ["g"], "v", F.col("v")), ["g"], (0.5,))) == []
    assert rows(quantiles.percentiles(quantiles.summaries(df, [], "v", F.col("v")), [], (0.5,))) == [(201, 100, 0)]


@pytest.mark.parametrize(("kind", "values"), [("double", [0.2, 0.7, 0.9]), ("decimal(10,3)", [Decimal("0.200"), Decimal("0.700"), Decimal("0.900")]), ("decimal(30,2)", [Decimal("1.10"), Decimal("123456789012345678901234.56"), Decimal("999999999999999999999999.99")])])
def test_numbers_keep_their_kind(spark, rows, kind, values):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    out = quantiles.percentiles(quantiles.summaries(df, [], "v", F.col("v")), [], (0.5, 1.0))
    assert rows(out) == [(3, values[1], values[2], 0)] and out.schema["p50"].dataType.simpleString() == kind


def test_the_layout_of_rows_changes_nothing(spark, rows, monkeypatch):
    monkeypatch.setattr(quantiles, "CHUNK", 900)
    r = random.Random(5)
    data = [(i, "hot" if i % 3 else f"k{i % 5}", r.gauss(0, 1)) for i in range(12_000)]
    df = spark.createDataFrame(data, "id int, k string, v double")

    def answers(x):
        return rows(quantiles.percentiles(quantiles.summaries(x, ["k"], "v", F.col("id"), size=32), ["k"], QS))

    first = answers(df)
    assert all(a[-1] > 0 for a in first)
    for n in (1, 7, 64):
        assert answers(df.repartition(n)) == first
    assert answers(df.orderBy(F.rand(3))) == first
    for k, n, *values, error in first:
        own = np.array([v for _, x, v in data if x == k])
        for q, v in zip(QS, values, strict=True):
            lo, hi = ranks(own, v)
            assert n == len(own) and max(lo - math.ceil(q * n), math.ceil(q * n) - hi, 0) <= error < 0.2 * n
