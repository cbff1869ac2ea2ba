import pytest
from pyspark.sql import functions as F

from graphloom.operators import features


def test_wide_equals_counting(spark):
    data = [("e1", "a b", 5, 10), ("e1", "a b", 7, None), ("e1", "a-b", 3, 2), ("e2", None, 1, 1), (None, "a b", 1, 1), ("e2", "z", None, None)]
    df = spark.createDataFrame(data, "e string, k string, t bigint, v bigint").withColumn("kind", F.lit("clash"))
    sparse = features.sparse_features(df, "e", [F.col("k")], "t", ["v"])
    assert sorted(tuple(r) for r in sparse.collect()) == [("e1", "a b", 2, 7, 10), ("e1", "a-b", 1, 3, 2), ("e2", "z", 1, None, None)]
    wide = {r.e: r.asDict() for r in features.wide_features(sparse, "e").collect()}
    assert set(wide) == {"e1", "e2"} and len(wide["e1"]) == 1 + 3 * 3
    assert wide["e1"]["a_b__n"] == 2 and wide["e1"]["a_b_1__n"] == 1 and wide["e1"]["a_b__total_v"] == 10 and wide["e2"]["a_b__n"] == 0 and wide["e2"]["z__last"] is None


def test_codes_are_shuffled(spark):
    """The vectors are grouped by integers, also with a dictionary of more kinds than the events have; one that lacks a kind is an error."""
    df = spark.createDataFrame([("e1", "a", "x", 1, 2), ("e1", "a", None, 3, 4), ("e2", None, "x", 5, None)], "e string, k string, l string, t bigint, v bigint")
    kinds = [F.col("k"), F.col("l")]
    more = features.kind_codes(df.union(df.withColumn("k", F.lit("0"))), kinds)
    assert [tuple(r) for r in more.orderBy("code").collect()] == [("0", 0), ("a", 1), ("x", 2)]
    sparse = features.sparse_features(df, "e", kinds, "t", ["v"], more)
    assert sorted(tuple(r) for r in sparse.collect()) == [("e1", "a", 2, 3, 6), ("e1", "x", 1, 1, 2), ("e2", "x", 1, 5, None)]
    plan = sparse._jdf.queryExecution().optimizedPlan().toString()
    grouped = [line for line in plan.splitlines() if "Aggregate [" in line]
    assert len(grouped) == 2 and all("kind" not in line.split("]")[0] and "__k" not in line.split("]")[0] for line in grouped)
    with pytest.raises(Exception, match="no code for the kind a"):
        features.sparse_features(df, "e", kinds, "t", ["v"], more.where("kind <> 'a'")).collect()


def test_latest_state(spark):
    data = [("k", 1, None, "early"), ("k", 1, 9, "done"), ("k", 1, 9, "done"), (None, 5, 5, "lost")]
    df = spark.createDataFrame(data, "id string, loaded int, ended int, what string")
    assert [tuple(r) for r in features.latest_state(df, "id", [F.col("loaded"), F.col("ended")], ["what", "ended"]).collect()] == [("done", 9)]


def test_empty(spark):
    df = spark.createDataFrame([], "e string, k string, t bigint, v bigint")
    assert features.wide_features(features.sparse_features(df, "e", [F.col("k")], "t", ["v"]), "e").collect() == []
