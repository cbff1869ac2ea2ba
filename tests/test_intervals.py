from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from graphloom.operators import intervals

SCHEMA = "e string, s bigint, t bigint, entity string, __start int"


def brute(data):
    by = {}
    for e, s, t, *_ in data:
        if None not in (e, s, t) and t >= s:
            by.setdefault(e, []).append((s, t))
    gaps, periods = [], []
    for e, spans in by.items():
        spans.sort()
        start, end, n = *spans[0], 1
        for s, t in spans[1:]:
            if s > end:
                gaps.append((e, end, s))
                periods.append((e, start, end, n))
                start, end, n = s, t, 0
            end, n = max(end, t), n + 1
        periods.append((e, start, end, n))
    return sorted(gaps), sorted(periods)


def check(spark, rows, data):
    df = spark.createDataFrame([(*r, "x", 1) for r in data], SCHEMA).repartition(3)
    gaps, periods = brute(data)
    assert rows(intervals.gaps(df, "e", "s", "t")) == sorted(gaps, key=repr)
    assert rows(intervals.periods(df, "e", "s", "t")) == sorted(periods, key=repr)


def test_nulls_ties_and_repeated_rows(spark, rows):
    check(spark, rows, [("a", 1, 5), ("a", 1, 5), ("a", 5, 5), ("a", 6, 6), ("a", None, 3), ("a", 9, None), (None, 1, 2), ("a", 9, 8), ("b", 0, 100), ("b", 3, 4), ("b", 200, 200)])


def test_empty(spark, rows):
    check(spark, rows, [])


def test_one_entity_over_all_partitions(spark, rows):
    check(spark, rows, [("hot", i * 7 % 1000, i * 7 % 1000 + (400 if i == 5 else i % 9)) for i in range(600)])


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(0, 60), st.one_of(st.none(), st.integers(0, 70))), max_size=60))
def test_random(spark, rows, data):
    check(spark, rows, data)
