import base64
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import packing


def optimum(sizes, capacity):
    """Fewest containers, by trying every one for each item."""
    best = len(sizes)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for j in range(len(rooms)):
            if rooms[j] >= sizes[i]:
                place(i + 1, [*rooms[:j], rooms[j] - sizes[i], *rooms[j + 1 :]])
        place(i + 1, [*rooms, capacity - sizes[i]])

    sizes = sorted(sizes, reverse=True)
    place(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=0, max_size=9))
def test_small_packings_are_optimal(sizes):
    where = packing.pack(np.array(sizes, np.int64), 30, None).where
    loads = np.bincount(where, weights=sizes) if sizes else np.array([])
    assert len(where) == len(sizes) and (loads <= 30).all() and len(loads) == optimum(sizes, 30)


@pytest.mark.parametrize("seed", range(12))
def test_thirty_items_are_optimal(seed):
    """Containers cut at random: as many as were cut are needed, and best fit often takes more."""
    r = random.Random(seed)
    bins, sizes, capacity = 9, [], 1000
    for b in range(bins):
        cuts = sorted(r.sample(range(1, 10), 3 if b < 3 else 2))
        edges = [0, *(c * 100 + r.randrange(-40, 40) for c in cuts), capacity]
        sizes += [y - x for x, y in zip(edges, edges[1:], strict=False)]
    assert len(sizes) == 30
    p = packing.pack(np.array(sizes), capacity, None)
    assert p.proven and p.contexts == bins == p.least and np.bincount(p.where, weights=sizes).max() <= capacity


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=10))
def test_lower_bound(sizes):
    assert packing.least_contexts(np.array(sizes), 40) <= optimum(sizes, 40)


def test_proof_above_the_bound():
    """No two fit together though the sum would allow it: the search proves what the bound can't."""
    p = packing.pack(np.array([34, 34, 34, 34, 17, 17, 17, 15]), 50, None)
    assert p.proven and p.contexts == optimum([34, 34, 34, 34, 17, 17, 17, 15], 50)


def undominated(sizes, room):
    """All sets that fit and can't be bettered by one size added or put for a smaller one, by trying every subset."""
    out = set()
    for bits in range(1 << len(sizes)):
        chosen = [s for i, s in enumerate(sizes) if bits >> i & 1]
        left = [s for i, s in enumerate(sizes) if not bits >> i & 1]
        waste = room - sum(chosen)
        if waste >= 0 and not any(s <= waste for s in left) and not any(0 < s - c <= waste for s in left for c in chosen):
            out.add(tuple(sorted(chosen, reverse=True)))
    return out


def completed(sizes, room, most):
    pool = packing._Pool(sizes)
    return list(packing.completions(pool, np.array(pool.keys, np.int64), room, most))


def test_deep_completion():
    """The exact filling has a third size that is not the largest that fits."""
    assert (20, 20, 13, 7) in completed([20, 20, 19, 13, 7], 60, 40)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 25), min_size=1, max_size=9), st.integers(1, 60))
def test_all_completions(sizes, room):
    got = completed(sizes, room, 1000)
    assert len(set(got)) == len(got) and set(got) == undominated(sizes, room)
    assert [sum(c) for c in got] == sorted((sum(c) for c in got), reverse=True)


def test_better_than_best_fit():
    """Best fit takes four containers here, bin completion three."""
    sizes = np.array([44, 24, 24, 22, 21, 17, 8, 8, 6, 6])
    assert len(set(packing.pack(sizes, 60).where)) == 3


def test_many(monkeypatch):
    r = random.Random(5)
    sizes = np.array([min(2047, max(1, int(r.lognormvariate(5.2, 0.9)))) for _ in range(5000)])
    where = packing.pack(sizes, 2048).where
    loads = np.bincount(where, weights=sizes)
    assert (loads <= 2048).all() and loads.sum() == sizes.sum() and len(loads) <= -(-sizes.sum() // 2048) + 1


def test_texts(spark):
    data = [(1, 25, "x"), (2, 10, "x"), (3, 0, "x"), (4, None, "x"), (5, 7, "x"), (6, 3, "x"), (6, 3, "x"), (None, 5, "x")]
    df = spark.createDataFrame(data, "id bigint, n int, part string")
    got = [tuple(r) for r in packing.pack_texts(df, "id", "n", 10).collect()]
    by = {}
    for k, part, at, n, c in got:
        by.setdefault(c, []).append(n)
        assert at == part * 10
    assert sorted((k, part, n) for k, part, _, n, _ in got) == [(1, 0, 10), (1, 1, 10), (1, 2, 5), (2, 0, 10), (3, 0, 0), (4, 0, 0), (5, 0, 7), (6, 0, 3), (6, 0, 3)]
    assert all(sum(v) <= 10 for c, v in by.items() if c) and len([c for c in by if c]) == 5
    assert packing.pack_texts(df.where("false"), "id", "n", 10).collect() == []


def test_a_hot_key_is_spread(spark):
    df = spark.createDataFrame([(1, 30 + i % 7) for i in range(900)] + [(1, 25)] * 300 + [(2, 260)] * 3, "id bigint, n int")
    got = packing.pack_texts(df, "id", "n", 100, group_rows=100)
    rows = got.collect()
    assert len(rows) == 900 + 300 + 9 and len({r.context_id.split("-")[0] for r in rows if not r.context_id.startswith("full")}) > 8
    loads = {}
    for r in rows:
        loads[r.context_id] = loads.get(r.context_id, 0) + r.n_tokens
    assert max(loads.values()) <= 100 and sum(loads.values()) == sum(r.n for r in df.collect())
    report = packing.pack_report(df, "id", "n", 100, group_rows=100).collect()
    assert sum(r.contexts for r in report) + 6 == len(loads) and all(r.least <= r.contexts <= r.best_fit for r in report)


def test_token_counts(spark, tmp_path):
    vocabulary = tmp_path / "v.tiktoken"
    vocabulary.write_bytes(b"\n".join(base64.b64encode(bytes([i])) + b" %d" % i for i in range(256)) + b"\n" + base64.b64encode(b"ab") + b" 256\n")
    df = spark.createDataFrame([(1, "abab c", 9), (2, None, 9), (3, "", 9), (4, "é<|endoftext|>", 9), (5, "ab" * 30_000, 9)], "id bigint, t string, out int")
    got = {r.id: (r.n_tokens, r.out) for r in packing.token_counts(df, "t", str(vocabulary)).collect()}
    assert got == {1: (4, 9), 2: (0, 9), 3: (0, 9), 4: (15, 9), 5: (30_000, 9)}


@pytest.mark.parametrize("sizes", [[], [1], [10] * 7, [9, 1] * 20])
def test_edges(sizes):
    assert len(set(packing.pack(np.array(sizes, np.int64), 10).where)) == -(-sum(sizes) // 10)
