import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import hierarchy


def brute(edges):
    """Cycles by walking everywhere; of nodes whose ancestry ends, the rows by each parent's least way, and all pairs."""
    ups = {}
    for c, p in edges:
        if c and p:
            ups.setdefault(c, set()).add(p)

    def above(n):
        dist, front, d = {}, {n}, 0
        while front:
            d += 1
            front = {p for x in front for p in ups.get(x, ())} - set(dist)
            dist |= {p: d for p in front}
        return dist

    reach = {n: above(n) for n in ups}
    on = {n for n in ups if n in reach[n]}
    cyc = {n: "in_cycle" if n in on else "under_cycle" for n in ups if n in on or on & set(reach[n])}
    tree = {n for n in ups if n not in cyc}

    def way(n):
        return [*way(min(ups[n])), n] if n in ups else [n]

    rows = set()
    for n in tree:
        for p in ups[n]:
            w = [*way(p), n]
            rows.add((n, w[0], len(w) - 1, tuple(w)))
    rows |= {(r[1], r[1], 0, (r[1],)) for r in rows}
    return rows, cyc, {(a, n, d) for n in tree for a, d in reach[n].items()}


def data(kind):
    r = random.Random(3)
    return {
        "empty": [],
        "odd": [("a", "a"), ("b", "a"), ("c", "d"), ("d", "c"), ("e", "c"), ("f", None), (None, "a"), ("g", ""), ("h", "i"), ("h", "i"), ("k/1", "h"), ("x/y", "k/1")],
        "chain": [(f"n{i:04d}", f"n{i + 1:04d}") for i in range(120)] + [("m0", "n0050")],
        "star": [(f"s{i}", "hub") for i in range(500)] + [("hub", "top")],
        "random": [(f"x{i}", f"x{r.randrange(300)}") for i in range(260)],
        "forked": [("m", "a"), ("m", "b"), ("b", "m"), ("u", "m"), ("v", "a"), ("v", "u"), ("s", "t"), ("s", "w"), ("t", "z"), ("w", "z"), ("q", "s"), ("q", "c1"), ("c1", "c2"), ("c2", "c1")],
        "graph": [(f"x{i}", f"x{r.randrange(60)}") for i in list(range(55)) + [3, 9, 9, 20, 31, 44]],
        "acyclic": [(f"x{i:02d}", f"x{r.randrange(i):02d}") for i in list(range(1, 60)) + [5, 9, 9, 20, 31, 44, 50, 51]],
    }[kind]


@pytest.mark.parametrize(("kind", "small"), [(k, False) for k in ("empty", "odd", "chain", "star", "random", "forked", "graph", "acyclic")] + [(k, True) for k in ("chain", "random", "graph", "acyclic")])
def test_against_brute_force(spark, monkeypatch, kind, small):
    if small:  # every way that large inputs take
        monkeypatch.setattr(hierarchy, "TASK_LINKS", 5)
        monkeypatch.setattr(hierarchy, "PATH_LINKS", 3)
        monkeypatch.setattr(hierarchy, "BAND", 4 if kind == "chain" else 2)
        if kind == "chain":
            monkeypatch.setattr(hierarchy, "BAND", 32)
    edges = data(kind)
    rows, cyc, pairs = brute(edges)
    df = spark.createDataFrame([(*e, "t", i, "extra") for i, e in enumerate(edges)], "c string, p string, scope string, made bigint, root string")
    found = hierarchy.resolve(hierarchy.links(df, F.col("c"), F.col("p"), "scope", "made"))
    got = [(r.node, r.root, r.depth, tuple(r.path)) for r in hierarchy.nodes(found).collect()]
    assert len(got) == len(set(got)) and set(got) == rows
    kinds = [tuple(r) for r in hierarchy.cycles(found).collect()]
    assert len(kinds) == len(cyc) and dict(kinds) == cyc
    assert {tuple(r) for r in hierarchy.descendants(found).collect()} == pairs


def test_every_link_stays(spark):
    df = spark.createDataFrame([("m", "a"), ("m", "b"), ("b", "m")], "c string, p string")
    found = hierarchy.resolve(hierarchy.links(df, F.col("c"), F.col("p")))
    assert {tuple(r) for r in hierarchy.cycles(found).collect()} == {("m", "in_cycle"), ("b", "in_cycle")}


def test_components():
    assert hierarchy._components([(0, 1), (1, 0), (2, 0), (3, 3)], 5) in ([0, 0, 1, 2, 3],)
