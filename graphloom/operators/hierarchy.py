"""Parent-child links to hierarchies: root, depth, path and descendants of each node, and cycles.

Links made near each other in one scope share a partition. Each partition unites its links to weighted
disjoint sets: a child has its local root and its offset from it, and a link whose parent is already
below the child closes a cycle. Only children that are local roots elsewhere are left to merge; that
contracted graph is united in the same way by one task where a measured count allows it, else resolved by
doubling pointers. Paths are then made by walking an index of each tree from its root.

A node may have several parents. Such nodes are held out of the sets, which end at them, and the graph
of these junctions, which is no larger than their links, is searched for cycles by itself. No link is
left aside.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.session import checkpoint, round_checkpoint, shuffle_partitions, small

#: Links that one task may take.
TASK_LINKS = 500_000
#: Links of a tree that one task may hold to walk it; larger trees are put together from segments.
PATH_LINKS = 50_000
#: Depth of a band of such a tree.
BAND = 256

LINK = "child string, parent string"
RESOLVED = "child string, root string, offset bigint, endless boolean"


@dataclass(frozen=True)
class Links:
    """single: (child, parent, scope, made) of children with one parent; several: (child, parent), each parent of the others, or None if there are none."""

    single: DataFrame
    several: DataFrame | None

    def all(self) -> DataFrame:
        one = self.single.select("child", "parent")
        return one if self.several is None else one.unionByName(self.several)


def links(df: DataFrame, child: Column, parent: Column, scope: str | None = None, made: str | None = None) -> Links:
    """The links of a table, each once. Rows with a null or empty child or parent link nothing.

    scope and made only lay the links out: those of one scope made near each other are likely to meet.
    """
    rows = df.select(child.alias("child"), parent.alias("parent"), (F.col(scope) if scope else F.lit(None)).cast("string").alias("scope"), (F.col(made) if made else F.lit(None)).cast("bigint").alias("made"))
    rows = rows.where("child <> '' and parent <> ''")
    by = rows.groupBy("child").agg(F.min("parent").alias("parent"), F.max("parent").alias("other"), F.min("scope").alias("scope"), F.min("made").alias("made"))
    by = checkpoint(by)
    forked = by.where("parent <> other").select("child")
    n = forked.count()
    several = checkpoint(rows.join(small(forked, n), "child", "left_semi").select("child", "parent").distinct()) if n else None
    return Links(by.where("parent = other").drop("other"), several)


class Sets:
    """Weighted disjoint sets of links, of which each child has one: its set's root, its offset from it, and the links that close a cycle."""

    def __init__(self, child: pd.Series, parent: pd.Series, weight: np.ndarray):
        n = len(child)
        codes, names = pd.factorize(pd.concat([child, parent], ignore_index=True))
        self.names = np.asarray(names, dtype=object)
        self.child, self.parent = codes[:n].tolist(), codes[n:].tolist()
        self.up, self.off = list(range(len(names))), [0] * len(names)
        self.closed: dict[int, int] = {}
        for c, p, w in zip(self.child, self.parent, weight.tolist(), strict=True):
            self.unite(c, p, w)
        self.root = [self.find(c) for c in self.child]

    def find(self, x: int) -> int:
        up, off, way = self.up, self.off, []
        while up[x] != x:
            way.append(x)
            x = up[x]
        for y in reversed(way[:-1]):
            off[y] += off[up[y]]
            up[y] = x
        return x

    def unite(self, c: int, p: int, w: int) -> None:
        root = self.find(p)
        if root == c:
            self.closed[c] = p
        else:
            self.up[c], self.off[c] = root, w + self.off[p]

    def table(self) -> pd.DataFrame:
        return pd.DataFrame({"child": self.names[self.child], "root": self.names[self.root], "offset": [self.off[c] for c in self.child], "endless": [r in self.closed for r in self.root]})


def _whole(batches: Iterator[pd.DataFrame]) -> pd.DataFrame | None:
    held = [b for b in batches if len(b)]
    return pd.concat(held, ignore_index=True) if held else None


def _local(single: DataFrame, size: int) -> DataFrame:
    """Partition-local sets: (child, parent, root, offset, endless)."""
    n = max(shuffle_partitions(single.sparkSession), -(-single.count() // size))
    laid = single.repartitionByRange(n, "scope", "made", "child").select("child", "parent")

    def unite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if (pdf := _whole(batches)) is not None:
            yield Sets(pdf.child, pdf.parent, np.ones(len(pdf), np.int64)).table().assign(parent=pdf.parent)

    return checkpoint(laid.mapInPandas(unite, f"{LINK}, root string, offset bigint, endless boolean").select("child", "parent", "root", "offset", "endless"))


def _doubled(inter: DataFrame) -> DataFrame:
    """Follows (child, root, offset, endless) among themselves by doubling; what is left after enough rounds is endless."""
    n = inter.count()
    state = inter.withColumn("open", ~F.col("endless"))
    for _ in range(n.bit_length() + 1):
        b = state.select(F.col("child").alias("root"), F.col("root").alias("r2"), F.col("offset").alias("o2"), F.col("endless").alias("e2"), F.col("open").alias("open2"))
        to, done = state.where("open"), state.where("not open")
        on = to.join(b, "root", "left")
        found = F.col("r2").isNotNull()
        on = on.select("child", F.coalesce("r2", "root").alias("root"), (F.col("offset") + F.coalesce("o2", F.lit(0))).alias("offset"), F.coalesce("e2", F.lit(False)).alias("endless"), (found & F.col("open2") & ~F.col("e2")).alias("open"))
        state = round_checkpoint(on.unionByName(done))
        if not state.where("open").limit(1).count():
            break
    return state.select("child", "root", "offset", (F.col("endless") | F.col("open")).alias("endless"))


def _merged(inter: DataFrame) -> tuple[DataFrame, int]:
    """The contracted graph, resolved, and its size."""
    inter = checkpoint(inter)
    n = inter.count()
    if n > TASK_LINKS:
        return _doubled(inter), n

    def unite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if (pdf := _whole(batches)) is not None:
            # a link that is endless already leads to itself
            yield Sets(pdf.child, pdf.root.where(~pdf.endless, pdf.child), pdf.offset.to_numpy()).table()

    return inter.coalesce(1).mapInPandas(unite, RESOLVED), n


def _trees(single: DataFrame) -> DataFrame:
    """Children of one parent, up to where their way ends or forks: (child, parent, root, depth, endless)."""
    local = _local(single, TASK_LINKS)
    roots = local.where("not endless").select(F.col("root").alias("child")).distinct()
    merged, n = _merged(local.join(roots, "child", "left_semi").drop("parent"))
    above = merged.select(F.col("child").alias("root"), F.col("root").alias("r2"), F.col("offset").alias("o2"), F.col("endless").alias("e2"))
    full = local.join(small(above, n), "root", "left")
    return full.select("child", "parent", F.coalesce("r2", "root").alias("root"), (F.col("offset") + F.coalesce("o2", F.lit(0))).alias("depth"), (F.col("endless") | F.coalesce("e2", F.lit(False))).alias("endless"))


def _components(edges: list[tuple], nodes: int) -> list[int]:
    """Strongly connected component of each node, numbered so that a component's successors have lower numbers."""
    out: list[list[int]] = [[] for _ in range(nodes)]
    for a, b in edges:
        out[a].append(b)
    seen, low, comp, stack, n = [-1] * nodes, [0] * nodes, [-1] * nodes, [], 0
    count = 0
    for top in range(nodes):
        if seen[top] >= 0:
            continue
        work = [(top, 0)]
        while work:
            x, i = work.pop()
            if i == 0:
                seen[x] = low[x] = n
                n += 1
                stack.append(x)
            else:
                low[x] = min(low[x], low[out[x][i - 1]])
            while i < len(out[x]):
                y = out[x][i]
                i += 1
                if seen[y] < 0:
                    work += [(x, i), (y, 0)]
                    break
                if comp[y] < 0:
                    low[x] = min(low[x], seen[y])
            else:
                if low[x] == seen[x]:
                    while comp[x] < 0:
                        comp[stack.pop()] = count
                    count += 1
    return comp


def _searched(edges: DataFrame, n: int) -> DataFrame:
    """Of a graph (child, parent): (node, endless, group) for every child. group is the same for nodes that lie on a cycle together, null for nodes on none."""
    if n > TASK_LINKS:
        return _colored(edges)

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if (pdf := _whole(batches)) is not None:
            codes, names = pd.factorize(pd.concat([pdf.child, pdf.parent], ignore_index=True))
            pairs = list(zip(codes[: len(pdf)].tolist(), codes[len(pdf) :].tolist(), strict=True))
            comp = _components(pairs, len(names))
            cyclic, endless = {comp[a] for a, b in pairs if comp[a] == comp[b]}, {}
            for a, b in sorted(pairs, key=lambda e: comp[e[0]]):
                endless[comp[a]] = endless.get(comp[a], False) or comp[a] in cyclic or endless.get(comp[b], False)
            nodes = sorted({a for a, _ in pairs})
            yield pd.DataFrame({"node": [names[a] for a in nodes], "endless": [endless[comp[a]] for a in nodes], "group": [str(comp[a]) if comp[a] in cyclic else None for a in nodes]})

    return edges.coalesce(1).mapInPandas(one, "node string, endless boolean, `group` string")


def _colored(edges: DataFrame) -> DataFrame:
    """As _searched(), for graphs that no task can hold.

    Nodes whose parents all end are taken off until none is left to take; of the rest, and then of what is
    still undecided, each node learns the greatest node above it, and that node's group are those of its
    kind that it reaches again.
    """
    left = checkpoint(edges.distinct())
    before = -1
    while (n := left.count()) != before:
        before = n
        left = round_checkpoint(left.join(left.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi").select("child", "parent"))
    rest, groups = left, None
    while rest.limit(1).count():
        color = rest.select(F.col("child").alias("node")).unionByName(rest.select(F.col("parent").alias("node"))).distinct().select("node", F.col("node").alias("color"))
        color = _spread(color, rest, lambda c, e: c.select(F.col("node").alias("parent"), "color").join(e, "parent").select(F.col("child").alias("node"), "color"))
        named = rest.join(color.withColumnsRenamed({"node": "child", "color": "a"}), "child").join(color.withColumnsRenamed({"node": "parent", "color": "b"}), "parent").where("a = b").select("child", "parent", F.col("a").alias("color"))
        held = color.where("node = color")
        while True:
            more = named.join(held.select(F.col("node").alias("child"), "color"), ["child", "color"]).select(F.col("parent").alias("node"), "color")
            wider = round_checkpoint(held.unionByName(more).distinct())
            if wider.count() == held.count():
                break
            held = wider
        looped = rest.where("child = parent").select(F.col("child").alias("node")).distinct().withColumn("loop", F.lit(True))
        sized = held.join(held.groupBy("color").count(), "color").join(looped, "node", "left").where("count > 1 or loop").select("node", F.col("color").alias("group"))
        groups = sized if groups is None else groups.unionByName(sized)
        done = held.select("node")
        rest = round_checkpoint(rest.join(done.select(F.col("node").alias("child")), "child", "left_anti").join(done.select(F.col("node").alias("parent")), "parent", "left_anti").select("child", "parent"))
    nodes = edges.select(F.col("child").alias("node")).distinct()
    endless = left.select(F.col("child").alias("node")).distinct().withColumn("e", F.lit(True))
    out = nodes.join(endless, "node", "left").select("node", F.coalesce("e", F.lit(False)).alias("endless"))
    return out.withColumn("group", F.lit(None).cast("string")) if groups is None else out.join(groups, "node", "left")


def _spread(color: DataFrame, edges: DataFrame, step) -> DataFrame:
    """Greatest colors, passed along links until none changes."""
    color, before = round_checkpoint(color), None
    while True:
        color = round_checkpoint(color.unionByName(step(color, edges)).groupBy("node").agg(F.max("color").alias("color")))
        now = color.agg(F.sum(F.xxhash64("node", "color") % 1_000_003), F.count(F.lit(1))).first()
        if now == before:
            return color
        before = now


@dataclass(frozen=True)
class Resolved:
    """nodes: (child, parent, root, depth, endless), one row for each link. Where endless is true the child's ancestry never ends, by this parent or another, and root
    and depth are null. Root and depth of a node with several parents go, by each link, by the least parents above it.

    groups: (node, group) of junctions that lie on cycles, or None; main: (child, parent) with one parent each."""

    nodes: DataFrame
    groups: DataFrame | None
    junctions: DataFrame | None


def resolve(lk: Links) -> Resolved:
    """Root and depth of each child of links(). An empty table gives no rows."""
    trees = _trees(lk.single)
    if lk.several is None:
        shown = [F.when(~F.col("endless"), F.col(c)).alias(c) for c in ("root", "depth")]
        return Resolved(trees.select("child", "parent", *shown, "endless"), None, None)
    trees = checkpoint(trees)
    to = trees.select(F.col("child").alias("parent"), F.col("root").alias("t"), F.col("endless").alias("e"))
    forks = lk.several.join(to, "parent", "left").select("child", "parent", F.coalesce("t", "parent").alias("top"), F.coalesce("e", F.lit(False)).alias("e"))
    forks = checkpoint(forks)
    # a junction below a cycle of single parents is endless: its link leads to a loop of its own
    loop = F.concat(F.lit("\0loop "), "top")
    graph = forks.select("child", F.when(F.col("e"), loop).otherwise(F.col("top")).alias("parent"))
    graph = checkpoint(graph.unionByName(forks.where("e").select(loop.alias("child"), loop.alias("parent"))).distinct())
    found = checkpoint(_searched(graph, graph.count()))
    bad = found.where("endless").select(F.col("node").alias("root"), F.lit(True).alias("bad"))
    single = trees.join(bad, "root", "left").select("child", "parent", (F.col("endless") | F.coalesce("bad", F.lit(False))).alias("endless"))
    forked = lk.several.join(found.select(F.col("node").alias("child"), "endless"), "child")
    every = checkpoint(single.unionByName(forked))
    # the rest has no cycle: the least parent of each gives trees
    ends = every.where("not endless").groupBy("child").agg(F.min("parent").alias("parent"))
    main = checkpoint(_trees(ends.select("child", "parent", F.lit(None).cast("string").alias("scope"), F.lit(None).cast("bigint").alias("made"))))
    above = main.select(F.col("child").alias("parent"), "root", "depth")
    tree = every.join(above, "parent", "left").select("child", "parent", F.when(~F.col("endless"), F.coalesce("root", "parent")).alias("root"), F.when(~F.col("endless"), F.coalesce("depth", F.lit(0)) + 1).alias("depth"), "endless")
    return Resolved(tree, found.where("`group` is not null").select("node", "group"), forks)


def cycles(resolved: Resolved) -> DataFrame:
    """Endless nodes: (node, case_kind), in_cycle for a node that is its own ancestor, under_cycle for one below."""
    x = checkpoint(resolved.nodes.where("endless").select("child", "parent"))
    n = x.count()
    kind = F.when(F.col("on"), "in_cycle").otherwise("under_cycle").alias("case_kind")
    if n <= TASK_LINKS and resolved.junctions is None:

        def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            if (pdf := _whole(batches)) is not None:
                sets = Sets(pdf.child, pdf.parent, np.ones(len(pdf), np.int64))
                parent = dict(zip(sets.child, sets.parent, strict=True))
                on = set(sets.closed)
                for top, at in sets.closed.items():  # from the parent that closed it up to the root
                    while at != top:
                        on.add(at)
                        at = parent[at]
                yield pd.DataFrame({"node": pdf.child, "case_kind": ["in_cycle" if c in on else "under_cycle" for c in sets.child]})

        return x.coalesce(1).mapInPandas(walk, "node string, case_kind string")
    if n <= TASK_LINKS:
        return _searched(x, n).where("endless").select("node", F.col("group").isNotNull().alias("on")).select("node", kind)
    nodes = x.select(F.col("child").alias("node")).distinct()
    several = x.groupBy("child").count().where("count > 1").select("child") if resolved.junctions is not None else x.select("child").limit(0)
    state, before = x.join(several, "child", "left_anti").select("child", F.col("parent").alias("up")), -1
    marked = None
    if resolved.groups is not None:
        g = resolved.groups
        ways = resolved.junctions.where("not e").join(g.withColumnsRenamed({"node": "child", "group": "a"}), "child").join(g.withColumnsRenamed({"node": "top", "group": "b"}), "top").where("a = b")
        marked = round_checkpoint(ways.select(F.col("parent").alias("child")).unionByName(g.select(F.col("node").alias("child"))).distinct())
    for _ in range(n.bit_length() + 1):
        if marked is not None:  # all nodes between two junctions of one cycle
            marked = round_checkpoint(marked.unionByName(marked.join(state, "child").select(F.col("up").alias("child"))).distinct())
        nxt = state.join(state.select(F.col("child").alias("up"), F.col("up").alias("u2")), "up").select("child", F.col("u2").alias("up"))
        state = round_checkpoint(nxt)
        on = state.select(F.col("up").alias("child")).distinct()
        if (count := (on.count(), marked.count() if marked is not None else 0)) == before:
            break
        before = count
    on = on.unionByName(marked).distinct() if marked is not None else on
    return nodes.join(on.select(F.col("child").alias("node"), F.lit(True).alias("on")), "node", "left").select("node", kind)


def nodes(resolved: Resolved) -> DataFrame:
    """All nodes whose ancestry ends, with (node, root, depth, path); path is an array from the root to the node.

    Roots have depth 0. A node of several parents has a row for each link to one, by the path of that
    parent; nodes below it go by its least parent.
    """
    tree = resolved.nodes.where("not endless")
    tops = tree.select("root").distinct()
    if resolved.junctions is None:
        made = _paths(tree)
    else:
        tree = checkpoint(tree)
        least = tree.groupBy("child").agg(F.min_by(F.struct("parent", "root", "depth"), "parent").alias("l")).select("child", "l.*")
        made = checkpoint(_paths(least))
        extra = tree.join(least.select("child", "parent"), ["child", "parent"], "left_anti")
        made = made.unionByName(_beyond(extra, made))
    return made.select(F.col("child").alias("node"), "root", "depth", "path").unionByName(tops.select(F.col("root").alias("node"), "root", F.lit(0).cast("bigint").alias("depth"), F.array("root").alias("path")))


def _beyond(extra: DataFrame, made: DataFrame) -> DataFrame:
    """Links outside the trees, by their parents' paths; a parent without a path is a root."""
    above = made.select(F.col("child").alias("parent"), F.col("path").alias("p"))
    return extra.join(above, "parent", "left").select("child", "root", "depth", F.concat(F.coalesce("p", F.array("parent")), F.array("child")).alias("path"))


def _paths(tree: DataFrame) -> DataFrame:
    """Paths of trees (child, parent, root, depth), as (child, root, depth, path).

    A tree's links meet in one task, which walks it from the root; no path is shuffled. Trees that a task
    shouldn't hold are put together from segments.
    """
    tree = checkpoint(tree.select("child", "parent", "root", "depth"))
    large = checkpoint(tree.groupBy("root").count().where(F.col("count") > PATH_LINKS).select("root"))
    n = large.count()
    schema = "child string, root string, depth bigint, path array<string>"

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        root, below = None, {}

        def paths() -> Iterator[pd.DataFrame]:
            out, size, way, work = [], 0, [root], [iter(below.get(root, ()))]
            while work:
                x = next(work[-1], None)
                if x is None:
                    work.pop()
                    way.pop()
                    continue
                way.append(x)
                out.append((x, root, len(way) - 1, list(way)))
                size += len(way)
                if x in below:
                    work.append(iter(below[x]))
                else:
                    way.pop()
                if size > 100_000:
                    yield pd.DataFrame(out, columns=["child", "root", "depth", "path"])
                    out, size = [], 0
            if out:
                yield pd.DataFrame(out, columns=["child", "root", "depth", "path"])

        for pdf in batches:
            for c, p, r in zip(pdf.child, pdf.parent, pdf.root, strict=True):
                if r != root:
                    if below:
                        yield from paths()
                    root, below = r, {}
                below.setdefault(p, []).append(c)
        if below:
            yield from paths()

    light = tree.join(small(large, n), "root", "left_anti") if n else tree
    out = light.repartition("root").sortWithinPartitions("root").mapInPandas(walk, schema)
    return out.unionByName(_large_paths(tree.join(small(large, n), "root", "left_semi"))) if n else out


def _large_paths(tree: DataFrame) -> DataFrame:
    """As _paths(), by depth: links are cut into bands of depth, and the segments of a band hang on the nodes that end the band above.

    Within a band, pointers and segments are doubled; a path is met once by each band it runs through.
    """
    deepest = tree.agg(F.max("depth")).first()[0]
    state = checkpoint(tree.select("child", "parent", "root", "depth", F.expr(f"(depth - 1) div {BAND}").alias("band"), F.col("parent").alias("top"), F.array("child").alias("seg")))
    reach = 1
    while reach < min(BAND, deepest):  # segments of up to twice as many links, within the band
        up = state.select(F.col("child").alias("top"), F.col("top").alias("t2"), F.col("seg").alias("s2"), "band")
        open_ = (F.col("depth") - 1) % BAND >= reach
        on = state.where(open_).join(up, ["top", "band"]).select("child", "parent", "root", "depth", "band", F.col("t2").alias("top"), F.concat("s2", "seg").alias("seg"))
        state = round_checkpoint(on.unionByName(state.where(~open_).select(*on.columns)))
        reach *= 2
    path = ["child", "root", "depth", "band"]
    out = ends = state.where("band = 0").select(*path, F.concat(F.array("top"), "seg").alias("path"))
    for b in range(1, (deepest - 1) // BAND + 1):
        above = ends.where(F.col("depth") % BAND == 0).select(F.col("child").alias("top"), "path")
        ends = round_checkpoint(state.where(F.col("band") == b).join(above, "top").select(*path, F.concat("path", "seg").alias("path")))
        out = out.unionByName(ends)
    return out.select("child", "root", "depth", "path")


def descendants(resolved: Resolved) -> DataFrame:
    """(ancestor, descendant, distance) for every two nodes of which one is above the other, with their least distance."""
    made = nodes(resolved).where("depth > 0")
    steps = made.select(F.col("node").alias("descendant"), "depth", F.posexplode("path").alias("at", "ancestor"))
    pairs = steps.where("at < depth").select("ancestor", "descendant", (F.col("depth") - F.col("at")).cast("bigint").alias("distance"))
    if resolved.junctions is None:
        return pairs
    # through several parents: what is above a junction by any link is above all below it
    least = F.min("distance").alias("distance")
    pairs = round_checkpoint(pairs.groupBy("ancestor", "descendant").agg(least))
    forked = resolved.junctions.select(F.col("child").alias("mid")).distinct()
    below = pairs.join(forked.withColumnRenamed("mid", "ancestor"), "ancestor", "left_semi").select(F.col("ancestor").alias("mid"), "descendant", F.col("distance").alias("d2"))
    before = None
    while True:
        above = pairs.select("ancestor", F.col("descendant").alias("mid"), F.col("distance").alias("d1"))
        more = above.join(below, "mid").select("ancestor", "descendant", (F.col("d1") + F.col("d2")).alias("distance"))
        pairs = round_checkpoint(pairs.unionByName(more).groupBy("ancestor", "descendant").agg(least))
        now = pairs.agg(F.count(F.lit(1)), F.sum("distance")).first()
        if now == before:
            return pairs
        before = now
