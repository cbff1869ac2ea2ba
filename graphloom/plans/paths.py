"""Property paths: automata for closures, and their evaluation as a frontier that moves over edges."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.plans.algebra import PAlt, PInv, PIri, PNot, PRepeat, PSeq
from graphloom.plans.values import TERM
from graphloom.session import BROADCAST_ROWS, checkpoint, round_checkpoint, small


class PathCeiling(RuntimeError):
    """A traversal grew beyond its limit; nothing is returned in part."""


#: Kind of term that says a walk met its ceiling.
STOPPED = -1


@dataclass
class Limits:
    rounds: int = 10_000
    visited: int = 2_000_000_000


@dataclass(frozen=True)
class Step:
    """What a transition consumes: an edge of these predicates (all but them if negated), against its direction if inverse."""

    predicates: tuple[str, ...]
    negated: bool
    inverse: bool


@dataclass
class Automaton:
    """Transitions without empty moves, from state to state; state 0 starts."""

    transitions: list[tuple[int, Step, int]] = field(default_factory=list)
    accepting: frozenset[int] = frozenset()

    @property
    def empty(self) -> bool:
        return 0 in self.accepting


def compile_path(path) -> Automaton:
    """An automaton for a path; directions are pushed down to the steps, so inverse sequences run backwards."""
    moves: list[tuple[int, Step | None, int]] = []
    states = 0

    def new() -> int:
        nonlocal states
        states += 1
        return states - 1

    def build(p, a: int, b: int, inverse: bool) -> None:
        match p:
            case PIri(iri):
                moves.append((a, Step((iri,), False, inverse), b))
            case PInv(inner):
                build(inner, a, b, not inverse)
            case PSeq(x, y):
                mid = new()
                build(y if inverse else x, a, mid, inverse)
                build(x if inverse else y, mid, b, inverse)
            case PAlt(x, y):
                build(x, a, b, inverse)
                build(y, a, b, inverse)
            case PNot():
                if p.has_forward:
                    moves.append((a, Step(p.forward, True, inverse), b))
                if p.has_inverse:
                    moves.append((a, Step(p.inverse, True, not inverse), b))
            case PRepeat(inner, least, many):
                i, j = new(), new()
                moves.append((a, None, i))
                build(inner, i, j, inverse)
                moves.append((j, None, b))
                if many:
                    moves.append((j, None, i))
                if not least:
                    moves.append((a, None, b))

    start, end = new(), new()
    build(path, start, end, False)

    def reach(q: int) -> set[int]:
        seen, todo = {q}, [q]
        while todo:
            at = todo.pop()
            for x, step, y in moves:
                if x == at and step is None and y not in seen:
                    seen.add(y)
                    todo.append(y)
        return seen

    out, accepting, number, todo = [], set(), {start: 0}, [start]
    while todo:
        q = todo.pop(0)
        near = reach(q)
        if end in near:
            accepting.add(number[q])
        for x, step, y in moves:
            if x in near and step is not None:
                if y not in number:
                    number[y] = len(number)
                    todo.append(y)
                out.append((number[q], step, number[y]))
    return Automaton(list(dict.fromkeys(out)), frozenset(accepting))


def labelled(edges: DataFrame, automaton: Automaton) -> DataFrame:
    """Edges (s, p, o, g) as moves (node, q, to, q2, g) of the automaton."""

    def wanted(step: Step) -> Column:
        return ~F.col("p").isin(*step.predicates) if step.negated and step.predicates else F.lit(True) if step.negated else F.col("p").isin(*step.predicates)

    out = None
    for q, step, q2 in automaton.transitions:
        a, b = ("o", "s") if step.inverse else ("s", "o")
        part = edges.where(wanted(step)).select(F.col(a).alias("node"), F.lit(q).alias("q"), F.col(b).alias("to"), F.lit(q2).alias("q2"), "g")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def traverse(seeds: DataFrame, edges: DataFrame, automaton: Automaton, limits: Limits | None = None) -> DataFrame:
    """Pairs (origin, node, g) that a path from a seed (origin, g) leads to, each once.

    Where a count shows that the moves may be broadcast, each task walks them from its own seeds. Else the
    frontier of all walks is moved over the edges in rounds, each kept by a written table; it is broadcast
    only where its count allows it. Only seeds that have a first move walk; of the others a path that may
    be empty leads to themselves. g must match, so a walk in a named graph never leaves it; for the default
    graph it is one constant. Hot vertices are left to the split of skewed partitions.
    """
    limits = limits or Limits()
    moves = checkpoint(labelled(edges, automaton))
    seeds = seeds.select("origin", "g").distinct()
    if moves.count() <= BROADCAST_ROWS:
        pairs = checkpoint(_walked(seeds, moves, automaton, limits))
        n, stopped = pairs.agg(F.count(F.lit(1)), F.bool_or(F.col("origin.k") == STOPPED)).first()
        if stopped or n > limits.visited:
            raise PathCeiling(f"path stopped after {limits.rounds} rounds or {limits.visited} states")
        return pairs
    first = moves.where("q = 0").select(F.col("node").alias("origin"), "g").distinct()
    frontier = checkpoint(seeds.join(first, ["origin", "g"], "left_semi").select("origin", F.col("origin").alias("node"), F.lit(0).alias("q"), "g"))
    visited, count = frontier, frontier.count()
    total, rounds = count, 0
    columns = ["origin", "node", "q", "g"]
    while count:
        rounds += 1
        if rounds > limits.rounds or total > limits.visited:
            raise PathCeiling(f"path stopped after {rounds} rounds with {total} states")
        step = moves.join(small(frontier, count), ["node", "q", "g"]).select("origin", F.col("to").alias("node"), F.col("q2").alias("q"), "g").distinct()
        frontier = round_checkpoint(step.join(visited, columns, "left_anti"))
        count = frontier.count()
        total += count
        visited = visited.unionByName(frontier)
        if rounds % 8 == 0:
            visited = round_checkpoint(visited)
    walked = visited.where(F.col("q").isin(*automaton.accepting)).select("origin", "node", "g")
    if automaton.empty:
        walked = walked.unionByName(seeds.select("origin", F.col("origin").alias("node"), "g"))
    return walked.distinct()


def _walked(seeds: DataFrame, moves: DataFrame, automaton: Automaton, limits: Limits) -> DataFrame:
    """The walks from each seed over moves that every task holds; at most BROADCAST_ROWS of them come by way of the driver."""

    def flat(name: str) -> list[Column]:
        return [F.col(name)[f].alias(f"{name}_{f}") for f in "kvdl"]

    ids: dict[tuple, int] = {}
    steps: dict[tuple, list[tuple[int, int]]] = {}
    for r in moves.select(*flat("node"), "q", *flat("to"), "q2", "g").toLocalIterator():
        a, b = (ids.setdefault(tuple(x), len(ids)) for x in (r[:4], r[5:9]))
        steps.setdefault((a, r.q, r.g), []).append((b, r.q2))
    shared = seeds.sparkSession.sparkContext.broadcast((ids, steps))
    accepting, empty, most, rounds = automaton.accepting, automaton.empty, limits.visited, limits.rounds
    columns = [*(f"{n}_{f}" for n in ("origin", "node") for f in "kvdl"), "g"]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, steps = shared.value
        terms = list(ids)
        out = []
        for pdf in batches:
            for k, v, d, l, g in zip(*(pdf[c] for c in ("origin_k", "origin_v", "origin_d", "origin_l", "g")), strict=True):
                origin = (int(k), *(None if pd.isna(x) else x for x in (v, d, l)))
                start = ids.get(origin)
                seen, front, n = set(), [] if start is None else [(start, 0)], 0
                ends = set()
                while front:
                    n += 1
                    ahead = []
                    for node, q in front:
                        for state in steps.get((node, q, g), ()):
                            if state not in seen:
                                seen.add(state)
                                ahead.append(state)
                                if state[1] in accepting:
                                    ends.add(state[0])
                    front = ahead
                    if len(seen) > most or (front and n >= rounds):
                        yield pd.DataFrame([(STOPPED, *[None] * 7, g)], columns=columns)
                        return
                if empty and (start is None or start not in ends):
                    out.append((*origin, *origin, g))
                out += [(*origin, *terms[e], g) for e in ends]
                if len(out) > 50_000:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
        if out:
            yield pd.DataFrame(out, columns=columns)

    kinds = "{0}_k int, {0}_v string, {0}_d string, {0}_l string, "
    laid = seeds.select(*flat("origin"), "g").mapInPandas(walk, kinds.format("origin") + kinds.format("node") + "g string")
    return laid.select(*[F.struct(*[F.col(f"{n}_{f}").alias(f) for f in "kvdl"]).cast(TERM).alias(n) for n in ("origin", "node")], "g")
