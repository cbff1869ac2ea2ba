"""Filling contexts of a fixed token capacity with texts of any length.

Bin completion: a context is opened with the largest text left; the undominated sets of other texts that
fit beside it are tried, fullest first, and whole packings are bounded by the space they must waste. The
best-fit packing is the first incumbent. Each group of texts is packed on its own; groups have a bounded
number of texts, so a group wastes at most part of one context beyond what it must.

A packing that reaches the lower bound is proven best. For other groups contexts are searched in windows,
and then the whole group within a budget of nodes; without a budget the search is exact.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import shuffle_partitions

#: Texts in a group, about.
GROUP_ROWS = 5_000
#: Completions tried for one context, and nodes of the search over one window.
COMPLETIONS, NODES = 40, 400
#: Steps of the search for the completions of one context that are less full than its fullest.
STEPS = 1_200
#: Contexts searched together; a window's packing is settled before the next is opened.
WINDOW = 6
#: Equal rows numbered at once.
COPIES = 10_000
#: Nodes of the search over a whole group, where the windows' packing is not proven best.
GROUP_NODES = 2_000


def token_counts(df: DataFrame, text: str, vocabulary: str = "/opt/tokenizers/byte_bpe_50k.tiktoken", pattern: str | None = None, out: str = "n_tokens") -> DataFrame:
    """df with the number of tokens of a text, by the byte-level ranks in a file; 0 for a null or empty text.

    The file must be readable by every executor. Strings of special tokens count as ordinary text. Runs
    of one character, which some pre-tokenisers handle in quadratic time, are no problem for the words
    these texts have; a text is never shortened.
    """
    import tiktoken

    split = pattern or r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        encoder = tiktoken.Encoding("counted", pat_str=split, mergeable_ranks=ranks, special_tokens={})
        for pdf in batches:
            yield pdf.drop(columns=text).assign(**{out: [len(encoder.encode_ordinary(t)) if t else 0 for t in pdf[text]]})

    kept = [f for f in df.schema if f.name != text]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return df.mapInPandas(count, f"{schema}, `{out}` int")


def _best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Positions of each context, by best fit of decreasing sizes; sizes are sorted, largest first."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]  # room left -> contexts
    filled = np.zeros(capacity + 1, bool)
    out: list[list[int]] = []
    for i, s in enumerate(sizes):
        fits = np.flatnonzero(filled[s:])
        if len(fits):
            room = s + int(fits[0])
            c = by_room[room].pop()
            filled[room] = bool(by_room[room])
        else:
            room, c = capacity, len(out)
            out.append([])
        out[c].append(i)
        by_room[room - s].append(c)
        filled[room - s] = True
    return out


class _Pool:
    """Sizes left to pack, with how many there are of each."""

    def __init__(self, sizes: list[int]):
        self.n: dict[int, int] = {}
        for s in sizes:
            self.n[s] = self.n.get(s, 0) + 1
        self.keys = sorted(self.n, reverse=True)

    def take(self, sizes: tuple[int, ...]) -> None:
        for s in sizes:
            self.n[s] -= 1

    def put(self, sizes: tuple[int, ...]) -> None:
        for s in sizes:
            self.n[s] += 1

    def largest(self) -> int | None:
        while self.keys and not self.n[self.keys[0]]:
            self.keys.pop(0)
        return self.keys[0] if self.keys else None


def _sums(pool: _Pool, sizes: list[int], room: int) -> list[int]:
    """For each i, the sums up to a room that copies of the sizes from i on add up to, as bits; at the end that of none."""
    reach, within = [1] * (len(sizes) + 1), (1 << (room + 1)) - 1
    for i in range(len(sizes) - 1, -1, -1):
        sums, copies, step = reach[i + 1], min(pool.n[sizes[i]], room // sizes[i]), 1
        while copies:
            step = min(step, copies)
            sums |= (sums << (step * sizes[i])) & within
            copies, step = copies - step, step * 2
        reach[i] = sums
    return reach


def completions(pool: _Pool, keys: np.ndarray, room: int, most: int | None = COMPLETIONS) -> Iterator[tuple[int, ...]]:
    """Undominated sets of sizes that fit a room, fullest first: the first `most`, or with None all of them.

    A set is dominated if a size left out could be added, or could take the place of a smaller one, and
    still fit. The sums that the smaller sizes can add up to are worked out first, so the search for the
    sets of one sum, from large to small, enters no branch that misses it. None of the fullest is
    dominated; those of a smaller sum are found within STEPS steps in all, unless all are asked for. The
    pool may change between two sets.
    """
    sizes = [int(k) for k in keys if k <= room]
    counts = dict(pool.n)
    reach = _sums(pool, sizes, room)
    steps = STEPS if most is not None else 1 << 62

    def search(i: int, left: int, chosen: tuple[int, ...], waste: int, free: bool) -> Iterator[tuple[int, ...]]:
        nonlocal steps
        if not left:
            if free or not _dominated(counts, chosen, waste):
                yield chosen
            return
        while i < len(sizes) and reach[i] >> left & 1:
            if not free:
                steps -= 1
                if steps < 0:
                    return
            s = sizes[i]
            for m in range(min(counts[s], left // s), 0, -1):
                if reach[i + 1] >> (left - m * s) & 1:
                    yield from search(i + 1, left - m * s, (*chosen, *[s] * m), waste, free)
            i += 1

    fullest = reach[0].bit_length() - 1
    found = (c for total in range(fullest, -1, -1) if steps > 0 and reach[0] >> total & 1 for c in search(0, total, (), room - total, total == fullest))
    return islice(found, most)


def _dominated(counts: dict[int, int], chosen: tuple[int, ...], left: int) -> bool:
    rest = {d: n - chosen.count(d) for d, n in counts.items()}
    return any(rest.get(d, 0) > 0 for d in range(1, left + 1)) or any(rest.get(s + d, 0) > 0 for s in set(chosen) for d in range(1, left + 1))


def _full(pool: _Pool, keys: list[int], room: int) -> tuple[int, ...] | None:
    """Sizes that fill a room to the brim, if large ones and a last pair do; keys are the sizes left, largest first."""
    chosen: list[int] = []
    used: dict[int, int] = {}

    def free(s: int) -> int:
        return pool.n.get(s, 0) - used.get(s, 0)

    for s in keys:
        while s <= room and free(s) > 0:
            for t in (room,) if free(room) > 0 else ():
                return (*chosen, t)
            if 2 * s < room and free(room - s) > 0:
                return tuple(sorted((*chosen, s, room - s), reverse=True))
            chosen.append(s)
            used[s] = used.get(s, 0) + 1
            room -= s
            if not room:
                return tuple(chosen)
    return None


def least_contexts(sizes: np.ndarray, capacity: int) -> int:
    """A lower bound: for each k, texts that leave less than k free beside them, those above half, and what the rest of at least k must add to these."""
    s = np.sort(np.asarray(sizes, np.int64))
    if not len(s):
        return 0
    total = np.concatenate(([0], np.cumsum(s)))
    k = np.unique(np.concatenate(([0], s[s * 2 <= capacity])))
    above, half, from_k = (np.searchsorted(s, x, "right") for x in (capacity - k, np.full(len(k), capacity // 2), k - 1))
    above = np.maximum(above, half)
    large, middle = len(s) - above, above - half
    free = middle * capacity - (total[above] - total[half])
    more = np.maximum(0, total[half] - total[np.minimum(from_k, half)] - free)
    return int((large + middle + -(-more // capacity)).max())


@dataclass(frozen=True)
class Packing:
    """where: the context of each size; least: the lower bound; proven: whether no packing has fewer contexts; nodes: searched."""

    where: np.ndarray
    best_fit: int
    contexts: int
    least: int
    proven: bool
    nodes: int


def pack(sizes: np.ndarray, capacity: int, nodes: int | None = GROUP_NODES) -> Packing:
    """The contexts of sizes, all from 1 to capacity, by bin completion.

    Best fit of everything is the incumbent. Contexts are completed in windows, depth first over the
    completions of the largest size left, cut where the waste so far can't beat the window's best. Where
    that misses the lower bound, the whole group is searched: nodes limits it, and None never does, so
    that the result is then the best there is. It is never worse than best fit.
    """
    order = np.argsort(-sizes, kind="stable")
    ordered = [int(s) for s in sizes[order]]
    best_fit = [tuple(ordered[i] for i in c) for c in _best_fit(ordered, capacity)]
    least = least_contexts(sizes, capacity)
    bins = _completed(ordered, capacity, len(best_fit)) or best_fit
    seen, proven = 0, len(bins) <= least
    if not proven:
        bins, proven, seen = _whole(ordered, capacity, bins, least, nodes)
    places: dict[int, list[int]] = {}
    for i, s in enumerate(ordered):
        places.setdefault(s, []).append(int(order[i]))
    out = np.empty(len(sizes), np.int64)
    for number, chosen in enumerate(bins):
        for s in chosen:
            out[places[s].pop()] = number
    return Packing(out, len(best_fit), len(bins), least, proven, seen)


def _completed(ordered: list[int], capacity: int, best: int) -> list[tuple[int, ...]] | None:
    """Windows of completed contexts; None if there are more than the incumbent has."""
    pool = _Pool(ordered)
    allowed = best * capacity - sum(ordered)  # waste that doesn't lose to the incumbent
    packed: list[tuple[int, ...]] = []
    wasted = 0
    while pool.largest() is not None:
        for chosen in _window(pool, capacity):
            pool.take(chosen)
            packed.append(chosen)
            wasted += capacity - sum(chosen)
        if wasted > allowed + capacity:  # one context, the last, may be left open
            return None
    return packed if len(packed) <= best else None


def _whole(ordered: list[int], capacity: int, best: list[tuple[int, ...]], least: int, nodes: int | None) -> tuple[list[tuple[int, ...]], bool, int]:
    """Bin completion of a whole group: the best packing found, whether it is proven best, and the nodes it took.

    A branch is left where its contexts and the lower bound of what is left don't beat the best packing.
    It is a loop over a stack of completions, so a group may have any number of contexts.
    """
    pool = _Pool(ordered)
    done: list[tuple[int, ...]] = []
    seen = 0

    def options() -> Iterator[tuple[int, ...]]:
        left = np.repeat(*zip(*((k, n) for k, n in pool.n.items() if n), strict=True))
        if len(done) + least_contexts(left, capacity) >= len(best):
            return iter(())
        top = int(left.max())
        pool.n[top] -= 1
        found = completions(pool, np.unique(left)[::-1] if pool.n[top] else np.unique(left)[-2::-1], capacity - top, None)
        pool.n[top] += 1
        return ((top, *rest) for rest in found)

    stack = [options()] if ordered else []
    while stack:
        if nodes is not None and seen >= nodes:
            return best, len(best) <= least, seen
        chosen = next(stack[-1], None)
        if chosen is None:
            stack.pop()
            if done:
                pool.put(done.pop())
            continue
        seen += 1
        pool.take(chosen)
        done.append(chosen)
        if not any(pool.n.values()):
            if len(done) < len(best):
                best = list(done)
                if len(best) <= least:
                    return best, True, seen
            pool.put(done.pop())
        else:
            stack.append(options())
    return best, True, seen


def _window(pool: _Pool, capacity: int) -> list[tuple[int, ...]]:
    """The least wasteful filling of the next few contexts found within the node budget."""
    best: list[tuple[int, ...]] = []
    least = float("inf")
    nodes = NODES
    sizes = [k for k in pool.keys if pool.n[k] > 0]
    need = min(WINDOW, -(-sum(k * pool.n[k] for k in sizes) // capacity))  # contexts, at least
    spare = 0  # that any context must waste; worked out once a window that wastes nothing wasn't found

    def options(keys: np.ndarray) -> Iterator[tuple[int, ...]]:
        top = int(keys[0])
        full = None
        for quick in (True, False):
            pool.n[top] -= 1
            try:
                found = [f for f in (_full(pool, keys.tolist(), capacity - top),) if f] if quick else completions(pool, keys, capacity - top)
            finally:
                pool.n[top] += 1
            for rest in found:
                if quick or rest != full:
                    full = full or rest
                    yield (top, *rest)

    def search(done: list[tuple[int, ...]], waste: int) -> None:
        nonlocal best, least, nodes, spare
        keys = np.array([k for k in pool.keys if pool.n[k] > 0], np.int64)
        if len(done) == WINDOW or not len(keys):
            if waste < least:
                best, least = list(done), waste
            return
        for chosen in options(keys):
            more = waste + capacity - sum(chosen)
            if more + spare * max(0, need - len(done) - 1) >= least:
                break  # the others waste more
            nodes -= 1
            pool.take(chosen)
            search([*done, chosen], more)
            pool.put(chosen)
            if 0 < least < float("inf") and not spare:
                spare = capacity + 1 - _sums(pool, sizes, capacity)[0].bit_length()
            if nodes <= 0 or least <= spare * need:
                return

    search([], 0)
    return best


def pack_texts(sized: DataFrame, key: str, size: str, capacity: int, group_rows: int = GROUP_ROWS, nodes: int | None = GROUP_NODES) -> DataFrame:
    """The context of each text: (key, part, start_token, n_tokens, context_id).

    A text longer than the capacity, and only that, is divided: whole parts of exactly the capacity are
    contexts of their own and the rest is packed like a text. A text without tokens is part 0 with the
    null context. Keys must not be null; of rows that share a key each is packed by itself. Only keys and
    sizes are shuffled, into groups by a hash, in which rows that are the same are counted first and then
    spread, so no key makes a group large. nodes: of pack(); None proves every group's packing best.
    """
    kind = sized.schema[key].dataType.simpleString()
    cut, groups = _cut(sized, key, size, capacity, group_rows)
    full = cut.where(F.col("n") == capacity).select("k", "part", "at", "n", F.concat(F.lit("full-"), F.col("k").cast("string"), F.lit("-"), F.col("part").cast("string"), F.lit("-"), F.col("copy").cast("string")).alias("c"))
    empty = cut.where("n = 0").select("k", "part", "at", "n", F.lit(None).cast("string").alias("c"))

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "k", "at", "copy"]).reset_index(drop=True)
        where = pack(pdf.n.to_numpy(), capacity, nodes).where
        return pdf[["k", "part", "at", "n"]].assign(c=[f"{pdf.g.iloc[0]}-{b}" for b in where])

    packed = _loose(cut, capacity, groups).groupBy("g").applyInPandas(group, f"k {kind}, part int, at bigint, n bigint, c string")
    out = packed.unionByName(full).unionByName(empty)
    return out.select(F.col("k").alias(key), "part", F.col("at").alias("start_token"), F.col("n").cast("int").alias("n_tokens"), F.col("c").alias("context_id"))


def pack_report(sized: DataFrame, key: str, size: str, capacity: int, group_rows: int = GROUP_ROWS, nodes: int | None = GROUP_NODES) -> DataFrame:
    """Of each group that pack_texts() makes: (group_no, n_pieces, n_tokens, best_fit, contexts, least, proven, nodes)."""
    cut, groups = _cut(sized, key, size, capacity, group_rows)

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pack(pdf.n.to_numpy(), capacity, nodes)
        return pd.DataFrame([(pdf.g.iloc[0], len(pdf), pdf.n.sum(), p.best_fit, p.contexts, p.least, p.proven, p.nodes)], columns=["group_no", "n_pieces", "n_tokens", "best_fit", "contexts", "least", "proven", "nodes"])

    return _loose(cut, capacity, groups).groupBy("g").applyInPandas(group, "group_no bigint, n_pieces bigint, n_tokens bigint, best_fit int, contexts int, least int, proven boolean, nodes int")


def _loose(cut: DataFrame, capacity: int, groups: int) -> DataFrame:
    """The pieces to pack, by group. The tasks are as many as groups or shuffle partitions: groups are few bytes and much work, so they are not to be coalesced by size."""
    tasks = min(groups, shuffle_partitions(cut.sparkSession))
    return cut.where((F.col("n") > 0) & (F.col("n") < capacity)).withColumn("g", F.pmod(F.xxhash64("k", "at", "n", "copy"), F.lit(groups))).repartition(tasks, "g")


def _cut(sized: DataFrame, key: str, size: str, capacity: int, group_rows: int) -> tuple[DataFrame, int]:
    """Pieces (k, copy, part, at, n) of at most the capacity, and the number of groups; copy tells equal rows apart."""
    rows = sized.select(F.col(key).alias("k"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("n")).where("k is not null")
    counted = rows.groupBy("k", "n").agg(F.count(F.lit(1)).alias("rows"))
    # copies are numbered in steps, so that no array grows with their number
    steps = counted.withColumn("step", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(rows - 1) div {COPIES}"))))
    copies = steps.select("k", "n", F.explode(F.sequence(F.expr(f"step * {COPIES}"), F.expr(f"least(rows, (step + 1) * {COPIES}) - 1"))).alias("copy"))
    whole = F.expr(f"n div {capacity}")
    none = F.array().cast("array<struct<part:int,at:bigint,n:bigint>>")
    full = F.transform(F.when(whole > 0, F.sequence(F.lit(1), whole)).otherwise(F.array().cast("array<bigint>")), lambda i: F.struct((i - 1).cast("int").alias("part"), ((i - 1) * capacity).alias("at"), F.lit(capacity).cast("bigint").alias("n")))
    rest = F.when((F.col("n") % capacity > 0) | (F.col("n") == 0), F.array(F.struct(whole.cast("int").alias("part"), (whole * capacity).alias("at"), (F.col("n") % capacity).alias("n")))).otherwise(none)
    return copies.select("k", "copy", F.explode(F.concat(full, rest)).alias("p")).select("k", "copy", "p.*"), max(1, round(sized.count() / group_rows))
