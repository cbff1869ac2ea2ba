"""Percentiles of large numeric columns with a stated rank error, from summaries that can be combined.

A summary holds tuples (value, lowest rank, highest rank) of some of a group's values. A summary of sorted
values is exact. Merging two adds up the rank intervals; compressing to `size` tuples keeps those nearest
to evenly spaced ranks. Every answer comes with the most by which its rank can be wrong.

Nothing is random, and nothing depends on how rows lie: they are put into blocks by what they hold, a
block's values are summarised in their order, and summaries are merged in the order of blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIZE = 4096
#: Sorted values of one group and block that are summarised at once; rows of a block, about.
CHUNK, BLOCK_ROWS = 500_000, 125_000
FAN_IN = 16
BLOCK = "__block"


class Summary:
    """n values, known by tuples: v sorted, lo and hi the bounds of each one's rank (from 1)."""

    __slots__ = ("n", "v", "lo", "hi")

    def __init__(self, n: int, v: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        self.n, self.v, self.lo, self.hi = int(n), v, lo, hi

    @classmethod
    def of(cls, values: np.ndarray, is_sorted: bool = False) -> Summary:
        v = values if is_sorted else np.sort(values)
        r = np.arange(1, len(v) + 1, dtype=np.int64)
        return cls(len(v), v, r, r)

    @classmethod
    def read(cls, n: int, v: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Summary:
        v = np.asarray(v)
        return cls(n, v, np.asarray(lo, np.int64), np.asarray(hi, np.int64)) if len(lo) else cls.of(v, True)

    def merge(self, other: Summary) -> Summary:
        """Ranks of a value of one side: its own plus the other side's bounds around it."""
        if not self.n or not other.n:
            return other if not self.n else self

        def against(a: Summary, b: Summary, side: str) -> tuple[np.ndarray, np.ndarray]:
            i = np.searchsorted(b.v, a.v, side)  # b's tuples before a's value
            lo = a.lo + np.where(i > 0, b.lo[np.maximum(i - 1, 0)], 0)
            hi = a.hi + np.where(i < len(b.v), b.hi[np.minimum(i, len(b.v) - 1)] - 1, b.n)
            return lo, hi

        (l1, h1), (l2, h2) = against(self, other, "left"), against(other, self, "right")
        v = np.concatenate([self.v, other.v])
        order = np.argsort(v, kind="stable")
        return Summary(self.n + other.n, v[order], np.concatenate([l1, l2])[order], np.concatenate([h1, h2])[order])

    def compress(self, size: int) -> Summary:
        """At most size + 1 tuples; the first and last stay."""
        if len(self.v) <= size + 1:
            return self
        at = np.unique(self.nearest(np.linspace(1, self.n, size + 1)))
        return Summary(self.n, self.v[at], self.lo[at], self.hi[at])

    def nearest(self, ranks: np.ndarray) -> np.ndarray:
        """For each rank the tuple whose interval strays least from it; of several the first."""
        near = np.searchsorted(self.lo, ranks)[:, None] + np.arange(-2, 3)
        at = np.clip(near, 0, len(self.v) - 1)
        stray = np.maximum(ranks[:, None] - self.lo[at], self.hi[at] - ranks[:, None])
        return at[np.arange(len(ranks)), np.argmin(stray, axis=1)]

    def quantiles(self, qs: Sequence[float]) -> tuple[list, list[int]]:
        """The values of the ranks ceil(q n), and the most by which the true rank of each may differ."""
        ranks = np.maximum(1, np.ceil(np.round(np.asarray(qs) * self.n, 9)))
        at = self.nearest(ranks)
        error = np.maximum(np.maximum(ranks - self.lo[at], self.hi[at] - ranks), 0)
        return self.v[at].tolist(), error.astype(np.int64).tolist()

    def row(self) -> tuple:
        """An exact summary needs no ranks."""
        exact = len(self.v) == self.n
        return self.n, self.v, self.lo[:0] if exact else self.lo, self.hi[:0] if exact else self.hi


class _Stack:
    """Summaries of one key as they pass, merged pairwise by a binary counter: about the logarithm of their number is held."""

    def __init__(self, size: int):
        self.size, self.held = size, []

    def add(self, s: Summary) -> None:
        level = 0
        while self.held and self.held[-1][0] == level:
            s, level = self.held.pop()[1].merge(s).compress(self.size), level + 1
        self.held.append((level, s))

    def whole(self) -> Summary:
        s = self.held[-1][1]
        for _, x in reversed(self.held[:-1]):
            s = x.merge(s).compress(self.size)
        return s.compress(self.size)


def _value(t: T.DataType) -> str:
    """What a column's values are held as; numbers keep their kind."""
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "bigint"
    if isinstance(t, T.DecimalType):
        return t.simpleString()
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return "double"
    raise TypeError(f"no numbers: {t.simpleString()}")


def _schema(df: DataFrame, keys: Sequence[str]) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*keys).schema)


def _summary(kind: str) -> str:
    return f"n bigint, v array<{kind}>, lo array<bigint>, hi array<bigint>"


def _segments(pdf: pd.DataFrame, keys: list[str]) -> Iterator[tuple[tuple, int, int]]:
    """Runs of rows with one key tuple; null is a key."""
    change = np.zeros(len(pdf), bool)
    change[:1] = True
    for k in keys:
        codes = pd.factorize(pdf[k])[0]
        change[1:] |= codes[1:] != codes[:-1]
    at = np.flatnonzero(change)
    heads = [[None if pd.isna(x) else x for x in pdf[k].iloc[at]] for k in keys]
    yield from zip(zip(*heads, strict=True) if keys else [()] * len(at), at, [*at[1:], len(pdf)], strict=True)


def _folded(keys: list[str], size: int, read: Callable[[pd.DataFrame, int, int], Iterator[Summary]], columns: list[str]):
    """A function over batches of rows sorted by key that makes one summary of each key's rows."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, stack, out = None, _Stack(size), []
        for pdf in batches:
            for k, a, b in _segments(pdf, keys):
                if k != key:
                    if stack.held:
                        out.append((*key, *stack.whole().row()))
                    key, stack = k, _Stack(size)
                for s in read(pdf, a, b):
                    stack.add(s)
            if len(out) >= 500:
                yield pd.DataFrame(out, columns=columns)
                out = []
        if stack.held:
            out.append((*key, *stack.whole().row()))
        if out:
            yield pd.DataFrame(out, columns=columns)

    return fold


def blocks_for(rows: int) -> int:
    """A power of two that gives blocks of about BLOCK_ROWS."""
    return 1 << max(3, (max(1, rows) // BLOCK_ROWS).bit_length())


def summaries(df: DataFrame, keys: Sequence[str], value: str, identity: Column, blocks: int | None = None, size: int = SIZE) -> DataFrame:
    """One summary for each key tuple: (keys..., n, v, lo, hi).

    value: a column of integers, decimals or floating-point numbers, kept as they are; null values are
    left out, NaN is the greatest number, null keys are a group. identity tells rows apart and decides
    their block, so a hot key or a hot value is spread over all blocks; rows that share an identity share
    a block. blocks: blocks_for() the number of rows, which is counted if it is None. A block's rows meet
    in one task in order; what is merged after that is `size` tuples for each key and block.
    """
    keys = list(keys)
    kind = _value(df.schema[value].dataType)
    blocks = blocks or blocks_for(df.count())
    rows = df.select(*keys, F.col(value).cast(kind).alias("__value"), F.pmod(F.xxhash64(identity), F.lit(blocks)).cast("int").alias(BLOCK)).where("__value is not null")
    by = [BLOCK, *keys]

    def read(pdf: pd.DataFrame, a: int, b: int) -> Iterator[Summary]:
        v = pdf["__value"].to_numpy()
        for i in range(a, b, CHUNK):
            yield Summary.of(v[i : min(b, i + CHUNK)], True)

    laid, cut, fold = rows.repartition(BLOCK).sortWithinPartitions(*by, "__value"), _rebatched(by), _folded(by, size, read, [*by, "n", "v", "lo", "hi"])
    parts = laid.mapInPandas(lambda batches: fold(cut(batches)), f"{BLOCK} int, {_schema(df, keys)}{_summary(kind)}")
    return combine(parts, keys, BLOCK, size)


def _rebatched(keys: list[str]):
    """Batches that hold a key's rows whole, up to CHUNK rows, wherever the batches that come in end."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            held.append(pdf)
            whole = pd.concat(held, ignore_index=True) if len(held) > 1 else pdf
            start = [a for _, a, _ in _segments(whole, keys)][-1]
            if start:
                yield whole.iloc[:start]
                whole = whole.iloc[start:].reset_index(drop=True)
            while len(whole) >= CHUNK:
                yield whole.iloc[:CHUNK]
                whole = whole.iloc[CHUNK:].reset_index(drop=True)
            held = [whole]
        if held:
            yield pd.concat(held, ignore_index=True)

    return cut


def combine(parts: DataFrame, keys: Sequence[str], order: str, size: int = SIZE) -> DataFrame:
    """Summaries of parts, such as blocks, days or partitions, put together by key in the order of a column.

    Two levels, of groups of FAN_IN parts and then of their results, each sorted and merged as they pass:
    no task holds more than about the logarithm of a key's summaries. Parts that agree in the order are
    merged in the order of what they hold.
    """
    keys = list(keys)
    kind = parts.schema["v"].dataType.elementType.simpleString()

    def read(pdf: pd.DataFrame, a: int, b: int) -> Iterator[Summary]:
        for i in range(a, b):
            yield Summary.read(pdf.n.iloc[i], pdf.v.iloc[i], pdf.lo.iloc[i], pdf.hi.iloc[i])

    def level(df: DataFrame, by: list[str], then: list[str]) -> DataFrame:
        laid = df.repartition(*by) if by else df.coalesce(1)
        fold = _folded(by, size, read, [*by, "n", "v", "lo", "hi"])
        return laid.sortWithinPartitions(*by, *then).mapInPandas(fold, f"{_schema(df, by)}{_summary(kind)}")

    rank = F.col(order) if isinstance(parts.schema[order].dataType, (T.IntegerType, T.LongType, T.ShortType)) else F.xxhash64(order)
    first = parts.select(*keys, F.floor(rank / FAN_IN).alias("__group"), rank.alias("__at"), "n", "v", "lo", "hi")
    return level(level(first, [*keys, "__group"], ["__at", "n", "v"]), keys, ["__group"])


def percentiles(parts: DataFrame, keys: Sequence[str], qs: Sequence[float]) -> DataFrame:
    """Answers from summaries: (keys..., n, p<q>..., rank_error), the last the largest bound of the answers given."""
    keys, names = list(keys), [f"p{q * 100:g}".replace(".", "_") for q in qs]
    kind = parts.schema["v"].dataType.elementType.simpleString()

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [Summary.read(n, v, lo, hi).quantiles(qs) for n, v, lo, hi in zip(pdf.n, pdf.v, pdf.lo, pdf.hi, strict=True)]
            yield pdf[[*keys, "n"]].assign(**{m: [g[0][i] for g in got] for i, m in enumerate(names)}, rank_error=[max(g[1]) for g in got])

    return parts.mapInPandas(answer, f"{_schema(parts, keys)}n bigint, " + ", ".join(f"{m} {kind}" for m in names) + ", rank_error bigint")
