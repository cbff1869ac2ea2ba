"""Solution multisets as DataFrames, and the joins that unbound variables call for.

An unbound variable is compatible with anything, which a plain equi-join on null is not. Where both
sides are sure to bind a shared variable the join is an equi-join; otherwise the side that may leave it
unbound is split, so that only the unbound rows are compared without a key.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.values import Value, null, text, unify

UNIT = "__unit"


def cn(name: str) -> str:
    """Column of a variable; hidden ones begin with a dot."""
    return "h_" + name[1:] if name.startswith(".") else "v_" + name


@dataclass(frozen=True)
class Rel:
    df: DataFrame
    vars: dict[str, Value]
    unit: bool = False

    @staticmethod
    def of(df: DataFrame, values: dict[str, Value], where: Column | None = None) -> Rel:
        """A relation of computed values over a frame."""
        df = df if where is None else df.where(where)
        cols = [v.col.alias(cn(n)) for n, v in values.items()] or [F.lit(1).alias(UNIT)]
        return Rel(df.select(*cols), {n: replace(v, col=F.col(cn(n))) for n, v in values.items()})

    @staticmethod
    def one(spark: SparkSession) -> Rel:
        """The one empty mapping."""
        return Rel(spark.range(1).select(F.lit(1).alias(UNIT)), {}, True)

    def project(self, names) -> Rel:
        return Rel.of(self.df, {n: self.vars.get(n, null()) for n in names})

    def where(self, c: Column) -> Rel:
        return Rel(self.df.where(c), self.vars)

    def extend(self, name: str, v: Value) -> Rel:
        return Rel.of(self.df, self.vars | {name: v})

    def distinct(self) -> Rel:
        return Rel(self.df.distinct(), self.vars)

    def bound(self, names) -> Rel:
        return Rel(self.df, {n: replace(v, maybe=v.maybe and n not in names) for n, v in self.vars.items()}, self.unit)

    def decoded(self, names=None) -> DataFrame:
        """Native columns: IRIs and terms as text, other values as they are."""
        names = names or [n for n in self.vars if not n.startswith(".")]
        out = []
        for n in names:
            v = self.vars.get(n, null())
            out.append((F.coalesce(text(v), F.concat(F.lit("_:"), v.col["v"])) if v.kind == "term" else text(v) if v.kind == "key" else v.col).alias(n))
        return self.df.select(*out)


def union(a: Rel, b: Rel) -> Rel:
    """Bag union; a variable of one side only is unbound on the other."""
    names = [*a.vars, *[n for n in b.vars if n not in a.vars]]
    left, right = {}, {}
    for n in names:
        x, y = a.vars.get(n), b.vars.get(n)
        x, y = (replace(null(y.kind), prefix=y.prefix), y) if x is None else (x, replace(null(x.kind), prefix=x.prefix)) if y is None else unify(x, y)
        maybe = x.maybe or y.maybe
        left[n], right[n] = replace(x, maybe=maybe), replace(y, maybe=maybe)
    p, q = Rel.of(a.df, left), Rel.of(b.df, right)
    if names:
        types = {f.name: f.dataType for f in p.df.schema}
        q = Rel(q.df.select(*[F.col(f.name).cast(types[f.name]) if f.dataType != types[f.name] else F.col(f.name) for f in q.df.schema]), q.vars)
    return Rel(p.df.unionByName(q.df), p.vars)


@dataclass(frozen=True)
class _Pair:
    """Two sides with their shared variables in one form; the right one's columns of these end in __r."""

    left: DataFrame
    right: DataFrame
    shared: dict[str, tuple[Value, Value]]
    vars: dict[str, Value]

    def on(self, n: str) -> Column:
        a, b = self.shared[n]
        eq = F.col(cn(n)) == F.col(cn(n) + "__r")
        if a.maybe:
            eq = F.col(cn(n)).isNull() | eq
        if b.maybe:
            eq = F.col(cn(n) + "__r").isNull() | eq
        return eq

    def condition(self, extra: Callable[[dict[str, Value]], Column] | None) -> Column:
        c = F.lit(True)
        for n in self.shared:
            c = c & self.on(n)
        return c & F.coalesce(extra(self.vars), F.lit(False)) if extra else c


def _pair(a: Rel, b: Rel) -> _Pair:
    shared = {n: unify(a.vars[n], b.vars[n]) for n in a.vars if n in b.vars}
    left = a.df.select(*[shared.get(n, (v,))[0].col.alias(cn(n)) for n, v in a.vars.items()] or [F.lit(1).alias(UNIT)])
    right = b.df.select(*[(shared[n][1].col.alias(cn(n) + "__r") if n in shared else v.col.alias(cn(n))) for n, v in b.vars.items()] or [F.lit(1).alias(UNIT + "__r")])
    vars_ = {}
    for n, v in (a.vars | b.vars).items():
        if n in shared:
            x, y = shared[n]
            c = F.coalesce(F.col(cn(n)), F.col(cn(n) + "__r")) if x.maybe else F.col(cn(n))
            vars_[n] = replace(x, col=c, maybe=x.maybe and y.maybe)
        else:
            vars_[n] = replace(v, col=F.col(cn(n)))
    return _Pair(left, right, shared, vars_)


def _loose(a: Rel, b: Rel) -> str | None:
    """A shared variable to split on: some may be unbound and none is sure on both sides."""
    shared = [n for n in a.vars if n in b.vars]
    if any(not a.vars[n].maybe and not b.vars[n].maybe for n in shared):
        return None
    return next((n for n in shared), None)


def _split(r: Rel, n: str) -> tuple[Rel, Rel | None]:
    """Rows that bind a variable, and, without it, those that don't."""
    if not r.vars[n].maybe:
        return r, None
    c = F.col(cn(n))
    rest = {k: v for k, v in r.vars.items() if k != n}
    return r.where(c.isNotNull()).bound({n}), Rel.of(r.df.where(c.isNull()), rest)


def join(a: Rel, b: Rel, extra=None) -> Rel:
    if a.unit and extra is None:
        return b
    if b.unit and extra is None:
        return a
    if n := _loose(a, b):
        (a1, a0), (b1, b0) = _split(a, n), _split(b, n)
        out = join(a1, b1, extra)
        if a0 is not None:
            out = union(out, join(a0, b, extra))
        if b0 is not None:
            out = union(out, join(a1, b0, extra))
        return out
    p = _pair(a, b)
    if not p.shared and extra is None:
        return Rel.of(p.left.crossJoin(p.right), p.vars)
    return Rel.of(p.left.join(p.right, p.condition(extra), "inner"), p.vars)


def left_join(a: Rel, b: Rel, extra=None) -> Rel:
    """OPTIONAL: its filter is part of the join's condition."""
    if (n := _loose(a, b)) and a.vars[n].maybe:
        bound, free = _split(a, n)
        return union(left_join(bound, b, extra), left_join(free, b, extra))
    p = _pair(a, b)
    joined = p.left.join(p.right, p.condition(extra), "left")
    return Rel.of(joined, {n: v if n in a.vars and not a.vars[n].maybe else replace(v, maybe=True) for n, v in p.vars.items()})


def semi(a: Rel, b: Rel, negated: bool, extra=None, minus: bool = False, apart: set[str | None] = frozenset()) -> Rel:
    """EXISTS and MINUS; MINUS also asks that some shared variable, but for those set apart, be bound on both sides."""
    p = _pair(a, b)
    if minus:
        if not set(p.shared) - apart:
            return a
        both = F.lit(False)
        for n, (x, y) in p.shared.items():
            if n in apart:
                continue
            both = F.lit(True) if not x.maybe and not y.maybe else both | (F.col(cn(n)).isNotNull() & F.col(cn(n) + "__r").isNotNull())
            if not x.maybe and not y.maybe:
                break
        c = p.condition(None) & both
    else:
        c = p.condition(extra)
    kept = p.left.join(p.right, c, "left_anti" if negated else "left_semi")
    return Rel(kept, {n: replace(p.shared.get(n, (v,))[0], col=F.col(cn(n)), maybe=v.maybe) for n, v in a.vars.items()})
