"""Triple patterns over a table of quads with term structs."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.algebra import Iri, Triple, Var
from graphloom.plans.lower import Forbidden, Scope
from graphloom.plans.relation import Rel, join
from graphloom.plans.values import Value, is_term


@dataclass(frozen=True)
class Active:
    """The graphs that a query may use: those merged into its default graph, and the named ones."""

    default: frozenset[str]
    named: frozenset[str]


@dataclass
class QuadSource:
    """quads: s, p, o, g; closure: entailed triples with `support`, the graphs they follow from."""

    quads: DataFrame
    active: Active
    closure: DataFrame | None = None
    spark: SparkSession = field(init=False)

    def __post_init__(self) -> None:
        self.spark = self.quads.sparkSession

    def scoped(self, scope: Scope, predicates: set[str] | None = None) -> DataFrame:
        """Triples (s, p, o) of a scope, with g for a graph variable; a set, as RDF graphs are."""
        quads = self.quads if predicates is None else self.quads.where(F.col("p").isin(*predicates))
        if scope.var:
            return quads.where(F.col("g").isin(*self.active.named)).select("s", "p", "o", "g")
        if scope.graph is not None:
            if scope.graph not in self.active.named:
                raise Forbidden(f"graph {scope.graph} is not in the dataset")
            return quads.where(F.col("g") == scope.graph).select("s", "p", "o")
        out = quads.where(F.col("g").isin(*self.active.default)).select("s", "p", "o")
        if self.closure is not None:
            own = self.closure.where(F.size(F.array_except("support", F.array(*[F.lit(g) for g in sorted(self.active.default)]))) == 0)
            out = out.unionByName(own.select("s", "p", "o") if predicates is None else own.where(F.col("p").isin(*predicates)).select("s", "p", "o"))
        return out.distinct() if len(self.active.default) > 1 or self.closure is not None else out

    def edges(self, predicates: set[str] | None, scope: Scope) -> DataFrame:
        df = self.scoped(scope, predicates)
        return df if scope.var else df.withColumn("g", F.lit(""))

    def pattern(self, t: Triple, scope: Scope) -> Rel:
        df = self.scoped(scope, {t.p.value} if isinstance(t.p, Iri) else None)
        where, vals = F.lit(True), {}
        for x, v in ((t.s, Value("term", F.col("s"), maybe=False)), (t.p, Value("iri", F.col("p"), maybe=False)), (t.o, Value("term", F.col("o"), maybe=False))):
            if isinstance(x, Var):
                if x.name in vals:
                    a, b = vals[x.name], v
                    where = where & ((a.col["v"] if a.kind == "term" else a.col) == (b.col["v"] if b.kind == "term" else b.col)) if a.kind != b.kind else where & (a.col == b.col)
                else:
                    vals[x.name] = v
            elif v.kind == "iri":
                where = where & (v.col == x.value)
            else:
                where = where & is_term(v.col, x)
        if scope.var:
            vals[scope.var] = Value("iri", F.col("g"), maybe=False)
        return Rel.of(df, vals, where)

    def bgp(self, triples: list[Triple], scope: Scope) -> Rel:
        """Patterns joined so that each, if it can, shares a variable with those before it."""
        left = sorted(triples, key=lambda t: sum(isinstance(x, Var) for x in (t.s, t.p, t.o)))
        rel = self.pattern(left.pop(0), scope)
        while left:
            near = next((t for t in left if any(isinstance(x, Var) and x.name in rel.vars for x in (t.s, t.p, t.o))), left[0])
            left.remove(near)
            rel = join(rel, self.pattern(near, scope))
        return rel
