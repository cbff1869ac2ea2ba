"""Lowering of the algebra to relations."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone
from decimal import Decimal
from itertools import count
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.builtins import Compiler, sort_keys
from graphloom.plans import algebra as A
from graphloom.plans.algebra import XSD, Iri, Triple, Var
from graphloom.plans.paths import Limits, compile_path, traverse
from graphloom.plans.relation import UNIT, Rel, cn, join, left_join, semi, union
from graphloom.plans.values import DEC, DOUBLES, INTEGERS, NUMERIC, TERM, Value, boolean, constant, divide, instant, is_term, null, number, struct, term_constant, text


class Unsupported(ValueError):
    """A query that asks for what this engine doesn't answer."""


class Forbidden(PermissionError):
    """A graph or endpoint that the principal may not use."""


@dataclass(frozen=True)
class Scope:
    """Graph that patterns match: the default graph, one graph, or a variable over the named graphs."""

    graph: str | None = None
    var: str | None = None


class Source(Protocol):
    spark: SparkSession

    def bgp(self, triples: list[Triple], scope: Scope) -> Rel: ...

    def edges(self, predicates: set[str] | None, scope: Scope) -> DataFrame:
        """(s, p, o, g) with term structs; g is one constant in the default graph."""


@dataclass
class Lowering:
    source: Source
    base: str = ""
    limits: Limits = field(default_factory=Limits)
    services: dict[str, Source] = field(default_factory=dict)
    functions: dict[str, Callable] = field(default_factory=dict)
    now: datetime = field(default_factory=lambda: datetime.now(timezone.utc))
    numbers: Iterator[int] = field(default_factory=lambda: count(1))
    outer: Rel | None = None
    mark: str = ""

    @property
    def spark(self) -> SparkSession:
        return self.source.spark

    def new(self) -> Var:
        return Var(f".l{next(self.numbers)}")

    # an EXISTS whose pattern refers to its solution in a nested place is lowered over the solutions' distinct bindings

    def within(self, rel: Rel, pattern) -> Lowering:
        """A lowering of the pattern over the bindings it uses; its mark tells them apart."""
        used = {x.name for x in A.walk(pattern) if isinstance(x, Var)} | set(A.visible(pattern))
        names = [n for n in rel.vars if n in used or n == self.mark]
        bindings = rel.project(names).distinct()
        mark = f".o{next(self.numbers)}"
        return replace(self, outer=bindings.extend(mark, row_value(bindings.vars)), mark=mark)

    def correlated(self, rel: Rel) -> Rel:
        """A relation for each binding of the solutions around it."""
        return rel if self.outer is None or self.mark in rel.vars else join(self.outer, rel)

    def leaf(self, rel: Rel) -> Rel:
        return self.correlated(rel) if self.outer is not None and set(rel.vars) & set(self.outer.vars) else rel

    def needs(self, e) -> bool:
        return self.outer is not None and e is not None and any(isinstance(x, Var) and x.name in self.outer.vars for x in A.walk(e))

    def sides(self, a, b, scope: Scope, e=None) -> tuple[Rel, Rel]:
        """Two patterns; if one is correlated, or their expression is, both are."""
        x, y = self(a, scope), self(b, scope)
        if self.outer is not None and (self.mark in x.vars or self.mark in y.vars or self.needs(e)):
            return self.correlated(x), self.correlated(y)
        return x, y

    # patterns

    def __call__(self, p, scope: Scope = Scope()) -> Rel:
        match p:
            case A.Bgp(triples):
                return self.leaf(self.bgp(triples, scope))
            case Rel():
                return self.leaf(p)  # a pattern that was answered before
            case A.Join(a, b):
                return join(self(a, scope), self(b, scope))
            case A.LeftJoin(a, b, e):
                x, y = self.sides(a, b, scope, e)
                return self.optional(x, y, e, scope)
            case A.Union(a, b):
                return union(*self.sides(a, b, scope))
            case A.Minus(a, b):
                x, y = self.sides(a, b, scope)
                bound = set(self.outer.vars) if self.outer is not None else set()
                return semi(x, y, True, minus=True, apart={scope.var} | bound)
            case A.Filter(e, inner):
                return self.filter(e, inner, scope)
            case A.Extend(inner, name, e):
                rel = self(inner, scope)
                return self.extend(self.correlated(rel) if self.needs(e) else rel, name, e, scope)
            case A.Graph(name, inner):
                return self(inner, Scope(graph=name.value) if isinstance(name, Iri) else Scope(var=name.name)) if not self.bare(inner) else self.leaf(self.graphs(name, inner))
            case A.Service():
                return self.leaf(replace(self, outer=None).service(p, scope))
            case A.Values(names, rows):
                return self.leaf(self.values(names, rows))
            case A.Lateral(a, b):
                return self.lateral(self.correlated(self(a, scope)), b, scope)
            case _ if self.outer is not None:
                return self.leaf(replace(self, outer=None)(p, scope))  # a subquery is answered by itself
            case A.Group():
                return self.group(p, scope)
            case A.OrderBy(inner, keys):
                rel = self(inner, scope)
                c = self.compiler(rel, scope)
                return Rel(rel.df.orderBy(*[k for e, up in keys for k in sort_keys(c(e), up)]), rel.vars)
            case A.Project(inner, names):
                return self(inner, scope).project([*names, *([scope.var] if scope.var and scope.var not in names else [])])
            case A.Distinct(inner):
                return self(inner, scope).distinct()
            case A.Reduced(inner):
                return self(inner, scope)
            case A.Slice(inner, offset, limit):
                rel = self(inner, scope)
                df = rel.df.offset(offset) if offset else rel.df
                return Rel(df if limit is None else df.limit(limit), rel.vars)
        raise Unsupported(f"no pattern: {p!r}")

    def bare(self, inner) -> bool:
        return inner == A.Bgp()

    def graphs(self, name, inner) -> Rel:
        """GRAPH with an empty pattern: whether the graph is there, or each of them."""
        t = Triple(self.new(), self.new(), self.new())
        rel = self.bgp((t,), Scope(graph=name.value) if isinstance(name, Iri) else Scope(var=name.name))
        return rel.project([name.name] if isinstance(name, Var) else []).distinct()

    def compiler(self, rel: Rel, scope: Scope, exists: Callable | None = None) -> Compiler:
        return Compiler(rel.vars, exists, self.base, self.now, row_value(rel.vars).col, self.functions)

    def extra(self, e, scope: Scope) -> Callable[[dict[str, Value]], Column] | None:
        if e is None:
            return None
        return lambda vars_: Compiler(vars_, None, self.base, self.now, None, self.functions).condition(e)

    def optional(self, left: Rel, right: Rel, e, scope: Scope) -> Rel:
        """OPTIONAL. An EXISTS in its filter is asked of the joined rows; left rows none of which pass stay as they are."""
        if e is None or not any(isinstance(x, A.Exists) for x in A.walk(e)):
            return left_join(left, right, self.extra(e, scope))
        key = self.new().name
        told = left.extend(key, row_value(left.vars))
        passed = self.where(join(told, right), e, scope)
        rest = semi(told, passed.project([key]).distinct(), True)
        return union(passed, rest).project([n for n in dict.fromkeys([*left.vars, *right.vars])])

    def filter(self, e, inner, scope: Scope) -> Rel:
        rel = self(inner, scope)
        return self.where(self.correlated(rel) if self.needs(e) else rel, e, scope)

    def where(self, rel: Rel, e, scope: Scope) -> Rel:
        """Conjuncts that are EXISTS become semi-joins; EXISTS elsewhere becomes a mark."""
        for c in _conjuncts(e):
            if isinstance(c, A.Exists):
                rel = self.exists(rel, c.pattern, c.negated, scope)
            elif isinstance(c, A.Call) and c.name == "!" and isinstance(c.args[0], A.Exists):
                rel = self.exists(rel, c.args[0].pattern, not c.args[0].negated, scope)
            else:
                rel, compiler = self.marked(rel, c, scope)
                rel = Rel(rel.df.where(compiler.condition(c)), rel.vars).project([n for n in rel.vars if not n.startswith(".mark")])
        return rel

    def inner_and_filter(self, pattern, outer: set[str]) -> tuple[object, object | None]:
        """A pattern whose filter refers to variables only the outer side binds, taken apart."""
        if isinstance(pattern, A.Filter):
            own = set(A.visible(pattern.inner))
            used = {x.name for x in A.walk(pattern.expr) if isinstance(x, Var)}
            if (used - own) & outer and not any(isinstance(x, A.Exists) for x in A.walk(pattern.expr)):
                return pattern.inner, pattern.expr
        return pattern, None

    def exists(self, rel: Rel, pattern, negated: bool, scope: Scope) -> Rel:
        inner, e = self.inner_and_filter(pattern, set(rel.vars))
        if _nested(inner, set(rel.vars)):
            told, hits, _ = self.answered(rel, pattern, scope)
            return semi(told, hits, negated).project(list(rel.vars))
        return semi(rel, self(inner, scope), negated, self.extra(e, scope))

    def answered(self, rel: Rel, pattern, scope: Scope) -> tuple[Rel, Rel, str]:
        """The relation with the mark of each row's binding, and the marks, each once, for which the pattern has a solution."""
        low = self.within(rel, pattern)
        hits = low.correlated(low(pattern, scope)).project([low.mark]).distinct()
        return rel.extend(low.mark, row_value({n: rel.vars[n] for n in low.outer.vars if n != low.mark})), hits, low.mark

    def marked(self, rel: Rel, e, scope: Scope) -> tuple[Rel, Compiler]:
        """A compiler of an expression whose EXISTS are columns, marked by joins with the distinct keys that have a match."""
        marks: dict[A.Exists, str] = {}
        for x in A.walk(e):
            if isinstance(x, A.Exists) and x not in marks:
                name = f".mark{len(marks)}_{self.new().name[1:]}"
                marks[x] = name
                names = list(rel.vars)
                inner, cond = self.inner_and_filter(x.pattern, set(rel.vars))
                if _nested(inner, set(rel.vars)):
                    told, hits, _ = self.answered(rel, x.pattern, scope)
                    rel = left_join(told, hits.extend(name, Value("bool", F.lit(True)))).project([*names, name])
                    continue
                hit = self(inner, scope)
                shared = [n for n in rel.vars if n in hit.vars]
                loose = any(rel.vars[n].maybe or hit.vars[n].maybe for n in shared)
                if cond is not None or loose:
                    yes = semi(rel, hit, False, self.extra(cond, scope)).extend(name, Value("bool", F.lit(True)))
                    no = semi(rel, hit, True, self.extra(cond, scope)).extend(name, Value("bool", F.lit(False)))
                    rel = union(yes, no).project([*names, name])
                else:
                    rel = left_join(rel, hit.project(shared).distinct().extend(name, Value("bool", F.lit(True))))
        return rel, self.compiler(rel, scope, lambda x: F.coalesce(F.col(cn(marks[x])), F.lit(False)) != F.lit(x.negated))

    def extend(self, rel: Rel, name: str, e, scope: Scope) -> Rel:
        names = list(rel.vars)
        rel, compiler = self.marked(rel, e, scope)
        out = rel.extend(name, compiler(e))
        return out.project([*names, name]) if len(out.vars) > len(names) + 1 else out

    def values(self, names, rows) -> Rel:
        cols = []
        for i in range(len(names)):
            kinds = {constant(r[i]).kind for r in rows if r[i] is not None}
            cols.append(kinds.pop() if len(kinds) == 1 and kinds <= {"iri", "str", "int", "dec", "dbl", "bool"} else "term" if kinds else "str")
        types = {"int": "bigint", "dec": DEC, "dbl": "double", "bool": "boolean", "term": TERM}

        def cell(t, kind):
            if t is None:
                return None
            if kind == "term":
                return (1, t.value, None, None) if isinstance(t, Iri) else (3, t.value, t.datatype, t.lang)
            return {"int": int, "dec": Decimal, "dbl": float, "bool": lambda v: v in ("true", "1")}.get(kind, str)(t.value)

        if not names:
            return Rel(self.spark.range(len(rows)).select(F.lit(1).alias(UNIT)), {}, len(rows) == 1)
        data = [tuple(cell(t, k) for t, k in zip(r, cols, strict=True)) for r in rows]
        schema = ", ".join(f"`{cn(n)}` {types.get(k, 'string')}" for n, k in zip(names, cols, strict=True))
        df = self.spark.createDataFrame(data, schema)
        return Rel(df, {n: Value(k, F.col(cn(n)), maybe=any(r[i] is None for r in rows)) for i, (n, k) in enumerate(zip(names, cols, strict=True))})

    def service(self, p: A.Service, scope: Scope) -> Rel:
        """An allowed endpoint is another source; SILENT turns any other into the empty mapping."""
        if isinstance(p.name, Iri):
            if p.name.value not in self.services:
                if p.silent:
                    return Rel.one(self.spark)
                raise Forbidden(f"endpoint {p.name.value} is not allowed")
            return replace(self, source=self.services[p.name.value])(p.inner)
        out = None
        for iri, source in sorted(self.services.items()):
            rel = replace(self, source=source)(p.inner)
            rel = join(rel, Rel.of(self.spark.range(1), {p.name.name: Value("iri", F.lit(iri), maybe=False)}))
            out = rel if out is None else union(out, rel)
        if out is None:
            if p.silent:
                return Rel.one(self.spark)
            raise Forbidden("no endpoint is allowed")
        return out

    def lateral(self, left: Rel, p, scope: Scope) -> Rel:
        """The right side for each left row; a LIMIT there counts by row."""
        offset, limit, order = 0, None, ()
        if isinstance(p, A.Slice):
            offset, limit, p = p.offset, p.limit, p.inner
        names = None
        if isinstance(p, A.Project):
            names, p = p.names, p.inner
        if isinstance(p, A.OrderBy):
            order, p = p.keys, p.inner
        if any(isinstance(x, (A.Group, A.Distinct, A.Slice)) for x in A.walk(p)):
            raise Unsupported("LATERAL over a grouping")
        row = ".row"
        ided = left.extend(row, Value("int", F.monotonically_increasing_id(), maybe=False))
        rel = join(ided, self(p, scope)) if not isinstance(p, (A.Filter, A.Extend)) else self.lateral_inner(ided, p, scope)
        if limit is not None or offset:
            c = self.compiler(rel, scope)
            w = Window.partitionBy(cn(row)).orderBy(*([k for e, up in order for k in sort_keys(c(e), up)] or [F.lit(1)]))
            df = rel.df.withColumn("__n", F.row_number().over(w)).where((F.col("__n") > offset) & (F.col("__n") <= offset + limit if limit is not None else F.lit(True)))
            rel = Rel(df.drop("__n"), rel.vars)
        keep = [*left.vars, *[n for n in (names if names is not None else rel.vars) if n not in left.vars and n != row]]
        return rel.project(keep)

    def lateral_inner(self, left: Rel, p, scope: Scope) -> Rel:
        if isinstance(p, A.Filter):
            rel = self.lateral_inner(left, p.inner, scope)
            return rel.where(self.compiler(rel, scope).condition(p.expr))
        if isinstance(p, A.Extend):
            return self.extend(self.lateral_inner(left, p.inner, scope), p.var, p.expr, scope)
        return left if p == A.Bgp() else join(left, self(p, scope))

    # basic graph patterns and paths

    def bgp(self, triples, scope: Scope) -> Rel:
        plain, others = [], []
        for t in triples:
            self.lower_path(t, plain, others)
        rel = self.source.bgp(plain, scope) if plain else None
        for p in others:
            part = p(scope)
            rel = part if rel is None else join(rel, part)
        return rel if rel is not None else Rel.one(self.spark)

    def lower_path(self, t: Triple, plain: list[Triple], others: list) -> None:
        """Steps, inverses and sequences are triple patterns; alternatives unions; repetitions traversals."""
        match t.p:
            case Iri() | Var():
                plain.append(t)
            case A.PIri(iri):
                plain.append(Triple(t.s, Iri(iri), t.o))
            case A.PInv(inner):
                self.lower_path(Triple(t.o, inner, t.s), plain, others)
            case A.PSeq(a, b):
                mid = self.new()
                self.lower_path(Triple(t.s, a, mid), plain, others)
                self.lower_path(Triple(mid, b, t.o), plain, others)
            case A.PAlt(a, b):
                others.append(lambda sc: self.only(union(self.bgp((Triple(t.s, a, t.o),), sc), self.bgp((Triple(t.s, b, t.o),), sc)), t, sc))
            case A.PNot():
                others.append(lambda sc: self.negated(t, sc))
            case A.PRepeat():
                others.append(lambda sc: self.closure(t, sc))
            case _:
                raise Unsupported(f"no path: {t.p!r}")

    def only(self, rel: Rel, t: Triple, scope: Scope) -> Rel:
        names = [x.name for x in (t.s, t.o) if isinstance(x, Var)] + ([scope.var] if scope.var else [])
        return rel.project(list(dict.fromkeys(names)))

    def negated(self, t: Triple, scope: Scope) -> Rel:
        out = None
        for has, names, s, o in ((t.p.has_forward, t.p.forward, t.s, t.o), (t.p.has_inverse, t.p.inverse, t.o, t.s)):
            if has:
                v = self.new()
                rel = self.source.bgp([Triple(s, v, o)], scope)
                rel = self.only(rel.where(~text(rel.vars[v.name]).isin(*names)) if names else rel, t, scope)
                out = rel if out is None else union(out, rel)
        return out

    def closure(self, t: Triple, scope: Scope) -> Rel:
        """*, + and ?, walked from a bound end if there is one."""
        path, s, o = t.p, t.s, t.o
        if isinstance(s, Var) and not isinstance(o, Var):
            path, s, o = A.PInv(path), o, s
        automaton = compile_path(path)
        wanted: set[str] | None = set()
        for _, step, _ in automaton.transitions:
            wanted = None if step.negated or wanted is None else wanted | set(step.predicates)
        edges = self.source.edges(wanted, scope)
        everything = self.source.edges(None, scope) if automaton.empty and isinstance(s, Var) else edges
        if isinstance(s, Var):
            ends = everything.select(F.col("s").alias("origin"), "g").unionByName(everything.select(F.col("o").alias("origin"), "g"))
            seeds = ends.distinct()
            if automaton.empty and not scope.var:
                extra = [x for x in (t.s, t.o) if not isinstance(x, Var)]
                for x in extra:
                    seeds = seeds.unionByName(seeds.sparkSession.range(1).select(term_constant(x).col.alias("origin"), F.lit("").alias("g")))
        elif scope.var:
            seeds = self.source.edges(None, scope).select(term_constant(s).col.alias("origin"), "g").distinct()
        else:
            seeds = self.spark.range(1).select(term_constant(s).col.alias("origin"), F.lit("").alias("g"))
        pairs = traverse(seeds, edges, automaton, self.limits)
        vals: dict[str, Value] = {}
        where = F.lit(True)
        for x, c in ((s, "origin"), (o, "node")):
            if not isinstance(x, Var):
                where = where & is_term(F.col(c), x)
            elif x.name in vals:
                where = where & (F.col("origin") == F.col("node"))
            else:
                vals[x.name] = Value("term", F.col(c), maybe=False)
        if scope.var:
            vals[scope.var] = Value("iri", F.col("g"), maybe=False)
        return Rel.of(pairs, vals, where)

    # grouping

    def group(self, p: A.Group, scope: Scope) -> Rel:
        rel = self(p.inner, scope)
        keys = dict(p.keys)
        if scope.var and scope.var not in keys:
            keys[scope.var] = Var(scope.var)
        c = self.compiler(rel, scope)
        by = {n: c(e) for n, e in keys.items()}
        args: dict[str, Value] = {n: c(a.expr) for n, a in p.aggs if a.expr is not None}
        cols = [v.col.alias(f"k{i}") for i, v in enumerate(by.values())]
        cols += [v.col.alias(f"a{i}") for i, v in enumerate(args.values())]
        whole = [v.col.alias(f"w{i}") for i, v in enumerate(rel.vars.values())]
        star = any(a.expr is None and a.distinct for _, a in p.aggs)
        df = rel.df.select(*cols, *(whole if star else []), F.lit(1).alias("one"))
        at = {n: replace(v, col=F.col(f"a{i}")) for i, (n, v) in enumerate(args.items())}
        out, made = {}, []
        for n, a in p.aggs:
            v = self.aggregate(a, at.get(n), [F.col(f"w{i}") for i in range(len(whole))])
            made.append(v.col.alias(f"r{len(made)}"))
            out[n] = replace(v, col=F.col(f"r{len(made) - 1}"))
        grouped = df.groupBy(*[f"k{i}" for i in range(len(by))]).agg(*(made or [F.count("one").alias("r")]))
        vals = {n: replace(v, col=F.col(f"k{i}")) for i, (n, v) in enumerate(by.items())}
        return Rel.of(grouped, vals | out)

    def aggregate(self, a: A.Agg, v: Value | None, whole: list[Column]) -> Value:
        """An error poisons SUM and AVG; the others pass over it."""
        if a.name == "COUNT":
            if v is None:
                c = F.count_distinct(F.struct(*whole)) if a.distinct else F.count(F.lit(1))
                return Value("int", c, maybe=False)
            x = text(v) if v.kind == "key" else v.col
            return Value("int", F.count_distinct(x) if a.distinct else F.count(x), maybe=False)
        if a.name in ("SUM", "AVG"):
            return self.numeric(a, v)
        if a.name in ("MIN", "MAX"):
            least = a.name == "MIN"
            if v.kind != "term":
                return v.to((F.min if least else F.max)(v.col))
            rank = F.when(v.col["k"] == 2, 1).when(v.col["k"] == 1, 2).otherwise(3)
            key = F.when(v.col.isNotNull(), F.struct(rank, number(v), boolean(v), instant(v), v.col["v"]))
            return v.to((F.min_by if least else F.max_by)(v.col, key))
        if a.name == "SAMPLE":
            return v.to(F.min(v.col) if v.kind != "term" else F.min_by(v.col, v.col["v"]))
        if a.name == "GROUP_CONCAT":
            gathered = (F.collect_set if a.distinct else F.collect_list)(text(v))
            return Value("str", F.array_join(F.sort_array(gathered), a.sep), maybe=False)
        raise Unsupported(a.name)

    def numeric(self, a: A.Agg, v: Value) -> Value:
        whole = F.count(F.lit(1))
        if v.kind == "term":
            x = number(v)
            total = (F.sum_distinct if a.distinct else F.sum)(x)
            if a.name == "AVG":
                total = total / (F.count_distinct(x) if a.distinct else F.count(x))
            ints, dbls = F.bool_and(v.col["d"].isin(*INTEGERS)), F.bool_or(v.col["d"].isin(*DOUBLES))
            if a.name == "AVG":
                ints = F.lit(False)
            shown = F.when(ints, total.try_cast("bigint").cast("string")).when(dbls, total.cast("string")).otherwise(text(Value("dec", total.try_cast(DEC))))
            kind = F.when(ints, XSD + "integer").when(dbls, XSD + "double").otherwise(XSD + "decimal")
            return Value("term", F.when(whole == 0, struct(3, F.lit("0"), XSD + "integer")).when(whole == F.count(x), struct(3, shown, kind)).cast(TERM))
        if v.kind not in NUMERIC:
            return replace(null("int"), col=F.when(whole == 0, F.lit(0).cast("bigint")))
        x = v.col
        kind = v.kind if a.name == "SUM" or v.kind == "dbl" else "dec"
        if v.kind == "dbl":
            c = (F.sum_distinct if a.distinct else F.sum)(x) if a.name == "SUM" else F.sum_distinct(x) / F.count_distinct(x) if a.distinct else F.avg(x)
        elif a.name == "SUM" and not a.distinct:
            c = F.try_sum(x).try_cast(DEC if v.kind == "dec" else "bigint")
        else:
            # a sum of integers as decimals doesn't run over before it is divided
            wide = x.cast("decimal(19,0)") if v.kind == "int" else x
            total = F.sum_distinct(wide.cast("decimal(28,0)") if v.kind == "int" else wide) if a.distinct else F.try_sum(wide)
            c = total.try_cast(DEC if kind == "dec" else "bigint") if a.name == "SUM" else divide(total, (F.count_distinct(x) if a.distinct else F.count(x)).cast("decimal(19,0)"))
        return Value(kind, F.when(whole == 0, F.lit(0).cast(DEC if kind == "dec" else "double" if kind == "dbl" else "bigint")).when(whole == F.count(x), c))


def row_value(vars_: dict[str, Value]) -> Value:
    """A value that is the same for equal bindings, and differs for others as far as a digest of 256 bits tells."""

    def whole(v: Value) -> Column:
        return v.col if v.kind == "term" else text(v)

    return Value("str", F.sha2(F.to_json(F.struct(*[whole(v).alias(cn(n)) for n, v in vars_.items()] or [F.lit(1).alias(UNIT)])), 256), maybe=False)


def _surely(p) -> set[str]:
    """Variables that every solution of a pattern binds."""
    match p:
        case A.Bgp():
            return set(A.visible(p))
        case A.Join(a, b) | A.Lateral(a, b):
            return _surely(a) | _surely(b)
        case A.Union(a, b):
            return _surely(a) & _surely(b)
        case A.LeftJoin(a, _, _) | A.Minus(a, _):
            return _surely(a)
        case A.Graph(name, inner):
            return _surely(inner) | ({name.name} if isinstance(name, Var) else set())
        case A.Values(names, rows):
            return {n for i, n in enumerate(names) if all(r[i] is not None for r in rows)}
        case A.Project(inner, names):
            return _surely(inner) & set(names)
        case A.Filter(_, inner) | A.Extend(inner, _, _) | A.OrderBy(inner, _) | A.Distinct(inner) | A.Reduced(inner) | A.Slice(inner, _, _):
            return _surely(inner)
    return set()


def _nested(p, outer: set[str]) -> bool:
    """Whether a pattern's answer depends on what an outer variable is bound to other than by a join with it."""

    def used(*xs) -> set[str]:
        return {v.name for x in xs if x is not None for v in A.walk(x) if isinstance(v, Var)} & outer

    match p:
        case A.Filter(e, inner):
            return bool(used(e) - _surely(inner)) or _nested(inner, outer)
        case A.Extend(inner, _, e):
            return bool(used(e) - _surely(inner)) or _nested(inner, outer)
        case A.LeftJoin(a, b, e):
            return bool((used(e) | (set(A.visible(b)) & outer)) - _surely(a)) or _nested(a, outer) or _nested(b, outer)
        case A.Minus(a, b):
            return bool(set(A.visible(a)) & set(A.visible(b)) & outer) or bool(used(b) - _surely(a)) or _nested(a, outer) or _nested(b, outer)
        case A.Join(a, b) | A.Union(a, b) | A.Lateral(a, b):
            return _nested(a, outer) or _nested(b, outer)
        case A.Graph(_, inner):
            return _nested(inner, outer)
    return False


def _conjuncts(e) -> list:
    return [*_conjuncts(e.args[0]), *_conjuncts(e.args[1])] if isinstance(e, A.Call) and e.name == "&&" else [e]
