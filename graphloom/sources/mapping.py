"""Relational tables as virtual graphs: triple patterns become scans of typed columns.

Patterns about one subject are one scan of a table, without self-joins. Joins between subjects compare
keys, not IRIs; an IRI is put together only where it is asked for.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.builtins import Compiler
from graphloom.plans.algebra import RDF_TYPE, Iri, Triple, Var
from graphloom.plans.lower import Forbidden, Scope, Unsupported
from graphloom.plans.relation import Rel, join, union
from graphloom.plans.values import TERM, Value, constant, term, text, unify
from graphloom.sources.quads import Active
from graphloom.session import table

PREDICATE, GRAPH, CLASS = "urn:p:", "urn:g:", "urn:c:"


@dataclass(frozen=True)
class Mapping:
    """A table as a graph.

    key: column of the subject's IRI, urn:<name>:<key>; None for the digest of the whole row. links: FK
    columns to the table they refer to, as predicates urn:p:<column>:ref. payload: columns outside the
    graph, which only hydration reads.
    """

    name: str
    key: str | None
    links: tuple[tuple[str, str], ...] = ()
    payload: tuple[str, ...] = ()
    labels: frozenset[str] = frozenset({"public"})
    load: Callable[[SparkSession], DataFrame] | None = None

    @property
    def graph(self) -> str:
        return GRAPH + self.name


def _kind(t: T.DataType) -> str | None:
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(t, T.DecimalType):
        return "dec"
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return "dbl"
    return {T.StringType: "str", T.BooleanType: "bool", T.TimestampNTZType: "dt", T.TimestampType: "dt", T.DateType: "date"}.get(type(t))


@dataclass
class VirtualSource:
    spark: SparkSession
    mappings: list[Mapping]
    active: Active
    folder: str = ""
    frames: dict[str, DataFrame] = field(default_factory=dict)

    def frame(self, m: Mapping) -> DataFrame:
        if m.name not in self.frames:
            self.frames[m.name] = m.load(self.spark) if m.load else table(self.spark, self.folder, m.name)
        return self.frames[m.name]

    def fields(self, m: Mapping) -> dict[str, Value]:
        """Predicate to value, for every column that has a place in the graph."""
        out: dict[str, Value] = {}
        links = dict(m.links)
        for f in self.frame(m).schema:
            if f.name in m.payload or (kind := _kind(f.dataType)) is None:
                continue
            c = F.col(f.name)
            c = c.cast("bigint") if kind == "int" and not isinstance(f.dataType, T.LongType) else c.cast("timestamp_ntz") if isinstance(f.dataType, T.TimestampType) else c
            out[PREDICATE + f.name] = Value(kind, c, maybe=False)
            if f.name in links:
                out[f"{PREDICATE}{f.name}:ref"] = Value("key", c, f"urn:{links[f.name]}:", False, kind == "int")
        return out

    def subject(self, m: Mapping) -> Value:
        if m.key is not None:
            c = F.col(m.key)
            kind = _kind(self.frame(m).schema[m.key].dataType)
            return Value("key", c.cast("bigint") if kind == "int" else c, f"urn:{m.name}:", False, kind == "int")
        cols = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in self.frame(m).columns if c not in m.payload]
        return Value("key", F.md5(F.concat_ws("\1", *cols)), f"urn:{m.name}:", False)

    def scope(self, scope: Scope) -> list[Mapping]:
        if scope.graph is not None:
            if scope.graph not in self.active.named:
                raise Forbidden(f"graph {scope.graph} is not in the dataset")
            return [m for m in self.mappings if m.graph == scope.graph]
        graphs = self.active.named if scope.var else self.active.default
        return [m for m in self.mappings if m.graph in graphs]

    def star(self, m: Mapping, triples: list[Triple], scope: Scope) -> Rel | None:
        """The patterns about one subject over one table; None if the table can't match them."""
        fields = self.fields(m)
        df = self.frame(m)
        vals: dict[str, Value] = {}
        where = F.lit(True)
        if scope.var:
            vals[scope.var] = Value("iri", F.lit(m.graph), maybe=False)

        def match(x, v: Value) -> None:
            nonlocal where
            if isinstance(x, Var):
                if x.name in vals:
                    a, b = unify(vals[x.name], v)
                    where = where & (a.col == b.col)
                else:
                    vals[x.name] = v
            elif isinstance(x, Iri) and v.kind == "key":
                where = where & _is_key(v, x.value)
            else:
                where = where & Compiler({}).equal(v, constant(x))

        for i, t in enumerate(triples):
            if isinstance(t.p, Iri):
                if t.p.value == RDF_TYPE:
                    v = Value("iri", F.lit(CLASS + m.name), maybe=False)
                    if isinstance(t.o, Iri) and t.o.value != CLASS + m.name:
                        return None
                elif t.p.value in fields:
                    v = fields[t.p.value]
                    where = where & v.col.isNotNull()
                else:
                    return None
                match(t.o, v)
            else:
                # any predicate: the row's columns as (p, o), beside the row itself
                pairs = [F.struct(F.lit(p).alias("p"), term(v).col.alias("o")) for p, v in fields.items()]
                pairs.append(F.struct(F.lit(RDF_TYPE).alias("p"), term(Value("iri", F.lit(CLASS + m.name))).col.alias("o")))
                df = df.withColumn(f"__po{i}", F.explode(F.array(*pairs)))
                where = where & F.col(f"__po{i}.o").isNotNull()
                match(t.p, Value("iri", F.col(f"__po{i}.p"), maybe=False))
                match(t.o, Value("term", F.col(f"__po{i}.o"), maybe=False))
        match(triples[0].s, self.subject(m))
        return Rel.of(df, vals, where)

    def bgp(self, triples: list[Triple], scope: Scope) -> Rel:
        stars: dict[object, list[Triple]] = {}
        for t in triples:
            stars.setdefault(t.s, []).append(t)
        rels: list[Rel] = []
        for parts in stars.values():
            hits = [r for m in self.scope(scope) if (r := self.star(m, parts, scope)) is not None]
            names = dict.fromkeys(x.name for t in parts for x in (t.s, t.p, t.o) if isinstance(x, Var))
            if not hits:
                none = {n: Value("term", F.lit(None).cast(TERM), maybe=False) for n in [*names, *([scope.var] if scope.var else [])]}
                hits = [Rel.of(self.spark.range(0), none)]
            rel = hits[0]
            for r in hits[1:]:
                rel = union(rel, r)
            rels.append(rel)
        rel = rels.pop(0)
        while rels:
            near = next((r for r in rels if set(r.vars) & set(rel.vars)), rels[0])
            rels.remove(near)
            rel = join(rel, near)
        return rel

    def spread(self, m: Mapping) -> DataFrame:
        """The table's rows over all tasks: a file of one row group is one task's, which would make all its facts."""
        df = self.frame(m)
        return df.repartition(*[m.key] if m.key else [f.name for f in df.schema if f.name not in m.payload])

    def edges(self, predicates: set[str] | None, scope: Scope, spread: bool = False) -> DataFrame:
        out = None
        for m in self.scope(scope):
            fields = {p: v for p, v in self.fields(m).items() if predicates is None or p in predicates}
            if predicates is None or RDF_TYPE in predicates:
                fields[RDF_TYPE] = Value("iri", F.lit(CLASS + m.name), maybe=False)
            if fields:
                pairs = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), term(v).col.alias("o")) for p, v in fields.items()]))
                # the subject first: beside the explode it would be put together again for each fact; the array within it, else a filter of its size goes down to the scan
                rows = (self.spread(m) if spread else self.frame(m)).withColumn("__s", term(self.subject(m)).col).select(F.col("__s").alias("s"), pairs.alias("x"))
                rows = rows.select("s", "x.p", "x.o", F.lit(m.graph if scope.var else "").alias("g")).where("o is not null")
                out = rows if out is None else out.unionByName(rows)
        return out if out is not None else self.spark.createDataFrame([], f"s {TERM}, p string, o {TERM}, g string")

    def triples(self, m: Mapping) -> DataFrame:
        """The graph's triples as quads, for materialising it."""
        only = replace(self, active=Active(frozenset(), frozenset({m.graph})))
        return only.edges(None, Scope(var="g"), spread=True)


def _is_key(v: Value, iri: str) -> Column:
    """Whether a key makes an IRI, as a comparison of the key's own type, which scans can be filtered by."""
    rest = iri.removeprefix(v.prefix)
    if rest == iri:
        return F.lit(False)
    if not v.integer:
        return v.col.cast("string") == rest
    return v.col == F.lit(int(rest)).cast("bigint") if re.fullmatch("0|-?[1-9][0-9]{0,17}", rest) else F.lit(False)


def subject_text(v: Value) -> Column:
    if v.kind not in ("iri", "key", "term"):
        raise Unsupported("a literal is no subject")
    return text(v)
