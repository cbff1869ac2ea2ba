"""Queries over a catalog of governed graphs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.governed import route_graphs
from graphloom.plans import algebra as A
from graphloom.plans.algebra import Iri, Query, Var
from graphloom.plans.lower import Forbidden, Lowering, Scope, Unsupported
from graphloom.plans.parser import parse
from graphloom.plans.paths import Limits
from graphloom.plans.relation import Rel
from graphloom.plans.values import TERM, struct, term, term_constant
from graphloom.session import checkpoint, round_checkpoint
from graphloom.sources.mapping import Mapping, VirtualSource
from graphloom.sources.quads import Active, QuadSource
from graphloom.sources.rdf import DEFAULT, ntriples

PUBLIC = frozenset({"public"})


class TooLarge(RuntimeError):
    """A result beyond its ceiling; results are whole or not given."""


@dataclass(frozen=True)
class GraphRecord:
    """A declared graph: its labels, and whether queries may see it. The source's default graph has no name."""

    name: str
    labels: frozenset[str] = PUBLIC
    visible: bool = True
    role: str = "data"


@dataclass
class Catalog:
    graphs: list[GraphRecord]

    def __post_init__(self) -> None:
        if len({g.name for g in self.graphs}) != len(self.graphs):
            raise ValueError("a graph is declared twice")

    def authorized(self, principal: frozenset[str]) -> list[str]:
        return sorted(g.name for g in self.graphs if g.name != DEFAULT and g.visible and g.labels & principal)

    def resolve(self, principal: frozenset[str], query: Query, protocol: tuple[tuple[str, ...], tuple[str, ...]] | None = None) -> tuple[Active, str]:
        """The active dataset: of the protocol, else of FROM and FROM NAMED, else all authorized graphs in both roles."""
        may = frozenset(self.authorized(principal))
        if protocol is not None and (protocol[0] or protocol[1]):
            default, named, how = protocol[0], protocol[1], "protocol"
        elif query.default_graphs or query.named_graphs:
            default, named, how = query.default_graphs, query.named_graphs, "query"
        else:
            return Active(may, may), "service"
        if bad := sorted((set(default) | set(named)) - may):
            raise Forbidden(f"graphs not authorized: {', '.join(bad)}")
        return Active(frozenset(default), frozenset(named)), how


    def of_roles(self, active: Active, roles: frozenset[str] | None) -> Active:
        """The part of an active dataset whose graphs have one of the roles; none at all is an error."""
        if roles is None:
            return active
        may = frozenset(g.name for g in self.graphs if g.role in roles)
        kept = Active(active.default & may, active.named & may)
        if not kept.default | kept.named:
            raise Forbidden("no graph of these roles")
        return kept


@dataclass
class Engine:
    """A dataset of quads or of mapped tables, with what its queries may do.

    capabilities: of capability_index(), to read only graphs that can match; roles: those of the graphs
    that may answer, all if it is None.
    """

    spark: SparkSession
    catalog: Catalog
    quads: DataFrame | None = None
    closure: DataFrame | None = None
    mappings: list[Mapping] | None = None
    folder: str = ""
    limits: Limits = field(default_factory=Limits)
    services: dict[str, Engine] = field(default_factory=dict)
    functions: dict[str, Callable] = field(default_factory=dict)
    row_ceiling: int | None = None
    capabilities: DataFrame | None = None
    roles: frozenset[str] | None = None
    frames: dict[str, DataFrame] = field(default_factory=dict)

    @staticmethod
    def over_quads(quads: DataFrame, catalog: Catalog | None = None, **more) -> Engine:
        """Without a catalog every graph that occurs is public; their names, not their facts, come to the driver."""
        catalog = catalog or Catalog([GraphRecord(r.g) for r in quads.select("g").distinct().collect()])
        return Engine(quads.sparkSession, catalog, quads, **more)

    @staticmethod
    def over_tables(spark: SparkSession, folder: str, mappings: list[Mapping], **more) -> Engine:
        return Engine(spark, Catalog([GraphRecord(m.graph, m.labels) for m in mappings]), mappings=mappings, folder=folder, **more)

    def source(self, active: Active, entailed: bool = True):
        if self.mappings is not None:
            return VirtualSource(self.spark, self.mappings, active, self.folder, self.frames)
        return QuadSource(self.quads, active, self.closure if entailed else None)

    def lowering(self, query: Query, principal: frozenset[str], protocol=None) -> Lowering:
        active, how = self.catalog.resolve(principal, query, protocol)
        active = self.routed(query, self.catalog.of_roles(active, self.roles))
        services = {}
        for iri, e in self.services.items():
            may = frozenset(e.catalog.authorized(principal))
            services[iri] = e.source(Active(may, may))
        return Lowering(self.source(active, how == "service"), query.base, self.limits, services, self.functions)

    def routed(self, query: Query, active: Active) -> Active:
        """The graphs that can match, by the capability index if there is one; graphs that the query names stay."""
        if self.capabilities is None or any(isinstance(x, A.Graph) and x.inner == A.Bgp() for x in A.walk(query.pattern)) or query.form == "DESCRIBE":
            return active
        named = {x.name.value for x in A.walk(query.pattern) if isinstance(x, A.Graph) and isinstance(x.name, Iri)}
        if named - active.named:
            return active  # refused where the pattern is read
        needed = route_graphs(query, self.capabilities, sorted(active.default | active.named)) | named
        return Active(active.default & needed, active.named & needed)

    def relation(self, text: str | Query, principal: frozenset[str] = PUBLIC, protocol=None) -> Rel:
        query = parse(text) if isinstance(text, str) else text
        return self.lowering(query, principal, protocol)(query.pattern)

    def query(self, text: str, principal: frozenset[str] = PUBLIC, protocol=None) -> DataFrame:
        """The result as a DataFrame: the head's columns, `ask`, or subject, predicate and object."""
        query = parse(text)
        lower = self.lowering(query, principal, protocol)
        if query.form == "SELECT":
            out = lower(query.pattern).decoded(list(query.names))
        elif query.form == "ASK":
            hit = lower(query.pattern).df.limit(1)
            out = hit.agg((F.count(F.lit(1)) > 0).alias("ask"))
        else:
            triples = construct(lower, query) if query.form == "CONSTRUCT" else describe(lower, query)
            out = triples.select(ntriples(F.col("s")).alias("subject"), ntriples(F.col("p")).alias("predicate"), ntriples(F.col("o")).alias("object"))
        return self.checked(out)

    def checked(self, df: DataFrame) -> DataFrame:
        """Beyond the ceiling a result is an error, never cut."""
        if self.row_ceiling is not None and df.limit(self.row_ceiling + 1).count() > self.row_ceiling:
            raise TooLarge(f"more than {self.row_ceiling} rows")
        return df


def construct(lower: Lowering, query: Query) -> DataFrame:
    """Triples (s, p, o) of the template: a set; blank nodes are new for each solution, incomplete triples are left out.

    For blank nodes the solutions are numbered and kept by a checkpoint, so that a task that is run again
    gives the same ones.
    """
    rel = lower(query.pattern)
    row = F.lit("")
    if any(isinstance(x, Var) and x.name.startswith(".") for t in query.template for x in (t.s, t.p, t.o)):
        rel = Rel(checkpoint(rel.df.withColumn("__row", F.monotonically_increasing_id())), rel.vars)
        row = F.concat(F.col("__row").cast("string"), F.lit(" "))
    shown = {n: term(v).col for n, v in rel.vars.items()}

    def cell(x):
        if isinstance(x, Var):
            if x.name in shown:
                return shown[x.name]
            return struct(2, F.concat(row, F.lit(x.name))) if x.name.startswith(".") else F.lit(None).cast(TERM)
        return term_constant(x).col

    parts = F.array(*[F.struct(cell(t.s).alias("s"), cell(t.p).alias("p"), cell(t.o).alias("o")) for t in query.template])
    rows = rel.df.select(F.explode(parts).alias("t")).select("t.s", "t.p", "t.o")
    return rows.where("s is not null and p is not null and o is not null and s.k < 3 and p.k = 1").distinct()


def describe(lower: Lowering, query: Query) -> DataFrame:
    """All triples from the resources on, and on from each blank node that they reach."""
    rel = lower(query.pattern)
    edges = lower.source.edges(None, Scope())
    about = None
    for x in query.describe:
        if isinstance(x, Iri):
            part = lower.spark.range(1).select(term_constant(x).col.alias("s"))
        elif x.name in rel.vars:
            part = rel.df.select(term(rel.vars[x.name]).col.alias("s")).where("s is not null and s.k < 3")
        else:
            continue
        about = part if about is None else about.unionByName(part)
    if about is None:
        raise Unsupported("nothing to describe")
    about = about.distinct()
    out = edges.join(about, "s", "left_semi")
    seen = about
    while True:
        further = out.where("o.k = 2").select(F.col("o").alias("s")).distinct().join(seen, "s", "left_anti")
        if not further.limit(1).count():
            break
        seen = round_checkpoint(seen.unionByName(further))
        out = edges.join(seen, "s", "left_semi")
    return out.select("s", struct(1, F.col("p")).alias("p"), "o").distinct()


__all__ = ["A", "Catalog", "Engine", "GraphRecord", "PUBLIC", "TooLarge", "construct", "describe"]
