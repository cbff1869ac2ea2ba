"""Checks and plans around a governed dataset: policies, literal validation, routing, entailment routes, encoded joins and scans."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.reason import CHARACTERISTICS, OWL, RDFS, REFUSED, SCHEMA, Ontology
from graphloom.plans.algebra import RDF_TYPE, XSD, Bgp, Graph, Iri, Lit, PIri, Query, Triple, Var, walk
from graphloom.plans.values import TERM


class PolicyViolation(ValueError):
    """Facts that the projection policy doesn't allow."""


@dataclass(frozen=True)
class Treatment:
    """How a predicate is kept: core, virtual or payload; whether rules and queries may use it."""

    kind: str = "core"
    reasoning: bool = True
    queryable: bool = True


def apply_policy(quads: DataFrame, policy: dict[str, Treatment]) -> tuple[DataFrame, DataFrame]:
    """Queryable facts, and the payload ones; an undeclared predicate is an error, not a guess."""
    unknown = [r.p for r in quads.select("p").distinct().where(~F.col("p").isin(*policy)).limit(20).collect()] if policy else ["every predicate"]
    if unknown:
        raise PolicyViolation(f"undeclared predicates: {', '.join(sorted(unknown))}")
    payload = [p for p, t in policy.items() if t.kind == "payload"]
    shown = [p for p, t in policy.items() if t.kind != "payload" and t.queryable]
    return quads.where(F.col("p").isin(*shown)), quads.where(F.col("p").isin(*payload))


# rows as facts


@dataclass(frozen=True)
class ObjectMap:
    """What stands for a predicate's object. entity: a GUID column as urn:uuid:; iri: a constant; typed: a column with
    a datatype; language: a column with a column of language tags."""

    kind: str
    column: str = ""
    datatype: str = ""
    language: str = ""
    value: str = ""

    def term(self) -> Column:
        none, text = F.lit(None).cast("string"), F.col(self.column).cast("string") if self.column else F.lit(self.value)
        k, v, d, l = {
            "entity": (1, F.concat(F.lit("urn:uuid:"), F.lower(text)), none, none), "iri": (1, F.lit(self.value), none, none),
            "typed": (3, text, F.lit(self.datatype), none), "language": (3, text, F.lit("http://www.w3.org/1999/02/22-rdf-syntax-ns#langString"), F.lower(F.col(self.language or self.column).cast("string"))),
        }[self.kind]
        there = v.isNotNull() & l.isNotNull() if self.kind == "language" else v.isNotNull()
        return F.when(there, F.struct(F.lit(k).alias("k"), v.alias("v"), d.alias("d"), l.alias("l"))).cast(TERM)


@dataclass(frozen=True)
class RowMapping:
    """A table as facts: columns of the subject's and the graph's IRIs, and for each predicate its object and treatment."""

    subject: str
    graph: str
    predicates: tuple[tuple[str, ObjectMap, Treatment], ...]


def mapped_quads(rows: DataFrame, mapping: RowMapping) -> tuple[DataFrame, DataFrame]:
    """Queryable facts and payload of a table's rows: quads each, in one scan. Rows without a subject or graph, and objects that are null, state nothing."""

    def quads(chosen: list[tuple[str, ObjectMap]]) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(p).alias("p"), o.term().alias("o")) for p, o in chosen]) if chosen else F.array().cast(f"array<struct<p:string,o:{TERM}>>")
        s = F.struct(F.lit(1).alias("k"), F.col(mapping.subject).cast("string").alias("v"), F.lit(None).cast("string").alias("d"), F.lit(None).cast("string").alias("l")).cast(TERM)
        known = rows.where(F.col(mapping.subject).isNotNull() & F.col(mapping.graph).isNotNull())
        return known.select(s.alias("s"), F.inline(pairs), F.col(mapping.graph).alias("g")).where("o is not null").select("s", "p", "o", "g")

    payload = [(p, o) for p, o, t in mapping.predicates if t.kind == "payload"]
    return quads([(p, o) for p, o, t in mapping.predicates if t.kind != "payload" and t.queryable]), quads(payload)


# literals

_INT = r"^[+-]?\d+$"
_ZONE = r"(Z|[+-](0\d|1[0-3]):[0-5]\d|[+-]14:00)?"
#: Fixed lexical forms of the datatypes, and bounds of the integer ones.
LEXICAL = {
    "boolean": r"^(true|false|0|1)$", "decimal": r"^[+-]?(\d+(\.\d*)?|\.\d+)$", "double": r"^([+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|-?INF|NaN)$", "dateTime": rf"^-?([1-9]\d{{3,}}|0\d{{3}})-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])T(([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d+)?|24:00:00(\.0+)?){_ZONE}$",
    "date": rf"^-?([1-9]\d{{3,}}|0\d{{3}})-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01]){_ZONE}$", "time": rf"^(([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d+)?|24:00:00(\.0+)?){_ZONE}$", "hexBinary": "^([0-9a-fA-F]{2})*$", "language": "^[a-zA-Z]{1,8}(-[a-zA-Z0-9]{1,8})*$",
    "token": r"^(\S+( \S+)*)?$", "normalizedString": r"^[^\t\n\r]*$", "NMTOKEN": r"^[\p{L}\p{N}._:-]+$", "Name": r"^[\p{L}_:][\p{L}\p{N}._:-]*$", "NCName": r"^[\p{L}_][\p{L}\p{N}._-]*$", "string": None, "anyURI": None,
}
LEXICAL |= {"float": LEXICAL["double"], "dateTimeStamp": LEXICAL["dateTime"].replace(")?$", ")$")}
BOUNDS = {
    "integer": (None, None), "long": (-(1 << 63), (1 << 63) - 1), "int": (-(1 << 31), (1 << 31) - 1), "short": (-(1 << 15), (1 << 15) - 1), "byte": (-128, 127), "nonNegativeInteger": (0, None), "positiveInteger": (1, None), "nonPositiveInteger": (None, 0), "negativeInteger": (None, -1),
    "unsignedLong": (0, (1 << 64) - 1), "unsignedInt": (0, (1 << 32) - 1), "unsignedShort": (0, (1 << 16) - 1), "unsignedByte": (0, 255),
}


def literal_fault(v: Column, d: Column) -> Column:
    """Why a lexical form isn't one of its datatype, null if it is; datatypes without rules are unknown."""
    c = F.lit("unknown datatype")
    for name, form in LEXICAL.items():
        c = F.when(d == XSD + name, F.when(~v.rlike(form), f"no {name}") if form else F.lit(None).cast("string")).otherwise(c)
    for name, (lo, hi) in BOUNDS.items():
        n = v.try_cast("decimal(38,0)")
        # more digits than a decimal holds are beyond any bound, on the side of their sign
        low = F.lit(False) if lo is None else F.when(n.isNull(), v.startswith("-")).otherwise(n < F.lit(str(lo)).cast("decimal(38,0)"))
        high = F.lit(False) if hi is None else F.when(n.isNull(), ~v.startswith("-")).otherwise(n > F.lit(str(hi)).cast("decimal(38,0)"))
        c = F.when(d == XSD + name, F.when(~v.rlike(_INT), f"no {name}").when(low | high, f"{name} out of range")).otherwise(c)
    return F.when(d == "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString", F.lit(None).cast("string")).otherwise(c)


def invalid_literals(quads: DataFrame) -> DataFrame:
    """Literals that aren't what they say: (g, p, value, datatype, fault, n)."""
    lits = quads.where("o.k = 3").select("g", "p", F.col("o.v").alias("value"), F.col("o.d").alias("datatype"), literal_fault(F.col("o.v"), F.col("o.d")).alias("fault"))
    return lits.where("fault is not null").groupBy("g", "p", "value", "datatype", "fault").agg(F.count(F.lit(1)).alias("n"))


def first_invalid(quads: DataFrame, order: Sequence[str]) -> DataFrame:
    """The first bad literal in an order, as a report of one row or none."""
    return quads.where("o.k = 3").withColumn("fault", literal_fault(F.col("o.v"), F.col("o.d"))).where("fault is not null").orderBy(*order).limit(1)


def without_source(quads: DataFrame, predicate: str = "http://www.w3.org/ns/prov#wasDerivedFrom") -> DataFrame:
    """Subjects of facts that name no source by the predicate: (s)."""
    return quads.select("s").distinct().join(quads.where(F.col("p") == predicate).select("s"), "s", "left_anti")


# routing


def route_graphs(query: Query, capabilities: DataFrame, authorized: Sequence[str]) -> frozenset[str]:
    """Graphs that can hold a match: those with one of the query's predicates or classes.

    A variable predicate or a property path needs all of them. Only rows for the query's own IRIs are
    read from the index.
    """
    wanted: set[tuple[str, str]] = set()
    for x in walk(query.pattern):
        if isinstance(x, Triple):
            if not isinstance(x.p, Iri):
                return frozenset(authorized)
            if x.p.value == RDF_TYPE and isinstance(x.o, Iri):
                wanted.add(("class", x.o.value))
            else:
                wanted.add(("predicate", x.p.value))
        elif isinstance(x, PIri):
            return frozenset(authorized)
        elif isinstance(x, Graph) and isinstance(x.name, Iri) and x.name.value not in authorized:
            raise PermissionError(x.name.value)
    if not wanted:
        return frozenset(authorized)
    rows = capabilities.where(F.struct("kind", "iri").isin(*[F.struct(F.lit(k), F.lit(i)) for k, i in sorted(wanted)])).select("graphs").collect()
    return frozenset(g for r in rows for g in r.graphs.split(" ")) & frozenset(authorized)


# entailment


class Route(Enum):
    ASSERTED = "asserted"
    CLOSURE = "closure"
    ILLEGAL = "illegal"
    UNKNOWN = "unknown"


def variable_roles(bgp: Bgp) -> dict[str, set[str]]:
    """What each variable of a basic graph pattern stands for: class, property, individual, data."""
    roles: dict[str, set[str]] = {}

    def mark(x, role: str) -> None:
        if isinstance(x, Var):
            roles.setdefault(x.name, set()).add(role)

    schema = {RDFS + "subClassOf": "class", OWL + "equivalentClass": "class", OWL + "disjointWith": "class", RDFS + "subPropertyOf": "property", OWL + "equivalentProperty": "property", OWL + "inverseOf": "property"}
    for t in bgp.triples:
        if isinstance(t.p, Var):
            mark(t.p, "property")
            mark(t.s, "individual")
            continue
        p = t.p.value if isinstance(t.p, Iri) else None
        if p == RDF_TYPE:
            if isinstance(t.o, Iri) and t.o.value in {OWL + "Class", RDFS + "Class"}:
                mark(t.s, "class")
            elif isinstance(t.o, Iri) and (t.o.value in CHARACTERISTICS or t.o.value in {OWL + "ObjectProperty", OWL + "DatatypeProperty"}):
                mark(t.s, "property")
            else:
                mark(t.s, "individual")
                mark(t.o, "class")
        elif p in schema:
            mark(t.s, schema[p])
            mark(t.o, schema[p])
        elif p in (RDFS + "domain", RDFS + "range"):
            mark(t.s, "property")
            mark(t.o, "class")
        else:
            mark(t.s, "individual")
            if isinstance(t.o, Var):
                mark(t.o, "individual")
    return roles


def entailment_route(bgp: Bgp, onto: Ontology, closure: bool) -> tuple[Route, str]:
    """How a pattern is answered, and why: illegal before anything, then from what is asserted, then from the closure.

    A pattern about a construct that the rules don't decide is unknown, which isn't the same as empty.
    """
    for name, roles in sorted(variable_roles(bgp).items()):
        if len(roles) > 1:
            return Route.ILLEGAL, f"?{name} stands for {' and '.join(sorted(roles))}"
    for t in bgp.triples:
        if isinstance(t.s, Lit):
            return Route.ILLEGAL, "a literal is no subject"
        if isinstance(t.p, Iri) and t.p.value in REFUSED:
            return Route.UNKNOWN, t.p.value
    derived = {b for a in (onto.sub_class, onto.sub_property) for bs in a.values() for b in bs} | {c for _, c in onto.domain | onto.range} | {p for _, p in onto.chains} | {p for pair in onto.inverse for p in pair} | {p for ps in onto.traits.values() for p in ps}
    derived |= {p for _, p, _ in onto.has_value_above} | {c for *_, c in onto.has_value_below} | {c for *_, c in onto.some_below} | {d for *_, d in onto.all_above} | {c for _, c in onto.intersections}
    named = {x.value for t in bgp.triples for x in (t.p, t.o) if isinstance(x, Iri)}
    open_ = any(isinstance(t.p, Var) or (isinstance(t.p, Iri) and (t.p.value in SCHEMA or (t.p.value == RDF_TYPE and isinstance(t.o, Var)))) for t in bgp.triples)
    if not open_ and not named & derived:
        return Route.ASSERTED, "nothing about it is derived"
    return (Route.CLOSURE, "the rules decide it") if closure else (Route.UNKNOWN, "no closure is at hand")


# encoded rows


def encoded_join(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join of encoded bindings: multiplicities m are multiplied, proofs put together; an overflow is an error."""
    right = b.withColumnsRenamed({"m": "__m", "proofs": "__proofs"})
    product = F.try_multiply("m", "__m")
    m = F.when(product.isNull(), F.raise_error(F.lit("multiplicity overflow")).cast("bigint")).otherwise(product)
    joined = a.join(right, list(on))
    return joined.select(*[c for c in joined.columns if c not in ("m", "__m", "proofs", "__proofs")], m.alias("m"), F.array_union("proofs", "__proofs").alias("proofs"))


def leaf_scan(facts: DataFrame, graphs: Sequence[int], s: int | None = None, p: int | None = None, o: int | None = None, ceiling: int | None = None) -> DataFrame:
    """Encoded facts that match the ids given, in authorized graphs only; equalities reach the Parquet scan.

    Beyond the ceiling the scan is an error.
    """
    c = F.col("g").isin(*graphs) if graphs else F.lit(False)
    for name, v in (("s", s), ("p", p), ("o", o)):
        if v is not None:
            c = c & (F.col(name) == v)
    out = facts.where(c)
    if ceiling is not None and out.limit(ceiling + 1).count() > ceiling:
        raise OverflowError(f"more than {ceiling} rows")
    return out


def hash_buckets(quads: DataFrame, buckets: int) -> DataFrame:
    """Facts with the bucket their digest falls into, laid out by it."""
    parts = [F.col("s.v"), F.col("p"), F.col("o.v"), F.coalesce("o.d", F.lit("")), F.coalesce("o.l", F.lit("")), F.col("g")]
    return quads.withColumn("bucket", F.pmod(F.xxhash64(*parts), F.lit(buckets)).cast("int")).repartition(buckets, "bucket")
