"""Materialised consequences of an ontology, for the part of it that rules decide.

Supported are subclasses and equivalent classes, subproperties and equivalent properties, domains,
ranges, inverse, symmetric, transitive, functional and inverse functional properties, property chains,
sameAs, hasValue, someValuesFrom below and allValuesFrom above a subclass axiom, and intersections. Any
other construct is refused, so an answer is never silently incomplete. The ontology is small and kept on
the driver behind a ceiling; facts stay distributed. Each consequence carries the graphs it follows from.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.plans.algebra import RDF, RDF_TYPE
from graphloom.plans.values import TERM
from graphloom.session import checkpoint, round_checkpoint, small

RDFS, OWL = "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2002/07/owl#"
SAME = OWL + "sameAs"
ONTOLOGY_TRIPLES = 1_000_000
#: Fixed vocabulary: what schema triples say, and constructs that the rules don't decide.
SCHEMA = [RDFS + n for n in ("subClassOf", "subPropertyOf", "domain", "range")] + [OWL + n for n in "equivalentClass equivalentProperty inverseOf propertyChainAxiom onProperty someValuesFrom allValuesFrom hasValue intersectionOf disjointWith".split()] + [RDF + n for n in ("first", "rest")]
REFUSED = [OWL + n for n in "unionOf complementOf oneOf hasKey hasSelf cardinality minCardinality maxCardinality qualifiedCardinality minQualifiedCardinality maxQualifiedCardinality propertyDisjointWith disjointUnionOf onDatatype sourceIndividual".split()]
CHARACTERISTICS = {OWL + n: n for n in "SymmetricProperty TransitiveProperty FunctionalProperty InverseFunctionalProperty".split()}
IGNORED_CLASSES = {OWL + n for n in "Class ObjectProperty DatatypeProperty AnnotationProperty Ontology NamedIndividual Restriction Thing".split()} | {RDFS + "Class", RDF + "Property"} | set(CHARACTERISTICS)


class UnsupportedAxiom(ValueError):
    """A construct outside the rules."""


class Inconsistent(ValueError):
    """Facts that contradict the ontology."""


@dataclass
class Ontology:
    sub_class: dict[str, set[str]] = field(default_factory=lambda: defaultdict(set))
    sub_property: dict[str, set[str]] = field(default_factory=lambda: defaultdict(set))
    domain: set[tuple[str, str]] = field(default_factory=set)
    range: set[tuple[str, str]] = field(default_factory=set)
    inverse: set[tuple[str, str]] = field(default_factory=set)
    traits: dict[str, set[str]] = field(default_factory=lambda: defaultdict(set))
    chains: list[tuple[tuple[str, ...], str]] = field(default_factory=list)
    has_value_above: list[tuple[str, str, tuple]] = field(default_factory=list)
    has_value_below: list[tuple[str, tuple, str]] = field(default_factory=list)
    some_below: list[tuple[str, str, str]] = field(default_factory=list)
    all_above: list[tuple[str, str, str]] = field(default_factory=list)
    intersections: list[tuple[tuple[str, ...], str]] = field(default_factory=list)
    disjoint: set[tuple[str, str]] = field(default_factory=set)
    graphs: tuple[str, ...] = ()


def _closed(direct: dict[str, set[str]]) -> dict[str, set[str]]:
    out = {}
    for k in list(direct):
        seen, todo = set(), list(direct[k])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += direct.get(x, ())
        out[k] = seen
    return out


def ontology(quads: DataFrame) -> Ontology:
    """The axioms among the quads; UnsupportedAxiom for one the rules can't decide, and for an import whose ontology isn't there.

    What an ontology imports must be among the quads, as a graph of that name or under its ontology header.
    """
    imports = quads.where(F.col("p") == OWL + "imports").select(F.col("o.v").alias("iri")).distinct()
    headers = quads.where((F.col("p") == RDF_TYPE) & (F.col("o.v") == OWL + "Ontology")).select(F.col("s.v").alias("iri"))
    if missing := imports.join(quads.select(F.col("g").alias("iri")).unionByName(headers).distinct(), "iri", "left_anti").limit(20).collect():
        raise UnsupportedAxiom("imports that aren't there: " + ", ".join(sorted(r.iri for r in missing)))
    schema = quads.where(F.col("p").isin(*SCHEMA, *REFUSED) | ((F.col("p") == RDF_TYPE) & F.col("o.v").isin(*CHARACTERISTICS, OWL + "AllDisjointClasses", OWL + "NegativePropertyAssertion"))).distinct()
    rows = schema.limit(ONTOLOGY_TRIPLES + 1).collect()
    if len(rows) > ONTOLOGY_TRIPLES:
        raise UnsupportedAxiom("the ontology is beyond its ceiling")
    if bad := sorted({r.p for r in rows if r.p in REFUSED} | {r.o.v for r in rows if r.p == RDF_TYPE and r.o.v not in CHARACTERISTICS}):
        raise UnsupportedAxiom(", ".join(bad))
    by = defaultdict(list)
    for r in rows:
        by[r.s.v, r.p].append(tuple(r.o))

    def one(s: str, p: str) -> tuple | None:
        return by[s, p][0] if by.get((s, p)) else None

    def items(head: str) -> tuple[str, ...]:
        out = []
        while head != RDF + "nil":
            out.append(one(head, RDF + "first")[1])
            head = one(head, RDF + "rest")[1]
        return tuple(out)

    o = Ontology(graphs=tuple(sorted({r.g for r in rows})))
    blank = {r.s.v for r in rows if r.s.k == 2}

    def below(c: tuple, d: tuple) -> None:
        """Class c is a subclass of d; either may be a restriction or an intersection."""
        (ck, cv), (dk, dv) = c[:2], d[:2]
        for v in (cv, dv):
            if v in blank and not any((v, p) in by for p in (OWL + "onProperty", OWL + "intersectionOf")):
                raise UnsupportedAxiom(f"class expression {v}")
        inter = one(dv, OWL + "intersectionOf")
        if inter and dv in blank:
            for x in items(inter[1]):
                below(c, (2 if x in blank else 1, x))
            return
        inter = one(cv, OWL + "intersectionOf")
        if inter and cv in blank:
            parts = items(inter[1])
            if any(x in blank for x in parts):
                raise UnsupportedAxiom("intersection of restrictions below a class")
            o.intersections.append((parts, dv))
            return
        if dk == 2 or dv in blank:
            p = one(dv, OWL + "onProperty")[1]
            if ck == 2:
                raise UnsupportedAxiom("restriction below a restriction")
            if (v := one(dv, OWL + "hasValue")) is not None:
                o.has_value_above.append((cv, p, v))
            elif (v := one(dv, OWL + "allValuesFrom")) is not None and v[1] not in blank:
                o.all_above.append((cv, p, v[1]))
            else:
                raise UnsupportedAxiom("restriction above a class")
            return
        if ck == 2 or cv in blank:
            p = one(cv, OWL + "onProperty")[1]
            if (v := one(cv, OWL + "hasValue")) is not None:
                o.has_value_below.append((p, v, dv))
            elif (v := one(cv, OWL + "someValuesFrom")) is not None and v[1] not in blank:
                o.some_below.append((p, v[1], dv))
            else:
                raise UnsupportedAxiom("restriction below a class")
            return
        o.sub_class[cv].add(dv)

    for r in rows:
        s, v = r.s.v, r.o.v
        match r.p:
            case p if p == RDFS + "subClassOf":
                below((r.s.k, s), (r.o.k, v))
            case p if p == OWL + "equivalentClass":
                for a, b in (((r.s.k, s), (r.o.k, v)), ((r.o.k, v), (r.s.k, s))):
                    inner = a[1] if a[0] == 2 else b[1]
                    # a restriction says something in one direction only, as far as rules go
                    if {a[0], b[0]} == {1, 2} and ((b[0] == 2 and one(inner, OWL + "someValuesFrom")) or (a[0] == 2 and one(inner, OWL + "allValuesFrom"))):
                        raise UnsupportedAxiom("equivalence with a restriction")
                    below(a, b)
            case p if p == RDFS + "subPropertyOf":
                o.sub_property[s].add(v)
            case p if p == OWL + "equivalentProperty":
                o.sub_property[s].add(v)
                o.sub_property[v].add(s)
            case p if p == RDFS + "domain":
                o.domain.add((s, v))
            case p if p == RDFS + "range":
                o.range.add((s, v))
            case p if p == OWL + "inverseOf":
                o.inverse |= {(s, v), (v, s)}
            case p if p == OWL + "propertyChainAxiom":
                o.chains.append((items(v), s))
            case p if p == OWL + "disjointWith":
                o.disjoint.add((s, v))
            case p if p == RDF_TYPE:
                o.traits[CHARACTERISTICS[v]].add(s)
            case p if p == OWL + "intersectionOf" and s not in blank:
                parts = items(v)
                o.intersections.append((parts, s))
                for x in parts:
                    o.sub_class[s].add(x)
    o.sub_class, o.sub_property = _closed(o.sub_class), _closed(o.sub_property)
    return o


def _iri(v: str | Column) -> Column:
    c = v if isinstance(v, Column) else F.lit(v)
    return F.struct(F.lit(1).alias("k"), c.alias("v"), F.lit(None).cast("string").alias("d"), F.lit(None).cast("string").alias("l")).cast(TERM)


class _Rules:
    """One round of all rules over facts (s, p, o, support), for what the last round added: each rule joins that with the facts, in every place."""

    def __init__(self, o: Ontology, facts: DataFrame):
        self.o, self.spark = o, facts.sparkSession
        self.t = F.array_sort(F.array(*[F.lit(g) for g in o.graphs])) if o.graphs else F.array().cast("array<string>")

    def pairs(self, d: dict[str, set[str]], a: str, b: str) -> DataFrame | None:
        rows = [(k, x) for k, v in d.items() for x in v if x != k]
        return self.listed(rows, f"{a} string, {b} string") if rows else None

    def listed(self, rows: list[tuple], schema: str) -> DataFrame:
        return small(self.spark.createDataFrame(rows, schema), len(rows))

    def both(self, *supports: str) -> Column:
        c = self.t
        for s in supports:
            c = F.array_union(c, F.col(s))
        return F.array_sort(F.array_distinct(c)).alias("support")

    def types(self, facts: DataFrame) -> DataFrame:
        return facts.where(F.col("p") == RDF_TYPE).select("s", F.col("o.v").alias("c"), "support")

    def uses(self, facts: DataFrame, p: str, s: str = "s", o: str = "o", support: str = "support") -> DataFrame:
        return facts.where(F.col("p") == p).select(F.col("s").alias(s), F.col("o").alias(o), F.col("support").alias(support))

    def __call__(self, facts: DataFrame, delta: DataFrame | None = None) -> DataFrame:
        o, out = self.o, []
        add = out.append
        new = facts if delta is None else delta

        def places(n: int) -> list[list[DataFrame]]:
            """For a rule of n facts, where the new ones stand: in one place each time, in all at first."""
            return [[facts] * n] if delta is None else [[facts] * i + [delta] + [facts] * (n - 1 - i) for i in range(n)]

        types = self.types(new)

        def typed(rows: DataFrame, s: str, c: Column | str, *supports: str) -> None:
            add(rows.select(F.col(s).alias("s"), F.lit(RDF_TYPE).alias("p"), _iri(c).alias("o"), self.both(*supports)))

        if (m := self.pairs(o.sub_class, "c", "d")) is not None:
            typed(types.join(m, "c"), "s", F.col("d"), "support")
        if (m := self.pairs(o.sub_property, "p", "q")) is not None:
            add(new.join(m, "p").select("s", F.col("q").alias("p"), "o", self.both("support")))
        for pairs, end in ((o.domain, "s"), (o.range, "o")):
            if pairs:
                typed(new.where(F.col(f"{end}.k") < 3).join(self.listed(sorted(pairs), "p string, c string"), "p"), end, F.col("c"), "support")
        swaps = set(o.inverse) | {(p, p) for p in o.traits["SymmetricProperty"]}
        if swaps:
            add(new.where("o.k < 3").join(self.listed(sorted(swaps), "p string, q string"), "p").select(F.col("o").alias("s"), F.col("q").alias("p"), F.col("s").alias("o"), self.both("support")))
        for steps, p in [*o.chains, *[((p, p), p) for p in sorted(o.traits["TransitiveProperty"])]]:
            for first, *rest in places(len(steps)):
                path = self.uses(first, steps[0], "s", "x", "u")
                for q, there in zip(steps[1:], rest, strict=True):
                    path = path.join(self.uses(there, q, "x", "y", "w"), "x").select("s", F.col("y").alias("x"), self.both("u", "w").alias("u"))
                add(path.select("s", F.lit(p).alias("p"), F.col("x").alias("o"), F.col("u").alias("support")))
        if o.has_value_above:
            add(types.join(self.listed(o.has_value_above, f"c string, q string, v {TERM}"), "c").select("s", F.col("q").alias("p"), F.col("v").alias("o"), self.both("support")))
        if o.has_value_below:
            typed(new.join(self.listed(o.has_value_below, f"p string, o {TERM}, c string"), ["p", "o"]), "s", F.col("c"), "support")
        for p, d, c in o.some_below:
            if d == OWL + "Thing":
                typed(self.uses(new, p, "s", "y", "u"), "s", c, "u")
                continue
            for x, y in places(2):
                typed(self.uses(x, p, "s", "y", "u").join(self.types(y).where(F.col("c") == d).select(F.col("s").alias("y"), "support"), "y"), "s", c, "u", "support")
        for c, p, d in o.all_above:
            for x, y in places(2):
                typed(self.uses(x, p, "s", "y", "u").join(self.types(y).where(F.col("c") == c).select("s", "support"), "s"), "y", d, "u", "support")
        for parts, c in o.intersections:
            for first, *rest in places(len(parts)):
                rows = self.types(first).where(F.col("c") == parts[0]).select("s", F.col("support").alias("u"))
                for d, there in zip(parts[1:], rest, strict=True):
                    rows = rows.join(self.types(there).where(F.col("c") == d).select("s", F.col("support").alias("w")), "s").select("s", self.both("u", "w").alias("u"))
                typed(rows, "s", c, "u")
        for trait, key, other in (("FunctionalProperty", "s", "o"), ("InverseFunctionalProperty", "o", "s")):
            for p in sorted(o.traits[trait]):
                # every value is the same as the least of its group, whatever groups the new facts touch
                of = (F.col("p") == p) & (F.col("o.k") < 3)
                use = facts.where(of).join(new.where(of).select(key).distinct(), key, "left_semi")
                least = use.groupBy(key).agg(F.min_by(F.struct(other, "support"), F.col(f"{other}.v")).alias("m"), F.count_distinct(other).alias("n")).where("n > 1").select(key, F.col(f"m.{other}").alias("y"), F.col("m.support").alias("w"))
                add(use.join(least, key).where(F.col(other) != F.col("y")).select(F.col(other).alias("s"), F.lit(SAME).alias("p"), F.col("y").alias("o"), self.both("support", "w")))

        def equal(rows: DataFrame) -> DataFrame:
            return rows.where(F.col("p") == SAME).select(F.col("s").alias("a"), F.col("o").alias("b"), F.col("support").alias("w")).where("a <> b")

        add(equal(new).select(F.col("b").alias("s"), F.lit(SAME).alias("p"), F.col("a").alias("o"), F.col("w").alias("support")))
        for end in ("s", "o"):
            for x, y in places(2):
                moved = x.join(equal(y).withColumnRenamed("a", end), end)
                add(moved.select(F.col("b").alias("s") if end == "s" else "s", "p", F.col("b").alias("o") if end == "o" else "o", self.both("support", "w")))
        total = out[0]
        for x in out[1:]:
            total = total.unionByName(x)
        return total


def materialize(quads: DataFrame, onto: Ontology | None = None, rounds: int = 100) -> DataFrame:
    """All consequences that aren't asserted: (s, p, o, support).

    Rounds of all rules, each over what the one before added, until nothing new comes; each is kept by a
    checkpoint. A fact that follows from
    several sets of graphs has a row for each, unless one set holds another.
    """
    onto = onto or ontology(quads)
    schema = set(SCHEMA)
    asserted = quads.where(~F.col("p").isin(*schema)).where(~((F.col("p") == RDF_TYPE) & F.col("o.v").isin(*IGNORED_CLASSES))).select("s", "p", "o", F.array("g").alias("support")).distinct()
    facts = checkpoint(asserted)
    rules, delta = _Rules(onto, facts), None
    for _ in range(rounds):
        new = rules(facts, delta).where("s <> o or p <> '" + SAME + "'").distinct()
        # a row adds nothing if a known one has the same fact from fewer or the same graphs
        known = facts.select(F.col("s").alias("s2"), F.col("p").alias("p2"), F.col("o").alias("o2"), F.col("support").alias("k2"))
        held = (F.col("s") == F.col("s2")) & (F.col("p") == F.col("p2")) & (F.col("o") == F.col("o2")) & (F.size(F.array_except("k2", "support")) == 0)
        new = checkpoint(new.join(known, held, "left_anti"))
        if not new.limit(1).count():
            break
        delta = new
        facts = round_checkpoint(facts.unionByName(new))
    else:
        raise UnsupportedAxiom("no end of consequences within the rounds")
    if onto.disjoint:
        types = facts.where(F.col("p") == RDF_TYPE).select("s", F.col("o.v").alias("c"))
        pairs = rules.listed(sorted(onto.disjoint), "c string, d string")
        if types.join(pairs, "c").join(types.withColumnRenamed("c", "d"), ["s", "d"]).limit(1).count():
            raise Inconsistent("an individual of two disjoint classes")
    mine = facts.join(quads.select("s", "p", "o").distinct(), ["s", "p", "o"], "left_anti")
    return mine.unionByName(schema_closure(facts, onto)) if onto.sub_class or onto.sub_property else mine


def schema_closure(facts: DataFrame, onto: Ontology) -> DataFrame:
    """Super classes and properties of all, as triples."""
    rows = [(a, p, b) for p, d in ((RDFS + "subClassOf", onto.sub_class), (RDFS + "subPropertyOf", onto.sub_property)) for a, bs in d.items() for b in bs if a != b]
    rows += [(a, OWL + "equivalentClass", b) for a, bs in onto.sub_class.items() for b in bs if a != b and a in onto.sub_class.get(b, ())]
    df = facts.sparkSession.createDataFrame(rows, "a string, p string, b string")
    return df.select(_iri(F.col("a")).alias("s"), "p", _iri(F.col("b")).alias("o"), F.array(*[F.lit(g) for g in onto.graphs]).cast("array<string>").alias("support"))


def representatives(same: DataFrame) -> DataFrame:
    """Of links (a, b) the least member of each component for each member: (member, representative).

    Labels move to the least neighbour and then to the label of that one, so rounds grow with the
    logarithm of a component's width; every round is checkpointed.
    """
    edges = checkpoint(same.where("a is not null and b is not null").select("a", "b").unionByName(same.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = checkpoint(edges.groupBy(F.col("a").alias("member")).agg(F.least(F.min("b"), F.first("a")).alias("representative")))
    while True:
        near = edges.join(label.select(F.col("member").alias("b"), F.col("representative").alias("r")), "b").groupBy(F.col("a").alias("member")).agg(F.min("r").alias("r"))
        least = label.join(near, "member").select("member", F.least("representative", "r").alias("up"), "representative")
        jump = least.join(label.select(F.col("member").alias("up"), F.col("representative").alias("r2")), "up", "left")
        new = round_checkpoint(jump.select("member", F.least("up", "r2").alias("representative"), (F.least("up", "r2") < F.col("representative")).alias("moved")))
        label = new.select("member", "representative")
        if not new.where("moved").limit(1).count():
            return label
