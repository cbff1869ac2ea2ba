"""Query algebra: terms, paths, expressions and patterns."""

from __future__ import annotations

from dataclasses import dataclass, field

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDF_TYPE = RDF + "type"


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Iri:
    value: str


@dataclass(frozen=True)
class Lit:
    value: str
    datatype: str = XSD + "string"
    lang: str | None = None


Term = Var | Iri | Lit


# paths


@dataclass(frozen=True)
class PIri:
    iri: str


@dataclass(frozen=True)
class PInv:
    inner: object


@dataclass(frozen=True)
class PSeq:
    left: object
    right: object


@dataclass(frozen=True)
class PAlt:
    left: object
    right: object


@dataclass(frozen=True)
class PRepeat:
    """inner*, inner+ and inner?: at least `least` steps, one at most unless many."""

    inner: object
    least: int
    many: bool


@dataclass(frozen=True)
class PNot:
    forward: tuple[str, ...]
    inverse: tuple[str, ...]
    has_forward: bool = True
    has_inverse: bool = False


@dataclass(frozen=True)
class Triple:
    s: Term
    p: object
    o: Term


# expressions


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple = ()


@dataclass(frozen=True)
class Exists:
    pattern: object
    negated: bool = False


@dataclass(frozen=True)
class Agg:
    name: str
    expr: object | None
    distinct: bool = False
    sep: str = " "


# patterns


@dataclass(frozen=True)
class Bgp:
    triples: tuple[Triple, ...] = ()


@dataclass(frozen=True)
class Join:
    left: object
    right: object


@dataclass(frozen=True)
class LeftJoin:
    left: object
    right: object
    expr: object | None = None


@dataclass(frozen=True)
class Lateral:
    left: object
    right: object


@dataclass(frozen=True)
class Union:
    left: object
    right: object


@dataclass(frozen=True)
class Minus:
    left: object
    right: object


@dataclass(frozen=True)
class Filter:
    expr: object
    inner: object


@dataclass(frozen=True)
class Extend:
    inner: object
    var: str
    expr: object


@dataclass(frozen=True)
class Graph:
    name: Term
    inner: object


@dataclass(frozen=True)
class Service:
    name: Term
    inner: object
    silent: bool


@dataclass(frozen=True)
class Values:
    names: tuple[str, ...]
    rows: tuple[tuple, ...]


@dataclass(frozen=True)
class Group:
    inner: object
    keys: tuple[tuple[str, object], ...]
    aggs: tuple[tuple[str, Agg], ...]


@dataclass(frozen=True)
class OrderBy:
    inner: object
    keys: tuple[tuple[object, bool], ...]  # expression, ascending


@dataclass(frozen=True)
class Project:
    inner: object
    names: tuple[str, ...]


@dataclass(frozen=True)
class Distinct:
    inner: object


@dataclass(frozen=True)
class Reduced:
    inner: object


@dataclass(frozen=True)
class Slice:
    inner: object
    offset: int
    limit: int | None


@dataclass
class Query:
    form: str
    pattern: object
    names: tuple[str, ...] = ()
    template: tuple[Triple, ...] = ()
    describe: tuple[Term, ...] = ()
    default_graphs: tuple[str, ...] = ()
    named_graphs: tuple[str, ...] = ()
    prefixes: dict[str, str] = field(default_factory=dict)
    base: str = ""

    @property
    def ordered(self) -> bool:
        """Whether the rows' order means anything: only an outermost ORDER BY makes it so."""
        p = self.pattern
        while isinstance(p, (Distinct, Reduced, Slice)):
            p = p.inner
        return isinstance(p.inner if isinstance(p, Project) else p, OrderBy)

    @property
    def volatile(self) -> bool:
        return any(isinstance(x, Call) and x.name in VOLATILE for x in walk(self.pattern))


VOLATILE = {"BNODE", "NOW", "RAND", "STRUUID", "UUID"}


def walk(x):
    """Every node below and with x, through tuples and dataclasses."""
    yield x
    if isinstance(x, tuple):
        for y in x:
            yield from walk(y)
    elif hasattr(x, "__dataclass_fields__"):
        for f in x.__dataclass_fields__:
            yield from walk(getattr(x, f))


def visible(p) -> list[str]:
    """Variables of a pattern in the order they first occur, as SELECT * lists them."""
    seen: dict[str, None] = {}

    def add(x) -> None:
        match x:
            case Var(name):
                if not name.startswith("."):
                    seen.setdefault(name)
            case Bgp(triples):
                for t in triples:
                    add(t.s)
                    add(t.p)
                    add(t.o)
            case Join() | LeftJoin() | Union() | Lateral():
                add(x.left)
                add(x.right)
            case Minus():
                add(x.left)
            case Extend():
                add(x.inner)
                seen.setdefault(x.var)
            case Graph() | Service():
                add(x.name)
                add(x.inner)
            case Values(names, _):
                for n in names:
                    seen.setdefault(n)
            case Project(_, names):
                for n in names:
                    seen.setdefault(n)
            case Group():
                for n, _ in x.keys + x.aggs:
                    seen.setdefault(n)
            case Filter() | OrderBy() | Distinct() | Reduced() | Slice():
                add(x.inner)

    add(p)
    return list(seen)
