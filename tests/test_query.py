"""The query language over quads: bags, unbound variables, errors, paths, datasets."""

import pytest

from graphloom.engine import Catalog, Engine, GraphRecord, TooLarge
from graphloom.plans.lower import Forbidden, Unsupported
from graphloom.plans.parser import SyntaxFault, parse
from graphloom.plans.paths import Limits, PathCeiling, compile_path
from graphloom.sources import rdf

P = "PREFIX : <urn:x:> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#>\n"
DATA = """@prefix : <urn:x:> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
:g1 { :a :p 1 ; :name "Ann"@en , "Anna" ; :knows :b . :b :p 2 ; :q 3 ; :knows :c . _:n :p 4 . :d :when "2024-01-31T23:30:00+02:00"^^xsd:dateTime }
:g2 { :a :p 1 . :b :knows :c . :c :knows :a . :c :p "1.5"^^xsd:decimal . _:n :p 5 . :e :p "x" , true , 2.0e0 }
"""


@pytest.fixture(scope="module")
def engine(spark):
    return Engine.over_quads(rdf.from_text(spark, DATA).cache())


@pytest.fixture
def ask(engine, rows):
    def get(text, **more):
        return rows(engine.query(P + text, **more))

    return get


def test_bag_and_set(ask):
    assert ask("SELECT ?o { :a :p ?o }") == [("1",)]  # the default graph is a set
    assert ask("SELECT ?g { GRAPH ?g { :a :p 1 } }") == [("urn:x:g1",), ("urn:x:g2",)]
    assert ask("SELECT ?o { { :a :p ?o } UNION { :a :p ?o } }") == [("1",), ("1",)]
    assert ask("SELECT REDUCED ?o { { :a :p ?o } UNION { :a :p ?o } }") == [("1",), ("1",)]


def test_blank_nodes_of_graphs_are_apart(ask):
    assert ask("SELECT (COUNT(DISTINCT ?n) AS ?k) { ?n :p ?o FILTER(isBLANK(?n)) }") == [(2,)]
    assert ask("SELECT ?x ?y { GRAPH :g1 { ?n :p ?x } GRAPH :g2 { ?n :p ?y } FILTER(isBLANK(?n)) }") == []


def test_optional_and_unbound(ask):
    assert ask("SELECT ?s ?q { ?s :p ?o OPTIONAL { ?s :q ?q } FILTER(?s IN (:a, :b)) }") == [("urn:x:a", None), ("urn:x:b", "3")]
    # ?q stays unbound on one side and then joins anything
    assert ask("SELECT ?s ?q ?t { { SELECT ?s ?q { ?s :p 1 OPTIONAL { ?s :q ?q } } } ?t :q ?q }") == [("urn:x:a", "3", "urn:x:b")]
    assert ask("SELECT ?s ?o { ?s :q ?z OPTIONAL { ?s :p ?o FILTER(?o > ?z) } }") == [("urn:x:b", None)]


def test_union_minus_exists(ask):
    assert ask("SELECT ?s { ?s :knows ?o MINUS { ?s :q ?z } }") == [("urn:x:a",), ("urn:x:c",)]
    assert len(ask("SELECT ?s { ?s :knows ?o MINUS { ?y :q ?z } }")) == 3
    assert ask("SELECT ?s { ?s :p ?o FILTER NOT EXISTS { ?s :knows ?x } FILTER(isIRI(?s)) }") == [("urn:x:e",)] * 3
    assert ask("SELECT ?s { ?s :knows ?k FILTER(EXISTS { ?s :q ?x } || ?s = :c) }") == [("urn:x:b",), ("urn:x:c",)]
    assert ask("SELECT ?s (EXISTS { ?s :q ?x } AS ?e) { ?s :knows ?k }") == [("urn:x:a", False), ("urn:x:b", True), ("urn:x:c", False)]


def test_errors(ask):
    assert ask("SELECT ?o { :e :p ?o FILTER(?o > 1) }") == [("2.0e0",)]
    assert ask("SELECT ?o { :e :p ?o FILTER(!(?o > 1)) }") == []
    assert ask('SELECT (IF(1/0 > 1, "a", "b") AS ?x) {}') == [(None,)]
    assert [float(x) for x, in ask("SELECT (COALESCE(1/0, ?none, 7) AS ?x) {}")] == [7.0]
    assert ask("SELECT ?s (SUM(?o) AS ?t) { ?s :p ?o FILTER(?s IN (:b, :e)) } GROUP BY ?s") == [("urn:x:b", "2"), ("urn:x:e", None)]
    assert ask("SELECT (1 = 1.0 AS ?a) (\"a\" = 1 AS ?b) (:a = 1 AS ?c) {}") == [(True, None, False)]


def test_aggregates(ask):
    assert ask("SELECT (COUNT(*) AS ?n) (SUM(?o) AS ?s) { ?x :nothing ?o }") == [(0, "0")]
    assert ask("SELECT ?g (COUNT(*) AS ?n) { GRAPH ?g { ?s :knows ?o } } GROUP BY ?g") == [("urn:x:g1", 2), ("urn:x:g2", 2)]
    assert ask("SELECT (GROUP_CONCAT(?n; SEPARATOR=\",\") AS ?x) { :a :name ?n }") == [("Ann,Anna",)]
    assert ask("SELECT (MIN(?o) AS ?lo) (MAX(?o) AS ?hi) { ?s :p ?o FILTER(isNUMERIC(?o)) }") == [("1", "5")]
    assert ask("SELECT ?s (COUNT(*) AS ?n) { ?s :p ?o } GROUP BY ?s HAVING(COUNT(*) > 2)") == [("urn:x:e", 3)]


def test_union_values_bind_group_order(ask):
    got = ask("SELECT ?s (SUM(?v) AS ?t) { { ?s :p ?o } UNION { ?s :q ?o } VALUES ?k { 10 20 } BIND(?o * ?k AS ?v) FILTER(?s IN (:a, :b)) } GROUP BY ?s HAVING(SUM(?v) > 40) ORDER BY DESC(?t) LIMIT 5")
    assert got == [("urn:x:b", "150")]


def test_order_over_kinds(engine):
    got = [tuple(r) for r in engine.query(P + "SELECT ?o { { :e :p ?o } UNION { :a :knows ?o } UNION { :a :p ?o } UNION { :a :q ?o } UNION { BIND(?none AS ?o) } } ORDER BY ?o").collect()]
    assert got[0] == (None,) and got[1] == ("urn:x:b",) and [g[0] for g in got].index("1") < [g[0] for g in got].index("2.0e0")


def test_paths(ask):
    assert ask("SELECT ?x { :a :knows+ ?x }") == [("urn:x:a",), ("urn:x:b",), ("urn:x:c",)]
    assert ask("SELECT ?x { ?x :knows+ :c }") == [("urn:x:a",), ("urn:x:b",), ("urn:x:c",)]
    assert ask("SELECT ?x { :a (^:knows/:knows)* ?x }") == [("urn:x:a",)]
    assert ask("SELECT ?x { <urn:none> :knows* ?x }") == [("urn:none",)]
    assert ask("SELECT ?x { <urn:none> :knows+ ?x }") == []
    assert ask("SELECT ?g ?x { GRAPH ?g { :a :knows+ ?x } }") == [("urn:x:g1", "urn:x:b"), ("urn:x:g1", "urn:x:c")]
    assert ask("SELECT ?g ?x { GRAPH ?g { :b :knows+ ?x } }") == [("urn:x:g1", "urn:x:c"), ("urn:x:g2", "urn:x:a"), ("urn:x:g2", "urn:x:c")]
    assert ask("SELECT ?x { :a !(:p|:name) ?x }") == [("urn:x:b",)]
    assert ask("SELECT ?x { :a !(^:p|^:name) ?x }") == [("urn:x:c",)]
    assert ask("SELECT ?x { :a (:p|:knows)? ?x }") == [("1",), ("urn:x:a",), ("urn:x:b",)]
    assert ask("SELECT (COUNT(*) AS ?n) { ?x :knows* ?x }")[0][0] > 5
    assert ask("SELECT ?x { :a :knows/:knows|:knows/:q ?x }") == [("3",), ("urn:x:c",)]


def test_path_ceiling(spark):
    e = Engine.over_quads(rdf.from_text(spark, DATA), limits=Limits(rounds=1))
    with pytest.raises(PathCeiling):
        e.query(P + "SELECT ?x { :a :knows+ ?x }")


def test_automaton_runs_inverse_sequences_backwards():
    q = parse("SELECT * { ?a ^(<urn:p>/<urn:q>)+ ?b }")
    auto = compile_path(q.pattern.inner.triples[0].p.inner if False else __import__("graphloom.plans.algebra", fromlist=["PRepeat"]).PRepeat(q.pattern.inner.triples[0].p.inner, 1, True))
    assert not auto.empty and {s.predicates for _, s, _ in auto.transitions} == {("urn:p",), ("urn:q",)}


def test_datasets(ask, engine):
    assert ask("SELECT ?o FROM :g2 { :b :knows ?o }") == [("urn:x:c",)]
    assert ask("SELECT ?o FROM :g1 { :c :knows ?o }") == []
    assert ask("SELECT ?g FROM :g1 FROM NAMED :g2 { GRAPH ?g { ?s :knows :c } }") == [("urn:x:g2",)]
    assert ask("SELECT ?o { :c :knows ?o }", protocol=(("urn:x:g1",), ())) == []
    with pytest.raises(Forbidden):
        engine.query(P + "SELECT * FROM <urn:secret> { ?s ?p ?o }")
    with pytest.raises(Forbidden):
        engine.query(P + "SELECT * FROM NAMED :g1 { GRAPH :g2 { ?s ?p ?o } }").collect()


def test_authorization(spark, rows):
    catalog = Catalog([GraphRecord("urn:x:g1"), GraphRecord("urn:x:g2", frozenset({"secret"}))])
    e = Engine.over_quads(rdf.from_text(spark, DATA), catalog)
    assert rows(e.query(P + "SELECT ?s { ?s :knows :a }")) == []
    assert rows(e.query(P + "SELECT ?s { ?s :knows :a }", frozenset({"secret"}))) == [("urn:x:c",)]
    with pytest.raises(Forbidden):
        e.query(P + "SELECT ?s { GRAPH :g2 { ?s :knows :a } }").collect()
    with pytest.raises(ValueError):
        Catalog([GraphRecord("a"), GraphRecord("a")])


def test_forms(ask):
    assert ask("ASK { :a :p 1 }") == [(True,)] and ask("ASK { :a :p 99 }") == [(False,)] and ask("ASK {}") == [(True,)]
    assert ask("CONSTRUCT { ?s :made ?o . ?o :bad ?s } WHERE { ?s :q ?o }") == [("<urn:x:b>", "<urn:x:made>", '"3"^^<http://www.w3.org/2001/XMLSchema#integer>')]
    got = ask("CONSTRUCT { _:k :of ?s } WHERE { ?s :knows ?o }")
    assert len(got) == 3 and all(g[0].startswith("_:") for g in got)
    assert ("<urn:x:b>", "<urn:x:q>", '"3"^^<http://www.w3.org/2001/XMLSchema#integer>') in ask("DESCRIBE :b")


def test_functions_over_terms(ask):
    assert ask("SELECT (YEAR(?t) AS ?y) (HOURS(?t) AS ?h) (DAY(?t) AS ?d) (TZ(?t) AS ?z) { :d :when ?t }") == [(2024, 23, 31, "+02:00")]
    assert ask('SELECT (STRLEN(?n) AS ?l) { :a :name ?n FILTER(LANG(?n) = "en") }') == [(3,)]
    assert ask('SELECT ?n { :a :name ?n FILTER(LANGMATCHES(LANG(?n), "*")) }') == [("Ann",)]
    assert ask('SELECT (REPLACE("abcb", "b", "Z") AS ?a) (SUBSTR("héllo", 2) AS ?b) (STRBEFORE("abc", "z") AS ?c) (STRAFTER("abc", "") AS ?d) {}') == [("aZcZ", "éllo", "", "abc")]
    assert ask("SELECT (ROUND(-2.5) = -2 AS ?a) (ABS(-3) AS ?b) (7/2 = 3.5 AS ?c) {}") == [(True, 3, True)]
    assert ask('SELECT (REGEX("Aß", "^a", "i") AS ?a) (REGEX("a.c", "a.c", "q") AS ?b) (CONCAT("a", STR(1)) AS ?c) {}') == [(True, True, "a1")]
    assert ask('SELECT (STR(STRDT("5", xsd:integer)) AS ?a) (LANG(STRLANG("x", "EN")) AS ?b) (DATATYPE(1.5) = xsd:decimal AS ?c) {}') == [("5", "en", True)]
    assert ask('SELECT (xsd:boolean("yes") AS ?a) (xsd:integer("12") AS ?b) (xsd:double("INF") > 1 AS ?c) {}') == [(None, 12, True)]
    assert len(ask("SELECT (UUID() AS ?a) (STRUUID() AS ?b) (RAND() AS ?c) (NOW() AS ?d) (BNODE() AS ?e) {}")[0]) == 5


def test_subquery_and_lateral(ask):
    assert ask("SELECT ?s ?o { { SELECT ?s { ?s :q ?z } } ?s :p ?o }") == [("urn:x:b", "2")]
    assert ask("SELECT ?s ?o { ?s :knows ?k LATERAL { SELECT * { ?s :p ?o } ORDER BY DESC(?o) LIMIT 1 } }") == [("urn:x:a", "1"), ("urn:x:b", "2"), ("urn:x:c", "1.5")]


def test_services(spark, engine, rows):
    e = Engine.over_quads(rdf.from_text(spark, DATA), services={"urn:s:1": engine})
    assert rows(e.query(P + "SELECT ?o { SERVICE <urn:s:1> { :b :q ?o } }")) == [("3",)]
    assert rows(e.query(P + "SELECT ?w ?o { VALUES ?w { <urn:s:1> <urn:s:2> } SERVICE ?w { :b :q ?o } }")) == [("urn:s:1", "3")]
    assert rows(e.query(P + "SELECT ?o { :a :p ?o SERVICE SILENT <urn:s:9> { :b :q ?z } }")) == [("1",)]
    with pytest.raises(Forbidden):
        e.query(P + "SELECT ?o { SERVICE <urn:s:9> { :b :q ?o } }")


def test_row_ceiling_is_an_error(spark):
    e = Engine.over_quads(rdf.from_text(spark, DATA), row_ceiling=2)
    with pytest.raises(TooLarge):
        e.query(P + "SELECT * { ?s ?p ?o }")


@pytest.mark.parametrize("bad", ["SELECT ?x", "SELECT * { ?s ?p }", "SELECT ?x { ?x :p 1 }", "SELECT (COUNT(*) AS ?n) ?x { } GROUP BY", "INSERT DATA { <a> <b> <c> }", "SELECT * { FILTER(foo(1)) }", "SELECT * { BIND(1 AS ?x) BIND(2 AS ?x) }", "SELECT * { VALUES (?a ?b) { (1) } }", "ASK { } extra"])
def test_syntax(bad):
    with pytest.raises((SyntaxFault, AttributeError)):
        parse(bad)


def test_order_and_volatility():
    assert parse("SELECT ?s { ?s ?p ?o } ORDER BY ?s LIMIT 1").ordered and not parse("SELECT ?s { { SELECT ?s { ?s ?p ?o } ORDER BY ?s } }").ordered
    assert parse("SELECT (NOW() AS ?n) {}").volatile and not parse("SELECT * { ?s ?p ?o }").volatile


def test_unsupported_is_refused(engine):
    with pytest.raises(Unsupported):
        engine.query(P + "SELECT * { ?s :p ?o LATERAL { SELECT (COUNT(*) AS ?n) { ?s :q ?x } } }")
