"""Plans, routing, roles, walks of every kind, object maps, chunk sizes and written results."""

import json
import random

import pytest

from graphloom import results
from graphloom.engine import Catalog, Engine, GraphRecord
from graphloom.operators import governed, graph, text
from graphloom.plans import paths
from graphloom.plans.lower import Forbidden
from graphloom.plans.paths import Limits, PathCeiling
from graphloom.sources import rdf
from graphloom.sources.mapping import Mapping

P = "PREFIX : <urn:x:> "


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("t"))
    spark.createDataFrame([(i, f"n{i % 5}", "B" if i % 2 else None) for i in range(50)], "id int, name string, kind string").write.parquet(f"{d}/item.parquet")
    return Engine.over_tables(spark, d, [Mapping("item", "id")])


@pytest.mark.parametrize(("query", "pushed"), [
    ("SELECT ?n { <urn:item:7> <urn:p:name> ?n }", "EqualTo(id,7)"), ('SELECT ?x { ?x <urn:p:kind> "B" }', "EqualTo(kind,B)"), ("SELECT ?n { ?x <urn:p:id> 7 ; <urn:p:name> ?n }", "EqualTo(id,7)"),
])
def test_constants_reach_the_scan(tables, query, pushed):
    plan = tables.query(query)._jdf.queryExecution().executedPlan().toString()
    assert pushed in plan


def test_keys_that_are_no_integers(tables, rows):
    assert rows(tables.query("SELECT ?n { <urn:item:07> <urn:p:name> ?n }")) == [] and rows(tables.query("SELECT ?n { <urn:item:x> <urn:p:name> ?n }")) == []
    assert rows(tables.query("SELECT ?n { <urn:item:7> <urn:p:name> ?n }")) == [("n2",)]


def test_walks_in_rounds_and_by_task_agree(spark, rows, monkeypatch):
    r = random.Random(4)
    n = "".join(f":n{r.randrange(30)} :{r.choice('pq')} :n{r.randrange(30)} . " for _ in range(45))
    e = Engine.over_quads(rdf.from_text(spark, "@prefix : <urn:x:> . :g { " + n + "} :h { :n1 :p :n2 . :n2 :p :n31 }"))
    asks = ["SELECT ?a ?b { ?a :p+ ?b }", "SELECT ?a ?b { ?a (:p|^:q)* ?b }", "SELECT ?b { :n1 (:p/:q)* ?b }", "SELECT ?a { ?a :p? :n2 }", "SELECT ?g ?a ?b { GRAPH ?g { ?a :p+ ?b } }", "SELECT ?b { :none :p* ?b }"]
    near = [rows(e.query(P + q)) for q in asks]
    monkeypatch.setattr(paths, "BROADCAST_ROWS", -1)
    assert [rows(e.query(P + q)) for q in asks] == near and len(near[0]) > 20


@pytest.mark.parametrize("wide", [False, True])
def test_ceilings_of_walks(spark, monkeypatch, wide):
    if wide:
        monkeypatch.setattr(paths, "BROADCAST_ROWS", -1)
    chain = rdf.from_text(spark, "@prefix : <urn:x:> . :g { " + " ".join(f":n{i} :p :n{i + 1} ." for i in range(9)) + " }")
    for limits in (Limits(rounds=3), Limits(visited=4)):
        with pytest.raises(PathCeiling):
            Engine.over_quads(chain, limits=limits).query(P + "SELECT ?x { :n0 :p+ ?x }").collect()
    assert len(Engine.over_quads(chain, limits=Limits(rounds=20)).query(P + "SELECT ?x { :n0 :p+ ?x }").collect()) == 9


DATA = "@prefix : <urn:x:> . :g { :a :p 1 . :b :p 2 } :h { :a :q :b . :c a :K } :i { :a :p 9 }"


def test_routing_changes_no_answer(spark, rows):
    quads = rdf.from_text(spark, DATA)
    plain, routed = Engine.over_quads(quads), Engine.over_quads(quads, capabilities=graph.capability_index(quads))
    for q in ("SELECT ?s ?o { ?s :p ?o }", "SELECT ?s { ?s a :K }", "SELECT ?s ?o { ?s :q ?o . ?o :p ?x }", "SELECT ?g { GRAPH ?g {} }", "SELECT ?s { ?s ?x ?o }", "SELECT ?s { GRAPH :h { ?s :p ?o } }", "SELECT ?s { ?s :p ?o MINUS { ?s :q ?x } }", "SELECT ?s { ?s :none ?o }", "SELECT ?x { :a :q* ?x }"):
        assert rows(routed.query(P + q)) == rows(plain.query(P + q)), q
    active = routed.lowering(__import__("graphloom.plans.parser", fromlist=["parse"]).parse(P + "SELECT ?s { ?s a :K }"), frozenset({"public"})).source.active
    assert active.default == {"urn:x:h"}


def test_roles(spark, rows):
    quads = rdf.from_text(spark, DATA)
    catalog = Catalog([GraphRecord("urn:x:g"), GraphRecord("urn:x:h", role="provenance"), GraphRecord("urn:x:i")])
    assert rows(Engine.over_quads(quads, catalog, roles=frozenset({"provenance"})).query(P + "SELECT ?s { ?s ?p ?o }")) == [("urn:x:a",), ("urn:x:c",)]
    with pytest.raises(Forbidden):
        Engine.over_quads(quads, catalog, roles=frozenset({"mapping"})).query(P + "SELECT ?s { ?s ?p ?o }")


def test_exists_sees_the_outer_solution(spark, rows):
    e = Engine.over_quads(rdf.from_text(spark, "@prefix : <urn:x:> . :g { :a :p 1 ; :q 5 . :b :p 2 ; :q 1 . :c :p 3 }"))
    ask = lambda q: rows(e.query(P + q))
    assert ask("SELECT ?s { ?s :p ?v FILTER EXISTS { { ?s :q ?w FILTER(?w > ?v) } UNION { ?s :r ?w } } }") == [("urn:x:a",)]
    assert ask("SELECT ?s { ?s :p ?v FILTER EXISTS { ?s :q ?w BIND(?v * 2 AS ?x) FILTER(?w >= ?x) } }") == [("urn:x:a",)]
    assert ask("SELECT ?s { ?s :p ?v FILTER EXISTS { VALUES ?k { 1 } OPTIONAL { ?s :q ?w FILTER(?w > ?v) } FILTER(BOUND(?w)) } }") == [("urn:x:a",)]
    assert ask("SELECT ?s ?w { ?s :p ?v OPTIONAL { ?s :q ?w FILTER(NOT EXISTS { ?s :p ?x FILTER(?x > 1 && ?w = 1) }) } }") == [("urn:x:a", "5"), ("urn:x:b", None), ("urn:x:c", None)]
    # a variable of the solution is a constant inside, so MINUS shares none
    assert ask("SELECT ?s { ?s :p ?v FILTER EXISTS { ?s :p ?v MINUS { ?s :p ?v } } }") == [("urn:x:a",), ("urn:x:b",), ("urn:x:c",)]


def test_object_maps(spark, rows):
    df = spark.createDataFrame([("urn:o:1", "urn:g", "AB", 1.5, "hi", "EN"), ("urn:o:2", "urn:g", None, None, "yo", None), (None, "urn:g", "x", 1.0, "z", "en"), ("urn:o:3", None, "x", 1.0, "z", "en")], "s string, g string, e string, v double, t string, l string")
    m = governed.RowMapping("s", "g", (("urn:e", governed.ObjectMap("entity", "e"), governed.Treatment()), ("urn:k", governed.ObjectMap("iri", value="urn:K"), governed.Treatment()), ("urn:v", governed.ObjectMap("typed", "v", "urn:d"), governed.Treatment(queryable=False)), ("urn:t", governed.ObjectMap("language", "t", language="l"), governed.Treatment("payload"))))
    facts, payload = governed.mapped_quads(df, m)
    assert rows(facts.selectExpr("s.v", "p", "o.k", "o.v")) == [("urn:o:1", "urn:e", 1, "urn:uuid:ab"), ("urn:o:1", "urn:k", 1, "urn:K"), ("urn:o:2", "urn:k", 1, "urn:K")]
    assert rows(payload.selectExpr("s.v", "o.v", "o.l")) == [("urn:o:1", "hi", "en")]


def test_sized_chunks():
    body = "# A\n\nfirst words here\n\nsecond words\n\n" + "é" * 50 + "\n\n- one\n- two must\n"
    raw = body.encode()
    parts = list(text.sized(text.chunks(body), raw, 40, 60))
    assert all(b - a <= 60 for _, _, a, b, _ in parts) and [p[2] for p in parts] == sorted(p[2] for p in parts)
    assert "".join(raw[a:b].decode() for _, _, a, b, _ in parts).replace("\n", "") == body.replace("\n", "")
    assert parts[1][2:4] == (5, 36) and parts[-1][4]


def test_visible_memories(spark, rows):
    data = [(1, "EPISODIC", "me", "PRIVATE", "APPROVED", None), (2, "EPISODIC", "you", "PRIVATE", "APPROVED", None), (3, "SEMANTIC", "you", "TENANT", "APPROVED", None), (4, "SEMANTIC", "you", "TENANT", "PUBLISHED", 10), (5, "SEMANTIC", "you", "TENANT", "PUBLISHED", 99)]
    df = spark.createDataFrame(data, "id int, memory_class string, owner_subject string, audience string, state string, expires_at_epoch_ms bigint")
    assert rows(text.visible_memories(df, "me", 50).select("id")) == [(1,), (5,)]
    assert rows(text.visible_memories(df, "me", 50, "SEMANTIC").select("id")) == [(5,)]


def test_written_json_is_one_document(spark, tables, tmp_path):
    rel = tables.relation("SELECT ?n ?k { ?x <urn:p:name> ?n OPTIONAL { ?x <urn:p:kind> ?k } }")
    results.write(rel, ["n", "k"], "json", str(tmp_path / "r"))
    read = lambda part: [r.value for r in spark.read.text(str(tmp_path / "r" / part)).collect()]
    doc = json.loads(read("head")[0] + ",".join(read("rows")) + read("foot")[0])
    assert doc["head"]["vars"] == ["n", "k"] and len(doc["results"]["bindings"]) == 50 and sum("k" in b for b in doc["results"]["bindings"]) == 25


def test_merged_answers_are_whole_or_none(spark, rows):
    from graphloom.operators import exact

    parts = spark.createDataFrame([(0, "a"), (1, "b"), (1, "b")], "part int, x string")
    good = [(0, 0, 5, "COMPLETE"), (1, 5, 9, "COMPLETE")]
    table = lambda r: spark.createDataFrame(r, "part int, first bigint, after bigint, status string")
    assert rows(exact.merged(parts, table(good), 9)) == [("a",), ("b",), ("b",)]
    bad = [(good, 10), ([good[0], (1, 6, 9, "COMPLETE")], 9), ([good[0], (1, 4, 9, "COMPLETE")], 9), ([good[0], (1, 5, 9, "FAILED")], 9), ([good[0], (1, 5, 9, None)], 9), ([(0, 0, 9, "COMPLETE")], 9), ([], 0)]
    for ranges, total in bad:
        with pytest.raises(exact.Incomplete):
            exact.merged(parts, table(ranges), total)


def test_templates_and_substitution(spark, rows):
    from graphloom.operators import exact
    from graphloom.plans.lower import Scope
    from graphloom.plans.parser import parse

    e = Engine.over_quads(rdf.from_text(spark, DATA))
    text_ = P + "SELECT ?s ?o { ?s :p ?o . GRAPH ?g { ?s :p ?o } FILTER NOT EXISTS { ?s :q ?x FILTER(?o > 5) } }"
    q = parse(text_)
    found = exact.bgp_templates(q)
    assert len(found) == 3 and sorted(f[2] or "" for f in found) == ["", "", "g"]
    low = e.lowering(q, frozenset({"public"}))
    got = low(exact.substituted(q, {(b, g, v): low(b, Scope(g, v)) for b, g, v in found}).pattern).decoded(["s", "o"])
    assert rows(got) == rows(e.query(text_)) != []


def test_imports_are_there_or_refused(spark):
    from graphloom.operators.reason import UnsupportedAxiom, ontology

    owl = "@prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix : <urn:x:> . "
    ontology(rdf.from_text(spark, owl + ":g { :a owl:imports :h } :h { :k :p :b }"))
    with pytest.raises(UnsupportedAxiom):
        ontology(rdf.from_text(spark, owl + ":g { :a owl:imports :none }"))


def test_spine_keeps_what_is_no_number(spark, rows):
    from graphloom.operators import snapshot

    xsd = "@prefix xsd: <http://www.w3.org/2001/XMLSchema#> . @prefix : <urn:x:> . "
    quads = rdf.from_text(spark, xsd + ':g { :a :p 1 , "x"^^xsd:integer , 2.5 , 1e3 , true , "t"@en , :b , "2024-01-02T03:04:05Z"^^xsd:dateTime }')
    s = snapshot.spine(quads, graph.dictionary(quads))
    got = rows(s.selectExpr("value_int", "cast(value_decimal as string)", "value_double", "value_bool", "value_text", "language", "object is not null", "value_time is not null"))
    none = (None,) * 6
    assert len(got) == 8 and (*none, True, False) in got and (*none, False, True) in got and (None, None, None, None, "x", None, False, False) in got
    assert (None, None, None, None, "t", "en", False, False) in got and (1, *none[1:], False, False) in got and (None, None, 1000.0, *none[3:], False, False) in got
