from datetime import datetime

import pytest
from pyspark.sql import functions as F

from graphloom import results
from graphloom.cache import ResultCache
from graphloom.engine import Engine
from graphloom.operators import graph, reason, snapshot, text
from graphloom.operators.reason import Inconsistent, UnsupportedAxiom
from graphloom.sources import rdf
from graphloom.streaming import ingest

PRE = "@prefix : <urn:x:> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix owl: <http://www.w3.org/2002/07/owl#> .\n"


def closure(spark, body):
    quads = rdf.from_text(spark, PRE + body)
    return {(r.s.v.removeprefix("urn:x:"), r.p.split("#")[-1].removeprefix("urn:x:"), r.o.v.removeprefix("urn:x:")) for r in reason.materialize(quads).collect()}


@pytest.mark.parametrize(
    ("axioms", "facts", "want"),
    [
        (":A rdfs:subClassOf :B . :B rdfs:subClassOf :C .", ":i a :A .", {("i", "type", "B"), ("i", "type", "C"), ("A", "subClassOf", "C")}),
        (":p rdfs:subPropertyOf :q ; rdfs:domain :D ; rdfs:range :R .", ":i :p :j .", {("i", "q", "j"), ("i", "type", "D"), ("j", "type", "R")}),
        (":p owl:inverseOf :q . :s a owl:SymmetricProperty .", ":i :p :j . :k :s :l .", {("j", "q", "i"), ("l", "s", "k")}),
        (":t a owl:TransitiveProperty .", ":a :t :b . :b :t :c . :c :t :d .", {("a", "t", "c"), ("a", "t", "d"), ("b", "t", "d")}),
        (":r owl:propertyChainAxiom ( :p :q :s ) .", ":a :p :b . :b :q :c . :c :s :d .", {("a", "r", "d")}),
        (":C rdfs:subClassOf [ owl:onProperty :p ; owl:hasValue :v ] . [ owl:onProperty :q ; owl:hasValue 1 ] rdfs:subClassOf :D .", ":i a :C . :j :q 1 .", {("i", "p", "v"), ("j", "type", "D")}),
        ("[ owl:onProperty :p ; owl:someValuesFrom :A ] rdfs:subClassOf :B . :B rdfs:subClassOf [ owl:onProperty :q ; owl:allValuesFrom :Z ] .", ":i :p :j . :j a :A . :i :q :k .", {("i", "type", "B"), ("k", "type", "Z")}),
        (":C owl:intersectionOf ( :A :B ) .", ":i a :A , :B . :j a :C .", {("i", "type", "C"), ("j", "type", "A"), ("j", "type", "B")}),
        (":f a owl:FunctionalProperty . :k a owl:InverseFunctionalProperty .", ":i :f :a , :b . :a :p 1 . :x :k :z . :y :k :z .", {("a", "sameAs", "b"), ("b", "sameAs", "a"), ("b", "p", "1"), ("x", "sameAs", "y")}),
        (":A owl:equivalentClass :B . :p owl:equivalentProperty :q .", ":i a :B ; :q :j .", {("i", "type", "A"), ("i", "p", "j")}),
    ],
)
def test_rules(spark, axioms, facts, want):
    assert want <= closure(spark, f":t1 {{ {axioms} }} :t2 {{ {facts} }}")


def test_support_limits_what_a_principal_sees(spark):
    body = PRE + ":onto { :A rdfs:subClassOf :B } :one { :i a :A } :two { :j a :A }"
    quads = rdf.from_text(spark, body)
    e = Engine.over_quads(quads, closure=reason.materialize(quads))
    assert {r.s for r in e.query("SELECT ?s { ?s a <urn:x:B> }").collect()} == {"urn:x:i", "urn:x:j"}
    assert e.query("SELECT ?s FROM <urn:x:onto> FROM <urn:x:one> { ?s a <urn:x:B> }").collect() == []
    e.catalog.graphs = [g for g in e.catalog.graphs if g.name != "urn:x:two"]
    assert {r.s for r in e.query("SELECT ?s { ?s a <urn:x:B> }").collect()} == {"urn:x:i"}


@pytest.mark.parametrize("axiom", [":A owl:complementOf :B .", ":A rdfs:subClassOf [ owl:onProperty :p ; owl:someValuesFrom :B ] .", ":A rdfs:subClassOf [ owl:onProperty :p ; owl:maxCardinality 1 ] ."])
def test_other_constructs_are_refused(spark, axiom):
    with pytest.raises(UnsupportedAxiom):
        closure(spark, f":t {{ {axiom} :i a :A }}")


def test_clash(spark):
    with pytest.raises(Inconsistent):
        closure(spark, ":t { :A owl:disjointWith :B . :i a :A , :B }")


def test_representatives(spark, rows):
    same = spark.createDataFrame([("e", "d"), ("d", "c"), ("c", "b"), ("x", "y"), (None, "y"), ("x", "y")], "a string, b string")
    assert rows(reason.representatives(same)) == [("b", "b"), ("c", "b"), ("d", "b"), ("e", "b"), ("x", "x"), ("y", "x")]


def test_dictionary_is_dense_and_ordered(spark):
    quads = rdf.from_text(spark, PRE + " ".join(f':s{i} :p "{i}", :s{i + 1} .' for i in range(60)))
    got = [(r.term_key, r.id) for r in graph.dictionary(quads).orderBy("term_key").collect()]
    assert [i for _, i in got] == list(range(1, len(got) + 1)) and len({k for k, _ in got}) == len(got)
    assert graph.encoded(quads, graph.dictionary(quads)).count() == quads.count()


def test_encoding_never_broadcasts_by_estimate(spark):
    """A dictionary's estimated size follows the tables' files; only counted frames are broadcast (predicates, partition starts)."""
    from graphloom.queries.graphs import _tables

    quads = _tables(spark, "/root/testdata/sf0.001", ["region", "nation", "customer"])
    facts = graph.encoded(quads, graph.dictionary(quads))
    assert facts.count() == quads.count()
    plan = facts._jdf.queryExecution().optimizedPlan().toString() + facts._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortMergeJoin [k") == 2 and "BroadcastHashJoin [k" not in plan


def test_facts_of_one_file_are_spread(spark):
    """Lines are one row group: their facts are made by several tasks, and a line's subject once, not once a fact."""
    from graphloom.queries.graphs import _tables

    quads = _tables(spark, "/root/testdata/sf0.01", ["lineitem"])
    assert quads.groupBy(F.spark_partition_id()).count().count() > 1
    plan = quads._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("md5(") and plan.count("md5(") == 1 and "size(array(" not in plan


def test_hydration(spark, rows):
    keys = spark.createDataFrame([(2, "b"), (1, "a"), (3, "a")], "ordinal int, k string")
    payload = spark.createDataFrame([("a", "A", "pub"), ("b", None, "pub"), ("c", "C", "sec")], "k string, v string, label string")
    assert [tuple(r) for r in graph.hydrate(keys, payload, "k", ["v"], F.col("label") == "pub").collect()] == [(1, "a", "A"), (2, "b", None), (3, "a", "A")]
    with pytest.raises(Exception, match="no payload for c"):
        graph.hydrate(spark.createDataFrame([(1, "c")], "ordinal int, k string"), payload, "k", ["v"], F.col("label") == "pub").collect()
    with pytest.raises(graph.ForbiddenPredicate):
        graph.hydrate(keys, payload, "k", ["v"], forbidden=["v"])
    assert graph.optional_context(payload, ["k"], 2)[1] and not graph.optional_context(payload, ["k"], 3)[1]


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "ds")
    quads = rdf.from_text(spark, PRE + ":g { :a :p 1 , 1 ; a :T }")
    one = snapshot.publish(quads, root, 0)
    assert one.number == 1 and one.quads(spark).count() == 2 and one.manifest["facts"] == 2
    with pytest.raises(snapshot.Conflict):
        snapshot.publish(quads, root, 0)
    two = snapshot.publish(quads.repartition(5), root, 1)
    assert two.number == 2 and two.manifest["digest"] == one.manifest["digest"]  # layout changes nothing
    assert snapshot.current(spark, root) == two and two.capabilities(spark).count() == 3
    e = Engine.over_quads(two.quads(spark))
    cache = ResultCache(e, str(tmp_path / "cache"), "2")
    for _ in range(2):
        assert [r.o for r in cache.query("SELECT ?o { ?s <urn:x:p> ?o }").collect()] == ["1"]
    cache.query("SELECT (NOW() AS ?n) {}").collect()
    assert cache.hits == 1


def test_results(spark):
    e = Engine.over_quads(rdf.from_text(spark, PRE + ':g { :a :p "x,\\"y\\""@en ; :q 5 . :b :p "<&>" }'))
    rel, names = e.relation("SELECT ?s ?o ?z { ?s <urn:x:p> ?o OPTIONAL { ?s <urn:x:q> ?z } } ORDER BY ?s"), ["s", "o", "z"]
    assert results.to_json(rel, names) == '{"head":{"vars":["s", "o", "z"]},"results":{"bindings":[{"s":{"type":"uri","value":"urn:x:a"},"o":{"type":"literal","value":"x,\\"y\\"","xml:lang":"en"},"z":{"type":"literal","value":"5","datatype":"http://www.w3.org/2001/XMLSchema#integer"}},{"s":{"type":"uri","value":"urn:x:b"},"o":{"type":"literal","value":"<&>"}}]}}'
    assert [r["value"] for r in results.csv_rows(rel, names).collect()] == ['urn:x:a,"x,""y""",5', "urn:x:b,<&>,"]
    assert [r["value"] for r in results.tsv_rows(rel, names).collect()] == ['<urn:x:a>\t"x,\\"y\\""@en\t"5"^^<http://www.w3.org/2001/XMLSchema#integer>', '<urn:x:b>\t"<&>"\t']
    assert "<literal>&lt;&amp;&gt;</literal>" in results.to_xml(rel, names) and results.head(names) == "s,o,z"
    flipped = e.relation("SELECT ?s ?o ?z { ?s <urn:x:p> ?o OPTIONAL { ?s <urn:x:q> ?z } } ORDER BY DESC(?s)")
    assert results.canonical_hash(rel, names, False) == results.canonical_hash(flipped, names, False)
    assert results.canonical_hash(rel, names, True) != results.canonical_hash(flipped, names, True)
    assert results.ask_json(True) == '{"head": {}, "boolean": true}'
    ttl = [r["value"] for r in results.turtle_subjects(rdf.from_text(spark, PRE + ":a :p 1 , 2 .")).collect()]
    assert len(ttl) == 1 and ttl[0].count(";") == 1
    assert results.same_results(rel.decoded(names), flipped.decoded(names))


def test_chunks():
    t = "# A\nOne\ntwo must\n\n## B é\n- x\n  y\n- z\n```\n# no\n\ncode\n```\ntail\n# C"
    raw = t.encode()
    got = text.chunks(t)
    assert [(k, p, raw[a:b].decode().strip("\n")) for k, p, a, b, _ in got] == [("heading", "A", "# A"), ("paragraph", "A", "One\ntwo must"), ("heading", "A > B é", "## B é"), ("list", "A > B é", "- x\n  y\n- z"), ("code", "A > B é", "```\n# no\n\ncode\n```"), ("paragraph", "A > B é", "tail"), ("heading", "C", "# C")]
    assert [c[4] for c in got][:2] == [False, True] and text.chunks("") == [] and text.chunks("\n \n") == []


def test_reduce_context(spark, rows):
    df = spark.createDataFrame([("d", 0, 4, True), ("d", 1, 5, False), ("d", 2, 3, False), ("d", 3, 2, True), ("e", 0, 99, False)], "k string, i int, n bigint, must boolean")
    assert rows(text.reduce_context(df, "k", "i", "n", "must", 10).select("k", "i")) == [("d", 0), ("d", 2), ("d", 3)]
    with pytest.raises(Exception, match="mandatory"):
        text.reduce_context(df, "k", "i", "n", "must", 5).collect()


def test_reduce_context_refuses_one_text_alone(spark, rows, tmp_path):
    from graphloom.queries.graphs import QUERIES

    long = "\n\n".join(f"It must hold {i}. " + "x" * 500 for i in range(60))
    docs = [(1, long), (2, "It must.\n\n" + "y" * 1990 + "\n\nshort"), (3, None), (4, "z")]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    need = sum(e - b for _, _, b, e, must in text.chunks(long) if must)
    assert need > 24_000
    assert rows(QUERIES["reduce_context"](spark, str(tmp_path))) == sorted([(1, None, need), (2, 0, 9), (2, 1, 1991), (2, 2, 5), (4, 0, 1)], key=repr)


def test_reduce_context_across_batches(spark, rows):
    """Keys, a null one too, whose chunks fall into several batches of one task."""
    data = [(None if k == 5 else k, i, (k * 7 + i * 13) % 11 + 1, (k + i) % 5 == 0) for k in range(23) for i in range(k)]
    want = []
    for k in range(23):
        left = 20 - sum(n for kk, _, n, must in data if kk == (None if k == 5 else k) and must)
        if left < 0:
            want.append((k, None, 20 - left))
            continue
        for kk, i, n, must in data:
            if kk == (None if k == 5 else k) and (must or n <= left):
                left -= 0 if must else n
                want.append((kk, i, n))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = rows(text.reduce_context(spark.createDataFrame(data, "k int, i int, n bigint, must boolean"), "k", "i", "n", "must", 20, refusals=True).select("k", "i", "n"))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == sorted(want, key=repr) and any(i is None for _, i, _ in want)


def test_stream_keeps_each_fact_once(spark, tmp_path):
    quads = rdf.from_text(spark, PRE + ":g { :a :p 1 , 2 }").withColumn("at", F.lit(datetime(2026, 1, 1)))
    quads.unionByName(quads).write.parquet(str(tmp_path / "in"))
    q = ingest.append_once(ingest.quad_stream(spark, str(tmp_path / "in")), str(tmp_path / "t"), str(tmp_path / "c"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_all_tables_are_indexed(spark):
    """The dictionary's facts and the capability index take every mapped table, the growing ones included."""
    from graphloom.queries.graphs import QUERIES
    from graphloom.queries.tables import MAPPINGS

    d, want = "/root/testdata/sf0.001", {m.graph for m in MAPPINGS}
    assert {r.g for r in QUERIES["dictionary_all"](spark, d).collect()} == want
    assert {g for r in QUERIES["capability_all"](spark, d).collect() for g in r.graphs.split(" ")} == want
