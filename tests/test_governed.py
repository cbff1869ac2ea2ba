import pytest
from pyspark.sql import functions as F

from graphloom import results
from graphloom.operators import governed, reason
from graphloom.operators.governed import Route, Treatment
from graphloom.plans.algebra import XSD
from graphloom.plans.parser import parse
from graphloom.sources import rdf

PRE = "@prefix : <urn:x:> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix owl: <http://www.w3.org/2002/07/owl#> .\n"


@pytest.mark.parametrize(
    ("kind", "good", "bad"),
    [
        ("integer", ["0", "-007", "+12", "9" * 50], ["", "1.0", "x"]), ("byte", ["-128", "127"], ["128", "-129", "9" * 50]), ("unsignedLong", ["18446744073709551615"], ["-1", "18446744073709551616"]), ("boolean", ["true", "0"], ["yes", "TRUE"]), ("decimal", [".5", "1.", "-2.50"], ["1e3", "."]),
        ("double", ["1e3", "-INF", "NaN", ".5"], ["+NaN", "inf"]), ("dateTime", ["2024-02-29T23:59:59.5Z", "2024-01-01T24:00:00"], ["2024-13-01T00:00:00", "2024-01-01", "2024-01-01T25:00:00"]), ("dateTimeStamp", ["2024-01-01T00:00:00+14:00"], ["2024-01-01T00:00:00"]),
        ("date", ["2024-01-31", "-0044-03-15"], ["24-01-01"]), ("hexBinary", ["", "0aFF"], ["0", "zz"]), ("language", ["en", "de-AT"], ["_"]), ("token", ["a b", ""], [" a", "a  b"]), ("NCName", ["a-b", "_x"], ["1a", "a:b"]), ("string", ["", "any\n"], []), ("noSuchType", [], ["x"]),
    ],
)
def test_literals(spark, kind, good, bad):
    df = spark.createDataFrame([(v, XSD + kind, True) for v in good] + [(v, XSD + kind, False) for v in bad], "v string, d string, ok boolean")
    assert [r.v for r in df.where(governed.literal_fault(F.col("v"), F.col("d")).isNull() != F.col("ok")).collect()] == []


def test_policy(spark):
    quads = rdf.from_text(spark, PRE + ":a :p 1 ; :t 'long' .")
    shown, payload = governed.apply_policy(quads, {"urn:x:p": Treatment(), "urn:x:t": Treatment("payload")})
    assert [r.p for r in shown.collect()] == ["urn:x:p"] and [r.p for r in payload.collect()] == ["urn:x:t"]
    with pytest.raises(governed.PolicyViolation):
        governed.apply_policy(quads, {"urn:x:p": Treatment()})


def test_entailment_routes(spark):
    onto = reason.ontology(rdf.from_text(spark, PRE + ":g { :A rdfs:subClassOf :B . :p a owl:TransitiveProperty }"))

    def route(text, closure=True):
        return governed.entailment_route(parse("PREFIX : <urn:x:> PREFIX owl: <http://www.w3.org/2002/07/owl#> SELECT * " + text).pattern.inner, onto, closure)[0]

    assert route("{ ?s :q ?o }") == Route.ASSERTED and route("{ ?s a :A }") == Route.ASSERTED
    assert route("{ ?s a :B }") == Route.CLOSURE and route("{ ?s :p ?o }") == Route.CLOSURE and route("{ ?s a ?c }") == Route.CLOSURE
    assert route("{ ?s a :B }", False) == Route.UNKNOWN and route("{ ?c owl:complementOf :A }") == Route.UNKNOWN
    assert route("{ ?s a ?c . ?c :q ?o }") == Route.ILLEGAL


def test_encoded_join_overflow(spark):
    a = spark.createDataFrame([(1, 1 << 62, ["x"])], "k int, m bigint, proofs array<string>")
    with pytest.raises(Exception, match="multiplicity overflow"):
        governed.encoded_join(a, a.withColumn("m", F.lit(4).cast("bigint")), ["k"]).collect()
    assert governed.encoded_join(a, a.withColumn("m", F.lit(1).cast("bigint")), ["k"]).first().proofs == ["x"]


def test_leaf_scan_ceiling_and_graphs(spark):
    facts = spark.createDataFrame([(1, 2, 3, 4), (1, 2, 5, 6)], "s int, p int, o int, g int")
    assert governed.leaf_scan(facts, [4], s=1).count() == 1 and governed.leaf_scan(facts, []).count() == 0
    with pytest.raises(OverflowError):
        governed.leaf_scan(facts, [4, 6], ceiling=1)


def test_buckets_do_not_depend_on_layout(spark):
    quads = rdf.from_text(spark, PRE + " ".join(f":s{i} :p {i} ." for i in range(40)))
    a = {(r.s.v, r.bucket) for r in governed.hash_buckets(quads, 8).collect()}
    assert a == {(r.s.v, r.bucket) for r in governed.hash_buckets(quads.repartition(7), 8).collect()} and len({b for _, b in a}) > 3


def test_rdfxml_round_trip(spark):
    xml = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="urn:x#" xml:base="http://b/">
    <e:T rdf:about="a" e:name="n"><e:q rdf:datatype="http://www.w3.org/2001/XMLSchema#integer">5</e:q><e:r xml:lang="EN">hi &amp; &lt;</e:r><e:s rdf:resource="c"/><e:t rdf:parseType="Resource"><e:u>v</e:u></e:t></e:T>
    <rdf:Description rdf:nodeID="x"><e:l rdf:parseType="Collection"><rdf:Description rdf:about="one"/></e:l><e:w><e:T rdf:about="two"/></e:w></rdf:Description></rdf:RDF>"""
    rows = rdf.parse_rdfxml(xml, "s")
    assert len(rows) == 12 and {r[2][1] for r in rows if r[1] == "urn:x#r"} == {"hi & <"}
    df = spark.createDataFrame(rows, rdf.QUADS)
    text = results.RDFXML_HEAD + "".join(r["value"] for r in results.rdfxml_subjects(df).collect()) + results.RDFXML_FOOT
    strip = lambda rs: sorted((r[0][:1] if r[0][0] == 2 else r[0], r[1], r[2][:1] if r[2][0] == 2 else r[2]) for r in rs)
    assert strip(rdf.parse_rdfxml(text, "t")) == strip(rows)
    for bad in ("<x", '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description><a:b xmlns:a="urn:"><a:c/><a:d/></a:b></rdf:Description></rdf:RDF>'):
        with pytest.raises(rdf.BadRdf):
            rdf.parse_rdfxml(bad, "s")


def test_rdf_file_by_ending(spark, tmp_path):
    (tmp_path / "a.rdf").write_text('<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="urn:x#"><e:T rdf:about="urn:a"/></rdf:RDF>')
    assert rdf.read(spark, str(tmp_path / "a.rdf"), "urn:g").first().g == "urn:g"
    with pytest.raises(rdf.BadRdf):
        rdf.read(spark, "x.doc")
