import pytest
from pyspark.sql import functions as F

from graphloom.sources import rdf

NQ = r"""# a comment
<urn:a> <urn:p> "x \"y\"\né \\ 'z'" <urn:g> .

<urn:a> <urn:p> "5"^^<http://www.w3.org/2001/XMLSchema#integer> <urn:g> .
_:b <urn:p> "hi"@EN-gb .
<urn:w> <urn:p> "\u00e9\U0001F600\U00000022!" .
<urn:a> <urn:p> _:b <urn:g> . # end
"""


def test_lines(spark, tmp_path):
    (tmp_path / "a.nq").write_text(NQ)
    got = {(r.s.v if r.s.k == 1 else "_", r.o.v if r.o.k != 2 else "_", r.o.d and r.o.d.split("#")[1], r.o.l, r.g) for r in rdf.read(spark, str(tmp_path / "a.nq")).collect()}
    assert got == {("urn:a", "x \"y\"\né \\ 'z'", "string", None, "urn:g"), ("urn:a", "5", "integer", None, "urn:g"), ("_", "hi", "langString", "en-gb", ""), ("urn:w", "é😀\"!", "string", None, ""), ("urn:a", "_", None, None, "urn:g")}
    assert {r.g for r in rdf.read(spark, str(tmp_path / "a.nq"), "urn:z").collect()} == {"urn:z"}


@pytest.mark.parametrize("line", ["<urn:a> <urn:p> .", "<urn:a> \"p\" <urn:o> .", "<urn:a> <urn:p> \"x .", "what"])
def test_bad_lines_fail(spark, tmp_path, line):
    (tmp_path / "a.nt").write_text(line + "\n")
    with pytest.raises(Exception, match="no RDF line"):
        rdf.read(spark, str(tmp_path / "a.nt")).collect()


def test_trig_file(spark, tmp_path):
    (tmp_path / "a.trig").write_text('@prefix : <urn:x:> .\nBASE <urn:base/>\n:s :p ( 1 "two" ) ; a :T .\nGRAPH :g { <rel> :q [ :r true ; :r -1.5 ] , """long\n"text" """@de . }\n:h { }\n_:b1 { :s :p 2e0 }')
    rows = rdf.read(spark, str(tmp_path / "a.trig")).collect()
    assert len(rows) == 1 + 4 + 1 + 4 + 1
    assert {r.g for r in rows} >= {"", "urn:x:g"} and any(r.s.v.endswith("rel") for r in rows)
    assert {r.o.d.split("#")[1] for r in rows if r.o.k == 3} == {"integer", "string", "boolean", "decimal", "langString", "double"}


@pytest.mark.parametrize("bad", ["<urn:a> <urn:p> ?x .", '"lit" <urn:p> 1 .', "@prefix : <urn:x:> . :a :b", "<urn:a> <urn:p> <urn:b> ", "x:a x:b x:c ."])
def test_bad_turtle(bad):
    with pytest.raises(rdf.BadRdf):
        rdf.parse_turtle(bad, "t")


def test_round_trip_and_normalization(spark, tmp_path):
    quads = rdf.from_text(spark, '@prefix : <urn:x:> . :g { :a :p "l\\"i\\nne\\\\" , "t"@fr , 5 . :a :p 5 }')
    assert quads.count() == 4 and rdf.normalized(quads).count() == 3
    rdf.write_lines(rdf.normalized(quads), str(tmp_path / "out"))
    back = rdf.read_lines(spark, str(tmp_path / "out"))
    assert back.exceptAll(quads.distinct()).count() == 0 and back.count() == 3


def test_empty_text(spark):
    assert rdf.from_text(spark, "").collect() == []
    assert rdf.normalized(rdf.from_text(spark, "# nothing\n")).where(F.lit(True)).count() == 0
