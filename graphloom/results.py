"""Results as text: SPARQL JSON, XML, CSV and TSV of solutions, N-Triples and Turtle of graphs, and canonical hashes.

Rows are formatted by the executors; what is put around them is added when they are written or gathered.
"""

from __future__ import annotations

import json
from html import escape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.plans.algebra import XSD
from graphloom.plans.relation import Rel
from graphloom.plans.values import Value, null, term
from graphloom.sources.rdf import ntriples


def _label(c: Column) -> Column:
    return F.concat(F.lit("b"), F.substring(F.sha2(c["v"], 256), 1, 16))


def _json_term(c: Column) -> Column:
    kind = F.when(c["k"] == 1, "uri").when(c["k"] == 2, "bnode").otherwise("literal")
    value = F.when(c["k"] == 2, _label(c)).otherwise(c["v"])
    plain = c["l"].isNotNull() | (c["d"] == XSD + "string")
    return F.when(c.isNotNull(), F.struct(kind.alias("type"), value.alias("value"), F.when(~plain, c["d"]).alias("datatype"), c["l"].alias("xml:lang")))


def json_rows(rel: Rel, names: list[str]) -> DataFrame:
    """One JSON object a solution, unbound variables left out: column value."""
    cells = [_json_term(term(rel.vars.get(n, null("term"))).col).alias(n) for n in names]
    return rel.df.select(F.to_json(F.struct(*cells), {"ignoreNullFields": "true"}).alias("value") if cells else F.lit("{}").alias("value"))


def to_json(rel: Rel, names: list[str]) -> str:
    """The whole document, for results that fit the driver."""
    rows = ",".join(r["value"] for r in json_rows(rel, names).collect())
    return f'{{"head":{{"vars":{json.dumps(names)}}},"results":{{"bindings":[{rows}]}}}}'


def ask_json(answer: bool) -> str:
    return json.dumps({"head": {}, "boolean": answer})


def csv_rows(rel: Rel, names: list[str]) -> DataFrame:
    """CSV lines: plain values, quoted where they must be."""

    def cell(v: Value) -> Column:
        c = term(v).col
        s = F.coalesce(F.when(c["k"] == 2, F.concat(F.lit("_:"), _label(c))).otherwise(c["v"]), F.lit(""))
        return F.when(s.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)

    return rel.df.select(F.concat_ws(",", *[cell(rel.vars.get(n, null("term"))) for n in names]).alias("value"))


def tsv_rows(rel: Rel, names: list[str]) -> DataFrame:
    """TSV lines: terms in N-Triples form, tabs escaped; an unbound variable is empty."""
    cells = [F.coalesce(F.replace(ntriples(term(rel.vars.get(n, null("term"))).col), F.lit("\t"), F.lit("\\t")), F.lit("")) for n in names]
    cells = [F.when(term(rel.vars.get(n, null("term"))).col.isNull(), "").otherwise(c) for n, c in zip(names, cells, strict=True)]
    return rel.df.select(F.concat_ws("\t", *cells).alias("value"))


def head(names: list[str], tsv: bool = False) -> str:
    return "\t".join("?" + n for n in names) if tsv else ",".join(names)


def xml_rows(rel: Rel, names: list[str]) -> DataFrame:
    def esc(c: Column) -> Column:
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            c = F.replace(c, F.lit(a), F.lit(b))
        return c

    def cell(n: str) -> Column:
        c = term(rel.vars.get(n, null("term"))).col
        tag = F.when(c["l"].isNotNull(), F.concat(F.lit(' xml:lang="'), c["l"], F.lit('"'))).when(c["d"] != XSD + "string", F.concat(F.lit(' datatype="'), esc(c["d"]), F.lit('"'))).otherwise("")
        body = F.when(c["k"] == 1, F.concat(F.lit("<uri>"), esc(c["v"]), F.lit("</uri>"))).when(c["k"] == 2, F.concat(F.lit("<bnode>"), _label(c), F.lit("</bnode>"))).otherwise(F.concat(F.lit("<literal"), tag, F.lit(">"), esc(c["v"]), F.lit("</literal>")))
        return F.when(c.isNotNull(), F.concat(F.lit(f'<binding name="{escape(n)}">'), body, F.lit("</binding>"))).otherwise("")

    return rel.df.select(F.concat(F.lit("<result>"), *[cell(n) for n in names], F.lit("</result>")).alias("value"))


def to_xml(rel: Rel, names: list[str]) -> str:
    rows = "".join(r["value"] for r in xml_rows(rel, names).collect())
    vars_ = "".join(f'<variable name="{escape(n)}"/>' for n in names)
    return f'<?xml version="1.0"?><sparql xmlns="http://www.w3.org/2005/sparql-results#"><head>{vars_}</head><results>{rows}</results></sparql>'


FORMS = {"csv": csv_rows, "tsv": tsv_rows, "json": json_rows, "xml": xml_rows}


def write(rel: Rel, names: list[str], form: str, path: str) -> None:
    """A result as text by the executors: rows/ holds the solutions, and beside it head/ and foot/ what makes them one document.

    JSON rows are lines to be joined by commas; CSV and TSV files each begin with the header line.
    """
    spark = rel.df.sparkSession
    rows = FORMS[form](rel, names)
    if form in ("csv", "tsv"):
        line = head(names, form == "tsv")

        def headed(batches):
            yield pd.DataFrame({"value": [line]})
            yield from batches

        rows.mapInPandas(headed, "value string").write.text(f"{path}/rows")
        return
    rows.write.text(f"{path}/rows")
    vars_ = "".join(f'<variable name="{escape(n)}"/>' for n in names)
    ends = {
        "json": (f'{{"head":{{"vars":{json.dumps(names)}}},"results":{{"bindings":[', "]}}"),
        "xml": (f'<?xml version="1.0"?><sparql xmlns="http://www.w3.org/2005/sparql-results#"><head>{vars_}</head><results>', "</results></sparql>"),
    }[form]
    for name, text in zip(("head", "foot"), ends, strict=True):
        spark.createDataFrame([(text,)], "value string").write.text(f"{path}/{name}")


def arrow_batches(rel: Rel, names: list[str]) -> DataFrame:
    """Bindings as Arrow record batches in the IPC stream format, one row a batch: (batch binary). They may be written or sent on as they come."""

    def pack(batches):
        import pyarrow as pa

        for b in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema) as writer:
                writer.write_batch(b)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["batch"])

    return rel.decoded(names).mapInArrow(pack, "batch binary")


def from_arrow(batches: DataFrame, schema: str) -> DataFrame:
    """Rows of Arrow batches made by arrow_batches()."""

    def unpack(rows):
        import pyarrow as pa

        for b in rows:
            for raw in b.column(0):
                yield from pa.ipc.open_stream(raw.as_buffer())

    return batches.mapInArrow(unpack, schema)


def turtle_subjects(triples: DataFrame) -> DataFrame:
    """Turtle of a graph (s, p, o), one statement a subject; a subject's triples are one task's."""
    pair = F.concat(F.lit("<"), F.col("p"), F.lit("> "), ntriples(F.col("o")))
    grouped = triples.select(ntriples(F.col("s")).alias("s"), pair.alias("po")).groupBy("s").agg(F.array_join(F.sort_array(F.collect_set("po")), " ;\n  ").alias("po"))
    return grouped.select(F.concat("s", F.lit(" "), "po", F.lit(" .")).alias("value"))


def rdfxml_subjects(triples: DataFrame) -> DataFrame:
    """RDF/XML descriptions of a graph (s, p, o), one a subject, for a document with the usual head and foot.

    A predicate is split before its last run of name characters; one that has none can't be written so.
    """

    def esc(c: Column) -> Column:
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            c = F.replace(c, F.lit(a), F.lit(b))
        return c

    def attr(name: str, c: Column) -> Column:
        return F.concat(F.lit(f' {name}="'), esc(c), F.lit('"'))

    local = F.regexp_extract("p", r"([\p{L}_][\p{L}\p{N}_.-]*)$", 1)
    name = F.when(local == "", F.raise_error(F.concat(F.lit("no XML name in "), F.col("p"))).cast("string")).otherwise(local)
    space = F.substring("p", F.lit(1), F.char_length("p") - F.char_length(local))
    o = F.col("o")
    about = F.when(F.col("s.k") == 1, attr("rdf:about", F.col("s.v"))).otherwise(attr("rdf:nodeID", _label(F.col("s"))))
    value = (
        F.when(o["k"] == 1, F.concat(attr("rdf:resource", o["v"]), F.lit("/>"))).when(o["k"] == 2, F.concat(attr("rdf:nodeID", _label(o)), F.lit("/>")))
        .otherwise(F.concat(F.when(o["l"].isNotNull(), attr("xml:lang", o["l"])).when(o["d"] != XSD + "string", attr("rdf:datatype", o["d"])).otherwise(""), F.lit(">"), esc(o["v"]), F.lit("</n:"), name, F.lit(">")))
    )
    prop = F.concat(F.lit("<n:"), name, attr("xmlns:n", space), value)
    grouped = triples.select(about.alias("about"), prop.alias("prop")).groupBy("about").agg(F.array_join(F.sort_array(F.collect_set("prop")), "").alias("props"))
    return grouped.select(F.concat(F.lit("<rdf:Description"), "about", F.lit(">"), "props", F.lit("</rdf:Description>")).alias("value"))


RDFXML_HEAD = '<?xml version="1.0"?><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">'
RDFXML_FOOT = "</rdf:RDF>"


def canonical_hash(rel: Rel, names: list[str], ordered: bool) -> str:
    """A digest of a result: by rows in order, or, if order means nothing, of the bag of its rows.

    The bag's digest adds up the rows' digests, so it needs no sort and no row on the driver. Blank nodes
    count by being blank only.
    """

    def cell(n: str) -> Column:
        c = term(rel.vars.get(n, null("term"))).col
        shown = F.when(c["k"] == 2, "_:").when(c["l"].isNotNull(), F.concat(c["v"], F.lit("@"), F.lower(c["l"]))).otherwise(F.concat_ws("^^", c["v"], c["d"]))
        return F.coalesce(F.concat(c["k"].cast("string"), shown), F.lit("unbound"))

    digest = F.sha2(F.to_json(F.array(*[cell(n) for n in names])), 256)
    if ordered:
        text = "\n".join(r.h for r in rel.df.select(digest.alias("h")).toLocalIterator())
        from hashlib import sha256

        return sha256(text.encode()).hexdigest()
    parts = [F.conv(F.substring(digest, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)") for i in range(5)]
    row = rel.df.select(*[p.alias(f"x{i}") for i, p in enumerate(parts)]).agg(F.count(F.lit(1)), *[F.sum(f"x{i}") for i in range(5)]).first()
    return "-".join(str(x or 0) for x in row)


def same_results(a: DataFrame, b: DataFrame) -> bool:
    """Whether two results are one bag of rows."""
    return a.exceptAll(b).limit(1).count() == 0 and b.exceptAll(a).limit(1).count() == 0
