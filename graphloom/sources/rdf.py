"""Readers and writers of RDF text: N-Triples and N-Quads by line, Turtle and TriG by file."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from hashlib import sha256
from pathlib import Path
from urllib.parse import urljoin
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.algebra import RDF, RDF_TYPE, XSD, Iri, Lit, Triple, Var
from graphloom.plans.parser import Parser, SyntaxFault, unescape
from graphloom.plans.values import TERM

QUADS = f"s {TERM}, p string, o {TERM}, g string"
DEFAULT = ""  # name of the default graph
RESERVED = "urn:graphloom:blank:"

_TERM = r'(<[^>\s]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:\^\^<[^>\s]*>|@[A-Za-z0-9-]+)?)'
_LINE = rf"^\s*{_TERM}\s+(<[^>\s]*>)\s+{_TERM}\s*({_TERM}\s*)?\.\s*(?:#.*)?$"


class BadRdf(ValueError):
    """Input that is no valid RDF text of its format."""


#: Stand for an escaped backslash and for \\U while the JSON reader decodes the rest; no text holds these code points.
_SLASH, _WIDE = "\ufdd0", "\ufdd1"


def _unescaped(c: Column) -> Column:
    """Escapes of the line formats, decoded inside the JVM: what JSON has too by its reader, \\U by code point."""
    safe = F.replace(F.replace(F.replace(c, F.lit("\\\\"), F.lit(_SLASH)), F.lit("\\'"), F.lit("'")), F.lit("\\U"), F.lit(_WIDE))
    read = F.from_json(F.concat(F.lit('{"v":"'), safe, F.lit('"}')), "v string", {"allowUnquotedControlChars": "true"})["v"]
    parts = F.split(read, f"(?={_WIDE})")
    wide = F.transform(parts, lambda x: F.when(x.startswith(_WIDE), F.concat(F.decode(F.unhex(F.substring(x, 2, 8)), "UTF-32"), F.substring(x, 10, 1 << 30))).otherwise(x))
    return F.when(F.instr(c, "\\") > 0, F.replace(F.array_join(wide, ""), F.lit(_SLASH), F.lit("\\"))).otherwise(c)


def _term(c: Column, scope: Column) -> Column:
    """The struct of a term as it is written; blank nodes are kept apart by scope."""
    iri = F.when(c.startswith("<"), F.struct(F.lit(1).alias("k"), _unescaped(F.substring(c, F.lit(2), F.length(c) - 2)).alias("v"), F.lit(None).cast("string").alias("d"), F.lit(None).cast("string").alias("l")))
    blank = F.struct(F.lit(2).alias("k"), F.concat(scope, F.lit("|"), F.substring(c, F.lit(3), F.length(c))).alias("v"), F.lit(None).cast("string").alias("d"), F.lit(None).cast("string").alias("l"))
    body = r'^"((?:[^"\\]|\\.)*)"'
    lang = F.nullif(F.lower(F.regexp_extract(c, body + r"@([A-Za-z0-9-]+)$", 2)), F.lit(""))
    kind = F.nullif(F.regexp_extract(c, body + r"\^\^<([^>\s]*)>$", 2), F.lit(""))
    literal = F.struct(F.lit(3).alias("k"), _unescaped(F.regexp_extract(c, body, 1)).alias("v"), F.when(lang.isNotNull(), RDF + "langString").otherwise(F.coalesce(kind, F.lit(XSD + "string"))).alias("d"), lang.alias("l"))
    return F.when(c.startswith("<"), iri).when(c.startswith("_:"), blank).otherwise(literal).cast(TERM)


def read_lines(spark: SparkSession, path: str | list[str], graph: str | None = None) -> DataFrame:
    """Quads of N-Triples or N-Quads files, read by Spark's splits; graph overrides the lines' own.

    Blank lines and comments are skipped; any other line that doesn't parse fails the query that reads it.
    Blank nodes of one label are one node within a graph of a file.
    """
    lines = spark.read.text(path).select(F.col("value"), F.col("_metadata.file_path").alias("file")).where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    checked = lines.withColumn("value", F.when(F.col("value").rlike(_LINE), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("no RDF line: "), F.substring("value", 1, 200))).cast("string")))
    parts = checked.select("file", *[F.regexp_extract("value", _LINE, i).alias(n) for i, n in ((1, "s"), (2, "p"), (3, "o"), (5, "g"))])
    g = F.lit(graph) if graph is not None else F.regexp_replace("g", "^<|>$", "")
    scope = F.sha2(F.concat_ws("|", "file", g), 256)
    return parts.select(_term(F.col("s"), scope).alias("s"), F.regexp_replace("p", "^<|>$", "").alias("p"), _term(F.col("o"), scope).alias("o"), g.alias("g"))


class _Turtle(Parser):
    """Turtle and TriG on the query grammar's tokens; anonymous nodes and labels are both blank nodes."""

    def __init__(self, text: str, base: str = ""):
        super().__init__(text)
        self.base = base

    def declare(self) -> bool:
        kind, text = self.peek()
        if (kind == "lang" and text in ("@prefix", "@base")) or (kind == "word" and text.upper() in ("PREFIX", "BASE")):
            self.next()
            if text.lower().endswith("prefix"):
                name = self.next()[1]
                self.prefixes[name[:-1]] = self.iri()
            else:
                k, t = self.next()
                self.base = urljoin(self.base, t[1:-1])
            if kind == "lang":
                self.need(".")
            return True
        return False

    def statements(self) -> Iterator[tuple[Triple, str]]:
        while self.peek()[0] != "end":
            if self.declare():
                continue
            graph = DEFAULT
            if self.word("GRAPH"):
                graph = self.label()
            elif self.peek()[0] in ("iri", "pname", "blank") and self.peek(1) == ("op", "{"):
                graph = self.label()
            if self.op("{"):
                block = self.triples_block()
                self.need("}")
            else:
                if graph:
                    raise SyntaxFault("GRAPH without a block")
                block: list[Triple] = []
                compound = self.is_op("[", "(")
                s = self.node(block)
                if not compound or not self.is_op("."):
                    self.properties(s, block)
                self.need(".")
            yield from ((t, graph) for t in block)

    def label(self) -> str:
        t = self.term()
        return t.value if isinstance(t, Iri) else f"_:{t.name[3:]}"


def parse_turtle(text: str, scope: str, base: str = "") -> list[tuple]:
    """Rows of QUADS; BadRdf if the text is no Turtle or TriG."""
    key = sha256(scope.encode()).hexdigest()

    def term(t, g: str) -> tuple:
        if isinstance(t, Iri):
            if t.value.startswith(RESERVED):
                raise BadRdf("reserved IRI")
            return (1, t.value, None, None)
        if isinstance(t, Lit):
            return (3, t.value, t.datatype, t.lang)
        if not t.name.startswith("."):
            raise BadRdf("a variable is no RDF term")
        return (2, f"{key}|{g}|{t.name}", None, None)

    try:
        rows = []
        for t, g in _Turtle(text, base).statements():
            if not isinstance(t.p, Iri) or isinstance(t.s, Lit):
                raise BadRdf(f"no triple: {t}")
            rows.append((term(t.s, g), t.p.value, term(t.o, g), g))
        return rows
    except SyntaxFault as e:
        raise BadRdf(str(e)) from e


def read_files(spark: SparkSession, path: str | list[str], graph: str | None = None, parser: Callable[[str, str], list[tuple]] = parse_turtle) -> DataFrame:
    """Quads of files in a format that can't be split, a task parsing a file at a time."""
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for value, file in zip(pdf["value"], pdf.file, strict=True):
                rows = parser(value, file)
                for i in range(0, len(rows), 20_000):
                    part = rows[i : i + 20_000]
                    yield pd.DataFrame({"s": [dict(zip("kvdl", r[0], strict=True)) for r in part], "p": [r[1] for r in part], "o": [dict(zip("kvdl", r[2], strict=True)) for r in part], "g": [r[3] if graph is None else graph for r in part]})

    return files.mapInPandas(parse, QUADS)


_X = "{http://www.w3.org/XML/1998/namespace}"
_R = "{" + RDF + "}"


def parse_rdfxml(text: str, scope: str, base: str = "") -> list[tuple]:
    """Rows of QUADS in the default graph from RDF/XML: node and property elements, containers' li, typed and plain
    literals, parseType Resource, Collection and Literal; BadRdf for anything else."""
    try:
        root = ElementTree.fromstring(text)
    except ElementTree.ParseError as e:
        raise BadRdf(str(e)) from e
    key, rows, n = sha256(scope.encode()).hexdigest(), [], 0

    def blank(label: str | None = None) -> tuple:
        nonlocal n
        n += label is None
        return (2, f"{key}||{label or f'.{n}'}", None, None)

    def iri(tag: str) -> str:
        return tag[1:].replace("}", "", 1)

    def emit(s: tuple, p: str, o: tuple) -> None:
        rows.append((s, p, o, DEFAULT))

    def literal(v: str, lang: str | None, kind: str | None = None) -> tuple:
        return (3, v, kind or (RDF + "langString" if lang else XSD + "string"), None if kind else lang)

    def node(e, base: str, lang: str | None) -> tuple:
        base, lang = e.get(_X + "base", base), (e.get(_X + "lang") or lang or "").lower() or None
        about, label, own = e.get(_R + "about"), e.get(_R + "nodeID"), e.get(_R + "ID")
        s = (1, urljoin(base, about if about is not None else "#" + own), None, None) if about is not None or own else blank(label)
        if e.tag != _R + "Description":
            emit(s, RDF_TYPE, (1, iri(e.tag), None, None))
        for k, v in e.attrib.items():
            if not k.startswith((_R, _X)) and k.startswith("{"):
                emit(s, iri(k), literal(v, lang))
            elif k == _R + "type":
                emit(s, RDF_TYPE, (1, urljoin(base, v), None, None))
        items(s, e, base, lang)
        return s

    def items(s: tuple, e, base: str, lang: str | None) -> None:
        count = 0
        for c in e:
            count += c.tag == _R + "li"
            emit(s, RDF + f"_{count}" if c.tag == _R + "li" else iri(c.tag), value(c, base, lang))

    def value(e, base: str, lang: str | None) -> tuple:
        base, lang = e.get(_X + "base", base), (e.get(_X + "lang") or lang or "").lower() or None
        how = e.get(_R + "parseType")
        if e.get(_R + "resource") is not None:
            return (1, urljoin(base, e.get(_R + "resource")), None, None)
        if how == "Resource":
            o = blank()
            items(o, e, base, lang)
            return o
        if how == "Collection":
            head: tuple = (1, RDF + "nil", None, None)
            for x in reversed([node(c, base, lang) for c in e]):
                cell = blank()
                emit(cell, RDF + "first", x)
                emit(cell, RDF + "rest", head)
                head = cell
            return head
        if how == "Literal":
            return literal((e.text or "") + "".join(ElementTree.tostring(c, encoding="unicode") for c in e), None, RDF + "XMLLiteral")
        if how is not None:
            raise BadRdf(f"parseType {how}")
        if len(e) > 1:
            raise BadRdf("a property with two values")
        if len(e):
            return node(e[0], base, lang)
        if e.get(_R + "nodeID"):
            return blank(e.get(_R + "nodeID"))
        return literal(e.text or "", lang, e.get(_R + "datatype"))

    for e in root if root.tag == _R + "RDF" else [root]:
        node(e, root.get(_X + "base", base), root.get(_X + "lang"))
    return rows


def read(spark: SparkSession, path: str, graph: str | None = None) -> DataFrame:
    """Quads of a file or folder, by the name's ending."""
    kind = Path(path).suffix.lower()
    if kind in (".nt", ".nq"):
        return read_lines(spark, path, graph)
    if kind in (".ttl", ".trig", ".rdf", ".xml", ".owl"):
        return read_files(spark, path, graph, parse_turtle if kind in (".ttl", ".trig") else parse_rdfxml)
    raise BadRdf(f"unknown RDF format {kind!r}")


def from_text(spark: SparkSession, text: str, graph: str | None = None) -> DataFrame:
    """Quads of a small text in Turtle or TriG."""
    return spark.createDataFrame([(*r[:3], r[3] if graph is None else graph) for r in parse_turtle(text, "text")], QUADS)


def normalized(quads: DataFrame) -> DataFrame:
    """Each fact once; a fact id is the digest of its parts, each with its length before it."""
    parts = [F.col("s.k").cast("string"), F.col("s.v"), F.col("p"), F.col("o.k").cast("string"), F.col("o.v"), F.coalesce("o.d", F.lit("")), F.coalesce("o.l", F.lit("")), F.col("g")]
    return quads.withColumn("fact_id", F.sha2(F.concat(*[F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in parts]), 256)).dropDuplicates(["fact_id"])


# writers


def ntriples(c: Column) -> Column:
    """A term struct in N-Triples form."""
    lit = F.replace(F.replace(F.replace(F.replace(c["v"], F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    tail = F.when(c["l"].isNotNull(), F.concat(F.lit("@"), c["l"])).when(c["d"] == XSD + "string", "").otherwise(F.concat(F.lit("^^<"), c["d"], F.lit(">")))
    return F.when(c["k"] == 1, F.concat(F.lit("<"), c["v"], F.lit(">"))).when(c["k"] == 2, F.concat(F.lit("_:b"), F.sha2(c["v"], 256))).otherwise(F.concat(F.lit('"'), lit, F.lit('"'), tail))


def write_lines(quads: DataFrame, path: str) -> None:
    """N-Quads text, or N-Triples if there is no graph column; one file a partition."""
    g = [F.when(F.col("g") != DEFAULT, F.concat(F.lit("<"), F.col("g"), F.lit(">")))] if "g" in quads.columns else []
    line = F.concat(F.concat_ws(" ", ntriples(F.col("s")), F.concat(F.lit("<"), F.col("p"), F.lit(">")), ntriples(F.col("o")), *g), F.lit(" ."))
    quads.select(line.alias("value")).write.mode("errorifexists").text(path)


__all__ = ["DEFAULT", "QUADS", "RDF_TYPE", "BadRdf", "Var", "from_text", "normalized", "ntriples", "parse_rdfxml", "parse_turtle", "read", "read_files", "read_lines", "unescape", "write_lines"]
