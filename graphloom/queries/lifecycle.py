"""Queries of readers, writers, result formats, snapshots, policies, caches and streams, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import results
from graphloom.cache import ResultCache
from graphloom.engine import Catalog, Engine, GraphRecord
from graphloom.operators import exact, governed, graph, snapshot
from graphloom.operators.reason import OWL, Ontology, ontology
from graphloom.plans.algebra import Bgp, Iri, Triple, Var
from graphloom.plans.lower import Scope
from graphloom.plans.parser import parse
from graphloom.queries.graphs import ONTOLOGY, _facts_of, _tables
from graphloom.queries.tables import ALL, MAPPINGS, engine
from graphloom.session import checkpoint, shared_folder, table
from graphloom.sources import rdf
from graphloom.streaming import ingest

_P = "PREFIX p: <urn:p:> PREFIX c: <urn:c:>\n"
_NATIONS = _P + "SELECT ?k ?name ?none WHERE { ?n p:n_nationkey ?k ; p:n_name ?name }"


def _folder(spark: SparkSession, ending: str = "") -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}{ending}"


def _by_predicate(quads: DataFrame) -> DataFrame:
    return quads.groupBy(F.col("p").alias("iri"), "g").agg(F.count(F.lit(1)).alias("n"))


# result formats


def _rows(form: Callable) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: form(engine(spark, d).relation(_NATIONS, ALL), ["k", "name", "none"])


def results_written(spark: SparkSession, d: str) -> DataFrame:
    """CSV lines of all customers, written by the executors and read again."""
    rel = engine(spark, d).relation(_P + "SELECT ?k ?name WHERE { ?c p:c_custkey ?k ; p:c_name ?name }", ALL)
    path = _folder(spark)
    results.write(rel, ["k", "name"], "csv", path)
    return spark.read.option("header", True).csv(f"{path}/rows").select(F.col("k").cast("bigint"), "name")


def arrow_stream(spark: SparkSession, d: str) -> DataFrame:
    """Bindings as Arrow batches, decoded again and counted."""
    rel = engine(spark, d).relation(_P + "SELECT ?k ?m WHERE { ?c p:c_custkey ?k ; p:c_mktsegment ?m }", ALL)
    return results.from_arrow(results.arrow_batches(rel, ["k", "m"]), "k bigint, m string").groupBy("m").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("keys"))


def graph_turtle(spark: SparkSession, d: str) -> DataFrame:
    return results.turtle_subjects(_tables(spark, d, ["region"]).select("s", "p", "o"))


def result_hash(spark: SparkSession, d: str) -> DataFrame:
    """Digests of one result in two orders, and of another result."""
    e = engine(spark, d)
    q = _P + "SELECT ?k ?name WHERE {{ ?n p:n_nationkey ?k ; p:n_name ?name FILTER(?k < {}) }} ORDER BY {}"
    a, b, c = (results.canonical_hash(e.relation(q.format(*x), ALL), ["k", "name"], False) for x in ((20, "?k"), (20, "DESC(?k)"), (19, "?k")))
    up, down = (results.canonical_hash(e.relation(q.format(*x), ALL), ["k", "name"], True) for x in ((20, "?k"), (20, "DESC(?k)")))
    return spark.createDataFrame([(a == b, a == c, up == down)], "same boolean, other boolean, ordered boolean")


def construct_blank(spark: SparkSession, d: str) -> DataFrame:
    """Equal solutions have blank nodes of their own."""
    out = engine(spark, d).query(_P + "CONSTRUCT { [] <urn:in> ?r } WHERE { ?n p:n_regionkey:ref ?r }", ALL)
    return out.groupBy("object").agg(F.count_distinct("subject").alias("n"))


# readers


def ingest_nquads(spark: SparkSession, d: str) -> DataFrame:
    """Facts of three tables, written as N-Quads and read by Spark's splits."""
    path = _folder(spark, ".nq")
    rdf.write_lines(_tables(spark, d, ["region", "nation", "customer"]), path)
    return _by_predicate(rdf.read(spark, path))


def ingest_ntriples(spark: SparkSession, d: str) -> DataFrame:
    """Triples without a graph, read into one that is named."""
    path = _folder(spark, ".nt")
    rdf.write_lines(_tables(spark, d, ["supplier"]).select("s", "p", "o"), path)
    return _by_predicate(rdf.read(spark, path, "urn:g:read"))


def ingest_turtle(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, ".ttl")
    results.turtle_subjects(_tables(spark, d, ["customer"]).select("s", "p", "o")).write.text(path)
    return _by_predicate(rdf.read(spark, path, "urn:g:customer"))


def quads_normalized(spark: SparkSession, d: str) -> DataFrame:
    """Facts given twice are one each."""
    quads = _tables(spark, d, ["nation", "customer"])
    return _by_predicate(rdf.normalized(quads.unionByName(quads)))


def hash_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Every fact of a table falls into one of 16 buckets, equal facts into the same."""
    quads = _tables(spark, d, ["customer"])
    laid = governed.hash_buckets(quads.unionByName(quads), 16)
    each = laid.groupBy("s", "p", "o", "g").agg(F.count(F.lit(1)).alias("m"), F.count_distinct("bucket").alias("b"), F.max("bucket").alias("top"))
    return each.groupBy(F.col("p").alias("iri")).agg(F.count(F.lit(1)).alias("n"), (F.bool_and((F.col("m") == 2) & (F.col("b") == 1)) & (F.max("top") < 16)).alias("whole"))


def graph_merge(spark: SparkSession, d: str) -> DataFrame:
    """A triple that two graphs hold is one in the default graph, and one in each by name."""
    quads = _tables(spark, d, ["nation"])
    e = Engine.over_quads(quads.unionByName(quads.withColumn("g", F.lit("urn:g:copy"))))
    one = e.query(_P + "SELECT (COUNT(*) AS ?n) WHERE { ?s p:n_name ?o }").withColumn("how", F.lit("default"))
    return one.unionByName(e.query(_P + "SELECT (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?s p:n_name ?o } }").select(F.sum("n").alias("n"), F.lit("named").alias("how")))


# dataset


def routed_query(spark: SparkSession, d: str) -> DataFrame:
    """The engine asks only graphs that its index says can match."""
    quads = _tables(spark, d, ["region", "nation", "customer"])
    e = Engine.over_quads(quads, capabilities=graph.capability_index(quads))
    return e.query(_P + "SELECT ?name ?r WHERE { ?n p:n_name ?name ; p:n_regionkey:ref ?x . ?x p:r_name ?r }")


def role_restricted(spark: SparkSession, d: str) -> DataFrame:
    """Only graphs of the data role answer, though others may be seen."""
    quads = _tables(spark, d, ["region", "nation"])
    e = Engine.over_quads(quads, Catalog([GraphRecord("urn:g:region"), GraphRecord("urn:g:nation", role="provenance")]), roles=frozenset({"data"}))
    return e.query("SELECT ?t (COUNT(*) AS ?n) WHERE { ?s a ?t } GROUP BY ?t")


def policy_split(spark: SparkSession, d: str) -> DataFrame:
    """Facts by what their policy makes of them."""
    quads = _tables(spark, d, ["customer"])
    policy = {r: governed.Treatment("payload" if r.endswith("c_name") else "virtual" if r.endswith("c_acctbal") else "core", queryable=not r.endswith("c_mktsegment")) for r in [f"urn:p:{c}" for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment", "c_nationkey:ref")] + ["http://www.w3.org/1999/02/22-rdf-syntax-ns#type"]}
    facts, payload = governed.apply_policy(quads, policy)
    return facts.withColumn("kind", F.lit("facts")).unionByName(payload.withColumn("kind", F.lit("payload"))).groupBy("kind", F.col("p").alias("iri")).agg(F.count(F.lit(1)).alias("n"))


def entailment_routes(spark: SparkSession, d: str) -> DataFrame:
    """How single patterns are answered under the ontology of the tables."""
    onto: Ontology = ontology(rdf.from_text(spark, ONTOLOGY))
    v, a = Var, "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
    cases = {
        "asserted": Triple(v("s"), Iri("urn:p:n_name"), v("o")), "derived class": Triple(v("s"), Iri(a), Iri("urn:x:Thing")), "chain": Triple(v("s"), Iri("urn:x:sellsIn"), v("o")),
        "any class": Triple(v("s"), Iri(a), v("c")), "refused": Triple(v("s"), Iri(OWL + "unionOf"), v("o")), "two roles": Triple(v("s"), v("s"), v("o")),
    }
    return spark.createDataFrame([(n, governed.entailment_route(Bgp((t,)), onto, True)[0].value) for n, t in cases.items()], "pattern string, route string")


def first_invalid(spark: SparkSession, d: str) -> DataFrame:
    """The first event whose value is no integer, as a report of one row."""
    value = F.struct(F.lit(3).alias("k"), F.col("value").cast("string").alias("v"), F.lit("http://www.w3.org/2001/XMLSchema#integer").alias("d"), F.lit(None).cast("string").alias("l"))
    quads = table(spark, d, "events").select("event_id", F.lit("urn:p:value").alias("p"), value.alias("o"))
    return governed.first_invalid(quads, ["event_id"]).select("event_id", "fault")


def optional_context(spark: SparkSession, d: str) -> DataFrame:
    """The first context that may be left out, and whether any was: a top-k report."""
    kept, more = graph.optional_context(table(spark, d, "orders").select("o_orderkey", "o_totalprice", (-F.col("o_totalprice")).alias("rank")), ["rank", "o_orderkey"], 30)
    return kept.select("o_orderkey", "o_totalprice", F.lit(more).alias("more"))


# lifecycle


def snapshot_read(spark: SparkSession, d: str) -> DataFrame:
    """Facts of a published snapshot, with their number by its manifest."""
    root = _folder(spark)
    quads = _tables(spark, d, ["nation", "customer"])
    snapshot.publish(quads, root, 0)
    now = snapshot.current(spark, root)
    return _by_predicate(now.quads(spark)).withColumn("facts", F.lit(now.manifest["facts"]).cast("bigint"))


def snapshot_adjacency(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours of nations, from the reverse adjacency of a snapshot, of which the scan is asked for one anchor range."""
    root = _folder(spark)
    now = snapshot.publish(_tables(spark, d, ["customer", "supplier"]), root)
    back = now.adjacency(spark, forward=False).where(F.col("anchor.v").startswith("urn:nation:"))
    return back.groupBy(F.col("anchor.v").alias("nation"), F.col("pred")).agg(F.count(F.lit(1)).alias("n"))


def spine_types(spark: SparkSession, d: str) -> DataFrame:
    """A written spine of two tables: by predicate, how many values of each type."""
    quads, path = _tables(spark, d, ["nation", "customer"]), _folder(spark)
    terms = checkpoint(graph.dictionary(quads))
    snapshot.write_spine(quads, terms, path)
    back = spark.read.parquet(path).join(terms.withColumnRenamed("id", "predicate"), "predicate")
    counts = [F.count(c).alias(f"n_{c.removeprefix('value_')}") for c in ("object", "value_int", "value_double", "value_text")]
    return back.groupBy(F.split("term_key", "\0")[1].alias("iri"), "g").agg(*counts, F.sum("value_int").alias("total"))


def payload_located(spark: SparkSession, d: str) -> DataFrame:
    """Payload rows of some keys, read from where they were written."""
    path = _folder(spark)
    snapshot.write_payload(table(spark, d, "documents"), "doc_id", ["text", "lang"], path)
    keys = table(spark, d, "documents").where("source = 'query_notes'").select("doc_id", F.col("doc_id").alias("ordinal"))
    return graph.hydrate(keys, spark.read.parquet(path), "doc_id", ["text", "lang"]).select("doc_id", F.md5("text").alias("digest"), "lang")


def bgp_substituted(spark: SparkSession, d: str) -> DataFrame:
    """A query whose patterns are answered one by one and put back."""
    e = engine(spark, d)
    q = parse(_P + "SELECT ?name (COUNT(?c) AS ?n) WHERE { ?x p:n_name ?name OPTIONAL { ?c p:c_nationkey:ref ?x ; p:c_acctbal ?b FILTER(?b > 5000) } } GROUP BY ?name")
    lower = e.lowering(q, ALL)
    answers = {(b, g, v): lower(b, Scope(g, v)) for b, g, v in exact.bgp_templates(q)}
    return lower(exact.substituted(q, answers).pattern).decoded(["name", "n"])


def exact_merge(spark: SparkSession, d: str) -> DataFrame:
    """An answer made in four ranges of candidates, merged when all are there."""
    orders = table(spark, d, "orders").select(F.expr("o_orderkey % 4").cast("int").alias("part"), "o_orderkey")
    ranges = spark.createDataFrame([(i, 10 * i, 10 * i + 10, "COMPLETE") for i in range(4)], "part int, first bigint, after bigint, status string")
    return exact.merged(orders, ranges, 40)


def result_cache(spark: SparkSession, d: str) -> DataFrame:
    """The second answer comes from the cache."""
    cache = ResultCache(engine(spark, d), _folder(spark), "1")
    q = _P + "SELECT ?m (COUNT(*) AS ?n) WHERE { ?c p:c_mktsegment ?m } GROUP BY ?m"
    cache.query(q, ALL)
    out = cache.query(q, ALL)
    return out.withColumn("hits", F.lit(cache.hits).cast("bigint"))


def stream_append(spark: SparkSession, d: str) -> DataFrame:
    """Facts that arrive in files, some in two of them, appended once each."""
    quads = _tables(spark, d, ["nation", "supplier"]).withColumn("at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    source, target = _folder(spark), _folder(spark)
    for part in (quads, quads.where("g = 'urn:g:nation'")):
        part.write.mode("append").parquet(source)
    ingest.append_once(ingest.quad_stream(spark, source), target, _folder(spark)).awaitTermination()
    return _by_predicate(spark.read.schema(quads.schema).parquet(target))


def _named(name: str, f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    f.__name__ = name
    return f


_FORMS = [_named(f"results_{n}", _rows(f)) for n, f in (("csv", results.csv_rows), ("tsv", results.tsv_rows), ("json", results.json_rows), ("xml", results.xml_rows))]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (*_FORMS, results_written, arrow_stream, graph_turtle, result_hash, construct_blank, ingest_nquads, ingest_ntriples, ingest_turtle, quads_normalized, hash_buckets, graph_merge, routed_query, role_restricted, policy_split, entailment_routes, first_invalid, optional_context, snapshot_read, snapshot_adjacency, spine_types, payload_located, bgp_substituted, exact_merge, result_cache, stream_append)
}

_INT = "http://www.w3.org/2001/XMLSchema#integer"


def _counted(*names: str, graph: str = "g") -> str:
    facts = " UNION ALL ".join(_facts_of(m) for m in MAPPINGS if m.name in names)
    return f"SELECT iri, {graph} AS g, n FROM ({facts})"


SQL: dict[str, str] = {
    "results_csv": "SELECT n_nationkey || ',' || n_name || ',' AS value FROM nation",
    "results_tsv": f"SELECT '\"' || n_nationkey || '\"^^<{_INT}>' || chr(9) || '\"' || n_name || '\"' || chr(9) AS value FROM nation",
    "results_json": f"""SELECT '{{"k":{{"type":"literal","value":"' || n_nationkey || '","datatype":"{_INT}"}},"name":{{"type":"literal","value":"' || n_name || '"}}}}' AS value FROM nation""",
    "results_xml": f"""SELECT '<result><binding name="k"><literal datatype="{_INT}">' || n_nationkey || '</literal></binding><binding name="name"><literal>' || n_name || '</literal></binding></result>' AS value FROM nation""",
    "results_written": "SELECT c_custkey AS k, c_name AS name FROM customer",
    "arrow_stream": "SELECT c_mktsegment AS m, count(*) AS n, sum(c_custkey)::BIGINT AS keys FROM customer GROUP BY 1",
    "graph_turtle": f"""SELECT '<urn:region:' || r_regionkey || '> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <urn:c:region> ;' || chr(10) || '  <urn:p:r_name> "' || r_name || '" ;' || chr(10) || '  <urn:p:r_regionkey> "' || r_regionkey || '"^^<{_INT}> .' AS value FROM region""",
    "result_hash": "SELECT true AS same, false AS other, false AS ordered",
    "construct_blank": "SELECT '<urn:region:' || n_regionkey || '>' AS object, count(*) AS n FROM nation GROUP BY 1",
    "ingest_nquads": _counted("region", "nation", "customer"),
    "ingest_ntriples": _counted("supplier", graph="'urn:g:read'"),
    "ingest_turtle": _counted("customer"),
    "quads_normalized": _counted("nation", "customer"),
    "hash_buckets": f"SELECT iri, n, true AS whole FROM ({_counted('customer')})",
    "graph_merge": "SELECT count(*) AS n, 'default' AS how FROM nation UNION ALL SELECT 2 * count(*), 'named' FROM nation",
    "routed_query": "SELECT n_name AS name, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey",
    "role_restricted": "SELECT 'urn:c:region' AS t, count(*) AS n FROM region",
    "policy_split": f"SELECT CASE WHEN iri LIKE '%c_name' THEN 'payload' ELSE 'facts' END AS kind, iri, n FROM ({_counted('customer')}) WHERE iri NOT LIKE '%c_mktsegment'",
    "entailment_routes": "SELECT * FROM (VALUES ('asserted', 'asserted'), ('derived class', 'closure'), ('chain', 'closure'), ('any class', 'closure'), ('refused', 'unknown'), ('two roles', 'illegal')) v(pattern, route)",
    "first_invalid": "SELECT event_id, 'no integer' AS fault FROM events WHERE value <> trunc(value) OR value::VARCHAR LIKE '%.%' ORDER BY event_id LIMIT 1",
    "optional_context": "SELECT o_orderkey, o_totalprice, true AS more FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 30",
    "snapshot_read": f"SELECT *, sum(n) OVER ()::BIGINT AS facts FROM ({_counted('nation', 'customer')})",
    "snapshot_adjacency": "SELECT 'urn:nation:' || c_nationkey AS nation, 'urn:p:c_nationkey:ref' AS pred, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT 'urn:nation:' || s_nationkey, 'urn:p:s_nationkey:ref', count(*) FROM supplier GROUP BY 1",
    "spine_types": f"""SELECT iri, g, CASE WHEN iri LIKE '%:ref' OR iri LIKE '%#type' THEN n ELSE 0 END AS n_object, CASE WHEN regexp_matches(iri, 'key$') THEN n ELSE 0 END AS n_int, CASE WHEN iri LIKE '%acctbal' THEN n ELSE 0 END AS n_double,
  CASE WHEN regexp_matches(iri, '(name|segment)$') THEN n ELSE 0 END AS n_text, CASE iri WHEN 'urn:p:n_nationkey' THEN (SELECT sum(n_nationkey)::BIGINT FROM nation) WHEN 'urn:p:n_regionkey' THEN (SELECT sum(n_regionkey)::BIGINT FROM nation)
  WHEN 'urn:p:c_custkey' THEN (SELECT sum(c_custkey)::BIGINT FROM customer) WHEN 'urn:p:c_nationkey' THEN (SELECT sum(c_nationkey)::BIGINT FROM customer) END AS total FROM ({_counted('nation', 'customer')})""",
    "payload_located": "SELECT doc_id, md5(text) AS digest, lang FROM documents WHERE source = 'query_notes'",
    "bgp_substituted": "SELECT n_name AS name, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 5000 GROUP BY 1",
    "exact_merge": "SELECT o_orderkey FROM orders",
    "result_cache": "SELECT c_mktsegment AS m, count(*) AS n, 1::BIGINT AS hits FROM customer GROUP BY 1",
    "stream_append": _counted("nation", "supplier"),
}
