"""Queries of the operators around graphs, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.engine import Engine
from graphloom.operators import governed, graph, reason, text
from graphloom.plans.values import TERM
from graphloom.queries.tables import ALL, MAPPINGS, engine
from graphloom.session import table
from graphloom.sources import rdf
from graphloom.sources.mapping import Mapping, VirtualSource

#: A small ontology over the tables: classes of places, and properties that say what follows.
ONTOLOGY = """
@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix p: <urn:p:> . @prefix c: <urn:c:> . @prefix x: <urn:x:> .
<urn:g:ontology> {
  c:nation rdfs:subClassOf x:Place . c:region rdfs:subClassOf x:Place . x:Place rdfs:subClassOf x:Thing .
  <urn:p:n_regionkey:ref> rdfs:subPropertyOf x:within . <urn:p:s_nationkey:ref> rdfs:domain x:Seller ; rdfs:range x:Market .
  x:sellsIn owl:propertyChainAxiom ( <urn:p:s_nationkey:ref> <urn:p:n_regionkey:ref> ) . x:hosts owl:inverseOf x:sellsIn .
}
"""


def _tables(spark: SparkSession, d: str, names: list[str]) -> DataFrame:
    """The named tables' graphs as quads."""
    e = engine(spark, d)
    source: VirtualSource = e.source(e.catalog.resolve(ALL, _EMPTY)[0])
    out = None
    for m in e.mappings:
        if m.name in names:
            part = source.triples(m)
            out = part if out is None else out.unionByName(part)
    return out


class _Empty:
    default_graphs: tuple = ()
    named_graphs: tuple = ()


_EMPTY = _Empty()


def _entailed(spark: SparkSession, d: str) -> Engine:
    quads = _tables(spark, d, ["region", "nation", "supplier"]).unionByName(rdf.from_text(spark, ONTOLOGY))
    return Engine.over_quads(quads, closure=reason.materialize(quads))


_P = "PREFIX x: <urn:x:> PREFIX p: <urn:p:> PREFIX rdfs: <http://www.w3.org/2000/01/rdf-schema#>\n"


def entail_subclass(spark: SparkSession, d: str) -> DataFrame:
    return _entailed(spark, d).query(_P + "SELECT ?s WHERE { ?s a x:Thing }")


def entail_domain_range(spark: SparkSession, d: str) -> DataFrame:
    return _entailed(spark, d).query(_P + "SELECT ?s ?t WHERE { VALUES ?t { x:Seller x:Market } ?s a ?t }")


def entail_chain(spark: SparkSession, d: str) -> DataFrame:
    return _entailed(spark, d).query(_P + "SELECT ?r ?s WHERE { ?r x:hosts ?s }")


def entail_scope(spark: SparkSession, d: str) -> DataFrame:
    """With FROM no closure takes part."""
    return _entailed(spark, d).query(_P + "SELECT ?s ?t FROM <urn:g:nation> WHERE { ?s a ?t FILTER(?t IN (<urn:c:nation>, x:Place, x:Thing)) }")


def closure_materialize(spark: SparkSession, d: str) -> DataFrame:
    """Consequences by predicate."""
    quads = _tables(spark, d, ["region", "nation", "supplier"]).unionByName(rdf.from_text(spark, ONTOLOGY))
    return reason.materialize(quads).groupBy("p").agg(F.count_distinct("s", "o").alias("n"))


def sameas_rep(spark: SparkSession, d: str) -> DataFrame:
    """Customers of one nation and segment are the same, as far as this query goes: components by shared keys."""
    c = table(spark, d, "customer").select(F.col("c_name").alias("a"), F.concat_ws("|", "c_nationkey", "c_mktsegment").alias("b"))
    return reason.representatives(c).where(F.col("member").startswith("Customer"))


def hydrate(spark: SparkSession, d: str) -> DataFrame:
    keys = engine(spark, d).query("PREFIX p: <urn:p:> SELECT ?doc_id WHERE { ?x p:doc_id ?doc_id ; p:source ?s ; p:n_chars ?n FILTER(?s = \"query_notes\" && ?n > 500) }", ALL)
    out = graph.hydrate(keys.withColumn("ordinal", F.col("doc_id")), table(spark, d, "documents"), "doc_id", ["text", "lang"])
    return out.select("doc_id", F.md5("text").alias("digest"), "lang")


def capability_index(spark: SparkSession, d: str) -> DataFrame:
    return graph.capability_index(_tables(spark, d, ["region", "nation"]))


def dictionary_encode(spark: SparkSession, d: str) -> DataFrame:
    """Ids of the nation graph's subjects; IRIs come in the order of their text."""
    quads = _tables(spark, d, ["nation"])
    terms = graph.dictionary(quads)
    ids = quads.select(F.col("s.v").alias("iri"), graph.term_key(F.col("s")).alias("term_key")).distinct().join(terms, "term_key")
    return ids.select("iri", "id")


def capability_all(spark: SparkSession, d: str) -> DataFrame:
    """The capability index of all mapped tables, which grow with the scale."""
    return graph.capability_index(_tables(spark, d, [m.name for m in MAPPINGS]))


def dictionary_all(spark: SparkSession, d: str) -> DataFrame:
    """The facts of all mapped tables by ids of one dictionary, counted by predicate and graph."""
    quads = _tables(spark, d, [m.name for m in MAPPINGS])
    terms = graph.dictionary(quads)
    counts = graph.encoded(quads, terms).groupBy("p", "g").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(graph.predicates(terms), "p").select("iri", "g", "n")


def encoded_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts by ids, decoded again through the dictionary: an exact round trip, counted by predicate."""
    quads = _tables(spark, d, ["region", "nation", "customer"])
    terms = graph.dictionary(quads)
    facts = graph.encoded(quads, terms)
    counts = facts.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("s").alias("subjects"))
    return counts.join(graph.predicates(terms), "p").select("iri", "n", "subjects")


def adjacency_degree(spark: SparkSession, d: str) -> DataFrame:
    """In-degree of nations by predicate, from the reverse adjacency."""
    quads = _tables(spark, d, ["customer", "supplier"])
    back = graph.adjacency(quads, forward=False).where(F.col("anchor.v").startswith("urn:nation:"))
    return back.groupBy(F.col("anchor.v").alias("nation"), F.col("pred")).agg(F.count(F.lit(1)).alias("n"))


def semijoin_reduce(spark: SparkSession, d: str) -> DataFrame:
    rich = table(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_custkey").alias("o_custkey"))
    return graph.semijoin_reduce(table(spark, d, "orders").select("o_orderkey", "o_custkey"), rich, ["o_custkey"])


def query_log(spark: SparkSession, d: str) -> DataFrame:
    out = graph.query_log(table(spark, d, "query_execution_log"), status="COMPLETED", least_ms=100, limit=50, offset=10)
    return out.select("query_execution_id", "start_time_epoch_ms", "total_duration_ms")


def nearest_rank(spark: SparkSession, d: str) -> DataFrame:
    return graph.nearest_rank(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice", [0.5, 0.95, 0.99])


OBSERVATIONS = governed.RowMapping(
    "observation_iri", "graph_iri",
    (
        ("urn:core:observedOn", governed.ObjectMap("entity", "entity_guid"), governed.Treatment()),
        ("urn:core:value", governed.ObjectMap("typed", "metric_value", "http://www.w3.org/2001/XMLSchema#double"), governed.Treatment("virtual", reasoning=False)),
        ("urn:core:kind", governed.ObjectMap("iri", value="urn:core:Observation"), governed.Treatment()),
        ("urn:core:label", governed.ObjectMap("language", "policy_label", language="lang"), governed.Treatment("virtual")),
        ("urn:core:rawMessage", governed.ObjectMap("typed", "raw_message", "http://www.w3.org/2001/XMLSchema#string"), governed.Treatment("payload", queryable=False)),
    ),
)


def _observations(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "observations").dropDuplicates(["record_guid"]).withColumn("lang", F.lit("en"))
    return rows.withColumn("metric_value", F.when(F.col("metric_value") != -999, F.col("metric_value")))


def mapped_observations(spark: SparkSession, d: str) -> DataFrame:
    """Observations by the graph their rows name: a relational mapping with core, virtual and payload predicates."""
    e = Engine.over_quads(governed.mapped_quads(_observations(spark, d), OBSERVATIONS)[0])
    return e.query("SELECT ?g (COUNT(?v) AS ?n) (MAX(<http://www.w3.org/2001/XMLSchema#double>(?v)) AS ?hi) WHERE { GRAPH ?g { ?x <urn:core:observedOn> ?e ; <urn:core:value> ?v FILTER(?v > 500) } } GROUP BY ?g")


def mapped_objects(spark: SparkSession, d: str) -> DataFrame:
    """What the object maps make of the observations, by predicate and kind of term."""
    facts, payload = governed.mapped_quads(_observations(spark, d), OBSERVATIONS)
    return facts.unionByName(payload).groupBy("p", F.col("o.k").alias("kind"), F.col("o.d").alias("datatype"), F.col("o.l").alias("lang")).agg(F.count(F.lit(1)).alias("n"), F.min("o.v").alias("least"))


def _iri(c):
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNotNull(), F.struct(F.lit(1).alias("k"), c.alias("v"), F.lit(None).cast("string").alias("d"), F.lit(None).cast("string").alias("l"))).cast(TERM)


def chunk_text(spark: SparkSession, d: str) -> DataFrame:
    return text.chunk_text(table(spark, d, "documents"), "doc_id", "text")


def reduce_context(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that state a requirement are kept, others as far as 2,000 bytes beyond them go.

    A document whose requirements take over 24,000 bytes is refused: one row with a null ordinal and what they take.
    """
    parts = chunk_text(spark, d).withColumn("size", F.col("byte_end") - F.col("byte_start"))
    return text.reduce_context(parts, "doc_id", "ordinal", "size", "requirement", 24_000, 2_000, refusals=True).select("doc_id", "ordinal", "size")


def chunk_cover(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of at most 400 bytes, for each text: whether they lie apart and in order, and hold all its letters and digits."""
    parts = text.chunk_text(table(spark, d, "documents"), "doc_id", "text", target=200, most=400)
    texts = table(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("b"))
    cut = parts.join(texts, "doc_id").withColumn("c", F.decode(F.expr("substring(b, int(byte_start) + 1, int(byte_end - byte_start))"), "UTF-8"))
    letters = F.char_length(F.regexp_replace("c", r"[^\p{L}\p{N}]", ""))
    return cut.groupBy("doc_id").agg(F.sum(letters).cast("bigint").alias("n_letters"), (F.max(F.col("byte_end") - F.col("byte_start")) <= 400).alias("small"))


def memory_search(spark: SparkSession, d: str) -> DataFrame:
    return text.memory_search(table(spark, d, "documents"), "text", ["proof", "archive"], [F.col("created_at").desc(), F.col("doc_id")], 25).select("doc_id", "score")


def invalid_literals(spark: SparkSession, d: str) -> DataFrame:
    """Token counts of calls read as unsigned: what isn't one, and how often."""
    calls = table(spark, d, "model_call").where("input_tokens is not null")
    value = F.struct(F.lit(3).alias("k"), F.col("input_tokens").cast("string").alias("v"), F.lit("http://www.w3.org/2001/XMLSchema#unsignedShort").alias("d"), F.lit(None).cast("string").alias("l")).cast(TERM)
    quads = calls.select(_iri(F.concat(F.lit("urn:call:"), "model_call_id")).alias("s"), F.lit("urn:p:tokens").alias("p"), value.alias("o"), F.lit("urn:g:calls").alias("g"))
    return governed.invalid_literals(quads).select("value", "fault", "n")


def without_source(spark: SparkSession, d: str) -> DataFrame:
    """Customers without a pending order, as subjects that nothing is derived from."""
    quads = _tables(spark, d, ["customer"])
    orders = table(spark, d, "orders").where("o_orderstatus = 'P'").select(_iri(F.concat(F.lit("urn:customer:"), F.col("o_custkey").cast("string"))).alias("s"), F.lit("urn:from").alias("p"), _iri(F.concat(F.lit("urn:orders:"), F.col("o_orderkey").cast("string"))).alias("o"), F.lit("urn:g:x").alias("g"))
    return governed.without_source(quads.unionByName(orders), "urn:from").select(F.col("s.v").alias("s")).where(F.col("s").startswith("urn:customer:"))


def encoded_join(spark: SparkSession, d: str) -> DataFrame:
    """Orders by customer joined with customers by nation: multiplicities and proofs."""
    orders = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c")).agg(F.count(F.lit(1)).alias("m"), F.array(F.lit("o")).alias("proofs"))
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("c"), F.col("c_nationkey").alias("nation"), F.lit(2).cast("bigint").alias("m"), F.array(F.lit("c")).alias("proofs"))
    return governed.encoded_join(orders, customers, ["c"]).select("c", "nation", "m", F.array_join("proofs", "+").alias("proofs"))


def leaf_scan(spark: SparkSession, d: str) -> DataFrame:
    """Lines of one part and two supplier groups as encoded facts."""
    facts = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("s"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("o"), (F.col("l_linenumber")).alias("g"))
    return governed.leaf_scan(facts, [1, 3], p=7)


def routed_graphs(spark: SparkSession, d: str) -> DataFrame:
    """Graphs that a query about nations needs, out of three."""
    from graphloom.plans.parser import parse

    quads = _tables(spark, d, ["region", "nation", "customer"])
    q = parse("SELECT * { ?n <urn:p:n_name> ?x . ?r a <urn:c:region> }")
    got = governed.route_graphs(q, graph.capability_index(quads), ["urn:g:region", "urn:g:nation", "urn:g:customer"])
    return spark.createDataFrame([(g,) for g in sorted(got)], "g string")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (entail_subclass, entail_domain_range, entail_chain, entail_scope, closure_materialize, sameas_rep, hydrate, capability_index, dictionary_encode, capability_all, dictionary_all, encoded_facts, adjacency_degree, semijoin_reduce, query_log, nearest_rank, mapped_observations, mapped_objects, invalid_literals, without_source, encoded_join, leaf_scan, routed_graphs, chunk_text, chunk_cover, reduce_context, memory_search)
}



def _facts_of(m: Mapping) -> str:
    """The facts of a mapped table by predicate: columns that are not null, references, and the class of each row."""
    hidden = f" EXCLUDE ({', '.join(m.payload)})" if m.payload else ""
    parts = [f"SELECT 'urn:p:' || c AS iri, count(*) AS n FROM (UNPIVOT (SELECT COLUMNS(*{hidden})::VARCHAR FROM {m.name}) ON COLUMNS(*) INTO NAME c VALUE v) GROUP BY 1"]
    parts += [f"SELECT 'urn:p:{c}:ref', count({c}) FROM {m.name}" for c, _ in m.links]
    parts.append(f"SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', count(*) FROM {m.name}")
    return " UNION ALL ".join(f"SELECT iri, 'urn:g:{m.name}' AS g, n FROM ({x}) x(iri, n) WHERE n > 0" for x in parts)


_FACTS = "facts AS (" + " UNION ALL ".join(map(_facts_of, MAPPINGS)) + ")"

SQL: dict[str, str] = {
    "dictionary_all": f"WITH {_FACTS} SELECT iri, g, n FROM facts",
    "capability_all": f"""WITH {_FACTS} SELECT 'predicate' AS kind, iri, string_agg(g, ' ' ORDER BY g) AS graphs, sum(n)::BIGINT AS n FROM facts GROUP BY iri
UNION ALL SELECT 'class', replace(g, 'urn:g:', 'urn:c:'), g, n FROM facts WHERE iri LIKE '%#type'""",
    "invalid_literals": "SELECT input_tokens::VARCHAR AS value, 'unsignedShort out of range' AS fault, count(*) AS n FROM model_call WHERE input_tokens < 0 OR input_tokens > 65535 GROUP BY 1",
    "without_source": "SELECT 'urn:customer:' || c_custkey AS s FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
    "encoded_join": "SELECT o_custkey AS c, c_nationkey AS nation, 2 * count(*) AS m, 'o+c' AS proofs FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2",
    "leaf_scan": "SELECT l_orderkey AS s, l_partkey AS p, l_suppkey AS o, l_linenumber AS g FROM lineitem WHERE l_partkey = 7 AND l_linenumber IN (1, 3)",
    "routed_graphs": "SELECT * FROM (VALUES ('urn:g:nation'), ('urn:g:region')) v(g)",
    "entail_subclass": "SELECT 'urn:nation:' || n_nationkey AS s FROM nation UNION ALL SELECT 'urn:region:' || r_regionkey FROM region",
    "entail_domain_range": "SELECT 'urn:supplier:' || s_suppkey AS s, 'urn:x:Seller' AS t FROM supplier UNION SELECT 'urn:nation:' || s_nationkey, 'urn:x:Market' FROM supplier",
    "entail_chain": "SELECT 'urn:region:' || n_regionkey AS r, 'urn:supplier:' || s_suppkey AS s FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "entail_scope": "SELECT 'urn:nation:' || n_nationkey AS s, 'urn:c:nation' AS t FROM nation",
    "closure_materialize": """SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' AS p, (SELECT 2 * count(*) FROM nation) + (SELECT 2 * count(*) FROM region) + (SELECT count(*) + count(DISTINCT s_nationkey) FROM supplier) AS n
UNION ALL SELECT 'urn:x:within', count(*) FROM nation UNION ALL SELECT 'urn:x:sellsIn', count(*) FROM supplier UNION ALL SELECT 'urn:x:hosts', count(*) FROM supplier
UNION ALL SELECT 'http://www.w3.org/2000/01/rdf-schema#subClassOf', 5 UNION ALL SELECT 'http://www.w3.org/2000/01/rdf-schema#subPropertyOf', 1""",
    "sameas_rep": "SELECT c_name AS member, least(min(c_name) OVER (PARTITION BY c_nationkey, c_mktsegment), c_nationkey || '|' || c_mktsegment) AS representative FROM customer",
    "hydrate": "SELECT doc_id, md5(text) AS digest, lang FROM documents WHERE source = 'query_notes' AND n_chars > 500",
    "capability_index": """WITH t AS (SELECT unnest(['n_nationkey', 'n_name', 'n_regionkey', 'n_regionkey:ref']) c) SELECT 'predicate' AS kind, 'urn:p:' || c AS iri, 'urn:g:nation' AS graphs, (SELECT count(*) FROM nation) AS n FROM t
UNION ALL SELECT 'predicate', 'urn:p:' || c, 'urn:g:region', (SELECT count(*) FROM region) FROM (SELECT unnest(['r_regionkey', 'r_name']) c)
UNION ALL SELECT 'predicate', 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'urn:g:nation urn:g:region', (SELECT count(*) FROM nation) + (SELECT count(*) FROM region)
UNION ALL SELECT 'class', 'urn:c:nation', 'urn:g:nation', count(*) FROM nation UNION ALL SELECT 'class', 'urn:c:region', 'urn:g:region', count(*) FROM region""",
    "dictionary_encode": """WITH iris AS (SELECT 'urn:nation:' || n_nationkey AS iri FROM nation UNION SELECT 'urn:region:' || n_regionkey FROM nation UNION SELECT 'urn:c:nation' UNION
SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' UNION SELECT 'urn:p:' || unnest(['n_nationkey', 'n_name', 'n_regionkey', 'n_regionkey:ref'])), ids AS (SELECT iri, row_number() OVER (ORDER BY iri || chr(1)) AS id FROM iris)
SELECT iri, id FROM ids WHERE iri LIKE 'urn:nation:%'""",
    "encoded_facts": """WITH c AS (SELECT count(*) n FROM customer), x AS (SELECT count(*) n FROM nation), r AS (SELECT count(*) n FROM region)
SELECT 'urn:p:' || unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_nationkey:ref', 'c_acctbal', 'c_mktsegment']) AS iri, n, n AS subjects FROM c UNION ALL
SELECT 'urn:p:' || unnest(['n_nationkey', 'n_name', 'n_regionkey', 'n_regionkey:ref']), n, n FROM x UNION ALL SELECT 'urn:p:' || unnest(['r_regionkey', 'r_name']), n, n FROM r
UNION ALL SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', c.n + x.n + r.n, c.n + x.n + r.n FROM c, x, r""",
    "adjacency_degree": "SELECT 'urn:nation:' || c_nationkey AS nation, 'urn:p:c_nationkey:ref' AS pred, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT 'urn:nation:' || s_nationkey, 'urn:p:s_nationkey:ref', count(*) FROM supplier GROUP BY 1",
    "semijoin_reduce": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)",
    "query_log": "SELECT query_execution_id, start_time_epoch_ms, total_duration_ms FROM query_execution_log WHERE status = 'COMPLETED' AND total_duration_ms >= 100 ORDER BY start_time_epoch_ms DESC NULLS LAST, query_execution_id DESC NULLS LAST, loaded_at DESC NULLS LAST LIMIT 50 OFFSET 10",
    "nearest_rank": "SELECT o_orderpriority, quantile_disc(o_totalprice, 0.5) AS p50, quantile_disc(o_totalprice, 0.95) AS p95, quantile_disc(o_totalprice, 0.99) AS p99 FROM orders GROUP BY 1",
    "mapped_observations": "SELECT graph_iri AS g, count(*) AS n, max(metric_value) AS hi FROM (SELECT DISTINCT ON (record_guid) * FROM observations) WHERE metric_value > 500 AND observation_iri IS NOT NULL AND entity_guid IS NOT NULL GROUP BY 1",
    "memory_search": r"""SELECT doc_id, len(list_filter(l, lambda x: x IN ('proof', 'archive'))) AS score FROM (SELECT doc_id, created_at, string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+') l FROM documents)
WHERE list_contains(l, 'proof') AND list_contains(l, 'archive') ORDER BY score DESC, created_at DESC, doc_id LIMIT 25""",
    "chunk_cover": r"SELECT doc_id, length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) AS n_letters, true AS small FROM documents WHERE regexp_matches(text, '\S')",
    "mapped_objects": """WITH o AS (SELECT * EXCLUDE (rn), CASE WHEN metric_value <> -999 THEN metric_value END v FROM (SELECT *, row_number() OVER (PARTITION BY record_guid ORDER BY loaded_at) rn FROM observations) WHERE rn = 1 AND observation_iri IS NOT NULL AND graph_iri IS NOT NULL),
x AS (SELECT 'urn:core:observedOn' p, 1 kind, NULL datatype, NULL lang, 'urn:uuid:' || lower(entity_guid) v FROM o UNION ALL SELECT 'urn:core:kind', 1, NULL, NULL, 'urn:core:Observation' FROM o
  UNION ALL SELECT 'urn:core:label', 3, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#langString', 'en', policy_label FROM o UNION ALL SELECT 'urn:core:rawMessage', 3, 'http://www.w3.org/2001/XMLSchema#string', NULL, raw_message FROM o)
SELECT p, kind, datatype, lang, count(*) AS n, min(v) AS least FROM x WHERE v IS NOT NULL GROUP BY ALL UNION ALL SELECT 'urn:core:value', 3, 'http://www.w3.org/2001/XMLSchema#double', NULL, count(v), min(v)::VARCHAR FROM o""",
}
