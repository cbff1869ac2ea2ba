"""Queries of the query language over the tables as virtual graphs, with the SQL they equal."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.queries.tables import ALL, engine

PREFIXES = "PREFIX p: <urn:p:> PREFIX c: <urn:c:> PREFIX g: <urn:g:> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#>\n"

#: name: (query, SQL)
CATALOGUE: dict[str, tuple[str, str]] = {
    # basic graph patterns
    "bgp_star": (
        "SELECT ?key ?name ?bal WHERE { ?c p:c_custkey ?key ; p:c_name ?name ; p:c_acctbal ?bal ; p:c_mktsegment \"BUILDING\" }",
        "SELECT c_custkey AS key, c_name AS name, c_acctbal AS bal FROM customer WHERE c_mktsegment = 'BUILDING'",
    ),
    "bgp_chain": (
        "SELECT ?order ?nation ?region WHERE { ?o p:o_orderkey ?order ; p:o_custkey:ref ?c . ?c p:c_nationkey:ref ?n . ?n p:n_name ?nation ; p:n_regionkey:ref ?r . ?r p:r_name ?region }",
        "SELECT o_orderkey AS \"order\", n_name AS nation, r_name AS region FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    ),
    "bgp_cross": (
        "SELECT ?a ?b WHERE { ?r p:r_name ?a . ?n p:n_name ?b }",
        "SELECT r_name AS a, n_name AS b FROM region, nation",
    ),
    "bgp_predicate_variable": (
        "SELECT ?s ?p ?o WHERE { ?s a c:nation ; ?p ?o }",
        "WITH t AS (SELECT 'urn:nation:' || n_nationkey AS s, * FROM nation) SELECT s, 'urn:p:n_nationkey' AS p, n_nationkey::VARCHAR AS o FROM t UNION ALL SELECT s, 'urn:p:n_name', n_name FROM t"
        " UNION ALL SELECT s, 'urn:p:n_regionkey', n_regionkey::VARCHAR FROM t UNION ALL SELECT s, 'urn:p:n_regionkey:ref', 'urn:region:' || n_regionkey FROM t"
        " UNION ALL SELECT s, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'urn:c:nation' FROM t",
    ),
    "bgp_constant_subject": (
        "SELECT ?name ?region WHERE { <urn:nation:3> p:n_name ?name ; p:n_regionkey:ref ?region }",
        "SELECT n_name AS name, 'urn:region:' || n_regionkey AS region FROM nation WHERE n_nationkey = 3",
    ),
    "mapping_materialized": (
        "SELECT ?s ?o WHERE { GRAPH g:supplier { ?s p:s_nationkey:ref ?o } }",
        "SELECT 'urn:supplier:' || s_suppkey AS s, 'urn:nation:' || s_nationkey AS o FROM supplier",
    ),
    # filters and expressions
    "filter_cmp": (
        "SELECT ?key WHERE { ?o p:o_orderkey ?key ; p:o_totalprice ?t ; p:o_orderdate ?d FILTER(?t >= 150000.5 && ?d < \"1999-01-01T00:00:00\"^^xsd:dateTime) }",
        "SELECT o_orderkey AS key FROM orders WHERE o_totalprice >= 150000.5 AND o_orderdate < TIMESTAMP '1999-01-01'",
    ),
    "filter_logic": (
        "SELECT ?key WHERE { ?o p:o_orderkey ?key ; p:o_orderstatus ?s ; p:o_totalprice ?t FILTER(!(?s = \"F\" || ?t < 1000) || ?key = 7) }",
        "SELECT o_orderkey AS key FROM orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice < 1000) OR o_orderkey = 7",
    ),
    "filter_in": (
        "SELECT ?key WHERE { ?c p:c_custkey ?key ; p:c_mktsegment ?m ; p:c_nationkey ?n FILTER(?m IN (\"BUILDING\", \"MACHINERY\") && ?n NOT IN (1, 2, 3)) }",
        "SELECT c_custkey AS key FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2, 3)",
    ),
    "filter_regex": (
        "SELECT ?name WHERE { ?c p:c_name ?name FILTER(REGEX(?name, \"^customer#0+1\", \"i\")) }",
        "SELECT c_name AS name FROM customer WHERE regexp_matches(lower(c_name), '^customer#0+1')",
    ),
    "filter_error": (
        "SELECT ?key WHERE { ?c p:c_custkey ?key ; p:c_name ?name FILTER(?name + 1 > 0 || ?key < 10) }",
        "SELECT c_custkey AS key FROM customer WHERE c_custkey < 10",
    ),
    # OPTIONAL
    "optional_plain": (
        "SELECT ?key ?order WHERE { ?c p:c_custkey ?key OPTIONAL { ?o p:o_custkey:ref ?c ; p:o_orderkey ?order } }",
        "SELECT c_custkey AS key, o_orderkey AS \"order\" FROM customer LEFT JOIN orders ON o_custkey = c_custkey",
    ),
    "optional_filter": (
        "SELECT ?key ?order WHERE { ?c p:c_custkey ?key ; p:c_acctbal ?b OPTIONAL { ?o p:o_custkey:ref ?c ; p:o_orderkey ?order ; p:o_totalprice ?t FILTER(?t > ?b * 50) } }",
        "SELECT c_custkey AS key, o_orderkey AS \"order\" FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > c_acctbal * 50",
    ),
    "optional_nested": (
        "SELECT ?key ?order ?part WHERE { ?c p:c_custkey ?key OPTIONAL { ?o p:o_custkey:ref ?c ; p:o_orderkey ?order ; p:o_totalprice ?t FILTER(?t > 400000) OPTIONAL { ?l p:l_orderkey:ref ?o ; p:l_partkey ?part ; p:l_quantity ?q FILTER(?q > 45) } } }",
        "SELECT c_custkey AS key, o_orderkey AS \"order\", l_partkey AS part FROM customer LEFT JOIN (orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 45) ON o_custkey = c_custkey AND o_totalprice > 400000",
    ),
    "optional_then_join": (
        "SELECT ?nation ?s ?key WHERE { ?n p:n_nationkey ?nation OPTIONAL { ?x p:s_nationkey:ref ?n ; p:s_suppkey ?s ; p:s_acctbal ?b FILTER(?b > 9000) } ?y p:s_suppkey ?s ; p:s_nationkey ?key FILTER(?nation < 5) }",
        "WITH a AS (SELECT n_nationkey AS nation, s_suppkey AS s FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 9000 WHERE n_nationkey < 5)"
        " SELECT a.nation, y.s_suppkey AS s, y.s_nationkey AS key FROM a JOIN supplier y ON a.s IS NULL OR a.s = y.s_suppkey",
    ),
    # UNION, MINUS, EXISTS
    "union_bag": (
        "SELECT ?n WHERE { { ?c p:c_nationkey ?n } UNION { ?s p:s_nationkey ?n } }",
        "SELECT c_nationkey::BIGINT AS n FROM customer UNION ALL SELECT s_nationkey FROM supplier",
    ),
    "union_hetero": (
        "SELECT ?c ?s ?n WHERE { { ?x p:c_custkey ?c ; p:c_nationkey ?n } UNION { ?y p:s_suppkey ?s ; p:s_nationkey ?n } }",
        "SELECT c_custkey AS c, NULL::BIGINT AS s, c_nationkey::BIGINT AS n FROM customer UNION ALL SELECT NULL, s_suppkey, s_nationkey FROM supplier",
    ),
    "minus_shared": (
        "SELECT ?key WHERE { ?c p:c_custkey ?key MINUS { ?o p:o_custkey:ref ?c ; p:o_orderstatus \"P\" } }",
        "SELECT c_custkey AS key FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    ),
    "minus_disjoint": (
        "SELECT ?key WHERE { ?c p:c_custkey ?key MINUS { ?n p:n_nationkey ?other } }",
        "SELECT c_custkey AS key FROM customer",
    ),
    "exists": (
        "SELECT ?key WHERE { ?c p:c_custkey ?key FILTER EXISTS { ?o p:o_custkey:ref ?c ; p:o_totalprice ?t FILTER(?t > 300000) } }",
        "SELECT c_custkey AS key FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)",
    ),
    "not_exists": (
        "SELECT ?key WHERE { ?c p:c_custkey ?key FILTER NOT EXISTS { ?o p:o_custkey:ref ?c ; p:o_orderstatus \"P\" } }",
        "SELECT c_custkey AS key FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    ),
    "exists_in_or": (
        "SELECT ?key WHERE { ?c p:c_custkey ?key ; p:c_acctbal ?b FILTER(?b < 0 || EXISTS { ?o p:o_custkey:ref ?c ; p:o_orderpriority \"1-URGENT\" }) }",
        "SELECT c_custkey AS key FROM customer WHERE c_acctbal < 0 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')",
    ),
    "exists_correlated": (
        "SELECT ?key WHERE { ?c p:c_custkey ?key ; p:c_acctbal ?b FILTER EXISTS { ?o p:o_custkey:ref ?c ; p:o_totalprice ?t FILTER(?t > ?b * 60) } }",
        "SELECT c_custkey AS key FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 60)",
    ),
    "exists_union": (
        "SELECT ?key WHERE { ?c p:c_custkey ?key ; p:c_acctbal ?b FILTER EXISTS { { ?o p:o_custkey:ref ?c ; p:o_totalprice ?t FILTER(?t > ?b * 60) } UNION { ?c p:c_mktsegment \"BUILDING\" FILTER(?b < 0) } } }",
        "SELECT c_custkey AS key FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 60) OR (c_mktsegment = 'BUILDING' AND c_acctbal < 0)",
    ),
    "exists_bind": (
        "SELECT ?key WHERE { ?c p:c_custkey ?key ; p:c_acctbal ?b FILTER EXISTS { ?o p:o_custkey:ref ?c ; p:o_totalprice ?t BIND(?b * 60 AS ?least) FILTER(?t > ?least) } }",
        "SELECT c_custkey AS key FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 60)",
    ),
    "exists_optional": (
        "SELECT ?key WHERE { ?c p:c_custkey ?key ; p:c_acctbal ?b FILTER NOT EXISTS { ?n ^p:c_nationkey:ref ?c OPTIONAL { ?o p:o_custkey:ref ?c ; p:o_totalprice ?t FILTER(?t > ?b * 60) } FILTER(BOUND(?t)) } }",
        "SELECT c_custkey AS key FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 60)",
    ),
    "exists_minus": (
        "SELECT ?key WHERE { ?c p:c_custkey ?key ; p:c_nationkey:ref ?n FILTER EXISTS { ?s p:s_nationkey:ref ?n ; p:s_suppkey ?k MINUS { ?s p:s_acctbal ?b ; p:s_nationkey:ref ?n FILTER(?b < 5000) } } }",
        "SELECT c_custkey AS key FROM customer WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND NOT s_acctbal < 5000)",
    ),
    "exists_nested": (
        "SELECT ?key WHERE { ?c p:c_custkey ?key ; p:c_acctbal ?b FILTER EXISTS { ?o p:o_custkey:ref ?c FILTER NOT EXISTS { ?o p:o_totalprice ?t FILTER(?t < ?b * 40) } } }",
        "SELECT c_custkey AS key FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND NOT o_totalprice < c_acctbal * 40)",
    ),
    "exists_union_in_or": (
        "SELECT ?key WHERE { ?c p:c_custkey ?key ; p:c_acctbal ?b FILTER(?key < 20 || EXISTS { { ?o p:o_custkey:ref ?c ; p:o_totalprice ?t FILTER(?t > ?b * 60) } UNION { ?o p:o_custkey:ref ?c ; p:o_orderstatus \"P\" } }) }",
        "SELECT c_custkey AS key FROM customer WHERE c_custkey < 20 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND (o_totalprice > c_acctbal * 60 OR o_orderstatus = 'P'))",
    ),
    "optional_exists": (
        "SELECT ?key ?order WHERE { ?c p:c_custkey ?key ; p:c_acctbal ?b OPTIONAL { ?o p:o_custkey:ref ?c ; p:o_orderkey ?order FILTER(?b > 5000 && EXISTS { ?l p:l_orderkey:ref ?o ; p:l_quantity ?q FILTER(?q * 200 > ?b) }) } }",
        "SELECT c_custkey AS key, o_orderkey AS \"order\" FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND c_acctbal > 5000 AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity * 200 > c_acctbal)",
    ),
    # VALUES, BIND
    "values_join": (
        "SELECT ?name ?tag WHERE { VALUES (?k ?tag) { (1 \"one\") (2 \"two\") (99 \"none\") } ?n p:n_nationkey ?k ; p:n_name ?name }",
        "SELECT n_name AS name, tag FROM nation JOIN (VALUES (1, 'one'), (2, 'two'), (99, 'none')) v(k, tag) ON n_nationkey = k",
    ),
    "values_undef": (
        "SELECT ?k ?r ?tag WHERE { ?n p:n_nationkey ?k ; p:n_regionkey ?r VALUES (?k ?r ?tag) { (1 UNDEF \"a\") (UNDEF 2 \"b\") (3 3 \"c\") } }",
        "SELECT n_nationkey::BIGINT AS k, n_regionkey::BIGINT AS r, tag FROM nation JOIN (VALUES (1, NULL, 'a'), (NULL, 2, 'b'), (3, 3, 'c')) v(k, r, tag) ON (k IS NULL OR n_nationkey = k) AND (r IS NULL OR n_regionkey = r)",
    ),
    "bind_arith": (
        "SELECT ?key ?v WHERE { ?l p:l_orderkey ?key ; p:l_extendedprice ?e ; p:l_discount ?d ; p:l_tax ?x BIND(ROUND(?e * (1 - ?d) * (1 + ?x)) AS ?v) }",
        "SELECT l_orderkey AS key, floor(l_extendedprice * (1 - l_discount) * (1 + l_tax) + 0.5) AS v FROM lineitem",
    ),
    "int_div_decimal": (
        "SELECT ?key ?v WHERE { ?c p:c_custkey ?key ; p:c_nationkey ?n BIND(xsd:double(?key / 8) AS ?v) }",
        "SELECT c_custkey AS key, c_custkey / 8 AS v FROM customer",
    ),
    "div_zero": (
        "SELECT ?key ?i ?d WHERE { ?n p:n_nationkey ?key ; p:n_regionkey ?r BIND(xsd:integer(?key / ?r) AS ?i) BIND(1.0e0 / ?r AS ?d) }",
        "SELECT n_nationkey::BIGINT AS key, CASE WHEN n_regionkey <> 0 THEN trunc(n_nationkey / n_regionkey)::BIGINT END AS i, CASE WHEN n_regionkey = 0 THEN 'inf'::DOUBLE ELSE 1 / n_regionkey END AS d FROM nation",
    ),
    "if_coalesce": (
        "SELECT ?key ?a ?b WHERE { ?c p:c_custkey ?key ; p:c_acctbal ?x BIND(IF(?x > 0, \"plus\", \"minus\") AS ?a) BIND(COALESCE(?none, ?key + 1) AS ?b) }",
        "SELECT c_custkey AS key, CASE WHEN c_acctbal > 0 THEN 'plus' ELSE 'minus' END AS a, c_custkey + 1 AS b FROM customer",
    ),
    # datasets
    "graph_const": (
        "SELECT ?name WHERE { GRAPH g:nation { ?n p:n_name ?name } }",
        "SELECT n_name AS name FROM nation",
    ),
    "graph_var": (
        "SELECT ?g ?k WHERE { GRAPH ?g { ?x a ?t ; p:n_nationkey ?k } }",
        "SELECT 'urn:g:nation' AS g, n_nationkey::BIGINT AS k FROM nation",
    ),
    "graph_var_count": (
        "SELECT ?g (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?x a ?t } } GROUP BY ?g",
        " UNION ALL ".join(f"SELECT 'urn:g:{t}' AS g, count(*) AS n FROM {t}" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")),
    ),
    "from_merge": (
        "SELECT ?t (COUNT(?s) AS ?n) FROM g:region FROM g:nation WHERE { ?s a ?t } GROUP BY ?t",
        "SELECT 'urn:c:region' AS t, count(*) AS n FROM region UNION ALL SELECT 'urn:c:nation', count(*) FROM nation",
    ),
    "from_named": (
        "SELECT ?g ?t (COUNT(*) AS ?n) FROM g:region FROM NAMED g:nation FROM NAMED g:part WHERE { GRAPH ?g { ?x a ?t } } GROUP BY ?g ?t",
        "SELECT 'urn:g:nation' AS g, 'urn:c:nation' AS t, count(*) AS n FROM nation UNION ALL SELECT 'urn:g:part', 'urn:c:part', count(*) FROM part",
    ),
    "union_default_set": (
        "SELECT DISTINCT ?k WHERE { { ?c p:c_nationkey ?k } UNION { ?s p:s_nationkey ?k } }",
        "SELECT c_nationkey::BIGINT AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    ),
    # aggregates
    "agg_count": (
        "SELECT ?m (COUNT(*) AS ?n) (COUNT(?o) AS ?k) WHERE { ?c p:c_mktsegment ?m OPTIONAL { ?o p:o_custkey:ref ?c } } GROUP BY ?m",
        "SELECT c_mktsegment AS m, count(*) AS n, count(o_orderkey) AS k FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    ),
    "agg_distinct": (
        "SELECT (COUNT(DISTINCT ?c) AS ?n) (COUNT(DISTINCT ?p) AS ?k) (SUM(DISTINCT ?y) AS ?s) WHERE { ?o p:o_custkey ?c ; p:o_orderpriority ?p . ?c2 p:c_custkey ?c ; p:c_nationkey ?y }",
        "SELECT count(DISTINCT o_custkey) AS n, count(DISTINCT o_orderpriority) AS k, sum(DISTINCT c_nationkey)::BIGINT AS s FROM orders JOIN customer ON c_custkey = o_custkey",
    ),
    "agg_sum_avg": (
        "SELECT ?f ?s (ROUND(SUM(?q)) AS ?sum_qty) (ROUND(AVG(?e)) AS ?avg_price) WHERE { ?l p:l_returnflag ?f ; p:l_linestatus ?s ; p:l_quantity ?q ; p:l_extendedprice ?e } GROUP BY ?f ?s",
        "SELECT l_returnflag AS f, l_linestatus AS s, floor(sum(l_quantity) + 0.5) AS sum_qty, floor(avg(l_extendedprice) + 0.5) AS avg_price FROM lineitem GROUP BY 1, 2",
    ),
    "agg_min_max": (
        "SELECT ?p (MIN(?d) AS ?lo) (MAX(?t) AS ?hi) WHERE { ?o p:o_orderpriority ?p ; p:o_orderdate ?d ; p:o_totalprice ?t } GROUP BY ?p",
        "SELECT o_orderpriority AS p, min(o_orderdate) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY 1",
    ),
    "agg_sample": (
        "SELECT ?r (SAMPLE(?n) AS ?any) WHERE { ?x p:n_regionkey ?r ; p:n_name ?n } GROUP BY ?r",
        "SELECT n_regionkey::BIGINT AS r, min(n_name) AS any FROM nation GROUP BY 1",
    ),
    "group_concat": (
        "SELECT ?r (GROUP_CONCAT(DISTINCT ?n; SEPARATOR=\"|\") AS ?all) WHERE { ?x p:n_regionkey ?r ; p:n_name ?n } GROUP BY ?r",
        "SELECT n_regionkey::BIGINT AS r, string_agg(DISTINCT n_name, '|' ORDER BY n_name) AS \"all\" FROM nation GROUP BY 1",
    ),
    "having": (
        "SELECT ?c (COUNT(*) AS ?n) WHERE { ?o p:o_custkey ?c ; p:o_totalprice ?t } GROUP BY ?c HAVING(COUNT(*) > 12 && MAX(?t) > 300000)",
        "SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12 AND max(o_totalprice) > 300000",
    ),
    "agg_empty": (
        "SELECT (COUNT(*) AS ?n) (SUM(?k) AS ?s) (xsd:double(AVG(?k)) AS ?a) (MIN(?k) AS ?m) WHERE { ?x p:n_nationkey ?k FILTER(?k > 1000) }",
        "SELECT 0::BIGINT AS n, 0::BIGINT AS s, 0::DOUBLE AS a, NULL::BIGINT AS m",
    ),
    "agg_poisoned": (
        "SELECT ?m (SUM(?v) AS ?s) WHERE { ?c p:c_mktsegment ?m ; p:c_custkey ?k BIND(IF(?m = \"BUILDING\", ?k, xsd:integer(?m)) AS ?v) } GROUP BY ?m",
        "SELECT c_mktsegment AS m, CASE WHEN c_mktsegment = 'BUILDING' THEN sum(c_custkey)::BIGINT END AS s FROM customer GROUP BY 1",
    ),
    "group_unbound": (
        "SELECT ?b (COUNT(*) AS ?n) WHERE { ?c p:c_custkey ?k OPTIONAL { ?o p:o_custkey:ref ?c ; p:o_orderstatus ?b FILTER(?b = \"P\") } } GROUP BY ?b",
        "SELECT o_orderstatus AS b, count(*) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY 1",
    ),
    "group_expression": (
        "SELECT ?y (COUNT(*) AS ?n) WHERE { ?o p:o_orderdate ?d } GROUP BY (YEAR(?d) AS ?y)",
        "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1",
    ),
    # modifiers
    "order_limit": (
        "SELECT ?key ?t WHERE { ?o p:o_orderkey ?key ; p:o_totalprice ?t } ORDER BY DESC(?t) ?key LIMIT 20",
        "SELECT o_orderkey AS key, o_totalprice AS t FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    ),
    "offset": (
        "SELECT ?key WHERE { ?o p:o_orderkey ?key } ORDER BY ?key LIMIT 25 OFFSET 40",
        "SELECT o_orderkey AS key FROM orders ORDER BY 1 LIMIT 25 OFFSET 40",
    ),
    "distinct": (
        "SELECT DISTINCT ?f ?s WHERE { ?l p:l_returnflag ?f ; p:l_linestatus ?s }",
        "SELECT DISTINCT l_returnflag AS f, l_linestatus AS s FROM lineitem",
    ),
    "reduced": (
        "SELECT REDUCED ?f WHERE { ?l p:l_returnflag ?f }",
        "SELECT l_returnflag AS f FROM lineitem",
    ),
    "topk": (
        "SELECT ?name (ROUND(SUM(?t)) AS ?spent) WHERE { ?o p:o_custkey:ref ?c ; p:o_totalprice ?t . ?c p:c_name ?name } GROUP BY ?name ORDER BY DESC(?spent) ?name LIMIT 10",
        "SELECT c_name AS name, floor(sum(o_totalprice) + 0.5) AS spent FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    ),
    "subquery_limit": (
        "SELECT ?name ?t WHERE { { SELECT ?c ?t WHERE { ?o p:o_custkey:ref ?c ; p:o_orderkey ?k ; p:o_totalprice ?t } ORDER BY DESC(?t) ?k LIMIT 15 } ?c p:c_name ?name }",
        "SELECT c_name AS name, t FROM (SELECT o_custkey, o_totalprice AS t FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15) JOIN customer ON c_custkey = o_custkey",
    ),
    "lateral": (
        "SELECT ?n ?key ?b WHERE { ?x p:n_nationkey ?n LATERAL { SELECT * WHERE { ?c p:c_nationkey:ref ?x ; p:c_custkey ?key ; p:c_acctbal ?b } ORDER BY DESC(?b) ?key LIMIT 2 } }",
        "SELECT n_nationkey::BIGINT AS n, c_custkey AS key, c_acctbal AS b FROM nation, LATERAL (SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey = n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 2)",
    ),
    # paths
    "path_seq": (
        "SELECT ?key ?region WHERE { ?c p:c_custkey ?key ; p:c_nationkey:ref/p:n_regionkey:ref/p:r_name ?region }",
        "SELECT c_custkey AS key, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    ),
    "path_alt": (
        "SELECT ?x ?n WHERE { ?x p:c_nationkey:ref|p:s_nationkey:ref ?n }",
        "SELECT 'urn:customer:' || c_custkey AS x, 'urn:nation:' || c_nationkey AS n FROM customer UNION ALL SELECT 'urn:supplier:' || s_suppkey, 'urn:nation:' || s_nationkey FROM supplier",
    ),
    "path_inv": (
        "SELECT ?name ?key WHERE { ?n p:n_name ?name ; ^p:s_nationkey:ref/p:s_suppkey ?key }",
        "SELECT n_name AS name, s_suppkey AS key FROM nation JOIN supplier ON s_nationkey = n_nationkey",
    ),
    "path_star": (
        "SELECT ?x WHERE { <urn:customer:7> (p:c_nationkey:ref|p:n_regionkey:ref)* ?x }",
        "SELECT 'urn:customer:7' AS x UNION ALL SELECT 'urn:nation:' || c_nationkey FROM customer WHERE c_custkey = 7 UNION ALL SELECT 'urn:region:' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 7",
    ),
    "path_plus": (
        "SELECT ?c ?x WHERE { ?c (p:c_nationkey:ref|p:n_regionkey:ref)+ ?x }",
        "SELECT 'urn:customer:' || c_custkey AS c, 'urn:nation:' || c_nationkey AS x FROM customer UNION SELECT 'urn:nation:' || n_nationkey, 'urn:region:' || n_regionkey FROM nation"
        " UNION SELECT 'urn:customer:' || c_custkey, 'urn:region:' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey",
    ),
    "path_plus_inverse": (
        "SELECT ?x WHERE { ?x (p:o_custkey:ref|p:c_nationkey:ref|p:n_regionkey:ref)+ <urn:region:2> }",
        "WITH n AS (SELECT n_nationkey FROM nation WHERE n_regionkey = 2), c AS (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT * FROM n))"
        " SELECT 'urn:nation:' || n_nationkey AS x FROM n UNION ALL SELECT 'urn:customer:' || c_custkey FROM c UNION ALL SELECT 'urn:order:' || o_orderkey FROM orders WHERE false UNION ALL SELECT 'urn:orders:' || o_orderkey FROM orders WHERE o_custkey IN (SELECT * FROM c)",
    ),
    "path_opt": (
        "SELECT ?x WHERE { <urn:nation:4> p:n_regionkey:ref? ?x }",
        "SELECT 'urn:nation:4' AS x UNION ALL SELECT 'urn:region:' || n_regionkey FROM nation WHERE n_nationkey = 4",
    ),
    "path_neg": (
        "SELECT ?s ?o WHERE { GRAPH g:region { ?s !(p:r_regionkey|<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>) ?o } }",
        "SELECT 'urn:region:' || r_regionkey AS s, r_name AS o FROM region",
    ),
    # forms
    "ask": ("ASK { ?n p:n_name \"NATION_3\" ; p:n_regionkey ?r FILTER(?r < 9) }", "SELECT count(*) > 0 AS ask FROM nation WHERE n_name = 'NATION_3' AND n_regionkey < 9"),
    "ask_empty_pattern": ("ASK {}", "SELECT true AS ask"),
    "construct": (
        "CONSTRUCT { ?n <urn:in> ?r . ?r <urn:named> ?name } WHERE { ?n p:n_regionkey:ref ?r . ?r p:r_name ?name }",
        "SELECT '<urn:nation:' || n_nationkey || '>' AS subject, '<urn:in>' AS predicate, '<urn:region:' || n_regionkey || '>' AS object FROM nation UNION"
        " SELECT '<urn:region:' || r_regionkey || '>', '<urn:named>', '\"' || r_name || '\"' FROM region JOIN nation ON n_regionkey = r_regionkey",
    ),
    "describe": (
        "DESCRIBE ?n WHERE { ?n p:n_nationkey 3 }",
        "WITH t AS (SELECT * FROM nation WHERE n_nationkey = 3), i AS (SELECT '^^<http://www.w3.org/2001/XMLSchema#integer>' i) SELECT '<urn:nation:3>' AS subject, '<urn:p:n_nationkey>' AS predicate, '\"3\"' || i AS object FROM i UNION ALL"
        " SELECT '<urn:nation:3>', '<urn:p:n_name>', '\"' || n_name || '\"' FROM t UNION ALL SELECT '<urn:nation:3>', '<urn:p:n_regionkey>', '\"' || n_regionkey || '\"' || i FROM t, i UNION ALL"
        " SELECT '<urn:nation:3>', '<urn:p:n_regionkey:ref>', '<urn:region:' || n_regionkey || '>' FROM t UNION ALL SELECT '<urn:nation:3>', '<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>', '<urn:c:nation>'",
    ),
    # functions
    "fn_string": (
        "SELECT ?key ?a ?b ?d ?e ?f ?h ?i ?j WHERE { ?c p:c_custkey ?key ; p:c_name ?n ; p:c_mktsegment ?m BIND(STRLEN(?n) AS ?a) BIND(SUBSTR(?n, 3, 5) AS ?b) BIND(LCASE(?m) AS ?d)"
        " BIND(STRBEFORE(?n, \"#\") AS ?e) BIND(STRAFTER(?n, \"#\") AS ?f) BIND(CONCAT(?m, \"-\", STR(?key)) AS ?h) BIND(REPLACE(?n, \"0+\", \"_\") AS ?i) BIND(ENCODE_FOR_URI(CONCAT(?n, \" ~*\")) AS ?j) }",
        "SELECT c_custkey AS key, length(c_name) AS a, substr(c_name, 3, 5) AS b, lower(c_mktsegment) AS d, split_part(c_name, '#', 1) AS e, split_part(c_name, '#', 2) AS f,"
        " c_mktsegment || '-' || c_custkey AS h, regexp_replace(c_name, '0+', '_', 'g') AS i, replace(c_name, '#', '%23') || '%20~%2A' AS j FROM customer",
    ),
    "fn_string_tests": (
        "SELECT ?key ?a ?b ?d ?e WHERE { ?c p:c_custkey ?key ; p:c_name ?n ; p:c_mktsegment ?m BIND(STRSTARTS(?m, \"B\") AS ?a) BIND(STRENDS(?m, \"Y\") AS ?b) BIND(CONTAINS(?n, \"11\") AS ?d) BIND(UCASE(SUBSTR(?n, 0, 3)) AS ?e) }",
        "SELECT c_custkey AS key, starts_with(c_mktsegment, 'B') AS a, ends_with(c_mktsegment, 'Y') AS b, contains(c_name, '11') AS d, upper(substr(c_name, 1, 2)) AS e FROM customer",
    ),
    "fn_numeric": (
        "SELECT ?key ?a ?b ?d ?e WHERE { ?c p:c_custkey ?key ; p:c_acctbal ?x BIND(ABS(?x) AS ?a) BIND(CEIL(?x) AS ?b) BIND(FLOOR(?x) AS ?d) BIND(ROUND(?x) AS ?e) }",
        "SELECT c_custkey AS key, abs(c_acctbal) AS a, ceil(c_acctbal) AS b, floor(c_acctbal) AS d, floor(c_acctbal + 0.5) AS e FROM customer",
    ),
    "fn_date": (
        "SELECT ?key ?y ?m ?d ?h ?i WHERE { ?o p:event_id ?key ; p:ts ?t BIND(YEAR(?t) AS ?y) BIND(MONTH(?t) AS ?m) BIND(DAY(?t) AS ?d) BIND(HOURS(?t) AS ?h) BIND(MINUTES(?t) AS ?i) }",
        "SELECT event_id AS key, year(ts) AS y, month(ts) AS m, day(ts) AS d, hour(ts) AS h, minute(ts) AS i FROM events",
    ),
    "fn_date_zone": (
        "SELECT ?h ?z ?tz WHERE { VALUES ?t { \"2024-05-01T22:10:05+02:00\"^^xsd:dateTime \"2024-05-01T22:10:05Z\"^^xsd:dateTime } BIND(HOURS(?t) AS ?h) BIND(TZ(?t) AS ?z) BIND(STR(TIMEZONE(?t)) AS ?tz) }",
        "SELECT * FROM (VALUES (22::BIGINT, '+02:00', 'PT2H'), (22, 'Z', 'PT0S')) v(h, z, tz)",
    ),
    "fn_hash": (
        "SELECT ?key ?a ?b ?d WHERE { ?c p:c_custkey ?key ; p:c_name ?n BIND(MD5(?n) AS ?a) BIND(SHA1(?n) AS ?b) BIND(SHA256(?n) AS ?d) }",
        "SELECT c_custkey AS key, md5(c_name) AS a, sha1(c_name) AS b, sha256(c_name) AS d FROM customer",
    ),
    "fn_term": (
        "SELECT ?k ?a ?b ?d ?e ?f WHERE { ?n p:n_nationkey ?k ; p:n_name ?name BIND(isIRI(?n) AS ?a) BIND(isLITERAL(?name) AS ?b) BIND(isNUMERIC(?k) AS ?d) BIND(STR(DATATYPE(?k)) AS ?e) BIND(sameTerm(?n, IRI(CONCAT(\"urn:nation:\", STR(?k)))) AS ?f) }",
        "SELECT n_nationkey::BIGINT AS k, true AS a, true AS b, true AS d, 'http://www.w3.org/2001/XMLSchema#integer' AS e, true AS f FROM nation",
    ),
    "fn_lang": (
        "SELECT ?l ?m ?d ?s WHERE { VALUES ?x { \"chat\"@fr \"cat\"@en-GB \"cat\" } BIND(LANG(?x) AS ?l) BIND(LANGMATCHES(LANG(?x), \"en\") AS ?m) BIND(STR(DATATYPE(?x)) AS ?d) BIND(STR(UCASE(?x)) AS ?s) }",
        "SELECT * FROM (VALUES ('fr', false, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#langString', 'CHAT'), ('en-gb', true, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#langString', 'CAT'), ('', false, 'http://www.w3.org/2001/XMLSchema#string', 'CAT')) v(l, m, d, s)",
    ),
    "fn_cast": (
        "SELECT ?x ?b ?i ?d ?s WHERE { VALUES ?x { \"1\" \"true\" \"yes\" \"2.50\" \"abc\" } BIND(xsd:boolean(?x) AS ?b) BIND(xsd:integer(?x) AS ?i) BIND(xsd:double(?x) AS ?d) BIND(xsd:string(xsd:double(?x)) AS ?s) }",
        "SELECT * FROM (VALUES ('1', true, 1::BIGINT, 1::DOUBLE, '1.0E0'), ('true', true, NULL, NULL, NULL), ('yes', NULL, NULL, NULL, NULL), ('2.50', NULL, NULL, 2.5, '2.5E0'), ('abc', NULL, NULL, NULL, NULL)) v(x, b, i, d, s)",
    ),
    "fn_numeric_extreme": (
        "SELECT ?k ?a ?b WHERE { VALUES (?k ?x) { (1 1.5e20) (2 9007199254740993) (3 \"INF\"^^xsd:double) (4 2.5) (5 -2.5) (6 -9007199254740993) } BIND(STR(CEIL(?x)) AS ?a) BIND(STR(FLOOR(?x)) AS ?b) }",
        "SELECT * FROM (VALUES (1::BIGINT, '1.5E20', '1.5E20'), (2, '9007199254740993', '9007199254740993'), (3, 'INF', 'INF'), (4, '3', '2'), (5, '-2', '-3'), (6, '-9007199254740993', '-9007199254740993')) v(k, a, b)",
    ),
    "fn_round_extreme": (
        "SELECT ?k ?a ?b WHERE { VALUES (?k ?x) { (1 1.5e20) (2 9007199254740993) (3 \"INF\"^^xsd:double) (4 2.5) (5 -2.5) (6 -9007199254740993) } BIND(STR(ROUND(?x)) AS ?a) BIND(STR(ABS(?x)) AS ?b) }",
        "SELECT * FROM (VALUES (1::BIGINT, '1.5E20', '1.5E20'), (2, '9007199254740993', '9007199254740993'), (3, 'INF', 'INF'), (4, '3', '2.5'), (5, '-2', '2.5'), (6, '-9007199254740993', '9007199254740993')) v(k, a, b)",
    ),
    "fn_round_wide": (
        "SELECT ?key ?a ?b WHERE { ?c p:c_custkey ?key ; p:c_acctbal ?x BIND(ROUND(?key * 6000000000000001) AS ?a) BIND(CEIL(?x * 1.0e20) > 9.3e18 AS ?b) }",
        "SELECT c_custkey AS key, c_custkey * 6000000000000001 AS a, c_acctbal * 1e20 > 9.3e18 AS b FROM customer",
    ),
    "div_wide": (
        "SELECT ?key ?a ?b WHERE { ?c p:c_custkey ?key BIND(xsd:integer(?key * 1000000000000000 / 7) AS ?a) BIND(xsd:integer(1000000000000 * (0.0000001 / ?key)) AS ?b) }",
        "SELECT c_custkey AS key, (c_custkey * 1000000000000000) // 7 AS a, CASE WHEN c_custkey <> 0 THEN floor(100000 / c_custkey + 0.5)::BIGINT END AS b FROM customer",
    ),
    "agg_small_decimal": (
        "SELECT ?m (xsd:integer(ROUND(AVG(?x) * 1000000000000)) AS ?a) WHERE { ?c p:c_custkey ?key ; p:c_mktsegment ?m BIND(?key * 0.0000000001 AS ?x) } GROUP BY ?m",
        "SELECT c_mktsegment AS m, floor(avg(c_custkey) * 100 + 0.5)::BIGINT AS a FROM customer GROUP BY 1",
    ),
    "sum_overflow": (
        "SELECT ?s (SUM(?x) AS ?total) (COUNT(?x) AS ?n) (xsd:integer(AVG(?x)) AS ?mean) WHERE { ?o p:o_orderkey ?key ; p:o_orderstatus ?s BIND(?key * 0 + 9223372036854775000 AS ?x) } GROUP BY ?s",
        "SELECT o_orderstatus AS s, NULL::BIGINT AS total, count(*) AS n, 9223372036854775000 AS mean FROM orders GROUP BY 1",
    ),
    "regex_error": (
        "SELECT ?k WHERE { ?n p:n_nationkey ?k ; p:n_name ?name FILTER(REGEX(?name, \"([\") || ?k < 5) }",
        "SELECT n_nationkey::BIGINT AS k FROM nation WHERE n_nationkey < 5",
    ),
    "regex_by_row": (
        "SELECT ?k ?p WHERE { ?n p:n_nationkey ?k ; p:n_name ?name VALUES ?p { \"^NATION_1\" \"([\" \"0$\" } FILTER(REGEX(?name, ?p)) }",
        "SELECT n_nationkey::BIGINT AS k, p FROM nation, (VALUES ('^NATION_1'), ('0$')) v(p) WHERE regexp_matches(n_name, p)",
    ),
    "fn_bound": (
        "SELECT ?key ?a ?b WHERE { ?c p:c_custkey ?key OPTIONAL { ?c p:c_acctbal ?x FILTER(?x < 0) } BIND(BOUND(?x) AS ?a) BIND(BOUND(?none) AS ?b) }",
        "SELECT c_custkey AS key, c_acctbal < 0 AS a, false AS b FROM customer",
    ),
    "fn_iri_base": (
        "BASE <http://x.y/a/b/c?q> SELECT ?r ?i WHERE { VALUES ?r { \"d\" \"../d\" \"../../../d\" \"/e/./f\" \"?z\" \"#s\" \"\" \"//h/p\" \"urn:u\" \".\" \"g/..\" } BIND(STR(IRI(?r)) AS ?i) }",
        "SELECT * FROM (VALUES ('d', 'http://x.y/a/b/d'), ('../d', 'http://x.y/a/d'), ('../../../d', 'http://x.y/d'), ('/e/./f', 'http://x.y/e/f'), ('?z', 'http://x.y/a/b/c?z'), ('#s', 'http://x.y/a/b/c?q#s'), ('', 'http://x.y/a/b/c?q'), ('//h/p', 'http://h/p'), ('urn:u', 'urn:u'), ('.', 'http://x.y/a/b/'), ('g/..', 'http://x.y/a/b/')) v(r, i)",
    ),
    "fn_blank_typed": (
        "SELECT ?k ?a ?b ?d ?e ?f WHERE { ?n p:n_nationkey ?k ; p:n_name ?name BIND(isBLANK(BNODE()) AS ?a) BIND(BNODE(?name) = BNODE(?name) AS ?b) BIND(STRDT(STR(?k), xsd:integer) + 1 AS ?d) BIND(LANG(STRLANG(?name, \"EN\")) AS ?e) BIND(sameTerm(STRDT(\"a\", xsd:string), \"a\") AS ?f) }",
        "SELECT n_nationkey::BIGINT AS k, true AS a, true AS b, (n_nationkey + 1)::VARCHAR AS d, 'en' AS e, true AS f FROM nation",
    ),
    "fn_volatile": (
        "SELECT ?k ?a ?b ?d ?e WHERE { ?n p:n_nationkey ?k BIND(STRLEN(STRUUID()) AS ?a) BIND(STRSTARTS(STR(UUID()), \"urn:uuid:\") AS ?b) BIND(RAND() < 1 AS ?d) BIND(YEAR(NOW()) > 2020 AS ?e) }",
        "SELECT n_nationkey::BIGINT AS k, 36::BIGINT AS a, true AS b, true AS d, true AS e FROM nation",
    ),
    "fn_hash_long": (
        "SELECT ?x ?a ?b WHERE { VALUES ?x { \"abc\" \"\" } BIND(SHA384(?x) AS ?a) BIND(SHA512(?x) AS ?b) }",
        "SELECT * FROM (VALUES " + ", ".join(f"('{x}', '{hashlib.sha384(x.encode()).hexdigest()}', '{hashlib.sha512(x.encode()).hexdigest()}')" for x in ("abc", "")) + ") v(x, a, b)",
    ),
    "fn_cast_more": (
        "SELECT ?key ?a ?b ?d ?e ?f WHERE { ?o p:event_id ?key ; p:ts ?t ; p:value ?v BIND(SECONDS(?t) > 30 AS ?a) BIND(STR(xsd:date(?t)) AS ?b) BIND(xsd:dateTime(STR(?t)) = ?t AS ?d) BIND(xsd:integer(xsd:decimal(STR(?key)) * 2.5) AS ?e) BIND(xsd:float(STR(?key)) AS ?f) }",
        "SELECT event_id AS key, epoch_ms(ts) % 60000 > 30000 OR (second(ts) = 30 AND microsecond(ts) > 30000000) AS a, strftime(ts, '%Y-%m-%d') AS b, true AS d, trunc(event_id * 2.5)::BIGINT AS e, event_id::DOUBLE AS f FROM events",
    ),
    "agg_distinct_star": (
        "SELECT ?f (COUNT(DISTINCT *) AS ?n) WHERE { SELECT ?f ?s WHERE { ?l p:l_returnflag ?f ; p:l_linestatus ?s } } GROUP BY ?f",
        "SELECT l_returnflag AS f, count(DISTINCT l_linestatus) AS n FROM lineitem GROUP BY 1",
    ),
    "agg_per_graph": (
        "SELECT ?g (COUNT(*) AS ?n) WHERE { GRAPH ?g { SELECT (COUNT(?x) AS ?m) WHERE { ?x a ?t } } } GROUP BY ?g",
        "SELECT * FROM (VALUES " + ", ".join(f"('urn:g:{t}', 1::BIGINT)" for t in "region nation customer supplier part orders lineitem events documents embeddings".split()) + ") v(g, n)",
    ),
    "union_default_overlap": (
        "SELECT ?s ?o WHERE { ?s p:n_regionkey:ref ?o }",
        "SELECT DISTINCT 'urn:nation:' || n_nationkey AS s, 'urn:region:' || n_regionkey AS o FROM nation",
    ),
    "path_zero_absent": (
        "SELECT ?x WHERE { <urn:nowhere:1> (p:c_nationkey:ref|p:n_regionkey:ref)* ?x }",
        "SELECT 'urn:nowhere:1' AS x",
    ),
    "path_in_graph": (
        "SELECT ?x WHERE { GRAPH g:nation { <urn:nation:4> (p:c_nationkey:ref|p:n_regionkey:ref)+ ?x } }",
        "SELECT 'urn:region:' || n_regionkey AS x FROM nation WHERE n_nationkey = 4",
    ),
    # larger ones
    "tpch_q1": (
        "SELECT ?f ?s (ROUND(SUM(?q)) AS ?sum_qty) (ROUND(SUM(?e)) AS ?sum_base) (ROUND(SUM(?e * (1 - ?d))) AS ?sum_disc) (COUNT(*) AS ?n) WHERE { ?l p:l_returnflag ?f ; p:l_linestatus ?s ; p:l_quantity ?q ; p:l_extendedprice ?e ; p:l_discount ?d ; p:l_shipdate ?t FILTER(?t <= \"1998-09-02T00:00:00\"^^xsd:dateTime) } GROUP BY ?f ?s",
        "SELECT l_returnflag AS f, l_linestatus AS s, floor(sum(l_quantity) + 0.5) AS sum_qty, floor(sum(l_extendedprice) + 0.5) AS sum_base, floor(sum(l_extendedprice * (1 - l_discount)) + 0.5) AS sum_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
    ),
    "tpch_q3": (
        "SELECT ?key (ROUND(SUM(?e * (1 - ?d))) AS ?revenue) ?date WHERE { ?c p:c_mktsegment \"BUILDING\" . ?o p:o_custkey:ref ?c ; p:o_orderkey ?key ; p:o_orderdate ?date . ?l p:l_orderkey:ref ?o ; p:l_extendedprice ?e ; p:l_discount ?d ; p:l_shipdate ?t FILTER(?date < \"1995-03-15T00:00:00\"^^xsd:dateTime && ?t > \"1995-03-15T00:00:00\"^^xsd:dateTime) } GROUP BY ?key ?date ORDER BY DESC(?revenue) ?key LIMIT 10",
        "SELECT o_orderkey AS key, floor(sum(l_extendedprice * (1 - l_discount)) + 0.5) AS revenue, o_orderdate AS date FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1995-03-15' AND l_shipdate > TIMESTAMP '1995-03-15' GROUP BY 1, 3 ORDER BY 2 DESC, 1 LIMIT 10",
    ),
    "tpch_q5": (
        "SELECT ?nation (ROUND(SUM(?e * (1 - ?d))) AS ?revenue) WHERE { ?o p:o_custkey:ref ?c . ?c p:c_nationkey:ref ?n . ?l p:l_orderkey:ref ?o ; p:l_suppkey:ref ?s ; p:l_extendedprice ?e ; p:l_discount ?d . ?s p:s_nationkey:ref ?n . ?n p:n_name ?nation ; p:n_regionkey:ref/p:r_name \"ASIA\" } GROUP BY ?nation",
        "SELECT n_name AS nation, floor(sum(l_extendedprice * (1 - l_discount)) + 0.5) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA' GROUP BY 1",
    ),
    "tpch_q6": (
        "SELECT (ROUND(SUM(?e * ?d)) AS ?revenue) WHERE { ?l p:l_extendedprice ?e ; p:l_discount ?d ; p:l_quantity ?q ; p:l_shipdate ?t FILTER(?q < 24 && ?d >= 0.05 && ?d <= 0.07 && YEAR(?t) = 1994) }",
        "SELECT coalesce(floor(sum(l_extendedprice * l_discount) + 0.5), 0) AS revenue FROM lineitem WHERE l_quantity < 24 AND l_discount >= 0.05 AND l_discount <= 0.07 AND year(l_shipdate) = 1994",
    ),
}


def _query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: engine(spark, d).query(PREFIXES + text, ALL)


def auth_filtered(spark: SparkSession, d: str) -> DataFrame:
    """A principal without the label of supplier doesn't see it in the default graph."""
    return engine(spark, d).query(PREFIXES + "SELECT ?t (COUNT(*) AS ?n) WHERE { ?s a ?t FILTER(?t IN (c:nation, c:supplier)) } GROUP BY ?t")


def service_join(spark: SparkSession, d: str) -> DataFrame:
    """A SERVICE inside OPTIONAL, and a silent one that isn't allowed."""
    own = engine(spark, d)
    own.services = {"urn:endpoint:tables": engine(spark, d)}
    return own.query(PREFIXES + "SELECT ?r ?n WHERE { ?x p:r_name ?r OPTIONAL { SERVICE <urn:endpoint:tables> { SELECT ?x (COUNT(*) AS ?n) WHERE { ?y p:n_regionkey:ref ?x } GROUP BY ?x } } SERVICE SILENT <urn:endpoint:none> { ?q p:none ?w } }", ALL)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _query(q) for name, (q, _) in CATALOGUE.items()} | {"auth_filtered": auth_filtered, "service_join": service_join}

SQL: dict[str, str] = {name: sql for name, (_, sql) in CATALOGUE.items()} | {
    "auth_filtered": "SELECT 'urn:c:nation' AS t, count(*) AS n FROM nation",
    "service_join": "SELECT r_name AS r, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1",
}
