"""Queries of the general data-processing operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import drift, features, hierarchy, intervals, references
from graphloom.session import checkpoint, table


# 1: schemas that drift


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    files = drift.sorted_files(table(spark, d, "verification_record"))
    return drift.changes(files).select("component", "phase_no", "old_path", "new_path", F.col("op").alias("change_kind"))


def p1_scripts(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(drift.sorted_files(table(spark, d, "verification_record")), paths=False)


def p1_checks(spark: SparkSession, d: str) -> DataFrame:
    files = drift.sorted_files(table(spark, d, "verification_record"))
    found = drift.compare(files)
    return drift.consistent_table(files, drift.field_names(found), value="check_value", first=drift.first_names(found.edits))


def p1_complete(spark: SparkSession, d: str) -> DataFrame:
    """How many values each check has in the consistent table, wherever its members went."""
    checks = p1_checks(spark, d)
    values = [c for c in checks.columns if c not in ("component", "phase_no", "check_name", "check_value", "first_name")]
    filled = sum((F.col(f"`{c}`").isNotNull().cast("bigint") for c in values), F.lit(0).cast("bigint"))
    return checks.select("component", "phase_no", "check_name", filled.alias("n_values"), F.col("check_value").isNotNull().alias("plain"))


# 2: intervals


def _calls(spark: SparkSession, d: str) -> DataFrame:
    c = ["execution_id", "started_at_epoch_ms", "ended_at_epoch_ms"]
    return table(spark, d, "model_call").select(*c).unionByName(table(spark, d, "tool_call").select(*c))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    out = intervals.gaps(_calls(spark, d), "execution_id", "started_at_epoch_ms", "ended_at_epoch_ms")
    return out.withColumnsRenamed({"entity": "execution_id", "gap_start": "gap_start_epoch_ms", "gap_end": "gap_end_epoch_ms"})


def p2_periods(spark: SparkSession, d: str) -> DataFrame:
    out = intervals.periods(_calls(spark, d), "execution_id", "started_at_epoch_ms", "ended_at_epoch_ms")
    return out.withColumnsRenamed({"entity": "execution_id", "period_start": "period_start_epoch_ms", "period_end": "period_end_epoch_ms"})


# 3: hierarchies


def _memories(spark: SparkSession, d: str) -> hierarchy.Resolved:
    """All links of both types; a memory with one of each, or several of one, keeps them all."""
    edges = table(spark, d, "agent_memory_edge").where(F.lower(F.trim("edge_type")).isin("supersedes", "derived_from"))
    return hierarchy.resolve(hierarchy.links(edges, F.lower("source_memory_id"), F.lower("target_memory_id"), "tenant_id", "created_at_epoch_ms"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.cycles(_memories(spark, d)).withColumnRenamed("node", "memory_id")


def p3_paths(spark: SparkSession, d: str) -> DataFrame:
    out = hierarchy.nodes(_memories(spark, d)).withColumn("path", F.array_join("path", "/"))
    return out.withColumnsRenamed({"node": "memory_id", "root": "root_id"})


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(_memories(spark, d))


# 4: features


def _model_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls sent twice count once, in their last state; outcomes are compared in upper case without blanks, a token count below 0 is none."""
    keep = ["execution_id", "model_id", "outcome", "error_code", "input_tokens", "output_tokens", "started_at_epoch_ms"]
    calls = features.latest_state(table(spark, d, "model_call"), "model_call_id", [F.col("loaded_at"), F.col("ended_at_epoch_ms")], keep)
    tokens = {c: F.when(F.col(c) >= 0, F.col(c)) for c in ("input_tokens", "output_tokens")}
    return calls.withColumns(tokens)


def _outcome():
    return F.coalesce(F.nullif(F.upper(F.trim("outcome")), F.lit("")), F.lit("OPEN"))


def _model_features(spark: SparkSession, d: str) -> DataFrame:
    """Kinds are a model with an outcome, and an error: the hundreds that a wide table is made for."""
    calls = _model_calls(spark, d)
    by_model = F.concat_ws("|", F.coalesce("model_id", F.lit("none")), _outcome())
    by_error = F.when(F.col("error_code").isNotNull(), F.concat(F.lit("error|"), "error_code"))
    codes = features.kind_codes(table(spark, d, "model_call"), [by_model, by_error])
    return features.sparse_features(calls, "execution_id", [by_model, by_error], "started_at_epoch_ms", ["input_tokens", "output_tokens"], codes)


def p4_features(spark: SparkSession, d: str) -> DataFrame:
    return features.wide_features(checkpoint(_model_features(spark, d)), "execution_id")


def p4_vectors(spark: SparkSession, d: str) -> DataFrame:
    return _model_features(spark, d).withColumnRenamed("last", "last_started_ms")


def p4_kinds(spark: SparkSession, d: str) -> DataFrame:
    """The vectors with a kind for each model, outcome and error together."""
    calls = _model_calls(spark, d)
    kind = F.concat_ws("|", F.coalesce("model_id", F.lit("none")), _outcome(), F.coalesce("error_code", F.lit("none")))
    codes = features.kind_codes(table(spark, d, "model_call"), [kind])
    out = features.sparse_features(calls, "execution_id", [kind], "started_at_epoch_ms", ["input_tokens", "output_tokens"], codes)
    return out.withColumnRenamed("last", "last_started_ms")


# 6: references

CLAIM = references.Reference("claim_validation", "query_execution_id", "query", "validation_id", "created_at_epoch_ms")
TOOL = [
    references.Reference("tool_call", "query_execution_id", "query", "tool_call_id", "started_at_epoch_ms"),
    references.Reference("tool_call", "approval_id", "approval", "tool_call_id", "started_at_epoch_ms"),
]


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    refs = references.reference_rows(table(spark, d, "tool_call"), TOOL).unionByName(references.reference_rows(table(spark, d, "claim_validation"), [CLAIM]))
    parents = references.parent_rows(table(spark, d, "query_execution_log"), "query", "query_execution_id").unionByName(references.parent_rows(table(spark, d, "approval"), "approval", "approval_id"))
    return references.classify(refs, parents)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ref_table", "ref_field", "row_id", "case_kind")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return references.per_period(_orphans(spark, d))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_scripts, p1_checks, p1_complete, p2_found, p2_periods, p3_found, p3_paths, p3_descendants, p4_features, p4_vectors, p4_kinds, p6_found, p6_report)}

_SPANS = """spans AS (
  SELECT execution_id e, started_at_epoch_ms s, ended_at_epoch_ms t FROM model_call UNION ALL
  SELECT execution_id, started_at_epoch_ms, ended_at_epoch_ms FROM tool_call),
seen AS (
  SELECT *, max(t) OVER (PARTITION BY e ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) before
  FROM spans WHERE e IS NOT NULL AND t >= s)"""

_LINKS = """links AS (
  SELECT lower(source_memory_id) child, min(lower(target_memory_id)) parent FROM agent_memory_edge
  WHERE lower(trim(edge_type)) IN ('supersedes', 'derived_from') AND source_memory_id <> '' AND target_memory_id <> '' GROUP BY 1)"""

_TREE = f"""{_LINKS}, roots AS (SELECT DISTINCT parent node FROM links WHERE parent NOT IN (SELECT child FROM links)),
tree(node, root, depth, path, up) AS (
  SELECT node, node, 0::BIGINT, node, [node] FROM roots
  UNION ALL SELECT l.child, t.root, t.depth + 1, t.path || '/' || l.child, list_append(t.up, l.child) FROM links l JOIN tree t ON l.parent = t.node)"""

_CALLS = """calls AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model_call_id ORDER BY loaded_at DESC NULLS LAST, ended_at_epoch_ms DESC NULLS LAST,
    execution_id DESC NULLS LAST, model_id DESC NULLS LAST, outcome DESC NULLS LAST, error_code DESC NULLS LAST, input_tokens DESC NULLS LAST, output_tokens DESC NULLS LAST) rn
  FROM model_call WHERE model_call_id IS NOT NULL) WHERE rn = 1 AND execution_id IS NOT NULL),
marked AS (
  SELECT *, coalesce(model_id, 'none') || '|' || coalesce(nullif(upper(trim(outcome)), ''), 'OPEN') kind FROM calls
  UNION ALL SELECT *, 'error|' || error_code FROM calls WHERE error_code IS NOT NULL)"""

_UUID = "regexp_replace(regexp_replace(regexp_replace(lower(trim({c})), '^urn:uuid:', ''), '^[{{]|[}}]$', '', 'g'), '-', '', 'g')"
_Q, _A = _UUID.format(c="query_execution_id"), _UUID.format(c="approval_id")

_ORPHANS = f"""refs AS (
  SELECT 'tool_call' ref_table, 'query_execution_id' ref_field, 'query' kind, tenant_id, tool_call_id row_id, {_Q} k, started_at_epoch_ms at_ms, loaded_at FROM tool_call UNION ALL
  SELECT 'tool_call', 'approval_id', 'approval', tenant_id, tool_call_id, {_A}, started_at_epoch_ms, loaded_at FROM tool_call UNION ALL
  SELECT 'claim_validation', 'query_execution_id', 'query', tenant_id, validation_id, {_Q}, created_at_epoch_ms, loaded_at FROM claim_validation),
records AS (
  SELECT ref_table, ref_field, kind, tenant_id, row_id, max(k) k, min(at_ms) at_ms, min(loaded_at) loaded_at FROM refs GROUP BY ALL
  HAVING NOT regexp_matches(coalesce(max(k), ''), '^0*$')),
parents AS (
  SELECT kind, tenant_id, k, min(deleted_at_epoch_ms) deleted_ms, min(loaded_at) first_loaded FROM (
    SELECT 'query' kind, tenant_id, {_Q} k, deleted_at_epoch_ms, loaded_at FROM query_execution_log UNION ALL
    SELECT 'approval', tenant_id, {_A}, deleted_at_epoch_ms, loaded_at FROM approval) GROUP BY ALL),
cases AS (
  SELECT r.*, CASE WHEN p.k IS NULL THEN 'missing' WHEN p.deleted_ms <= r.at_ms THEN 'deleted' WHEN p.first_loaded > r.loaded_at THEN 'late' END case_kind
  FROM records r LEFT JOIN parents p USING (kind, tenant_id, k))"""

# values of a file by path: what lies inside an array is no value of its own
_FILES = r"""files AS (
  SELECT component, phase_no, body FROM (SELECT *, row_number() OVER (PARTITION BY component, phase_no ORDER BY record_id DESC) rn FROM verification_record
    WHERE component IS NOT NULL AND phase_no IS NOT NULL AND json_valid(body)) WHERE rn = 1 AND json_type(body) = 'OBJECT'),
numbered AS (SELECT component, phase_no, body, lag(phase_no) OVER (PARTITION BY component ORDER BY phase_no) before FROM files),
nodes AS (SELECT component, phase_no, t.id, t.type, t.fullkey, json_extract_string(body, t.fullkey) v FROM files, json_tree(body) t WHERE t.type <> 'OBJECT' AND NOT contains(t.path, '[')),
leaves AS (
  SELECT component, phase_no, id, regexp_replace(regexp_replace(substr(fullkey, 3), '"', '', 'g'), 'phase' || phase_no || '([^0-9]|$)', 'phaseN\1', 'g') path, v,
    CASE WHEN type = 'NULL' THEN 'null' WHEN type = 'VARCHAR' THEN 'string' WHEN type IN ('ARRAY', 'BOOLEAN') THEN lower(type) ELSE 'number' END kind FROM nodes WHERE NOT regexp_matches(fullkey, '\[[0-9]+\]$')),
old AS (SELECT l.*, n.phase_no to_no FROM leaves l JOIN numbered n ON l.component = n.component AND l.phase_no = n.before),
new AS (SELECT l.* FROM leaves l JOIN numbered n USING (component, phase_no) WHERE n.before IS NOT NULL),
gone AS (
  SELECT *, row_number() OVER (PARTITION BY component, to_no, home, alike, v ORDER BY id) k FROM (
    SELECT o.component, o.to_no, o.path, o.id, o.kind, o.v, regexp_replace(o.path, '[^.]*$', '') home, CASE WHEN o.kind IN ('string', 'number') THEN 'text' WHEN o.kind = 'null' THEN NULL ELSE o.kind END alike
    FROM old o ANTI JOIN new n ON o.component = n.component AND o.to_no = n.phase_no AND o.path = n.path)),
come AS (
  SELECT *, row_number() OVER (PARTITION BY component, phase_no, home, alike, v ORDER BY id) k FROM (
    SELECT n.component, n.phase_no, n.path, n.id, n.kind, n.v, regexp_replace(n.path, '[^.]*$', '') home, CASE WHEN n.kind IN ('string', 'number') THEN 'text' WHEN n.kind = 'null' THEN NULL ELSE n.kind END alike
    FROM new n ANTI JOIN old o ON o.component = n.component AND o.to_no = n.phase_no AND o.path = n.path)),
pairs AS (
  SELECT g.component, c.phase_no, g.path old_path, c.path new_path, g.kind a, c.kind b FROM gone g JOIN come c
  ON g.component = c.component AND g.to_no = c.phase_no AND g.home = c.home AND g.alike = c.alike AND g.v = c.v AND g.k = c.k)"""

SQL: dict[str, str] = {
    "p1_found": f"""WITH {_FILES}
SELECT component, phase_no, old_path, new_path, 'renamed' AS change_kind FROM pairs UNION ALL
SELECT component, phase_no, old_path, new_path, 'retyped' FROM pairs WHERE a <> b UNION ALL
SELECT o.component, n.phase_no, o.path, n.path, 'retyped' FROM old o JOIN new n ON o.component = n.component AND o.to_no = n.phase_no AND o.path = n.path WHERE o.kind <> n.kind AND 'null' NOT IN (o.kind, n.kind) UNION ALL
SELECT component, to_no, path, '', 'removed' FROM gone g WHERE NOT EXISTS (FROM pairs p WHERE p.component = g.component AND p.phase_no = g.to_no AND p.old_path = g.path) UNION ALL
SELECT component, phase_no, '', path, 'added' FROM come c WHERE NOT EXISTS (FROM pairs p WHERE p.component = c.component AND p.phase_no = c.phase_no AND p.new_path = c.path)""",
    "p1_complete": f"""WITH {_FILES}, checks AS (SELECT component, phase_no, c.key k, c.type, c.value v FROM files, json_each(body, '$.checks') c)
SELECT component, phase_no, regexp_replace(k, 'phase' || phase_no || '([^0-9]|$)', 'phaseN\\1', 'g') AS check_name,
  CASE WHEN type = 'OBJECT' THEN (SELECT count(*) FROM json_each(v) m WHERE m.type <> 'NULL') ELSE 0 END AS n_values, type <> 'OBJECT' AS plain FROM checks""",
    "p2_found": f"WITH {_SPANS} SELECT e AS execution_id, before AS gap_start_epoch_ms, s AS gap_end_epoch_ms FROM seen WHERE s > before",
    "p2_periods": f"""WITH {_SPANS}, marked AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY e ORDER BY s, t ROWS UNBOUNDED PRECEDING) island FROM seen)
SELECT e AS execution_id, min(s) AS period_start_epoch_ms, max(t) AS period_end_epoch_ms, count(*) AS n_spans FROM marked GROUP BY e, island""",
    "p3_found": f"""WITH RECURSIVE {_LINKS}, up(node, anc) AS (SELECT child, parent FROM links UNION SELECT u.node, l.parent FROM up u JOIN links l ON u.anc = l.child)
SELECT child AS memory_id, CASE WHEN child IN (SELECT node FROM up WHERE node = anc) THEN 'in_cycle' ELSE 'under_cycle' END AS case_kind
FROM links WHERE child IN (SELECT node FROM up WHERE anc IN (SELECT node FROM up WHERE node = anc))""",
    "p3_paths": f"WITH RECURSIVE {_TREE} SELECT node AS memory_id, root AS root_id, depth, path FROM tree",
    "p3_descendants": f"""WITH RECURSIVE {_TREE} SELECT a.anc AS ancestor, node AS descendant, (depth - a.i + 1)::BIGINT AS distance
FROM (SELECT node, depth, up, unnest(range(1, depth + 1)) i FROM tree) t, LATERAL (SELECT t.up[t.i] anc, t.i i) a""",
    "p4_features": f"""WITH {_CALLS}, named AS (SELECT execution_id, regexp_replace(kind, '[^0-9A-Za-z_]+', '_', 'g') kind, started_at_epoch_ms s, CASE WHEN input_tokens >= 0 THEN input_tokens END i, CASE WHEN output_tokens >= 0 THEN output_tokens END o FROM marked)
SELECT * FROM (PIVOT named ON kind USING count(*) AS _n, max(s) AS _last, sum(i)::BIGINT AS _total_input_tokens, sum(o)::BIGINT AS _total_output_tokens GROUP BY execution_id)""",
    "p4_vectors": f"""WITH {_CALLS} SELECT execution_id, kind, count(*) AS n, max(started_at_epoch_ms) AS last_started_ms,
sum(CASE WHEN input_tokens >= 0 THEN input_tokens END)::BIGINT AS total_input_tokens, sum(CASE WHEN output_tokens >= 0 THEN output_tokens END)::BIGINT AS total_output_tokens FROM marked GROUP BY 1, 2""",
    "p4_kinds": f"""WITH {_CALLS} SELECT execution_id, kind || '|' || coalesce(error_code, 'none') AS kind, count(*) AS n, max(started_at_epoch_ms) AS last_started_ms,
sum(CASE WHEN input_tokens >= 0 THEN input_tokens END)::BIGINT AS total_input_tokens, sum(CASE WHEN output_tokens >= 0 THEN output_tokens END)::BIGINT AS total_output_tokens FROM marked WHERE kind NOT LIKE 'error|%' GROUP BY 1, 2""",
    "p6_found": f"WITH {_ORPHANS} SELECT ref_table, ref_field, row_id, case_kind FROM cases WHERE case_kind IS NOT NULL",
    "p6_report": f"WITH {_ORPHANS} SELECT ref_table, ref_field, case_kind, strftime(make_timestamp(at_ms * 1000), '%Y-%m') AS period, count(*) AS n FROM cases WHERE case_kind IS NOT NULL GROUP BY ALL",
}
