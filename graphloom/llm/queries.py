"""Queries of the operators on texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import leaks, packing, quantiles, truncation
from graphloom.operators.features import latest_state
from graphloom.session import checkpoint, table

CAPACITY = 2048
QS = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


def _durations(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    """Observations sent twice count once; durations that are null or not above 0 are none; engines are compared in lower case without blanks."""
    rows = table(spark, d, "performance_observation")
    keep = ["observation_id", "scenarioid", "engine", "partition_no", "durationnanoseconds"]
    last = latest_state(rows, "observation_id", [F.col("loaded_at")], [*keep[1:], "observation_id"])
    return last.where("durationnanoseconds > 0").withColumn("engine", F.nullif(F.lower(F.trim("engine")), F.lit(""))), quantiles.blocks_for(rows.count())


def p5_percentiles(spark: SparkSession, d: str) -> DataFrame:
    keys = ["scenarioid", "engine"]
    rows, blocks = _durations(spark, d)
    return quantiles.percentiles(quantiles.summaries(rows, keys, "durationnanoseconds", F.col("observation_id"), blocks), keys, QS)


def p5_partitions(spark: SparkSession, d: str) -> DataFrame:
    """Each partition's own percentiles, and with a null partition_no those of all, made of the same summaries."""
    keys = ["scenarioid", "engine"]
    rows, blocks = _durations(spark, d)
    parts = checkpoint(quantiles.summaries(rows, [*keys, "partition_no"], "durationnanoseconds", F.col("observation_id"), blocks))
    own = quantiles.percentiles(parts, [*keys, "partition_no"], QS)
    together = quantiles.percentiles(quantiles.combine(parts, keys, "partition_no"), keys, QS)
    return own.unionByName(together.withColumn("partition_no", F.lit(None).cast("int")))


def p5_bounds(spark: SparkSession, d: str) -> DataFrame:
    """For each trial phase, from summaries of 128 tuples, whether the true ranks of all answers lie within the stated error."""
    raw = table(spark, d, "performance_observation")
    last = latest_state(raw, "observation_id", [F.col("loaded_at")], ["trialphase", "durationnanoseconds", "observation_id"])
    rows = checkpoint(last.where("durationnanoseconds > 0").select("trialphase", F.col("durationnanoseconds").alias("v"), "observation_id"))
    got = quantiles.percentiles(quantiles.summaries(rows, ["trialphase"], "v", F.col("observation_id"), size=128), ["trialphase"], QS)
    answers = F.array(*[F.struct(F.lit(q).alias("q"), F.col(f"p{q * 100:g}").alias("answer")) for q in QS])
    long = got.select("trialphase", "n", "rank_error", F.inline(answers))  # a few rows a phase
    ranked = rows.join(F.broadcast(long.withColumnRenamed("trialphase", "t")), F.col("trialphase").eqNullSafe(F.col("t"))).groupBy("t", "q", "n", "rank_error").agg((F.count_if(F.col("v") < F.col("answer")) + 1).alias("lo"), F.count_if(F.col("v") <= F.col("answer")).alias("hi"))
    rank = F.greatest(F.lit(1), F.ceil(F.round(F.col("q") * F.col("n"), 9)))
    true_error = F.greatest(F.col("lo") - rank, rank - F.col("hi"), F.lit(0))
    within = F.bool_and(true_error <= F.col("rank_error")) & (F.max("rank_error") <= 0.05 * F.max("n"))
    return ranked.groupBy("t").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("n_answers"), within.alias("within_bounds"), (F.max("rank_error") > 0).alias("compressed")).withColumnRenamed("t", "trialphase")


def p7_contexts(spark: SparkSession, d: str) -> DataFrame:
    sized = checkpoint(packing.token_counts(table(spark, d, "documents").select("doc_id", "text"), "text"))
    return packing.pack_texts(sized, "doc_id", "n_tokens", CAPACITY)


def p7_tight(spark: SparkSession, d: str) -> DataFrame:
    """Small groups and contexts, where best fit often misses the bound: what bin completion makes of each group."""
    sized = checkpoint(packing.token_counts(table(spark, d, "documents").select("doc_id", "text"), "text"))
    return packing.pack_report(sized, "doc_id", "n_tokens", 768, 100)


def p7_pieces(spark: SparkSession, d: str) -> DataFrame:
    """With sizes in characters: the pieces of each text, their sum, and whether its contexts are all within the capacity."""
    packed = checkpoint(packing.pack_texts(table(spark, d, "documents"), "doc_id", "n_chars", 8192))
    loads = packed.where("context_id is not null").groupBy("context_id").agg(F.sum("n_tokens").alias("load"))
    pieces = packed.join(loads, "context_id", "left").groupBy("doc_id")
    return pieces.agg(F.count(F.lit(1)).alias("n_pieces"), F.sum("n_tokens").alias("n_chars"), F.bool_and(F.coalesce("load", F.lit(0)) <= 8192).alias("within"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the contexts are, against the least number that could hold all tokens."""
    contexts = p7_contexts(spark, d).where("context_id is not null").groupBy("context_id").agg(F.sum("n_tokens").alias("n"))
    total = contexts.agg(F.count(F.lit(1)).alias("n_contexts"), F.sum("n").alias("n_tokens"), F.max("n").alias("fullest"))
    return total.withColumn("least_contexts", F.ceil(F.col("n_tokens") / CAPACITY))


def p8_matches(spark: SparkSession, d: str) -> DataFrame:
    """Every place where a document and an item share a passage."""
    shards = checkpoint(leaks.index(table(spark, d, "documents")))
    return leaks.search(shards, table(spark, d, "eval_item"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_matches(spark, d).select("doc_id", "item_id").distinct()


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    """The documents that remain when those with a leaked passage are removed."""
    return table(spark, d, "documents").select("doc_id", "source", "n_chars").join(p8_found(spark, d).select("doc_id").distinct(), "doc_id", "left_anti")


def _endings(spark: SparkSession, d: str) -> truncation.Endings:
    return truncation.endings(table(spark, d, "documents"), "doc_id", "text", "source")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _endings(spark, d).texts.where("cut").select("doc_id")


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return truncation.per_source(_endings(spark, d))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p5_percentiles, p5_partitions, p5_bounds, p7_contexts, p7_fill, p7_tight, p7_pieces, p8_found, p8_matches, p8_clean, p9_found, p9_report)}

_DURATIONS = """obs AS (
  SELECT scenarioid, nullif(lower(trim(engine)), '') engine, partition_no, trialphase, durationnanoseconds v FROM (
    SELECT *, row_number() OVER (PARTITION BY observation_id ORDER BY loaded_at DESC, durationnanoseconds DESC NULLS LAST) rn
    FROM performance_observation WHERE observation_id IS NOT NULL) WHERE rn = 1 AND durationnanoseconds > 0)"""


def _percentiles(keys: str, extra: str = "") -> str:
    ranks = ", ".join(f"max(CASE WHEN rn = greatest(1, ceil(round({q} * n, 9))) THEN v END)::BIGINT AS p{q * 100:g}" for q in QS)
    return f"""SELECT {keys}{extra}, max(n)::BIGINT n, {ranks}, 0::BIGINT rank_error FROM (
  SELECT {keys}, v, row_number() OVER (PARTITION BY {keys} ORDER BY v) rn, count(*) OVER (PARTITION BY {keys}) n FROM obs) GROUP BY {keys}"""


_PASSAGES = r"""plain AS (
  SELECT 'd' side, doc_id id, lower(text) t FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'i', item_id, lower(text) FROM eval_item WHERE text IS NOT NULL),
bare AS (
  SELECT side, id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '[\x{AD}\x{34F}\x{61C}\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{206F}\x{FEFF}]', '', 'g'),
    '</?(?:p|br|div|li|ul|ol|tr|td|th|table|h[1-6]|hr|pre|blockquote|section)(?:\s[^<>]*)?/?>', ' ', 'g'), '</?[a-z][a-z0-9]*(?:\s[^<>]*)?/?>', '', 'g'), '(?m)^[ \t]*(?:>[ \t]?)+', '', 'g') t FROM plain),
readings AS (
  SELECT side, id, t FROM bare UNION ALL
  SELECT side, id, regexp_replace(t, '([\p{L}\p{N}])[-\x{2010}\x{2011}][ \t]*\r?\n[ \t]*([\p{L}\p{N}])', '\1\2', 'g') FROM bare),
lists AS (SELECT side, id, regexp_extract_all(t, '[\p{L}\p{N}]+') w FROM readings),
grams AS (SELECT DISTINCT side, id, array_to_string(w[k:k + 11], ' ') g FROM (SELECT side, id, w, unnest(range(1, len(w) - 10)) k FROM lists)),
leaked AS (SELECT DISTINCT a.id doc_id, b.id item_id FROM grams a JOIN grams b ON a.side = 'd' AND b.side = 'i' AND a.g = b.g)"""

_MARK = r"(?:\s*(?:…|\.{3,}|\[[^\[\]\n]{0,24}\]|\((?:more|continued|cont\.|cut|truncated|abridged|snip)[^()\n]{0,20}\)|<(?:more|cut|truncated|snip)>))+\s*$"
_ITEM, _STOP = r"^\s*(?:[-*+•]|\d+[.)])\s+\S", r"""[.!?]["''”’»)\]]*$"""


def _form(line: str) -> str:
    bare = rf"regexp_replace(trim({line}), '\p{{N}}+', '9', 'g')"
    return rf"""CASE WHEN NOT regexp_matches({line}, '{_ITEM}') THEN 'line ' || {bare} WHEN contains({bare}, ': ') THEN 'entry ' || string_split_regex({bare}, ':\s+')[-1] ELSE 'item ' || regexp_extract({bare}, '(\S+)$', 1) END"""


# a number's point is marked as one that goes on or ends a sentence, since the pattern language can't look ahead
_ENDINGS = rf"""base AS (
  SELECT doc_id, source, text t, length(text) chars, strlen(text) bytes, length(text) - length(regexp_extract(right(text, 120), '{_MARK}')) body, E' \t\r\n\f\v' || chr(160) || chr(8203) blanks FROM documents),
ended AS (SELECT *, coalesce(rtrim(left(t, body), blanks), '') e FROM base),
tails AS (SELECT *, regexp_extract(e, '[^\n]*$') last, regexp_replace(regexp_replace(e, '(\p{{N}}\.)(\p{{N}})', '\1⟂\2', 'g'), '(\p{{N}}\.)(\s+[\p{{Lu}}¿¡"#`-]|\n)', '\1⊥\2', 'g') points FROM ended),
told AS (
  SELECT doc_id, source, chars, bytes, body, last, t IS NULL OR trim(t, blanks) = '' blank, body < chars marked, len(regexp_extract_all(e, '(?m)^[ \t>]*```')) % 2 = 1 in_code,
    right(left(e, length(e) - length(last)), 200) before, {_form("last")} form, regexp_matches(last, '{_STOP}') stop, regexp_matches(last, '{_ITEM}') is_list, regexp_extract(last, '(\p{{L}}+ \p{{L}}+) \p{{N}}+\.$', 1) context,
    regexp_extract_all(e, '(?m)^([ \t]*(?:[-*+•]|\d+[.)])[ \t]+[^\n]*)\n', 1) entries, regexp_extract_all(points, '(\p{{L}}+ \p{{L}}+) \p{{N}}+\.⊥', 1) ends, regexp_extract_all(points, '(\p{{L}}+ \p{{L}}+) \p{{N}}+\.⟂', 1) goes_on FROM tails),
lengths AS (SELECT source, unit, length, count(*) n FROM told UNPIVOT (length FOR unit IN (chars, bytes, body)) GROUP BY ALL),
rated AS (
  SELECT *, (sum(n) OVER (PARTITION BY source, unit ORDER BY length RANGE BETWEEN 50 PRECEDING AND 50 FOLLOWING) - n) / 100 near,
    sum(n) OVER (PARTITION BY source, unit ORDER BY length RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) longer, sum(n) OVER (PARTITION BY source, unit) n_source FROM lengths),
spikes AS (SELECT * FROM rated WHERE n >= greatest(4, n_source * 0.004) AND n >= 10 * near AND n >= longer * 0.25),
seen AS (
  SELECT *, EXISTS (FROM spikes s WHERE s.source IS NOT DISTINCT FROM a.source AND ((unit = 'chars' AND length = chars) OR (unit = 'bytes' AND length = bytes) OR (unit = 'body' AND length = body))) at_spike FROM told a),
plain AS (SELECT form, count(*) n FROM seen WHERE NOT at_spike AND NOT marked AND NOT in_code AND last <> '' AND NOT is_list AND NOT stop GROUP BY form HAVING count(DISTINCT before) >= 2),
known AS (
  SELECT form FROM plain p WHERE n >= 0.1 * (SELECT count(*) FROM seen s WHERE NOT is_list AND starts_with(s.form, p.form)) UNION ALL
  SELECT {_form("x")} FROM (SELECT doc_id, unnest(entries) x FROM seen) WHERE NOT regexp_matches(x, '{_STOP}') GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2),
points AS (SELECT context, sum(w) w FROM (SELECT DISTINCT doc_id, unnest(ends) context, 1 w FROM seen UNION ALL SELECT DISTINCT doc_id, unnest(goes_on), -1 FROM seen) GROUP BY 1),
judged AS (
  SELECT doc_id, source, at_spike, NOT blank AND (in_code OR NOT (regexp_matches(last, '^[ \t>]*```[ \t]*$') OR coalesce(form IN (FROM known), false)
    OR (stop AND NOT regexp_matches(last, '^\s*\p{{N}}+[.)]$') AND coalesce((SELECT w FROM points p WHERE p.context = s.context), 0) >= 0))) cut FROM seen s)"""

SQL: dict[str, str] = {
    "p5_percentiles": f"WITH {_DURATIONS} {_percentiles('scenarioid, engine')}",
    "p5_partitions": f"WITH {_DURATIONS} {_percentiles('scenarioid, engine, partition_no')} UNION ALL BY NAME {_percentiles('scenarioid, engine', ', NULL::INTEGER partition_no')}",
    "p5_bounds": f"WITH {_DURATIONS} SELECT trialphase, count(*) AS n, {len(QS)}::BIGINT AS n_answers, true AS within_bounds, true AS compressed FROM obs GROUP BY trialphase",
    "p7_pieces": "SELECT doc_id, greatest(1, ceil(n_chars / 8192))::BIGINT AS n_pieces, n_chars, true AS within FROM documents WHERE doc_id IS NOT NULL",
    "p8_found": f"WITH {_PASSAGES} SELECT doc_id, item_id FROM leaked",
    "p8_clean": f"WITH {_PASSAGES} SELECT doc_id, source, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM leaked)",
    "p9_found": f"WITH {_ENDINGS} SELECT doc_id FROM judged WHERE cut",
    "p9_report": f"""WITH {_ENDINGS}, limits AS (SELECT source, string_agg(unit || ':' || length, ' ' ORDER BY unit || ':' || length) limits FROM spikes GROUP BY source)
SELECT source, count(*) AS n_texts, count(*) FILTER (cut) AS n_cut, round(count(*) FILTER (cut) / count(*), 6) AS cut_share, count(*) FILTER (cut AND at_spike) AS n_cut_at_limit, coalesce(any_value(limits), '') AS limits
FROM judged LEFT JOIN limits USING (source) GROUP BY source""",
}
