"""Texts cut off by a field limit or in mid-transfer.

Length histograms per source, in characters and in bytes, show a field limit as a spike at the maximum. A
text at such a length without terminal punctuation was cut by the limit. A transfer that broke off leaves
any length: such texts are those of other lengths that stop within a code block, or neither with a finished
sentence nor with an ending known to be proper. The same endings excuse texts at a limit that happen to
end properly there.

Endings are learned from the corpus, by shares that don't depend on its size: the values and items of list
entries that another line follows, and last lines in which several texts agree that differ before it. What
follows a number's point tells whether the point may end a sentence.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.session import checkpoint, small

#: A length is a spike if its texts are at least so many, such a share of the source, and so many times as many as at the lengths around it.
SPIKE_ROWS, SPIKE_SHARE, SPIKE_TIMES, AROUND = 4, 0.004, 10, 50
#: It is at the maximum if its texts are such a share of those of its length or longer.
LIMIT_SHARE = 0.25
#: An ending is known if it is in so many different texts; a last line also only if it is such a share of the last lines that begin with it.
FORM_ROWS, WHOLE_SHARE = 2, 0.1
#: Characters before a last line that tell texts apart.
BEFORE = 200
#: Characters of a last line by which lines that begin with it are looked up.
HEAD = 64

_MARK = r"(?:\s*(?:…|\.{3,}|\[[^\[\]\n]{0,24}\]|\((?:more|continued|cont\.|cut|truncated|abridged|snip)[^()\n]{0,20}\)|<(?:more|cut|truncated|snip)>))+\s*$"
_LIST = r"^\s*(?:[-*+•]|\d+[.)])\s+\S"
_ENTRY = r"(?m)^([ \t]*(?:[-*+•]|\d+[.)])[ \t]+[^\n]*)\n"
_STOP = r"""[.!?]["'”’»)\]]*$"""
#: Two words and a number with a point: a sentence goes on after it with a capital or ends; or the number goes on.
_NUMBER = r"(?<!\p{L})(\p{L}++ \p{L}++) \p{N}++\."
_ENDS, _GOES_ON = _NUMBER + r"(?=\s+[\p{Lu}¿¡\"#`-]|\n)", _NUMBER + r"\p{N}"
_BLANK = " \t\r\n\f\v ​"
#: Characters at a text's end among which marks are looked for.
TAIL = 120


@dataclass(frozen=True)
class Endings:
    """texts: the rows with what their ends look like; spikes: (source, unit, length, n)."""

    texts: DataFrame
    spikes: DataFrame


def length_spikes(df: DataFrame, text: str, source: str) -> DataFrame:
    """Spikes at the maximum of the length histograms: (source, unit, length, n, n_source). Null texts have no length; a null source is one source."""
    t = F.col(text)
    return _spikes(df.select(F.col(source).alias("source"), F.char_length(t).alias("chars"), F.octet_length(t).alias("bytes"), F.char_length(t).alias("body")))


def _spikes(seen: DataFrame) -> DataFrame:
    """body: the characters before any mark put after a cut."""
    each = F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), F.col(u).alias("length")) for u in ("chars", "bytes", "body")]))
    counts = seen.where("chars is not null").select("source", each.alias("l")).select("source", "l.*").groupBy("source", "unit", "length").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("source", "unit")
    near = by.orderBy("length").rangeBetween(-AROUND, AROUND)
    longer = by.orderBy("length").rangeBetween(0, Window.unboundedFollowing)
    rated = counts.withColumns({"near": (F.sum("n").over(near) - F.col("n")) / (2 * AROUND), "longer": F.sum("n").over(longer), "n_source": F.sum("n").over(by)})
    spike = (F.col("n") >= F.greatest(F.lit(SPIKE_ROWS), F.col("n_source") * SPIKE_SHARE)) & (F.col("n") >= SPIKE_TIMES * F.col("near"))
    return rated.where(spike & (F.col("n") >= F.col("longer") * LIMIT_SHARE)).select("source", "unit", "length", "n", "n_source")


def _form(line: Column) -> Column:
    """What stands for a line: the value of a list entry, or the line itself; digits count alike."""
    bare = F.regexp_replace(F.trim(line), r"\p{N}+", "9")
    value = F.element_at(F.split(bare, r":\s+"), -1)
    return F.when(line.rlike(_LIST) & (F.instr(bare, ": ") > 0), F.concat(F.lit("entry "), value)).when(line.rlike(_LIST), F.concat(F.lit("item "), F.regexp_extract(bare, r"(\S+)$", 1))).otherwise(F.concat(F.lit("line "), bare))


def _asked(wanted: DataFrame, found: DataFrame, on: str) -> DataFrame:
    """The found rows about what some text's end asks for; that is few things, and broadcast only if counted so."""
    return found.join(small(wanted, wanted.count()), on, "left_semi")


def _known_lines(seen: DataFrame) -> DataFrame:
    """Last lines that are proper ends: in several texts that differ before it, and a fair share of the last lines that begin with it."""
    plain = ~F.col("at_spike") & ~F.col("marked") & ~F.col("in_code") & (F.col("last") != "") & F.col("form").startswith("line ") & ~F.col("stop")
    lines = checkpoint(seen.where(plain).groupBy("form").agg(F.count_distinct("before").alias("texts"), F.count(F.lit(1)).alias("n")).where(F.col("texts") >= FORM_ROWS))
    rows = lines.count()
    heads = lines.select("form", "n", F.substring("form", 1, HEAD).alias("head"))
    lengths = sorted(r[0] for r in heads.select(F.char_length("head")).distinct().collect())  # at most HEAD
    if not lengths:
        return lines.select("form")
    all_lines = seen.where(F.col("form").startswith("line ")).groupBy("form").agg(F.count(F.lit(1)).alias("m"))
    cuts = F.filter(F.array(*[F.when(F.char_length("form") >= k, F.substring("form", 1, k)) for k in lengths]), lambda h: h.isNotNull())
    begun = all_lines.select(F.col("form").alias("other"), "m", F.explode(cuts).alias("head"))
    share = begun.join(small(heads, rows), "head").where(F.col("other").startswith(F.col("form"))).groupBy("form", "n").agg(F.sum("m").alias("m"))
    return share.where(F.col("n") >= F.col("m") * WHOLE_SHARE).select("form")


def endings(df: DataFrame, key: str, text: str, source: str) -> Endings:
    """Each text with: source, cut (boolean), reason (limit, transfer, or null) and at_spike (boolean), under its key.

    Null, empty and blank texts are not cut. Repeated rows are each judged. Texts are read once, for their
    lengths, ends, list entries and numbers, and never shuffled. A judgement depends on texts with the same
    source or like endings alone: others change nothing, however many they are.
    """
    spark = df.sparkSession
    t = F.col(text)
    mark = F.char_length(F.regexp_extract(F.substring(t, -TAIL, TAIL), _MARK, 0))
    base = df.select(F.col(key).alias("key"), F.col(source).alias("source"), t.alias("t"), F.char_length(t).alias("chars"), F.octet_length(t).alias("bytes"), mark.alias("mark"))
    base = base.withColumn("end", F.rtrim(F.substring("t", F.lit(1), F.col("chars") - F.col("mark")), F.lit(_BLANK)))
    fences = F.when(F.instr("t", "```") > 0, F.regexp_count("end", F.lit(r"(?m)^[ \t>]*```"))).otherwise(0)
    blank = F.col("t").isNull() | (F.trim(F.col("t"), F.lit(_BLANK)) == "")
    last = F.substring_index("end", "\n", -1)
    rest = F.expr(f"substring(end, greatest(1, char_length(end) - char_length(substring_index(end, '\\n', -1)) - {BEFORE}), {BEFORE})")
    forms = F.array_distinct(F.transform(F.filter(F.regexp_extract_all("end", F.lit(_ENTRY), F.lit(1)), lambda x: ~x.rlike(_STOP)), _form))
    seen = checkpoint(base.select(
        "key", "source", "chars", "bytes", (F.col("chars") - F.col("mark")).alias("body"), last.alias("last"), F.xxhash64(rest).alias("before"), (fences % 2 == 1).alias("in_code"), (F.col("mark") > 0).alias("marked"), blank.alias("blank"),
        forms.alias("entries"), F.array_distinct(F.regexp_extract_all("end", F.lit(_ENDS), F.lit(1))).alias("ends"), F.array_distinct(F.regexp_extract_all("end", F.lit(_GOES_ON), F.lit(1))).alias("goes_on"),
    ))
    spikes = checkpoint(_spikes(seen))
    limits = spikes.collect()  # at most 1 / SPIKE_SHARE of a source and unit
    at = F.lit(False)
    for unit in ("chars", "bytes", "body"):
        found = spark.createDataFrame([(r.source, r.length) for r in limits if r.unit == unit], "s string, l int").select("s", "l", F.lit(True).alias(f"at_{unit}"))
        seen = seen.join(F.broadcast(found), F.col("source").cast("string").eqNullSafe(F.col("s")) & (F.col(unit) == F.col("l")), "left").drop("s", "l")
        at = at | F.coalesce(f"at_{unit}", F.lit(False))
    l = F.col("last")
    seen = seen.withColumns({"at_spike": at, "form": _form(l), "stop": l.rlike(_STOP), "context": F.regexp_extract("last", _NUMBER + "$", 1), "is_list": l.rlike(_LIST)})

    known_lines = checkpoint(_known_lines(seen))
    entries = _asked(seen.where("is_list and not stop").select("form").distinct(), seen.select(F.explode("entries").alias("form")), "form")
    known = known_lines.unionByName(entries.groupBy("form").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FORM_ROWS).select("form"))
    known = checkpoint(known.withColumn("known", F.lit(True)))
    wanted = seen.where("context <> ''").select("context").distinct()
    both = seen.select(F.explode("ends").alias("context"), F.lit(1).alias("w")).unionByName(seen.select(F.explode("goes_on").alias("context"), F.lit(-1).alias("w")))
    split = checkpoint(_asked(wanted, both, "context").groupBy("context").agg((F.sum("w") < 0).alias("goes_on_mostly")))
    ended = seen.join(small(known, known.count()), "form", "left").join(small(split, split.count()), "context", "left")

    sentence = F.col("stop") & ~l.rlike(r"^\s*\p{N}+[.)]$") & ~F.coalesce("goes_on_mostly", F.lit(False))
    fence = l.rlike(r"^[ \t>]*```[ \t]*$")
    proper = ~F.col("in_code") & (fence | sentence | F.coalesce("known", F.lit(False)))
    cut = ~F.col("blank") & ~proper
    reason = F.when(cut, F.when(F.col("at_spike"), "limit").otherwise("transfer"))
    return Endings(ended.select(F.col("key").alias(key), "source", F.coalesce(cut, F.lit(False)).alias("cut"), reason.alias("reason"), "at_spike", "last"), spikes)


def per_source(found: Endings) -> DataFrame:
    """For each source: texts, cut ones and their share, how many of them stand at a limit, and the limits as unit:length."""
    counts = found.texts.groupBy("source").agg(F.count(F.lit(1)).alias("n_texts"), F.count_if("cut").alias("n_cut"), F.count_if(F.col("reason") == "limit").alias("n_cut_at_limit"))
    limits = found.spikes.groupBy(F.col("source").alias("s")).agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "unit", "length"))), " ").alias("limits"))
    out = counts.join(F.broadcast(limits), F.col("source").eqNullSafe(F.col("s")), "left")  # a row a source
    return out.select("source", "n_texts", "n_cut", F.round(F.col("n_cut") / F.col("n_texts"), 6).alias("cut_share"), "n_cut_at_limit", F.coalesce("limits", F.lit("")).alias("limits"))
