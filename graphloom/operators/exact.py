"""Basic graph patterns that are answered apart from the query around them, and put back exactly."""

from __future__ import annotations

from dataclasses import fields, is_dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.plans.algebra import Bgp, Graph, Iri, Query, Var
from graphloom.plans.relation import Rel


class Incomplete(RuntimeError):
    """Parts of an answer that don't cover it exactly once, or failed."""


def bgp_templates(query: Query) -> list[tuple[Bgp, str | None, str | None]]:
    """The query's different basic graph patterns with the graph, or the graph variable, that each is matched in."""
    found: dict[tuple[Bgp, str | None, str | None], None] = {}

    def look(x, graph: str | None, var: str | None) -> None:
        if isinstance(x, Bgp):
            if x.triples:
                found.setdefault((x, graph, var))
            return
        if isinstance(x, Graph):
            graph, var = (x.name.value, None) if isinstance(x.name, Iri) else (None, x.name.name)
        if isinstance(x, tuple):
            for y in x:
                look(y, graph, var)
        elif is_dataclass(x) and not isinstance(x, (Var, Iri)):
            for f in fields(x):
                look(getattr(x, f.name), graph, var)

    look(query.pattern, None, None)
    return list(found)


def substituted(query: Query, answers: dict[tuple[Bgp, str | None, str | None], Rel]) -> Query:
    """The query with patterns, as bgp_templates() names them, replaced by their answers, as VALUES would be; the answers stay distributed."""

    def put(x, graph: str | None, var: str | None):
        if isinstance(x, Bgp):
            return answers.get((x, graph, var), x)
        if isinstance(x, Graph):
            graph, var = (x.name.value, None) if isinstance(x.name, Iri) else (None, x.name.name)
        if isinstance(x, tuple):
            return tuple(put(y, graph, var) for y in x)
        if is_dataclass(x) and not isinstance(x, (Var, Iri, Rel)):
            return replace(x, **{f.name: put(getattr(x, f.name), graph, var) for f in fields(x)})
        return x

    return replace(query, pattern=put(query.pattern, None, None))


def merged(parts: DataFrame, ranges: DataFrame, total: int) -> DataFrame:
    """Rows of an answer made in parts, each of a range of candidates: (part, ...) without its part.

    ranges: (part, first, after, status), one row a part. They must lie side by side from 0 to total and all
    be COMPLETE; anything else is an error, never a smaller answer. Rows of a part that isn't named are one too.
    """
    order = Window.orderBy("first", "after")  # a row a part
    checked = ranges.withColumn("before", F.lag("after", 1, 0).over(order)).agg(
        F.count_if((F.col("first") != F.col("before")) | (F.col("after") < F.col("first"))).alias("off"), F.count_if(F.coalesce(F.col("status") != "COMPLETE", F.lit(True))).alias("failed"),
        F.coalesce(F.max("after"), F.lit(0)).alias("end"), (F.count(F.lit(1)) - F.count_distinct("part")).alias("twice"),
    ).first()
    if checked.off or checked.failed or checked.twice or checked.end != total:
        raise Incomplete(f"{checked.off} ranges out of place, {checked.failed} not complete, {checked.twice} parts twice, {checked.end} of {total} candidates")
    if parts.select("part").distinct().join(ranges.select("part"), "part", "left_anti").limit(1).count():
        raise Incomplete("rows of a part without a range")
    return parts.drop("part")
