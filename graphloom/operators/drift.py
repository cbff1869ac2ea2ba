"""Schemas that drift between files: edit scripts between successive nested records, and projections made of them.

Files of one series are sorted by their number; each is compared with the one before it. A tree edit
distance between the two gives the cheapest script of adds, deletes, renames, moves and changes of type,
among the mappings that keep objects' members together. The scripts are compiled to a projection for every
file: its renames of members, put together, say which column a member goes to, and those of objects, along
the series, what an object was called at first.
"""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.operators.ordered import range_sorted
from graphloom.session import checkpoint

Path = tuple[str, ...]
#: Cost of a rename where scripts are chosen: of those that cost the same, one that keeps names.
TIE = 1 + 1e-6
SCRIPT = "component string, phase_no int, op string, old_path string, new_path string, old_type string, new_type string, nested boolean"


class _Number(str):
    """A JSON number by its text, so that 8 equals "8" and no digit is lost."""


def parse(body: str | None) -> dict | None:
    """The object in a file, or None for a file that is null, broken or no object."""
    try:
        doc = json.loads(body, parse_int=_Number, parse_float=_Number, parse_constant=_Number)
    except (TypeError, ValueError, RecursionError):
        return None
    return doc if isinstance(doc, dict) else None


def kind(v: Any) -> str:
    if v is None:
        return "null"
    return "boolean" if isinstance(v, bool) else "number" if isinstance(v, _Number) else "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object"


def _text(v: Any) -> str:
    return v if isinstance(v, str) else json.dumps(v, sort_keys=True, ensure_ascii=False)


def _json(v: Any) -> str:
    """The JSON text of a value, numbers as they were written."""
    if isinstance(v, dict):
        return "{" + ", ".join(f"{json.dumps(k, ensure_ascii=False)}: {_json(v[k])}" for k in sorted(v)) + "}"
    if isinstance(v, list):
        return "[" + ", ".join(map(_json, v)) + "]"
    return str(v) if isinstance(v, _Number) else json.dumps(v, ensure_ascii=False)


def _same(v: Any) -> tuple[str, str] | None:
    """What two values share if they count as the same; None for null, which equals nothing."""
    return None if v is None else ("text" if isinstance(v, str) else kind(v), _text(v))


def unnumbered(doc: dict, number: int) -> dict:
    """The file with its own number taken out of its member names."""
    own = re.compile(rf"phase{number}(?!\d)")

    def walk(o: Any) -> Any:
        return {own.sub("phaseN", k): walk(v) for k, v in o.items()} if isinstance(o, dict) else o

    return walk(doc)


def leaves(o: Any, at: Path = ()) -> Iterator[tuple[Path, Any]]:
    if isinstance(o, dict):
        for k, v in o.items():
            yield from leaves(v, (*at, k))
    else:
        yield at, o


@dataclass(frozen=True)
class Edit:
    """op: renamed, retyped, removed, added, moved, or kept where only an object above changed its name; nested if the node is an object."""

    op: str
    old: Path
    new: Path
    old_type: str
    new_type: str
    nested: bool = False


def _size(o: Any) -> int:
    return 1 + sum(map(_size, o.values())) if isinstance(o, dict) else 1


def _assign(cost: list[list[float]]) -> list[int]:
    """Cheapest assignment of rows to columns (at least as many): shortest augmenting paths with potentials."""
    n, m = len(cost), len(cost[0])
    u, v, owner = [0.0] * n, [0.0] * m, [-1] * m
    for row in range(n):
        dist, back, done = [float("inf")] * m, [-1] * m, [False] * m
        i, last, base = row, -1, 0.0
        while True:
            for j in range(m):
                if not done[j] and (d := base + cost[i][j] - u[i] - v[j]) < dist[j]:
                    dist[j], back[j] = d, last
            j = min((j for j in range(m) if not done[j]), key=lambda j: dist[j])
            done[j], base, last = True, dist[j], j
            if owner[j] < 0:
                break
            i = owner[j]
        u[row] += base
        for k in range(m):
            if done[k] and k != j:
                u[owner[k]] += base - dist[k]
                v[k] -= base - dist[k]
        while back[j] >= 0:
            owner[j] = owner[back[j]]
            j = back[j]
        owner[j] = row
    out = [-1] * n
    for j, i in enumerate(owner):
        if i >= 0:
            out[i] = j
    return out


def _paired(gain: list[list[float]]) -> list[tuple[int, int]]:
    """The rows and columns of the cheapest assignment whose cost is below 0."""
    if not gain or not gain[0]:
        return []
    if len(gain) <= len(gain[0]):
        pairs = enumerate(_assign(gain))
    else:
        pairs = ((i, j) for j, i in enumerate(_assign([list(c) for c in zip(*gain, strict=True)])))
    return [(i, j) for i, j in pairs if gain[i][j] < 0]


def _script(a: dict, b: dict, at_a: Path, at_b: Path, by_path: bool) -> tuple[float, list[Edit]]:
    """Least cost of turning one object's members into another's, and the script.

    Removing or adding costs the nodes of a subtree, a rename or change of type 1. A value is the one of
    its name, or renamed to one that is the same, of the same type first; an object may become any other,
    by the cheapest assignment of them all. by_path: objects of one name are one.
    """
    cost, out = 0.0, []
    values_a, values_b = ({k: v for k, v in o.items() if not isinstance(v, dict)} for o in (a, b))

    def turned(k: str, n: str) -> float | None:
        """Cost of one value becoming another; None where neither its name nor its content stays."""
        x, y = kind(a[k]), kind(b[n])
        other = x != y and "null" not in (x, y)
        return float(other) if k == n else 1.0 + other if _same(a[k]) and _same(a[k]) == _same(b[n]) else None

    both = [k for k in values_a if k in values_b and (by_path or not turned(k, k))]
    gone, new = [k for k in values_a if k not in both], [k for k in values_b if k not in both]
    if by_path or not any(k in values_b for k in gone):  # a name is no longer there; values find each other, those of one type first
        found = []
        for alike in (kind, lambda _: ""):
            waiting = defaultdict(list)
            for n in new:
                if same := _same(b[n]):
                    waiting[same, alike(b[n])].append(n)
            for k in list(gone):
                if (same := _same(a[k])) and (there := waiting.get((same, alike(a[k])))):
                    found.append((k, there[0]))
                    gone.remove(k)
                    new.remove(there.pop(0))
    else:
        gain = [[min(0.0, 0.0 if c is None else c - 2 + (k != n) * (TIE - 1)) for n, c in ((n, turned(k, n)) for n in new)] for k in gone]
        found = [(gone[i], new[j]) for i, j in _paired(gain)]
        gone, new = [k for k in gone if k not in {x for x, _ in found}], [n for n in new if n not in {y for _, y in found}]
    for k, n in [*((k, k) for k in both), *found]:
        cost += turned(k, n)
        if k != n:
            out.append(Edit("renamed", (*at_a, k), (*at_b, n), kind(a[k]), kind(b[n])))
        elif at_a != at_b:
            out.append(Edit("kept", (*at_a, k), (*at_b, n), kind(a[k]), kind(b[n])))
        if kind(a[k]) != kind(b[n]) and "null" not in (kind(a[k]), kind(b[n])):
            out.append(Edit("retyped", (*at_a, k), (*at_b, n), kind(a[k]), kind(b[n])))
    objects_a, objects_b = [k for k in a if k not in values_a], [k for k in b if k not in values_b]
    pairs = []
    for k in [k for k in objects_a if k in objects_b]:
        c, s = _script(a[k], b[k], (*at_a, k), (*at_b, k), by_path)
        if by_path or not c:  # nothing is cheaper than a pair that costs nothing
            objects_a.remove(k)
            objects_b.remove(k)
            cost, out = cost + c, out + s
    if objects_a and objects_b:
        tries = [[_script(a[x], b[y], (*at_a, x), (*at_b, y), by_path) for y in objects_b] for x in objects_a]
        pairs = _paired([[min(0.0, TIE * (x != y) + tries[i][j][0] - _size(a[x]) - _size(b[y])) for j, y in enumerate(objects_b)] for i, x in enumerate(objects_a)])
    for i, j in pairs:
        x, y = objects_a[i], objects_b[j]
        if x != y:
            out.append(Edit("renamed", (*at_a, x), (*at_b, y), "object", "object", True))
        cost, out = cost + (x != y) + tries[i][j][0], out + tries[i][j][1]
    paired_a, paired_b = {objects_a[i] for i, _ in pairs}, {objects_b[j] for _, j in pairs}
    for k in [*gone, *(k for k in objects_a if k not in paired_a)]:
        cost, out = cost + _size(a[k]), out + _removed(a[k], (*at_a, k))
    for k in [*new, *(k for k in objects_b if k not in paired_b)]:
        cost, out = cost + _size(b[k]), out + _added(b[k], (*at_b, k))
    return cost, out


def _removed(o: Any, at: Path) -> list[Edit]:
    return [Edit("removed", p, (), kind(v), "") for p, v in leaves(o, at)]


def _added(o: Any, at: Path) -> list[Edit]:
    return [Edit("added", (), p, "", kind(v)) for p, v in leaves(o, at)]


def script(a: dict, b: dict, by_path: bool = False) -> list[Edit]:
    """The edits that turn one file's schema into another's; a value that left one object and turned up in another under its name is moved."""
    _, out = _script(a, b, (), (), by_path)
    old, new = dict(leaves(a)), dict(leaves(b))
    homes = defaultdict(list)
    for e in out:
        if e.op == "added" and (same := _same(new[e.new])):
            homes[e.new[-1], same].append(e)
    moved: dict[Edit, Edit] = {}
    for e in out:
        if e.op == "removed" and (same := _same(old[e.old])) and homes.get((e.old[-1], same)):
            to = homes[e.old[-1], same].pop(0)
            moved[e], moved[to] = Edit("moved", e.old, to.new, e.old_type, to.new_type), None
    return [x for e in out if (x := moved.get(e, e)) is not None]


def path_changes(edits: list[Edit]) -> Iterator[tuple[str, Path, Path]]:
    """A script by path as changes of the paths of values: what is no longer in its object, since that was renamed or the value moved, is removed and added."""
    stays = {(e.old, e.new) for e in edits if e.op == "renamed" and not e.nested and e.old[:-1] == e.new[:-1]}
    for e in edits:
        if e.nested:
            continue
        if e.op == "retyped":
            if e.old == e.new or (e.old, e.new) in stays:
                yield e.op, e.old, e.new
        elif e.op in ("removed", "added") or (e.old, e.new) in stays:
            yield e.op, e.old, e.new
        else:
            yield "removed", e.old, ()
            yield "added", (), e.new


def _compare(component: str, number: int, a: dict, b: dict, paths: bool) -> Iterator[tuple]:
    edits = script(a, b, paths)
    if paths:
        for op, old, new in path_changes(edits):
            yield component, number, op, ".".join(old), ".".join(new), "", "", False
    else:
        for e in edits:
            if e.op != "kept":
                yield component, number, e.op, ".".join(e.old), ".".join(e.new), e.old_type, e.new_type, e.nested


def sorted_files(df: DataFrame, component: str = "component", number: str = "phase_no", body: str = "body", order: str = "record_id") -> DataFrame:
    """Files by component and number over all partitions; rows with a null in either name no file."""
    rows = df.select(F.col(component).alias("component"), F.col(number).cast("int").alias("phase_no"), F.col(order).alias("record_id"), F.col(body).alias("body"))
    return range_sorted(rows.where("component is not null and phase_no is not null"), ["component", "phase_no"])


def _files(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, int, dict]]:
    """One file for each component and number: of rows sent twice, the last by id whose body is an object."""
    key, held = None, None
    for pdf in batches:
        for c, n, r, body in zip(pdf.component, pdf.phase_no, pdf.record_id, pdf.body, strict=True):
            if (c, n) != key:
                if held is not None:
                    yield *key, held[1]
                key, held = (c, n), None
            order = (0,) if pd.isna(r) else (1, r)
            if held is None or order > held[0]:
                if held is not None and body == held[2]:
                    held = (order, *held[1:])
                elif (doc := parse(body)) is not None:
                    held = (order, unnumbered(doc, int(n)), body)
    if held is not None:
        yield *key, held[1]


@dataclass(frozen=True)
class Drift:
    """edits: every change between successive files; names: (name, n) of the members of the group's objects."""

    edits: DataFrame
    names: DataFrame


def changes(files: DataFrame, paths: bool = True) -> DataFrame:
    """Every change between successive files of a component, as path changes or as edit scripts."""
    return compare(files, paths).edits


def compare(files: DataFrame, paths: bool = False, group: str = "checks") -> Drift:
    """Successive files of each component, compared; every file is parsed once.

    files: of sorted_files(). A file that can't be read counts as not there, so the one after it is
    compared with the one before it. The first file of a partition finds its predecessor in a second,
    small pass over one file a side and partition; no file goes through the driver.
    """
    columns = [f.split()[0] for f in SCRIPT.split(", ")]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = last = None
        rows, count = [], Counter()
        for c, n, doc in _files(batches):
            if last and last[0] == c:
                rows += _compare(c, int(n), last[2], doc, paths)
            last = (c, int(n), doc)
            first = first or last
            if not paths:
                count.update(k for m in _objects(doc, group).values() for k in m)
            if len(rows) > 5000:
                yield pd.DataFrame(rows, columns=columns)
                rows = []
        rows += [(None, n, "named", k, "", "", "", False) for k, n in count.items()]
        if first:
            pid = str(TaskContext.get().partitionId())
            rows += [(x[0], x[1], what, pid, "", "", "", False) for x, what in ((first, "first"), (last, "last"))]
        yield pd.DataFrame(rows, columns=columns)

    log = checkpoint(files.mapInPandas(scan, SCRIPT))
    names = log.where("op = 'named'").groupBy(F.col("old_path").alias("name")).agg(F.sum("phase_no").alias("n"))
    ends: dict[int, dict] = defaultdict(dict)
    for r in log.where("op in ('first', 'last')").collect():  # two rows a partition
        ends[int(r.old_path)][r.op] = (r.component, r.phase_no)
    order = sorted(ends)
    seams = [x for p, q in zip(order, order[1:], strict=False) if ends[p]["last"][0] == ends[q]["first"][0] for x in ((q, p, *ends[p]["last"]), (q, q, *ends[q]["first"]))]
    inner = log.where("op not in ('named', 'first', 'last')")
    if not seams:
        return Drift(inner, names)
    seam_rows = files.sparkSession.createDataFrame(seams, "seam int, pid int, component string, phase_no int")
    both = files.withColumn("pid", F.spark_partition_id()).join(F.broadcast(seam_rows), ["pid", "component", "phase_no"])

    def seam(pdf: pd.DataFrame) -> pd.DataFrame:
        docs = list(_files(iter([pdf.sort_values(["phase_no", "record_id"])])))
        rows = _compare(docs[1][0], int(docs[1][1]), docs[0][2], docs[1][2], paths) if len(docs) == 2 else []
        return pd.DataFrame(list(rows), columns=columns)

    return Drift(inner.unionByName(both.groupBy("seam").applyInPandas(seam, SCRIPT)), names)


def first_names(edits: DataFrame, group: str = "checks") -> DataFrame:
    """What the group's renamed objects were called before any rename: (component, phase_no, name, first), from that phase on.

    The renames of a component pass in order, with the names that are live held.
    """
    nested = edits.where(F.col("nested") & (F.col("op") == "renamed") & F.col("old_path").startswith(f"{group}.") & F.col("new_path").startswith(f"{group}."))
    at = len(group) + 2
    renames = nested.select("component", "phase_no", F.expr(f"substring(old_path, {at})").alias("old"), F.expr(f"substring(new_path, {at})").alias("new"))

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        component, first, phase, fresh = None, {}, None, {}
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                if (r.component, r.phase_no) != (component, phase):
                    first = {**first, **fresh} if r.component == component else {}
                    component, phase, fresh = r.component, r.phase_no, {}
                fresh[r.new] = first.get(r.old, r.old)  # renames of one file happen at once
                out.append((component, phase, r.new, fresh[r.new]))
            yield pd.DataFrame(out, columns=["component", "phase_no", "name", "first"])

    return renames.repartition("component").sortWithinPartitions("component", "phase_no", "old").mapInPandas(follow, "component string, phase_no int, name string, first string")


def _objects(doc: dict, group: str) -> dict[str, dict]:
    held = doc.get(group)
    return {k: v for k, v in held.items() if isinstance(v, dict)} if isinstance(held, dict) else {}


def _others(doc: dict, group: str) -> dict[str, Any]:
    """What the group holds that is no object."""
    held = doc.get(group)
    return {k: v for k, v in held.items() if not isinstance(v, dict)} if isinstance(held, dict) else {}


def field_names(drift: Drift, group: str = "checks", support: float = 0.02) -> dict[str, str]:
    """Which member names of the group's objects mean one field: name to the name used most.

    Renames in the scripts link names; a link counts if it makes up the given share of all renames of
    either name, so a chance equality of two values links nothing. What is collected grows with the
    number of different names, not with the files.
    """
    edits = drift.edits
    renames = edits.where((F.col("op") == "renamed") & ~F.col("nested") & F.col("old_path").startswith(f"{group}."))
    pair = renames.groupBy(F.element_at(F.split("old_path", r"\."), -1).alias("a"), F.element_at(F.split("new_path", r"\."), -1).alias("b")).count()
    links: Counter = Counter()
    for r in pair.collect():
        links[tuple(sorted((r.a, r.b)))] += r["count"]
    total: Counter = Counter()
    for (a, b), n in links.items():
        total[a] += n
        total[b] += n

    used = {r.name: r.n for r in drift.names.collect()}
    home = {k: k for k in used}

    def find(k: str) -> str:
        while home[k] != k:
            k = home[k]
        return k

    for (a, b), n in sorted(links.items()):
        if a in home and b in home and n >= max(2, support * min(total[a], total[b])):
            x, y = sorted((find(a), find(b)), key=lambda k: (-used[k], k))
            home[y] = x
    return {k: find(k) for k in used}


def _placed(members: dict, fields: dict[str, str]) -> dict[str, str]:
    """The members that are not null by the key of their column: a field, or for what has no free field \\0 and its own name."""
    row: dict[str, str] = {}
    for k in sorted(members, key=lambda k: (fields.get(k, k) != k, k)):
        if members[k] is not None:
            field = fields.get(k)
            row["\0" + k if field is None or field in row else field] = _text(members[k])
    return row


def consistent_table(files: DataFrame, fields: dict[str, str], group: str = "checks", value: str | None = None, first: DataFrame | None = None) -> DataFrame:
    """All named objects of the group in all files, one row each, with one text column for each field.

    Values keep their JSON text, strings their content, since a field's type may change; a member that is
    null or absent is null, and an object inside is JSON text. Where members of one object meet in a field,
    the one that has the field's name is its value, else the least by name; each other has, like a member
    that fields doesn't list, its value in a column of its own name, so no value is lost. Columns are
    component, phase_no, check_name, the sorted fields, and the sorted names of such members, of which
    there are none in most data.

    value: the name of one more column, after check_name; with it, what the group holds under a name that is
    no object (a string, number, boolean, array or null) is a row as well, with its JSON text there.
    first: of first_names(); with it, a column first_name follows, what the object was called before it was
    renamed in its series.
    """

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = []
        for c, n, doc in _files(batches):
            for name, members in _objects(doc, group).items():
                rows.append((c, n, name, None, _placed(members, fields)))
            if value:
                rows += [(c, n, name, _json(v), {}) for name, v in _others(doc, group).items()]
            if len(rows) > 5000:
                yield pd.DataFrame(rows, columns=["component", "phase_no", "check_name", "value", "m"])
                rows = []
        yield pd.DataFrame(rows, columns=["component", "phase_no", "check_name", "value", "m"])

    out = checkpoint(files.mapInPandas(project, "component string, phase_no int, check_name string, value string, m map<string,string>"))
    keys = out.select(F.explode(F.map_keys("m")).alias("k")).where(F.col("k").startswith("\0")).distinct()
    extra = sorted(r.k[1:] for r in keys.collect())
    taken_by_first = ["first_name"] if first is not None else []
    taken = {"component", "phase_no", "check_name", *taken_by_first, *([value.lower()] if value else [])}
    lower: Counter = Counter(f.lower() for f in set(fields.values()))
    columns = sorted(set(fields.values()))
    named = [(f, f"member_{i}_{f}" if f.lower() in taken or lower[f.lower()] > 1 else f) for i, f in enumerate(columns)]
    used = taken | {name.lower() for _, name in named}
    for i, k in enumerate(extra, len(columns)):
        named.append(("\0" + k, f"member_{i}_{k}" if k.lower() in used else k))
        used.add(named[-1][1].lower())
    kept = [F.col("value").alias(value)] if value else []
    if first is not None:
        first = checkpoint(first)
        if first.limit(1).count():
            events = first.select("component", "phase_no", F.col("name").alias("check_name"), "first", F.lit(None).cast("string").alias("value"), F.lit(None).cast("map<string,string>").alias("m"), F.lit(0).alias("row"))
            rows = out.select("component", "phase_no", "check_name", F.lit(None).cast("string").alias("first"), "value", "m", F.lit(1).alias("row"))
            before = Window.partitionBy("component", "check_name").orderBy("phase_no", "row")
            out = events.unionByName(rows).withColumn("first", F.last("first", ignorenulls=True).over(before)).where("row = 1")
        else:
            out = out.withColumn("first", F.lit(None).cast("string"))
        kept.append(F.coalesce("first", "check_name").alias("first_name"))
    return out.select("component", "phase_no", "check_name", *kept, *[F.try_element_at("m", F.lit(key)).alias(name) for key, name in named])
