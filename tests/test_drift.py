import json
from itertools import permutations

from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.operators import drift
from graphloom.operators.drift import _assign, parse, path_changes, script, unnumbered


def changes_of(a, b, n=1, m=2):
    x, y = unnumbered(parse(json.dumps(a)), n), unnumbered(parse(json.dumps(b)), m)
    return sorted((op, ".".join(p), ".".join(q)) for op, p, q in path_changes(script(x, y, True)))


def test_kinds():
    a = {"phase": 1, "checks": {"phase1Static": {"status": "ok", "code": 8, "gone": None, "x": [1]}, "other": {"k": True}}}
    b = {"phase": "2", "checks": {"phase2Static": {"verdict": "ok", "rc": "8", "fresh": None, "x": "1"}, "other": {"k": None}}}
    assert changes_of(a, b) == [
        ("added", "", "checks.phaseNStatic.fresh"), ("removed", "checks.phaseNStatic.gone", ""), ("renamed", "checks.phaseNStatic.code", "checks.phaseNStatic.rc"), ("renamed", "checks.phaseNStatic.status", "checks.phaseNStatic.verdict"),
        ("retyped", "checks.phaseNStatic.code", "checks.phaseNStatic.rc"), ("retyped", "checks.phaseNStatic.x", "checks.phaseNStatic.x"), ("retyped", "phase", "phase"),
    ]


def test_own_number_only():
    assert changes_of({"phase1": {"a": 1}}, {"phase12": {"a": 1}}, 1, 12) == []
    assert changes_of({"phase12": 1}, {"phase12": 1}, 1, 12) == [("renamed", "phase12", "phaseN")]


def test_renamed_object_is_removed_and_added():
    a, b = {"checks": {"scan": {"s": "p", "t": "q"}}}, {"checks": {"walk": {"s": "p", "t": "q"}}}
    assert changes_of(a, b) == [("added", "", "checks.walk.s"), ("added", "", "checks.walk.t"), ("removed", "checks.scan.s", ""), ("removed", "checks.scan.t", "")]
    assert [(e.op, e.nested) for e in script(parse(json.dumps(a)), parse(json.dumps(b))) if e.op != "kept"] == [("renamed", True)]


def test_an_object_and_a_value_swap_names():
    edits = script(parse('{"x": {"p": 1, "q": 2}, "y": 5}'), parse('{"y": {"p": 1, "q": 2}, "x": 5}'))
    assert sorted((e.op, e.old, e.new) for e in edits if e.op != "kept") == [("renamed", ("x",), ("y",)), ("renamed", ("y",), ("x",))]


def test_the_same_type_first():
    edits = script(parse('{"a": 8, "b": "8"}'), parse('{"c": "8", "d": 8}'))
    assert sorted((e.op, e.old[-1], e.new[-1]) for e in edits) == [("renamed", "a", "d"), ("renamed", "b", "c")]


def least(a, b):
    """Least cost over all pairings of members, by trying them all."""
    size = drift._size
    names_a, names_b = list(a), list(b)

    def pair(k, n):
        x, y = a[k], b[n]
        if isinstance(x, dict) != isinstance(y, dict):
            return None
        if isinstance(x, dict):
            return (k != n) + least(x, y)
        retyped = drift.kind(x) != drift.kind(y) and "null" not in (drift.kind(x), drift.kind(y))
        if k == n:
            return int(retyped)
        return 1 + retyped if drift._same(x) and drift._same(x) == drift._same(y) else None

    def best(i, free):
        if i == len(names_a):
            return sum(size(b[n]) for n in free)
        ways = [size(a[names_a[i]]) + best(i + 1, free)]
        for n in free:
            if (c := pair(names_a[i], n)) is not None:
                ways.append(c + best(i + 1, free - {n}))
        return min(ways)

    return best(0, frozenset(names_b))


_TREES = st.recursive(st.sampled_from([1, "1", 2, True, None]), lambda t: st.dictionaries(st.sampled_from("abcd"), t, max_size=3), max_leaves=7).map(lambda t: t if isinstance(t, dict) else {"a": t})


@settings(max_examples=200, deadline=None)
@given(_TREES, _TREES)
def test_scripts_are_cheapest(a, b):
    x, y = parse(json.dumps(a)), parse(json.dumps(b))
    assert drift._script(x, y, (), (), False)[0] == least(x, y)


def test_moved():
    edits = script(parse('{"a": {"k": "v", "z": 1}, "b": {"z": 1}}'), parse('{"a": {"z": 1}, "b": {"k": "v", "z": 1}}'))
    assert [(e.op, e.old, e.new) for e in edits] == [("moved", ("a", "k"), ("b", "k"))]


def test_odd_bodies():
    assert parse(None) is None and parse("[1]") is None and parse("{") is None and parse("") is None
    assert changes_of({}, {}) == [] and changes_of({"a": {}}, {}) == []


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 4).flatmap(lambda n: st.lists(st.lists(st.integers(-9, 9), min_size=4, max_size=4), min_size=n, max_size=n)))
def test_assignment_is_cheapest(cost):
    got = _assign(cost)
    assert len(set(got)) == len(got)
    assert sum(cost[i][j] for i, j in enumerate(got)) == min(sum(cost[i][j] for i, j in enumerate(p)) for p in permutations(range(4), len(cost)))


def test_changes_over_partitions(spark, rows):
    """One series over all partitions, with rows sent twice, gaps and files that can't be read."""
    data, want = [], []
    previous = None
    for n in range(1, 60):
        if n % 7 == 0:
            continue
        body = {"phase": n, "checks": {f"phase{n}X": {"status": "ok", f"m{n // 5}": n // 5}, "y": {"v": 1 if n % 3 else "1"}}}
        text = json.dumps(body) if n % 11 else "{broken"
        data += [(n * 2, "c", n, text, "x"), (n * 2 + 1, "c", n, json.dumps(body, indent=1) if n % 11 else None, "x")][: 1 + n % 2]
        if n % 11 == 0:
            continue
        if previous:
            x, y = (unnumbered(parse(json.dumps(b)), b["phase"]) for b in (previous, body))
            want += [("c", n, op, ".".join(p), ".".join(q)) for op, p, q in path_changes(script(x, y, True))]
        previous = body
    data += [(1000, None, 3, "{}", "x"), (1001, "d", None, "{}", "x"), (1002, "d", 1, "{}", "x")]
    df = spark.createDataFrame(data, "record_id bigint, component string, phase_no int, body string, pid string").repartition(4)
    files = drift.sorted_files(df)
    assert files.rdd.getNumPartitions() > 2
    assert rows(drift.changes(files).select("component", "phase_no", "op", "old_path", "new_path")) == sorted(want, key=repr)


def test_consistent_table(spark):
    body = lambda s: json.dumps({"checks": {"a": {s: "ok" + s, "n": 1}, "b": 3}, "z": 1})
    data = [(i, f"c{i}", n, body("status" if n == 1 else "state" if i % 2 else "status").replace("okstate", "okstatus")) for i in range(6) for n in (1, 2)]
    files = drift.sorted_files(spark.createDataFrame(data, "record_id bigint, component string, phase_no int, body string"))
    names = drift.field_names(drift.compare(files))
    assert names == {"status": "status", "state": "status", "n": "n"}
    got = drift.consistent_table(files, names)
    assert got.columns == ["component", "phase_no", "check_name", "n", "status"] and got.where("status = 'okstatus' and n = '1'").count() == 12


def test_first_names(spark):
    """A check that is renamed along its series keeps its first name; another component's names are its own."""
    def body(n, **checks):
        return json.dumps({"checks": {k: {"s": f"v{v}", "t": f"w{v}", "n": 1} for k, v in checks.items()}})

    series = {"c": [dict(a=1, b=2), dict(a=1, d=2), dict(e=1, d=2), dict(d=1, f=2), dict(d=1, f=2)], "o": [dict(f=1), dict(f=1)]}
    data = [(i * 10 + n, c, n, body(n, **k), "x") for i, (c, files) in enumerate(series.items()) for n, k in enumerate(files)]
    files = drift.sorted_files(spark.createDataFrame(data, "record_id bigint, component string, phase_no int, body string, first string"))
    found = drift.compare(files)
    got = drift.consistent_table(files, drift.field_names(found), first=drift.first_names(found.edits))
    names = {(r.component, r.phase_no, r.check_name): r.first_name for r in got.collect()}
    assert names["c", 1, "d"] == "b" and names["c", 2, "e"] == "a" and names["c", 4, "f"] == names["c", 3, "f"] and names["o", 1, "f"] == "f"
    assert {names["c", 4, "d"], names["c", 4, "f"]} == {"a", "b"} and len(names) == len(series["c"]) * 2 + 2


def test_members_that_meet_in_a_field(spark):
    """Every value of every member is in the table: the field's own name first, the others under their names."""
    bodies = ['{"note": "old", "summary": "new", "n": 1}', '{"note": "alone"}', '{"summary": null, "note": "left"}', '{"text": "t", "note": "s"}', '{"Summary": "S", "text": "u", "summary": "v"}']
    data = [(i, "c", i, f'{{"checks": {{"a": {b}}}}}') for i, b in enumerate(bodies)]
    files = drift.sorted_files(spark.createDataFrame(data, "record_id bigint, component string, phase_no int, body string"))
    got = drift.consistent_table(files, {"note": "summary", "text": "summary", "summary": "summary", "n": "n"})
    assert got.columns[3:] == ["n", "summary", "member_2_Summary", "note", "text"]
    assert [tuple(r)[3:] for r in got.orderBy("phase_no").collect()] == [
        ("1", "new", None, "old", None), (None, "alone", None, None, None), (None, "left", None, None, None), (None, "s", None, None, "t"), (None, "v", "S", None, "u"),
    ]


def test_checks_that_are_no_objects(spark, tmp_path):
    """p1_checks has a row for every check, whatever its type in a file."""
    from graphloom.queries.processing import p1_checks

    bodies = ['{"checks": {"a": {"status": "ok", "check_value": 1}, "b": "ok"}}', '{"checks": {"a": 8.0, "b": {"status": "ok"}, "c": true, "d": [1, "1", {"k": null}], "e": null, "f": "8"}}']
    spark.createDataFrame([(i, "c", i, b) for i, b in enumerate(bodies)], "record_id bigint, component string, phase_no int, body string").write.parquet(f"{tmp_path}/verification_record.parquet")
    got = p1_checks(spark, str(tmp_path))
    assert got.columns == ["component", "phase_no", "check_name", "check_value", "first_name", "member_0_check_value", "status"]
    assert [(*tuple(r)[1:4], *tuple(r)[5:]) for r in got.orderBy("phase_no", "check_name").collect()] == [
        (0, "a", None, "1", "ok"), (0, "b", '"ok"', None, None), (1, "a", "8.0", None, None), (1, "b", None, None, "ok"), (1, "c", "true", None, None),
        (1, "d", '[1, "1", {"k": null}]', None, None), (1, "e", "null", None, None), (1, "f", '"8"', None, None),
    ]


def test_no_files(spark):
    files = drift.sorted_files(spark.createDataFrame([], "record_id bigint, component string, phase_no int, body string"))
    assert drift.changes(files).collect() == [] and drift.consistent_table(files, {}).collect() == []
