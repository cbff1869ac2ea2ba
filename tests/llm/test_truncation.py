import pytest

from graphloom.llm import truncation

SENTENCES = ["The lease keeper was restarted twice.", "Latency rose to 60.7 ms, and the index was rebuilt.", "The count stayed at 87956.", "Why was the graph merged?", "Nothing changed!", '"It was sealed."']
CODE = "```sparql\nSELECT ?s WHERE { ?s ?p ?o }\nLIMIT 10\n```"
ENDS = ["- cold gate: blocked", "- warm lane: passed", "- wide map: waived", "Status: passed", "Regards,\nthe audit reader", "-- night desk, second shift", "Thanks"]


@pytest.fixture(scope="module")
def judged(spark):
    data, n = [], 0

    def add(text, source="free"):
        nonlocal n
        n += 1
        data.append((n, text, source, True))
        return n

    for i in range(400):
        body = " ".join(SENTENCES[(i + k) % 6] for k in range(3 + i % 40))
        end = ENDS[i % len(ENDS)]
        tail = "\n".join([f"- cold gate: {v}" for v in ("passed", "blocked", "waived")][: 1 + i % 3]) + "\n" + end if end.startswith("-") and ":" in end else end
        add(f"# Note {i}\n{body}\n\n{tail}" if i % 2 else f"# Note {i}\n{body}" + (f"\n\n{CODE}" if i % 4 else ""))
    limited = [add((f"Case {i}. " + " ".join(SENTENCES[(i + k) % 6] for k in range(60)))[:500], "limited") for i in range(60)] + [add(f"Case {i}. " + " ".join(SENTENCES[: 1 + i % 5]), "limited") and 0 for i in range(60)]
    body = "The lease keeper was restarted twice. "
    cuts = {
        "word": body + "The lease kee", "sentence": body + "The lease keeper was ", "entry": "- cold gate: passed\n- warm lane: pas", "entry without value": "- cold gate: passed\n- warm lane", "code": f"{body}\n{CODE[:-4]}", "fence": f"{body}\n{CODE[:-1]}",
        "mark": body + "The lease kee…", "dots": body + "The lease kee...", "more": body + "The lease kee [more]", "decimal": body + "Latency rose to 60.", "item": body + "\n1. Done.\n2.", "signature": body + "\n\nThan", "tag": body + "The lease <em", "status": body + "\nStatus: pas",
    }
    ids = {name: add(t) for name, t in cuts.items()}
    whole = [add(None), add(""), add(" \n"), add(body + "Done at 87956.\n\n"), add(body + "The count stayed at 5."), add(body + "\n- cold gate: waived\n"), add(body, None), add("word " * 50_000 + "end.")]
    df = spark.createDataFrame(data, "doc_id bigint, text string, source string, cut boolean")
    found = truncation.endings(df, "doc_id", "text", "source")
    return found, {r.doc_id: r for r in found.texts.collect()}, ids, whole, [x for x in limited if x], {d[0]: d[1] for d in data}


def test_cuts(judged):
    _, got, ids, whole, _, _ = judged
    assert [name for name, i in ids.items() if not got[i].cut] == []
    assert [i for i in whole[:3] + whole[4:] if got[i].cut] == []


def test_proper_ends(judged):
    _, got, _, _, _, texts = judged
    assert [(i, texts[i][-40:]) for i in range(1, 401) if got[i].cut] == []


def test_limit(judged):
    found, got, _, _, limited, texts = judged
    spikes = {(r.source, r.unit, r.length) for r in found.spikes.collect()}
    assert ("limited", "chars", 500) in spikes and all(got[i].at_spike for i in limited)
    stop = (".", "?", "!", '"')
    assert all(got[i].cut for i in limited if not texts[i].endswith(stop))
    row = {r.source: r for r in truncation.per_source(found).collect()}["limited"]
    assert row.n_texts == 120 and "chars:500" in row.limits and row.n_cut == row.n_cut_at_limit > 40


def judge(spark, rows):
    found = truncation.endings(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), "doc_id", "text", "source")
    return {r.doc_id: r.cut for r in found.texts.collect()}


def test_a_long_closing_line(spark):
    line = "Sent on behalf of the duty officers of the northern and the southern region"
    assert len(line) > 60
    got = judge(spark, [(i, f"Report {i} was read{' again' * (i % 9)}.\n\n{line}", "mail") for i in range(50)] + [(99, "Report 7 was read.\n\n" + line[:-9], "mail")])
    assert [i for i, cut in got.items() if cut] == [99]


def test_other_texts_change_nothing(spark):
    few = [(i, f"Case {'x' * i} was closed.\n\nGreetings from the archive", "a") for i in range(4)] + [(10, "Case y was closed.\n\nGreetings from the arc", "a"), (11, "The rate rose to 6.", "a"), (12, "The rate rose to 6.5 again.", "a")]
    many = [(100 + i, f"Entry {i} is whole and says so{' indeed' * (i % 200)}.", "b") for i in range(20_000)]
    alone, among = judge(spark, few), judge(spark, few + many)
    assert alone == {k: v for k, v in among.items() if k < 100} == {0: False, 1: False, 2: False, 3: False, 10: True, 11: True, 12: False}


def test_reasons_and_the_maximum(spark):
    body = " ".join(SENTENCES * 9)
    rows = [(i, (f"Case {i}. " + body)[:500], "limited") for i in range(40)] + [(100 + i, f"Case {i}. " + body[: 100 + 7 * i], "free") for i in range(40)]
    rows += [(200 + i, f"Case {1000 + i}. Nothing changed!", "free") for i in range(12)]  # equal lengths, but others are longer
    found = truncation.endings(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), "doc_id", "text", "source")
    assert {(r.source, r.length) for r in found.spikes.collect()} == {("limited", 500)}
    got = {r.doc_id: (r.cut, r.reason) for r in found.texts.collect()}
    assert all(r == (cut, ("limit" if i < 100 else "transfer") if cut else None) for i, r in got.items() for cut in [r[0]])
    assert sum(r[0] for i, r in got.items() if i < 100) > 25 and not any(r[0] for i, r in got.items() if i >= 200)


def test_empty(spark):
    found = truncation.endings(spark.createDataFrame([], "doc_id bigint, text string, source string"), "doc_id", "text", "source")
    assert found.texts.collect() == [] and truncation.per_source(found).collect() == []
