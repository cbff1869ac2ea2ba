import random

import pytest
from pyspark.sql import functions as F

from graphloom.llm import leaks

WORDS = [f"{a}{b}" for a in "bcdfg" for b in ("ar", "el", "im", "on", "us")]
DOCS, ITEMS = "doc_id bigint, text string, docs int, d string", "item_id bigint, text string, items int"


def places(spark, docs, items, least=12):
    d = spark.createDataFrame([(*r, 7, "x") for r in docs], DOCS).repartition(3)
    i = spark.createDataFrame([(*r, 7) for r in items], ITEMS)
    return leaks.search(leaks.index(d, least=least), i, least=least)


def found(spark, docs, items, least=12):
    return {(r.doc_id, r.item_id): (r.n_words, r.doc_word, r.item_word) for r in leaks.longest(places(spark, docs, items, least)).collect()}


def brute_places(docs, items, least):
    """Every maximal match, each line-end hyphen read both ways at every step."""
    out = set()
    for d, t in docs:
        a, breaks = leaks.pieces(t)
        for i, u in items:
            b, _ = leaks.pieces(u)
            after = {}  # (x, y) -> next, and back

            def step(x, y):
                if y >= len(b) or x >= len(a):
                    return None
                w = a[x]
                k = x
                while True:
                    if w == b[y]:
                        return k + 1, y + 1
                    if k not in breaks:
                        return None
                    k += 1
                    w += a[k]

            for x in range(len(a)):
                for y in range(len(b)):
                    if n := step(x, y):
                        after[x, y] = n
            for s in set(after) - set(after.values()):
                e, n = s, 0
                while e in after:
                    e, n = after[e], n + 1
                if n >= least:
                    out.add((d, i, n, s[0], s[1]))
    return out


def longest_of(rows):
    best = {}
    for d, i, n, x, y in rows:
        if (d, i) not in best or (-n, x, y) < best[d, i]:
            best[d, i] = (-n, x, y)
    return {k: (-v[0], v[1], v[2]) for k, v in best.items()}


def broken(r, words):
    """Words in a row, some with a line-end hyphen inside or between."""
    out = words[0]
    for w in words[1:]:
        out += r.choice([" ", " ", " ", "-\n", "-\n> "]) + w
    return "".join(c + "-\n" if r.random() < 0.03 and c.isalpha() else c for c in out)


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("hyphens", [False, True])
def test_against_brute_force(spark, monkeypatch, small, hyphens):
    r = random.Random(2)
    some = WORDS[:5] + [WORDS[0] + WORDS[1], WORDS[2] + WORDS[3]] if hyphens else WORDS[:6]
    docs = [(k, broken(r, ws) if hyphens and ws else " ".join(ws)) for k in range(40) for ws in [[r.choice(some + ["zz"]) for _ in range(r.randrange(60))]]]
    items = [(k, " ".join(r.choice(some) for _ in range(r.randrange(4, 30)))) for k in range(12)] + [(50, " ".join(leaks.pieces(docs[3][1])[0]).replace("zz", "bar")), (51, " ".join(leaks.joined(*leaks.pieces(docs[4][1]))[0]))]
    want = brute_places(docs, items, 4)
    if small:
        monkeypatch.setattr(leaks, "BLOCK_CHARS", 60)
        monkeypatch.setattr(leaks, "BROADCAST_CHARS", 0)
        monkeypatch.setattr(leaks, "SHARD_WORDS", 40)
        monkeypatch.setattr(leaks, "PLACES", 3)
    got = {tuple(x) for x in places(spark, docs, items, 4).collect()}
    assert len(want) > 20 and got == want
    assert found(spark, docs, items, 4) == longest_of(want)


ITEM = "Trace how closed-world Alpha shadows Beta across 42 steps when role cycle and inverse chain of Gamma coincide"


@pytest.mark.parametrize(
    "text",
    [
        "Intro. " + ITEM.upper() + " end", ITEM.replace(" ", "\n> "), ITEM.replace("shadows", "sha-\n  dows").replace("closed-world", "closed-\nworld"), ITEM.replace("Alpha", "**Alpha**").replace("how", "<em>how</em>"),
        ITEM.replace("a", "a​").replace(" ", "  "), ITEM.replace("role", "ro­le"), "> " + ITEM.replace("steps when", "st-\n> eps, when;"), ITEM.replace(" ", "<br/>"), ITEM.replace("Beta", "[Beta](http://x.y/z)").replace("how", "&quot;how&quot;"),
        ITEM.replace("shadows", "sha-\ndo-\nws"), ITEM.replace("inverse", "in-\r\nverse").replace("closed-world", "closed-\nworld"),
    ],
)
def test_layout_makes_no_difference(spark, text):
    assert found(spark, [(1, text)], [(1, ITEM)])[1, 1][0] == len(leaks.pieces(ITEM)[0])


def test_other_items_change_nothing(spark):
    docs = [(1, ITEM.replace("closed-world", "closed-\nworld")), (2, ITEM.replace("closed-world", "closedworld"))]
    alone = found(spark, docs, [(1, ITEM)])
    more = found(spark, docs, [(1, ITEM), (2, "closedworld closed world " * 9), (3, ITEM.replace("closed-world", "closedworld"))])
    assert alone[1, 1][0] == 19 and {k: v for k, v in more.items() if k[1] == 1} == alone
    assert more[1, 3][0] == more[2, 3][0] == 18  # the same text answers both readings


def test_eleven_words_or_another_order_are_none(spark):
    w = ITEM.split()
    assert found(spark, [(1, " ".join(w[:10])), (2, " ".join(reversed(w))), (3, None), (4, ""), (None, ITEM)], [(1, ITEM), (2, None), (3, ""), (None, ITEM)]) == {}


def test_all_places(spark):
    got = sorted(tuple(x) for x in places(spark, [(1, f"{ITEM} x {ITEM}")], [(1, ITEM)]).collect())
    assert got == [(1, 1, 19, 0, 0), (1, 1, 19, 20, 0)]


def test_kept_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, ITEM), (2, "other words")], "doc_id bigint, text string")
    leaks.index(docs).write.parquet(str(tmp_path / "index"))
    got = leaks.search(spark.read.parquet(str(tmp_path / "index")), spark.createDataFrame([(1, ITEM)], "item_id bigint, text string"))
    assert [r.doc_id for r in got.collect()] == [1]


def test_long_texts_copies_and_empty_tables(spark):
    long = "filler word " * 60_000 + ITEM + " filler" * 1000
    assert set(found(spark, [(1, long), (2, ITEM), (2, ITEM), (3, ITEM), (4, "a-\n" * 3000 + ITEM)], [(1, ITEM), (2, ITEM)])) == {(d, i) for d in (1, 2, 3, 4) for i in (1, 2)}
    assert found(spark, [], [(1, ITEM)]) == {} and found(spark, [(1, ITEM)], []) == {}
    same = places(spark, [(2, ITEM), (2, ITEM)], [(1, ITEM), (1, ITEM)])
    assert same.count() == 1 and same.where(F.col("n_words") == 19).count() == 1
