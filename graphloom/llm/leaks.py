"""Evaluation passages inside a training corpus, found with a kept suffix array of the corpus.

Texts are brought to words that no layout changes. The corpus is indexed once, as shards: the words of
some documents and the order of all their suffixes, by their first words. The index knows no test item
and can be kept as a table. Every suffix of every item is then searched by bisection in every shard,
which gives all places where it matches, and matches are extended to their full length.

A hyphen at a line's end may stand inside a word or between two. Both readings are indexed: the words
apart, and all such words joined; a match that needs both is found from each of its joined words.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 12
#: Words of a shard, about; characters of a block of items; places of matches held at once.
SHARD_WORDS, BLOCK_CHARS, PLACES = 400_000, 2_000_000, 1_000_000
#: Characters of all items up to which their blocks are broadcast.
BROADCAST_CHARS = 20_000_000

_INVISIBLE = re.compile("[­͏؜᠎​-‏‪-‮⁠-⁤⁦-⁯﻿]")
_BLOCK_TAG = re.compile(r"</?(?:p|br|div|li|ul|ol|tr|td|th|table|h[1-6]|hr|pre|blockquote|section)(?:\s[^<>]*)?/?>", re.I)
_TAG = re.compile(r"</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?/?>")
_LINK = re.compile(r"\]\([^()\s]*\)")
_QUOTE = re.compile(r"^[ \t]*(?:>[ \t]?)+", re.M)
_JOINT = "\x1f"
_BREAK = re.compile("(?<=[^\\W_])[-‐‑][ \\t]*(?:\\r\\n|[\\n\\r\\x0b\\x0c\\x85  ])[ \\t]*(?=[^\\W_])")
_WORD = re.compile(r"[^\W_]+")
_WORD_JOINT = re.compile(rf"[^\W_]+{_JOINT}?")
_ENTITY = re.compile(r"&(?:#\d+|#x[0-9a-f]+|[a-z]+\d*);", re.I)

INDEX = "docs array<{kind}>, starts binary, text binary, names binary, joined binary, base binary, glue binary, suffixes binary"
BLOCK = "items array<{kind}>, begin binary, owner binary, tests binary, place binary"


def pieces(text: str | None) -> tuple[list[str], list[int]]:
    """Lower-case words of a text without markup, invisible characters and quote marks, and the numbers of those that a line-end hyphen follows."""
    if not text:
        return [], []
    text = text.lower()
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
    if "&" in text:
        text = _ENTITY.sub(lambda m: html.unescape(m[0]), text)
    if "<" in text:
        text = _TAG.sub("", _BLOCK_TAG.sub(" ", text))
    if "](" in text:
        text = _LINK.sub("]", text)
    if ">" in text:
        text = _QUOTE.sub("", text)
    text = _BREAK.sub(_JOINT, text.replace(_JOINT, " "))
    if _JOINT not in text:
        return _WORD.findall(text), []
    found = _WORD_JOINT.findall(text)
    return [w.rstrip(_JOINT) for w in found], [i for i, w in enumerate(found) if w[-1] == _JOINT]


def joined(words: list[str], breaks: list[int]) -> tuple[list[str], list[int]]:
    """The words with all line-end hyphens taken for breaks inside a word, and where each begins in the words apart."""
    after, out, at = set(breaks), [], []
    for i, w in enumerate(words):
        if i - 1 in after:
            out[-1] += w
        else:
            out.append(w)
            at.append(i)
    return out, at


class _Names:
    """Words as positive 63-bit numbers that are the same everywhere."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, words: list[str]) -> list[int]:
        known = self.known
        if len(known) > 1_000_000:
            known.clear()
        out = []
        for w in words:
            n = known.get(w)
            if n is None:
                n = known[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big") >> 1 or 1
            out.append(n)
        return out


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Places where `depth` words without a break (0) begin, ordered by those words and on, to a power of two at least depth."""
    rank = text.astype(np.int64)
    step = 1
    while step < depth:
        after = np.zeros_like(rank)
        after[:-step] = rank[step:]
        rank = np.unique(rank * (rank.max() + 1) + after, return_inverse=True)[1] if len(rank) else rank
        step *= 2
    known = np.concatenate(([0], np.cumsum(text > 0)))
    starts = np.arange(max(0, len(text) - depth + 1))
    starts = starts[known[starts + depth] - known[starts] == depth]
    return starts[np.argsort(rank[starts], kind="stable")]


def bisect(text: np.ndarray, order: np.ndarray, queries: np.ndarray, right: bool) -> np.ndarray:
    """For each query, a row of words, the first place in the order that isn't before it (right: that is after it)."""
    lo, hi = np.zeros(len(queries), np.int64), np.full(len(queries), len(order), np.int64)
    at = np.arange(queries.shape[1])
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        there = text[order[np.minimum(mid, len(order) - 1)][:, None] + at]
        differ = there != queries
        first = np.argmax(differ, axis=1)
        a, b = there[np.arange(len(queries)), first], queries[np.arange(len(queries)), first]
        below = (a <= b if right else a < b) & open_
        lo, hi = np.where(below, mid + 1, lo), np.where(open_ & ~below, mid, hi)
    return lo


def _ints(raw: bytes, kind: type = np.int32) -> np.ndarray:
    return np.frombuffer(raw, kind)


def _shard(ids: list, texts: list[tuple[list[str], list[int]]], names: _Names, least: int) -> dict:
    """One row of the index. text: words apart, 0 after each document; joined and base: the other reading of
    documents with line-end hyphens, and its places in text; glue: (place, words, joined word) of pairs and longer runs."""
    starts, whole, other, base, glue, at = [], [], [], [], [], 0
    for words, breaks in texts:
        starts.append(at)
        whole += [*names(words), 0]
        if breaks:
            more, places = joined(words, breaks)
            other += [*names(more), 0]
            base += [*[at + p for p in places], -1]
            glue += [(at + i, 2, *names([words[i] + words[i + 1]])) for i in breaks]
            glue += [(at + p, q - p, *names([w])) for w, p, q in zip(more, places, [*places[1:], len(words)], strict=True) if q - p > 2]
        at += len(words) + 1
    marks = np.array(glue, np.int64).reshape(-1, 3)
    known, codes = np.unique(np.concatenate([np.array(whole, np.int64), np.array(other, np.int64), marks[:, 2], [0]]), return_inverse=True)
    codes = codes.astype(np.int32)
    both = codes[: len(whole) + len(other)]
    marks[:, 2] = codes[len(both) : -1]
    parts = {"starts": np.array(starts, np.int32), "text": both[: len(whole)], "names": known, "joined": both[len(whole) :], "base": np.array(base, np.int32), "glue": marks.astype(np.int32), "suffixes": suffix_array(both, least).astype(np.int32)}
    return {"docs": ids} | {k: v.tobytes() for k, v in parts.items()}


def index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = MIN_WORDS) -> DataFrame:
    """The corpus as sharded suffix arrays, one row a shard; for matches of at least `least` words.

    Rows with a null id or text have no part in it. Each task indexes what it reads; nothing is shuffled.
    The result depends on the corpus alone and may be written as a table and searched again and again.
    """
    rows = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).where("d is not null and t is not null")

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, ids, held, n = _Names(), [], [], 0
        for pdf in batches:
            for d, t in zip(pdf.d, pdf.t, strict=True):
                words, breaks = pieces(t)
                if len(words) < least:
                    continue  # joined words are fewer still
                ids.append(d)
                held.append((words, breaks))
                n += len(words) + 1
                if n >= SHARD_WORDS:
                    yield pd.DataFrame([_shard(ids, held, names, least)])
                    ids, held, n = [], [], 0
        if held:
            yield pd.DataFrame([_shard(ids, held, names, least)])

    return rows.mapInPandas(build, INDEX.format(kind=docs.schema[doc_id].dataType.simpleString()))


def item_blocks(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """The items as rows of bounded size; their words are never on the driver.

    An item's own line-end hyphens are read apart and, in a second reading of the item, joined.
    """
    kind = items.schema[item_id].dataType.simpleString()
    rows = items.select(F.col(item_id).alias("i"), F.col(text).alias("t")).where("i is not null and t is not null")
    chars = rows.agg(F.sum(F.char_length("t")).alias("n")).first().n or 0

    def block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, size = _Names(), 0
        ids, begin, owner, tests, place = [], [], [], [], []

        def row() -> pd.DataFrame:
            return pd.DataFrame([{"items": ids, "begin": np.array(begin, np.int32).tobytes(), "owner": np.array(owner, np.int32).tobytes(), "tests": np.array(tests, np.int64).tobytes(), "place": np.array(place, np.int32).tobytes()}])

        for pdf in batches:
            for i, t in zip(pdf.i, pdf.t, strict=True):
                words, breaks = pieces(t)
                for reading, at in [(words, list(range(len(words))))] + ([joined(words, breaks)] if breaks else []):
                    begin.append(len(tests))
                    owner.append(len(ids))
                    tests += [*names(reading), 0]
                    place += [*at, -1]
                ids.append(i)
                size += len(t)
                if size >= BLOCK_CHARS:
                    yield row()
                    ids, begin, owner, tests, place, size = [], [], [], [], [], 0
        if ids:
            yield row()

    blocks = rows.repartition(max(1, -(-chars // BLOCK_CHARS))).mapInPandas(block, BLOCK.format(kind=kind))
    return F.broadcast(blocks) if chars <= BROADCAST_CHARS else blocks


class _Lattice:
    """Words of a shard with the ways to read line-end hyphens, and its extension of matches."""

    def __init__(self, text: np.ndarray, glue: np.ndarray):
        self.text, self.layers = text, []
        for part in (glue[glue[:, 1] == 2], glue[glue[:, 1] > 2]):
            if len(part):
                code, span, code_end, span_end = (np.zeros(len(text) + 1, np.int32) for _ in range(4))
                code[part[:, 0]], span[part[:, 0]] = part[:, 2], part[:, 1]
                code_end[part[:, 0] + part[:, 1]], span_end[part[:, 0] + part[:, 1]] = part[:, 2], part[:, 1]
                self.layers.append((code, span, code_end, span_end))

    def extend(self, tests: np.ndarray, p: np.ndarray, q: np.ndarray, right: bool) -> tuple[np.ndarray, np.ndarray]:
        """The ends, or beginnings, of the matches through p and q; at each word at most one reading agrees with the item."""
        p, q, going = p.copy(), q.copy(), np.arange(len(p))
        while len(going):
            a, w = p[going], tests[q[going] if right else q[going] - 1]  # tests[-1] is a break
            step = ((self.text[a] if right else self.text[a - 1]) == w).astype(np.int32)
            for code, span, code_end, span_end in self.layers:
                c, s = (code[a], span[a]) if right else (code_end[a], span_end[a])
                step = np.where((step == 0) & (s > 0) & (c == w), s, step)
            step[w == 0] = 0
            on = step > 0
            going, step = going[on], step[on]
            p[going] += step if right else -step
            q[going] += 1 if right else -1
        return p, q


def _search(shard, block, least: int) -> pd.DataFrame:
    names, text = _ints(shard.names, np.int64), _ints(shard.text)
    tests = _ints(block.tests, np.int64)
    code = np.minimum(np.searchsorted(names, tests), len(names) - 1)
    tests = np.where(names[code] == tests, code, 0).astype(np.int32)  # names[0] is 0, the break
    both, base, order = np.concatenate([text, _ints(shard.joined)]), _ints(shard.base), _ints(shard.suffixes)
    glue = _ints(shard.glue).reshape(-1, 3)
    lattice, found = _Lattice(text, glue), []

    def keep(p: np.ndarray, q: np.ndarray) -> None:
        p0, q0 = lattice.extend(tests, p, q, False)
        _, q1 = lattice.extend(tests, p, q, True)
        rows = np.stack([p0, q0, q1 - q0], 1)
        found.append(np.unique(rows[rows[:, 2] >= least], axis=0))

    def spread(lo: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For slices of the queries: which query each place belongs to, and the place in the order; about PLACES at once."""
        edge = np.concatenate(([0], np.cumsum(n)))
        a = 0
        while a < len(n):
            b = max(a + 1, int(np.searchsorted(edge, edge[a] + PLACES, "right")) - 1)
            of = np.repeat(np.arange(a, b), n[a:b])
            yield of, np.arange(edge[a], edge[b]) - edge[of] + lo[of]
            a = b

    starts = suffix_array(tests, least)
    if len(starts) and len(order):
        queries = tests[starts[:, None] + np.arange(least)]
        lo, hi = bisect(both, order, queries, False), bisect(both, order, queries, True)
        some = hi > lo
        starts, lo, n = starts[some], lo[some], (hi - lo)[some]
        for of, at in spread(lo, n):
            p, q = order[at].astype(np.int64), starts[of]
            first = (p == 0) | (q == 0) | (both[p - 1] != tests[q - 1]) | (both[p - 1] == 0)
            p, q = p[first], q[first]
            keep(np.where(p < len(text), p, base[np.maximum(p - len(text), 0)] if len(base) else p), q)
    near = np.unique(glue[:, 0])
    if len(near) > 1:  # matches that read one hyphen so and another so
        gap = np.diff(near) <= 2 * least
        mixed = glue[np.isin(glue[:, 0], near[np.concatenate(([False], gap)) | np.concatenate((gap, [False]))])]
        by = np.argsort(tests, kind="stable")
        lo, hi = np.searchsorted(tests[by], mixed[:, 2], "left"), np.searchsorted(tests[by], mixed[:, 2], "right")
        for of, at in spread(lo, hi - lo):
            keep(mixed[of, 0].astype(np.int64), by[at])
    rows = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)
    doc = np.searchsorted(_ints(shard.starts), rows[:, 0], "right") - 1
    run = np.searchsorted(_ints(block.begin), rows[:, 1], "right") - 1
    owner = _ints(block.owner)[run]
    return pd.DataFrame({
        "doc_id": [shard.docs[i] for i in doc], "item_id": [block.items[i] for i in owner], "n_words": rows[:, 2],
        "doc_word": rows[:, 0] - _ints(shard.starts)[doc], "item_word": _ints(block.place)[rows[:, 1]],
    })


def search(shards: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", least: int = MIN_WORDS) -> DataFrame:
    """All places where a document and an item share at least `least` words in a row, each at its full length.

    shards: of index(), made for the same `least`. Columns: doc_id, item_id, n_words, doc_word and
    item_word, counted from 0 with the halves of a word at a line-end hyphen counted apart; n_words counts
    the item's words. Null or empty texts match nothing, rows with a null id are left out, and rows that
    repeat an id and text give it one row. Which other items or documents there are changes nothing. The
    items, in blocks of bounded size, meet every shard; only matches leave a task.
    """
    kinds = shards.schema["docs"].dataType.elementType.simpleString(), items.schema[item_id].dataType.simpleString()

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                yield _search(row, row, least)

    met = shards.crossJoin(item_blocks(items, item_id, text))  # the stated test items, in blocks, against all shards
    out = met.mapInPandas(each, f"doc_id {kinds[0]}, item_id {kinds[1]}, n_words int, doc_word int, item_word int")
    return out.distinct().select(F.col("doc_id").alias(doc_id), F.col("item_id").alias(item_id), "n_words", "doc_word", "item_word")


def longest(places: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """Of search(): the longest match of each document and item; of equally long ones the first."""
    best = F.min(F.struct((-F.col("n_words")).alias("n"), "doc_word", "item_word")).alias("b")
    return places.groupBy(doc_id, item_id).agg(best).select(doc_id, item_id, (-F.col("b.n")).alias("n_words"), "b.doc_word", "b.item_word")
