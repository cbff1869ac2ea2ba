"""Text for agents: structural chunks, contexts under a byte budget, memory search."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_HEADING = re.compile(r"^(#{1,6})[ \t]+(.*?)[ \t#]*$")
_ITEM = re.compile(r"^[ \t]*(?:[-*+]|\d+[.)])[ \t]+")
_FENCE = re.compile(r"^[ \t]*(```|~~~)")
_MUST = re.compile(r"\b(?:must|shall|required|never|only if)\b", re.I)


class OverBudget(ValueError):
    """Context that must be kept doesn't fit its budget."""


def chunks(text: str) -> list[tuple[str, str, int, int, bool]]:
    """(kind, heading path, first byte, end byte, whether it states a requirement) of each block of a text.

    Kinds: heading, code, list, paragraph. Blocks are parted by blank lines, headings, fences and the
    edges of lists; an open fence ends with the text.
    """
    out: list[tuple[str, str, int, int, bool]] = []
    path: list[tuple[int, str]] = []
    kind, start, body, fence, at = "", 0, [], "", 0

    def close(end: int) -> None:
        nonlocal kind, body
        if kind:
            out.append((kind, " > ".join(t for _, t in path), start, end, bool(_MUST.search("".join(body)))))
        kind, body = "", []

    end = 0
    for line in text.splitlines(keepends=True):
        size = len(line.encode())
        bare = line.rstrip("\r\n")
        edge = _FENCE.match(bare)
        if kind == "code":
            body.append(line)
            end = at + size
            if edge and edge[1] == fence:
                close(end)
        elif edge:
            close(end)
            kind, start, fence, body = "code", at, edge[1], [line]
            end = at + size
        elif m := _HEADING.match(bare):
            close(end)
            while path and path[-1][0] >= len(m[1]):
                path.pop()
            path.append((len(m[1]), m[2]))
            kind, start, body = "heading", at, [line]
            end = at + size
            close(end)
        elif not bare.strip():
            close(end)
        else:
            now = "list" if _ITEM.match(bare) or (kind == "list" and bare[:1] in " \t") else "paragraph"
            if kind != now:
                close(end)
                kind, start = now, at
            body.append(line)
            end = at + size
        at += size
    close(end)
    return out


def sized(parts: list[tuple[str, str, int, int, bool]], raw: bytes, target: int, most: int) -> Iterator[tuple[str, str, int, int, bool]]:
    """Chunks of about `target` bytes and never more than `most`.

    Neighbours of one heading path and kind are put together up to the target; a longer block is cut at the
    last line end before the limit, else at the last blank, else before a whole character.
    """
    held: tuple | None = None
    for kind, path, a, b, must in parts:
        if held and held[:2] == (kind, path) and kind != "heading" and b - held[2] <= target:
            held = (kind, path, held[2], b, held[4] or must)
            continue
        if held:
            yield held
        while b - a > most:
            piece = raw[a : a + most]
            cut = max(piece.rfind(b"\n"), 0) or max(piece.rfind(b" "), 0)
            cut = cut + 1 if cut else most
            while cut > 1 and a + cut < len(raw) and raw[a + cut] & 0xC0 == 0x80:
                cut -= 1
            yield kind, path, a, a + cut, bool(_MUST.search(raw[a : a + cut].decode("utf-8", "replace")))
            a += cut
        held = (kind, path, a, b, must)
    if held:
        yield held


def chunk_text(df: DataFrame, key: str, text: str, target: int | None = None, most: int | None = None) -> DataFrame:
    """(key, ordinal, kind, heading_path, byte_start, byte_end, requirement); null and blank texts have no chunks.

    target and most: bytes of a chunk, of sized(); without them every block is a chunk.
    """
    kind = df.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, *c) for k, t in zip(pdf.k, pdf.t, strict=True) for i, c in enumerate(chunks(t) if most is None else sized(chunks(t), t.encode(), target or most, most))]
            yield pd.DataFrame(rows, columns=["k", "ordinal", "kind", "heading_path", "byte_start", "byte_end", "requirement"])

    out = df.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(cut, f"k {kind}, ordinal int, kind string, heading_path string, byte_start bigint, byte_end bigint, requirement boolean")
    return out.withColumnRenamed("k", key)


def reduce_context(df: DataFrame, key: str, ordinal: str, size: str, mandatory: str, budget: int, optional: int | None = None, refusals: bool = False) -> DataFrame:
    """Chunks kept for each key: the mandatory ones, then the others in order as long as each fits.

    The others have what mandatory chunks leave of the budget, and no more than `optional` if that is given.
    A key whose mandatory chunks go beyond the budget has no context: it fails the query, or with `refusals`
    it alone is refused, as one row of the key and the size of those chunks with nulls elsewhere. Keys pass
    in order through a task that holds the chunks of one, those of one text, and a batch.
    """

    def decide(t: pa.Table) -> pa.Table:
        keep, refused, i = [], [], 0
        keys, sizes, musts = (t[c].to_pylist() for c in (key, size, mandatory))
        while i < len(keys):
            end = next((j for j in range(i + 1, len(keys)) if keys[j] != keys[i]), len(keys))
            needed = sum(n for must, n in zip(musts[i:end], sizes[i:end], strict=True) if must and n is not None)
            if needed > budget and not refusals:
                raise OverBudget(f"mandatory chunks of {keys[i]} take {needed} of {budget} bytes")
            if needed > budget:
                refused.append({key: keys[i], size: needed})
                keep += [False] * (end - i)
            else:
                left = budget - needed if optional is None else min(budget - needed, optional)
                for must, n in zip(musts[i:end], sizes[i:end], strict=True):
                    fits = bool(must) or (n is not None and n <= left)
                    left -= 0 if must or not fits else n
                    keep.append(fits)
            i = end
        return pa.concat_tables([t.filter(pa.array(keep, pa.bool_())), pa.Table.from_pylist(refused, schema=t.schema)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch[key].to_pylist()
            first = next((i for i in range(len(keys) - 1, 0, -1) if keys[i] != keys[i - 1]), 0)
            if held and (first or keys[0] != held[-1][key][0].as_py()):
                yield from decide(pa.Table.from_batches([*held, batch.slice(0, first)])).to_batches()
                held = []
            elif first:
                yield from decide(pa.Table.from_batches([batch.slice(0, first)])).to_batches()
            held.append(batch.slice(first))
        if held:
            yield from decide(pa.Table.from_batches(held)).to_batches()

    schema = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema])
    return df.repartition(key).sortWithinPartitions(key, ordinal).mapInArrow(scan, schema)


def visible_memories(df: DataFrame, subject: str, now_ms: int, memory_class: str | None = None) -> DataFrame:
    """Memories that a subject may be shown: shared with the tenant or its own, of the class, not expired, and in a state that serves answers."""
    state = F.when(F.col("memory_class") == "SEMANTIC", F.col("state") == "PUBLISHED").otherwise(F.col("state").isin("VALIDATED", "APPROVED", "PUBLISHED"))
    seen = ((F.col("audience") == "TENANT") | (F.col("owner_subject") == subject)) & state & (F.col("expires_at_epoch_ms").isNull() | (F.col("expires_at_epoch_ms") > now_ms))
    return df.where(seen if memory_class is None else seen & (F.col("memory_class") == memory_class))


def memory_search(df: DataFrame, text: str, words: Sequence[str], order: Sequence[Column], limit: int) -> DataFrame:
    """The rows with all query words that have most of them, ties by order: a top-k report.

    score is how often the words occur; without words every row has a score of 0. Case makes no difference.
    """
    held = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+")
    wanted = F.array(*[F.lit(w) for w in dict.fromkeys(w.lower() for w in words)]).cast("array<string>")
    all_ = F.size(F.array_except(wanted, held)) == 0
    found = df.withColumn("__held", held).where(all_).withColumn("score", F.size(F.filter("__held", lambda w: F.array_contains(wanted, w))).cast("bigint"))
    return found.drop("__held").orderBy(F.col("score").desc(), *order).limit(limit)
