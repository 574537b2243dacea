"""Benchmark decontamination by pigeonhole edit matching.

Texts are lower-cased and runs of white space become one blank. An item of m
characters may differ in ``k = floor(RATE * m)`` edits, so it is cut into k + 1
pieces of about equal length: whatever text holds the item with k edits or
fewer holds one piece exactly. An automaton finds all pieces in one pass over
the text; around each hit, Myers' bit-parallel recurrence gives the least edit
distance between the item and any part of the text.

Items that are null or blank match nothing. Items of fewer than ``SHORTEST``
characters, which ordinary text is full of, are held only by a document that
says nothing else. Items with the same text are all reported, and ids may be of
any type, null too. Items are a query set of stated size: they are dealt into
blocks of ``BLOCK_CHARS`` characters, each searched for in one pass over the
documents; a worker process holds the automaton of one block at a time (about
55 bytes a character) and keeps it from task to task. Null and empty documents
hold nothing. Repeated rows are reported each; extra columns are ignored. Ties
between places go to the first end. Very long texts are searched whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from fluxlane.llm.common import checkpoint, in_batches

#: Edits allowed for each character of an item.
RATE = 0.05
#: Characters of items that one pass looks for, about.
BLOCK_CHARS = 1 << 21
#: Characters of an item that is looked for inside of texts.
SHORTEST = 8


def normalized(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece) of the budget + 1 pieces, as equal in length as can be."""
    n = min(budget + 1, len(item))
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: str, text: str, budget: int) -> tuple[int, int] | None:
    """(least distance of the pattern to a part of the text, that part's first end), if within budget."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | (1 << i)
    every, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = every, 0, m, None
    if m <= budget:
        best = (m, 0)
    for at, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        x = eq | minus
        d = (((eq & plus) + plus) ^ plus) | eq
        hp = minus | ~(d | plus) & every
        hm = plus & d
        if hp & top:
            score += 1
        elif hm & top:
            score -= 1
        hp = (hp << 1) & every  # the pattern may start anywhere
        hm = (hm << 1) & every
        plus = hm | ~(x | hp) & every
        minus = hp & x
        if score <= budget and (best is None or score < best[0]):
            best = (score, at)
    return best


class Matcher:
    """An automaton of the pieces of normalized items."""

    def __init__(self, items: list[str], rate: float = RATE) -> None:
        self.items = items
        self.budgets = [int(rate * len(x)) for x in items]
        self.short: dict[str, list[int]] = {}
        at: dict[str, list[tuple[int, int]]] = {}
        for k, (x, budget) in enumerate(zip(items, self.budgets, strict=True)):
            if len(x) < SHORTEST:
                self.short.setdefault(x, []).append(k)
                continue
            for offset, piece in pieces(x, budget):
                at.setdefault(piece, []).append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in at.items():
            self.automaton.add_word(piece, (len(piece), where))
        if at:
            self.automaton.make_automaton()
        self.any = bool(at)

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item, distance, end in the normalized text) of each item that the text holds."""
        if not text:
            return []
        out = [(k, 0, len(text)) for k in self.short.get(text, ())]
        if not self.any:
            return out
        starts: dict[int, list[int]] = {}
        for end, (length, where) in self.automaton.iter(text):
            for k, offset in where:
                starts.setdefault(k, []).append(end + 1 - length - offset)
        for k in sorted(starts):
            if hit := self._verify(text, k, sorted(set(starts[k]))):
                out.append((k, *hit))
        return sorted(out)

    def _verify(self, text: str, k: int, starts: list[int]) -> tuple[int, int] | None:
        item, budget = self.items[k], self.budgets[k]
        if (at := text.find(item)) >= 0:
            return 0, at + len(item)
        best, i = None, 0
        while budget and i < len(starts):
            # hits whose windows meet are looked at together
            first = last = starts[i]
            while i < len(starts) and starts[i] <= last + 2 * budget + len(item):
                last, i = starts[i], i + 1
            a = max(0, first - budget)
            hit = myers(item, text[a : last + len(item) + budget], budget)
            if hit and (best is None or hit[0] < best[0]):
                best = (hit[0], a + hit[1])
        return best


#: The automaton that this worker process made last, by the name of its block.
_MADE: dict[str, Matcher] = {}


def matcher_of(name: str, items: list[str], rate: float) -> Matcher:
    """The matcher of the block ``name``, made once a worker process."""
    if name not in _MADE:
        _MADE.clear()
        _MADE[name] = Matcher(items, rate)
    return _MADE[name]


def item_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[tuple[list[str], list[list]]]:
    """Blocks of (normalized distinct texts, item ids of each), each of bounded size."""
    known = benchmark.select("item_id", F.col("text").cast("string").alias("text")).filter(F.trim(F.regexp_replace("text", r"\s+", " ")) != "")
    total = known.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-total // block_chars)
    for n in range(blocks):
        by: dict[str, list] = {}
        block = known.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == n)
        for x in block.toLocalIterator():
            if text := normalized(x["text"]):
                by.setdefault(text, []).append(x["item_id"])
        if by:
            names = sorted(by)
            yield names, [sorted(by[x], key=lambda i: (i is None, i)) for x in names]


def leaks(documents: DataFrame, benchmark: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, distance and stop (in the normalized text) of each item that a document holds."""
    chosen = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    named = benchmark.select("item_id")
    schema = f"doc_id {dict(chosen.dtypes)['doc_id']}, item_id {dict(named.dtypes)['item_id']}, distance int, stop long"
    kind = to_arrow_type(named.schema[0].dataType)
    out = documents.sparkSession.createDataFrame([], schema)
    for items, ids in item_blocks(benchmark, block_chars):
        kept, name = documents.sparkSession.sparkContext.broadcast((items, ids)), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], kept=kept, name=name) -> Iterator[pa.RecordBatch]:
            matcher, ids = matcher_of(name, kept.value[0], rate), kept.value[1]
            for batch in in_batches(batches):
                rows: list[tuple] = []
                for i, text in enumerate(batch.column("text").to_pylist()):
                    rows += [(i, item, distance, stop) for k, distance, stop in matcher.find(normalized(text)) for item in ids[k]]
                if rows:
                    at, item, distance, stop = zip(*rows, strict=True)
                    yield pa.record_batch({"doc_id": batch.column("doc_id").take(pa.array(at)), "item_id": pa.array(item, kind), "distance": pa.array(distance, pa.int32()), "stop": pa.array(stop, pa.int64())})

        out = out.unionByName(chosen.mapInArrow(run, schema))
    return out


def keep_clean(documents: DataFrame, benchmark: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``documents``, all their columns, that hold no item.

    A benchmark of one block is a filter in one pass. Of more blocks, each is
    looked for by itself, and the texts that hold an item are told by two
    hashes and taken out by an anti-join.
    """
    blocks = item_blocks(benchmark, block_chars)
    first, more = next(blocks, None), next(blocks, None)
    if first is None:
        return documents
    if more is None:
        kept, name = documents.sparkSession.sparkContext.broadcast(first[0]), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = matcher_of(name, kept.value, rate)
            for batch in in_batches(batches):
                yield batch.filter(pa.array([not matcher.find(normalized(t)) for t in batch.column("text").to_pylist()], pa.bool_()))

        return documents.mapInArrow(run, documents.schema)

    def marked(text: Column) -> Column:
        return F.struct(F.xxhash64(text), F.md5(text.cast("binary")))

    text = F.col("text").cast("string")
    chosen = documents.select(marked(text).alias("doc_id"), text.alias("text"))
    found = checkpoint(leaks(chosen, benchmark, rate, block_chars).select(F.col("doc_id").alias("_held")).distinct())
    return documents.join(found, marked(text) == F.col("_held"), "left_anti")
