"""Chat formatting by a grammar round trip.

The grammar of a formatted conversation is ``turn*``, where

    turn = "<s>[INST]" role "[/INST]" text "</s>"

and the parser is deterministic: it reads to the next control string. A turn is
rendered as it is and parsed again. If what comes back differs from the source,
the conflicting content is escaped and the turn is rendered and parsed anew,
until both are identical. Escaping puts one more backslash behind the first
character of whatever looks like a control string, with any number of
backslashes already there, so it can be undone exactly.

Turns are ordered by (turn, role, text), nulls first; null roles and texts are
empty; repeated rows are turns of their own; rows with a null conversation id
form one conversation. Extra columns are ignored. An empty table gives no rows.
A conversation is kept as one chunk a turn: its formatted text is the chunks in
order. So no conversation is ever held whole, and digests run along the chunks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<s>[INST]", "[/INST]", "</s>"
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
_LOOKS = re.compile(r"([<\[])(\\*)(?=/?(?:s>|INST\]))")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(?=/?(?:s>|INST\]))")
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))


def escape(text: str) -> str:
    return _LOOKS.sub(r"\1\2\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


class ParseError(ValueError):
    """The text isn't of the grammar."""


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of formatted text; ParseError if it breaks the grammar."""
    turns, at = [], 0

    def expect(control: str) -> str:
        nonlocal at
        found = _CONTROL.search(formatted, at)
        if not found or found[0] != control:
            raise ParseError(f"{control} expected at {at}")
        before, at = formatted[at : found.start()], found.end()
        return before

    while at < len(formatted):
        if expect("<s>") or expect("[INST]"):
            raise ParseError(f"text outside a turn before {at}")
        role = expect(MIDDLE)
        turns.append((unescape(role), unescape(expect(CLOSE))))
    return turns


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """(chunk, start and end of the text in it), such that parse() gives the turn back."""
    parts = [role, text]
    for raw in ((True, True), (False, True), (True, False), (False, False)):
        head, body = (p if r else escape(p) for p, r in zip(parts, raw, strict=True))
        chunk = f"{OPEN}{head}{MIDDLE}{body}{CLOSE}"
        try:
            same = parse(chunk) == [(role, text)]
        except ParseError:
            same = False
        if same:
            start = len(OPEN) + len(head) + len(MIDDLE)
            return chunk, start, start + len(body)
    raise AssertionError("an escaped turn always parses")


def format_turns(conversations: DataFrame, assistant: str = "assistant") -> DataFrame:
    """A chunk for each row: conv_id, turn, role, text, chunk, loss_start and loss_end.

    The loss mask covers the code points loss_start to loss_end (end exclusive)
    of an assistant's chunk; both are null for others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            chunks, starts, ends = [], [], []
            for role, text in zip(b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True):
                chunk, start, end = render_turn(role, text)
                chunks.append(chunk)
                starts.append(start if role == assistant else None)
                ends.append(end if role == assistant else None)
            yield pa.record_batch([*b.columns, pa.array(chunks, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=[*b.schema.names, "chunk", "loss_start", "loss_end"])

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.select("conv_id", "turn", text("role"), text("text"))
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, text string, chunk string, loss_start long, loss_end long")


class _Digest:
    """What is read back of one conversation, chunk by chunk."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0

    def add(self, chunk: str, start: int | None, end: int | None) -> None:
        for role, text in parse(chunk):
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "replace"))
            self.n_turns += 1
        self.formatted_chars += len(chunk)
        if start is not None:
            said = unescape(chunk[start:end])
            self.loss.update(said.encode("utf-8", "replace"))
            self.loss_chars += len(said)


def read_back(chunks: DataFrame) -> DataFrame:
    """A row for each conversation, from its chunks alone.

    Rows of a conversation meet in one task, sorted, and stream through it: it
    holds one turn and two digests, as a digest of the whole is sequential.
    """
    kind = dict(chunks.dtypes)["conv_id"]
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list = []
        done: list[tuple] = []

        def end() -> None:
            if now:
                d = now[1]
                done.append((now[0], d.n_turns, d.turns.hexdigest(), d.loss_chars, d.loss.hexdigest(), d.formatted_chars))

        out = None
        for b in batches:
            kinds = out or [b.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            out = kinds
            for key, chunk, start, stop in zip(*(b.column(c).to_pylist() for c in ("conv_id", "chunk", "loss_start", "loss_end")), strict=True):
                if not now or now[0] != key:
                    end()
                    now[:] = [key, _Digest()]
                now[1].add(chunk, start, stop)
            if done:
                yield _rows(done, kinds)
                done = []
        end()
        if done:
            yield _rows(done, out)

    return (
        chunks.repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "chunk", "loss_start", "loss_end")
        .mapInArrow(run, schema)
    )


def _rows(done: list[tuple], kinds: list) -> pa.RecordBatch:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names=names)


#: The query's rows in DuckDB's SQL; what is escaped grows by a backslash for each place that looks like a control string.
ORACLE = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), written AS (
  SELECT *, length(regexp_replace(role, '([<\[])(\\*)(/?(s>|INST\]))', '\1\2\\\3', 'g')) + length(regexp_replace(text, '([<\[])(\\*)(/?(s>|INST\]))', '\1\2\\\3', 'g')) + 20 AS chars FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM written GROUP BY conv_id
"""
