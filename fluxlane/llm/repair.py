"""Repair of the structure of conversations by the cheapest edits.

A conversation is well formed if the initials of its roles give ``(s?(ua)+)?``. Its
rows and the states of that pattern span a graph of layers: keeping, reroling or
deleting a row leads to the next layer, inserting an empty turn stays in one. The
minimum costs from the start and to the end tell which arcs are tight, that is, lie
on a cheapest path; a walk over them takes the least letter at each step, from the
set of places that it may be at.

Costs of the states of a layer are kept as their differences from the least one.
There are few such profiles, so a step is a lookup, and a row takes a byte for its
kind and two for its profile from the end. That is all that a conversation holds
in its task, as its audit is one value anyway; its texts stream past, ordered.

Rows are ordered by (turn, role, text), turns of null first; equal rows are turns
of their own. A null role or text is one space, which no turn of the pattern has;
rows with a null conversation id form one conversation. Roles are judged by their
first character. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT = "KRDI"
COSTS = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED_COST = 1
SPACES = "\x20\t\n\x0b\x0c\r"
#: States: nothing yet, after a system turn, after a user's, after an assistant's. The first and the last may end.
STATES, ENDS = 4, (0, 3)
#: Where a turn of an initial leads.
STEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
#: The turn that may come next but for a system's, by state.
NEXT = {0: "user", 1: "user", 2: "assistant", 3: "user"}
FAULTS = ("blank", "duplicate", "truncated")
_INITIALS = "sua"
_FAR = 1 << 40
_LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}

Profile = tuple[int, ...]


def row_kind(initial: str, fault: int) -> int:
    """A row's kind as a number: its initial (3: any other) and its fault (0: none, else its place in FAULTS plus one)."""
    place = _INITIALS.find(initial) if initial else -1
    return (place if place >= 0 else 3) + 4 * fault


@lru_cache(maxsize=None)
def row_arcs(kind: int) -> tuple[tuple[int, int, str, int], ...]:
    """(from, to, letter, cost) of the arcs to the next layer."""
    fault = kind >> 2
    arcs = [(q, q, DELETE, COSTS[DELETE]) for q in range(STATES)]
    if fault not in (1, 2):
        more = TRUNCATED_COST if fault == 3 else 0
        arcs += [(q, to, KEEP, COSTS[KEEP] + more) for q, to in STEPS.get((*_INITIALS, "")[kind & 3], {}).items()]
        arcs += [(q, STEPS[role[0]][q], REROLE, COSTS[REROLE] + more) for q, role in NEXT.items()]
    return tuple(arcs)


#: Arcs that stay in a layer.
INSERTS = tuple((q, STEPS[role[0]][q], INSERT, COSTS[INSERT]) for q, role in NEXT.items())


def _least(costs: list[int]) -> tuple[Profile, int]:
    low = min(costs)
    return tuple(min(c - low, _FAR) for c in costs), low


def _relax(costs: list[int], back: bool) -> list[int]:
    for _ in range(STATES):
        for q, to, _letter, c in INSERTS:
            if back:
                costs[q] = min(costs[q], c + costs[to])
            else:
                costs[to] = min(costs[to], c + costs[q])
    return costs


@lru_cache(maxsize=1 << 14)
def step(profile: Profile, kind: int, back: bool) -> tuple[Profile, int]:
    """The profile one row on (or, ``back``, before it), and how much the least cost grows."""
    out = [_FAR] * STATES
    for q, to, _letter, c in row_arcs(kind):
        if back:
            out[q] = min(out[q], c + profile[to])
        else:
            out[to] = min(out[to], c + profile[q])
    return _least(_relax(out, back))


FIRST = _least(_relax([0 if q == 0 else _FAR for q in range(STATES)], False))
LAST = _least(_relax([0 if q in ENDS else _FAR for q in range(STATES)], True))


def cheapest(kinds: bytes) -> tuple[int, str]:
    """The least cost of edits that make rows of these kinds well formed, and the edits' letters, the least of all cheapest ones."""
    number: dict[Profile, int] = {LAST[0]: 0}
    profiles = [LAST[0]]
    to_end = np.zeros(len(kinds) + 1, np.uint16)
    back, b = LAST
    for n in range(len(kinds) - 1, -1, -1):
        back, more = step(back, kinds[n], True)
        b += more
        if back not in number:
            number[back] = len(profiles)
            profiles.append(back)
        to_end[n] = number[back]
    total = b + back[0]
    front, f = FIRST
    letters = bytearray()
    at, n = {0}, 0
    while True:
        if n == len(kinds) and any(q in ENDS and f + front[q] == total for q in at):
            return total, letters.decode()
        tight = [(letter, to, 0) for q, to, letter, c in INSERTS if q in at and f + front[q] + c + b + back[to] == total]
        if n < len(kinds):
            after = profiles[to_end[n + 1]]
            b_after = b - step(after, kinds[n], True)[1]
            tight += [(letter, to, 1) for q, to, letter, c in row_arcs(kinds[n]) if q in at and f + front[q] + c + b_after + after[to] == total]
        least, _, row = min(tight)
        letters += least.encode()
        at = {to for letter, to, _ in tight if letter == least}
        if row:
            front, more = step(front, kinds[n], False)
            f += more
            back, b = after, b_after
            n += 1


def edited(letters: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(letter, role, text) of the turns that the edits leave of rows of (role, text)."""
    state = 0
    for letter in letters:
        role, text = (NEXT[state], "") if letter == INSERT else next(rows)
        if letter == REROLE:
            role = NEXT[state]
        if letter != DELETE:
            state = STEPS[role[0]][state]
            yield letter, role, text


def damaged(conversations: DataFrame, key: Column | None = None) -> DataFrame:
    """conv_id, turn, role, text after damage by ``key`` modulo 20 (by default crc32 of conv_id:turn): 0 drops a row, 1 empties its text, 2 takes its sentence ends, 3 repeats it, 4 makes it the user's."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    chosen = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) if key is None else key
    rows = conversations.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), (chosen % 20).alias("how"))
    rows = rows.filter("how > 0")
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("how") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("how") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("_")).drop("_")


def with_faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, digest and fault (0, or the place in FAULTS plus one) of rows, duplicates of the same turn aside, which stand behind each other."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    rows = rows.withColumn("digest", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    stripped = F.rtrim(F.col("text"), F.lit(SPACES))
    # turns of null come first
    when = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    first = rows.groupBy(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest")).agg(F.min(when).alias("first"))
    again = rows.join(first, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("digest") == F.col("_digest")))
    fault = F.when(stripped == "", 1).when(when > F.col("first"), 2).when(~F.right(stripped, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    return again.select("conv_id", "turn", "role", "text", "digest", fault.alias("fault"))


def _in_order(rows: DataFrame, *before: str) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *before, F.col("turn").asc_nulls_first(), "role", "text")


def _rows(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(c).to_pylist() for c in names), strict=True)


def audits(faulty: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit of each conversation of ``faulty`` (as by ``with_faults``)."""
    kind = dict(faulty.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, rows in groupby(_rows(batches, ["conv_id", "turn", "initial", "digest", "fault"]), lambda r: r[0]):
            kinds, counts, illegal, turns, low, high, before = bytearray(), [0] * 4, 0, 0, None, None, None
            for _, turn, initial, digest, fault in rows:
                # an equal row of the same turn stands right before
                if before and fault != 1 and before[:2] == (turn, digest):
                    fault = 2
                counts[fault] += 1
                illegal += bool(before) and (before[2], initial) not in _LEGAL
                if turn is not None:
                    turns += turn != high
                    low, high = (turn if low is None else low), turn
                kinds.append(row_kind(initial, fault))
                before = (turn, digest, initial)
            cost, audit = cheapest(bytes(kinds))
            values = {"gaps": high - low + 1 - turns if turns else 0, "blank": counts[1], "duplicate": counts[2], "truncated": counts[3], "illegal": illegal, "cost": cost, "audit": audit}
            yield pa.RecordBatch.from_pydict({"conv_id": [conv]} | {c: [v] for c, v in values.items()}, schema=schema)

    names = {c: pa.int64() for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    schema = pa.schema({"conv_id": pa.string() if kind == "string" else pa.int64()} | names | {"audit": pa.string()})
    ordered = _in_order(faulty).select("conv_id", F.col("turn").cast("long").alias("turn"), F.left("role", F.lit(1)).alias("initial"), "digest", "fault")
    return ordered.mapInArrow(run, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def repaired_turns(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """conv_id, position, edit (K, R or I), role and text of the turns that edits leave, each conversation's in order in one partition.

    ``rows``: the turns that ``audited`` (conv_id and audit) has looked at.
    """
    kind = dict(rows.dtypes)["conv_id"]
    turn = dict(rows.dtypes)["turn"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        for conv, group in groupby(_rows(batches, ["conv_id", "is_turn", "role", "text"]), lambda r: r[0]):
            _, _, _, audit = next(group)
            for n, (letter, role, text) in enumerate(edited(audit, ((role, text) for _, _, role, text in group))):
                out.append((conv, n, letter, role, text))
                size += len(text) + 100
                if size > 1 << 20:
                    yield batch(out)
                    out, size = [], 0
        if out:
            yield batch(out)

    schema = pa.schema({"conv_id": pa.string() if kind == "string" else pa.int64(), "position": pa.int64(), "edit": pa.string(), "role": pa.string(), "text": pa.string()})
    batch = lambda out: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
    spaced = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    heads = audited.select("conv_id", F.lit(0).alias("is_turn"), F.lit(None).cast(turn).alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"))
    both = heads.unionByName(rows.select("conv_id", F.lit(1).alias("is_turn"), "turn", *spaced))
    return _in_order(both, "is_turn").select("conv_id", "is_turn", "role", "text").mapInArrow(run, f"conv_id {kind}, position long, edit string, role string, text string")


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256 (of ``role:text``, joined by newlines) of turns in the order that ``repaired_turns`` leaves."""
    kind = dict(repaired.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, found = [], []
        for conv, rows in groupby(_rows(batches, ["conv_id", "position", "role", "text"]), lambda r: r[0]):
            sha = hashlib.sha256()
            for _, n, role, text in rows:
                sha.update((("\n" if n else "") + role + ":" + text).encode())
            ids.append(conv)
            found.append(sha.hexdigest())
        if ids:
            yield pa.record_batch({"conv_id": pa.array(ids, pa.string() if kind == "string" else pa.int64()), "repaired_sha256": pa.array(found)})

    return repaired.select("conv_id", "position", "role", "text").mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def repaired(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """The audit of every conversation of ``conversations`` and the digest of what is left of it; ``rows``: its rows as they are now."""
    audited = audits(with_faults(rows))
    said = digests(repaired_turns(rows, audited))
    found = conversations.select("conv_id").distinct()
    for n, more in enumerate((audited, said)):
        more = more.withColumnRenamed("conv_id", f"_{n}")
        found = found.join(more, F.col("conv_id").eqNullSafe(F.col(f"_{n}")), "left").drop(f"_{n}")
    zeros = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


#: SQL of the query: crc32 bit by bit, costs and audits layer by layer, turns told by the place of their letters.
ORACLE = """WITH RECURSIVE spaced AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
hashed AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(key) + 1), lambda i: ascii(substr(key, i, 1))::BIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS how FROM spaced),
hurt AS (SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN how = 3 THEN [1, 2] ELSE [1] END) AS copy FROM hashed WHERE how > 0),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
 rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS before FROM hurt),
faulty AS (SELECT *, CASE WHEN said = '' THEN 1 WHEN seen > 1 THEN 2 WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM ordered),
counted AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
 count(*) FILTER (i > 1 AND before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id),
inserts(q, via, letters, c) AS (VALUES (0, 0, '', 0), (1, 1, '', 0), (2, 2, '', 0), (3, 3, '', 0), (0, 2, 'I', 2), (0, 3, 'II', 4), (1, 2, 'I', 2), (1, 3, 'II', 4), (2, 3, 'I', 2), (3, 2, 'I', 2)),
steps(q, z, initial) AS (VALUES (0, 1, 's'), (0, 2, 'u'), (1, 2, 'u'), (3, 2, 'u'), (2, 3, 'a')),
arcs AS (SELECT conv_id, i, q, q AS z, 'D' AS letter, 3 AS c FROM faulty, (SELECT unnest([0, 1, 2, 3]) AS q) UNION ALL SELECT conv_id, i, q, z, 'K', CASE WHEN fault = 3 THEN 1 ELSE 0 END FROM faulty JOIN steps ON initial = left(role, 1) WHERE fault IN (0, 3)
 UNION ALL SELECT conv_id, i, q, z, 'R', CASE WHEN fault = 3 THEN 3 ELSE 2 END FROM faulty, steps WHERE fault IN (0, 3) AND initial <> 's'),
walk AS (SELECT conv_id, 0::BIGINT AS i, 0 AS q, {'cost': 0::BIGINT, 'audit': ''} AS best FROM counted
 UNION ALL SELECT w.conv_id, w.i + 1, a.z, min({'cost': w.best.cost + t.c + a.c, 'audit': w.best.audit || t.letters || a.letter}) FROM walk w JOIN inserts t ON t.q = w.q JOIN arcs a ON a.conv_id IS NOT DISTINCT FROM w.conv_id AND a.i = w.i + 1 AND a.q = t.via GROUP BY 1, 2, 3),
ended AS (SELECT w.conv_id, min({'cost': w.best.cost + t.c, 'audit': w.best.audit || t.letters}) AS best FROM walk w JOIN inserts t ON t.q = w.q JOIN counted k ON k.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = k.n WHERE t.via IN (0, 3) GROUP BY 1),
letters AS (SELECT conv_id, j, substr(best.audit, j, 1) AS letter, j - length(replace(left(best.audit, j), 'I', '')) AS inserted FROM (SELECT *, unnest(range(1, length(best.audit) + 1)) AS j FROM ended)),
left_ AS (SELECT l.conv_id, l.letter, f.role, f.text, row_number() OVER (PARTITION BY l.conv_id ORDER BY l.j) AS e FROM letters l LEFT JOIN faulty f ON l.letter <> 'I' AND f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.i = l.j - l.inserted WHERE l.letter <> 'D'),
turned AS (SELECT *, max(CASE WHEN e = 1 AND letter = 'K' AND left(role, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS s FROM left_),
said_ AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (e - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY e) AS whole FROM turned GROUP BY conv_id)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted k ON k.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended b ON b.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN said_ d ON d.conv_id IS NOT DISTINCT FROM o.conv_id"""
