"""Conversation repair against a search over all edits."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

from fluxlane.llm import catalog, repair

SF = "/root/testdata/sf0.01"
WELL = re.compile(r"(s?(ua)+)?")
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def search(rows: list[tuple[str, str, str]]) -> tuple[int, str, list[tuple[str, str]]]:
    """Least cost, least audit and what it leaves, of rows (role, text, fault): best first over (cost, audit), states by replaying roles."""
    queue = [(0, "", 0, "", ())]
    done = set()
    while queue:
        cost, audit, n, initials, kept = heapq.heappop(queue)
        tail = "" if not initials else initials if len(initials) == 1 else "s" if initials == "s" else initials[-1]
        if n == len(rows) and WELL.fullmatch(initials):
            return cost, audit, list(kept)
        if (n, tail) in done:
            continue
        done.add((n, tail))
        choices = [("I", 2, n, (role, "")) for role in ("user", "assistant")]
        if n < len(rows):
            role, text, fault = rows[n]
            choices.append(("D", 3, n + 1, None))
            if fault not in ("blank", "duplicate"):
                more = int(fault == "truncated")
                choices += [("K", more, n + 1, (role, text))] + [("R", 2 + more, n + 1, (r, text)) for r in ("user", "assistant")]
        for letter, c, to, turn in choices:
            now = initials + (turn[0][:1] or "?") if turn else initials
            # a prefix of a well-formed conversation, by what may still follow
            if any(WELL.fullmatch(now + rest) for rest in ("", "a", "ua")):
                short = now[-1:] if len(now) > 1 or now in ("u", "a") else now
                heapq.heappush(queue, (cost + c, audit + letter, to, short if short != "a" else "ua", (*kept, turn) if turn else kept))
    raise AssertionError("every conversation can be emptied")


def by_hand(rows: list[tuple]) -> tuple:
    """The contract's columns of rows (turn, role, text) after damage."""
    rows = sorted(((t, r, " " if x is None else x) for t, r, x in ((t, " " if r is None else r, x) for t, r, x in rows)), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        said = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = {t for t, _, _ in rows if t is not None}
    initials = [r[:1] for _, r, _ in rows]
    cost, audit, kept = search([(r, x, f) for (_, r, x), f in zip(rows, faults, strict=True)])
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    text = "\n".join(f"{r}:{x}" for r, x in kept)
    return max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in repair.FAULTS), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def damage(rows: list[tuple]) -> list[tuple]:
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        how = zlib.crc32(key.encode()) % 20
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        out += [(conv, turn, "user" if how == 4 else role, text)] * {0: 0, 3: 2}.get(how, 1)
    return out


def compare(got: list, before: list[tuple], rows: list[tuple]) -> None:
    found = {r.conv_id: (*(r[c] for c in COUNTS), r.audit, r.repaired_sha256) for r in got}
    assert len(found) == len(got)
    assert found == {c: by_hand([r[1:] for r in rows if r[0] == c]) for c in {r[0] for r in before}}


SCHEMA = "conv_id long, turn long, role string, text string, audit string, fault int"


def odd_rows(rng: random.Random) -> list[tuple]:
    rows = []
    for conv in [None, *range(150)]:
        for n in range(rng.randrange(0, 9)):
            turn = rng.choice([None, n, n, n, n + rng.randrange(3)])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool", "umpire"])
            rows.append((conv, turn, role, rng.choice([None, "", " \n\t", "Yes.", "yes", "No!", "No! ", "wh　", "é?\x0b", "　", "a b c"])))
    return rows


def test_repairs_equal_a_search(spark):
    rows = odd_rows(random.Random(13))
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    compare(repair.repaired(df, df).collect(), rows, rows)


def test_damage_and_repair(spark):
    rows = odd_rows(random.Random(5))
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    after = repair.damaged(df)
    hurt = damage(rows)
    assert sorted(map(tuple, after.collect()), key=repr) == sorted(hurt, key=repr)
    compare(repair.repaired(df, after).collect(), rows, hurt)


def test_long_conversation_and_turns_left(spark):
    rng = random.Random(2)
    rows = [(1, n, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "No", "", f"{n}."])) for n in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    compare(repair.repaired(df, df).collect(), rows, rows)
    audited = repair.audits(repair.with_faults(df))
    left = repair.repaired_turns(df, audited).collect()
    assert [r.position for r in left] == list(range(len(left)))
    assert WELL.fullmatch("".join(r.role[0] for r in left))


def test_ids_of_text_and_empty_table(spark):
    df = spark.createDataFrame([("a", 1, "user", "Hi."), ("a", 2, "assistant", "Ho."), ("b", 1, "user", "Hi.")], "conv_id string, turn long, role string, text string")
    assert {r.conv_id: r.audit for r in repair.repaired(df, df).collect()} == {"a": "KK", "b": "D"} | ({"b": "KI"} if repair.COSTS["I"] < repair.COSTS["D"] else {})
    assert repair.repaired(df.limit(0), df.limit(0)).count() == 0


def test_query_on_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    compare(catalog.op13_conversation_repair(spark, SF).collect(), rows, damage(rows))
