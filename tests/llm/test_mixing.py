import hashlib
from collections import Counter

import duckdb
import pyarrow as pa
from fluxlane.llm import catalog, mixing
from samples import ODD


def targets(sizes, weights=(5, 2, 1), most=3):
    """The contract's targets, by plain rounds over a list."""
    order = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode("utf-32-be", "replace")))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size, out = dict(order), {}
    left, free = float(sum(size.values())), [s for s, _ in order]
    while free:
        total = sum(weight[s] for s in free)
        share = {s: left * weight[s] / total for s in free}
        above = [s for s in free if share[s] > most * size[s]]
        if not above:
            return out | share
        for s in above:
            out[s] = float(most * size[s])
        left -= sum(out[s] for s in above)
        free = [s for s in free if s not in out]
    return out


def brute_taken(rows):
    """(doc_id, source, size, taken) of (doc_id, text, source) rows: every word of every source is laid out and taken slot by slot."""
    size = lambda t: len([w for w in (t or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w])
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    docs = [(i, s, size(t), int(md5(f"17:{'' if i is None else i}:{size(t)}:{md5(t or '')}")[:15], 16)) for i, t, s in rows]
    sizes = Counter()
    for _, s, n, _ in docs:
        sizes[s] += n
    goal, total = targets(list(sizes.items())), sum(sizes.values())
    order = sorted(sizes, key=lambda x: (x is None, (x or "").encode("utf-32-be", "replace")))
    widest = max(1, total // max(mixing.RESOLUTION, mixing.SLOTS_A_SOURCE * len(order)))
    width = {s: max(1, min(widest, sizes[s] // mixing.SLOTS_A_SOURCE, int(goal[s]) // mixing.SLOTS_A_SOURCE)) for s in order}
    whole = {s: int(goal[s] + 0.5) for s in order}
    need = {s: -(-whole[s] // width[s]) + mixing.SPARE if sizes[s] else 0 for s in order}
    slots, edges, at = sum(need.values()), [], 0
    for s in order:
        at += need[s]
        edges.append((at * mixing.CIRCLE // slots, s))
    laid = {s: [k for k in sorted((k for k in range(len(docs)) if docs[k][1] == s), key=lambda k: docs[k][3]) for _ in range(docs[k][2])] for s in order}
    taken, done = Counter(), Counter()
    for slot in range(slots):
        point = slot * mixing.GOLDEN % mixing.CIRCLE
        s = next(s for hi, s in edges if point < hi)
        blocks = -(-sizes[s] // width[s])
        block, turn = done[s] % blocks, done[s] // blocks
        done[s] += 1
        if turn < 3:
            for w in range(block * width[s], min((block + 1) * width[s], sizes[s])):
                if turn * sizes[s] + w < whole[s]:
                    taken[laid[s][w]] += 1
    return [(i, s, n, taken[k]) for k, (i, s, n, _) in enumerate(docs)]


def check(rows):
    by = {}
    for r in rows:
        s = by.setdefault(r.source, [0, 0])
        s[0], s[1] = s[0] + r["size"], s[1] + r.taken
        assert 0 <= r.taken <= 3 * r["size"]
    total = sum(n for n, _ in by.values())
    goal = targets([(s, n) for s, (n, _) in by.items()])
    assert abs(sum(goal.values()) - total) < 1e-6 * max(total, 1)
    for r in rows:
        assert r.source_size == by[r.source][0] and abs(r.target - goal[r.source]) < 1e-9 * max(total, 1)
    for s, (n, taken) in by.items():
        assert abs(taken - goal[s]) <= max(8, 1e-4 * total), (s, n, taken, goal[s])


def test_targets_stop_at_three_times(spark):
    assert targets([("a", 100), ("b", 100)]) == {"a": 200 * 5 / 7, "b": 200 * 2 / 7}
    assert targets([("a", 10), ("b", 1000), (None, 1000)]) == {"a": 30.0, "b": 1980 * 2 / 3, None: 1980 / 3}
    # order by code point: upper case first, marks beyond the basic plane after the private use area
    assert targets([("\U0001f600", 700), ("\ue000", 700), ("B", 700)])["\U0001f600"] == 2100 / 8
    for sizes in ([("a", 100), ("b", 100)], [("a", 10), ("b", 1000), (None, 1000)], [("\U0001f600", 700), ("\ue000", 700), ("B", 700)], [("a", 1), ("b", 5), ("c", 60), ("d", 0), ("e", 9000)], [("a", 0)]):
        table = mixing.numbered(spark.createDataFrame(sizes, "source string, source_size long"))
        got = {r.source: r.target for r in mixing.with_targets(table, sum(n for _, n in sizes)).collect()}
        assert got == targets(sizes)


def test_taken_words_equal_brute_force(spark, make_docs):
    rows = [(i, t, s) for (i, t), s in zip(ODD, ["a", None, "b", "b", "a", "c", "c", None, "\ue000", "zero"])]
    rows += [(100 + i, f"w{i} " * (1 + i * 7 % 40), "abcdefgh"[i % 3 if i % 11 else 7]) for i in range(300)] + [(100, "w0 ", "a")] * 3
    got = mixing.mix(make_docs([(i, t, "en", s) for i, t, s in rows])).collect()
    assert sorted(((r.doc_id, r.source, r["size"], r.taken) for r in got), key=str) == sorted(brute_taken(rows), key=str)


def test_sql_equals_the_query(spark, make_docs):
    rows = [(i, f"w{i} " * (1 + i * 7 % 40), "en", ["a", "b", None, "d", "e"][i % 5 if i % 3 else 1]) for i in range(400)] + [(900, None, "en", "x"), (None, " ", "en", "a"), (None, "z y", "en", "a")]
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()), "source": pa.array([r[3] for r in rows], pa.string())}))
    got = mixing.mix(make_docs(rows)).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, con.execute(mixing.ORACLE).fetchall()))


def test_very_many_sources(spark):
    n = 20_000
    df = spark.range(3 * n).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 7 as int)) as text", f"concat('https://s', id % {n}) as source")
    for small in (1 << 16, 10):  # broadcast and joined
        mixing.SMALL_ROWS, was = small, mixing.SMALL_ROWS
        try:
            got = mixing.mix(df.union(spark.sql("select -1L, repeat('w ', 200000), 'hot'"))).groupBy("source").agg({"taken": "sum", "target": "max", "size": "sum"}).collect()
        finally:
            mixing.SMALL_ROWS = was
        assert len(got) == n + 1 and all(abs(r["sum(taken)"] - r["max(target)"]) <= 1 for r in got)
        goal = targets([(r.source, r["sum(size)"]) for r in got])
        assert all(abs(goal[r.source] - r["max(target)"]) < 1e-6 for r in got)


def test_words_are_counted_by_ascii_space(spark):
    rows = [("a b  c", 3), (" \t\n\x0b\x0c\r", 0), ("", 0), (None, 0), ("a b c", 1), ("\x1ca\x85b", 1), ("\ta\n", 1)]
    df = spark.createDataFrame([(t,) for t, _ in rows], "text string").select(mixing.word_count(mixing.F.col("text")).alias("n"))
    assert [r.n for r in df.collect()] == [n for _, n in rows]


def test_every_slot_has_one_rank_and_points_are_even(spark):
    shares, edges = [("a", 0.5, 7), ("b", 0.3, 4), (None, 0.2, 100)], [0, int(0.5 * mixing.CIRCLE), int(0.8 * mixing.CIRCLE), mixing.CIRCLE]
    arcs = spark.createDataFrame([(k, edges[k], edges[k + 1], n) for k, (_, _, n) in enumerate(shares)], "src long, lo long, hi long, blocks long")
    rows = mixing.schedule(arcs, 10_000).collect()
    assert sorted(r.slot for r in rows) == list(range(10_000))
    for k, (_, share, blocks) in enumerate(shares):
        own = sorted((r for r in rows if r.src == k), key=lambda r: r.slot)
        assert [r["rank"] for r in own] == list(range(len(own))) and abs(len(own) - share * 10_000) < 6
        assert all(r.block == r["rank"] % blocks and r["pass"] == r["rank"] // blocks for r in own)
    for start in range(0, 10_000, 500):  # every stretch keeps the shares
        n = Counter(r.src for r in rows if start <= r.slot < start + 500)
        assert all(abs(n[k] - share * 500) < 8 for k, (_, share, _) in enumerate(shares))
    g = mixing.GOLDEN / mixing.CIRCLE
    assert abs(g - (5**0.5 - 1) / 2) < 1e-15
    assert all(r.src == sum((r.slot * mixing.GOLDEN % mixing.CIRCLE) >= e for e in (int(0.5 * mixing.CIRCLE), int(0.8 * mixing.CIRCLE))) for r in rows[:500])


def test_small_and_odd_tables(spark, make_docs):
    rows = [(i, t, "en", s) for (i, t), s in zip(ODD, ["a", None, "b", "b", "a", "c", "c", None, "", "zero"])]
    got = mixing.mix(make_docs(rows)).collect()
    assert len(got) == len(rows)
    check(got)
    assert mixing.mix(make_docs([])).collect() == []
    none = mixing.mix(make_docs([(1, None, "en", "a"), (2, " ", "en", None)])).collect()
    assert sorted((r.doc_id, r.taken) for r in none) == [(1, 0), (2, 0)]


def test_repeats_of_a_document_count_each_and_reruns_agree(spark, make_docs):
    rows = [(i % 7, "w " * (1 + i % 13), "en", f"s{i % 3}") for i in range(200)] + [(5, "w " * 5, "en", "s1")] * 10
    docs = make_docs(rows)
    got = mixing.mix(docs).collect()
    assert len(got) == 210
    check(got)
    again = mixing.mix(docs.repartition(3)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_coarse_schedules_keep_the_limits(spark, make_docs):
    rows = [(i, "w " * (1 + i * 7 % 40), "en", "abcdefgh"[i % 3 if i % 11 else 7]) for i in range(300)]
    got = mixing.mix(make_docs(rows), resolution=1).collect()
    assert len(got) == 300 and all(r.taken <= 3 * r["size"] for r in got)


def test_small_sources_come_near_their_own_targets(spark, make_docs):
    sizes = {"big0": 3_000_000, "big1": 2_000_000, "s1": 50, "s2": 300, "s3": 1_000, "s4": 3_000, "s5": 10_000}
    rows = []
    for s, n in sizes.items():
        step = max(7, n // 40)
        rows += [(len(rows) + k, "w " * min(step, n - at), "en", s) for k, at in enumerate(range(0, n, step))]
    for resolution in (1, 64, mixing.RESOLUTION):
        got = mixing.mix(make_docs(rows), resolution=resolution).collect()
        assert len(got) == len(rows) and all(0 <= r.taken <= 3 * r["size"] for r in got)
        for s, n in sizes.items():
            own = [r for r in got if r.source == s]
            assert own[0].source_size == n and abs(sum(r.taken for r in own) - own[0].target) <= 1, (resolution, s)


def test_query(spark):
    check(catalog.op7_source_mixing(spark, "/root/testdata/sf0.001").collect())
