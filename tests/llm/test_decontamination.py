import random

from fluxlane.llm import catalog, decontamination
from samples import ODD, words


def least_distance(pattern, text):
    """Least edit distance of the pattern to any part of the text, by the plain table."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (p != c)))
        row = new
        best = min(best, row[-1])
    return best


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        at = rng.randrange(len(out))
        rng.choice([lambda: out.pop(at), lambda: out.insert(at, rng.choice("xyz ")), lambda: out.__setitem__(at, rng.choice("xyz"))])()
    return "".join(out)


def test_myers_equals_the_table():
    rng = random.Random(1)
    for _ in range(300):
        p, t = words(rng, 3), words(rng, 8)
        if rng.random() < 0.5:
            t += edited(rng, p, rng.randint(0, 4)) + words(rng, 2)
        hit = decontamination.myers(p, t, 4)
        d = least_distance(p, t)
        assert (hit[0] if hit else None) == (d if d <= 4 else None)


def test_matcher_finds_all_that_the_budget_allows():
    rng = random.Random(2)
    items = [decontamination.normalized(words(rng, n)) for n in (3, 10, 30, 30, 60)]
    matcher = decontamination.Matcher(items)
    assert [len(decontamination.pieces(x, b)) for x, b in zip(items, matcher.budgets)] == [b + 1 for b in matcher.budgets]
    for trial in range(60):
        k = rng.randrange(len(items))
        text = decontamination.normalized(words(rng, 40) + " " + edited(rng, items[k], rng.randint(0, 6)) + " " + words(rng, 40))
        got = {i: d for i, d, _ in matcher.find(text)}
        want = {i: d for i, x in enumerate(items) if (d := least_distance(x, text)) <= matcher.budgets[i]}
        assert got == want


def test_odd_tables_blocks_and_stage(spark, make_docs):
    rng = random.Random(3)
    leak = words(rng, 40)
    bench = spark.createDataFrame([(1, leak, "x"), (2, leak, "x"), (3, None, "x"), (4, "  ", "x"), (5, words(rng, 30), "x"), (None, leak.upper(), "x")], "item_id long, text string, doc_id string")
    rows = [*ODD, (50, "pre " + leak.upper().replace(" ", "\n ") + " post"), (51, "pre " + leak[:-1] + "q post"), (52, words(rng, 60)), (50, "pre " + leak + " post")]
    docs = make_docs(rows)
    want = sorted([(i, item, d) for i, d in ((50, 0), (50, 0), (51, 1)) for item in (1, 2, None)], key=str)
    for size in (1 << 23, 100):
        found = decontamination.leaks(docs, bench, block_chars=size)
        assert sorted(((r.doc_id, r.item_id, r.distance) for r in found.collect()), key=str) == want
        kept = decontamination.keep_clean(docs, bench, block_chars=size)
        assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=str) == sorted([i for i, _ in rows if i not in (50, 51)], key=str)
    # ids of other types, given back as they are
    for cast in ("string", "int", "decimal(9,0)"):
        found = decontamination.leaks(docs, bench.withColumn("item_id", decontamination.F.col("item_id").cast(cast)))
        assert dict(found.dtypes)["item_id"] == cast and sorted(((r.doc_id, str(r.item_id), r.distance) for r in found.collect()), key=str) == sorted([(i, str(item), d) for i, item, d in want], key=str)
    assert decontamination.leaks(docs, bench.filter("item_id = 3")).collect() == []
    assert decontamination.leaks(make_docs([]), bench).collect() == []
    assert decontamination.keep_clean(docs, bench.filter("item_id = 99")).count() == len(rows)


def test_short_items_and_long_texts(spark, make_docs):
    rng = random.Random(4)
    leak = words(rng, 30)
    bench = spark.createDataFrame([("a", "a"), ("b", "Yes"), ("c", leak)], "item_id string, text string")
    docs = make_docs([(1, "a"), (2, " yes\n"), (3, "a yes a"), (4, words(rng, 60_000) + " " + leak + " " + words(rng, 60_000)), (5, words(rng, 50))])
    assert sorted((r.doc_id, r.item_id) for r in decontamination.leaks(docs, bench).collect()) == [(1, "a"), (2, "b"), (4, "c")]
    assert sorted(r.doc_id for r in decontamination.keep_clean(docs, bench).collect()) == [3, 5]


def test_query_finds_every_exact_item(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: decontamination.normalized(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: decontamination.normalized(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id): r.distance for r in catalog.op4_decontamination(spark, sf).collect()}
    assert {k for k, d in got.items() if d == 0} == {(i, k) for i, t in docs.items() for k, x in items.items() if x in t}
    assert all(least_distance(items[k], docs[i]) == d for (i, k), d in list(got.items())[:5])
