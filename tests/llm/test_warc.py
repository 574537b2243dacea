import random

from fluxlane.llm import warc


def records(spark, rows):
    """rows: id, url, ts, kind, etag, modified, digest, headers."""
    df = spark.createDataFrame(rows, warc.SCHEMA)
    return df.selectExpr("*", "'x' as slice", "1 as answer", "'y' as own", "'z' as canonical_url")


def brute(rows, key):
    out = []
    full = [r for r in set((*r[:7], None) for r in rows) if r[3] == "response" and r[1] is not None and r[2] is not None]
    heads = {(r[0], r[2]): r[7] for r in rows}
    for r in rows:
        if r[3] != "revisit":
            continue
        old = [f for f in full if None not in (r[1], r[2]) and key(f[1]) == key(r[1]) and f[2] < r[2]]
        if not old:
            out.append((r[0], None, "missing", None))
            continue
        f = max(old, key=lambda f: (f[2], f[0]))
        weak = lambda t: t.removeprefix("W/")
        pairs = [(weak(a), weak(b)) if k == 4 else (a, b) for k in (4, 5, 6) for a, b in [(r[k], f[k])] if a is not None and b is not None]
        what = "unchecked" if not pairs else "resolved" if pairs[0][0] == pairs[0][1] else "mismatch"
        merged = None
        if what == "resolved":
            merged = {k.lower(): v for k, v in (heads[(f[0], f[2])] or {}).items()} | {k.lower(): v for k, v in (r[7] or {}).items() if k.lower() in warc.PERMITTED}
        out.append((r[0], f[0], what, merged))
    return sorted(out, key=str)


def test_resolution_equals_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        hot = rng.random() < 0.5
        url = "http://hot.example.com/" if hot else f"http://u{rng.randrange(20)}.example.com/p"
        rows.append((i, rng.choice([url, url, url.replace("http:", "https:"), url + "#x"]), rng.choice([None, *range(60)]), rng.choice(["response", "revisit"]), rng.choice([None, '"a"', 'W/"a"', '"b"']), rng.choice([None, "m1", "m2"]), rng.choice([None, "d"]), rng.choice([None, {"ETag": f"e{i}", "Content-Length": str(i), "X": "y"}, {"date": str(i)}])))
    rows.append((400, None, 5, "revisit", '"a"', None, None, None))
    key = lambda u: u.replace("https:", "http:").split("#")[0].rstrip("/")
    for slices in (1, 5, 256):
        got = sorted(((r.record_id, r.response_id, r.outcome, r.headers) for r in warc.resolve(records(spark, rows), slices).collect()), key=str)
        assert got == brute(rows, key)


def test_ties_repeats_and_empty(spark):
    rows = [(1, "http://a.b/x", 10, "response", '"a"', None, "d1", None), (2, "http://a.b/x", 10, "response", '"b"', None, "d2", {"Date": "1"}), (3, "http://a.b/x", 10, "revisit", '"a"', None, None, None), (4, "http://a.b/x", 11, "revisit", '"b"', None, None, {"Date": "2", "Content-Type": "no"})]
    got = {r.record_id: r for r in warc.resolve(records(spark, rows + rows[3:])).collect()}
    assert got[3].outcome == "missing" and (got[4].response_id, got[4].headers, got[4].digest) == (2, {"date": "2"}, "d2")
    assert warc.resolve(records(spark, rows + rows[3:])).count() == 3
    assert warc.resolve(records(spark, rows).filter("record_id > 9")).collect() == []
    bodies = spark.createDataFrame([(1, "one"), (2, "two"), (2, "two")], "record_id long, body string")
    assert {r.record_id: r.body for r in warc.attach_bodies(warc.resolve(records(spark, rows)), bodies).collect()} == {3: None, 4: "two"}


def test_a_hot_url_and_a_hot_instant_are_split(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(i, "http://hot.example.com/", 50 if i % 2 else rng.randrange(100), "revisit" if i % 3 else "response", '"a"', None, None, None) for i in range(1500)]
    rows += [(2000 + i, None, i, "revisit", '"a"', None, None, None) for i in range(700)] + [(3000, "http://hot.example.com/", None, "response", '"a"', None, None, None)]
    seen, cut = [], warc.checkpoint
    monkeypatch.setattr(warc, "checkpoint", lambda df: seen.append(cut(df)) or seen[-1])
    got = sorted(((r.record_id, r.response_id, r.outcome, r.headers) for r in warc.resolve(records(spark, rows), 100).collect()), key=str)
    assert got == brute(rows, lambda u: u)
    slices = seen[0].groupBy("canonical_url", "slice").count().collect()
    assert len(slices) >= 8 and max(r["count"] for r in slices) < 300 and all(r.canonical_url for r in slices)


def test_canonical_urls(spark):
    urls = {
        "http://WWW.Example.com:80/A/?utm_source=feed#top": "example.com/A", "https://example.com/A?page=2&ref=x": "example.com/A?page=2", "https://example.com/A?ref=x&page=2": "example.com/A?page=2",
        "http://example.com": "example.com", "http://example.com/?": "example.com", "http://example.com:8080/b/": "example.com:8080/b", " https://m.example.com/x.html ": "m.example.com/x.html", None: None,
    }
    df = spark.createDataFrame([(u,) for u in urls], "url string").select("url", warc.canonical_url(warc.F.col("url")).alias("c"))
    assert {r.url: r.c for r in df.collect()} == urls
