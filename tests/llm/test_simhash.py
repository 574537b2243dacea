import random

import numpy as np
import xxhash
from fluxlane.llm import catalog, simhash
from samples import ODD, words


def brute_print(text):
    ws = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        ws = ws.replace(c, " ")
    ws = [w for w in ws.split(" ") if w]
    shingles = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or ([" ".join(ws)] if ws else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    """Smallest id reachable over prints at most two bits apart, by plain union-find over distinct prints."""
    first = {}
    for i, p in prints:
        known = [x for x in (i, first.get(p)) if x is not None]
        first[p] = min(known) if known else None
    parent = {p: p for p in first}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    names = list(first)
    for k, p in enumerate(names):
        for q in names[:k]:
            if bin(p ^ q).count("1") <= 2:
                parent[root(p)] = root(q)
    least = {}
    for p, i in first.items():
        if i is not None:
            least[root(p)] = min(i, least.get(root(p), i))
    return {p: least.get(root(p)) for p in names}


def check(rows, prints):
    want = brute_components(prints)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in rows), key=str)
    assert got == sorted(((i, f"{p:016x}", want[p]) for i, p in prints), key=str)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    prints = [(r.doc_id, brute_print(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(catalog.op8_simhash(spark, sf).collect(), prints)


def test_odd_rows_and_near_copies(spark, make_docs):
    rng = random.Random(4)
    text = words(rng, 400)
    rows = [*ODD, *[(100 + i, " ".join(w for k, w in enumerate(text.split()) if k != i * 3)) for i in range(25)], (90, text.upper()), (91, text)]
    check(simhash.near_duplicates(make_docs(rows)).collect(), [(i, brute_print(t)) for i, t in rows])
    assert simhash.near_duplicates(make_docs([])).collect() == []


def test_fingerprint_in_pieces(monkeypatch):
    text = words(random.Random(5), 300)
    monkeypatch.setattr(simhash, "_CHUNK", 7)
    assert simhash.fingerprint(text) == brute_print(text)


def clustered(rng, n):
    centres = [rng.getrandbits(64) for _ in range(6)]
    out = set()
    while len(out) < n:
        p = rng.choice(centres)
        for _ in range(rng.randint(0, 4)):
            p ^= 1 << rng.randrange(64)
        out.add(p)
    return sorted(out)


def test_trie_join_finds_all_pairs():
    for seed in range(5):
        keys = np.array(clustered(random.Random(seed), 300), np.uint64)
        i, j = simhash.trie_join(keys, [(0, len(keys), 0, len(keys))])
        want = {(a, b) for a in range(300) for b in range(300) if a < b and bin(int(keys[a]) ^ int(keys[b])).count("1") <= 2}
        assert {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())} == want
        i, j = simhash.trie_join(keys, [(0, 120, 120, 300)])
        assert {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())} == {p for p in want if p[0] < 120 <= p[1]}


def test_large_roots_are_split_without_loss(spark):
    rng = random.Random(9)
    base = rng.getrandbits(64)
    prints = {base}
    while len(prints) < 400:  # all share the first block
        p = rng.choice(list(prints))
        prints.add(p ^ (1 << rng.randrange(40)) ^ ((1 << rng.randrange(40)) if rng.random() < 0.7 else 0))
    df = spark.createDataFrame([(simhash._signed(p),) for p in prints], "print long")
    for bound in (20, 1 << 15):
        edges = [(r.a, r.b) for r in simhash.links(df, bound).collect()]
        parent = {simhash._signed(p): simhash._signed(p) for p in prints}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            assert bin((a ^ b) & (1 << 64) - 1).count("1") <= 64
            parent[root(a)] = root(b)
        got = {}
        for p in prints:
            got.setdefault(root(simhash._signed(p)), set()).add(p)
        want = {}
        for p, c in brute_components([(k, p) for k, p in enumerate(sorted(prints))]).items():
            want.setdefault(c, set()).add(p)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(200, 300), (300, 250), (7, 7)]
    got = {(r.node, r.root) for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(1, 61)} | {(300, 200), (250, 200)}
    assert simhash.components(spark.createDataFrame([], "a long, b long")).collect() == []


def shingles(text, n=5):
    ws = (text or "").lower().split()
    return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} or ({tuple(ws)} if ws else set())


def brute_groups(rows):
    """Groups of places whose texts reach each other over Jaccard similarities of 0.8 and more."""
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = sets[i] | sets[j]
            if not both or len(sets[i] & sets[j]) / len(both) >= 0.8:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return group


def stay(rows):
    groups = brute_groups(rows)
    return sorted((min((rows[k] for k in range(len(rows)) if groups[k] == g), key=lambda r: (r[0] is None, r[0])) for g in set(groups)), key=str)


def edited(rng, text, n):
    ws = text.split()
    for at in rng.sample(range(len(ws)), n):
        ws[at] = "edit" + str(rng.randrange(10**6))
    return " ".join(ws)


def test_one_of_each_group_of_near_copies_stays(make_docs):
    rng = random.Random(12)
    rows = []
    for n, edits in ((60, 1), (150, 2), (150, 3), (400, 6), (2000, 20), (400, 60)):
        base = words(rng, n)
        rows += [(len(rows), base)] + [(len(rows) + 1 + k, edited(rng, base, edits)) for k in range(5)]
    rows += [(len(rows) + k, words(rng, 80)) for k in range(150)]
    rng.shuffle(rows)
    got = sorted(((r.doc_id, r.text) for r in simhash.keep_one(make_docs(rows)).collect()), key=str)
    assert got == stay(rows)
    assert len(got) < len(rows) - 15


def test_one_of_each_group_stays_with_odd_rows(make_docs):
    rows = [(5, "a b c d"), (3, "a b c d"), (3, "A b c  d"), (9, "other words stand here"), (None, "a b c d"), (None, "lone words without an id"), (None, None), (7, " "), (8, "")]
    docs = make_docs(rows)
    for _ in range(2):
        kept = sorted(((r.doc_id, (r.text or "").lower().split()) for r in simhash.keep_one(docs).collect()), key=str)
        assert kept == sorted([(3, "a b c d".split()), (9, "other words stand here".split()), (None, "lone words without an id".split()), (7, [])], key=str)
        docs = docs.repartition(5)
    # an id that is repeated with another text loses none, and a copy under it goes
    one, two = "first text of its own with six", "second text that is quite another one"
    got = simhash.keep_one(make_docs([(3, one), (3, two)])).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(3, one), (3, two)]
    got = simhash.keep_one(make_docs([(1, two), (3, one), (3, two)])).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, two), (3, one)]
    # repeated rows leave one, the same on every run
    same = make_docs([(4, one, lang, "s") for lang in ("en", "de", "fr", None)] * 3)
    picks = {tuple(map(tuple, simhash.keep_one(same.repartition(n)).collect())) for n in (1, 2, 5)}
    assert len(picks) == 1 and len(picks.pop()) == 1
    assert simhash.keep_one(make_docs([])).collect() == []
    assert len(simhash.keep_one(make_docs(ODD)).collect()) == len({tuple((t or "").split()) for _, t in ODD})


def test_wide_fingerprints_by_hand():
    text = words(random.Random(3), 90)
    hashes = sorted({xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles(text)})
    assert simhash.shingle_hashes(text.upper() + "\n").tolist() == hashes
    full = (1 << 64) - 1

    def mixed(h, k):
        z = (h + 0x9E3779B97F4A7C15 * (k + 1)) & full
        z = ((z ^ z >> 30) * 0xBF58476D1CE4E5B9) & full
        z = ((z ^ z >> 27) * 0x94D049BB133111EB) & full
        return z ^ z >> 31

    bits = [2 * sum(mixed(h, k) >> b & 1 for h in hashes) > len(hashes) for k in range(4) for b in range(64)]
    assert np.unpackbits(np.frombuffer(simhash.wide_fingerprint(text), np.uint8)).tolist() == bits
    assert simhash.wide_fingerprint(None) == simhash.wide_fingerprint(" ") == bytes(32)


def test_wide_trie_join_and_forest_equal_brute_force():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, (4, 4), dtype=np.uint64)
    keys = base[rng.integers(0, 4, 120)]
    for k in range(120):
        for at in rng.integers(0, 256, rng.integers(0, 60)):
            keys[k, at // 64] ^= np.uint64(1) << np.uint64(at % 64)
    keys = keys[np.lexsort(keys.T[::-1])]
    bits = lambda a, b: sum(bin(int(x) ^ int(y)).count("1") for x, y in zip(keys[a], keys[b]))
    want = {(a, b): bits(a, b) for a in range(120) for b in range(a + 1, 120) if bits(a, b) <= 56}
    for leaves in (16, 1024):
        i, j = simhash.trie_join(keys, [(0, 120, 0, 120)], 56, leaves)
        assert {(min(p), max(p)) for p in zip(i.tolist(), j.tolist())} == set(want)
    cost = simhash.differing(keys, i, j)
    chosen = simhash.spanning_forest(i, j, cost, 120)
    parent, total = list(range(120)), 0

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), c in sorted(want.items(), key=lambda x: x[1]):
        if root(a) != root(b):
            parent[root(a)] = root(b)
            total += c
    assert len(chosen) == 120 - len({root(k) for k in range(120)}) and cost[chosen].sum() == total


def test_large_roots_are_dealt_without_loss(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2, 256)
    rows = [base ^ (rng.random(256) < 0.1) for _ in range(80)]
    prints = spark.createDataFrame([(bytearray(np.packbits(r.astype(np.uint8)).tobytes()),) for r in rows], "print binary")
    for chunk in (4, 1 << 12):
        edges = [(bytes(r.a), bytes(r.b)) for r in simhash.near_links(prints, 80, chunk=chunk).collect()]
        parent = {bytes(r.print): bytes(r.print) for r in prints.collect()}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            parent[root(a)] = root(b)
        assert len({root(x) for x in parent}) == 1
