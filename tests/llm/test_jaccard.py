"""The Jaccard join against all pairs, and its signatures against their promise."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from fluxlane.llm import catalog, jaccard
from samples import ODD, words

SF = "/root/testdata/sf0.001"


def shingles(text: str | None, width: int = 4) -> frozenset:
    found = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return frozenset(tuple(found[n : n + width]) for n in range(max(1, len(found) - width + 1))) if found else frozenset()


def brute(rows: list[tuple], least: int = 85) -> list[tuple]:
    """(doc_id, n_shingles, component_id) from all pairs that share a shingle."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(n: int) -> int:
        while label[n] != n:
            n = label[n]
        return n

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= least * len(a | b):
                label[root(i)] = root(j)
    ids: dict[int, int] = {}
    for n, (doc, _) in enumerate(rows):
        if doc is not None:
            ids[root(n)] = min(ids.get(root(n), doc), doc)
    return sorted(((d, len(s), ids.get(root(n))) for n, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def edited(rng: random.Random, text: str, edits: int) -> str:
    """The text with some words replaced, dropped or added."""
    found = text.split(" ")
    for _ in range(edits):
        at = rng.randrange(len(found))
        kind = rng.randrange(3)
        found[at : at + (kind != 1)] = [] if kind == 0 and len(found) > 1 else [words(rng, 1)]
    return " ".join(found)


def test_signatures_meet_whenever_sets_link():
    """Sets of any size that are just similar enough share a signature."""
    rng = np.random.default_rng(12)
    for size in [*range(1, 60), 100, 127, 128, 129, 179, 400, 1000, 3000]:
        for _ in range(40 if size < 130 else 4):
            a = rng.integers(0, 1 << 64, size, np.uint64)
            # features that differ, dealt to both sides
            most = (2 * size * 15) // 185
            drop = int(rng.integers(0, most + 1))
            add = int(rng.integers(0, most + 1))
            b = np.concatenate([a[drop:], rng.integers(0, 1 << 64, add, np.uint64)])
            common, union = size - drop, size + add
            if len(b) and 100 * common >= 85 * union and drop + add:
                assert np.intersect1d(jaccard.signatures(a), jaccard.signatures(b)).size, (size, drop, add)


def test_empty_subsets_stay_out():
    """Sets without a feature in a part don't all meet: there, they are dealt anew."""
    rng = np.random.default_rng(3)
    seen: dict[int, int] = {}
    for n in range(3000):
        for s in set(jaccard.signatures(rng.integers(0, 1 << 64, 7 + n % 40, np.uint64)).tolist()):
            seen[s] = seen.get(s, 0) + 1
    assert max(seen.values()) == 1


def test_bands():
    assert jaccard.bands_of(1)[0].low == 1
    for size in range(1, 5000):
        found = jaccard.bands_of(size)
        assert found[0].low <= size <= found[0].high
        assert found[-1].low <= size * 100 // 85 <= found[-1].high
        for b in found:
            assert b.k == 2 * b.high * 15 // 185 and b.n1 > b.k // (b.k2 + 1)


def groups_of_copies(rng: random.Random) -> list[tuple]:
    rows = []
    for n in range(40):
        base = words(rng, rng.choice([3, 4, 7, 12, 20, 33, 60, 150, 400]))
        rows += [edited(rng, base, rng.randrange(0, 1 + len(base.split()) // 30 + 1)) for _ in range(1 + n % 7)]
    return [(n * 3 + 5, t) for n, t in enumerate(rows)]


@pytest.mark.parametrize("chunk", [512, 3])
def test_components_equal_all_pairs(spark, make_docs, monkeypatch, chunk):
    """Groups of near copies around the least similarity, odd rows, repeated rows and ids; ``chunk`` 3 cuts every cluster."""
    rng = random.Random(85)
    rows = groups_of_copies(rng) + ODD + [(2, "other text of the same id"), (900, "A b C d"), (901, "a B c\td"), (902, "a b c"), (903, "a b c "), (904, "a b")]
    got = jaccard.near_duplicates(make_docs(rows), chunk=chunk).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows)


def test_one_large_group_of_copies_that_differ(spark, make_docs):
    """A chain of copies, a star around one text, and texts that share half of their words with them."""
    rng = random.Random(7)
    base = words(rng, 120)
    chain, rows = base, []
    for n in range(60):
        chain = edited(rng, chain, 1)
        rows.append((n, chain))
    rows += [(100 + n, edited(rng, base, 2)) for n in range(60)]
    rows += [(200 + n, base[: len(base) // 2] + " " + words(rng, 60)) for n in range(60)]
    rows += [(300 + n, base) for n in range(50)]
    got = jaccard.near_duplicates(make_docs(rows), chunk=16).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows)


def test_hot_signatures_need_no_common_task(spark, make_docs):
    rng = random.Random(1)
    base = words(rng, 60)
    docs = make_docs([(n, edited(rng, base, 1)) for n in range(30)] + [(100 + n, words(rng, 30)) for n in range(20)])
    sketches = jaccard.sketched(docs).cache()
    plain = {tuple(r) for r in jaccard.shared_signatures(sketches).collect()}
    assert plain and plain == {tuple(r) for r in jaccard.shared_signatures(sketches, hot=2).collect()}


def test_bitmaps_bound_what_is_common():
    rng = np.random.default_rng(5)
    for n in (1, 2, 15, 16, 17, 100, 300, 2000):
        a = rng.integers(0, 1 << 64, n, np.uint64)
        for kept in (0, n // 2, n - n // 20, n):
            b = np.concatenate([a[:kept], rng.integers(0, 1 << 64, max(1, n * 6 // 5 - kept), np.uint64)])
            most = jaccard.most_common(jaccard.bitmap(a), len(a), jaccard.bitmap(b), len(b))
            assert kept <= most <= kept + 0.4 * (n - kept) + 3


def test_clusters_and_pairs_hold_all_that_share_a_signature(spark):
    rng = random.Random(4)
    rows = sorted({(s, rng.randrange(60)) for s in range(80) for _ in range(rng.choice([2, 2, 3, 9]))})
    shared = spark.createDataFrame([(s, n) for s, n in rows if sum(t == s for t, _ in rows) > 1], "signature long, node long")
    clusters = jaccard.clusters_of(shared, 2)
    of = {r.node: r.cluster for r in clusters.collect()}
    nodes: dict[int, list[int]] = {}
    for s, n in shared.collect():
        nodes.setdefault(s, []).append(n)
    expected = {(a, b) for group in nodes.values() for a in group for b in group if a < b and of.get(a, a) != of.get(b, b)}
    got = [tuple(r) for r in jaccard.cross_pairs(shared, clusters).collect()]
    assert set(got) == expected and len(got) == len(expected)


def test_query_on_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = catalog.op12_ngram_jaccard(spark, SF).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows)


def test_empty_table_and_no_words(spark, make_docs):
    assert jaccard.near_duplicates(make_docs([])).count() == 0
    got = jaccard.near_duplicates(make_docs([(1, None), (2, ""), (None, " ")])).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == [(1, 0, 1), (2, 0, 2), (None, 0, None)]
