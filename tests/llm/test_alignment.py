"""Alignment of two tokenizers against a token-by-token walk."""

from __future__ import annotations

import hashlib
import random
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fluxlane.llm import alignment, catalog

SF = "/root/testdata/sf0.001"
NAMES = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]


@pytest.fixture(scope="module")
def pair() -> alignment.Pair:
    with open(alignment.A_PATH, "rb") as a, open(alignment.B_PATH, "rb") as b:
        return alignment.Pair(a.read(), b.read())


@pytest.fixture(scope="module")
def by_json() -> Tokenizer:
    found = Tokenizer.from_file(alignment.A_PATH)
    found.encode_special_tokens = True
    return found


def walk(pair: alignment.Pair, by_json: Tokenizer, text: str | None) -> tuple[int, int, int, str, Counter]:
    """n_a, n_b, n_groups, groups, and how often each id pair is linked."""
    if not text:
        return 0, 0, 0, "", Counter()
    a, b = by_json.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
    pieces = [pair.b.id_to_piece(x) for x in b]
    b_bytes = [bytes([int(p[3:5], 16)]) if pair.b.is_byte(x) else p.replace("▁", " ").encode() for x, p in zip(b, pieces, strict=True)]
    alphabet = alignment.byte_alphabet()
    a_bytes = [bytes(alphabet[c] for c in by_json.id_to_token(x)) for x in a]
    raw = (" " + text).encode()
    if b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
        return 0, 0, 0, "", Counter()
    a_end, b_end = list(accumulate(map(len, a_bytes))), list(accumulate(map(len, b_bytes)))
    cuts = sorted({*a_end} & {*b_end})
    groups = [([], []) for _ in cuts]
    for side, ids, ends in ((0, a, a_end), (1, b, b_end)):
        for x, end in zip(ids, ends, strict=True):
            groups[bisect_left(cuts, end)][side].append(x)
    links = Counter((x, y) for g, h in groups for x in g for y in h)
    return len(a), len(b), len(cuts), ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups), links


def by_hand(pair: alignment.Pair, by_json: Tokenizer, texts: list[str | None]) -> list[tuple]:
    found = [walk(pair, by_json, t) for t in texts]
    docs = Counter(p for *_, links in found for p in links)
    most: dict[int, int] = {}
    for (a, _), n in docs.items():
        most[a] = max(most.get(a, 0), n)
    rows = []
    for n_a, n_b, n_groups, groups, links in found:
        digest = hashlib.sha256(groups.encode()).hexdigest() if n_a else ""
        rows.append((n_a, n_b, n_groups, sum(links.values()), digest, sum(t for p, t in links.items() if docs[p] == most[p[0]]), sum(t * docs[p] for p, t in links.items())))
    return rows


ODD = [
    None, "", " ", "\n", "a", "a", "x▁y", "hello <|endoftext|> there</s><s>", "日本語🎉" * 40, "é" * 1001, "aaaa" * 700, "=" * 3000 + "ab" * 500,
    "\x00a\x01 b", "don't DON'T  two words\r\n\r\n", "the cat sat", "the cat sat", "<0x41> <unk>", "🏳️‍🌈 flag", "a" * 20000,
]


@pytest.mark.parametrize("head", [0, 3, 1 << 18])
def test_align_and_weigh(spark, pair, by_json, head):
    rng = random.Random(11)
    texts = ODD + ["".join(rng.choice("ab cde\n.é日🎉'0") for _ in range(rng.randrange(120))) for _ in range(40)]
    rows = [(n // 2 if n else None, t, "clash", [0]) for n, t in enumerate(texts)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, n_a string, pairs array<int>").repartition(3)
    aligned = alignment.align(documents).withColumn("groups_sha256", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")).drop("groups")
    got = [(r.doc_id, *(r[c] for c in NAMES)) for r in alignment.weigh(aligned, head).collect()]
    expected = [(r[0], *x) for r, x in zip(rows, by_hand(pair, by_json, texts), strict=True)]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_wide_groups_in_blocks(pair, by_json, monkeypatch):
    """Groups of many tokens, linked by distinct ids and cut into blocks."""
    texts = ["aaaa" * 300, "日" * 99, "b" * 50]
    monkeypatch.setattr(alignment, "WIDE", 3)
    monkeypatch.setattr(alignment, "_BLOCK", 2)
    found = alignment.link_batch(pair, texts)
    for n, t in enumerate(texts):
        links = walk(pair, by_json, t)[-1]
        assert dict(zip(found["pairs"][n].as_py(), found["times"][n].as_py(), strict=True)) == {(a << alignment.B_BITS) | b: k for (a, b), k in links.items()}


def test_query_on_whole_table(spark, pair, by_json):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: tuple(r[c] for c in NAMES) for r in catalog.op11_tokenizer_alignment(spark, SF).collect()}
    assert got == dict(zip([d for d, _ in texts], by_hand(pair, by_json, [t for _, t in texts]), strict=True))


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.weigh(alignment.align(empty)).count() == 0
