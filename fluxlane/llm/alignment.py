"""Alignment of two tokenizers over the same texts, by the places where both end a token.

A batch of texts is tokenized by both, and the tokens of the whole batch are laid
end to end as bytes, each document at its offset. One bincount of the ends of A's
tokens and one of B's give the places where either ends; where both do, a group
of tokens ends. Prefix sums of these cuts, taken at the offsets of documents, give
each document's groups. Two tokens of a group whose kinds differ are linked.

``align`` gives the groups and links of documents, ``weigh`` how common each link
is in the corpus. The most common id pairs, ``HEAD`` at most, are looked up in a
broadcast table; all others meet their counts in a join.

Null and empty texts, and texts that either tokenizer doesn't give back byte for
byte (such as those with U+2581), have no tokens. Every row is a document of its
own, whatever its doc_id. Texts of any length are tokenized whole. A group of many
tokens is linked by its distinct ids, in blocks. Extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxlane.llm.common import in_batches, remove, scratch

A_PATH, B_PATH = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Where A splits texts before it merges bytes (a fixed value of the tokenizer).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: B ids take so many bits of an id pair.
B_BITS = 15
#: Id pairs that are broadcast with their counts, at most.
HEAD = 1 << 18
#: Groups of more links are linked by their distinct ids.
WIDE = 1 << 10
_BLOCK = 1 << 20


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the rest from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(sorted({*range(256)} - {*own}))}


class Pair:
    """Both tokenizers, made of the bytes of their files."""

    def __init__(self, a_file: bytes, b_file: bytes) -> None:
        alphabet = byte_alphabet()
        ranks = {bytes(alphabet[c] for c in token): n for token, n in json.loads(a_file)["model"]["vocab"].items()}
        # ids are in the order of merges, so they serve as ranks; strings of special tokens stay plain text
        self.a = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        self.a_bytes = self._by_id(ranks)
        pieces = map(self.b.id_to_piece, range(self.b.get_piece_size()))
        self.b_bytes = self._by_id({n: bytes([int(p[3:5], 16)]) if self.b.is_byte(n) else p.replace("▁", " ").encode() for n, p in enumerate(pieces)})
        if len(self.b_bytes) > 1 << B_BITS or len(self.a_bytes) > 1 << (31 - B_BITS):
            raise ValueError("an id pair must fit 31 bits")
        self.a_size, self.b_size = (np.fromiter(map(len, t), np.int64, len(t)) for t in (self.a_bytes, self.b_bytes))
        self.b_flat, self.b_at = np.frombuffer(b"".join(self.b_bytes), np.uint8), np.cumsum(self.b_size) - self.b_size
        # an id in decimal with what may follow it in a group: , | for A and , ; or nothing for B
        self.a_text, self.b_text = (np.array([f"{n}{end}" for end in ends for n in range(len(t))], object) for t, ends in ((self.a_bytes, ",|"), (self.b_bytes, (",", ";", ""))))

    @staticmethod
    def _by_id(found: dict) -> list[bytes]:
        by_id = {v: k for k, v in found.items()} if isinstance(next(iter(found)), bytes) else found
        return [by_id.get(n, b"") for n in range(max(by_id) + 1)]

    def tokenize(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids by A and how many each text has, the same by B, and bytes of each text with its space; none for texts that don't come back."""
        raw = [(" " + t).encode() if t else b"" for t in texts]
        a = [self.a.encode_ordinary(" " + t) if t else [] for t in texts]
        b = self.b.encode([t or "" for t in texts], num_threads=1)
        n_a, n_b, size = (np.fromiter(map(len, x), np.int64, len(texts)) for x in (a, b, raw))
        a_ids, b_ids = (np.fromiter(chain.from_iterable(x), np.int64, int(n.sum())) for x, n in ((a, n_a), (b, n_b)))
        doc = lambda n: np.repeat(np.arange(len(texts)), n)
        same = (np.bincount(doc(n_a), self.a_size[a_ids], len(texts)) == size) & (np.bincount(doc(n_b), self.b_size[b_ids], len(texts)) == size)
        # A has a token for every byte, so its bytes come back; B's are compared where their number is right
        told = b_ids[same[doc(n_b)]]
        back = self.b_flat[_runs(self.b_at[told], self.b_size[told])]
        other = back != np.frombuffer(b"".join(compress(raw, same)), np.uint8)
        if other.any():
            same[np.unique(np.repeat(np.flatnonzero(same), size[same])[other])] = False
        if not same.all():
            a_ids, b_ids = a_ids[same[doc(n_a)]], b_ids[same[doc(n_b)]]
            n_a, n_b, size = n_a * same, n_b * same, size * same
        return a_ids, n_a, b_ids, n_b, size


@lru_cache(maxsize=1)
def _pair(a_file: bytes, b_file: bytes) -> Pair:
    return Pair(a_file, b_file)


def _runs(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ..., ``count`` of them, run after run."""
    return np.arange(count.sum()) + np.repeat(first - (np.cumsum(count) - count), count)


def link_batch(pair: Pair, texts: list[str | None]) -> dict[str, pa.Array]:
    """n_a, n_b, n_groups, n_links, groups, pairs and times of each text, from one pass over the batch's bytes."""
    a, n_a, b, n_b, size = pair.tokenize(texts)
    stop = np.cumsum(size)
    a_end, b_end = np.cumsum(pair.a_size[a]), np.cumsum(pair.b_size[b])
    total = int(stop[-1]) if len(stop) else 0
    cut = (np.bincount(a_end, minlength=total + 1) > 0) & (np.bincount(b_end, minlength=total + 1) > 0)
    done = np.cumsum(cut)  # groups that end at a byte or before it
    a_group, b_group = done[a_end - 1], done[b_end - 1]
    groups = int(done[-1])
    a_count, b_count = np.bincount(a_group, minlength=groups), np.bincount(b_group, minlength=groups)
    a_first, b_first = np.cumsum(a_count) - a_count, np.cumsum(b_count) - b_count
    n_links = a_count * b_count
    # a document's share of a running sum over groups
    doc_stop = done[stop]
    doc_start = np.append(0, doc_stop[:-1])
    links_so_far = np.append(0, np.cumsum(n_links))
    doc = np.repeat(np.arange(len(texts)), doc_stop - doc_start)

    # every token's place in "a,a|b;a|b,b": A's of a group, then B's
    out = np.empty(len(a) + len(b), object)
    a_last, b_last = (np.append(x[1:] != x[:-1], True)[: len(x)] for x in (a_group, b_group))
    ends = np.zeros(len(b), np.int64)
    ends[b_last] = 1
    ends[np.cumsum(n_b)[n_b > 0] - 1] = 2
    out[np.arange(len(a)) + b_first[a_group]] = pair.a_text[a + len(pair.a_bytes) * a_last]
    out[np.arange(len(b)) + (a_first + a_count)[b_group]] = pair.b_text[b + len(pair.b_bytes) * ends]
    at = np.append(0, np.cumsum(n_a + n_b))
    texts_of = ["".join(out[i:j].tolist()) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    narrow = np.flatnonzero(n_links <= WIDE)
    # B tokens of each A token, in groups of few links
    of = _runs(a_first[narrow], a_count[narrow])
    group = a_group[of]
    keys = (np.repeat((doc[group] << (31 + 1)) | (a[of] << B_BITS), b_count[group])) | b[_runs(b_first[group], b_count[group])]
    key, times = np.unique(keys, return_counts=True)
    wide = [(key, times)]
    for g in np.flatnonzero(n_links > WIDE).tolist():
        x, x_times = np.unique(a[a_first[g] : a_first[g] + a_count[g]], return_counts=True)
        y, y_times = np.unique(b[b_first[g] : b_first[g] + b_count[g]], return_counts=True)
        step = max(1, _BLOCK // len(y))
        for i in range(0, len(x), step):
            wide.append((((doc[g] << 32) | (x[i : i + step, None] << B_BITS) | y).ravel(), (x_times[i : i + step, None] * y_times).ravel()))
    if len(wide) > 1:
        key, where = np.unique(np.concatenate([k for k, _ in wide]), return_inverse=True)
        times = np.zeros(len(key), np.int64)
        np.add.at(times, where, np.concatenate([t for _, t in wide]))
    offsets = pa.array(np.searchsorted(key, np.arange(len(texts) + 1) << 32), pa.int32())
    lists = lambda x, kind: pa.ListArray.from_arrays(offsets, pa.array(x, kind))
    return {
        "n_a": pa.array(n_a), "n_b": pa.array(n_b), "n_groups": pa.array(doc_stop - doc_start), "n_links": pa.array(links_so_far[doc_stop] - links_so_far[doc_start]), "groups": pa.array(texts_of, pa.string()),
        "pairs": lists(key & 0x7FFFFFFF, pa.int32()), "times": lists(times, pa.int64()),
    }


def align(documents: DataFrame, a_path: str = A_PATH, b_path: str = B_PATH) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups, pairs and times of every row.

    groups: ids as ``a,a|b;a|b,b``. pairs: the distinct linked id pairs, A's id
    times 2^15 plus B's, ascending; times: how often each is linked. The files
    are read on the driver and sent to the executors, a few MB.
    """
    with open(a_path, "rb") as a, open(b_path, "rb") as b:
        files = documents.sparkSession.sparkContext.broadcast((a.read(), b.read()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(*files.value)
        for batch in in_batches(batches, 1 << 20):
            yield pa.record_batch({"doc_id": batch.column("doc_id")} | link_batch(pair, batch.column("text").to_pylist()))

    chosen = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    counts = "n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<int>, times array<long>"
    return chosen.mapInArrow(run, f"doc_id {dict(chosen.dtypes)['doc_id']}, {counts}")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, docs (how many documents hold it linked) and best (whether no pair of its A id has more)."""
    found = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs"))
    most = found.groupBy(F.shiftright("pair", B_BITS).alias("a")).agg(F.max("docs").alias("most"))
    return found.withColumn("a", F.shiftright("pair", B_BITS)).join(most, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def _head(counts: DataFrame, head: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """pair, docs, best of the most common pairs, ``head`` at most, by pair: all that reach the smallest power of two that keeps to it."""
    level = F.floor(F.log2("docs")).cast("int")
    least, kept = 64, 0
    for row in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):  # 64 rows at most
        kept += row["count"]
        if kept > head:
            break
        least = row.level
    rows = counts.filter(level >= least).orderBy("pair").toArrow()
    return tuple(rows.column(c).to_numpy() for c in ("pair", "docs", "best"))


def weigh(aligned: DataFrame, head: int = HEAD) -> DataFrame:
    """``aligned`` with n_best and count_sum in place of pairs and times.

    n_best: links whose pair is in as many documents as any of its A id;
    count_sum: over links, in how many documents their pair is.
    """
    spark = aligned.sparkSession
    folder = f"{scratch(spark)}/alignment-{uuid.uuid4().hex}"
    aligned.withColumn("_row", F.monotonically_increasing_id()).write.parquet(f"{folder}/links")
    links = spark.read.parquet(f"{folder}/links")
    pair_counts(links).write.parquet(f"{folder}/counts")
    counts = spark.read.parquet(f"{folder}/counts")
    common = spark.sparkContext.broadcast(_head(counts, head))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, docs, best = common.value
        for batch in batches:
            lists = batch.column("pairs")
            key, times = lists.flatten().to_numpy(), batch.column("times").flatten().to_numpy()
            at = np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
            place = np.minimum(np.searchsorted(pair, key), max(len(pair) - 1, 0))
            known = pair[place] == key if len(pair) else np.zeros(len(key), bool)
            so_far = lambda x: np.append(0, np.cumsum(np.where(known, x, 0)))
            n_best, count_sum, rest = so_far(times * best[place] if len(pair) else 0 * times), so_far(times * docs[place] if len(pair) else 0 * times), np.append(0, np.cumsum(~known))
            offsets = pa.array(rest[at], pa.int32())
            held = {c: batch.column(c) for c in batch.schema.names if c not in ("pairs", "times")}
            rare = {"pairs": pa.ListArray.from_arrays(offsets, pa.array(key[~known], pa.int32())), "times": pa.ListArray.from_arrays(offsets, pa.array(times[~known], pa.int64()))}
            yield pa.record_batch(held | rare | {"n_best": pa.array(n_best[at[1:]] - n_best[at[:-1]]), "count_sum": pa.array(count_sum[at[1:]] - count_sum[at[:-1]])})

    kept = [f"`{c}` {t}" for c, t in links.dtypes if c not in ("pairs", "times")]
    links.mapInArrow(run, ", ".join([*kept, "pairs array<int>, times array<long>, n_best long, count_sum long"])).write.parquet(f"{folder}/sums")
    remove(spark, f"{folder}/links")
    sums = spark.read.parquet(f"{folder}/sums")
    rare = sums.select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("_row", "x.pairs", "x.times")
    rare = rare.join(counts, F.col("pairs") == F.col("pair")).groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("times") * F.col("docs")).alias("_sum"))
    more = lambda c, d: (F.col(c) + F.coalesce(d, F.lit(0))).alias(c)
    held = [c for c in sums.columns if c not in ("pairs", "times", "_row", "n_best", "count_sum")]
    return sums.join(rare, "_row", "left").select(*held, more("n_best", "_best"), more("count_sum", "_sum"))
