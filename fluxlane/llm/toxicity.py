"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A document is the set of hashed 3- to 6-grams of its lower-cased
characters. Each feature counts as its log-count ratio ``r`` between toxic and
clean training documents, vectors are scaled to a fixed length, and a logistic
regression weighs them. The learned vector (``w * r``, one float a bucket) has
``2 ** HASH_BITS`` entries whatever the corpus, so broadcasting it is bounded.

Null and empty texts have no feature but the frame of blanks, and get the
score of that; without any label the score is 0. Ties, repeated rows and extra
columns change nothing: each row is scored alone, and only the named columns
are read. Rows with a null id are scored like others. A very long text takes no
more room than the table of buckets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxlane.llm.common import crc_bucket, in_batches, sampled_texts

HASH_BITS = 20
ORDERS = (3, 4, 5, 6)
#: Documents that the regression is fitted on, about, at most.
TRAIN_BOUND = 4000
#: A feature must be in so many training documents, with such a log-count ratio.
LEAST_DOCS, LEAST_RATIO = 5, 1.0
LENGTH = 10.0
PENALTY = 0.01
STEPS = 100
#: Characters hashed at once: bounds the memory that a very long text takes.
BLOCK = 1 << 20
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D], np.uint32)


def ngram_buckets(text: str | None) -> np.ndarray:
    """Sorted distinct buckets of the text's character n-grams."""
    text = f" {(text or '').lower()} "
    hit = np.zeros(1 << HASH_BITS, bool)
    reach = max(ORDERS) - 1
    for at in range(0, len(text), BLOCK):
        codes = np.frombuffer(text[at : at + BLOCK + reach].encode("utf-32-le", "replace"), np.uint32)
        for n in ORDERS:
            if len(codes) < n:
                continue
            h = np.full(len(codes) - n + 1, n * 0x01000193, np.uint32)
            for k in range(n):
                h = (h ^ codes[k : k + len(h)]) * _MIX[k]
                h ^= h >> np.uint32(15)
            hit[h >> np.uint32(32 - HASH_BITS)] = True
    return np.flatnonzero(hit).astype(np.int32)


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"label": b["label"], "buckets": [packed(ngram_buckets(t)) for t in b["text"]]})


def packed(buckets: np.ndarray) -> bytes:
    """Buckets as numbers, or, of many, as a bit each: 2 ** HASH_BITS / 8 bytes at most."""
    if 32 * len(buckets) <= 1 << HASH_BITS:
        return b"n" + buckets.tobytes()
    hit = np.zeros(1 << HASH_BITS, bool)
    hit[buckets] = True
    return b"b" + np.packbits(hit).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    if data[:1] == b"n":
        return np.frombuffer(data, np.int32, offset=1)
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=1))).astype(np.int32)


def fit(documents: DataFrame, labels: DataFrame, bound: int = TRAIN_BOUND, seed: int = 11) -> tuple[np.ndarray, np.ndarray, float]:
    """(w * r, r, intercept), from the rows of ``labels`` whose crc32(doc_id) mod 4 is not 2.

    The regression sees a hash sample of about ``bound`` labelled documents;
    their features are made on the executors, from whole texts.
    """
    known = labels.filter((crc_bucket("doc_id", 4) != 2) & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").alias("label")).filter("doc_id is not null")
    rows = sampled_texts(documents, known, bound, seed).mapInPandas(_features, "label int, buckets binary").collect()
    size = 1 << HASH_BITS
    if not rows:
        return np.zeros(size), np.zeros(size), -np.inf
    rows.sort(key=lambda x: (x["label"], hashlib.md5(x["buckets"]).digest()))  # any order will do that all runs share
    return fit_ratios([x["buckets"] for x in rows], np.array([x["label"] for x in rows], float))


def fit_ratios(sets: list[bytes], y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Log-count ratios and the regression, from the packed buckets and the labels of documents.

    Documents are held as numbers of used buckets, half the room of the packed
    ones at the most, and walked in batches.
    """
    counts = np.zeros((2, 1 << HASH_BITS))
    for data, label in zip(sets, y, strict=True):
        counts[int(label), unpacked(data)] += 1
    ratio = np.log((counts[1] + 1) / (y.sum() + 2)) - np.log((counts[0] + 1) / ((1 - y).sum() + 2))
    ratio[(counts.sum(0) < LEAST_DOCS) | (np.abs(ratio) < LEAST_RATIO)] = 0
    used = np.flatnonzero(ratio)
    place = np.full(1 << HASH_BITS, -1, np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    held = []
    for data in sets:
        at = place[unpacked(data)]
        held.append(at[at >= 0])
    r = ratio[used]
    scale = np.array([LENGTH / np.sqrt(max((r[at] ** 2).sum(), 1e-12)) for at in held])
    step_by = 256  # rows of a batch are told by a byte
    batches = []
    for at in range(0, len(y), step_by):
        part = held[at : at + step_by]
        batches.append((slice(at, at + len(part)), np.repeat(np.arange(len(part), dtype=np.uint8), [len(x) for x in part]), np.concatenate(part)))
    del held
    w, m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, STEPS + 1):
        grad, by_bucket = PENALTY * w, r * w[:-1]
        grad[-1] = 0
        for rows, row, col in batches:
            k = scale[rows]
            p = 1 / (1 + np.exp(-np.clip(np.bincount(row, by_bucket[col], len(k)) * k + w[-1], -30, 30)))
            miss = (p - y[rows]) / len(y)
            grad[:-1] += np.bincount(col, (miss * k)[row], len(used)) * r
            grad[-1] += miss.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    weights = np.zeros(1 << HASH_BITS)
    weights[used] = w[:-1] * r
    return weights, ratio, float(w[-1])


def score(documents: DataFrame, model: tuple[np.ndarray, np.ndarray, float], threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``documents``."""
    weights, ratio, bias = model
    kept = documents.sparkSession.sparkContext.broadcast((weights.astype(np.float32), (ratio**2).astype(np.float32), bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, square, b = kept.value
        for batch in in_batches(batches):
            out = np.zeros(batch.num_rows)
            for i, text in enumerate(batch.column("text").to_pylist()):
                at = ngram_buckets(text)
                norm = float(square[at].sum(dtype=float))
                z = b + (LENGTH / np.sqrt(norm) * float(w[at].sum(dtype=float)) if norm else 0.0)
                out[i] = 0.0 if z == -np.inf else 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": out, "predicted": (out >= threshold).astype(np.int32)})

    chosen = documents.select("doc_id", (crc_bucket("doc_id", 4) == 2).alias("held_out"), F.col("text").cast("string").alias("text"))
    kind = dict(chosen.dtypes)["doc_id"]
    return chosen.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
