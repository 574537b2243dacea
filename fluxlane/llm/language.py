"""Language ID with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram binds (multiplies)
the vectors of its letters, permuted (rotated) by their place; a text bundles
(adds) its trigrams; a language bundles its texts. A document belongs to the
language whose prototype has the largest cosine with its own bundle.

A text that is null or has no letter is ``und`` with score 0, and so is every
text if nothing was learned. Equal cosines go to the language first by code
point. Repeated rows and extra columns change nothing. Blanks frame words;
digits, marks and white space count as blanks. Prototypes are bundled from about
``LANGUAGE_BOUND`` documents of each language, so a rare language has one too.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxlane.llm.common import crc_bucket, in_batches

DIMENSIONS = 1024
#: Letters beyond this number share vectors with others.
ALPHABET = 4096
#: Documents that a language's prototype is bundled from, about, at most.
LANGUAGE_BOUND = 1000
BLOCK = 1 << 20


@functools.cache
def letter_of() -> np.ndarray:
    """Code point -> row of the letter vectors; 0 stands for a blank."""
    table = np.zeros(0x110000, np.uint16)
    for c in range(0x110000):
        if chr(c).isalpha():
            table[c] = 1 + c % (ALPHABET - 1)
    return table


@functools.cache
def vectors() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The letter vectors, rotated by two places, by one and by none."""
    v = np.random.default_rng(20240229).choice(np.array([-1, 1], np.int8), (ALPHABET, DIMENSIONS))
    return np.roll(v, 2, 1), np.roll(v, 1, 1), v


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(distinct trigrams as numbers, how often each occurs); none without a letter."""
    text = f" {(text or '').lower()} "
    keys, counts = [], []
    for at in range(0, len(text), BLOCK):
        a = letter_of()[np.frombuffer(text[at : at + BLOCK + 2].encode("utf-32-le", "replace"), np.uint32)].astype(np.int64)
        k = (a[:-2] << 24) | (a[1:-1] << 12) | a[2:]
        k, n = np.unique(k[(a[:-2] > 0) | (a[1:-1] > 0)], return_counts=True)  # two blanks say nothing
        keys.append(k)
        counts.append(n)
    if len(keys) == 1:
        return keys[0], counts[0]
    k, back = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(back, np.concatenate(counts), len(k)).astype(np.int64)


def bundle(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of the trigrams' vectors; exact, as all are whole numbers."""
    two, one, none = vectors()
    out = np.zeros(DIMENSIONS, np.float64)
    for at in range(0, len(keys), 2048):
        k = keys[at : at + 2048]
        bound = two[k >> 24] * one[(k >> 12) & 4095] * none[k & 4095]
        out += counts[at : at + 2048].astype(np.float32) @ bound.astype(np.float32)
    return out


def _bundled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[str, np.ndarray] = {}
    for b in batches:
        for lang, text in zip(b["lang"], b["text"], strict=True):
            v = bundle(*trigrams(text))
            if norm := np.linalg.norm(v):
                sums[lang] = sums.get(lang, 0) + np.rint(v * (4096 / norm))  # each text counts alike; whole numbers add up alike in any order
    if sums:
        yield pd.DataFrame({"lang": list(sums), "vector": [v.tolist() for v in sums.values()]})


def fit(documents: DataFrame, bound: int = LANGUAGE_BOUND, seed: int = 13) -> tuple[list[str], np.ndarray]:
    """(languages, unit prototypes), from documents whose crc32(doc_id) mod 4 is not 2.

    A hash sample of about ``bound`` of each language is bundled on the
    executors; the model, a vector a language, is what comes to the driver.
    """
    known = documents.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).filter((crc_bucket("doc_id", 4) != 2) & F.col("lang").isNotNull())
    # the share of a language that is taken; rows of one id differ by their text
    share = known.groupBy("lang").agg((F.lit(float(bound)) / F.count("*")).alias("share"))
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), F.col("text")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = known.join(F.broadcast(share), "lang").filter(draw < F.col("share")).select("lang", "text")  # a row a language, as the model has
    sums: dict[str, np.ndarray] = {}
    for x in sample.mapInPandas(_bundled, "lang string, vector array<double>").collect():
        sums[x["lang"]] = sums.get(x["lang"], 0) + np.array(x["vector"])
    names = sorted(n for n, v in sums.items() if np.any(v))
    if not names:
        return [], np.zeros((0, DIMENSIONS))
    return names, np.stack([sums[n] / np.linalg.norm(sums[n]) for n in names])


def identify(documents: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """doc_id, held_out, lang_pred and score (the cosine, 0 if negative)."""
    kept = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, prototypes = kept.value
        for batch in in_batches(batches):
            lang, score = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            for i, text in enumerate(batch.column("text").to_pylist()):
                v = bundle(*trigrams(text))
                if names and (norm := np.linalg.norm(v)):
                    cosine = prototypes @ v / norm
                    best = int(np.argmax(cosine))
                    lang[i], score[i] = names[best], min(1.0, max(0.0, float(cosine[best])))
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": pa.array(lang, pa.string()), "score": score})

    chosen = documents.select("doc_id", (crc_bucket("doc_id", 4) == 2).alias("held_out"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, f"doc_id {dict(chosen.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double")
