"""Quality: a linear-chain conditional random field over the lines of a document.

Each line is good or bad. Its features, and those of the lines before and
after it, give the emission scores; a 2 x 2 table gives the transitions. A
document's score is the mean of its lines' forward-backward marginals of
``good``, weighed by line length.

No line has a label of its own: line states are hidden while fitting, and a
label says how much of its document is good. The fit maximizes the likelihood of
the state of a character drawn at random, that is the cross-entropy of the
labelled share against the score. Beside the labelled documents it sees
``SPLICED`` documents put together from stretches of a good and of a bad one,
whose good share is known while the place of the seam isn't given: from them
transitions learn that a document may change its state.

Null, empty and blank texts have no line of any length and score 0, and so
does every text if there are no labels. Rows are scored one by one: ties,
repeated rows and extra columns change nothing. Texts are scored whole, in time
linear in their lines.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxlane.llm.common import crc_bucket, in_batches, sampled_texts

#: Documents that the field is fitted on, about, at most, and lines of each: of more, stretches from all over the text.
TRAIN_BOUND, TRAIN_LINES = 3000, 512
#: Spliced documents for each labelled one.
SPLICED = 0.5
PENALTY = 1e-4
STEPS = 80
#: Chains of so many lines are walked one by one.
LONG = 256
N_BASE = 14
_OTHER, _LOWER, _UPPER, _DIGIT, _SPACE, _STOP, _PAUSE, _SHOUT = range(8)


@functools.cache
def char_kinds() -> np.ndarray:
    """The kind of each code point."""
    kinds = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            kinds[c] = _UPPER if x.isupper() else _LOWER
        elif x.isdigit():
            kinds[c] = _DIGIT
        elif x.isspace():
            kinds[c] = _SPACE
    for marks, kind in (('.?…。？"', _STOP), (",;:'’-()", _PAUSE), ("!", _SHOUT)):
        kinds[[ord(x) for x in marks]] = kind
    return kinds


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines x 3 N_BASE + 1 features, line lengths); a line of no length has zeros."""
    codes = np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32)
    cuts = np.flatnonzero(codes == 10)
    start, end = np.append(0, cuts + 1), np.append(cuts, len(codes))
    keep = end > start
    start, end = start[keep], end[keep]
    if not len(start):
        return np.zeros((0, 3 * N_BASE + 1)), np.zeros(0)
    n, kinds = (end - start).astype(float), char_kinds()[codes]
    runs = np.stack([start, end], 1).ravel()  # the pieces between lines fall out
    count = np.stack([np.add.reduceat(np.append(kinds == k, False).astype(np.int64), runs)[::2] for k in range(8)], 1)
    share = count / n[:, None]
    letters = np.maximum(count[:, _LOWER] + count[:, _UPPER], 1)
    # words: a rolling sum names each, well enough to count the distinct ones of a line
    word = kinds != _SPACE
    first = np.flatnonzero(word & ~np.append(False, word[:-1]))
    mixed = np.where(word, (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (codes.astype(np.uint64) << np.uint64(17)), np.uint64(0))
    mixed *= 2 * _since(first, len(codes)) + np.uint64(1)
    names = np.add.reduceat(mixed, first) if len(first) else np.zeros(0, np.uint64)
    of = np.searchsorted(start, first, "right") - 1
    inside = first < end[np.maximum(of, 0)]
    of, names = of[inside], names[inside]
    words = np.bincount(of, minlength=len(start))
    order = np.lexsort((names, of))
    fresh = np.append(True, (np.diff(of[order]) != 0) | (np.diff(names[order]) != 0)) if len(of) else np.zeros(0, bool)
    distinct = np.bincount(of[order][fresh], minlength=len(start))
    total = np.bincount(of, names.astype(float), len(start))
    _, back = np.unique(np.stack([total, n], 1), axis=0, return_index=True)
    again = np.ones(len(start))
    again[back] = 0
    fullness = np.maximum(words, 1)
    last = kinds[end - 1]
    base = np.stack([
        np.log1p(n) / 8, share[:, _OTHER] * 4, share[:, _OTHER] > 0.05, count[:, _UPPER] / letters, (count[:, _UPPER] > 0.5 * letters),
        share[:, _DIGIT] * 4, share[:, _PAUSE] * 4, share[:, _STOP] * 4, share[:, _SHOUT] * 4, (last == _STOP) | (last == _SHOUT),
        np.minimum(n / fullness, 30) / 10, distinct / fullness, (distinct < 0.5 * fullness), again,
    ], 1).astype(float)
    return with_neighbours(base), n


def _since(first: np.ndarray, n: int) -> np.ndarray:
    """For each place, its distance from the latest of ``first`` (from 0 before the first)."""
    at = np.zeros(n, np.int64)
    if len(first):
        at[first] = first
        np.maximum.accumulate(at, out=at)
    return (np.arange(n) - at).astype(np.uint64)


def marginals(emission: np.ndarray, lengths: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over many chains at once.

    ``emission``: rows of all chains after one another, one column a state.
    Returns the marginals of the rows, the summed pair marginals of each chain
    and the chains' log partition functions. All lengths are 1 or more.
    """
    order = np.argsort(-lengths, kind="stable")
    start, size = (np.cumsum(lengths) - lengths)[order], lengths[order]
    most = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(1, most + 1), "right")
    add = lambda a: np.logaddexp(a[..., 0], a[..., 1])
    forward, backward = np.zeros_like(emission), np.zeros_like(emission)
    for t in range(most):
        at = start[: live[t]] + t
        forward[at] = emission[at] if t == 0 else emission[at] + np.stack([add(forward[at - 1] + transition[:, k]) for k in (0, 1)], 1)
    for t in range(most - 2, -1, -1):
        at = start[: live[t + 1]] + t
        after = emission[at + 1] + backward[at + 1]
        backward[at] = np.stack([add(after + transition[k]) for k in (0, 1)], 1)
    last = np.cumsum(lengths) - 1
    z = add(forward[last]) if len(lengths) else np.zeros(0)
    chain = np.repeat(np.arange(len(lengths)), lengths)
    single = np.exp(forward + backward - z[chain][:, None])
    pairs = np.zeros((len(lengths), 2, 2))
    inner = np.flatnonzero(chain[1:] == chain[:-1]) if len(chain) else np.zeros(0, int)
    for i in (0, 1):
        for j in (0, 1):
            p = np.exp(forward[inner, i] + transition[i, j] + emission[inner + 1, j] + backward[inner + 1, j] - z[chain[inner]])
            pairs[:, i, j] = np.bincount(chain[inner], p, len(lengths))
    return single, pairs, z


def long_marginals(odds: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """The marginals of good of one long chain, from each line's log-odds of good: two passes over plain numbers."""
    (bb, bg), (gb, gg) = np.exp(transition - transition.max()).tolist()
    e = np.clip(odds, -300, 300).tolist()
    forward, now = [], 0.0
    for k, x in enumerate(e):
        if k:
            r = math.exp(now)
            now = math.log((bg + gg * r) / (bb + gb * r))
        now = min(300.0, max(-300.0, now + x))
        forward.append(now)
    backward, now = [0.0], 0.0
    for x in reversed(e[1:]):
        r = math.exp(min(300.0, max(-300.0, now + x)))
        now = math.log((gb + gg * r) / (bb + bg * r))
        backward.append(now)
    return 1 / (1 + np.exp(-np.clip(np.array(forward) + np.array(backward[::-1]), -500, 500)))


def share_gradient(features: np.ndarray, lengths: np.ndarray, weight: np.ndarray, goal: np.ndarray, theta: np.ndarray) -> tuple[float, np.ndarray]:
    """(loss, gradient) of the cross-entropy between the chains' good shares ``goal`` and their scores, a mean over chains.

    ``weight``: each line's share of its document's characters. A score is the
    derivative of the log partition along ``weight``; so its gradient is the
    derivative of the marginals along it, taken as a central difference.
    """
    chain = np.repeat(np.arange(len(lengths)), lengths)
    transition, good = theta[-4:].reshape(2, 2), features @ theta[:-4]
    both = lambda odds: marginals(np.stack([np.zeros(len(odds)), odds], 1), lengths, transition)
    score = np.clip(np.bincount(chain, both(good)[0][:, 1] * weight, len(lengths)), 1e-6, 1 - 1e-6)
    loss = -(goal * np.log(score) + (1 - goal) * np.log(1 - score)).mean()
    slope = ((score - goal) / (score * (1 - score)) / len(lengths)).clip(-1e3, 1e3)
    h = 1e-4
    (s1, p1, _), (s0, p0, _) = both(good + h * weight), both(good - h * weight)
    by_line = (s1 - s0)[:, 1] / (2 * h) * slope[chain]
    by_pair = ((p1 - p0) / (2 * h) * slope[:, None, None]).sum(0)
    return loss, np.append(features.T @ by_line, by_pair.ravel())


def fit_chains(features: np.ndarray, lengths: np.ndarray, weight: np.ndarray, goal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weights of good against bad, transitions), by gradient descent. Every chain counts as one, however long."""
    theta, m, v = np.zeros(features.shape[1] + 4), 0.0, 0.0
    for step in range(1, STEPS + 1):
        grad = share_gradient(features, lengths, weight, goal, theta)[1] + PENALTY * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return theta[:-4], theta[-4:].reshape(2, 2)


def with_neighbours(base: np.ndarray) -> np.ndarray:
    """Lines' own features, those of the lines before and after, and a constant."""
    edge = np.zeros((1, N_BASE), base.dtype)
    return np.concatenate([base, np.concatenate([edge, base[:-1]]), np.concatenate([base[1:], edge]), np.ones((len(base), 1), base.dtype)], 1)


def stretches(n: int, most: int = TRAIN_LINES) -> np.ndarray:
    """Places of the lines that the fit sees of ``n``: all, or eight stretches spread evenly over the text."""
    if n <= most:
        return np.arange(n)
    width = most // 8
    return (np.linspace(0, n - width, 8).astype(np.int64)[:, None] + np.arange(width)).ravel()


def spliced(good: tuple[np.ndarray, np.ndarray], bad: tuple[np.ndarray, np.ndarray], rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, float]:
    """(features, lengths, good share) of a document made of a stretch of a good and one of a bad one, in either order."""
    parts = []
    for base, n in (good, bad):
        k = int(rng.integers(1, len(n) + 1))
        at = int(rng.integers(0, len(n) - k + 1))
        parts.append((base[at : at + k], n[at : at + k]))
    share = parts[0][1].sum() / (parts[0][1].sum() + parts[1][1].sum())
    if rng.random() < 0.5:
        parts.reverse()
    return with_neighbours(np.concatenate([p[0] for p in parts])), np.concatenate([p[1] for p in parts]), float(share)


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for text in b["text"]:
            x, n = line_features(text)
            at = stretches(len(n))
            rows.append(np.concatenate([x[at, :N_BASE], n[at, None]], 1).astype(np.float32).tobytes())
        yield pd.DataFrame({"label": b["label"], "lines": rows})


def fit(documents: DataFrame, labels: DataFrame, bound: int = TRAIN_BOUND, seed: int = 12) -> tuple[np.ndarray, np.ndarray] | None:
    """The field, from labels whose crc32(doc_id) mod 5 is not 0; None if there are none.

    It is fitted on a hash sample of about ``bound`` labelled documents, whose
    lines' features are made on the executors from whole texts; a document of
    more than ``TRAIN_LINES`` lines gives stretches. So no more than ``bound *
    TRAIN_LINES`` lines come to the driver.
    """
    known = labels.filter((crc_bucket("doc_id", 5) != 0) & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").alias("label")).filter("doc_id is not null")
    rows = sampled_texts(documents, known, bound, seed).mapInPandas(_features, "label int, lines binary").collect()
    rows = sorted((x for x in rows if len(x["lines"])), key=lambda x: (x["label"], bytes(x["lines"])))
    if not rows:
        return None
    each = [np.frombuffer(x["lines"], np.float32).reshape(-1, N_BASE + 1).astype(float) for x in rows]
    known = [(x[:, :N_BASE], x[:, N_BASE]) for x in each]
    chains = [(with_neighbours(base), n, float(x["label"])) for (base, n), x in zip(known, rows, strict=True)]
    good, bad = ([k for k, x in zip(known, rows, strict=True) if x["label"] == y] for y in (1, 0))
    rng = np.random.default_rng(seed)
    if good and bad:
        chains += [spliced(good[rng.integers(len(good))], bad[rng.integers(len(bad))], rng) for _ in range(int(SPLICED * len(rows)))]
    lengths = np.array([len(n) for _, n, _ in chains])
    weight = np.concatenate([n / n.sum() for _, n, _ in chains])
    return fit_chains(np.concatenate([x for x, _, _ in chains]), lengths, weight, np.array([y for _, _, y in chains]))


def line_marginals(text: str | None, model: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(marginal of good, length) of each line of a text that has a length."""
    features, n = line_features(text)
    odds = features @ model[0]
    if len(n) > LONG:
        return long_marginals(odds, model[1]), n
    return marginals(np.stack([np.zeros(len(odds)), odds], 1), np.array([len(n)]), model[1])[0][:, 1] if len(n) else n, n


def score_texts(texts: list[str | None], model: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    out = np.zeros(len(texts))
    if model is None:
        return out
    found = [line_features(t) for t in texts]
    for i, (x, n) in enumerate(found):
        if len(n) > LONG:
            out[i] = np.average(long_marginals(x @ model[0], model[1]), weights=n)
    some = [i for i, (_, n) in enumerate(found) if 0 < len(n) <= LONG]
    if some:
        odds, n = np.concatenate([found[i][0] for i in some]) @ model[0], np.concatenate([found[i][1] for i in some])
        lengths = np.array([len(found[i][1]) for i in some])
        good = marginals(np.stack([np.zeros(len(odds)), odds], 1), lengths, model[1])[0][:, 1]
        at = np.cumsum(lengths) - lengths
        out[some] = np.add.reduceat(good * n, at) / np.add.reduceat(n, at)
    out[[not (t or "").strip() for t in texts]] = 0
    return np.clip(out, 0, 1)


def score(documents: DataFrame, model: tuple[np.ndarray, np.ndarray] | None, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``documents``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_batches(batches):
            out = score_texts(batch.column("text").to_pylist(), model)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": out, "predicted": (out >= threshold).astype(np.int32)})

    chosen = documents.select("doc_id", (crc_bucket("doc_id", 5) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, f"doc_id {dict(chosen.dtypes)['doc_id']}, held_out boolean, score double, predicted int")


def keep_good(documents: DataFrame, model: tuple[np.ndarray, np.ndarray] | None, threshold: float = 0.3) -> DataFrame:
    """The rows of ``documents``, all their columns, that score ``threshold`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_batches(batches):
            good = score_texts(batch.column("text").to_pylist(), model) >= threshold
            yield batch.filter(pa.array(good))

    return documents.mapInArrow(run, documents.schema)
