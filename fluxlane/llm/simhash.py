"""SimHash near-duplicates by a self-join of binary tries.

Texts are lower-cased (A-Z) and split into words; three-word shingles, repeats
included, are hashed with XXH64 (seed 42), and a fingerprint bit is set if it is
set in over half of the hashes. Two fingerprints are linked if ``BUDGET`` bits or
fewer differ; documents reachable over links form a component.

The join walks a trie of fingerprints against itself: a pair of nodes becomes
the four pairs of their children, unlike children add a differing bit, and a
pair is pruned once it has more than the budget. To spread it over a cluster,
the 64 bits are cut into BUDGET + 1 blocks. Fingerprints within the budget agree
in one block at least, so tries are rooted at (block, its value), bits rotated
so that the block comes first. A root with many fingerprints is dealt out by
pairs of deeper nodes that are within the budget of each other. Each task emits
a spanning forest of the links it finds, never all pairs; components are then
merged with large-star and small-star rounds on the executors.

Null, empty and blank texts have fingerprint 0 and are linked like any other.
Rows with a null doc_id link too, but a component takes the smallest id that is
not null. Copies share a fingerprint, and only distinct fingerprints are
joined. Extra columns are ignored.

``keep_one`` links by similarity instead: Jaccard of ``NEAR_WORDS``-word shingles
of ``NEAR`` or more. Two texts of that similarity differ in about 15 % of their
SimHash bits, so it takes wider fingerprints (``NEAR_BITS``) of the distinct
shingles and a budget of three standard deviations above. No block needs to
agree then; tries are rooted at the values of small sets of bits, as many sets as
bring ``RECALL`` for pairs just at ``NEAR`` (more for closer ones), by the number
of fingerprints. A task walks its tries in pairs as above, and emits a minimum
spanning forest of its links by differing bits, the likeliest links of each
text; the shingles themselves confirm them. A root of many fingerprints is dealt
out by pairs of chunks. Fingerprints of very near copies that are all
different are compared with each other there: time grows with the square of
such a group's share of a root, though it spreads over tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxlane.llm.common import checkpoint, in_batches

SHINGLE, SEED, BUDGET = 3, 42, 2
#: A trie with more fingerprints is dealt out by its deeper nodes.
ROOT_BOUND = 1 << 15
#: A task walks so many fingerprints at once, or one trie.
FOREST = 1 << 16
#: Node pairs walked at once, and pairs of leaves that a node pair may hold to be compared at once.
FRONT, LEAVES, NEAR_LEAVES = 1 << 16, 16, 1024
#: (left rotation, width) of the blocks.
BLOCKS = ((0, 21), (21, 21), (42, 22))
#: Links of ``keep_one``: words of a shingle, least Jaccard similarity, bits of a fingerprint.
NEAR_WORDS, NEAR, NEAR_BITS = 5, 0.8, 256
#: Share of the pairs just at ``NEAR`` whose bits meet in some root, about; fingerprints that a root is to hold.
RECALL, ROOT_SIZE = 0.97, 64
#: Chunk of a root that is dealt out; a task reads two at once.
NEAR_CHUNK = 1 << 12
_CHUNK = 1 << 18
_ALL = (1 << 64) - 1


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the words have each bit set, lowest bit first."""
    bits = np.unpackbits(np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    whole = len(bits) // 255 * 255
    # sums of 255 bits fit a byte
    return bits[:whole].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64) + bits[whole:].sum(0, dtype=np.int64)


def fingerprint(text: str | None) -> int:
    """The text's fingerprint, unsigned."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # both know ASCII only
    if not words:
        return 0
    joined, width = b" ".join(words), min(SHINGLE, len(words))
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    digest, total, set_bits = xxhash.xxh64_intdigest, len(words) - width + 1, np.zeros(64, np.int64)
    for at in range(0, total, _CHUNK):
        n = min(_CHUNK, total - at)
        pairs = zip(start[at : at + n].tolist(), end[at + width - 1 : at + width - 1 + n].tolist(), strict=True)
        h = np.fromiter((digest(joined[a:b], SEED) for a, b in pairs), np.uint64, n)
        set_bits += bit_counts(h)
    return int.from_bytes(np.packbits(2 * set_bits > total, bitorder="little").tobytes(), "little")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id and print (the 64 bits as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_batches(batches):
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "print": pa.array([_signed(fingerprint(t)) for t in batch.column("text").to_pylist()], pa.int64())})

    chosen = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, f"doc_id {dict(chosen.dtypes)['doc_id']}, print long")


def differing(keys: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many bits of the rows ``i`` and ``j`` of ``keys`` differ."""
    return np.bitwise_count(keys[i] ^ keys[j]).sum(1, dtype=np.int16)


def trie_join(keys: np.ndarray, roots: list[tuple[int, int, int, int]], budget: int = BUDGET, leaves: int = LEAVES) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j), i != j, of all pairs within ``budget`` bits, from pairs of root ranges.

    ``keys``: unsigned, or rows of unsigned words, sorted within each range.
    ``roots``: (start, stop, start, stop); a range with itself finds its own
    pairs. Node pairs of ``leaves`` pairs or fewer are compared at once.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []
    zeros: dict[int, np.ndarray] = {}
    keys = keys.reshape(len(keys), -1)
    bottom = 64 * keys.shape[1]

    def split(depth: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if depth not in zeros:
            zeros[depth] = np.append(0, np.cumsum((keys[:, depth // 64] >> np.uint64(63 - depth % 64)) & np.uint64(1) == 0))
        return a + zeros[depth][b] - zeros[depth][a]

    stack = [(0, np.array(roots, np.int64).reshape(-1, 4), np.zeros(len(roots), np.int64))]
    while stack:
        depth, nodes, off = stack.pop()
        if len(nodes) > FRONT:
            stack += [(depth, nodes[at : at + FRONT], off[at : at + FRONT]) for at in range(0, len(nodes), FRONT)]
            continue
        m, n = nodes[:, 1] - nodes[:, 0], nodes[:, 3] - nodes[:, 2]
        few = m * n <= leaves
        if few.any() or depth == bottom:
            few |= depth == bottom
            for at in np.array_split(np.flatnonzero(few), max(1, int((m * n)[few].sum() >> 22))):
                count = (m * n)[at]
                k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                i, j = np.repeat(nodes[at, 0], count) + k // np.repeat(n[at], count), np.repeat(nodes[at, 2], count) + k % np.repeat(n[at], count)
                near = (differing(keys, i, j) <= budget) & (i != j)
                found.append((i[near], j[near]))
            nodes, off = nodes[~few], off[~few]
            if not len(nodes):
                continue
        s, t = split(depth, nodes[:, 0], nodes[:, 1]), split(depth, nodes[:, 2], nodes[:, 3])
        same = (nodes[:, 0] == nodes[:, 2]) & (nodes[:, 1] == nodes[:, 3])
        left, right = np.stack([nodes[:, 0], s], 1), np.stack([s, nodes[:, 1]], 1)
        left2, right2 = np.stack([nodes[:, 2], t], 1), np.stack([t, nodes[:, 3]], 1)
        more = np.concatenate([np.concatenate(x, 1) for x in ((left, left2), (right, right2), (left, right2), (right[~same], left2[~same]))])
        bits = np.concatenate([off, off, off + 1, off[~same] + 1])
        live = (more[:, 0] < more[:, 1]) & (more[:, 2] < more[:, 3]) & (bits <= budget)
        if live.any():
            stack.append((depth + 1, more[live], bits[live]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` places, the smallest place that links reach."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        was = label.copy()
        for x in (i, j):
            np.minimum.at(label, label[x], low)
            np.minimum.at(label, x, low)
        label = label[label]
        if np.array_equal(label, was):
            return label
    return label


def links(distinct: DataFrame, root_bound: int = ROOT_BOUND) -> DataFrame:
    """(a, b): prints linked within the budget, a spanning forest of each trie's links."""

    def turned(r: int) -> F.Column:
        p = F.col("print")
        return p if r == 0 else F.shiftleft(p, r).bitwiseOR(F.shiftrightunsigned(p, 64 - r))

    rows = None
    for n, (r, width) in enumerate(BLOCKS):
        part = distinct.select(F.lit(n).alias("block"), F.shiftrightunsigned(turned(r), 64 - width).alias("root"), turned(r).alias("key"), F.lit(width).alias("width"))
        rows = part if rows is None else rows.unionByName(part)
    large = rows.groupBy("block", "root").count().filter(F.col("count") > root_bound)
    depth = F.least(F.lit(12), F.ceil(F.log2(F.col("count") / root_bound)).cast("int") + 1)
    rows = rows.join(large.select("block", "root", depth.alias("depth")), ["block", "root"], "left")
    # a node of a large trie meets every node at its depth that is within the budget
    node = F.expr("shiftrightunsigned(shiftleft(key, width), 64 - depth)")
    masks = F.expr(f"filter(sequence(0L, shiftleft(1L, depth) - 1), m -> bit_count(m) <= {BUDGET})")
    rows = rows.withColumn("node", F.when(F.col("depth").isNotNull(), node)).withColumn("other", F.explode(F.when(F.col("depth").isNotNull(), F.transform(masks, lambda m: m.bitwiseXOR(F.col("node")))).otherwise(F.array(F.lit(None).cast("long")))))
    low, high = F.coalesce(F.least("node", "other"), F.lit(-1).cast("long")), F.coalesce(F.greatest("node", "other"), F.lit(-1).cast("long"))
    rows = rows.select("block", "root", "key", low.alias("n1"), high.alias("n2"), (F.coalesce("node", F.lit(-1).cast("long")) != low).cast("int").alias("side"))
    group = ["block", "root", "n1", "n2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at in _whole_groups(batches, ["block", "root", "n1", "n2", "side"], 4, lambda b: b.column("key").to_numpy()[:, None]):
            yield from _walk(at)

    return rows.repartition(*group).sortWithinPartitions(*group, "side", "key").mapInArrow(run, "a long, b long")


def _whole_groups(batches: Iterator[pa.RecordBatch], names: list[str], n_key: int, keys) -> Iterator[np.ndarray]:
    """Stretches of whole groups as rows of (the columns ``names``, whether n1 and n2 differ, keys); ``n_key`` columns tell groups apart."""
    held: list[np.ndarray] = []
    bound = FOREST
    for b in batches:
        code = [b.column(c).to_numpy().astype(np.int64) for c in names]
        held.append(np.concatenate([np.stack([*code, (code[2] != code[3]).astype(np.int64)], 1), keys(b)], 1))
        if sum(map(len, held)) >= bound:
            at = np.concatenate(held)
            # the last group may go on
            whole = np.flatnonzero((at[1:, :n_key] != at[:-1, :n_key]).any(1))
            if len(whole):
                yield at[: whole[-1] + 1]
            held = [at[whole[-1] + 1 :] if len(whole) else at]
            bound = max(FOREST, 2 * len(held[0]))
    if held:
        yield np.concatenate(held)


def _roots(rows: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Pairs of ranges to walk, of rows (block, root, n1, n2, side, cross, ...): a node with itself, or with the other side."""
    cut = np.flatnonzero((rows[1:, :5] != rows[:-1, :5]).any(1)) + 1
    start, stop = np.append(0, cut), np.append(cut, len(rows))
    roots = []
    for k, (a, b) in enumerate(zip(start.tolist(), stop.tolist(), strict=True)):
        if not rows[a, 5]:
            if b - a > 1:
                roots.append((a, b, a, b))
        elif rows[a, 4] and k and (rows[a, :4] == rows[start[k - 1], :4]).all():
            roots.append((int(start[k - 1]), a, a, b))
    return roots


def _walk(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The forests of whole groups of rows (block, root, n1, n2, side, cross, key)."""
    # keys sort as signed longs; those of one root and side have the same sign, so order holds
    keys, roots = np.ascontiguousarray(rows[:, 6]).view(np.uint64), _roots(rows)
    if not roots:
        return
    i, j = trie_join(keys, roots)
    label = forest(i, j, len(keys))
    of = np.flatnonzero(label != np.arange(len(keys)))
    turn = np.array([r for r, _ in BLOCKS], np.uint64)[rows[of, 0]]
    back = lambda k: np.where(turn == 0, k, (k >> turn) | (k << ((np.uint64(64) - turn) & np.uint64(63)))).view(np.int64)
    if len(of):
        yield pa.record_batch({"a": pa.array(back(keys[of])), "b": pa.array(back(keys[label[of]]))})


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge, roots left out; by large-star and small-star rounds."""

    def tidy(e: DataFrame) -> DataFrame:
        return checkpoint(e.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    e = tidy(edges.toDF("u", "v"))
    now = mark(e)
    while now[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        e = tidy(both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = tidy(e.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))))
        was, now = now, mark(e)
        if now == was:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id of every row of ``documents``."""
    prints = checkpoint(fingerprints(documents))
    first = prints.groupBy("print").agg(F.min("doc_id").alias("first"))
    found = components(links(first.select("print")))
    # only prints that have links need a look at their component
    linked = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
    least = linked.join(first, F.col("node") == F.col("print")).groupBy("root").agg(F.min("first").alias("component"))
    known = linked.join(least, "root").select(F.col("node").alias("print"), "component")
    classes = first.join(known, "print", "left").select("print", F.coalesce("component", "first").alias("component_id"))
    return prints.join(classes, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def wide_fingerprint(text: str | None) -> bytes:
    """``NEAR_BITS`` SimHash bits of the text's distinct shingles; zeros if it has no word.

    Each shingle's XXH64 is mixed into as many words as the bits need.
    """
    h = shingle_hashes(text)
    counts = np.zeros(NEAR_BITS, np.int64)
    for at in range(0, len(h), _CHUNK):
        for k in range(NEAR_BITS // 64):
            z = h[at : at + _CHUNK] + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) & _ALL)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            z ^= z >> np.uint64(31)
            counts[64 * k : 64 * k + 64] += bit_counts(z)
    return np.packbits(2 * counts > len(h)).tobytes()


def shingle_hashes(text: str | None, width: int = NEAR_WORDS) -> np.ndarray:
    """Sorted distinct XXH64 of the text's shingles, lower-cased; of the whole sequence if it has fewer words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, width = b" ".join(words), min(width, len(words))
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    start = np.append(0, end[:-1] + 1)
    digest, total = xxhash.xxh64_intdigest, len(words) - width + 1
    parts = []
    for at in range(0, total, _CHUNK):
        n = min(_CHUNK, total - at)
        pairs = zip(start[at : at + n].tolist(), end[at + width - 1 : at + width - 1 + n].tolist(), strict=True)
        parts.append(np.fromiter((digest(joined[a:b], SEED) for a, b in pairs), np.uint64, n))
    return np.unique(np.concatenate(parts))


def flip_share(similarity: float = NEAR) -> float:
    """Share of bits in which texts of a Jaccard similarity differ: the angle between their shingle sets, of pi."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def near_budget(similarity: float = NEAR) -> int:
    p = flip_share(similarity)
    return math.ceil(NEAR_BITS * p + 3 * math.sqrt(NEAR_BITS * p * (1 - p)))


def root_bits(n: int, similarity: float = NEAR, recall: float = RECALL) -> np.ndarray:
    """Places of the bits of each root set (sets x bits), for ``n`` fingerprints."""
    width = max(8, math.ceil(math.log2(max(n, 1) / ROOT_SIZE + 1)))
    sets = math.ceil(math.log(1 - recall) / math.log(1 - (1 - flip_share(similarity)) ** width))
    rng = np.random.default_rng(8)
    # sets use all bits in turn
    deck = np.concatenate([rng.permutation(NEAR_BITS) for _ in range(-(-sets * width // (NEAR_BITS // width * width)))])
    deck = deck.reshape(-1, NEAR_BITS)[:, : NEAR_BITS // width * width].reshape(-1, width)
    return deck[:sets]


def spanning_forest(i: np.ndarray, j: np.ndarray, cost: np.ndarray, n: int) -> np.ndarray:
    """Places in (i, j) of a minimum spanning forest: every part takes its cheapest link, until none is left."""
    order = np.lexsort((j, i, cost))
    i, j, label, taken = i[order], j[order], np.arange(n), []
    at = np.arange(len(i))
    while len(at):
        a, b = label[i[at]], label[j[at]]
        at, a, b = at[a != b], a[a != b], b[a != b]
        if not len(at):
            break
        best = np.full(n, len(order))
        np.minimum.at(best, a, at)
        np.minimum.at(best, b, at)
        chosen = np.unique(best[best < len(order)])
        taken.append(chosen)
        label = forest(label[i[chosen]], label[j[chosen]], n)[label]
    return order[np.concatenate(taken)] if taken else np.zeros(0, np.int64)


def near_links(distinct: DataFrame, n: int, similarity: float = NEAR, recall: float = RECALL, chunk: int = NEAR_CHUNK) -> DataFrame:
    """(a, b): fingerprints (column ``print``, binary) within the budget, a minimum spanning forest of each root's links."""
    places, budget = root_bits(n, similarity, recall), near_budget(similarity)
    weight = 1 << np.arange(places.shape[1], dtype=np.int64)
    words = NEAR_BITS // 64

    def rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_batches(batches, 1 << 18):
            prints = b.column("print").to_pylist()
            bits = np.unpackbits(np.frombuffer(b"".join(prints), np.uint8).reshape(len(prints), -1), axis=1)
            for k, at in enumerate(places):
                yield pa.record_batch({"block": pa.array(np.full(len(prints), k, np.int32)), "root": pa.array(bits[:, at].astype(np.int64) @ weight), "print": pa.array(prints, pa.binary())})

    rows = distinct.select("print").mapInArrow(rooted, "block int, root long, print binary")
    large = rows.groupBy("block", "root").count().filter(F.col("count") > chunk).select("block", "root", F.ceil(F.col("count") / chunk).cast("long").alias("chunks"))
    rows = checkpoint(rows).join(large, ["block", "root"], "left")
    # a chunk of a large root meets every chunk of it
    mine = F.pmod(F.xxhash64("print"), F.coalesce("chunks", F.lit(1).cast("long")))
    rows = rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("chunks", F.lit(1).cast("long")) - 1)))
    rows = rows.select("block", "root", F.least("mine", "other").alias("n1"), F.greatest("mine", "other").alias("n2"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "print")
    group = ["block", "root", "n1", "n2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def keys(b: pa.RecordBatch) -> np.ndarray:
            return np.frombuffer(b"".join(b.column("print").to_pylist()), ">u8").astype(np.uint64).view(np.int64).reshape(-1, words)

        for at in _whole_groups(batches, [*group, "side"], 4, keys):
            prints, roots = np.ascontiguousarray(at[:, 6:]).view(np.uint64), _roots(at)
            if not roots:
                continue
            i, j = trie_join(prints, roots, budget, NEAR_LEAVES)
            at = spanning_forest(i, j, differing(prints, i, j), len(prints))
            if len(at):
                whole = prints.astype(">u8")
                yield pa.record_batch({c: pa.array([whole[k].tobytes() for k in x[at].tolist()], pa.binary()) for c, x in (("a", i), ("b", j))})

    return rows.repartition(*group).sortWithinPartitions(*group, "side", "print").mapInArrow(run, "a binary, b binary")


def confirmed(links: DataFrame, texts: DataFrame, similarity: float = NEAR) -> DataFrame:
    """The links (a, b) whose texts have a Jaccard similarity of shingles that is large enough.

    ``texts``: print and text of each fingerprint that has a link, once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_batches(batches):
            yield pa.record_batch({"print": b.column("print"), "hashes": pa.array([shingle_hashes(t).view(np.int64) for t in b.column("text").to_pylist()], pa.list_(pa.int64()))})

    sets = checkpoint(texts.select("print", "text").mapInArrow(run, "print binary, hashes array<long>"))
    both = links.join(sets.toDF("a", "h"), "a").join(sets.toDF("b", "g"), "b")
    shared = F.size(F.array_intersect("h", "g"))
    # the union as a difference: sets have no repeats
    return both.filter(shared >= similarity * (F.size("h") + F.size("g") - shared)).select("a", "b")


def keep_one(documents: DataFrame, similarity: float = NEAR, recall: float = RECALL) -> DataFrame:
    """One row of each group of near copies, the one of the smallest doc_id, with all its columns.

    Rows without an id come last; of rows of the same id, the one whose text has
    the smaller hash stays, and of repeated rows the one with the smallest hash of
    all columns. Texts without a word form one group.
    """
    text = F.col("text").cast("string")
    mark = F.xxhash64(text, text.isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_batches(batches):
            yield pa.record_batch({"doc_id": b.column("doc_id"), "mark": b.column("mark"), "print": pa.array([wide_fingerprint(t) for t in b.column("text").to_pylist()], pa.binary())})

    chosen = documents.select("doc_id", mark.alias("mark"), text.alias("text"))
    prints = checkpoint(chosen.mapInArrow(run, f"doc_id {dict(chosen.dtypes)['doc_id']}, mark long, print binary"))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark")
    first = checkpoint(prints.groupBy("print").agg(F.min(place).alias("first")))
    pairs = near_links(first, first.count(), similarity, recall)
    pairs = checkpoint(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    # only the texts of fingerprints that have a link are looked at
    named = first.join(pairs.select(F.explode(F.array("a", "b")).alias("print")), "print", "left_semi").select("print", F.col("first.doc_id").alias("_id"), F.col("first.mark").alias("_mark"))
    texts = chosen.join(named, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))).dropDuplicates(["print"])
    found = components(confirmed(pairs, texts, similarity))
    linked = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
    least = linked.join(first, F.col("node") == F.col("print")).groupBy("root").agg(F.min("first").alias("first"))
    alone = first.join(linked, F.col("print") == F.col("node"), "left_anti").select("first")
    kept = checkpoint(alone.unionByName(least.select("first")).select(F.col("first.doc_id").alias("_id"), F.col("first.mark").alias("_mark")))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_mark"))
    times = prints.withColumnRenamed("mark", "_own").join(kept, same, "left_semi").groupBy("doc_id", "_own").count()
    times = checkpoint(times.select(F.col("doc_id").alias("_id"), F.col("_own").alias("_mark"), "count"))
    rows = documents.select(F.struct("*").alias("row"), "doc_id", mark.alias("_own"))
    once = rows.join(times.filter("count = 1"), same, "left_semi").select("row.*")
    more = rows.join(times.filter("count > 1"), same, "left_semi").groupBy("doc_id", "_own").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*")
    return once.unionByName(more)
