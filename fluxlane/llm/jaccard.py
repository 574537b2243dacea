"""Exact Jaccard join of texts' word shingles by PartEnum signatures.

Two sets of shingles link if their Jaccard similarity is ``LEAST`` percent or
more. Sizes are cut into bands; sets of a band and the sets just below it that
may still link differ in k features at most. The feature domain is dealt by a
hash into n1 parts, so that in one part at least k // n1 features or fewer, k2,
differ; a part is dealt again into n2 parts, and every subset of n2 - k2 of them
is a signature: the two sets share one. Larger sets take k2 = 0, where a part is
its own subset.

A subset without a feature says nothing, and all sets that lack it would meet. So
there are more parts than needed: a set emits its empty subsets only if so many
parts have one that no other part need agree; and before it does so, it is dealt
anew, with other hashes, ``SEEDS`` times. A pair of sets meets in the first dealing
that serves one of them, since the other one takes part in that too.

Texts of equal sets are one node. Nodes that share ``STRONG`` signatures with the
first node that has them, or one that ``CROWD`` nodes have, are put into one
cluster, and a cluster's nodes are compared with each other block by block, by products of 0/1 matrices over the
hashes that they share. A large cluster is cut into chunks; each is compared with
itself and with the first one, which joins groups of near copies in linear time.
What lies outside a cluster's largest group then meets all chunks. Nodes of
different clusters that share any signature are pairs, CROWD at most a row; bitmaps of their hashes, an
upper bound of what they have in common, leave few of them to be compared. So no
link is lost, and pairs already joined over others are not looked at.

Null, empty and blank texts have no shingle and link with nothing, not with each
other. Texts of fewer than ``WORDS`` words have one shingle, all their words.
Repeated rows and equal texts share a component. Rows with a null doc_id link like
others, but a component takes its smallest id that is not null. Whole texts are
read, whatever their length. Extra columns are ignored; an empty table gives no
rows. Shingles, nodes and signatures are told apart by 64-bit hashes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, groupby
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxlane.llm.common import checkpoint, in_batches, scratch
from fluxlane.llm.simhash import components, forest, shingle_hashes

WORDS, LEAST = 4, 85
#: A band's largest size is so many fifths of its smallest.
BAND_FIFTHS = 7
#: Bands up to this size deal a part again (k2 = 1, n2 = 3): half as many signatures more, but a passage that texts share fills far fewer of them.
TWICE = 1024
SEEDS = 4
#: Rows of signatures that are looked through for hot ones, about, and how many of them make one hot.
HOT_SAMPLE, HOT = 1 << 22, 64
#: Signatures that put a node into the cluster of the first node that has them, and nodes of a signature that does so alone.
STRONG, CROWD = 4, 16
#: Nodes, and hashes of their sets, of a chunk of a cluster, about.
CHUNK, CHUNK_HASHES = 512, 1 << 21
#: How often roots are followed to their own.
JUMPS = 3
#: Rows of ids that are broadcast, at most.
FEW = 1 << 20
#: A node that holds more than one of so many rows is hot.
HOT_SHARE = 1024
_COLUMNS = 1 << 13


class Band(NamedTuple):
    number: int
    low: int
    high: int
    k: int
    n1: int
    k2: int
    n2: int


@lru_cache(maxsize=8)
def bands(largest: int, least: int = LEAST) -> tuple[Band, ...]:
    """The bands up to one that holds sizes of ``largest``."""
    found, low = [], 1
    while low <= largest:
        high = max(low, low * BAND_FIFTHS // 5)
        # of sizes a and b, (a + b) (100 - least) / (100 + least) features or fewer differ
        k = 2 * high * (100 - least) // (100 + least)
        k2, n2 = (1, 3) if high <= TWICE else (0, 1)
        spare = 0 if k2 else 1 + (k + 1) // 12
        found.append(Band(len(found), low, high, k, k // (k2 + 1) + 1 + spare, k2, n2))
        low = high + 1
    return tuple(found)


def bands_of(size: int, least: int = LEAST) -> list[Band]:
    """The bands of the larger set in which a set of ``size`` may link: its own, and those of sets up to 100 / least times as large."""
    most = size * 100 // least
    return [b for b in bands(1 << (most - 1).bit_length(), least) if b.high >= size and b.low <= most]


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def band_signatures(hashes: np.ndarray, band: Band) -> np.ndarray:
    """The set's signatures in a band."""
    n, subsets = band.n1 * band.n2, np.array(list(combinations(range(band.n2), band.n2 - band.k2)))
    out = []
    for seed in range(SEEDS):
        own = np.uint64(((band.number * SEEDS + seed + 1) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        z = _mix(hashes + own)
        part = (((z >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)
        total = np.zeros(n, np.uint64)
        np.add.at(total, part, _mix(z))
        count = np.bincount(part, minlength=n)
        total, count = total.reshape(band.n1, band.n2)[:, subsets].sum(2), count.reshape(band.n1, band.n2)[:, subsets].sum(2)
        empty = count == 0
        # parts that agree, but for k2 features, in every pair that is to link
        agree = band.n1 - band.k // (band.k2 + 1)
        serves = int(empty.any(1).sum()) < agree
        signature = _mix(total + _mix(np.arange(total.size, dtype=np.uint64).reshape(total.shape) + own))
        out.append(signature.ravel() if seed == SEEDS - 1 and not serves else signature[~empty])
        if serves:
            break
    return np.concatenate(out)


def signatures(hashes: np.ndarray, least: int = LEAST) -> np.ndarray:
    """All signatures of a set of hashes. Bands in which nothing may differ need none: equal sets are one node."""
    found = [band_signatures(hashes, b) for b in bands_of(len(hashes), least) if b.k] if len(hashes) else []
    return np.concatenate([np.zeros(0, np.uint64), *found])


def node_of(hashes: np.ndarray) -> int | None:
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63) if len(hashes) else None


def sketched(documents: DataFrame, least: int = LEAST, words: int = WORDS) -> DataFrame:
    """doc_id, mark (a hash of the text), node, n_shingles and signatures of every row; a task gives a node's signatures once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in in_batches(batches):
            nodes, sizes, signs = [], [], []
            for text in b.column("text").to_pylist():
                h = shingle_hashes(text, words)
                node = node_of(h)
                signs.append(signatures(h, least).view(np.int64) if node is not None and node not in seen else None)
                seen.add(node)
                nodes.append(node)
                sizes.append(len(h))
            yield pa.record_batch({"doc_id": b.column("doc_id"), "mark": b.column("mark"), "node": pa.array(nodes, pa.int64()), "n_shingles": pa.array(sizes, pa.int64()), "signatures": pa.array(signs, pa.list_(pa.int64()))})

    text = F.col("text").cast("string")
    chosen = documents.select("doc_id", F.xxhash64(text).alias("mark"), text.alias("text"))
    return chosen.mapInArrow(run, f"doc_id {dict(chosen.dtypes)['doc_id']}, mark long, node long, n_shingles long, signatures array<long>")


def shared_signatures(sketches: DataFrame, sample: int = HOT_SAMPLE, hot: int = HOT) -> DataFrame:
    """(signature, node), distinct, of the signatures that several nodes share.

    Signatures that a sample of about ``sample`` rows holds ``hot`` times are
    known to be shared: at most sample / hot, so they are broadcast and their
    rows need not meet in one task.
    """
    rows = sketches.select(F.explode("signatures").alias("signature"), "node")
    total = sketches.agg(F.sum(F.size("signatures"))).first()[0] or 0
    share = F.pmod(F.xxhash64("node", "signature"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / max(total, 1)))
    often = rows.filter(share).groupBy("signature").agg(F.count("*").alias("n"), F.min("node").alias("low"), F.max("node").alias("high")).filter((F.col("n") >= hot) & (F.col("low") < F.col("high")))
    often = checkpoint(often.select("signature"))
    whole = Window.partitionBy("signature")
    rest = rows.join(F.broadcast(often), "signature", "left_anti").withColumns({"low": F.min("node").over(whole), "high": F.max("node").over(whole)})
    return rest.filter("low < high").select("signature", "node").unionByName(rows.join(F.broadcast(often), "signature", "left_semi")).distinct()


def bitmap(hashes: np.ndarray) -> bytes:
    """Bits of the hashes modulo a power of two, four to eight a hash."""
    size = 4 << max(4, (len(hashes) - 1).bit_length())
    bits = np.zeros(size, bool)
    bits[(hashes & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def most_common(a: bytes, n_a: int, b: bytes, n_b: int) -> int:
    """How many hashes two sets of these bitmaps and sizes have in common at most: where only one has a bit, it has a hash of its own."""
    x, y = (np.frombuffer(v, np.uint64) for v in (a, b))
    while len(x) != len(y):
        # a hash modulo half the size
        x, y = (v if len(v) == min(len(x), len(y)) else v[: len(v) // 2] | v[len(v) // 2 :] for v in (x, y))
    return min(n_a - int(np.bitwise_count(x & ~y).sum()), n_b - int(np.bitwise_count(y & ~x).sum()))


def sets_of(documents: DataFrame, wanted: DataFrame, words: int = WORDS) -> DataFrame:
    """node, its sorted hashes, how many and their bitmap, of the nodes of ``wanted`` (node, doc_id, mark of one of its rows); a row for each repeat of that row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_batches(batches):
            found = [shingle_hashes(t, words) for t in b.column("text").to_pylist()]
            yield pa.record_batch({"node": b.column("node"), "hashes": pa.array([h.view(np.int64) for h in found], pa.list_(pa.int64())), "n": pa.array(map(len, found), pa.int64()), "bits": pa.array(map(bitmap, found), pa.binary())})

    text = F.col("text").cast("string")
    rows = documents.select("doc_id", text.alias("text"), F.xxhash64(text).alias("mark"))
    named = wanted.select("node", F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"))
    # texts stay where they are unless too many are wanted
    named = F.broadcast(named) if named.count() <= FEW else named
    found = rows.join(named, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))).select("node", "text")
    return found.mapInArrow(run, "node long, hashes array<long>, n long, bits binary")


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many hashes each set of ``left`` shares with each of ``right``."""
    x, y = np.concatenate(left), np.concatenate(right)
    both = np.intersect1d(x, y)
    out = np.zeros((len(left), len(right)))
    sides = []
    for sets, h in ((left, x), (right, y)):
        at = np.minimum(np.searchsorted(both, h), max(len(both) - 1, 0))
        known = both[at] == h if len(both) else np.zeros(len(h), bool)
        sides.append((np.repeat(np.arange(len(sets)), list(map(len, sets)))[known], at[known]))
    for start in range(0, len(both), _COLUMNS):
        a, b = (np.zeros((len(s), _COLUMNS), np.float32) for s in (left, right))
        for m, (row, column) in zip((a, b), sides, strict=True):
            inside = (column >= start) & (column < start + _COLUMNS)
            m[row[inside], column[inside] - start] = 1
        out += a @ b.T
    return out


def block_links(left: list[tuple], right: list[tuple] | None, least: int) -> list[tuple[int, int]]:
    """A spanning forest (larger node, smallest node) of the links between rows (node, component, hashes) of different components; ``right`` None: among themselves."""
    rows = left + (right or [])
    other = right or left
    if len(rows) < 2:
        return []
    sizes, parts = np.array([len(r[2]) for r in rows]), np.array([r[1] for r in rows])
    shared = common_counts([r[2] for r in left], [r[2] for r in other])
    i, j = np.indices(shared.shape).reshape(2, -1)
    j += len(left) if right else 0
    near = (100 * shared.ravel() >= least * (sizes[i] + sizes[j] - shared.ravel())) & (parts[i] != parts[j])
    label = forest(i[near], j[near], len(rows))
    # towards the smallest node of each part
    nodes = np.array([r[0] for r in rows], np.int64)
    least_of = np.full(len(rows), np.iinfo(np.int64).max)
    np.minimum.at(least_of, label, nodes)
    return [(n, m) for n, m in zip(nodes.tolist(), least_of[label].tolist(), strict=True) if n != m]


def block_join(blocks: DataFrame, sets: DataFrame, least: int = LEAST) -> DataFrame:
    """(a, b): links within blocks; ``blocks``: cluster, n1, n2, side, node, component. Sides 0 and 1 of a block meet; without side 1, its nodes meet each other."""
    key = ["cluster", "n1", "n2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                at, values = b.column("hashes").offsets.to_numpy(), b.column("hashes").values.to_numpy().view(np.uint64)
                keys = zip(*(b.column(c).to_pylist() for c in (*key, "side", "node", "component")), strict=True)
                for n, (*where, side, node, part) in enumerate(keys):
                    # a copy, so that a batch need not be kept whole
                    yield tuple(where), side, (node, part, values[at[n] : at[n + 1]].copy())

        for _, group in groupby(rows(), itemgetter(0)):
            sides: tuple[list, list] = ([], [])
            for _, side, row in group:
                sides[side].append(row)
            found = block_links(sides[0], sides[1] or None, least) if sides[0] else []
            if found:
                yield pa.record_batch({c: pa.array([e[n] for e in found], pa.int64()) for n, c in enumerate("ab")})

    return blocks.join(sets.select("node", "hashes"), "node").repartition(*key).sortWithinPartitions(*key, "side", "node").select(*key, "side", "node", "component", "hashes").mapInArrow(run, "a long, b long")


def node_links(clusters: DataFrame, sets: DataFrame, least: int = LEAST, chunk: int = CHUNK, chunk_hashes: int = CHUNK_HASHES) -> DataFrame:
    """(a, b): links between nodes of a cluster whose components are those of all its links. ``clusters``: node, cluster, n_shingles."""
    # by hashes or by nodes, whichever needs more chunks
    chunks = F.greatest(F.ceil(F.count("*") / chunk), F.ceil(F.sum("n_shingles") / chunk_hashes)).alias("chunks")
    sizes = clusters.groupBy("cluster").agg(chunks)
    nodes = checkpoint(clusters.join(sizes, "cluster").withColumn("mine", F.pmod(F.xxhash64("node"), "chunks")))
    itself = nodes.select("cluster", F.col("mine").alias("n1"), F.col("mine").alias("n2"), F.lit(0).alias("side"), "node", F.col("node").alias("component"))
    # chunk 0 meets every other chunk
    later = F.when(F.col("mine") > 0, F.array("mine")).otherwise(F.sequence(F.lit(1).cast("long"), F.col("chunks") - 1))
    first = nodes.filter("chunks > 1").select("cluster", F.lit(0).cast("long").alias("n1"), F.explode(later).alias("n2"), F.when(F.col("mine") > 0, 1).otherwise(0).alias("side"), "node", F.col("node").alias("component"))
    links = checkpoint(block_join(itself.unionByName(first), sets, least))
    # what is not in its cluster's largest group meets all chunks
    large = nodes.filter("chunks > 1")
    if large.isEmpty():
        return links
    known = followed(links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")))
    large = checkpoint(large.join(known, "node", "left").withColumn("component", F.coalesce("root", "node")).drop("root"))
    groups = large.groupBy("cluster", "component").count()
    main = groups.groupBy("cluster").agg(F.max_by("component", F.struct("count", "component")).alias("main"), F.count("*").alias("groups")).filter("groups > 1").drop("groups")
    open_ = large.join(main, "cluster")
    rest = open_.filter("component != main")
    counts = rest.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("h"))
    pieces = F.greatest(F.ceil(F.col("n") / chunk), F.ceil(F.col("h") / chunk_hashes))
    counts = counts.select("cluster", pieces.alias("pieces"))
    rest = rest.join(counts, "cluster").withColumn("piece", F.pmod(F.xxhash64("node"), "pieces"))
    every = F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)
    a = rest.select("cluster", F.col("piece").alias("n1"), F.explode(every).alias("n2"), F.lit(0).alias("side"), "node", "component")
    b = open_.join(counts, "cluster").select("cluster", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("n1"), F.col("mine").alias("n2"), F.lit(1).alias("side"), "node", "component")
    return links.unionByName(block_join(a.unionByName(b), sets, least))


def followed(parents: DataFrame) -> DataFrame:
    """``parents`` (node, root), each root smaller than its node, with roots of roots in their place, ``JUMPS`` times over.

    Nodes of long chains may keep a root that has one itself: they only make for
    more comparisons.
    """
    for _ in range(JUMPS):
        parents = checkpoint(parents)
        further = parents.toDF("root", "_further")
        parents = parents.join(further, "root", "left").select("node", F.coalesce("_further", "root").alias("root"))
    return parents


def clusters_of(shared: DataFrame, strong: int = STRONG, crowd: int = CROWD) -> DataFrame:
    """node and cluster of the nodes that share ``strong`` signatures or more, or a signature of ``crowd`` nodes or more, with the first node that has them: that with which a node shares most leads its cluster, and on."""
    low = shared.groupBy("signature").agg(F.min("node").alias("low"), F.count("*").alias("n"))
    weight = F.when(F.col("n") >= crowd, strong).otherwise(1)
    near = shared.join(low, "signature").filter("node != low").groupBy("node", "low").agg(F.sum(weight).alias("weight")).filter(F.col("weight") >= strong)
    led = checkpoint(followed(near.groupBy("node").agg(F.max_by("low", F.struct("weight", -F.col("low"))).alias("root"))))
    leaders = led.select(F.col("root").alias("node")).distinct().join(led, "node", "left_anti").select("node", F.col("node").alias("root"))
    return led.unionByName(leaders).withColumnRenamed("root", "cluster")


def cross_pairs(shared: DataFrame, clusters: DataFrame) -> DataFrame:
    """(a, b): nodes of different clusters that share a signature, once each, in no order."""
    at = shared.join(clusters, "node", "left").withColumn("cluster", F.coalesce("cluster", "node"))
    several = at.groupBy("signature").agg(F.min("cluster").alias("low"), F.max("cluster").alias("high")).filter("low < high")
    open_ = checkpoint(at.join(several.select("signature"), "signature", "left_semi"))
    # nodes outside a signature's largest cluster meet all its nodes: pairs within that one are never made
    counts = open_.groupBy("signature", "cluster").count()
    main = counts.groupBy("signature").agg(F.max_by("cluster", F.struct("count", "cluster")).alias("main"))
    a = open_.join(main, "signature").filter("cluster != main").select("signature", F.col("node").alias("a"), F.col("cluster").alias("_a"), "main")
    b = open_.select("signature", F.col("node").alias("b"), F.col("cluster").alias("_b"))
    # both ways round if neither is of the largest
    met = a.join(b, "signature").filter((F.col("_a") != F.col("_b")) & ((F.col("_b") == F.col("main")) | (F.col("a") < F.col("b"))))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def linked_pairs(pairs: DataFrame, sets: DataFrame, least: int = LEAST) -> DataFrame:
    """The pairs (a, b) of nodes that link: first those that may by their sizes, then by their bitmaps, then by their hashes."""

    def may(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("x", "m", "y", "n")), strict=True)
            kept = [100 * common >= least * (m + n - common) for x, m, y, n in rows for common in (most_common(x, m, y, n),)]
            yield b.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    sizes = sets.select("node", "n")
    sized = pairs.join(sizes.toDF("a", "m"), "a").join(sizes.toDF("b", "n"), "b").filter(100 * F.least("m", "n") >= least * F.greatest("m", "n"))
    bits = sets.select("node", "bits")
    likely = sized.join(bits.toDF("a", "x"), "a").join(bits.toDF("b", "y"), "b").select("a", "b", "x", "m", "y", "n").mapInArrow(may, "a long, b long")
    hashes = sets.select("node", "hashes")
    both = checkpoint(likely).join(hashes.toDF("a", "h"), "a").join(hashes.toDF("b", "g"), "b")
    shared = F.size(F.array_intersect("h", "g"))
    return both.filter(100 * shared >= least * (F.size("h") + F.size("g") - shared)).select("a", "b")


def near_duplicates(documents: DataFrame, least: int = LEAST, words: int = WORDS, chunk: int = CHUNK, chunk_hashes: int = CHUNK_HASHES) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) of every row of ``documents``."""
    spark = documents.sparkSession
    folder = f"{scratch(spark)}/jaccard-{uuid.uuid4().hex}"

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    sketches = stored(sketched(documents, least, words), "sketches")
    shared = stored(shared_signatures(sketches), "shared")
    rows = sketches.filter(F.col("node").isNotNull())
    firsts = checkpoint(rows.groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.max("n_shingles").alias("n_shingles"), F.min(F.struct("doc_id", "mark")).alias("of")))
    named = stored(shared.select("node").distinct().join(firsts, "node").select("node", "n_shingles", "of.doc_id", "of.mark"), "named")
    sets = stored(sets_of(documents, named, words), "sets")
    if not sets.groupBy("node").count().filter("count > 1").isEmpty():  # repeated rows
        sets = stored(sets.dropDuplicates(["node"]), "once")
    clusters = checkpoint(clusters_of(shared))
    within = node_links(clusters.join(named.select("node", "n_shingles"), "node"), sets, least, chunk, chunk_hashes)
    found = components(within.unionByName(linked_pairs(cross_pairs(shared, clusters), sets, least)))
    linked = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
    smallest = linked.join(firsts.select("node", "first"), "node").groupBy("root").agg(F.min("first").alias("smallest"))
    known = linked.join(smallest, "root").select("node", "smallest")
    classes = stored(firsts.join(known, "node", "left").select("node", "copies", F.coalesce("smallest", "first").alias("component_id")), "classes")
    # a node of more than a thousandth of all rows is hot: at most HOT_SHARE of them
    hot = F.broadcast(classes.filter(F.col("copies") > rows.count() // HOT_SHARE).select("node", "component_id"))
    out = ["doc_id", "n_shingles", "component_id"]
    alone = sketches.filter(F.col("node").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return rows.join(hot, "node").select(*out).unionByName(rows.join(hot, "node", "left_anti").join(classes, "node").select(*out)).unionByName(alone)


#: SQL of the query, by all pairs of texts that share a shingle.
ORACLE = r"""WITH RECURSIVE worded AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS held FROM worded),
sizes AS (SELECT doc_id, CAST(len(held) AS BIGINT) AS n FROM sets), each AS (SELECT doc_id, unnest(held) AS g FROM sets),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM each x JOIN each y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS d, a AS m FROM edges UNION SELECT r.d, e.b FROM reach r JOIN edges e ON e.a = r.m)
SELECT doc_id, n AS n_shingles, coalesce(low, doc_id) AS component_id FROM sizes LEFT JOIN (SELECT d, min(m) AS low FROM reach GROUP BY d) ON d = doc_id"""
