"""Mixing sources to target weights by a low-discrepancy schedule.

Slot ``i`` of the schedule falls on the point ``frac(i * golden ratio)`` of the
unit interval, which is cut by the sources' cumulative shares, so that every
stretch of slots keeps the shares. Slots of a source are ranked; rank ``r``
takes block ``r mod blocks`` of it, in its pass ``r div blocks``. Blocks are
runs of equal numbers of words in the source's shuffled documents; a document
may lie in several. ``taken`` sums, over a document's blocks, the words there
times the number of slots that take the block, three at most.

The schedule has ``RESOLUTION`` slots or somewhat more, at every size of the
corpus: what a slot holds grows instead. A source's blocks are so narrow that
its target fills ``SLOTS_A_SOURCE`` slots, or has a slot a word; its share of
the slots is weighted by that width. Each source gets ``SPARE`` slots more than
it needs, and its last slot is cut where the target, as a whole number, is
reached.

Sources are a table, of any number: only its count, sums and water level come
to the driver. Prefix sums and ranks are made in two steps (within buckets, then
over sums of buckets), so no source meets in one task; documents are shuffled by
a digest of id, size and text. Null text has size 0; null sources form the last
source; repeated rows count each, and those alike in all are interchangeable. An
empty table, or one without words, takes nothing. Very long texts and extra
columns change nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxlane.llm.common import SPACE, checkpoint

WEIGHTS = (5, 2, 1)
MOST_PASSES = 3
#: Slots of the schedule, at least; some for each source at any rate.
RESOLUTION, SLOTS_A_SOURCE = 1 << 20, 1 << 10
#: More than the schedule's discrepancy, in slots.
SPARE = 32
#: Rows of a bucket of the prefix sums: of a source's documents by shuffle key, of slots and sources by number.
ROWS_BUCKET, SLOT_BUCKET = 1 << 14, 1 << 12
#: A table of the sources is broadcast if it has no more rows and no more characters of names.
SMALL_ROWS, SMALL_CHARS = 1 << 16, 1 << 24
#: frac((sqrt(5) - 1) / 2) in units of 2**-62: whole numbers keep points exact.
GOLDEN, CIRCLE = 2850178704830799621, 1 << 62


def word_count(text: Column) -> Column:
    bare = F.trim(text, F.lit(SPACE))
    return F.when(text.isNull() | (bare == ""), F.lit(0)).otherwise(F.size(F.split(bare, "[\\x20\\x09-\\x0D]+"))).cast("long")


def running(df: DataFrame, group: list[str], bucket: str, order: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of its group up to each row, in order of ``bucket`` and ``order``."""
    sums = df.groupBy(*group, bucket).agg(F.sum(value).alias("_sum"))
    w = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*group, bucket, F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_before"))
    inner = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_within", F.sum(value).over(inner)).join(before, [*group, bucket]).withColumn(name, F.col("_before") + F.col("_within")).drop("_before", "_within")


def numbered(sources: DataFrame) -> DataFrame:
    """``sources`` with their number ``src`` by code point of the name, null last; from the rows before each sorted partition."""
    placed = checkpoint(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).count()
    before = counts.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))  # a row a partition
    return placed.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("src", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_before")


def with_targets(sources: DataFrame, total: int, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """``sources`` (src, source_size) with ``target``: its weight's share of all words, ``most`` times its size at the most.

    What is above is shared again among the others by weight, until none is
    above. A round is one aggregate; the share of a unit of weight only grows.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("src") % len(weights) + 1).cast("int"))
    rows = sources.withColumn("weight", weight)
    left, free, capped = float(total), 0, -1
    while True:
        share = F.lit(left) * F.col("weight") / F.lit(float(free)) if free else F.lit(0.0)
        above = share > most * F.col("source_size")
        x = rows.agg(F.sum(F.when(~above, F.col("weight"))).alias("free"), F.sum(F.when(above, most * F.col("source_size"))).alias("held"), F.count_if(above).alias("n")).first()
        if x["n"] == capped or not x["free"]:
            return rows.withColumn("target", F.when(above, F.lit(float(most)) * F.col("source_size")).otherwise(share)).drop("weight")
        left, free, capped = float(total - (x["held"] or 0)), x["free"], x["n"] if free else -1


def schedule(arcs: DataFrame, slots: int) -> DataFrame:
    """slot, src, rank, block and pass of every slot.

    ``arcs``: src, blocks, and the arc from lo to hi (exclusive) of a circle of
    2**62 that belongs to it. Points and arcs meet over cells of about 64 slots.
    """
    shift = 62 - math.ceil(math.log2(max(slots / 64, 1)))
    point = F.col("slot").cast("decimal(18,0)") * F.lit(GOLDEN).cast("decimal(19,0)") % F.lit(CIRCLE).cast("decimal(20,0)")
    points = arcs.sparkSession.range(slots).withColumnRenamed("id", "slot").withColumn("point", point.cast("long")).withColumn("cell", F.shiftright("point", shift))
    cells = arcs.filter("lo < hi").withColumn("cell", F.explode(F.sequence(F.shiftright("lo", shift), F.shiftright(F.col("hi") - 1, shift))))
    found = points.join(cells, "cell").filter("lo <= point and point < hi").select("slot", "src", "blocks", F.expr(f"slot div {SLOT_BUCKET}").alias("bucket"))
    ranked = running(found, ["src"], "bucket", ["slot"], F.lit(1), "rank")
    return ranked.select("slot", "src", (F.col("rank") - 1).alias("rank"), F.expr("(rank - 1) % blocks").alias("block"), F.expr("(rank - 1) div blocks").alias("pass"))


def mix(documents: DataFrame, seed: int = 17, resolution: int = RESOLUTION) -> DataFrame:
    """doc_id, source, size, source_size, target and taken for every row of ``documents``."""
    # texts are read once: later steps need small columns, which outlive lost executors in the shared folder
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), word_count(text).cast("string"), F.md5(text.cast("binary"))).cast("binary"))
    key = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
    sized = checkpoint(documents.select("doc_id", F.col("source").cast("string").alias("source"), word_count(text).alias("size"), key.alias("key")))
    sources = numbered(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")))
    all_of = sources.agg(F.count("*").alias("n"), F.sum("source_size").alias("total"), F.sum("rows").alias("rows"), F.sum(F.length("source")).alias("chars")).first()
    n, total = all_of["n"], all_of["total"] or 0
    few = n <= SMALL_ROWS and (all_of["chars"] or 0) <= SMALL_CHARS
    small = F.broadcast if few else (lambda df: df)  # a row a source, of a checked size
    # words of a block: at most 1 / slots of all words, and fine enough for the source's own size and target
    most = max(1, total // max(resolution, SLOTS_A_SOURCE * max(n, 1)))
    table = with_targets(sources.drop("rows"), total).withColumn("whole", F.floor(F.col("target") + 0.5))
    table = table.withColumn("width", F.greatest(F.lit(1).cast("long"), F.least(F.lit(most).cast("long"), F.expr(f"source_size div {SLOTS_A_SOURCE}"), F.expr(f"cast(floor(target) as long) div {SLOTS_A_SOURCE}"))))
    need = F.when(F.col("source_size") > 0, F.expr(f"(whole + width - 1) div width + {SPARE}")).otherwise(F.lit(0).cast("long"))
    table = checkpoint(table.withColumns({"need": need, "bucket": F.expr(f"src div {SLOT_BUCKET}"), "one": F.lit(1)}))
    named = table.select(F.col("source").alias("_s"), "src", "source_size", "target", "width")
    known = sized.join(small(named), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    names = ["doc_id", "source", "size", "source_size", "target", "taken"]
    if not total:
        return known.withColumn("taken", F.lit(0).cast("long")).select(*names)
    slots = table.agg(F.sum("need")).first()[0]
    arcs = running(table, ["one"], "bucket", ["src"], F.col("need"), "stop")
    on_circle = lambda c: F.expr(f"(cast({c} as decimal(19,0)) * cast({CIRCLE} as decimal(19,0))) div cast({slots} as decimal(19,0))")
    arcs = arcs.select("src", on_circle("stop - need").alias("lo"), on_circle("stop").alias("hi"), F.expr("greatest(1L, (source_size + width - 1) div width)").alias("blocks"))
    plan = schedule(arcs, slots).filter(F.col("pass") < MOST_PASSES)
    # how far a slot's pass may go into the source, and where its block begins and ends there
    timed = plan.join(small(table.select("src", "source_size", "width", "whole")), "src").withColumns({"left": F.expr("whole - pass * source_size"), "low": F.expr("block * width"), "high": F.expr("least((block + 1) * width, source_size)")})
    cut = F.max(F.expr("case when low < left and left < high then left end")).alias("cut")
    uses = timed.filter("low < left").groupBy("src", "block").agg(F.count_if(F.expr("high <= left")).alias("uses"), cut)
    bits = max(8, math.ceil(math.log2(max(all_of["rows"] / ROWS_BUCKET, 1))))
    placed = running(known.filter("size > 0").withColumn("bucket", F.shiftright("key", 60 - bits)), ["src"], "bucket", ["key", "doc_id"], F.col("size"), "stop").withColumn("start", F.col("stop") - F.col("size"))
    pieces = placed.select("*", F.explode(F.sequence(F.expr("start div width"), F.expr("(stop - 1) div width"))).alias("block")).withColumns({"low": F.expr("greatest(start, block * width)"), "high": F.expr("least(stop, (block + 1) * width)")})
    # least() passes over nulls: a block that isn't cut, or that no slot takes, is cut at 0
    words = F.expr("(high - low) * coalesce(uses, 0) + greatest(0, least(high, coalesce(cut, 0)) - low)")
    taken = pieces.join(uses, ["src", "block"], "left").withColumn("words", words)
    # a place in the shuffled source tells rows apart
    summed = taken.groupBy("doc_id", "source", "size", "source_size", "target", "src", "start").agg(F.sum("words").alias("taken"))
    none = known.filter("size = 0").withColumn("taken", F.lit(0).cast("long"))
    return summed.select(*names).unionByName(none.select(*names))


#: The query's rows in DuckDB's SQL. Targets: the fewest sources of least size a weight that are held at three times their size.
ORACLE = f"""
WITH docs AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, coalesce(text, '') AS text FROM documents
), sized AS (
  SELECT doc_id, source, size, CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || size || ':' || md5(text)), 1, 15) AS BIGINT) AS key FROM docs
), sources AS (
  SELECT *, [{", ".join(map(str, WEIGHTS))}][1 + src % {len(WEIGHTS)}] AS weight
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS src FROM sized GROUP BY source)
), held AS (
  SELECT k, CAST((SELECT sum(n) FROM sources) - coalesce(sum({MOST_PASSES} * n), 0) AS DOUBLE) AS remains, CAST((SELECT sum(weight) FROM sources) - coalesce(sum(weight), 0) AS DOUBLE) AS free
  FROM (SELECT unnest(range((SELECT count(*) FROM sources))) AS k)
  LEFT JOIN (SELECT n, weight, row_number() OVER (ORDER BY n / weight, src) AS place FROM sources) s ON s.place <= k GROUP BY k
), level AS (
  SELECT remains, free FROM held h WHERE (SELECT count(*) FROM sources WHERE h.remains * weight / h.free > {MOST_PASSES} * n) <= k ORDER BY k LIMIT 1
), aimed AS (
  SELECT source, src, n, CASE WHEN remains * weight / free > {MOST_PASSES} * n THEN CAST({MOST_PASSES} * n AS DOUBLE) ELSE remains * weight / free END AS target FROM sources, level
), wide AS (
  SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS whole,
         CAST(greatest(1, least(greatest(1, (SELECT sum(n) FROM sources) // greatest({RESOLUTION}, {SLOTS_A_SOURCE} * (SELECT count(*) FROM sources))), n // {SLOTS_A_SOURCE}, CAST(floor(target) AS BIGINT) // {SLOTS_A_SOURCE})) AS BIGINT) AS width
  FROM aimed
), needed AS (
  SELECT *, CASE WHEN n > 0 THEN (whole + width - 1) // width + {SPARE} ELSE 0 END AS need, greatest(1, (n + width - 1) // width) AS blocks FROM wide
), arcs AS (
  SELECT *, CAST(sum(need) OVER (ORDER BY src) AS HUGEINT) AS stop, CAST((SELECT sum(need) FROM needed) AS HUGEINT) AS slots FROM needed
), points AS (
  SELECT slot, CAST(slot AS HUGEINT) * {GOLDEN} % {CIRCLE} AS point FROM range(CAST((SELECT sum(need) FROM needed) AS BIGINT)) t(slot)
), ranked AS (
  SELECT src, n, width, whole, blocks, row_number() OVER (PARTITION BY src ORDER BY slot) - 1 AS rank
  FROM points JOIN arcs ON (stop - need) * {CIRCLE} // slots <= point AND point < stop * {CIRCLE} // slots
), timed AS (
  SELECT src, rank % blocks AS block, whole - rank // blocks * n AS remains, rank % blocks * width AS low, least((rank % blocks + 1) * width, n) AS high FROM ranked WHERE rank // blocks < {MOST_PASSES}
), uses AS (
  SELECT src, block, count(*) FILTER (WHERE high <= remains) AS uses, max(CASE WHEN remains < high THEN remains END) AS cut FROM timed WHERE low < remains GROUP BY src, block
), placed AS (
  SELECT row_number() OVER () AS rn, doc_id, d.source, size, n, target, a.src, width, CAST(sum(size) OVER (PARTITION BY a.src ORDER BY key, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop
  FROM sized d JOIN wide a ON d.source IS NOT DISTINCT FROM a.source WHERE size > 0
), pieces AS (
  SELECT *, unnest(range((stop - size) // width, (stop - 1) // width + 1)) AS block FROM placed
)
SELECT any_value(doc_id) AS doc_id, any_value(source) AS source, any_value(size) AS size, any_value(n) AS source_size, any_value(target) AS target,
       CAST(sum((least(stop, (p.block + 1) * width) - greatest(stop - size, p.block * width)) * coalesce(uses, 0)
         + greatest(0, least(stop, (p.block + 1) * width, coalesce(cut, 0)) - greatest(stop - size, p.block * width))) AS BIGINT) AS taken
FROM pieces p LEFT JOIN uses u ON p.src = u.src AND p.block = u.block GROUP BY rn
UNION ALL
SELECT doc_id, d.source, size, n, target, 0 FROM sized d JOIN wide a ON d.source IS NOT DISTINCT FROM a.source WHERE size = 0
"""
