"""Not-modified revisits of WARC records, resolved to the response they stand for.

A revisit takes the latest full response of its canonical URL that is strictly
earlier (an as-of join; of responses at the same time, the one of the largest
id). Validators must agree: entity tags by weak comparison if both have one,
else modification dates, else payload digests. Then the response's headers are
taken, and those that a 304 answer may bring replace or join them.

The as-of join sorts all events by time (then by URL, and of an instant revisits
first) and cuts them into slices of about ``SLICE_ROWS`` rows. A revisit looks at
its own slice of the URL first, and else at the last response of the slices
before. So neither a URL nor one instant of it meets in one task, whatever its
share of the crawl.

Revisits of null url or time never match and pass by the join; null ids,
headers and validators are kept as null. Repeated revisits are resolved each;
repeated responses count as one. An empty table gives no rows. Extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluxlane.llm.common import checkpoint, load

SLICE_ROWS, LEAST_SLICES = 1 << 17, 16
#: Headers of a 304 answer that replace those stored. Fixed values (RFC 9110, section 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
SCHEMA = "record_id bigint, url string, ts bigint, kind string, etag string, last_modified string, digest string, headers map<string,string>"


def canonical_url(url: Column) -> Column:
    """Lower-case host without ``www.``, no scheme, default port, fragment, tracking parameters or last slash."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    u = F.regexp_replace(u, "^(?i)https?://(www\\.)?", "")
    host = F.lower(F.regexp_extract(u, "^[^/?]*", 0))
    rest = F.regexp_replace(u, "^[^/?]*", "")
    rest = F.regexp_replace(rest, "([?&])(utm_[a-z]+|ref)=[^&]*", "$1")
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, "&&+", "&"), "\\?&+", "?"), "[?&/]+$", "")
    return F.concat(F.regexp_replace(host, ":(80|443)$", ""), rest)


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def merged_headers(stored: Column, new: Column) -> Column:
    """The stored headers, with the permitted ones of the 304 answer in their place."""
    low = lambda m: F.transform_keys(F.coalesce(m, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), lambda k, _: F.lower(k))
    brought = F.map_filter(low(new), lambda k, _: k.isin(*PERMITTED))
    left = F.map_filter(low(stored), lambda k, _: ~F.array_contains(F.map_keys(brought), k))
    return F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(left, brought))))


def resolve(records: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """A row for each revisit: record_id, canonical_url, ts, response_id, outcome, headers and digest.

    outcome: ``resolved``, ``mismatch`` (validators differ; the response's id is
    given), ``unchecked`` (no validator in common) or ``missing`` (no earlier
    response). headers and digest are those of the resolved answer, else null.
    """
    known = records.select("record_id", canonical_url(F.col("url")).alias("canonical_url"), "ts", "kind", "etag", "last_modified", "digest", "headers")
    placed = F.col("canonical_url").isNotNull() & F.col("ts").isNotNull()
    answer = F.struct(F.col("ts").alias("at"), F.col("record_id").alias("id"), "etag", "last_modified", "digest", "headers")
    full = known.filter((F.col("kind") == "response") & placed).select("canonical_url", "ts", "record_id", answer.alias("answer"))
    # of responses at one time the largest id counts
    full = full.groupBy("canonical_url", "ts").agg(F.max("record_id").alias("record_id"), F.max_by("answer", F.struct(F.col("record_id").isNotNull(), "record_id")).alias("answer"))
    asked = known.filter("kind = 'revisit'").drop("kind")
    kind = full.schema["answer"].dataType
    # one stream of events: at the same time revisits come first
    events = (
        full.select("canonical_url", "ts", F.lit(1).alias("late"), "record_id", "answer", F.lit(None).cast(asked.schema).alias("ask"))
        .unionByName(asked.filter(placed).select("canonical_url", "ts", F.lit(0).alias("late"), "record_id", F.lit(None).cast(kind).alias("answer"), F.struct(*asked.columns).alias("ask")))
    )
    slices = max(LEAST_SLICES, -(-known.count() // slice_rows))
    spread = F.xxhash64("canonical_url"), F.col("late"), F.xxhash64(F.col("record_id").cast("string"))
    events = checkpoint(events.repartitionByRange(slices, "ts", *spread).withColumn("slice", F.spark_partition_id()))
    w = Window.partitionBy("canonical_url", "slice").orderBy("ts", "late").rowsBetween(Window.unboundedPreceding, -1)
    own = events.withColumn("own", F.last("answer", ignorenulls=True).over(w)).filter("late = 0")
    # the newest response of each slice, carried into the slices after it
    stops = events.groupBy("canonical_url", "slice").agg(F.max_by("answer", F.when(F.col("late") == 1, F.col("ts"))).alias("answer"))
    back = Window.partitionBy("canonical_url").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = stops.select("canonical_url", "slice", F.last("answer", ignorenulls=True).over(back).alias("before")).filter("before is not null")
    out = own.join(carried, ["canonical_url", "slice"], "left").select("ask.*", F.coalesce("own", "before").alias("found"))
    out = out.unionByName(asked.filter(~placed).withColumn("found", F.lit(None).cast(kind)))
    both = lambda c: F.col(c).isNotNull() & F.col(f"found.{c}").isNotNull()
    agrees = (
        F.when(both("etag"), _weak(F.col("etag")) == _weak(F.col("found.etag")))
        .when(both("last_modified"), F.col("last_modified") == F.col("found.last_modified"))
        .when(both("digest"), F.col("digest") == F.col("found.digest"))
    )
    outcome = F.when(F.col("found").isNull(), "missing").when(agrees.isNull(), "unchecked").when(agrees, "resolved").otherwise("mismatch")
    resolved = F.col("outcome") == "resolved"
    return out.withColumn("outcome", outcome).select(
        "record_id", "canonical_url", "ts", F.col("found.id").alias("response_id"), "outcome",
        F.when(resolved, merged_headers(F.col("found.headers"), F.col("headers"))).alias("headers"), F.when(resolved, F.col("found.digest")).alias("digest"),
    )


def attach_bodies(resolved: DataFrame, bodies: DataFrame) -> DataFrame:
    """``resolved`` with the ``body`` of its response; ``bodies`` has record_id and body."""
    return resolved.join(bodies.select(F.col("record_id").alias("response_id"), "body").dropDuplicates(["response_id"]), "response_id", "left")


def records_of_pages(pages: DataFrame) -> DataFrame:
    """A crawl over ``pages``: a full response for each row, and a later visit that was answered by 304.

    Row ``i`` is fetched at time 4 i and seen again at time 4 i + 2 x (1 + 97 x
    (i mod 3)), under http or https. Of ten answers, one has an entity tag of
    another version, one comes without tags, one without any validator.
    """
    i, body = F.col("page_id"), F.md5(F.coalesce("html", F.lit("")).cast("binary"))
    fold = i % 10
    date = lambda t: F.concat(F.lit("t"), t.cast("string"))
    first = pages.select(
        (2 * i).alias("record_id"), "url", (4 * i).alias("ts"), F.lit("response").alias("kind"),
        F.when(fold != 4, F.concat(F.lit('W/"'), body, F.lit('"'))).alias("etag"), date(4 * i).alias("last_modified"), body.alias("digest"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.octet_length("html").cast("string"), F.lit("Date"), date(4 * i), F.lit("ETag"), body).alias("headers"),
    )
    again = 4 * i + 2 * (1 + 97 * (i % 3))
    second = pages.select(
        (2 * i + 1).alias("record_id"), F.regexp_replace("url", "^http:", "https:").alias("url"), again.alias("ts"), F.lit("revisit").alias("kind"),
        F.when(fold == 3, F.lit('"other"')).when(~fold.isin(4, 5), F.concat(F.lit('"'), body, F.lit('"'))).alias("etag"), F.when(fold != 5, date(4 * i)).alias("last_modified"), F.lit(None).cast("string").alias("digest"),
        F.create_map(F.lit("Date"), date(again), F.lit("Expires"), date(again + 100), F.lit("Content-Length"), F.lit("0"), F.lit("Cache-Control"), F.lit("max-age=100")).alias("headers"),
    )
    return first.unionByName(second)


def revisits_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest columns of ``resolve`` over the crawl of ``pages``: the headers as one string."""
    records = checkpoint(records_of_pages(load(spark, sf_dir, "pages")))
    found = resolve(records)
    text = F.array_join(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return found.select("record_id", "canonical_url", "ts", "response_id", "outcome", text.alias("headers"), "digest")


#: The same in DuckDB's SQL.
ORACLE = r"""
WITH seen AS (
  SELECT page_id AS i, url, coalesce(md5(html), md5('')) AS body, strlen(html) AS n FROM pages
), records AS (
  SELECT 2 * i AS record_id, url, 4 * i AS ts, 'response' AS kind, CASE WHEN i % 10 <> 4 THEN '"' || body || '"' END AS etag, 't' || (4 * i) AS last_modified, body AS digest,
         4 * i AS date, n, body
  FROM seen
  UNION ALL
  SELECT 2 * i + 1, regexp_replace(url, '^http:', 'https:'), 4 * i + 2 * (1 + 97 * (i % 3)), 'revisit',
         CASE WHEN i % 10 = 3 THEN '"other"' WHEN i % 10 NOT IN (4, 5) THEN '"' || body || '"' END, CASE WHEN i % 10 <> 5 THEN 't' || (4 * i) END, NULL, 4 * i + 2 * (1 + 97 * (i % 3)), NULL, NULL
  FROM seen
), bare AS (
  SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^(?i)https?://(www\.)?', '') AS u FROM records
), canonical AS (
  SELECT *, regexp_replace(lower(regexp_extract(u, '^[^/?]*')), ':(80|443)$', '')
    || regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(u, '^[^/?]*', ''), '([?&])(utm_[a-z]+|ref)=[^&]*', '\1', 'g'), '&&+', '&', 'g'), '\?&+', '?', 'g'), '[?&/]+$', '') AS canonical_url
  FROM bare
), matched AS (
  SELECT v.record_id, v.canonical_url, v.ts, v.etag, v.last_modified, v.date, r.record_id AS response_id, r.etag AS r_etag, r.last_modified AS r_modified, r.digest AS r_digest, r.date AS r_date, r.n, r.body,
         row_number() OVER (PARTITION BY v.record_id ORDER BY r.ts DESC, r.record_id DESC) AS pick
  FROM canonical v LEFT JOIN canonical r ON r.kind = 'response' AND r.canonical_url = v.canonical_url AND r.ts < v.ts
  WHERE v.kind = 'revisit'
), judged AS (
  SELECT *, CASE WHEN response_id IS NULL THEN 'missing'
                 WHEN etag IS NOT NULL AND r_etag IS NOT NULL THEN CASE WHEN etag = r_etag THEN 'resolved' ELSE 'mismatch' END
                 WHEN last_modified IS NOT NULL AND r_modified IS NOT NULL THEN CASE WHEN last_modified = r_modified THEN 'resolved' ELSE 'mismatch' END
                 ELSE 'unchecked' END AS outcome
  FROM matched WHERE pick = 1
)
SELECT record_id, canonical_url, ts, response_id, outcome,
       CASE WHEN outcome = 'resolved' THEN 'cache-control=max-age=100;content-length=' || n || ';content-type=text/html;date=t' || date || ';etag=' || body || ';expires=t' || (date + 100) END AS headers,
       CASE WHEN outcome = 'resolved' THEN r_digest END AS digest
FROM judged
"""
