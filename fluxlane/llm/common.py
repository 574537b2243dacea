"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: everything else belongs to a word.
SPACE = "\x20\t\n\x0b\x0c\r"
WORD_RE = "[^\\x20\\x09-\\x0D]+"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` in the folder that spark.checkpoint.dir names.

    The folder of the session holds on a cluster; a folder of our own is set
    only where none is configured, as in tests.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(scratch(df.sparkSession))
    return df.checkpoint()


def crc_bucket(key: str, modulus: int) -> Column:
    """crc32 of an id as text, modulo ``modulus`` (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus


def bounded_sample(df: DataFrame, key: str, bound: int, seed: int) -> DataFrame:
    """About ``bound`` rows at most, chosen by a hash of ``key``, alike on every run.

    A first pass counts the rows (it reads ``key`` and what ``df`` filters on);
    then a hash threshold keeps a share of ``bound / count``. Nothing is sorted
    and no row is moved.
    """
    n = df.count()
    if n <= bound:
        return df
    share = F.pmod(F.xxhash64(F.lit(seed), F.col(key).cast("string")), F.lit(1 << 30))
    return df.filter(share < int((1 << 30) * bound / n))


def sampled_texts(documents: DataFrame, labels: DataFrame, bound: int, seed: int) -> DataFrame:
    """text and label of about ``bound`` labelled rows at most; ``labels``: doc_id and label.

    Ids are sampled by a hash. An id of several rows is joined with one label
    and one text of it (the smallest), so repeats add none.
    """
    once = bounded_sample(labels.groupBy("doc_id").agg(F.min("label").alias("label")), "doc_id", bound, seed)
    found = documents.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(once), "doc_id")  # bound rows of an id and a label
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label")).select("text", "label")


def in_batches(batches: Iterator[pa.RecordBatch], most_chars: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches that hold at most so many bytes, or a single row."""
    for b in batches:
        if b.num_rows:
            step = max(1, int(b.num_rows * most_chars / max(b.nbytes, 1)))
            for at in range(0, b.num_rows, step):
                yield b.slice(at, step)


def scratch(spark: SparkSession) -> str:
    """The shared folder for tables of a job: spark.checkpoint.dir, or, on a local master only, one of our own."""
    if shared := spark.conf.get("spark.checkpoint.dir", None):
        return shared
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="fluxlane-")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of ours, on whatever file system it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
