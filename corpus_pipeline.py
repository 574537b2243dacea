"""From raw documents to a training mix: five stages of the operators in ``fluxlane.llm``.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it
kept; ``docs`` has the columns of ``documents``, and so has what all stages but
the last return.

Null, empty and blank texts score 0 in the quality classifier and go, as does
every document if there are no labels to learn from. In the later stages, which
work by themselves too, they are near copies of each other, hold no item and no
secret, and have no words to take. Rows with a null id or source are treated
like others. Of repeated rows and of near copies one stays, whichever stage
follows; ties are settled by id, then by hashes of the row. Very long texts go
through whole. Empty tables give empty tables, and columns beside those of
``documents`` are carried along whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from fluxlane.llm import decontamination, mixing, quality, secrets, simhash
from fluxlane.llm.common import load, remove, scratch


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from all labelled documents of the corpus."""
    return quality.keep_good(docs, quality.fit(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8) stays, that of the smallest id."""
    return simhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.keep_clean(docs, load(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by the name of their kind; all documents stay."""
    return secrets.redact_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document: doc_id, source, size, source_size, target, taken."""
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scan", secret_scan),
    ("source mixing", mix_sources),
]

#: The classifier is fitted by gradient ascent, and fingerprints and edit matching have no SQL: the tests compare run() with plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder, read again, and deleted once the next stage's are there."""
    docs = load(spark, sf_dir, "documents")
    folder = f"{scratch(spark)}/pipeline-{uuid.uuid4().hex}"
    for n, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{n}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if n:
            remove(spark, f"{folder}/{n - 1}")
    return docs
