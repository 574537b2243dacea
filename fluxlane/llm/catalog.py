"""The queries of this subpackage and their SQL, for the driver's registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxlane.llm import alignment, chat, decontamination, jaccard, language, mixing, quality, repair, rules, secrets, simhash, toxicity, warc
from fluxlane.llm.common import load


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = load(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.fit(documents, load(spark, sf_dir, "labels")))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = load(spark, sf_dir, "documents")
    return quality.score(documents, quality.fit(documents, load(spark, sf_dir, "labels")))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.read_back(chat.format_turns(rows))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.revisits_of_pages(spark, sf_dir)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = load(spark, sf_dir, "documents")
    return language.identify(documents, language.fit(documents))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.verdicts(load(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(load(spark, sf_dir, "documents"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = alignment.align(load(spark, sf_dir, "documents"))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    return alignment.weigh(aligned.withColumn("groups_sha256", digest).drop("groups"))


def op12_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(load(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = load(spark, sf_dir, "conversations")
    return repair.repaired(conversations, repair.damaged(conversations))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_toxicity, op2_quality_classifier, op3_chat_formatting, op4_decontamination, op5_warc_revisits, op6_language_id, op7_source_mixing, op8_simhash, op9_quality_rules, op10_secret_scan, op11_tokenizer_alignment, op12_ngram_jaccard, op13_conversation_repair)
}
ORACLE_SQL: dict[str, str] = {"op3_chat_formatting": chat.ORACLE, "op5_warc_revisits": warc.ORACLE, "op7_source_mixing": mixing.ORACLE, "op9_quality_rules": rules.ORACLE, "op12_ngram_jaccard": jaccard.ORACLE, "op13_conversation_repair": repair.ORACLE}
