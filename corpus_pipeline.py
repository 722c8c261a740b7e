"""The corpus pipeline: STAGES turn `documents` into a deduplicated, decontaminated, weighted mix, one operator a stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phrasewell.llm import decontaminate, language_id, mixing, ngram_join, substring_dedup
from phrasewell.llm._shared import crc_mod, materialize, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: So many documents with hits (25 bytes each) are broadcast to the texts; beyond, texts are shuffled to them.
BROADCAST_HITS = 1_000_000


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that the labelled ones teach; those without letters (null and empty texts too) and those that fit none go.

    Repeated rows are judged alike and all stay; very long texts are judged whole; an empty table gives an empty one.
    """
    docs = docs.select(*COLUMNS)
    model = language_id.learn(docs.where(crc_mod(F.col("doc_id"), 5) != 0).select("text", "lang"))
    if not model["langs"]:  # nothing to go by but letters
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = language_id.detect(docs, model)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= language_id.REJECT_BELOW)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, that with the smallest doc_id (a null one only among nulls).

    Of repeated rows one stays; texts without words are in no group and stay.
    """
    return ngram_join.representatives(docs.select(*COLUMNS))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that occur earlier; documents of which nothing is left go, those of which nothing is cut stay as they are.

    Rows of one doc_id are one document here, so equal ones cut nothing from each other; null and empty texts stay.
    """
    found = substring_dedup.dedup(docs.select(*COLUMNS))
    found = found.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    cut = F.col("kept_text").isNotNull()
    found = found.withColumn("n_chars", F.when(cut, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")))
    return found.withColumn("text", F.coalesce("kept_text", "text")).select(*COLUMNS)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a full window of a benchmark item, or of whose words items shorter than a window make up half or more.

    A short item is found in any document that holds its few words, so one hit of it says nothing. Rows of one doc_id and text share one verdict.
    """
    docs = docs.select(*COLUMNS)
    hits = decontaminate.hits(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    hits = hits.groupBy("doc_id", "_text").agg(F.max(F.col("len") == decontaminate.WINDOW).alias("_whole"), decontaminate.spans().alias("_spans"))
    hits = hits.select(F.col("doc_id").alias("_d"), F.col("_text").alias("_t"), "_whole", decontaminate.covered("_spans").alias("_n"))
    hits = materialize(hits)
    few = hits.limit(BROADCAST_HITS + 1).count() <= BROADCAST_HITS
    out = docs.withColumn("_text", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_text") == F.col("_t"))
    dirty = F.col("_whole") | (2 * F.col("_n") >= F.size(decontaminate.words("text")))
    return out.join(F.broadcast(hits) if few else hits, same & dirty, "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document; texts without words are taken 0 times, repeated rows count each, and an empty table gives an empty result."""
    return mixing.mix(docs.select(*COLUMNS))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", languages),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeats),
    ("benchmark decontamination", benchmarks),
    ("mixing sources to target weights", mix),
]
#: No SQL: the first stage's filters and the join's components have none; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
