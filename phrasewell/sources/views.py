"""Logical views over the tables: words with vectors, questions, paragraphs, terms, predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phrasewell.functions import text as X
from phrasewell.functions import vectors as V

PER_DOC = 25
#: Every row whose id is divisible by this is a question, too.
QUESTION_EVERY = 20
#: So many document numbers (counted) are broadcast.
BROADCAST_IDS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per word: doc_idx, word_idx, start, end, two span halves and two boundary logits."""
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("word_id"),
        F.floor(F.col("vec_id") / PER_DOC).cast("long").alias("doc_idx"),
        (F.col("vec_id") % PER_DOC).alias("word_idx"),
        "label",
        V.part(e, 1, 24).alias("start"),
        V.part(e, 25, 24).alias("end"),
        V.part(e, 49, 8).alias("span_a"),
        V.part(e, 57, 8).alias("span_b"),
        e[0].cast("double").alias("filter_start"),
        e[24].cast("double").alias("filter_end"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return (
        table(spark, sf_dir, "embeddings")
        .where(F.col("vec_id") % QUESTION_EVERY == 0)
        .select(F.col("vec_id").alias("qid"), V.part(e, 1, 24).alias("q_start"), V.part(e, 25, 24).alias("q_end"), V.dot(V.part(e, 49, 8), V.part(e, 57, 8)).alias("q_span"))
    )


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("par_idx", "par_text"))


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their paragraphs joined by a marked separator."""
    return table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit(" [PAR] ")).alias("context"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, truth (a user's turn) and pred (the assistant's turn after it, null if there is none)."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("truth"))
    told = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("pred"))
    return asked.join(told, ["conv_id", "turn"], "left").select(F.concat_ws("-", "conv_id", "turn").alias("qid"), "truth", "pred")


def titled_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_idx, title, context)"""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc_idx"), F.col("source").alias("title"), F.replace("text", F.lit("\n"), F.lit(" [PAR] ")).alias("context"))


def within(rows: DataFrame, wanted: DataFrame, key: str = "doc_idx") -> DataFrame:
    """The rows of wanted documents; their numbers are broadcast while they are few (counted), so that other texts aren't shuffled."""
    ids = wanted.select(F.col("doc_idx").alias(key)).distinct()
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if few else ids, key, "left_semi")


def word_offsets(contexts: DataFrame) -> DataFrame:
    """(doc_idx, word_idx, par_idx, char_start, char_end) of every word of contexts(doc_idx, context); separators are no words."""
    rows = contexts.select("doc_idx", F.posexplode(X.word_places(F.col("context"))).alias("_at", "p"))
    order = Window.partitionBy("doc_idx").orderBy("_at")
    separator = F.col("p.word") == X.SEPARATOR.strip()
    rows = rows.select("doc_idx", "_at", separator.alias("_sep"), F.length("p.word").alias("_n"), F.sum(F.col("p.gap") + F.length("p.word")).over(order).alias("char_end"), F.sum(separator.cast("int")).over(order).alias("par_idx"))
    rows = rows.where(~F.col("_sep")).withColumn("word_idx", F.col("_at") - F.col("par_idx"))
    return rows.select("doc_idx", F.col("word_idx").cast("long").alias("word_idx"), "par_idx", (F.col("char_end") - F.col("_n")).alias("char_start"), "char_end")


def placed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words whose document has a word at their place, with its characters and paragraph."""
    w = words(spark, sf_dir)
    own = within(contexts(spark, sf_dir).withColumnRenamed("doc_id", "doc_idx"), w)
    return w.join(word_offsets(own), ["doc_idx", "word_idx"])


def question_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, text): a benchmark item for each question."""
    return table(spark, sf_dir, "benchmark").select((F.col("item_id") * QUESTION_EVERY).alias("qid"), "text")
