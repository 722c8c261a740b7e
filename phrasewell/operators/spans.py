"""Spans of words: enumeration, boundary filter, scores and best spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phrasewell.functions import vectors as V
from phrasewell.operators import corpus as C


def enumerate_spans(words: DataFrame, longest: int) -> DataFrame:
    """(doc_idx, i, j) of every span of at most `longest` words inside a document."""
    last = words.groupBy("doc_idx").agg(F.max("word_idx").alias("last"))
    starts = words.select("doc_idx", F.col("word_idx").alias("i")).join(last, "doc_idx")
    return starts.select("doc_idx", "i", F.explode(F.sequence("i", F.least(F.col("i") + longest - 1, F.col("last")))).alias("j"))


def boundary_filter(words: DataFrame, threshold: float, longest: int) -> DataFrame:
    """For every kept start and offset below `longest`: the ordinal of the kept end there, -1 if that word is no kept end."""
    order = Window.partitionBy("doc_idx").orderBy("word_idx")
    ordinal = (F.row_number().over(order) - 1).cast("long")
    starts = words.where(F.col("filter_start") > threshold).select("doc_idx", F.col("word_idx").alias("i"), ordinal.alias("start_ord"))
    ends = words.where(F.col("filter_end") > threshold).select("doc_idx", F.col("word_idx").alias("e"), ordinal.alias("end_ord"))
    starts = starts.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(longest - 1)))).withColumn("e", F.col("i") + F.col("o"))
    return starts.join(ends, ["doc_idx", "e"], "left").select("doc_idx", "i", "start_ord", "o", F.coalesce("end_ord", F.lit(-1)).alias("end_ord"))


def span_scores(questions: DataFrame, words: DataFrame, longest: int, threshold: float | None = None) -> DataFrame:
    """Scores of all spans in each question's doc_idx: start, end and span parts; with a threshold only of words that pass it."""
    starts, ends = words.select("doc_idx", F.col("word_idx").alias("i"), "start", "span_a", "filter_start"), words.select("doc_idx", F.col("word_idx").alias("j"), "end", "span_b", "filter_end")
    if threshold is not None:
        starts, ends = starts.where(F.col("filter_start") >= threshold), ends.where(F.col("filter_end") >= threshold)
    met = questions.join(starts, "doc_idx").withColumn("j", F.explode(F.sequence("i", F.col("i") + longest - 1))).join(ends, ["doc_idx", "j"])
    score = V.dot(F.col("q_start"), F.col("start")) + V.dot(F.col("q_end"), F.col("end")) + F.col("q_span") * V.dot(F.col("span_a"), F.col("span_b"))
    return met.withColumn("score", score)


def best_end(scored: DataFrame) -> DataFrame:
    """The best end of every start; the first of equal ones."""
    return scored.groupBy("qid", "doc_idx", "i").agg(F.max_by("j", F.struct("score", -F.col("j"))).alias("j"), F.max("score").alias("score"))


def best_span(scored: DataFrame, k: int = 1) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "i", "j")
    return scored.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)


def in_best_window(spans: DataFrame, sizes: DataFrame, size: int, stride: int) -> DataFrame:
    """The spans (doc_idx, i, j) whose end lies in the window that gives their start most context; sizes: (doc_idx, n)."""
    n = F.col("_n")
    k = C.best_window(F.col("i"), n, size, stride)
    met = spans.join(sizes.select("doc_idx", F.col("n").alias("_n")), "doc_idx")
    return met.withColumn("_last", k * stride + F.least(F.lit(size), n - k * stride) - 1).where(F.col("j") <= F.col("_last")).drop("_n", "_last")
