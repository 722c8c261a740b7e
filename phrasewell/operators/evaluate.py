"""Answer quality: exact match, bag F1, ranks, recall at k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasewell.functions import text as X

NO_RANK = 1e9


def bag_overlap(pairs: DataFrame, left: str, right: str, key: list[str]) -> DataFrame:
    """pairs with overlap: the size of the multiset intersection of two token arrays."""
    one = pairs.select(*key, F.explode(left).alias("t")).groupBy(*key, "t").agg(F.count("*").alias("n"))
    two = pairs.select(*key, F.explode(right).alias("t")).groupBy(*key, "t").agg(F.count("*").alias("m"))
    both = one.join(two, [*key, "t"]).groupBy(*key).agg(F.sum(F.least("n", "m")).alias("overlap"))
    return pairs.join(both, key, "left").withColumn("overlap", F.coalesce("overlap", F.lit(0)))


def scores(pairs: DataFrame, key: list[str], truth: str = "truth", pred: str = "pred") -> DataFrame:
    """pairs with em (boolean) and f1; a missing prediction scores nothing."""
    p = pairs.withColumns({"_a": X.white_tokens(X.normalize_answer(F.coalesce(pred, F.lit("")))), "_b": X.white_tokens(X.normalize_answer(F.col(truth)))})
    p = bag_overlap(p, "_a", "_b", key)
    answered = F.col(pred).isNotNull()
    f1 = F.when(F.col("overlap") > 0, 2.0 * F.col("overlap") / (F.size("_a") + F.size("_b"))).otherwise(0.0)
    p = p.withColumns({"em": answered & (F.array_join("_a", " ") == F.array_join("_b", " ")), "f1": F.when(answered, f1).otherwise(0.0)})
    return p.drop("_a", "_b", "overlap")


def best_over_truths(scored: DataFrame, key: list[str]) -> DataFrame:
    return scored.groupBy(*key).agg(F.max("em").alias("em"), F.max("f1").alias("f1"))


def report(scored: DataFrame) -> DataFrame:
    """Means in per cent over all questions, answered or not."""
    return scored.agg((100.0 * F.avg(F.col("em").cast("double"))).alias("exact_match"), (100.0 * F.avg("f1")).alias("f1"), F.count("*").alias("total"))


def first_hits(ranked: DataFrame) -> DataFrame:
    """(qid, rank) of the first matching answer, ranks from 1; NO_RANK if there is none."""
    return ranked.groupBy("qid").agg(F.coalesce(F.min(F.when(F.col("em"), F.col("rank"))).cast("double"), F.lit(NO_RANK)).alias("rank"))


def recall_at(ranks: DataFrame, n: int) -> DataFrame:
    """(k, recall) for k = 1 to n, over the questions that have answers: counts per rank, then sums over at most n rows."""
    per = ranks.groupBy().agg(F.count("*").alias("total"), *[F.count_if(F.col("rank") <= k).alias(f"k{k}") for k in range(1, n + 1)])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.col(f"k{k}") / F.col("total")).alias("recall")) for k in range(1, n + 1)]))
    return per.select(rows.alias("r")).select("r.k", "r.recall")


def at_k(ranked: DataFrame, first: int, last: int) -> DataFrame:
    """(k, exact_match, f1): means over questions of the best of the first k answers."""
    qs = ranked.groupBy("qid").agg(*[F.max(F.when(F.col("rank") <= k, F.col(c).cast("double"))).alias(f"{c}{k}") for k in range(first, last + 1) for c in ("em", "f1")])
    per = qs.agg(*[F.avg(F.coalesce(f"{c}{k}", F.lit(0.0))).alias(f"{c}{k}") for k in range(first, last + 1) for c in ("em", "f1")])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"em{k}").alias("exact_match"), F.col(f"f1{k}").alias("f1")) for k in range(first, last + 1)]))
    return per.select(rows.alias("r")).select("r.*")
