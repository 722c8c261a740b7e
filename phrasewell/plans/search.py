"""Search: dense, closed, by cells, and dense with sparse in three strategies; always a cascade from narrow to wide.

questions: (qid, q_start, q_end, q_span). words: (doc_idx, word_idx, start, end, span_a, span_b), placed ones with par_idx, char_start and char_end.
contexts: (doc_idx, title, context). Starts are (qid, rank, doc_idx, word_idx, score), spans (qid, rank, doc_idx, i, j, score).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasewell.functions import text as X
from phrasewell.functions import vectors as V
from phrasewell.operators import index as I
from phrasewell.operators import sparse as P
from phrasewell.operators import topk as K

LONGEST = 5
#: What a start without any end loses.
NO_END = -1e9
#: So many probed cells are named in the scan's partition filter; beyond, the join's own pruning has to do.
NAMED_CELLS = 10_000


def starts_open(questions: DataFrame, words: DataFrame, k: int) -> DataFrame:
    """The k best starts of each question among all words."""
    return K.score_all(questions, words, k)


def starts_closed(questions: DataFrame, words: DataFrame, k: int, scope: tuple[str, ...] = ("doc_idx",)) -> DataFrame:
    """The same among the words of the question's own doc_idx (or doc_idx and par_idx)."""
    met = questions.join(words.select(*dict.fromkeys([*scope, "doc_idx", "word_idx", "start"])), list(scope))
    return K.top(met.withColumn("score", V.dot(F.col("q_start"), F.col("start"))).select("qid", "doc_idx", "word_idx", "score"), k)


def starts_by_cells(questions: DataFrame, cells: DataFrame, centroids: DataFrame, nprobe: int, k: int, vec: str = "decoded") -> DataFrame:
    """The same among the words of the nprobe cells nearest to the question. cells: words with cluster_id, as `index.stored` reads them; only probed cells are read."""
    asked = I.nearest_cells(questions, centroids, "q_start", nprobe).select("qid", "q_start", "cells")
    named = [r[0] for r in asked.select(F.explode("cells")).distinct().limit(NAMED_CELLS + 1).collect()]
    if len(named) <= NAMED_CELLS:
        cells = cells.where(F.col("cluster_id").isin(named))
    return K.score_all(asked, cells, k, vec=vec)


def complete(questions: DataFrame, starts: DataFrame, words: DataFrame, longest: int = LONGEST, fused: bool = False, ends: DataFrame | None = None) -> DataFrame:
    """Each start with its best end: (qid, rank, doc_idx, i, j, score). fused keeps the starts' scores; else they are computed anew.

    ends: the (doc_idx, word_idx) that may end a span, if not all words may. A start without an end keeps a null j and a score lower by NO_END.
    """
    chosen = starts.select("qid", "rank", "doc_idx", F.col("word_idx").alias("i"), F.col("score").alias("start_score"))
    heads = words.select("doc_idx", F.col("word_idx").alias("i"), "start", "span_a")
    tails = words.select("doc_idx", F.col("word_idx").alias("j"), "end", "span_b")
    if ends is not None:
        tails = tails.join(ends.select("doc_idx", F.col("word_idx").alias("j")), ["doc_idx", "j"], "left_semi")
    met = chosen.join(heads, ["doc_idx", "i"]).join(questions.select("qid", "q_start", "q_end", "q_span"), "qid")
    met = met.withColumn("j", F.explode(F.sequence("i", F.col("i") + longest - 1))).join(tails, ["doc_idx", "j"], "left")
    first = F.col("start_score") if fused else V.dot(F.col("q_start"), F.col("start"))
    rest = V.dot(F.col("q_end"), F.col("end")) + F.col("q_span") * V.dot(F.col("span_a"), F.col("span_b"))
    met = met.select("qid", "rank", "doc_idx", "i", F.when(F.col("end").isNotNull(), F.col("j")).alias("j"), F.when(F.col("end").isNotNull(), first + rest).otherwise(first + NO_END).alias("score"))
    return met.groupBy("qid", "rank", "doc_idx", "i").agg(F.max_by("j", F.struct("score", -F.col("j"))).alias("j"), F.max("score").alias("score"))


def results(spans: DataFrame, words: DataFrame, contexts: DataFrame, presentable: bool = False) -> DataFrame:
    """Spans as answers: their text, and the paragraphs they touch with their place in them; presentable leaves contexts with too many marks out.

    Contexts are joined last, to the few spans that are left.
    """
    heads = words.select("doc_idx", F.col("word_idx").alias("i"), "char_start")
    tails = words.select("doc_idx", F.col("word_idx").alias("j"), "char_end")
    met = spans.join(heads, ["doc_idx", "i"]).join(tails, ["doc_idx", "j"], "left").join(contexts, "doc_idx")
    end = X.end_or_next(F.col("char_start"), F.col("char_end"))
    met = met.withColumns({"answer": X.between(F.col("context"), F.col("char_start"), end), "_crop": X.crop(F.col("context"), F.col("char_start"), end)})
    out = met.select("qid", "rank", "doc_idx", "title", "i", "j", "score", "answer", F.col("_crop.context").alias("context"), F.col("_crop.start").alias("start_pos"), F.col("_crop.end").alias("end_pos"))
    return out.where(X.presentable(F.col("context"))) if presentable else out


def search(questions: DataFrame, words: DataFrame, k: int = 5, start_top_k: int | None = None, scope: tuple[str, ...] | None = None, cells: DataFrame | None = None, centroids: DataFrame | None = None, nprobe: int = 64, ends: DataFrame | None = None) -> DataFrame:
    """Dense search: the best starts, then each one's best span. Over all words, over the question's own document or paragraph (scope), or over the cells of an index near to it."""
    n = start_top_k or k
    if scope is not None:
        starts = starts_closed(questions, words, n, scope)
    elif cells is not None:
        starts = starts_by_cells(questions, cells, centroids, nprobe, n)
    else:
        starts = starts_open(questions, words, n)
    return complete(questions, starts, words, ends=ends)


def fuse(starts: DataFrame, docs: DataFrame, weight: float, keys: list[str]) -> DataFrame:
    """starts with weight times the sparse score of their document (or paragraph) added."""
    extra = docs.select("qid", *keys, F.col("score").alias("_s"))
    return starts.join(extra, ["qid", *keys], "left").withColumn("score", F.col("score") + weight * F.coalesce("_s", F.lit(0.0))).drop("_s")


def dense_first(questions: DataFrame, words: DataFrame, docs: DataFrame, start_top_k: int, weight: float) -> DataFrame:
    return fuse(starts_open(questions, words, start_top_k).drop("rank"), docs, weight, ["doc_idx"])


def sparse_first(questions: DataFrame, words: DataFrame, docs: DataFrame, doc_top_k: int, weight: float) -> DataFrame:
    """Every start of each question's doc_top_k best documents; those without words give none."""
    best = K.top(docs, doc_top_k, ties=("doc_idx",)).select("qid", "doc_idx", F.col("score").alias("_d"))
    met = best.join(questions, "qid").join(words.select("doc_idx", "word_idx", "start"), "doc_idx")
    return met.select("qid", "doc_idx", "word_idx", (V.dot(F.col("q_start"), F.col("start")) + weight * F.col("_d")).alias("score"))


def sparse_scores(texts: DataFrame, documents: DataFrame, within: DataFrame | None = None, k: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """TF-IDF products of texts(qid, text) with documents(doc_id, text) and their paragraphs: (qid, doc_idx, score), (qid, doc_idx, par_idx, score), and each question's k best documents.

    The first two are of the doc_ids in `within`, if given; the best documents are of all. Only pairs that share a term have a row.
    """
    products = P.Products(texts, documents)
    docs, pars = (products.pairs(p, within).withColumnRenamed("doc_id", "doc_idx") for p in (False, True))
    best = None if k is None else K.top(products.best(k).withColumnRenamed("doc_id", "doc_idx"), k, ties=("doc_idx",)).drop("rank")
    return docs, pars, best


def hybrid_starts(
    questions: DataFrame, words: DataFrame, docs: DataFrame, pars: DataFrame, strategy: str = "dense_first", start_top_k: int = 1000, mid_top_k: int = 100, out_top_k: int = 10, doc_top_k: int = 5, weight: float = 0.1, sparse_type: str = "dp", best: DataFrame | None = None
) -> DataFrame:
    """The out_top_k starts of dense and sparse scores. docs: (qid, doc_idx, score); pars: (qid, doc_idx, par_idx, score); words carry par_idx.
    best: like docs, with at least each question's doc_top_k best documents, where docs leaves out documents without words.

    hybrid unites both strategies' starts and keeps duplicates. A letter missing from sparse_type counts as weight 0.
    """
    doc_weight, par_weight = (weight if t in sparse_type else 0.0 for t in "dp")
    found = []
    if strategy in ("dense_first", "hybrid"):
        found.append(dense_first(questions, words, docs, start_top_k, doc_weight))
    if strategy in ("sparse_first", "hybrid"):
        found.append(sparse_first(questions, words, docs if best is None else best, doc_top_k, doc_weight))
    if not found:
        raise ValueError(f"unknown strategy {strategy}")
    starts = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    mid = K.top(starts, mid_top_k).drop("rank").join(words.select("doc_idx", "word_idx", "par_idx"), ["doc_idx", "word_idx"])
    return K.top(fuse(mid, pars, par_weight, ["doc_idx", "par_idx"]), out_top_k)


def hybrid_search(questions: DataFrame, words: DataFrame, docs: DataFrame, pars: DataFrame, strategy: str = "dense_first", out_top_k: int = 10, scope: tuple[str, ...] | None = None, ends: DataFrame | None = None, **cuts) -> DataFrame:
    """Dense and sparse search; fused start scores stay in the spans' scores. With a scope (closed search) sparse scores play no part."""
    if scope is not None:
        return complete(questions, starts_closed(questions, words, out_top_k, scope), words, fused=True, ends=ends)
    return complete(questions, hybrid_starts(questions, words, docs, pars, strategy, out_top_k=out_top_k, **cuts), words, fused=True, ends=ends)


def batch_predictions(results: DataFrame) -> DataFrame:
    """One row per question: its answers in rank order of the final score."""
    ranked = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "rank", F.col("answer").alias("a")))), lambda x: x.a)
    return results.groupBy("qid").agg(ranked.alias("answers"))


__all__ = ["search", "hybrid_search", "hybrid_starts", "sparse_scores", "results", "complete", "starts_open", "starts_closed", "starts_by_cells", "fuse", "dense_first", "sparse_first", "batch_predictions"]
