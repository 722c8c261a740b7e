"""Top k per question, and the cascade of cuts that keeps wide columns out of the early ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Questions scored against all words at a time; a block of them is broadcast.
BLOCK = 4096
#: So many words and so many scores are in memory at a time, whatever the numbers of questions and words.
WORDS = 8192
TILE = 1 << 20


def top(scored: DataFrame, k: int, score: str = "score", ties: tuple[str, ...] = ("doc_idx", "word_idx"), key: str = "qid", rank: str = "rank") -> DataFrame:
    """The k best rows of each key; ties go by the given columns."""
    order = Window.partitionBy(key).orderBy(F.desc(score), *ties)
    return scored.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def ordered(results: DataFrame) -> DataFrame:
    return results.orderBy("qid", F.desc("score"), "rank")


def score_all(questions: DataFrame, words: DataFrame, k: int, q_vec: str = "q_start", vec: str = "start", block: int = BLOCK) -> DataFrame:
    """The k best words of every question by inner product over all words: (qid, doc_idx, word_idx, score). Words without a vector are no candidates.

    Questions are taken in blocks of consecutive ids; for each block a scan of the words keeps the k best of each partition, so a scan
    returns at most k rows a question and partition, and the final cut orders those.
    """
    out = None
    for low, high in _blocks(questions, block):
        part = questions if low is None else questions.where(F.col("qid").between(low, high))
        part = best_of_partitions(part, words, k, q_vec, vec)
        out = part if out is None else out.unionByName(part)
    return top(out, k)


def _blocks(questions: DataFrame, block: int) -> list[tuple]:
    """First and last qid of blocks; only these two a block come to the driver. (None, None) stands for all where one block holds them."""
    if questions.limit(block + 1).count() <= block:
        return [(None, None)]
    # Blocks are made from counts per range of ids, so no task orders all questions.
    rows = questions.select("qid", F.floor(F.col("qid") / block).alias("_r"))
    sizes = rows.groupBy("_r").agg(F.count("*").alias("_n"), F.min("qid").alias("lo"), F.max("qid").alias("hi"))
    before = F.sum("_n").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1))
    group = F.floor(F.coalesce(before, F.lit(0)) / block)
    return [tuple(r) for r in sizes.withColumn("_g", group).groupBy("_g").agg(F.min("lo"), F.max("hi")).drop("_g").collect()]


class _Best:
    """The k best places of each question among what was offered so far; of equal scores the first by doc_idx, word_idx.

    Places that aren't filled have doc -1 and come last. What it holds besides the tile that is offered is k places a question.
    """

    def __init__(self, questions: int, k: int) -> None:
        self.k = k
        self.score = np.full((questions, k), -np.inf)
        self.doc = np.full((questions, k), -1, np.int64)
        self.word = np.full((questions, k), -1, np.int64)
        self.held = np.zeros(questions, np.int64)

    def offer(self, scores: np.ndarray, doc: np.ndarray, word: np.ndarray) -> None:
        """scores: a row for each question, a column for each word."""
        at, col = self.candidates(scores)
        self.take(at, scores[at, col], doc[col], word[col])

    def candidates(self, scores: np.ndarray, rows: np.ndarray | slice = slice(None), slack: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Where scores (of the questions `rows`) are within slack of the k-th best so far, in them or held already; ties and all."""
        least = np.where(self.held[rows] == self.k, self.score[rows, -1], -np.inf)
        if scores.shape[1] > self.k and np.isneginf(least).any():
            least = np.maximum(least, np.partition(scores, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k])
        return np.nonzero(~(scores < (least - slack)[:, None]))

    def take(self, at: np.ndarray, score: np.ndarray, doc: np.ndarray, word: np.ndarray) -> None:
        """Offers single places: the question's row, score, doc and word of each."""
        rows = np.unique(at)
        there = np.arange(self.k)[None, :] < self.held[rows][:, None]
        at = np.concatenate((at, np.repeat(rows, self.held[rows])))
        score, doc, word = (np.concatenate((x, y[rows][there])) for x, y in ((score, self.score), (doc, self.doc), (word, self.word)))
        order = np.lexsort((word, doc, -score, at))
        at = at[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        order, at, place = order[place < self.k], at[place < self.k], place[place < self.k]
        for kept, x in ((self.score, score), (self.doc, doc), (self.word, word)):
            kept[at, place] = x[order]
        self.held[rows] = np.bincount(at, minlength=len(self.held))[rows]


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows with rows, added up component by component: the same number wherever the same vectors meet."""
    out = np.zeros(len(q))
    for k in range(q.shape[1]):
        out += q[:, k] * x[:, k]
    return out


def _offer_tiles(best: _Best, q: np.ndarray, x: np.ndarray, doc: np.ndarray, word: np.ndarray, rows: np.ndarray | None = None) -> None:
    """Offers the words x to the questions q (or to some rows of them), TILE scores at a time: a matrix product finds candidates, whose scores are then added up in order."""
    rows = np.arange(len(q)) if rows is None else rows
    longest = np.sqrt((x * x).sum(axis=1).max(initial=0.0))
    step = max(1, TILE // max(1, len(x)))
    for lo in range(0, len(rows), step):
        some = rows[lo : lo + step]
        part = q[some]
        slack = 1e-12 * longest * np.sqrt((part * part).sum(axis=1))  # a matrix product may add up in another order
        at, col = best.candidates(part @ x.T, some, np.nan_to_num(slack, posinf=0.0))
        for cut in range(0, len(at), TILE // 16):
            a, c = at[cut : cut + TILE // 16], col[cut : cut + TILE // 16]
            best.take(some[a], _products(part[a], x[c]), doc[c], word[c])


def _rows_of(ids: np.ndarray, best: _Best) -> Iterator[pa.RecordBatch]:
    step = max(1, TILE // 16 // max(1, best.k))
    for lo in range(0, len(ids), step):
        held = best.held[lo : lo + step]
        there = np.arange(best.k)[None, :] < held[:, None]
        columns = [x[lo : lo + step][there] for x in (best.doc, best.word, best.score)]
        if len(columns[0]):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[lo : lo + step], held)), *map(pa.array, columns)], ["qid", "doc_idx", "word_idx", "score"])


def best_of_partitions(questions: DataFrame, words: DataFrame, k: int, q_vec: str, vec: str) -> DataFrame:
    """A block of questions, with the k best words of each partition. With a column `cells` (an array) of the questions, and cluster_id of the words, each meets only words of its cells."""
    by_cells = "cells" in questions.columns
    rows = questions.where(F.col(q_vec).isNotNull()).select("qid", q_vec, *(["cells"] if by_cells else [])).orderBy("qid").collect()  # one block
    qid, matrix = np.asarray([r[0] for r in rows], np.int64), np.asarray([r[1] for r in rows], np.float64)
    asked: dict[int, list[int]] = {}
    for at, r in enumerate(rows if by_cells else ()):
        for cell in r[2]:
            asked.setdefault(cell, []).append(at)
    shared = words.sparkSession.sparkContext.broadcast((qid, matrix, {c: np.asarray(v) for c, v in asked.items()}))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, of_cell = shared.value
        best = _Best(len(ids), k)
        for b in batches:
            for lo in range(0, len(b) if len(ids) else 0, WORDS):
                part = b.slice(lo, WORDS)
                x = np.asarray(part.column(2).flatten(), np.float64).reshape(len(part), -1)
                doc, word = np.asarray(part.column(0), np.int64), np.asarray(part.column(1), np.int64)
                if not by_cells:
                    _offer_tiles(best, q, x, doc, word)
                    continue
                cell = np.asarray(part.column(3), np.int64)
                for c in np.unique(cell).tolist():
                    if c in of_cell:
                        here = np.flatnonzero(cell == c)
                        _offer_tiles(best, q, x[here], doc[here], word[here], of_cell[c])
        yield from _rows_of(ids, best)

    names = ["doc_idx", "word_idx", vec, *([F.col("cluster_id").cast("long")] if by_cells else [])]
    return words.where(F.col(vec).isNotNull()).select(*names).mapInArrow(work, "qid long, doc_idx long, word_idx long, score double")
