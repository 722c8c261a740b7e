"""LM scoring by deleted interpolation of n-gram estimates.

A text's tokens are its words (A-Z lower-cased) and one end. The probability of a token after another mixes three estimates,

    p(w | u) = l2 * c(u, w) / c(u)  +  l1 * c(w) / N  +  l0 / (V + 1),

with weights l that depend on how often the context u was seen (buckets by powers of two). The weights are learned by
expectation-maximisation on held-out counts: each training occurrence in turn is deleted from the counts it is then predicted
by (c - 1), so the held-out data are all training tokens and no count is lost to a separate set. The first word's context is the end of the text before.

All counts are exact and grow with the corpus; none is ever in one place. Each chunk of texts sends its distinct words and word pairs once
to the bucket of their hash and gets their totals back. EM works on a histogram of (context bucket, log estimates), whose
size is bounded by its bins and not by the corpus.

Null and empty texts have one token, the end; very long ones are scored whole, within a chunk. With no training tokens every estimate but the last is 0.
Repeated rows train and are scored each; an empty table gives an empty result. Extra columns are ignored. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phrasewell.llm._chunks import blob, bucket_count, chunked, cut, release, texts_of
from phrasewell.llm._shared import crc_mod, materialize, table
from phrasewell.llm._vec import mix64, word_hashes

END = np.uint64(0xE17D0F5E7A11C0DE)
#: Context buckets: number of binary digits of the context's count, at most the last.
BUCKETS = 24
#: EM's histogram: bins per octave of an estimate, and their number; the last holds estimates of 0.
PER_OCTAVE, BINS = 4, 200
EM_STEPS = 100


class Tokens:
    """Tokens of some texts, their distinct keys and how to get back from keys to tokens."""

    def __init__(self, texts: list[bytes | None]) -> None:
        words, ends = word_hashes(texts, lower=True)
        n = np.diff(ends)
        self.ends = ends + np.arange(len(texts) + 1)
        self.doc = np.repeat(np.arange(len(texts)), n + 1)
        self.word = np.full(len(self.doc), END)
        self.word[np.arange(len(words)) + np.repeat(np.arange(len(texts)), n)] = words
        before = np.concatenate(([END], self.word[:-1]))
        pair = mix64(before * np.uint64(0x9E3779B97F4A7C15) + self.word * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1))
        self.words, self.at_word = np.unique(self.word, return_inverse=True)
        self.pairs, self.at_pair = np.unique(pair, return_inverse=True)
        self.at_context = np.concatenate(([np.searchsorted(self.words, END)], self.at_word[:-1])) if len(self.doc) else self.at_word


def _narrow(a: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs; the first byte says how many."""
    top = int(a.max(initial=0))
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + blob(a.astype(kind))


def _wide(x: bytes) -> np.ndarray:
    return np.frombuffer(x, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[x[0]], offset=1).astype(np.int64)


def _requests(chunks: DataFrame, buckets: int) -> DataFrame:
    """(bucket, chunk, kind, keys, counts): the chunk's distinct words and pairs with their training counts in it."""

    def work(t: pa.Table) -> pa.Table:
        k = Tokens(texts_of(t["text"]))
        train = np.asarray(t["_train"].to_pylist(), bool)[k.doc]
        out = []
        for kind, keys, at in (("w", k.words, k.at_word), ("p", k.pairs, k.at_pair)):
            count = np.bincount(at[train], minlength=len(keys))
            out += [(b, t["_chunk"][0].as_py(), kind, blob(keys[s]), _narrow(count[s])) for b, s in cut(keys, buckets)]
        kinds = (pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.binary())
        return pa.table({n: pa.array([x[i] for x in out], kind) for i, (n, kind) in enumerate(zip(("bucket", "chunk", "kind", "keys", "counts"), kinds, strict=True))})

    return chunks.groupBy("_chunk").applyInArrow(work, "bucket int, chunk long, kind string, keys binary, counts binary")


def _totals(requests: DataFrame) -> DataFrame:
    """(chunk, kind, bucket, totals) in the order of each request's keys; and a row of kind N per bucket of words: distinct and all training words."""

    def work(t: pa.Table) -> pa.Table:
        kind, bucket = t["kind"][0].as_py(), t["bucket"][0].as_py()
        keys = [np.frombuffer(x, np.uint64) for x in t["keys"].to_pylist()]
        every, back = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(every), np.int64)
        np.add.at(total, back, np.concatenate([_wide(x) for x in t["counts"].to_pylist()]))
        edges = np.cumsum([0, *map(len, keys)])
        out = [(c, kind, bucket, _narrow(total[back[a:b]]), 0, 0) for c, a, b in zip(t["chunk"].to_pylist(), edges[:-1], edges[1:], strict=True)]
        if kind == "w":
            out.append((None, "N", bucket, None, int((total > 0).sum()), int(total.sum())))
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
        return pa.table({n: pa.array([x[i] for x in out], k) for i, (n, k) in enumerate(zip(("chunk", "kind", "bucket", "totals", "distinct", "tokens"), kinds, strict=True))})

    return requests.groupBy("bucket", "kind").applyInArrow(work, "chunk long, kind string, bucket int, totals binary, distinct long, tokens long")


def _answer(t: pa.Table, kind: str) -> np.ndarray:
    rows = sorted((b, x) for b, k, x in zip(t["bucket"].to_pylist(), t["kind"].to_pylist(), t["totals"].to_pylist(), strict=True) if k == kind)
    return np.concatenate([_wide(x) for _, x in rows] or [np.empty(0, np.int64)])


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(np.maximum(context, 0).astype(np.float64))[1], BUCKETS - 1)


def _bin(estimate: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        q = np.floor(-np.log2(estimate) * PER_OCTAVE)
    return np.where(estimate > 0, np.clip(q, 0, BINS - 2), BINS - 1).astype(np.int64)


def _ratio(a: np.ndarray, b: np.ndarray | float) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=np.asarray(b) > 0)


def _histogram(chunks: DataFrame, answers: DataFrame, n: int) -> DataFrame:
    """(cell, count) over all training tokens, each deleted from its own counts."""

    def work(t: pa.Table, r: pa.Table) -> pa.Table:
        cell, count = np.empty(0, np.int64), np.empty(0, np.int64)
        if t.num_rows and r.num_rows:
            k = Tokens(texts_of(t["text"]))
            some = np.asarray(t["_train"].to_pylist(), bool)[k.doc]
            words, pairs = _answer(r, "w"), _answer(r, "p")
            context = words[k.at_context[some]] - 1
            pair, word = pairs[k.at_pair[some]] - 1, words[k.at_word[some]] - 1
            cells = (_bucket(context) * BINS + _bin(_ratio(pair, context))) * BINS + _bin(word / max(1, n - 1))
            cell, count = np.unique(cells, return_counts=True)
        return pa.table({"cell": pa.array(cell, pa.int64()), "count": pa.array(count, pa.int64())})

    found = chunks.groupBy("_chunk").cogroup(answers.groupBy("_chunk")).applyInArrow(work, "cell long, count long")
    return found.groupBy("cell").agg(F.sum("count").alias("count"))


def learn_weights(cells: np.ndarray, counts: np.ndarray, v: int, steps: int = EM_STEPS) -> np.ndarray:
    """Weights (l2, l1, l0) per context bucket by EM over the histogram."""
    value = np.append(2.0 ** (-(np.arange(BINS - 1) + 0.5) / PER_OCTAVE), 0.0)
    b, q2, q1 = cells // (BINS * BINS), cells // BINS % BINS, cells % BINS
    parts = np.stack([value[q2], value[q1], np.full(len(cells), 1.0 / (v + 1))])
    weights = np.tile(np.asarray([0.4, 0.5, 0.1]), (BUCKETS, 1))
    weights[0] = (0.0, 0.9, 0.1)
    for _ in range(steps):
        post = weights[b].T * parts
        post *= counts / post.sum(axis=0)
        new = np.stack([np.bincount(b, p, BUCKETS) for p in post], axis=1) + np.asarray([0.0, 0.5, 0.5]) * 1e-3
        new /= new.sum(axis=1, keepdims=True)
        moved, weights = np.abs(new - weights).max(), new
        if moved < 1e-7:
            break
    seen = np.bincount(b, minlength=BUCKETS) > 0
    for i in range(1, BUCKETS):  # a bucket that was never seen takes the one below
        if not seen[i]:
            weights[i] = weights[i - 1]
    return weights


def score(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text, _train boolean): doc_id, _train, n_tokens, n_known, train_tokens, base_score and score."""
    chunks = chunked(docs.select("doc_id", "text", "_train"))
    size = chunks.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    answers = materialize(_totals(_requests(chunks, bucket_count(size // 7))))
    release(docs)
    v, n = (x or 0 for x in answers.where("kind = 'N'").agg(F.sum("distinct"), F.sum("tokens")).collect()[0])
    answers = answers.where("kind <> 'N'").select(F.col("chunk").alias("_chunk"), "kind", "bucket", "totals")
    cells = _histogram(chunks, answers, n).collect()  # at most BUCKETS * BINS * BINS cells
    weights = learn_weights(np.asarray([r[0] for r in cells], np.int64), np.asarray([r[1] for r in cells], np.float64), v)
    key = docs.schema["doc_id"].dataType.simpleString()

    def work(t: pa.Table, r: pa.Table) -> pa.Table:
        k = Tokens(texts_of(t["text"]))
        words, pairs = _answer(r, "w"), _answer(r, "p")
        word, context, pair = words[k.at_word], words[k.at_context], pairs[k.at_pair]
        w = weights[_bucket(context)]
        p = w[:, 0] * _ratio(pair, context) + w[:, 1] * word / max(1, n) + w[:, 2] / (v + 1)
        total = lambda x: np.add.reduceat(x, k.ends[:-1]) if len(x) else np.zeros(0)
        base = np.log10((word + 1) / (n + v + 1))
        cols = [np.diff(k.ends), total((word > 0).astype(np.int64)), np.full(t.num_rows, n)]
        return pa.table([t["doc_id"], t["_train"], *(pa.array(c, pa.int64()) for c in cols), pa.array(total(base), pa.float64()), pa.array(total(np.log10(p)), pa.float64())], names=["doc_id", "_train", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return chunks.groupBy("_chunk").cogroup(answers.groupBy("_chunk")).applyInArrow(work, f"doc_id {key}, _train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("_train", crc_mod(F.col("doc_id"), 7) != 2)
    return score(docs).withColumn("held_out", ~F.col("_train")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
