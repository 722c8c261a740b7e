"""What must not grow with the tables: memory of a task, rows that are shuffled."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from phrasewell.operators import index as I
from phrasewell.plans import search as Q
from phrasewell.sources import views as D


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_best_starts_in_bounded_memory():
    from phrasewell.operators import topk as K

    r = np.random.default_rng(5)
    q, x = r.normal(size=(2000, 24)), r.normal(size=(9000, 24))
    x[1::3] = x[0]  # copies
    doc, word = np.arange(9000) // 25, np.arange(9000) % 25
    best = K._Best(2000, 5)
    tracemalloc.start()
    for lo in range(0, 9000, 4500):
        K._offer_tiles(best, q, x[lo : lo + 4500], doc[lo : lo + 4500], word[lo : lo + 4500])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6  # all scores at once: 144e6 bytes
    for i in range(0, 2000, 100):
        score = np.zeros(9000)
        for k in range(24):
            score += q[i, k] * x[:, k]
        want = np.lexsort((word, doc, -score))[:5]
        assert best.doc[i].tolist() == doc[want].tolist() and best.word[i].tolist() == word[want].tolist() and best.score[i].tolist() == score[want].tolist()


def test_search_by_cells_joins_no_pairs(spark, sf):
    q, w = D.questions(spark, sf), D.words(spark, sf)
    centroids = I.label_centroids(w)
    found = Q.starts_by_cells(q, I.assign(w, centroids).withColumn("decoded", F.col("start")), centroids, 2, 3)
    assert "Join" not in plan(found)
    met = I.probe(q, centroids, 2).join(I.assign(w, centroids).select("cluster_id", "doc_idx", "word_idx", "start"), "cluster_id")
    from phrasewell.functions import vectors as V
    from phrasewell.operators import topk as K

    want = K.top(met.withColumn("score", V.dot(F.col("q_start"), F.col("start"))), 3).select("qid", "rank", "doc_idx", "word_idx", "score")
    assert sorted(found.select("qid", "rank", "doc_idx", "word_idx", "score").collect()) == sorted(want.collect())


def test_sparse_weights_shuffle_no_terms(spark):
    from phrasewell.operators import sparse as P
    from phrasewell.sources import io as IO

    texts = [(1, "Ab ab c\n\n!?\nc d"), (2, "c"), (3, None), (4, ""), (2, "ab c d\nx"), (5, "x é x é"), (6, "y"), (7, "z")]  # two texts of document 2
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    pars = docs.where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("par_idx", "par_text"))
    tf = P.term_counts(pars, ["doc_id", "par_idx"], "par_text")
    df, n = P.document_frequencies(tf), lambda rows: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows.collect())
    got = P.document_weights(docs)
    assert n(got) == n(P.weights(tf, df, docs).select(*got.columns))
    filled = P.document_weights(docs, fallback=True).select("doc_id", "par_idx", "term_id", "val")
    assert n(filled) == n(P.with_fallback(pars.select("doc_id", "par_idx").distinct(), P.weights(tf, df, docs), ["doc_id", "par_idx"]).select(*filled.columns))
    whole = P.weights(tf.groupBy("doc_id", "term_id").agg(F.sum("tf").alias("tf")), df, docs)
    asked = spark.createDataFrame([(0, "c d x"), (20, "AB c q"), (40, "q")], "qid long, text string")
    weighted = P.weights(P.term_counts(asked, ["qid"], "text"), df, docs)
    products = P.Products(asked, docs)
    assert n(products.pairs(False)) == n(P.product(weighted, whole, "qid", ["doc_id"]))
    assert n(products.pairs(True)) == n(P.product(weighted, P.weights(tf, df, docs), "qid", ["doc_id", "par_idx"]))
    alone = IO.materialized(docs.where("doc_id <> 2"))
    for made in (P.document_weights(alone), P.Products(asked, alone).pairs(True)):
        assert "Exchange" not in plan(made)


def test_contexts_are_read_without_a_join_of_texts(spark, sf):
    assert "Join" not in plan(D.titled_contexts(spark, sf))
