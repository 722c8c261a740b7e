"""Queries over vectors: scalar functions, norms, filters and span kernels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from phrasewell.functions import vectors as V
from phrasewell.operators import index as I
from phrasewell.operators import spans as S
from phrasewell.plans.registry import query
from phrasewell.sources import views as D

QUANT = "list_transform({v}, lambda x: round_even(greatest(-128, least(127, (x + 2) * 20)), 0)::INT)"
DEQ = "list_transform({v}, lambda x: x / 20.0 - 2.0)"
total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)


@query("f1_quantize", f"SELECT word_id, array_to_string({QUANT.format(v='s')}, ',') AS code FROM w", "w")
def f1(spark, d):
    return D.words(spark, d).select("word_id", F.array_join(V.quantize(F.col("start")), ",").alias("code"))


@query("f2_dequantize", f"SELECT word_id, round(list_sum({DEQ.format(v=QUANT.format(v='s'))}), 6) + 0.0 AS total, round(list_max({DEQ.format(v=QUANT.format(v='s'))}), 6) AS top FROM w", "w")
def f2(spark, d):
    v = V.maybe_dequantize(V.quantize(F.col("start")), F.lit(V.OFFSET), F.lit(V.SCALE))
    return D.words(spark, d).select("word_id", (F.round(total(v), 6) + 0.0).alias("total"), F.round(F.array_max(v), 6).alias("top"))


@query("f3_encode_phrase", "SELECT word_id, round(list_sum(s), 6) AS s, round(list_sum(e), 6) AS e, round(list_dot_product(sa, sb), 6) AS span FROM w", "w")
def f3(spark, d):
    return D.words(spark, d).select("word_id", F.round(total(F.col("start")), 6).alias("s"), F.round(total(F.col("end")), 6).alias("e"), F.round(V.dot(F.col("span_a"), F.col("span_b")), 6).alias("span"))


@query("f4_similarity", "SELECT word_id, round(list_dot_product(s, e), 6) AS ip, round(list_dot_product(s, e) - 0.5 * (list_dot_product(s, s) + list_dot_product(e, e)), 6) AS l2 FROM w", "w")
def f4(spark, d):
    s, e = F.col("start"), F.col("end")
    return D.words(spark, d).select("word_id", F.round(V.similarity(s, e), 6).alias("ip"), F.round(V.similarity(s, e, "l2"), 6).alias("l2"))


@query("f5_max_norm_lift", "m AS (SELECT max(sqrt(list_dot_product(s, s))) * 1.3 AS m FROM w) SELECT word_id, round(sqrt(greatest(0, m * m - list_dot_product(s, s))), 6) AS lifted, len(s) + 1 + 3 AS size FROM w, m", "w")
def f5(spark, d):
    w = D.words(spark, d)
    v = V.lift(F.col("start"), F.col("max_norm"), 3)
    return w.crossJoin(F.broadcast(I.max_norm(w))).select("word_id", F.round(v[0], 6).alias("lifted"), F.size(v).cast("long").alias("size"))


@query("f6_distance_to_product", "m AS (SELECT max(sqrt(list_dot_product(s, s))) AS m FROM w) SELECT word_id, round(list_dot_product(s, e), 6) AS product FROM w, m", "w")
def f6(spark, d):
    w = D.words(spark, d)
    m = F.col("max_norm")
    l2 = V.squared_distance(V.lift(F.col("start"), m), V.lift_question(F.col("end")))
    return w.crossJoin(F.broadcast(I.max_norm(w, 1.0))).select("word_id", F.round(V.distance_to_product(l2, m, V.norm(F.col("end"))), 6).alias("product"))


@query("f30_unpack_id", "SELECT word_id, ((word_id * 90000001) // 100000000) * 100000000 AS shard, (word_id * 90000001) % 100000000 AS idx FROM w", "w")
def f30(spark, d):
    shard, idx = V.unpack_id(F.col("word_id") * 90000001)
    return D.words(spark, d).select("word_id", shard.alias("shard"), idx.alias("idx"))


@query("f37_boundary_logits", "SELECT word_id, round(list_sum(list_transform(range(1, 25), lambda i: s[i] * (i % 5 - 2))) + 0.25, 6) AS start_logit FROM w", "w")
def f37(spark, d):
    return D.words(spark, d).select("word_id", F.round(V.linear(F.col("start"), [i % 5 - 2 for i in range(1, 25)], 0.25), 6).alias("start_logit"))


@query("a3_max_norm", "SELECT round(max(sqrt(list_dot_product(s, s))) * 1.3, 9) AS max_norm FROM w", "w")
def a3(spark, d):
    return I.max_norm(D.words(spark, d)).select(F.round("max_norm", 9).alias("max_norm"))


@query("p3_norm_filter", "SELECT word_id, round(sqrt(list_dot_product(s, s)), 6) AS n FROM w WHERE sqrt(list_dot_product(s, s)) <= 0.6", "w")
def p3(spark, d):
    return I.within_norm(D.words(spark, d), 0.6).select("word_id", F.round("norm", 6).alias("n"))


@query("w6_phrase_spans", "SELECT a.doc_idx, a.word_idx AS i, b.word_idx AS j FROM w a JOIN w b ON a.doc_idx = b.doc_idx AND b.word_idx BETWEEN a.word_idx AND a.word_idx + 4", "w")
def w6(spark, d):
    return S.enumerate_spans(D.words(spark, d), 5).select("doc_idx", "i", "j")


BOUNDARY = """
st AS (SELECT doc_idx, word_idx, row_number() OVER (PARTITION BY doc_idx ORDER BY word_idx) - 1 AS k FROM w WHERE fs > 0),
en AS (SELECT doc_idx, word_idx, row_number() OVER (PARTITION BY doc_idx ORDER BY word_idx) - 1 AS k FROM w WHERE fe > 0),
sp AS (SELECT st.doc_idx, st.word_idx, st.k, unnest(range(0, 5)) AS o FROM st)
"""


@query("p1_boundary_filter", BOUNDARY + "SELECT sp.doc_idx, sp.word_idx AS i, sp.k AS start_ord, o, coalesce(en.k, -1) AS end_ord FROM sp LEFT JOIN en ON en.doc_idx = sp.doc_idx AND en.word_idx = sp.word_idx + o", "w")
def p1(spark, d):
    return S.boundary_filter(D.words(spark, d), 0.0, 5)


@query("p2_boundary_evaluation", "SELECT word_id, fs >= 0 AS keeps_start, fe >= 0 AS keeps_end FROM w WHERE fs >= 0 OR fe >= 0", "w")
def p2(spark, d):
    return D.words(spark, d).where("filter_start >= 0 or filter_end >= 0").select("word_id", (F.col("filter_start") >= 0).alias("keeps_start"), (F.col("filter_end") >= 0).alias("keeps_end"))


@query("a12_kept_per_word", "SELECT doc_idx, round(sum((fs >= 0)::INT) / count(*), 6) AS nspw, round(sum((fe >= 0)::INT) / count(*), 6) AS nepw FROM w GROUP BY doc_idx", "w")
def a12(spark, d):
    share = lambda c: F.round(F.count_if(F.col(c) >= 0) / F.count("*"), 6)
    return D.words(spark, d).groupBy("doc_idx").agg(share("filter_start").alias("nspw"), share("filter_end").alias("nepw"))


SCORES = "sc AS (SELECT qid, a.doc_idx, a.word_idx AS i, b.word_idx AS j, list_dot_product(qs, a.s) + list_dot_product(qe, b.e) + qp * list_dot_product(a.sa, b.sb) AS score FROM q JOIN w a ON a.doc_idx = q.qid // 25 JOIN w b ON a.doc_idx = b.doc_idx AND b.word_idx BETWEEN a.word_idx AND a.word_idx + 4)"


@query("q7_span_logits", SCORES + " SELECT qid, doc_idx, i, j, round(score, 6) AS score FROM sc", "w q")
def q7(spark, d):
    own = D.questions(spark, d).withColumn("doc_idx", F.floor(F.col("qid") / D.PER_DOC).cast("long"))
    return S.span_scores(own, D.words(spark, d), 5).select("qid", "doc_idx", "i", "j", F.round("score", 6).alias("score"))


@query("a14_best_end", SCORES + " SELECT qid, doc_idx, i, arg_max(j, struct_pack(s := score, k := -j)) AS j, round(max(score), 6) AS score FROM sc GROUP BY qid, doc_idx, i", "w q")
def a14(spark, d):
    own = D.questions(spark, d).withColumn("doc_idx", F.floor(F.col("qid") / D.PER_DOC).cast("long"))
    return S.best_end(S.span_scores(own, D.words(spark, d), 5)).select("qid", "doc_idx", "i", "j", F.round("score", 6).alias("score"))


@query("a15_best_span", SCORES + " SELECT qid, i, j, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, i, j) AS n FROM sc) WHERE n = 1", "w q")
def a15(spark, d):
    own = D.questions(spark, d).withColumn("doc_idx", F.floor(F.col("qid") / D.PER_DOC).cast("long"))
    return S.best_span(S.span_scores(own, D.words(spark, d), 5)).select("qid", "i", "j", F.round("score", 6).alias("score"))


EXHAUSTIVE = (
    SCORES.replace("a.word_idx + 4)", "a.word_idx + 3 AND a.fs >= 0 AND b.fe >= 0)")
    + ", wn AS (SELECT doc_idx, count(*) AS n FROM w GROUP BY doc_idx), sw AS (SELECT sc.*, n, list_transform(range(greatest(0, ceil((n - 10) / 4.0))::BIGINT + 1), lambda k: CASE WHEN i >= k * 4 AND i < k * 4 + least(10, n - k * 4) THEN least(i - k * 4, k * 4 + least(10, n - k * 4) - 1 - i) + 0.01 * least(10, n - k * 4) ELSE -1 END) AS ls FROM sc JOIN wn USING (doc_idx)), "
    "kw AS (SELECT *, list_position(ls, list_max(ls)) - 1 AS k FROM sw), inw AS (SELECT * FROM kw WHERE j <= k * 4 + least(10, n - k * 4) - 1)"
)


@query("q6_exhaustive_prediction", EXHAUSTIVE + " SELECT qid, i, j, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, i, j) AS n FROM (SELECT qid, i, j, score FROM inw)) WHERE n = 1", "w q")
def q6(spark, d):
    """The best span of each question's document, in windows of 10 words: its start where it has most context, both ends past the boundary filter."""
    w = D.words(spark, d)
    own = D.questions(spark, d).withColumn("doc_idx", F.floor(F.col("qid") / D.PER_DOC).cast("long"))
    found = S.span_scores(own, w, 4, 0.0).select("qid", "doc_idx", "i", "j", "score")
    found = S.in_best_window(found, w.groupBy("doc_idx").agg(F.count("*").alias("n")), 10, 4)
    return S.best_span(found).select("qid", "i", "j", F.round("score", 6).alias("score"))


@query("w9_ordinals", "SELECT word_id, 100000000 + row_number() OVER (ORDER BY doc_idx, word_idx) - 1 AS ordinal FROM w WHERE sqrt(list_dot_product(s, s)) <= 0.7", "w")
def w9(spark, d):
    return I.ordinals(I.within_norm(D.words(spark, d), 0.7), 100_000_000).select("word_id", "ordinal")


@query("j3_ordinal_lookup", "SELECT word_id AS ordinal, doc_idx, word_idx FROM w", "w")
def j3(spark, d):
    found = I.ordinals(D.words(spark, d), 0)
    shard, idx = V.unpack_id(F.col("ordinal"))
    asked = found.select((shard + idx).alias("ordinal"))
    return I.lookup(asked, found).select("ordinal", "doc_idx", "word_idx")


@query("i5_idx2id", "SELECT doc_idx // 1000 * 100000000 AS shard, row_number() OVER (PARTITION BY doc_idx // 1000 ORDER BY doc_idx, word_idx) - 1 AS idx, doc_idx, word_idx FROM w", "w")
def i5(spark, d):
    w = D.words(spark, d).withColumn("shard", F.floor(F.col("doc_idx") / 1000).cast("long") * 100_000_000)
    return w.select("shard", (F.row_number().over(Window.partitionBy("shard").orderBy("doc_idx", "word_idx")) - 1).cast("long").alias("idx"), "doc_idx", "word_idx")
