"""Queries for search, index and sparse operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from phrasewell.functions import text as X
from phrasewell.functions import vectors as V
from phrasewell.operators import index as I
from phrasewell.operators import sparse as P
from phrasewell.operators import topk as K
from phrasewell.plans import search as Q
from phrasewell.plans.registry import query
from phrasewell.sources import io as IO
from phrasewell.sources import views as D

R6 = lambda c: F.round(c, 6).alias(c)
DOT = "all_s AS (SELECT qid, doc_idx, word_idx, list_dot_product(qs, s) AS score FROM q, w), top5 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_idx, word_idx) AS rank FROM all_s) WHERE rank <= 5)"
SPANS = "(SELECT {t}.qid, rank, a.doc_idx, a.word_idx AS i, b.word_idx AS j, {first} + list_dot_product(qe, b.e) + qp * list_dot_product(a.sa, b.sb) AS score FROM {t} JOIN q ON q.qid = {t}.qid JOIN w a ON a.doc_idx = {t}.doc_idx AND a.word_idx = {t}.word_idx JOIN w b ON b.doc_idx = a.doc_idx AND b.word_idx BETWEEN a.word_idx AND a.word_idx + 4)"
BEST = "SELECT qid, rank, doc_idx, i, arg_max(j, struct_pack(s := score, k := -j)) AS j, round(max(score), 6) AS score FROM {spans} GROUP BY qid, rank, doc_idx, i"


#: Open search over placed words, and spans as answers with their text.
PLACED = DOT.replace("FROM q, w)", "FROM q, pw)")
PSPANS = SPANS.replace("JOIN w ", "JOIN pw ")
RESULTS = """
res AS (SELECT r.qid, r.rank, r.doc_idx, title, r.i, r.j, r.score, substr(context, h.char_start + 1, coalesce(t.char_end, h.char_start + 1) - h.char_start) AS answer, string_split(substr(context, 1, h.char_start), ' [PAR] ')[-1] AS lft, string_split(substr(context, coalesce(t.char_end, h.char_start + 1) + 1), ' [PAR] ')[1] AS rgt
  FROM r JOIN pw h ON h.doc_idx = r.doc_idx AND h.word_idx = r.i LEFT JOIN pw t ON t.doc_idx = r.doc_idx AND t.word_idx = r.j JOIN ctx c ON c.doc_idx = r.doc_idx),
shown AS (SELECT qid, rank, doc_idx, title, i, j, score, answer, lft || answer || rgt AS context, len(lft)::BIGINT AS start_pos, (len(lft) + len(answer))::BIGINT AS end_pos FROM res)
"""


def _placed(spark, d):
    """Placed words, made once: searches read them again and again."""
    return IO.materialized(D.placed_words(spark, d))


def _shown(spans, words, contexts, presentable=False):
    out = Q.results(spans, words, D.within(contexts, words), presentable).withColumn("score", F.round("score", 6))
    return out.withColumns({c: F.col(c).cast("long") for c in ("start_pos", "end_pos")})


@query("w1_topk_start", DOT + " SELECT qid, rank, doc_idx, word_idx, round(score, 6) AS score FROM top5", "w q")
def w1(spark, d):
    return Q.starts_open(D.questions(spark, d), D.words(spark, d), 5).select("qid", "rank", "doc_idx", "word_idx", R6("score"))


@query("q1_dense_search", PLACED + ", r AS (" + BEST.format(spans=PSPANS.format(t="top5", first="list_dot_product(qs, a.s)")) + ")," + RESULTS + "SELECT * FROM shown", "pw q")
def q1(spark, d):
    w = _placed(spark, d)
    return _shown(Q.search(D.questions(spark, d), w), w, D.titled_contexts(spark, d))


OWN_PAR = "ownp AS (SELECT q.*, doc_idx AS qd, par_idx AS qpar FROM q JOIN pw ON word_id = qid), sc AS (SELECT qid, pw.doc_idx, word_idx, list_dot_product(qs, s) AS score FROM ownp JOIN pw ON pw.doc_idx = qd AND pw.par_idx = qpar), top5 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_idx, word_idx) AS rank FROM sc) WHERE rank <= 5)"


@query("q1_closed_paragraph", OWN_PAR + ", r AS (" + BEST.format(spans=PSPANS.format(t="top5", first="list_dot_product(qs, a.s)")) + ")," + RESULTS + "SELECT * FROM shown", "pw q")
def q1p(spark, d):
    """Among the words of the question's own paragraph."""
    w = _placed(spark, d)
    asked = D.questions(spark, d).join(w.select(F.col("word_id").alias("qid"), "doc_idx", "par_idx"), "qid")
    return _shown(Q.search(asked, w, scope=("doc_idx", "par_idx")), w, D.titled_contexts(spark, d))


@query("w3_final_order", DOT + ", r AS (" + BEST.format(spans=SPANS.format(t="top5", first="list_dot_product(qs, a.s)")) + ") SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rank) AS place FROM r", "w q")
def w3(spark, d):
    out = Q.search(D.questions(spark, d), D.words(spark, d)).withColumn("score", F.round("score", 6))
    return K.top(out, 5, ties=("rank",), rank="place").select("qid", "rank", "doc_idx", "i", "j", "score", "place")


CLOSED = "own AS (SELECT qid, doc_idx, word_idx, list_dot_product(qs, s) AS score FROM q JOIN w ON doc_idx = qid // 25), top5 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_idx, word_idx) AS rank FROM own) WHERE rank <= 5)"


def _own(spark, d):
    return D.questions(spark, d).withColumn("doc_idx", F.floor(F.col("qid") / D.PER_DOC).cast("long"))


@query("j9_closed_starts", CLOSED + " SELECT qid, rank, doc_idx, word_idx, round(score, 6) AS score FROM top5", "w q")
def j9(spark, d):
    return Q.starts_closed(_own(spark, d), D.words(spark, d), 5).select("qid", "rank", "doc_idx", "word_idx", R6("score"))


@query("q2_search_start", CLOSED + ", o AS (SELECT qid, max(list_dot_product(qs, s)) AS best FROM q, w GROUP BY qid) SELECT top5.qid, round(max(score), 6) AS closed_best, round(any_value(best), 6) AS open_best FROM top5 JOIN o ON o.qid = top5.qid GROUP BY top5.qid", "w q")
def q2(spark, d):
    q, w = _own(spark, d), D.words(spark, d)
    closed = Q.starts_closed(q, w, 5).groupBy("qid").agg(F.round(F.max("score"), 6).alias("closed_best"))
    return closed.join(Q.starts_open(q, w, 1).select("qid", F.round("score", 6).alias("open_best")), "qid")


#: Only words with a good boundary logit end a span.
KEPT = "(SELECT {t}.qid, rank, a.doc_idx, a.word_idx AS i, b.word_idx AS j, {first} + coalesce(list_dot_product(qe, b.e) + qp * list_dot_product(a.sa, b.sb), -1e9) AS score FROM {t} JOIN q ON q.qid = {t}.qid JOIN pw a ON a.doc_idx = {t}.doc_idx AND a.word_idx = {t}.word_idx LEFT JOIN pw b ON b.doc_idx = a.doc_idx AND b.fe > 0.1 AND b.word_idx BETWEEN a.word_idx AND a.word_idx + 4)"


@query("q3_complete_phrase", CLOSED.replace("JOIN w ON", "JOIN pw ON") + ", r AS (" + BEST.format(spans=KEPT.format(t="top5", first="list_dot_product(qs, a.s)")) + ")," + RESULTS + "SELECT * FROM shown", "pw q")
def q3(spark, d):
    """Starts without a kept end get the character after them and a score of their own."""
    q, w = _own(spark, d), _placed(spark, d)
    return _shown(Q.complete(q, Q.starts_closed(q, w, 5), w, ends=w.where("filter_end > 0.1")), w, D.titled_contexts(spark, d))


@query("j4_end_candidates", CLOSED + " SELECT top5.qid, rank, b.doc_idx, top5.word_idx AS i, b.word_idx AS j, round(list_dot_product(qe, b.e), 6) AS end_score FROM top5 JOIN q ON q.qid = top5.qid JOIN w b ON b.doc_idx = top5.doc_idx AND b.word_idx BETWEEN top5.word_idx AND top5.word_idx + 4", "w q")
def j4(spark, d):
    q, w = _own(spark, d), D.words(spark, d)
    starts = Q.starts_closed(q, w, 5).join(q.select("qid", "q_end"), "qid").withColumn("j", F.explode(F.sequence("word_idx", F.col("word_idx") + 4)))
    tails = w.select("doc_idx", F.col("word_idx").alias("j"), "end")
    return starts.join(tails, ["doc_idx", "j"]).select("qid", "rank", "doc_idx", F.col("word_idx").alias("i"), "j", F.round(V.dot(F.col("q_end"), F.col("end")), 6).alias("end_score"))


@query("j1_candidate_scoring", "SELECT qid, count(*) AS n, round(max(list_dot_product(qs, s)), 6) AS best FROM q JOIN w ON doc_idx BETWEEN qid // 25 AND qid // 25 + 1 GROUP BY qid", "w q")
def j1(spark, d):
    q = _own(spark, d).withColumn("doc_idx", F.explode(F.array("doc_idx", F.col("doc_idx") + 1)))
    met = q.join(D.words(spark, d).select("doc_idx", "start"), "doc_idx")
    return met.groupBy("qid").agg(F.count("*").alias("n"), F.round(F.max(V.dot(F.col("q_start"), F.col("start"))), 6).alias("best"))


CELL = "cen AS (SELECT label AS cluster_id, arg_min(s, word_id) AS c FROM w GROUP BY label), cell AS (SELECT word_id, doc_idx, word_idx, s, cluster_id FROM (SELECT w.*, cluster_id, row_number() OVER (PARTITION BY word_id ORDER BY list_sum(list_transform(range(1, 25), lambda k: (s[k] - c[k]) * (s[k] - c[k]))), cluster_id) AS n FROM w, cen) WHERE n = 1), probe AS (SELECT qid, qs, cluster_id FROM (SELECT q.*, cluster_id, row_number() OVER (PARTITION BY qid ORDER BY list_sum(list_transform(range(1, 25), lambda k: (qs[k] - c[k]) * (qs[k] - c[k]))), cluster_id) AS n FROM q, cen) WHERE n <= 3)"


#: 8-bit codes by ranges over all words, and what they stand for.
CODED = ", lohi AS (SELECT [" + ", ".join(f"min(s[{i}])" for i in range(1, 25)) + "] AS lo, [" + ", ".join(f"max(s[{i}])" for i in range(1, 25)) + "] AS hi FROM w), coded AS (SELECT word_id, doc_idx, word_idx, cluster_id, list_transform(range(1, 25), lambda k: floor((s[k] - lo[k]) / (hi[k] - lo[k]) * 255 + 0.5)) AS codes, list_transform(range(1, 25), lambda k: lo[k] + floor((s[k] - lo[k]) / (hi[k] - lo[k]) * 255 + 0.5) / 255.0 * (hi[k] - lo[k])) AS dec FROM cell, lohi)"


def _index(spark, d, stages=("coarse", "fine", "add", "merge"), keys=("doc_idx", "word_idx"), words=None):
    """An index of all words, added in two batches of documents."""
    w = D.words(spark, d) if words is None else words
    path = IO.scratch(spark)
    for stage in stages:
        parts = {"0": w.where("doc_idx % 2 = 0"), "1": w.where("doc_idx % 2 = 1")} if stage == "add" else {"0": w}
        for shard, part in parts.items():
            I.build(part, path, I.label_centroids(w), stage, shard=shard, keys=keys)
    return path


@query("i1_coarse_cells", CELL + " SELECT word_id, cluster_id FROM cell", "w q")
def i1(spark, d):
    w = D.words(spark, d)
    return I.assign(w, I.label_centroids(w)).select("word_id", "cluster_id")


@query("i3_cell_sizes", CELL + CODED + " SELECT cluster_id, count(*) AS n, min(word_id) AS first, sum(list_sum(codes))::BIGINT AS total FROM coded GROUP BY cluster_id", "w q")
def i3(spark, d):
    stored = spark.read.parquet(f"{_index(spark, d)}/index")
    sums = F.aggregate("codes", F.lit(0).cast("long"), lambda s, x: s + x)
    return stored.groupBy("cluster_id").agg(F.count("*").alias("n"), F.min(F.col("doc_idx") * D.PER_DOC + F.col("word_idx")).alias("first"), F.sum(sums).alias("total"))


@query("i3_paragraph_mode", CELL + " SELECT cluster_id, pw.doc_idx, par_idx, count(*) AS n FROM cell JOIN pw USING (word_id) GROUP BY ALL", "pw q")
def i3p(spark, d):
    """The index keeps each word's paragraph. Centroids are those of all words."""
    w, path = D.placed_words(spark, d), IO.scratch(spark)
    for stage in ("coarse", "fine", "add", "merge"):
        I.build(w, path, I.label_centroids(D.words(spark, d)), stage, keys=("doc_idx", "par_idx", "word_idx"))
    return spark.read.parquet(f"{path}/index").groupBy("cluster_id", "doc_idx", F.col("par_idx").cast("long").alias("par_idx")).agg(F.count("*").alias("n"))


BY_CELLS = CELL + CODED + ", sc AS (SELECT qid, doc_idx, word_idx, list_dot_product(qs, dec) AS score FROM probe JOIN coded USING (cluster_id)), top5 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_idx, word_idx) AS rank FROM sc) WHERE rank <= 5)"


@query("j2_cell_join", BY_CELLS + " SELECT qid, rank, doc_idx, word_idx, round(score, 6) AS score FROM top5", "w q")
def j2(spark, d):
    """Only the folders of probed cells are read, and only their codes."""
    path = _index(spark, d)
    return Q.starts_by_cells(D.questions(spark, d), I.stored(spark, path), spark.read.parquet(f"{path}/centroids"), 3, 5).select("qid", "rank", "doc_idx", "word_idx", R6("score"))


@query("q1_indexed_search", BY_CELLS + " " + BEST.format(spans=SPANS.format(t="top5", first="list_dot_product(qs, a.s)")), "w q")
def q1i(spark, d):
    """Candidates by decoded vectors from cells, scores by the words' own vectors."""
    path = _index(spark, d)
    w = D.words(spark, d)
    return Q.search(D.questions(spark, d), w, cells=I.stored(spark, path), centroids=spark.read.parquet(f"{path}/centroids"), nprobe=3).select("qid", "rank", "doc_idx", "i", "j", R6("score"))


@query("i2_scalar_quantizer", "lo AS (SELECT [" + ", ".join(f"min(s[{i}])" for i in range(1, 25)) + "] AS lo, [" + ", ".join(f"max(s[{i}])" for i in range(1, 25)) + "] AS hi FROM w) SELECT word_id, array_to_string(list_transform(range(1, 25), lambda k: floor((s[k] - lo[k]) / (hi[k] - lo[k]) * 255 + 0.5)::INT), ',') AS codes FROM w, lo", "w")
def i2(spark, d):
    return I.scalar_codes(D.words(spark, d), 24).select("word_id", F.array_join("codes", ",").alias("codes"))


def _lloyd(k: int, steps: int, first: int = 1, size: int = 24, name: str = "a") -> str:
    """CTEs {name}0 to {name}{steps}: centroids after each of Lloyd's steps on components first to first + size - 1; {name}: each word's cell."""
    vec = f"s[{first}:{first + size - 1}]"
    nearest = f"(SELECT word_id, v, id FROM (SELECT word_id, v, id, row_number() OVER (PARTITION BY word_id ORDER BY list_sum(list_transform(range(1, {size + 1}), lambda k: (v[k] - c[k]) * (v[k] - c[k]))), id) AS n FROM {name}v, {{c}}) WHERE n = 1)"
    out = [f"{name}v AS MATERIALIZED (SELECT word_id, {vec} AS v FROM w)", f"{name}0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY md5('29:' || word_id), word_id) - 1 AS id, v AS c FROM {name}v QUALIFY id < {k})"]
    for step in range(steps):
        means = "[" + ", ".join(f"avg(v[{i}])" for i in range(1, size + 1)) + "]"
        out.append(f"{name}{step + 1} AS MATERIALIZED (SELECT o.id, coalesce(m.c, o.c) AS c FROM {name}{step} o LEFT JOIN (SELECT id, {means} AS c FROM {nearest.format(c=f'{name}{step}')} GROUP BY id) m ON m.id = o.id)")
    out.append(f"{name} AS MATERIALIZED (SELECT word_id, id FROM {nearest.format(c=f'{name}{steps}')})")
    return ", ".join(out)


@query("i2_product_quantizer", ", ".join(_lloyd(8, 10, 1 + 6 * p, 6, "abcd"[p] + "x") for p in range(4)) + " SELECT word_id, ax.id || ',' || bx.id || ',' || cx.id || ',' || dx.id AS codes FROM ax JOIN bx USING (word_id) JOIN cx USING (word_id) JOIN dx USING (word_id)", "w")
def i2p(spark, d):
    return I.product_codes(D.words(spark, d), 4, 8).select("word_id", F.array_join("codes", ",").alias("codes"))


@query("a17_kmeans", _lloyd(16, 10) + " SELECT id::INT AS cluster_id, count(*) AS n FROM a GROUP BY id", "w")
def a17(spark, d):
    w = D.words(spark, d)
    return I.assign(w, I.kmeans_centroids(w, 16)).groupBy("cluster_id").agg(F.count("*").alias("n"))


@query("u2_merge_shards", CELL + " SELECT cluster_id, count(*) AS n, sum(word_id)::BIGINT AS total FROM cell GROUP BY cluster_id", "w q")
def u2(spark, d):
    """Two shards of an index, one of even and one of odd documents, as one."""
    merged = spark.read.parquet(f"{_index(spark, d)}/index").withColumn("word_id", F.col("doc_idx") * D.PER_DOC + F.col("word_idx"))
    return merged.groupBy("cluster_id").agg(F.count("*").alias("n"), F.sum("word_id").alias("total"))


COUNTS = "c AS (SELECT doc_id AS doc_idx, len(text) AS n FROM documents)"


@query("p9_over_represented", COUNTS + " SELECT doc_idx, n FROM c WHERE n > 0.005 * (SELECT sum(n) FROM c)")
def p9(spark, d):
    hits = D.table(spark, d, "documents").select(F.col("doc_id").alias("doc_idx"), F.length("text").cast("long").alias("count"))
    return I.over_represented(hits, 0.005).withColumnRenamed("count", "n")


@query("p8_ignore_documents", "SELECT word_id, doc_idx FROM w WHERE doc_idx NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)", "w")
def p8(spark, d):
    bad = D.table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("doc_idx"))
    return I.without(D.words(spark, d), bad).select("word_id", "doc_idx")


@query("p10_remove_ids", "SELECT cluster_id, count(*) AS n FROM cell WHERE doc_idx NOT IN (SELECT doc_id FROM labels WHERE quality = 0) GROUP BY cluster_id".join([CELL + " ", ""]), "w q")
def p10(spark, d):
    w = D.words(spark, d)
    bad = D.table(spark, d, "labels").where("quality = 0").select(F.col("doc_id").alias("doc_idx"))
    return I.without(I.assign(w, I.label_centroids(w)), bad).groupBy("cluster_id").agg(F.count("*").alias("n"))


@query("a4_hit_counter", DOT + " SELECT doc_idx, count(*) AS hits FROM top5 GROUP BY doc_idx", "w q")
def a4(spark, d):
    return Q.starts_open(D.questions(spark, d), D.words(spark, d), 5).groupBy("doc_idx").agg(F.count("*").alias("hits"))


@query("a5_distinct_docs", DOT + " SELECT qid, count(DISTINCT doc_idx) AS docs FROM top5 GROUP BY qid", "w q")
def a5(spark, d):
    return Q.starts_open(D.questions(spark, d), D.words(spark, d), 5).groupBy("qid").agg(F.countDistinct("doc_idx").alias("docs"))


@query("j10_nearest_other", "o AS (SELECT a.qid, b.qid AS other, list_dot_product(a.qs, b.qs) AS score FROM q a JOIN q b ON a.qid // 25 <> b.qid // 25) SELECT qid, other, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, other) AS n FROM o) WHERE n = 1", "w q")
def j10(spark, d):
    """Each question's nearest question of another document, taken from its best len(document) + 1 questions."""
    q = D.questions(spark, d)
    pool = q.select(F.floor(F.col("qid") / D.PER_DOC).cast("long").alias("doc_idx"), F.col("qid").alias("word_idx"), F.col("q_start").alias("start"))
    near = K.score_all(q, pool, D.PER_DOC + 1).where(F.floor(F.col("qid") / D.PER_DOC) != F.col("doc_idx"))
    return K.top(near.drop("rank"), 1, ties=("word_idx",)).select("qid", F.col("word_idx").alias("other"), R6("score"))


# --- sparse ---


def _tf(spark, d):
    return P.term_counts(D.paragraphs(spark, d), ["doc_id", "par_idx"], "par_text")


def _docs(spark, d):
    return D.table(spark, d, "documents")


def _par_weights(spark, d):
    return P.document_weights(_docs(spark, d))


def _products(spark, d):
    return P.Products(D.table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text"), _docs(spark, d))


@query("a1_term_frequency", "SELECT doc_id, par_idx, term_id, tf FROM tf", "tf")
def a1(spark, d):
    return _tf(spark, d)


@query("a2_document_frequency", "SELECT term_id, nt FROM df", "df")
def a2(spark, d):
    return P.document_frequencies(_tf(spark, d))


@query("f28_tfidf_weight", "SELECT doc_id, par_idx, term_id, round(val, 6) AS val FROM tfidf", "tfidf")
def f28(spark, d):
    return _par_weights(spark, d).select("doc_id", "par_idx", "term_id", R6("val"))


@query("f29_hashed_ngrams", "SELECT item_id, term_id, tf FROM qterm", "qterm")
def f29(spark, d):
    return P.term_counts(D.table(spark, d, "benchmark"), ["item_id"], "text")


@query("s6_tfidf_fallback", "SELECT p.doc_id, p.par_idx, coalesce(term_id, 0) AS term_id, round(coalesce(val, 0), 6) AS val FROM par p LEFT JOIN tfidf t ON p.doc_id = t.doc_id AND p.par_idx = t.par_idx", "par tfidf")
def s6(spark, d):
    return P.document_weights(_docs(spark, d), fallback=True).select("doc_id", "par_idx", "term_id", R6("val"))


PAR = "ps AS (SELECT item_id, doc_id, par_idx, sum(a.val * b.val) AS score FROM qtfidf a JOIN tfidf b ON a.term_id = b.term_id WHERE a.val > 0 AND b.val > 0 GROUP BY ALL)"


@query("j5_sparse_dot", PAR + " SELECT item_id, doc_id, par_idx, round(score, 5) AS score FROM ps", "tfidf qtfidf")
def j5(spark, d):
    return _products(spark, d).pairs(True).select(F.col("qid").alias("item_id"), "doc_id", "par_idx", F.round("score", 5).alias("score"))


def _doc_weights(spark, d):
    return P.document_weights(_docs(spark, d), per_paragraph=False)


DOCW = "dtf AS (SELECT doc_id, term_id, sum(tf) AS tf FROM tf GROUP BY ALL), dw AS (SELECT doc_id, term_id, ln(1 + tf) * greatest(0, ln(((SELECT count(*) FROM documents) - nt + 0.5) / (nt + 0.5))) AS val FROM dtf JOIN df USING (term_id)), ds AS (SELECT item_id, doc_id, sum(a.val * b.val) AS score FROM qtfidf a JOIN dw b ON a.term_id = b.term_id WHERE a.val > 0 AND b.val > 0 GROUP BY ALL)"


@query("j6_question_document_product", DOCW + " SELECT item_id, doc_id, round(score, 5) AS score FROM ds", "tfidf qtfidf")
def j6(spark, d):
    return _products(spark, d).pairs(False).select(F.col("qid").alias("item_id"), "doc_id", F.round("score", 5).alias("score"))


@query("s8_sparse_lookup", "SELECT l.doc_id, count(term_id) AS terms, round(sum(val), 4) AS total FROM labels l JOIN tfidf t ON l.doc_id = t.doc_id WHERE quality = 1 GROUP BY l.doc_id", "tfidf")
def s8(spark, d):
    asked = D.table(spark, d, "labels").where("quality = 1").select("doc_id")
    return asked.join(_par_weights(spark, d), "doc_id").groupBy("doc_id").agg(F.count("term_id").alias("terms"), F.round(F.sum("val"), 4).alias("total"))


@query("s10_document_matrix", DOCW.split(", ds AS")[0] + " SELECT term_id, count(*) AS docs, round(sum(val), 4) AS total FROM dw GROUP BY term_id", "tfidf")
def s10(spark, d):
    return _doc_weights(spark, d).groupBy("term_id").agg(F.count("*").alias("docs"), F.round(F.sum("val"), 4).alias("total"))


TOKENS = "tk AS (SELECT conv_id, turn, unnest(range(len(t))) AS pos, unnest(t) AS token, 1.0 / (1 + unnest(range(len(t)))) AS weight FROM (SELECT conv_id, turn, regexp_extract_all(lower(text), '[\\pL0-9]+') AS t FROM conversations)), uq AS (SELECT conv_id AS k, turn, pos, token, weight FROM tk WHERE turn % 2 = 0), ac AS (SELECT conv_id AS k, turn, pos, token, weight FROM tk WHERE turn % 2 = 1)"


#: Weights of both sides where n tokens in a row agree.
GRAMS = TOKENS + ", ug AS (SELECT *, lead(token, 1) OVER wn AS t1, lead(token, 2) OVER wn AS t2 FROM uq WINDOW wn AS (PARTITION BY k, turn ORDER BY pos)), ag AS (SELECT *, lead(token, 1) OVER wn AS t1, lead(token, 2) OVER wn AS t2 FROM ac WINDOW wn AS (PARTITION BY k, turn ORDER BY pos)) SELECT ug.k AS conv_id, ug.turn AS q, ag.turn AS c, ag.pos, round(sum(ug.weight * ag.weight), 6) AS score FROM ug JOIN ag ON ug.k = ag.k AND ug.token = ag.token{same} GROUP BY ALL"


def _agreeing(spark, d, n):
    t = D.table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit(X.TERM), F.lit(0))).alias("pos", "token"))
    t = t.withColumn("weight", 1.0 / (1 + F.col("pos"))).withColumn("token", F.struct("conv_id", "token"))
    q = t.where("turn % 2 = 0").withColumn("qid", F.struct("conv_id", "turn"))
    c = t.where("turn % 2 = 1").withColumn("cid", F.struct("conv_id", "turn"))
    return P.ngram_matches(q, c, n).select("qid.conv_id", F.col("qid.turn").alias("q"), F.col("cid.turn").alias("c"), F.col("pos").cast("long").alias("pos"), R6("score"))


for _n, _name, _same in ((1, "f32_sparse_logits", ""), (2, "f32_sparse_bigrams", " AND ug.t1 = ag.t1"), (3, "f32_sparse_trigrams", " AND ug.t1 = ag.t1 AND ug.t2 = ag.t2")):
    query(_name, GRAMS.format(same=_same))(lambda spark, d, n=_n: _agreeing(spark, d, n))


# --- dense with sparse: questions are benchmark items, documents and paragraphs have TF-IDF scores for them ---

HYB = (
    DOCW
    + ", "
    + PAR
    + """,
dsc AS (SELECT item_id * 20 AS qid, doc_id AS doc_idx, score FROM ds),
psc AS (SELECT item_id * 20 AS qid, doc_id AS doc_idx, par_idx, score FROM ps),
al AS (SELECT qid, doc_idx, word_idx, list_dot_product(qs, s) AS score FROM q, pw),
den AS (SELECT a.qid, a.doc_idx, a.word_idx, a.score + 0.1 * coalesce(dsc.score, 0) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_idx, word_idx) AS n FROM al) a LEFT JOIN dsc ON dsc.qid = a.qid AND dsc.doc_idx = a.doc_idx WHERE n <= 100),
dt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_idx) AS n FROM dsc) WHERE n <= 50),
spa AS (SELECT al.qid, al.doc_idx, al.word_idx, al.score + 0.1 * dt.score AS score FROM al JOIN dt ON al.qid = dt.qid AND al.doc_idx = dt.doc_idx)
"""
)
TAIL = """
, mid AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_idx, word_idx) AS n FROM st) WHERE n <= 20),
fu AS (SELECT m.qid, m.doc_idx, m.word_idx, m.score + 0.1 * coalesce(p.score, 0) AS score FROM mid m JOIN pw ON pw.doc_idx = m.doc_idx AND pw.word_idx = m.word_idx LEFT JOIN psc p ON p.qid = m.qid AND p.doc_idx = m.doc_idx AND p.par_idx = pw.par_idx),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_idx, word_idx) AS rank FROM fu) WHERE rank <= 10)
"""
CUTS = {"start_top_k": 100, "mid_top_k": 20, "doc_top_k": 50}


def _sparse(spark, d, words):
    """Scores of documents and paragraphs with words, and the best documents of all."""
    return Q.sparse_scores(D.question_texts(spark, d), _docs(spark, d), words.select(F.col("doc_idx").alias("doc_id")).distinct(), CUTS["doc_top_k"])


def _hybrid(spark, d, strategy):
    w = _placed(spark, d)
    docs, pars, best = _sparse(spark, d, w)
    found = Q.hybrid_search(D.questions(spark, d), w, docs, pars, strategy, best=best, **CUTS)
    return _shown(found, w, D.titled_contexts(spark, d), presentable=True)


MARKS = " WHERE len(context) - len(replace(context, '?', '')) <= 3 AND len(context) - len(replace(context, '!', '')) <= 5"
for _name, _strategy, _union in (("q4_dense_first", "dense_first", "SELECT * FROM den"), ("q4_sparse_first", "sparse_first", "SELECT * FROM spa"), ("q4_hybrid", "hybrid", "SELECT * FROM den UNION ALL SELECT * FROM spa")):
    query(_name, HYB + f", st AS ({_union})" + TAIL + ", r AS (" + BEST.format(spans=PSPANS.format(t="o", first="o.score")) + ")," + RESULTS + "SELECT * FROM shown" + MARKS, "pw q tfidf qtfidf")(lambda spark, d, s=_strategy: _hybrid(spark, d, s))


@query("q4_closed", CLOSED.replace("JOIN w ON", "JOIN pw ON") + ", r AS (" + BEST.format(spans=PSPANS.format(t="top5", first="top5.score")) + ")," + RESULTS + "SELECT * FROM shown", "pw q")
def q4c(spark, d):
    w = _placed(spark, d)
    none = spark.createDataFrame([], "qid long, doc_idx long, par_idx long, score double")
    return _shown(Q.hybrid_search(_own(spark, d), w, none, none, out_top_k=5, scope=("doc_idx",)), w, D.titled_contexts(spark, d))


@query("j7_score_fusion", HYB + "SELECT qid, doc_idx, word_idx, round(score, 6) AS score FROM den", "pw q tfidf qtfidf")
def j7(spark, d):
    w = _placed(spark, d)
    return Q.dense_first(D.questions(spark, d), w, _sparse(spark, d, w)[0], 100, 0.1).select("qid", "doc_idx", "word_idx", R6("score"))


@query("u1_hybrid_union", HYB + ", st AS (SELECT * FROM den UNION ALL SELECT * FROM spa) SELECT qid, count(*) AS n, round(sum(score), 4) AS total FROM st GROUP BY qid", "pw q tfidf qtfidf")
def u1(spark, d):
    w, q = _placed(spark, d), D.questions(spark, d)
    docs, _, best = _sparse(spark, d, w)
    both = Q.dense_first(q, w, docs, 100, 0.1).unionByName(Q.sparse_first(q, w, best, 50, 0.1))
    return both.groupBy("qid").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("total"))


@query("w2_cascade", HYB + ", st AS (SELECT * FROM den)" + TAIL + "SELECT qid, rank, doc_idx, word_idx, round(score, 6) AS score FROM o", "pw q tfidf qtfidf")
def w2(spark, d):
    w = _placed(spark, d)
    docs, pars, _ = _sparse(spark, d, w)
    return Q.hybrid_starts(D.questions(spark, d), w, docs, pars, **CUTS).select("qid", "rank", "doc_idx", "word_idx", R6("score"))


@query("q5_batch_prediction", PLACED + ", r AS (" + BEST.format(spans=PSPANS.format(t="top5", first="list_dot_product(qs, a.s)")) + ")," + RESULTS + "SELECT qid, string_agg(answer, '|' ORDER BY score DESC, rank) AS answers FROM shown GROUP BY qid", "pw q")
def q5(spark, d):
    return Q.batch_predictions(q1(spark, d)).select("qid", F.array_join("answers", "|").alias("answers"))


@query("q5_closed_prediction", OWN_PAR + ", r AS (" + BEST.format(spans=PSPANS.format(t="top5", first="list_dot_product(qs, a.s)")) + ")," + RESULTS + "SELECT qid, string_agg(answer, '|' ORDER BY score DESC, rank) AS answers FROM shown GROUP BY qid", "pw q")
def q5p(spark, d):
    return Q.batch_predictions(q1p(spark, d)).select("qid", F.array_join("answers", "|").alias("answers"))


@query("d14_predictions", DOT + " SELECT qid, string_agg(doc_idx || '.' || word_idx, ',' ORDER BY rank) AS starts FROM top5 GROUP BY qid", "w q")
def d14(spark, d):
    t = Q.starts_open(D.questions(spark, d), D.words(spark, d), 5).withColumn("answer", F.concat("doc_idx", F.lit("."), "word_idx"))
    return Q.batch_predictions(t.withColumn("score", -F.col("rank").cast("double"))).select("qid", F.array_join("answers", ",").alias("starts"))


@query("s12_max_norm_table", "SELECT round(max(sqrt(list_dot_product(s, s))), 9) AS max_norm FROM w", "w")
def s12(spark, d):
    return I.max_norm(D.words(spark, d), 1.0).select(F.round("max_norm", 9).alias("max_norm"))
