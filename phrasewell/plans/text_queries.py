"""Queries over texts: scalar functions, evaluation, predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from phrasewell.functions import text as X
from phrasewell.operators import evaluate as E
from phrasewell.plans.registry import query
from phrasewell.sources import views as D

WS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _norm(x: str) -> str:
    plain = f"regexp_replace(lower({x}), '[!-/:-@\\[-`{{-~]', '', 'g')"
    for _ in range(2):
        plain = f"regexp_replace({plain}, '(^|[^\\pL\\pN_])(a|an|the)($|[^\\pL\\pN_])', '\\1 \\3', 'g')"
    return f"array_to_string(list_filter(regexp_split_to_array({plain}, '{WS}'), lambda t: t <> ''), ' ')"


CTX = "c AS (SELECT doc_id, replace(text, chr(10), ' [PAR] ') AS ctx FROM documents WHERE text IS NOT NULL)"
#: A span for every paragraph: from its middle, five characters, as far as it goes.
SPAN = CTX + ", sp AS (SELECT doc_id, par_idx, (sum(len(par_text) + 7) OVER (PARTITION BY doc_id ORDER BY par_idx) - len(par_text) - 7 + len(par_text) // 2)::BIGINT AS st, len(par_text) AS n FROM par), s AS (SELECT doc_id, par_idx, ctx, st, st + least(5, n - n // 2) AS en FROM sp JOIN c USING (doc_id))"


def _spans(spark, d):
    from pyspark.sql import Window

    par = D.paragraphs(spark, d).withColumn("n", F.length("par_text"))
    done = F.sum(F.col("n") + 7).over(Window.partitionBy("doc_id").orderBy("par_idx"))
    par = par.withColumn("st", (done - F.col("n") - 7 + F.floor(F.col("n") / 2)).cast("int"))
    par = par.withColumn("en", F.col("st") + F.least(F.lit(5), F.col("n") - F.floor(F.col("n") / 2)).cast("int"))
    return par.join(D.contexts(spark, d), "doc_id").select("doc_id", "par_idx", "context", "st", "en")


@query("f7_crop_paragraph", SPAN + ", l AS (SELECT *, substr(ctx, 1, st) AS a, substr(ctx, en + 1) AS b FROM s), k AS (SELECT *, CASE WHEN strpos(reverse(a), ' ]RAP[ ') = 0 THEN a ELSE right(a, strpos(reverse(a), ' ]RAP[ ') - 1) END AS la, CASE WHEN strpos(b, ' [PAR] ') = 0 THEN b ELSE left(b, strpos(b, ' [PAR] ') - 1) END AS rb FROM l) SELECT doc_id, par_idx, la || substr(ctx, st + 1, en - st) || rb AS cropped, len(la) AS start_pos, len(la) + en - st AS end_pos FROM k", "par")
def f7(spark, d):
    s = _spans(spark, d).withColumn("r", X.crop(F.col("context"), F.col("st"), F.col("en")))
    return s.select("doc_id", "par_idx", F.col("r.context").alias("cropped"), F.col("r.start").cast("long").alias("start_pos"), F.col("r.end").cast("long").alias("end_pos"))


@query("f8_paragraph_ordinal", SPAN + " SELECT doc_id, par_idx, par_idx::BIGINT AS ordinal FROM s WHERE en >= st", "par")
def f8(spark, d):
    return _spans(spark, d).select("doc_id", "par_idx", X.paragraph_ordinal(F.col("context"), F.col("st")).cast("long").alias("ordinal"))


@query("f9_split_paragraphs", CTX + ", p AS (SELECT doc_id, string_split(ctx, '[PAR]') AS ps FROM c) SELECT doc_id, unnest(range(len(ps))) AS par_idx, trim(unnest(ps), ' ') AS par FROM p")
def f9(spark, d):
    return D.contexts(spark, d).where("context is not null").select("doc_id", F.posexplode(X.paragraphs_of(F.col("context"))).alias("par_idx", "par")).withColumn("par_idx", F.col("par_idx").cast("long"))


@query("f10_answer_text", SPAN + " SELECT doc_id, par_idx, substr(ctx, st + 1, en - st) AS answer FROM s", "par")
def f10(spark, d):
    return _spans(spark, d).select("doc_id", "par_idx", X.between(F.col("context"), F.col("st"), F.col("en")).alias("answer"))


@query("f11_end_fallback", "SELECT doc_id, par_idx, st, CASE WHEN par_idx % 2 = 0 THEN en ELSE st + 1 END AS en FROM s".join([SPAN + " ", ""]), "par")
def f11(spark, d):
    s = _spans(spark, d)
    return s.select("doc_id", "par_idx", F.col("st").cast("long").alias("st"), X.end_or_next(F.col("st"), F.when(F.col("par_idx") % 2 == 0, F.col("en"))).cast("long").alias("en"))


@query("f12_filter_results", "SELECT doc_id FROM documents WHERE len(text) - len(replace(text, '?', '')) <= 3 AND len(text) - len(replace(text, '!', '')) <= 5")
def f12(spark, d):
    return D.table(spark, d, "documents").where(X.presentable(F.col("text"))).select("doc_id")


@query("f13_interval_overlap", SPAN + " SELECT a.doc_id, a.par_idx AS p1, b.par_idx AS p2 FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.par_idx < b.par_idx AND a.st <= b.en + 60 AND b.st - 60 <= a.en", "par")
def f13(spark, d):
    s = _spans(spark, d).select("doc_id", "par_idx", "st", "en")
    a, b = s.alias("a"), s.alias("b")
    near = X.overlaps(F.col("a.st"), F.col("a.en"), F.col("b.st") - 60, F.col("b.en") + 60)
    return a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.par_idx") < F.col("b.par_idx")) & near).select("a.doc_id", F.col("a.par_idx").alias("p1"), F.col("b.par_idx").alias("p2"))


@query("f14_normalize_answer", f"SELECT conv_id, turn, {_norm('text')} AS norm FROM conversations")
def f14(spark, d):
    return D.table(spark, d, "conversations").select("conv_id", "turn", X.normalize_answer(F.col("text")).alias("norm"))


SCORED = f"""
n AS (SELECT qid, pred, {_norm('truth')} AS t, {_norm("coalesce(pred, '')")} AS p FROM pred),
tt AS (SELECT qid, w, count(*) AS c FROM (SELECT qid, unnest(string_split(t, ' ')) AS w FROM n WHERE t <> '') GROUP BY ALL),
pt AS (SELECT qid, w, count(*) AS c FROM (SELECT qid, unnest(string_split(p, ' ')) AS w FROM n WHERE p <> '') GROUP BY ALL),
o AS (SELECT tt.qid, sum(least(tt.c, pt.c)) AS o FROM tt JOIN pt ON tt.qid = pt.qid AND tt.w = pt.w GROUP BY tt.qid),
sc AS (SELECT n.qid, pred IS NOT NULL AND t = p AS em, CASE WHEN pred IS NULL OR coalesce(o, 0) = 0 THEN 0.0 ELSE 2.0 * o / (len(string_split(t, ' ')) + len(string_split(p, ' '))) END::DOUBLE AS f1 FROM n LEFT JOIN o ON n.qid = o.qid)
"""


def _scored(spark, d):
    return E.scores(D.predictions(spark, d), ["qid"])


@query("f15_f1_score", SCORED + "SELECT qid, round(f1, 6) AS f1 FROM sc", "pred")
def f15(spark, d):
    return _scored(spark, d).select("qid", F.round("f1", 6).alias("f1"))


@query("f16_exact_match", SCORED + "SELECT qid, em FROM sc", "pred")
def f16(spark, d):
    return _scored(spark, d).select("qid", "em")


@query("a7_bag_intersection", SCORED + "SELECT n.qid, coalesce(o, 0)::BIGINT AS overlap FROM n LEFT JOIN o ON n.qid = o.qid", "pred")
def a7(spark, d):
    p = D.predictions(spark, d).withColumns({"a": X.white_tokens(X.normalize_answer(F.coalesce("pred", F.lit("")))), "b": X.white_tokens(X.normalize_answer(F.col("truth")))})
    return E.bag_overlap(p, "a", "b", ["qid"]).select("qid", F.col("overlap").cast("long").alias("overlap"))


@query("a6_best_over_truths", SCORED + "SELECT split_part(qid, '-', 1) AS conv, max(em) AS em, round(max(f1), 6) AS f1 FROM sc GROUP BY 1", "pred")
def a6(spark, d):
    s = _scored(spark, d).withColumn("conv", F.split_part("qid", F.lit("-"), F.lit(1)))
    return E.best_over_truths(s, ["conv"]).select("conv", "em", F.round("f1", 6).alias("f1"))


@query("a8_mean_scores", SCORED + "SELECT round(100.0 * avg(em::INT), 6) AS exact_match, round(100.0 * avg(f1), 6) AS f1, count(*) AS total FROM sc", "pred")
def a8(spark, d):
    return E.report(_scored(spark, d)).select(F.round("exact_match", 6).alias("exact_match"), F.round("f1", 6).alias("f1"), "total")


@query("j11_predictions_truths", "SELECT qid, pred IS NOT NULL AS answered, len(truth) AS n FROM pred", "pred")
def j11(spark, d):
    return D.predictions(spark, d).select("qid", F.col("pred").isNotNull().alias("answered"), F.length("truth").cast("long").alias("n"))


#: Ranked answers: the assistant's turns of a conversation in order; a hit shares more than a tenth of its tokens with the first user turn.
RANKED = f"""
u AS (SELECT conv_id, {_norm('arg_min(text, turn)')} AS t FROM conversations WHERE role = 'user' GROUP BY conv_id),
a AS (SELECT conv_id AS qid, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank, {_norm('text')} AS p FROM conversations WHERE role = 'assistant'),
b AS (SELECT qid, rank, t, p FROM a JOIN u ON qid = conv_id),
xt AS (SELECT qid, rank, w, count(*) AS c FROM (SELECT qid, rank, unnest(string_split(t, ' ')) AS w FROM b WHERE t <> '') GROUP BY ALL),
xp AS (SELECT qid, rank, w, count(*) AS c FROM (SELECT qid, rank, unnest(string_split(p, ' ')) AS w FROM b WHERE p <> '') GROUP BY ALL),
xo AS (SELECT xt.qid, xt.rank, sum(least(xt.c, xp.c)) AS o FROM xt JOIN xp ON xt.qid = xp.qid AND xt.rank = xp.rank AND xt.w = xp.w GROUP BY ALL),
r AS (SELECT qid, rank, f1 > 0.1 AS em, f1 FROM (SELECT b.qid, b.rank, CASE WHEN coalesce(o, 0) = 0 THEN 0.0 ELSE 2.0 * o / (len(string_split(t, ' ')) + len(string_split(p, ' '))) END::DOUBLE AS f1 FROM b LEFT JOIN xo ON b.qid = xo.qid AND b.rank = xo.rank)),
fh AS (SELECT qid, coalesce(min(rank) FILTER (em), 1e9)::DOUBLE AS rank FROM r GROUP BY qid)
"""


def _ranked(spark, d):
    from pyspark.sql import Window

    t = D.table(spark, d, "conversations")
    asked = t.where("role = 'user'").groupBy(F.col("conv_id").alias("qid")).agg(F.min_by("text", "turn").alias("truth"))
    told = t.where("role = 'assistant'").select(F.col("conv_id").alias("qid"), F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("rank"), F.col("text").alias("pred"))
    return E.scores(told.join(asked, "qid"), ["qid", "rank"]).withColumn("em", F.col("f1") > 0.1)


@query("a9_first_hit_rank", RANKED + "SELECT qid, rank FROM fh")
def a9(spark, d):
    return E.first_hits(_ranked(spark, d))


@query("a10_recall_at_k", RANKED + "SELECT k::INT AS k, round((SELECT avg((rank <= k)::INT) FROM fh), 6) AS recall FROM range(1, 11) t(k)")
def a10(spark, d):
    return E.recall_at(E.first_hits(_ranked(spark, d)), 10).select("k", F.round("recall", 6).alias("recall"))


@query("a11_scores_at_k", RANKED + ", g AS (SELECT k, qid, max(em::INT) AS em, max(f1) AS f1 FROM r, range(1, 11) t(k) WHERE rank <= k GROUP BY ALL) SELECT k::INT AS k, round(avg(em), 6) AS exact_match, round(avg(f1), 6) AS f1 FROM g GROUP BY k")
def a11(spark, d):
    return E.at_k(_ranked(spark, d), 1, 10).select("k", F.round("exact_match", 6).alias("exact_match"), F.round("f1", 6).alias("f1"))


CW = r"[ \t\r\n\x{202F}]+"


@query("f17_context_words", f"SELECT doc_id, unnest(range(len(t))) AS i, unnest(t) AS word FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '{CW}'), lambda x: x <> '') AS t FROM documents)")
def f17(spark, d):
    return D.table(spark, d, "documents").select("doc_id", F.posexplode(X.context_words(F.col("text"))).alias("i", "word")).withColumn("i", F.col("i").cast("long"))


@query("f21_character_classes", r"SELECT ch, count(*) AS n, CASE WHEN regexp_matches(ch, '^[ \t\n\r]$|^\p{Zs}$') THEN 'space' WHEN regexp_matches(ch, '^\p{C}$') THEN 'control' WHEN regexp_matches(ch, '^[!-/:-@\[-`{-~]$|^\p{P}$') THEN 'punctuation' WHEN regexp_matches(ch, '^\p{Han}$') THEN 'cjk' ELSE 'other' END AS class FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY ch")
def f21(spark, d):
    ch = D.table(spark, d, "documents").select(F.explode(F.split("text", "")).alias("ch")).where("ch <> ''")
    return ch.groupBy("ch").agg(F.count("*").alias("n")).withColumn("class", X.classes(F.col("ch")))


@query("f27_titles", "SELECT doc_id, lower(replace(source || '_' || lang, '_', ' ')) AS spaced, lower(regexp_replace(source || ' ' || lang, '\\s+', '_', 'g')) AS joined FROM documents")
def f27(spark, d):
    return D.table(spark, d, "documents").select("doc_id", X.title_spaced(F.concat("source", F.lit("_"), "lang")).alias("spaced"), X.title_joined(F.concat("source", F.lit(" "), "lang")).alias("joined"))


@query("f31_highlight", SPAN + " SELECT doc_id, par_idx, substr(ctx, 1, st) || '<em>' || substr(ctx, st + 1, en - st) || '</em>' || substr(ctx, en + 1) AS html FROM s", "par")
def f31(spark, d):
    return _spans(spark, d).select("doc_id", "par_idx", X.highlight(F.col("context"), F.col("st"), F.col("en")).alias("html"))


@query("f35_white_tokens", f"SELECT conv_id, turn, array_to_string(list_filter(regexp_split_to_array(text, '{WS}'), lambda t: t <> ''), '|') AS tokens FROM conversations")
def f35(spark, d):
    return D.table(spark, d, "conversations").select("conv_id", "turn", F.array_join(X.white_tokens(F.col("text")), "|").alias("tokens"))


@query("f24_pad_ids", "ids AS (SELECT item_id, list_transform(regexp_extract_all(lower(text), '[\\pL0-9]+'), lambda t: ('0x' || substr(md5(t), 1, 6))::BIGINT) AS v FROM benchmark) SELECT item_id, array_to_string(list_concat(v[1:64], list_transform(range(greatest(0, 64 - len(v))), lambda i: 0)), ',') AS ids, least(64, len(v))::BIGINT AS used FROM ids")
def f24(spark, d):
    ids = F.transform(F.regexp_extract_all(F.lower("text"), F.lit(X.TERM), F.lit(0)), X.term_id)
    t = D.table(spark, d, "benchmark").select("item_id", ids.alias("v"))
    used = F.aggregate(X.mask(F.col("v"), 64), F.lit(0).cast("long"), lambda s, x: s + x)
    return t.select("item_id", F.array_join(X.padded(F.col("v"), 64), ",").alias("ids"), used.alias("used"))
