"""Queries for corpus preparation, sources, sinks, samples and tokenisers."""

from __future__ import annotations

from pyspark.sql import functions as F

from phrasewell.functions import text as X
from phrasewell.functions import tokenize as T
from phrasewell.functions import vectors as V
from phrasewell.operators import corpus as C
from phrasewell.operators import evaluate as E
from phrasewell.operators import index as I
from phrasewell.operators import spans as S
from phrasewell.plans import search_queries as SQ
from phrasewell.plans.registry import query
from phrasewell.plans.text_queries import WS, _norm
from phrasewell.sources import io as IO
from phrasewell.sources import views as D

SHARE = "(('0x' || substr(md5({seed} || {key}::VARCHAR), 1, 8))::BIGINT / 4294967296.0)"


def _share(key: str, seed: str = "29") -> str:
    return SHARE.format(seed=f"'{seed}'", key=key)


def _docs(spark, d):
    return D.table(spark, d, "documents")


def _corpus(spark, d):
    """The documents as one corpus: an article each, a paragraph a line, a question for each paragraph: its first word."""
    pars = F.transform(
        F.split("text", "\n"),
        lambda p, i: F.struct(
            p.alias("context"),
            F.array(F.struct(F.concat(F.col("doc_id").cast("string"), F.lit("-"), i.cast("string")).alias("id"), F.split(p, " ")[0].alias("question"), F.array(F.struct(F.element_at(F.split(p, " "), -1).alias("text"), (F.length(p) - F.length(F.element_at(F.split(p, " "), -1))).alias("answer_start"))).alias("answers"))).alias("qas"),
        ),
    )
    return _docs(spark, d).where("text is not null").select("doc_id", F.array(F.struct(F.col("source").alias("title"), pars.alias("paragraphs"))).alias("data"))


@query("s1_examples", "SELECT doc_id || '-' || par_idx AS qas_id, doc_id, par_idx, string_split(par_text, ' ')[1] AS question, len(par_text) AS n FROM par", "par")
def s1(spark, d):
    e = IO.flatten_examples(_corpus(spark, d))
    return e.select("qas_id", F.split_part("qas_id", F.lit("-"), F.lit(1)).cast("long").alias("doc_id"), "par_idx", "question", F.length("context").cast("long").alias("n"))


@query("s1_contexts", "SELECT source AS title, par_idx, par_text AS context FROM par JOIN documents USING (doc_id)", "par")
def s1c(spark, d):
    return IO.flatten_examples(_corpus(spark, d), context_only=True).select("title", "par_idx", "context")


@query("s2_answer_alignment", "t AS (SELECT doc_id, par_idx, list_filter(string_split(par_text, ' '), lambda x: x <> '') AS w, split_part(par_text, ' ', -1) AS a FROM par) SELECT doc_id, par_idx, CASE WHEN a = '' THEN len(w) - 1 ELSE len(w) - 1 END AS start_word, a AS answer FROM t WHERE contains(array_to_string(w, ' '), a)", "par")
def s2(spark, d):
    e = IO.flatten_examples(_corpus(spark, d)).select("qas_id", "par_idx", "context", F.explode("answers").alias("a"))
    e = e.where(F.contains(F.array_join(X.context_words(F.col("context")), " "), F.col("a.text")))
    start = X.word_index(F.col("context"), F.col("a.answer_start"))
    return e.select(F.split_part("qas_id", F.lit("-"), F.lit(1)).cast("long").alias("doc_id"), "par_idx", start.cast("long").alias("start_word"), F.col("a.text").alias("answer"))


@query("s3_file_ranges", "SELECT lpad((doc_id // 100)::VARCHAR, 4, '0') AS file, count(*) AS paragraphs, min(doc_id) AS first, sum(len(par_text))::BIGINT AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS par_text FROM documents WHERE text IS NOT NULL AND doc_id // 100 >= 1 AND doc_id // 100 < 7) GROUP BY 1")
def s3(spark, d):
    """Documents as numbered corpus files of 100, and files 1 to 6 of them read back."""
    folder = IO.scratch(spark)
    pars = F.transform(F.split("text", "\n"), lambda p: F.struct(p.alias("context"), F.lit(None).cast(f"array<{IO.QUESTION}>").alias("qas")))
    articles = _docs(spark, d).where("text is not null").select(F.col("doc_id").alias("doc_idx"), F.struct(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("title"), pars.alias("paragraphs")).alias("article"))
    IO.write_corpus_files(articles, folder, 100)
    back = IO.read_file_range(spark, folder, 1, 7, 100).withColumn("doc_id", F.substring("title", 2, 20).cast("long"))
    file = C.shard_name(F.floor(F.col("doc_idx") / 100))
    return back.groupBy(file.alias("file")).agg(F.count("*").alias("paragraphs"), F.min("doc_id").alias("first"), F.sum(F.length("context")).alias("n"))


@query("s3_resume", "SELECT DISTINCT doc_id // 100 AS file FROM documents WHERE doc_id // 100 NOT IN (SELECT doc_id // 100 FROM labels WHERE quality = 0)")
def s3r(spark, d):
    files = _docs(spark, d).select(F.floor(F.col("doc_id") / 100).cast("long").alias("file")).distinct()
    return IO.resume_after(files, D.table(spark, d, "labels").where("quality = 0").select(F.col("doc_id").alias("doc_idx")), 100)


@query("s4_phrase_dump", "SELECT doc_idx, count(*) AS n, min(word_id) AS first FROM w WHERE doc_idx % 3 <> 1 OR word_idx >= 10 GROUP BY doc_idx", "w")
def s4(spark, d):
    """Documents written, a third of them replaced by fewer words, and nothing changed by what is skipped."""
    path, w = IO.scratch(spark), D.words(spark, d)
    IO.write_phrase_dump(w, path, per_bucket=4)
    IO.write_phrase_dump(w.where("doc_idx % 3 = 1 and word_idx >= 10"), path, per_bucket=4)
    IO.write_phrase_dump(w.where("doc_idx % 2 = 0"), path, "skip", per_bucket=4)
    return IO.read_phrase_dump(spark, path).groupBy("doc_idx").agg(F.count("*").alias("n"), F.min("word_id").alias("first"))


@query("s4_paragraph_dump", "SELECT doc_idx, par_idx, count(*) AS n, min(word_id) AS first FROM pw WHERE par_idx % 2 = 1 OR word_idx < 12 GROUP BY ALL", "pw")
def s4p(spark, d):
    """Paragraph by paragraph: what is there is skipped."""
    path, w = IO.scratch(spark), D.placed_words(spark, d).withColumn("par_idx", F.col("par_idx").cast("long"))
    unit = ("doc_idx", "par_idx")
    IO.write_phrase_dump(w.where("par_idx % 2 = 0 and word_idx < 12"), path, unit=unit)
    gone = w.where("par_idx % 2 = 0 and word_idx >= 12").join(w.where("word_idx < 12").select(*unit).distinct(), list(unit), "left_anti")
    IO.write_phrase_dump(w.join(gone.select(*unit).distinct(), list(unit), "left_anti"), path, "skip", unit=unit)
    return IO.read_phrase_dump(spark, path).groupBy(*unit).agg(F.count("*").alias("n"), F.min("word_id").alias("first"))


@query("s15_dump_files", "SELECT count(*) AS broken FROM documents WHERE false")
def s15f(spark, d):
    """Every file of a dump is opened."""
    path = IO.scratch(spark)
    IO.write_phrase_dump(D.words(spark, d), path, per_bucket=4)
    return IO.unreadable_files(spark, path).groupBy().agg(F.count("*").alias("broken"))


@query("s5_question_vectors", "SELECT qid, len(qs) + len(qe) + 1 AS size, round(list_sum(qs) + list_sum(qe) + qp, 6) AS total FROM q", "q")
def s5(spark, d):
    dump = IO.question_dump(D.questions(spark, d))
    return dump.select("qid", F.size("data").cast("long").alias("size"), F.round(F.aggregate("data", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("s7_dump_lookup", "SELECT l.doc_id AS doc_idx, count(word_id) AS n FROM labels l JOIN w ON w.doc_idx = l.doc_id WHERE toxic = 1 GROUP BY 1", "w")
def s7(spark, d):
    asked = D.table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("doc_idx"))
    return IO.lookup(D.words(spark, d), asked)[0].groupBy("doc_idx").agg(F.count("word_id").alias("n"))


@query("s7_missing_documents", "SELECT doc_id AS doc_idx FROM labels WHERE toxic = 1 AND doc_id NOT IN (SELECT doc_idx FROM w)", "w")
def s7m(spark, d):
    asked = D.table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("doc_idx"))
    return IO.lookup(D.words(spark, d), asked)[1]


@query("s9_question_lookup", "SELECT item_id, qid, round(qp, 6) AS span FROM benchmark JOIN q ON qid = item_id * 20", "q")
def s9(spark, d):
    asked = D.table(spark, d, "benchmark").select("item_id", (F.col("item_id") * 20).alias("qid"))
    return asked.join(D.questions(spark, d), "qid").select("item_id", "qid", F.round("q_span", 6).alias("span"))


@query("s11_json_sink", "SELECT label, count(*) AS n FROM w GROUP BY label", "w")
def s11(spark, d):
    path = IO.scratch(spark)
    IO.write_json(D.words(spark, d).groupBy("label").agg(F.count("*").alias("n")), path)
    return spark.read.schema("label int, n long").json(path)


@query("s13_answers", SQ.DOT + " " + SQ.BEST.format(spans=SQ.SPANS.format(t="top5", first="list_dot_product(qs, a.s)")), "w q")
def s13(spark, d):
    return IO.answer(spark, D.questions(spark, d), D.words(spark, d)).select("qid", "rank", "doc_idx", "i", "j", F.round("score", 6).alias("score"))


@query("s14_vocabulary", "v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\pL0-9]+')) AS token FROM benchmark) SELECT token, row_number() OVER (ORDER BY token) - 1 AS id FROM v")
def s14(spark, d):
    tokens = D.table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(X.TERM), F.lit(0))).alias("token")).distinct()
    path = IO.scratch(spark)
    IO.write_vocabulary(tokens, path)
    return IO.read_vocabulary(spark, path)


@query("f23_token_ids", "v AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS id FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\pL0-9]+')) AS token FROM benchmark)), t AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[\\pL0-9]+')) AS token FROM conversations) SELECT conv_id, turn, count(*) AS n, count(*) FILTER (id IS NULL) AS unknown, coalesce(sum(id), 0)::BIGINT AS total FROM t LEFT JOIN v USING (token) GROUP BY ALL")
def f23(spark, d):
    vocab = s14(spark, d)
    t = D.table(spark, d, "conversations").select("conv_id", "turn", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(X.TERM), F.lit(0))).alias("token"))
    return t.join(vocab, "token", "left").groupBy("conv_id", "turn").agg(F.count("*").alias("n"), F.count_if(F.col("id").isNull()).alias("unknown"), F.coalesce(F.sum("id"), F.lit(0)).alias("total"))


@query("s15_range_gaps", "r AS (SELECT min(doc_id) AS s, max(doc_id) + 1 AS e FROM labels GROUP BY doc_id // 10 UNION ALL SELECT 100000, 100000), g AS (SELECT s, e, coalesce(lag(e) OVER (ORDER BY s, e), 0) AS expected FROM r) SELECT s AS start_doc, expected FROM g WHERE expected <> s")
def s15(spark, d):
    r = D.table(spark, d, "labels").groupBy(F.floor(F.col("doc_id") / 10)).agg(F.min("doc_id").alias("start"), (F.max("doc_id") + 1).alias("end"))
    return C.gaps(r, 0, 100_000).select(F.col("start").alias("start_doc"), "expected")


WIN = "t AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \\t\\r\\n\\x{202F}]+'), lambda x: x <> '')) AS n FROM documents), wi AS (SELECT doc_id, n, unnest(range(CASE WHEN n = 0 THEN 0 ELSE greatest(0, ceil((n - 382) / 128.0))::INT + 1 END)) AS k FROM t)"


#: Windows of the queries below.
WINDOW, STRIDE = 382, 128


def _windows(spark, d):
    n = F.size(X.context_words(F.col("text")))
    return _docs(spark, d).where("text is not null").select("doc_id", X.let(n, lambda n: C.token_windows(n, WINDOW, STRIDE)).alias("w"))


@query("w4_token_windows", WIN + " SELECT doc_id, k * 128 AS start_tok, least(382, n - k * 128) AS length FROM wi")
def w4(spark, d):
    return _windows(spark, d).select("doc_id", F.explode("w").alias("w")).select("doc_id", F.col("w.start").cast("long").alias("start_tok"), F.col("w.length").cast("long").alias("length"))


@query("w5_max_context", WIN + ", x AS (SELECT doc_id, i, k, least(i - k * 128, k * 128 + least(382, n - k * 128) - 1 - i) + 0.01 * least(382, n - k * 128) AS s FROM (SELECT doc_id, n, k, unnest(range(k * 128, k * 128 + least(382, n - k * 128))) AS i FROM wi)), b AS (SELECT doc_id, i, k FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, i ORDER BY s DESC, k) AS r FROM x) WHERE r = 1) SELECT doc_id, k::BIGINT AS window_idx, count(*) AS tokens FROM b GROUP BY ALL")
def w5(spark, d):
    n = F.size(X.context_words(F.col("text")))
    t = _docs(spark, d).where("text is not null").select("doc_id", n.alias("n")).where("n > 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return t.groupBy("doc_id", C.best_window(F.col("i"), F.col("n"), WINDOW, STRIDE).cast("long").alias("window_idx")).agg(F.count("*").alias("tokens"))


@query("w7_merge_paragraphs", "RECURSIVE o AS (SELECT doc_id, par_text, row_number() OVER (PARTITION BY doc_id ORDER BY par_idx) AS r FROM par WHERE len(par_text) < 2000), m AS (SELECT doc_id, r, ' ' || par_text AS cur, len(par_text) + 1 >= 500 AS done FROM o WHERE r = 1 UNION ALL SELECT o.doc_id, o.r, CASE WHEN m.done THEN ' ' || o.par_text ELSE m.cur || ' ' || o.par_text END, len(CASE WHEN m.done THEN ' ' || o.par_text ELSE m.cur || ' ' || o.par_text END) >= 500 FROM m JOIN o ON o.doc_id = m.doc_id AND o.r = m.r + 1) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY r) - 1 AS out_idx, len(cur) AS n, md5(cur) AS h FROM m WHERE done", "par")
def w7(spark, d):
    out = C.merge_paragraphs(D.paragraphs(spark, d), 500, 2000)
    return out.select("doc_id", F.col("out_idx").cast("long").alias("out_idx"), F.length("merged").cast("long").alias("n"), F.md5(F.col("merged").cast("binary")).alias("h"))


@query("p4_length_filter", "SELECT doc_id, par_idx FROM par WHERE len(par_text) >= 500 AND len(par_text) < 2000", "par")
def p4(spark, d):
    return D.paragraphs(spark, d).where(C.length_between(F.col("par_text"), 500, 2000)).select("doc_id", "par_idx")


@query("p5_allow_or_sample", f"SELECT doc_id, source FROM documents WHERE source IN (SELECT DISTINCT source FROM documents WHERE doc_id % 7 = 0 AND lang = 'es') OR {_share('source')} < 0.3")
def p5(spark, d):
    docs = _docs(spark, d)
    return C.allow_or_sample(docs, docs.where("doc_id % 7 = 0 and lang = 'es'"), "source", 0.3).select("doc_id", "source")


@query("p6_sample_questions", f"SELECT item_id FROM benchmark WHERE {_share('item_id')} < 0.5")
def p6(spark, d):
    return C.sample(D.table(spark, d, "benchmark"), "item_id", 0.5).select("item_id")


@query("p7_two_stage_sample", f"dd AS (SELECT DISTINCT doc_idx, doc_idx // 10 AS g FROM w), pick AS (SELECT doc_idx FROM (SELECT doc_idx, count(*) OVER (PARTITION BY g) AS n, row_number() OVER (PARTITION BY g ORDER BY {_share('doc_idx')}, doc_idx) AS r FROM dd) WHERE r <= floor(n * 0.3)), sz AS (SELECT doc_idx, count(*) AS m FROM w JOIN pick USING (doc_idx) GROUP BY doc_idx), dr AS (SELECT doc_idx, m, unnest(range(1, floor(m * 0.2)::INT + 1)) AS draw FROM sz), pos AS (SELECT doc_idx, draw, floor({SHARE.format(seed=chr(39) + '29' + chr(39), key='(doc_idx || chr(58) || draw)')} * m)::BIGINT AS pos FROM dr), nu AS (SELECT *, row_number() OVER (PARTITION BY doc_idx ORDER BY word_idx) - 1 AS pos FROM w) SELECT word_id, draw FROM nu JOIN pos ON nu.doc_idx = pos.doc_idx AND nu.pos = pos.pos", "w")
def p7(spark, d):
    return C.two_stage_sample(D.words(spark, d), 0.3, 0.2, F.floor(F.col("doc_idx") / 10)).select("word_id", F.col("draw").cast("long").alias("draw"))


DUMMY = "k AS (SELECT item_id, text, item_id % 2 = 0 AS first FROM benchmark) SELECT item_id, doc_idx, len(text) AS n FROM (SELECT item_id, CASE WHEN first THEN 0 ELSE 1 END AS doc_idx, 'dummy text' AS text FROM k UNION ALL SELECT item_id, CASE WHEN first THEN 1 ELSE 0 END, text FROM k)"


@query("p11_dummy_article", DUMMY)
def p11(spark, d):
    """A made-up article before every even item and after every odd one."""
    return C.with_dummy(D.table(spark, d, "benchmark"), "item_id", "text", F.lit("dummy text"), F.col("item_id") % 2 == 0).select("item_id", "doc_idx", F.length("text").cast("long").alias("n"))


@query("p11_random_draws", f"k AS (SELECT item_id, row_number() OVER (ORDER BY {_share('item_id')}, item_id) - 1 AS place, count(*) OVER () AS n FROM benchmark), dr AS (SELECT unnest(range(1, 21)) AS draw) SELECT draw, item_id FROM dr JOIN k ON place = floor({_share('draw')} * n)::BIGINT")
def p11r(spark, d):
    return C.draws(D.table(spark, d, "benchmark"), 20, "item_id").select("draw", "item_id")


@query("p12_draft", "SELECT item_id FROM benchmark ORDER BY item_id LIMIT 3")
def p12(spark, d):
    return D.table(spark, d, "benchmark").orderBy("item_id").limit(3).select("item_id")


@query("a13_title_coverage", "SELECT count(DISTINCT source) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS covered, count(DISTINCT source) AS total FROM documents")
def a13(spark, d):
    docs = _docs(spark, d)
    own = docs.join(D.table(spark, d, "labels").select("doc_id").distinct(), "doc_id", "left_semi").agg(F.countDistinct("source").alias("covered"))
    return own.crossJoin(docs.agg(F.countDistinct("source").alias("total")))


@query("a16_regroup_windows", "SELECT doc_id, md5(replace(text, chr(10), ' [PAR] ')) AS h FROM documents WHERE text IS NOT NULL")
def a16(spark, d):
    return C.regroup(D.paragraphs(spark, d)).select("doc_id", F.md5(F.col("context").cast("binary")).alias("h"))


WINDOWED = (
    "pb AS (SELECT doc_id, par_idx, par_text, coalesce(sum(len(par_text) + 7) OVER (PARTITION BY doc_id ORDER BY par_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM par), "
    "pw0 AS (SELECT doc_id, par_idx, base, regexp_extract_all(par_text, '[^ \\t\\r\\n\\x{202F}]+') AS ws, list_transform(regexp_split_to_array(par_text, '[^ \\t\\r\\n\\x{202F}]+'), lambda g: len(g)) AS gs FROM pb), "
    "pt AS (SELECT doc_id, par_idx, base, len(ws) AS n, unnest(range(len(ws))) AS i, unnest(ws) AS word, unnest(gs[1:len(ws)]) AS gap FROM pw0), "
    "pc AS (SELECT doc_id, par_idx, n, i, len(word) AS l, base + sum(gap + len(word)) OVER (PARTITION BY doc_id, par_idx ORDER BY i) AS e FROM pt), "
    "pk AS (SELECT *, unnest(range(greatest(0, ceil((n - 382) / 128.0))::BIGINT + 1)) AS k FROM pc), "
    "pp AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY par_idx, k, i) - 1 AS pos FROM pk WHERE i >= k * 128 AND i < k * 128 + 382)"
)


@query("a16_window_words", WINDOWED + " SELECT doc_id, par_idx, k AS window_idx, count(*) AS n, min(pos) AS first, sum(e - l)::BIGINT AS starts, sum(e)::BIGINT AS ends FROM pp GROUP BY ALL", "par")
def a16w(spark, d):
    words = C.regroup_windows(D.paragraphs(spark, d), WINDOW, STRIDE)
    return words.groupBy("doc_id", "par_idx", F.col("window_idx").cast("long").alias("window_idx")).agg(F.count("*").alias("n"), F.min("word_pos").alias("first"), F.sum("char_start").alias("starts"), F.sum("char_end").alias("ends"))


@query("j8_results_to_examples", "SELECT item_id, doc_id, lang, len(d.text) AS n FROM benchmark b JOIN documents d ON d.doc_id = b.item_id")
def j8(spark, d):
    return D.table(spark, d, "benchmark").select("item_id").join(_docs(spark, d), F.col("item_id") == F.col("doc_id")).select("item_id", "doc_id", "lang", F.length("text").cast("long").alias("n"))


@query("j12_title_membership", "SELECT doc_id FROM documents WHERE source IN (SELECT source FROM documents JOIN labels USING (doc_id) WHERE quality = 0)")
def j12(spark, d):
    docs = _docs(spark, d)
    bad = docs.join(D.table(spark, d, "labels").where("quality = 0").select("doc_id"), "doc_id").select("source")
    return docs.join(bad, "source", "left_semi").select("doc_id")


@query("u3_append_articles", "SELECT src, count(*) AS n FROM (SELECT 'documents' AS src FROM documents UNION ALL SELECT 'pages' FROM pages) GROUP BY src")
def u3(spark, d):
    both = _docs(spark, d).select(F.lit("documents").alias("src")).unionByName(D.table(spark, d, "pages").select(F.lit("pages").alias("src")))
    return both.groupBy("src").agg(F.count("*").alias("n"))


@query("w8_shards", f"SELECT doc_id, (row_number() OVER (ORDER BY {_share('doc_id')}, doc_id) - 1) // 100 AS shard FROM documents")
def w8(spark, d):
    return C.shards(_docs(spark, d).select("doc_id"), 100, "doc_id").select("doc_id", "shard")


@query("f26_answer_span", "s AS (SELECT doc_id, par_idx, list_filter(regexp_split_to_array(par_text, '[ \\t\\r\\n\\x{202F}]+'), lambda x: x <> '') AS w FROM par), m AS (SELECT doc_id, par_idx, w, w[len(w) // 2 + 1] AS a FROM s WHERE len(w) >= 1) SELECT doc_id, par_idx, (list_position(w, a) - 1)::BIGINT AS start_word, (list_position(w, a) - 1)::BIGINT AS end_word FROM m", "par")
def f26(spark, d):
    """Where a paragraph's middle word stands in it for the first time."""
    p = D.paragraphs(spark, d).select("doc_id", "par_idx", X.context_words(F.col("par_text")).alias("w")).where(F.size("w") >= 1)
    p = p.withColumn("a", F.element_at("w", (F.floor(F.size("w") / 2) + 1).cast("int")))
    span = X.let(F.col("w"), lambda w: X.answer_span(w, F.lit(0), F.size(w) - 1, F.array(F.col("a"))))
    return p.select("doc_id", "par_idx", span.alias("s")).select("doc_id", "par_idx", F.col("s.start").cast("long").alias("start_word"), F.col("s.end").cast("long").alias("end_word"))


@query("f26_tighter_span", "s AS (SELECT item_id, regexp_extract_all(lower(text), '[\\pL0-9]+') AS w FROM benchmark), m AS (SELECT item_id, w, w[len(w) // 2 + 1:len(w) // 2 + 3] AS a FROM s WHERE len(w) >= 5), c AS (SELECT item_id, w, a, unnest(range(len(w) - len(a) + 1)) AS i FROM m) SELECT item_id, min(i)::BIGINT AS start_word, (min(i) + any_value(len(a)) - 1)::BIGINT AS end_word FROM c WHERE w[i + 1:i + len(a)] = a GROUP BY item_id")
def f26t(spark, d):
    """The tokens of three words in the middle of an item, looked for in all of it."""
    t = D.table(spark, d, "benchmark").select("item_id", F.regexp_extract_all(F.lower("text"), F.lit(X.TERM), F.lit(0)).alias("w")).where(F.size("w") >= 5)
    t = t.withColumn("a", F.slice("w", (F.floor(F.size("w") / 2) + 1).cast("int"), 3))
    return t.select("item_id", X.answer_span(F.col("w"), F.lit(0), F.size("w") - 1, F.col("a")).alias("s")).select("item_id", F.col("s.start").cast("long").alias("start_word"), F.col("s.end").cast("long").alias("end_word"))


@query("f33_random_margins", f"SELECT doc_id, substr(text, greatest(0, 10 - floor({SHARE.format(seed=chr(39) + '29' + chr(39), key='(doc_id || chr(108))')} * 8)::INT) + 1, least(len(text), 15 + floor({SHARE.format(seed=chr(39) + '29' + chr(39), key='(doc_id || chr(114))')} * 8)::INT) - greatest(0, 10 - floor({SHARE.format(seed=chr(39) + '29' + chr(39), key='(doc_id || chr(108))')} * 8)::INT)) AS crop FROM documents WHERE len(text) > 30")
def f33(spark, d):
    docs = _docs(spark, d).where(F.length("text") > 30)
    return docs.select("doc_id", C.margins(F.col("text"), F.lit(10), F.lit(15), 8, F.col("doc_id")).alias("crop"))


def _vocab() -> dict[str, int]:
    """Single letters and a few endings."""
    from string import ascii_lowercase

    words = [*ascii_lowercase, *(f"##{c}" for c in ascii_lowercase), "##ing", "##tion", "##er", "the", "and", "of", "in"]
    return {w: i for i, w in enumerate(words)}


@query("f18_custom_tokenizer", f"SELECT conv_id, turn, len(list_filter(regexp_split_to_array(text, '{WS}'), lambda t: t <> ''))::INT AS n FROM conversations")
def f18(spark, d):
    return D.table(spark, d, "conversations").select("conv_id", "turn", F.size(T.with_tokenizer(F.col("text"), str.split)).alias("n"))


#: Cleaned words of a text, and its tokens, joined by single spaces.
CLEANED = "array_to_string(list_filter(string_split(strip_accents(lower(regexp_replace(regexp_replace(regexp_replace({c}, '[\\t\\n\\r\\p{{Zs}}]', ' ', 'g'), '[\\p{{C}}\\x{{FFFD}}]', '', 'g'), '(\\p{{Han}})', ' \\1 ', 'g'))), ' '), lambda x: x <> ''), ' ')"
BASIC = "list_filter(string_split(regexp_replace(" + CLEANED + ", '([!-/:-@\\[-`{{-~]|\\p{{P}})', ' \\1 ', 'g'), ' '), lambda x: x <> '')"


def _pieces_sql(tokens: str) -> str:
    """Longest known pieces from the left of each token, by a step for each piece."""
    known = "[" + ", ".join(f"'{w}'" for w in _vocab()) + "]"
    step = f"list_filter(range(len(token) - done, 0, -1), lambda l: list_contains({known}, CASE WHEN done > 0 THEN '##' ELSE '' END || substr(token, done + 1, l)))[1]"
    return f"""RECURSIVE t AS (SELECT item_id, unnest(range(len(w))) AS pos, unnest(w) AS token FROM (SELECT item_id, {tokens} AS w FROM benchmark)),
st AS (SELECT DISTINCT token, 0::BIGINT AS done, ''::VARCHAR AS ps FROM t WHERE len(token) <= 100 UNION ALL
  SELECT token, done + l, ps || CASE WHEN done > 0 THEN ' ##' ELSE '' END || substr(token, done + 1, l) FROM (SELECT *, {step} AS l FROM st WHERE done < len(token)) WHERE l IS NOT NULL),
cut AS (SELECT token, ps FROM st WHERE done = len(token))
SELECT item_id, coalesce(string_agg(coalesce(ps, token), ' ' ORDER BY pos), '') AS pieces FROM t LEFT JOIN cut USING (token) GROUP BY item_id"""


@query("f19_basic_tokens", "SELECT conv_id, turn, array_to_string(" + BASIC.format(c="text") + ", ' ') AS tokens FROM conversations")
def f19(spark, d):
    return D.table(spark, d, "conversations").select("conv_id", "turn", F.array_join(T.basic(F.col("text")), " ").alias("tokens"))


@query("f20_all_but_split", "SELECT conv_id, turn, " + CLEANED.format(c="text") + " AS clean FROM conversations")
def f20(spark, d):
    return D.table(spark, d, "conversations").select("conv_id", "turn", T.all_but_split(F.col("text")).alias("clean"))


@query("f22_wordpiece", _pieces_sql(f"list_filter(regexp_split_to_array(lower(text), '{WS}'), lambda t: t <> '')"))
def f22(spark, d):
    return D.table(spark, d, "benchmark").select("item_id", F.array_join(T.wordpiece(X.white_tokens(F.lower("text")), _vocab()), " ").alias("pieces"))


@query("f36_full_tokenizer", _pieces_sql(BASIC.format(c="text")))
def f36(spark, d):
    return D.table(spark, d, "benchmark").select("item_id", F.array_join(T.full(F.col("text"), _vocab()), " ").alias("pieces"))


PROJECTED = (
    "tk AS (SELECT item_id, text, " + BASIC.format(c="text") + " AS w FROM benchmark), pr AS (SELECT item_id, text, array_to_string(w, ' ') AS tok, array_to_string(w[len(w) // 4 + 1:len(w) // 4 + greatest(1, len(w) // 2)], ' ') AS pred FROM tk), "
    "m AS (SELECT item_id, list_filter(range(1, len(text) + 1), lambda i: NOT regexp_matches(text[i], '[\\t\\n\\r\\p{Zs}]')) AS ns, strpos(tok, pred) - 1 AS p0, tok, pred FROM pr), "
    "k AS (SELECT item_id, ns, p0 - (p0 - len(replace(substr(tok, 1, p0), ' ', ''))) AS s0, len(replace(pred, ' ', '')) AS n FROM m) "
    "SELECT item_id, (ns[s0 + 1] - 1)::BIGINT AS start, ns[s0 + n]::BIGINT AS \"end\" FROM k"
)


@query("f25_final_text", PROJECTED)
def f25(spark, d):
    """The middle half of every item's tokens, projected back into the item."""
    middle = X.let(T.basic(F.col("text")), lambda t: F.array_join(F.slice(t, (F.floor(F.size(t) / 4) + 1).cast("int"), F.greatest(F.lit(1), F.floor(F.size(t) / 2)).cast("int")), " "))
    return D.table(spark, d, "benchmark").select("item_id", T.final_text(F.col("text"), middle).alias("s")).select("item_id", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"))


DRAW = "(('0x' || substr(md5(item_id || ':' || {what} || ':' || {at}), 1, 8))::BIGINT / 4294967296.0)"
NOISE_IDS = "ids AS (SELECT item_id, list_concat([101], list_transform(regexp_extract_all(lower(text), '[\\pL0-9]+'), lambda t: ('0x' || substr(md5(t), 1, 6))::BIGINT), [102]) AS v FROM benchmark)"


def _draw(what: str, at: str = "0") -> str:
    return DRAW.format(what=f"'{what}'", at=at)


def _noise_sql(shorten: float, replace: float, unknown: float, shuffle: float, least: int, most: str, keep: str) -> str:
    cut = f"cut AS (SELECT item_id, CASE WHEN {_draw('shorten')} < {shorten} AND l < len(v) - 2 THEN list_concat(v[1:l + 1], v[-1:]) ELSE v END AS v, v AS o FROM (SELECT item_id, v, {least} + floor({_draw('length')} * ({most} - {least} + 1))::BIGINT AS l FROM ids))"
    rep = f"rep AS (SELECT item_id, o, list_transform(v, lambda x, i: CASE WHEN i > 1 AND i < len(v) AND {_draw('replace', '(i - 1)')} < {replace} THEN CASE WHEN {_draw('unknown', '(i - 1)')} < {unknown} THEN 100 ELSE 999 + floor({_draw('new', '(i - 1)')} * 29523)::BIGINT END ELSE x END) AS v FROM cut)"
    step = f"mix AS (SELECT item_id, o, v, 1 AS i FROM rep UNION ALL SELECT item_id, o, CASE WHEN {_draw('shuffle', 'i')} < {shuffle} THEN list_concat(v[1:i], [v[2 + floor({_draw('other', 'i')} * (len(v) - 2))::BIGINT]], v[i + 2:]) ELSE v END, i + 1 FROM mix WHERE i <= len(v) - 2)"
    return f"RECURSIVE {NOISE_IDS}, {cut}, {rep}, {step} SELECT item_id, array_to_string(CASE WHEN {keep} THEN v ELSE o END, ',') AS ids FROM mix WHERE i > len(v) - 2"


def _marked_ids():
    return T.framed(F.transform(F.regexp_extract_all(F.lower("text"), F.lit(X.TERM), F.lit(0)), X.term_id), 101, 102)


@query("f34_noise", _noise_sql(0.5, 0.3, 0.1, 0.2, 0, "300", "true"))
def f34(spark, d):
    return D.table(spark, d, "benchmark").select("item_id", F.array_join(T.noisy(_marked_ids(), F.col("item_id")), ",").alias("ids"))


@query("f34_negative_noise", _noise_sql(0.6, 0.4, 0.5, 0.3, 0, "least(len(v) - 2, 40)", f"{_draw('negative')} < 0.7"))
def f34n(spark, d):
    ids = T.noisy_negative(_marked_ids(), F.col("item_id"), share=0.7, shorten=0.6, replace=0.4, unknown=0.5, shuffle=0.3, most=40)
    return D.table(spark, d, "benchmark").select("item_id", F.array_join(ids, ",").alias("ids"))


@query("f24_question_features", "ids AS (SELECT item_id, list_transform(regexp_extract_all(lower(text), '[\\pL0-9]+'), lambda t: ('0x' || substr(md5(t), 1, 6))::BIGINT) AS v FROM benchmark), k AS (SELECT item_id, n, list_concat([101], v[1:n], [102]) AS f FROM ids, (VALUES (64), (16)) t(n)) SELECT item_id, n::BIGINT AS most, array_to_string(list_concat(f, list_transform(range(n + 2 - len(f)), lambda i: 0)), ',') AS ids, len(f)::BIGINT AS used FROM k")
def f24q(spark, d):
    """Questions between marks, cut to 64 tokens in batches and to 16 in service."""
    ids = F.transform(F.regexp_extract_all(F.lower("text"), F.lit(X.TERM), F.lit(0)), X.term_id)
    out = None
    for most in (64, 16):
        t = D.table(spark, d, "benchmark").select("item_id", F.lit(most).cast("long").alias("most"), T.framed(ids, 101, 102, most).alias("f"))
        used = F.aggregate(X.mask(F.col("f"), most + 2), F.lit(0).cast("long"), lambda s, x: s + x)
        t = t.select("item_id", "most", F.array_join(X.padded(F.col("f"), most + 2), ",").alias("ids"), used.alias("used"))
        out = t if out is None else out.unionByName(t)
    return out


@query("i4_index_stages", SQ.CELL + SQ.CODED + " SELECT cluster_id, count(*) AS n, sum(list_sum(codes))::BIGINT AS total FROM coded GROUP BY cluster_id", "w q")
def i4(spark, d):
    """All stages under one folder, each run twice: what is there stays; the index is moved at the end."""
    path, target = IO.scratch(spark), IO.scratch(spark)
    w = D.words(spark, d)
    for stage in (*I.STAGES, "all"):
        I.build(w, path, I.label_centroids(w), stage, target=target)
    sums = F.aggregate("codes", F.lit(0).cast("long"), lambda s, x: s + x)
    return spark.read.parquet(target).groupBy("cluster_id").agg(F.count("*").alias("n"), F.sum(sums).alias("total"))


#: The words' texts; answers of a search by cells against each question's own word.
JUDGED = (
    SQ.BY_CELLS
    + ", r AS (" + SQ.BEST.format(spans=SQ.PSPANS.format(t="top5", first="list_dot_product(qs, a.s)")) + "),"
    + SQ.RESULTS
    + f""", truth AS (SELECT word_id AS qid, substr(context, char_start + 1, char_end - char_start) AS truth FROM pw JOIN ctx USING (doc_idx)),
b AS (SELECT shown.qid, rank, {_norm('truth')} AS t, {_norm('answer')} AS p FROM shown JOIN truth USING (qid)),
xt AS (SELECT qid, rank, w, count(*) AS c FROM (SELECT qid, rank, unnest(string_split(t, ' ')) AS w FROM b WHERE t <> '') GROUP BY ALL),
xp AS (SELECT qid, rank, w, count(*) AS c FROM (SELECT qid, rank, unnest(string_split(p, ' ')) AS w FROM b WHERE p <> '') GROUP BY ALL),
xo AS (SELECT xt.qid, xt.rank, sum(least(xt.c, xp.c)) AS o FROM xt JOIN xp ON xt.qid = xp.qid AND xt.rank = xp.rank AND xt.w = xp.w GROUP BY ALL),
jd AS (SELECT b.qid, b.rank, t = p AS em, CASE WHEN coalesce(o, 0) = 0 THEN 0.0 ELSE 2.0 * o / (len(string_split(t, ' ')) + len(string_split(p, ' '))) END::DOUBLE AS f1 FROM b LEFT JOIN xo ON b.qid = xo.qid AND b.rank = xo.rank),
fh AS (SELECT qid, coalesce(min(rank) FILTER (em), 1e9)::DOUBLE AS rank FROM jd GROUP BY qid)"""
)


def _judged(spark, d):
    from phrasewell.plans import search as Q

    w, path = SQ._placed(spark, d), SQ._index(spark, d)
    contexts, asked = D.within(D.titled_contexts(spark, d), w), D.questions(spark, d)
    found = Q.search(asked, w, cells=I.stored(spark, path), centroids=spark.read.parquet(f"{path}/centroids"), nprobe=3)
    shown = Q.results(found, w, contexts)
    truth = w.join(asked.select(F.col("qid").alias("word_id")), "word_id", "left_semi").join(contexts, "doc_idx").select(F.col("word_id").alias("qid"), X.between(F.col("context"), F.col("char_start"), F.col("char_end")).alias("truth"))
    return E.scores(shown.join(truth, "qid").withColumnRenamed("answer", "pred"), ["qid", "rank"])


@query("q8_index_predict_evaluate", JUDGED + ", rc AS (SELECT k, avg((rank <= k)::INT) AS recall FROM fh, range(1, 6) t(k) GROUP BY k), be AS (SELECT k, avg(em) AS em, avg(f1) AS f1 FROM (SELECT k, qid, max(em::INT) AS em, max(f1) AS f1 FROM jd, range(1, 6) t(k) WHERE rank <= k GROUP BY k, qid) GROUP BY k) SELECT k::INT AS k, round(recall, 6) AS recall, round(em, 6) AS exact_match, round(f1, 6) AS f1 FROM rc JOIN be USING (k)", "pw q")
def q8(spark, d):
    """Index, search by cells, answers, and their exact match, F1 and recall among the first 1 to 5."""
    judged = materialized(_judged(spark, d))
    recall = E.recall_at(E.first_hits(judged), 5).select("k", F.round("recall", 6).alias("recall"))
    return recall.join(E.at_k(judged, 1, 5).select("k", F.round("exact_match", 6).alias("exact_match"), F.round("f1", 6).alias("f1")), "k")


def materialized(rows):
    return IO.materialized(rows)


DUMPED = "fl AS (SELECT * FROM pw WHERE fs > 0), ke AS (SELECT doc_idx, word_idx, row_number() OVER (PARTITION BY doc_idx ORDER BY word_idx) - 1 AS k FROM pw WHERE fe > 0), sp AS (SELECT fl.doc_idx, fl.word_idx, o, k FROM (SELECT *, unnest(range(5)) AS o FROM fl) fl LEFT JOIN ke ON ke.doc_idx = fl.doc_idx AND ke.word_idx = fl.word_idx + o), ag AS (SELECT doc_idx, count(*) FILTER (k IS NOT NULL) AS spans, sum(k)::BIGINT AS ends FROM sp GROUP BY doc_idx)"


@query("q9_dump_pipeline", DUMPED + ", cd AS (SELECT doc_idx, count(*) AS kept, sum(list_sum(list_transform(s, lambda x: round_even(greatest(-128, least(127, (x + 2) * 20)), 0))))::BIGINT AS total, sum(char_start)::BIGINT AS chars FROM fl GROUP BY doc_idx) SELECT cd.*, spans, coalesce(ends, 0) AS ends FROM cd JOIN ag USING (doc_idx)", "pw")
def q9(spark, d):
    """Placed words of contexts through the boundary filter (starts, kept ends of each) and the 8-bit code into a dump, and back."""
    w = D.placed_words(spark, d)
    spans = S.boundary_filter(w, 0.0, 5).groupBy("doc_idx", "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "end_ord"))), lambda x: x.end_ord).alias("start2end"))
    kept = w.where("filter_start > 0").select("doc_idx", "word_idx", "char_start", V.quantize(F.col("start")).alias("start"))
    path = IO.scratch(spark)
    IO.write_phrase_dump(kept.join(spans.withColumnRenamed("i", "word_idx"), ["doc_idx", "word_idx"]), path)
    sums = F.aggregate("start", F.lit(0).cast("long"), lambda s, x: s + x)
    there = F.filter("start2end", lambda e: e >= 0)
    back = IO.read_phrase_dump(spark, path)
    return back.groupBy("doc_idx").agg(F.count("*").alias("kept"), F.sum(sums).alias("total"), F.sum("char_start").cast("long").alias("chars"), F.sum(F.size(there)).alias("spans"), F.sum(F.aggregate(there, F.lit(0).cast("long"), lambda s, x: s + x)).alias("ends"))


@query("stream_words_to_index", "SELECT label, count(*) AS n FROM w GROUP BY label", "w")
def streamed(spark, d):
    """All words as a stream of files into the index."""
    from phrasewell.streaming import words as S

    w = D.words(spark, d)
    folder, path, mark = IO.scratch(spark), IO.scratch(spark), IO.scratch(spark)
    w.write.parquet(folder)
    S.append_to_index(S.word_stream(spark, folder, w), I.label_centroids(w), path, mark).awaitTermination()
    return spark.read.schema(spark.read.parquet(path).schema).parquet(path).groupBy("label").agg(F.count("*").alias("n"))


