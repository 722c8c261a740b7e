"""Queries register themselves here with the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: SQL views of the test tables, put before a query's own SQL where it names them.
VIEWS = {
    "w": "w AS (SELECT vec_id AS word_id, vec_id // 25 AS doc_idx, vec_id % 25 AS word_idx, label, embedding[1:24]::DOUBLE[] AS s, embedding[25:48]::DOUBLE[] AS e, embedding[49:56]::DOUBLE[] AS sa, embedding[57:64]::DOUBLE[] AS sb, embedding[1]::DOUBLE AS fs, embedding[25]::DOUBLE AS fe FROM embeddings)",
    "ctx": "ctx AS (SELECT doc_id AS doc_idx, source AS title, replace(text, chr(10), ' [PAR] ') AS context FROM documents WHERE text IS NOT NULL)",
    "off": r"offp AS (SELECT doc_idx, regexp_extract_all(context, '[^ \t\r\n\x{202F}]+') AS ws, list_transform(regexp_split_to_array(context, '[^ \t\r\n\x{202F}]+'), lambda g: len(g)) AS gs FROM ctx WHERE doc_idx IN (SELECT doc_idx FROM w)), offw AS (SELECT doc_idx, unnest(range(len(ws))) AS k, unnest(ws) AS word, unnest(gs[1:len(ws)]) AS gap FROM offp), offc AS (SELECT doc_idx, k, word, (sum(gap + len(word)) OVER (PARTITION BY doc_idx ORDER BY k))::BIGINT AS char_end, (sum((word = '[PAR]')::INT) OVER (PARTITION BY doc_idx ORDER BY k))::BIGINT AS par_idx FROM offw), off AS (SELECT doc_idx, k - par_idx AS word_idx, par_idx, char_end - len(word) AS char_start, char_end FROM offc WHERE word <> '[PAR]')",
    "pw": "pw AS (SELECT w.*, par_idx, char_start, char_end FROM w JOIN off USING (doc_idx, word_idx))",
    "q": "q AS (SELECT vec_id AS qid, embedding[1:24]::DOUBLE[] AS qs, embedding[25:48]::DOUBLE[] AS qe, list_dot_product(embedding[49:56]::DOUBLE[], embedding[57:64]::DOUBLE[]) AS qp FROM embeddings WHERE vec_id % 20 = 0)",
    "par": r"par AS (SELECT doc_id, (unnest(range(len(p))))::INT AS par_idx, unnest(p) AS par_text FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL))",
    "pred": "pred AS (SELECT a.conv_id || '-' || a.turn AS qid, a.text AS truth, b.text AS pred FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND b.role = 'assistant' WHERE a.role = 'user')",
    "term": r"term AS (SELECT doc_id, par_idx, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM (SELECT doc_id, par_idx, regexp_extract_all(lower(par_text), '[\pL0-9]+') AS t FROM par))",
    "tf": "tf AS (SELECT doc_id, par_idx, ('0x' || substr(md5(term), 1, 6))::BIGINT AS term_id, count(*) AS tf FROM term GROUP BY ALL)",
    "df": "df AS (SELECT term_id, count(DISTINCT doc_id) AS nt FROM tf GROUP BY term_id)",
    "tfidf": "tfidf AS (SELECT doc_id, par_idx, term_id, ln(1 + tf) * greatest(0, ln(((SELECT count(*) FROM documents) - nt + 0.5) / (nt + 0.5))) AS val FROM tf JOIN df USING (term_id))",
    "qterm": r"qterm AS (SELECT item_id, ('0x' || substr(md5(u), 1, 6))::BIGINT AS term_id, count(*) AS tf FROM (SELECT item_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS u FROM (SELECT item_id, regexp_extract_all(lower(text), '[\pL0-9]+') AS t FROM benchmark)) GROUP BY ALL)",
    "qtfidf": "qtfidf AS (SELECT item_id, term_id, ln(1 + tf) * greatest(0, ln(((SELECT count(*) FROM documents) - coalesce(nt, 0) + 0.5) / (coalesce(nt, 0) + 0.5))) AS val FROM qterm LEFT JOIN df USING (term_id))",
}
NEEDS = {"off": ["w", "ctx"], "pw": ["w", "ctx", "off"], "term": ["par"], "tf": ["par", "term"], "df": ["par", "term", "tf"], "tfidf": ["par", "term", "tf", "df"], "qtfidf": ["par", "term", "tf", "df", "qterm"]}


def query(name: str, sql: str | None = None, views: str = "") -> Callable[[Query], Query]:
    """Registers a query; sql may use the views named in `views`, and may begin with further CTEs ("a AS (...), b AS (...) SELECT")."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            need: list[str] = []
            for v in views.split():
                need += [x for x in [*NEEDS.get(v, []), v] if x not in need]
            head = ", ".join(VIEWS[v] for v in VIEWS if v in need)
            body = sql.strip()
            start = "WITH"
            if body.startswith("RECURSIVE "):
                start, body = "WITH RECURSIVE", body.removeprefix("RECURSIVE ")
            if head:
                body = f"{start} {head}, {body}" if body.split(None, 2)[1].upper() == "AS" else f"{start} {head} {body}"
            elif body.split(None, 2)[1].upper() == "AS":
                body = f"{start} {body}"
            ORACLES[name] = body
        return f

    return add
