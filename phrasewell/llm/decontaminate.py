"""Benchmark decontamination by winnowing, in DataFrame operations only.

Each text is a list of words. Of every run of `window` words the k-gram (k = `gram`) with the smallest hash is a fingerprint, so
two texts that share `window` consecutive words share a fingerprint at the same offset in them: none is missed. Fingerprints
of documents meet those of the items' windows in an equi-join, and each hit is extended to the whole window and
compared word by word, so that hashes decide nothing. An item of fewer words than a window is one window itself; these
are looked up by the hash of all their words and compared too.

The items' windows are broadcast while there are at most BROADCAST_WINDOWS of them (counted first), so that documents aren't
shuffled at all; beyond that, fingerprints are shuffled and joined by hash and the hits go back to their documents.
A passage in many documents gives each of them its own rows, keyed by document.

Null and empty texts have no words and no hits; an item without words is no item; a null item_id counts as "". Items
with one item_id count once. Repeated rows of a document get equal results; very long texts are handled whole, within their row. Empty documents give
an empty result, an empty benchmark documents without hits. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phrasewell.llm._shared import WORD_GAP, ascii_lower, let, table, text_or_empty

WINDOW, GRAM = 8, 5
BROADCAST_WINDOWS = 100_000


def words(c: Column | str) -> Column:
    return F.array_remove(F.split(ascii_lower(text_or_empty(c)), WORD_GAP), "")


def _grams(ws: Column, gram: int) -> Column:
    """Hashes of all grams of consecutive words."""
    last = F.size(ws) - gram
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(ws, i + j) for j in range(gram)])))


def _runs(ws: Column, n: int) -> Column:
    """Hashes of all runs of n consecutive words, each taken as a whole."""
    return let(ws, lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(F.slice(w, i + 1, n)))))


def _lowest(h: Column, hs: Column, at: Column, span: int) -> Column:
    """Whether h = hs[at] is the least, or as low as the least, in some run of span neighbours."""

    def reach(step: int, k: int = 1) -> Column:
        if k == span:
            return F.lit(span - 1)
        return F.when(F.coalesce(F.get(hs, at + step * k) >= h, F.lit(False)), reach(step, k + 1)).otherwise(F.lit(k - 1))

    return reach(-1) + reach(1) + 1 >= span


def item_windows(items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """item (string), len, window_words (array), off and h: the place and the hash of the window's fingerprint; h hashes all words of a short item."""
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words("text").alias("ws")).where(F.size("ws") > 0)
    n = F.least(F.size("ws"), F.lit(window))
    rows = rows.select("item", "ws", n.alias("len"), F.explode(F.sequence(F.lit(0), F.size("ws") - n)).alias("s"))
    rows = rows.select("item", "len", F.slice("ws", F.col("s") + 1, F.col("len")).alias("window_words"))
    hs = _grams(F.col("window_words"), gram)
    best = let(hs, lambda a: F.struct((F.array_position(a, F.array_min(a)) - 1).cast("int").alias("off"), F.array_min(a).alias("h")))
    short = F.struct(F.lit(0).alias("off"), F.xxhash64("window_words").alias("h"))
    rows = rows.withColumn("_f", F.when(F.col("len") == window, best).otherwise(short))
    return rows.select("item", "len", "window_words", F.col("_f.off").alias("off"), F.col("_f.h").alias("h")).distinct()


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """doc_id, _text (hash of the text), s (first word), len and item of every place where an item's window stands in a document."""
    found = item_windows(items, window, gram)
    small = found.limit(broadcast_windows + 1).count() <= broadcast_windows
    lens = [r[0] for r in found.select("len").distinct().collect()]  # at most `window` numbers
    distinct = found.select("h", "off", "len", "window_words").distinct()
    texts = docs.select("doc_id", F.xxhash64("text").alias("_text"), words("text").alias("ws"))
    parts = []
    for n in lens:
        if n == window:
            hashed = texts.withColumn("hs", let(F.col("ws"), lambda ws: F.when(F.size(ws) >= window, _grams(ws, gram))))
            # The outer form keeps the optimizer from adding a filter on hs, which would compute hs twice.
            prints = hashed.select("doc_id", "_text", "ws", "hs", F.posexplode_outer("hs").alias("p", "h")).where(_lowest(F.col("h"), F.col("hs"), F.col("p"), window - gram + 1))
        else:
            prints = texts.select("doc_id", "_text", "ws", F.posexplode_outer(_runs(F.col("ws"), n)).alias("p", "h"))
        wanted = distinct.where(F.col("len") == n)
        if small:
            met = prints.select("doc_id", "_text", "ws", "p", "h").join(F.broadcast(wanted), "h")
        else:
            met = prints.select("doc_id", "_text", "p", "h").join(wanted, "h").withColumnsRenamed({"doc_id": "_d", "_text": "_t"})
            met = met.join(texts.distinct(), F.col("_d").eqNullSafe(F.col("doc_id")) & (F.col("_t") == F.col("_text")))
        s = F.col("p") - F.col("off")
        met = met.where((s >= 0) & (F.slice("ws", F.greatest(s, F.lit(0)) + 1, F.col("len")) == F.col("window_words")))
        parts.append(met.select("doc_id", "_text", s.alias("s"), "len", "window_words"))
    if not parts:
        return texts.select("doc_id", "_text", F.lit(0).alias("s"), F.lit(0).alias("len"), F.lit("").alias("item")).where(F.lit(False))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    of = found.select("window_words", "item")
    return out.join(F.broadcast(of) if small else of, "window_words").select("doc_id", "_text", "s", "len", "item")


def spans() -> Column:
    """An aggregate of hits: their distinct spans (s, e), in order."""
    return F.array_sort(F.collect_set(F.struct("s", (F.col("s") + F.col("len")).alias("e"))))


def covered(of: str) -> Column:
    """The number of words in spans."""
    return F.aggregate(
        of,
        F.struct(F.lit(0).alias("e"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(F.greatest(a.e, x.e).alias("e"), (a.n + F.greatest(F.lit(0), x.e - F.greatest(a.e, x.s))).alias("n")),
        lambda a: a.n,
    )


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM, min_items: int = 2, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items (sorted), contaminated."""
    found = hits(docs, items, window, gram, broadcast_windows)
    per_doc = found.groupBy("doc_id", "_text").agg(spans().alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))
    per_doc = per_doc.select(F.col("doc_id").alias("_d"), F.col("_text").alias("_t"), covered("spans").alias("n_hit"), "items")
    rows = docs.select("doc_id", F.xxhash64("text").alias("_text"), F.size(words("text")).cast("long").alias("n_words"))
    out = rows.join(per_doc, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_text") == F.col("_t")), "left")
    out = out.withColumn("items", F.coalesce("items", F.expr("cast(array() as array<string>)")))
    return out.select(
        "doc_id",
        "_text",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        "items",
        (F.size("items") >= min_items).alias("contaminated"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM documents),
b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(len(ws), 8) AS n, array_to_string(ws[i:i + least(len(ws), 8) - 1], ' ') AS w
  FROM (SELECT item, ws, unnest(range(1, len(ws) - least(len(ws), 8) + 2)) AS i FROM b WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT r, n, i, array_to_string(ws[i:i + n - 1], ' ') AS w
  FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, lens WHERE len(ws) >= n)),
hit AS (SELECT r, i, dw.n AS n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.w = bw.w),
cov AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM hit) GROUP BY r),
its AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN cov USING (r) LEFT JOIN its USING (r)
"""
