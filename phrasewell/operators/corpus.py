"""Corpus preparation: windows, paragraph merging, filters, samples, shards, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phrasewell.functions import text as X


def token_windows(n: Column, size: int, stride: int) -> Column:
    """Windows over n tokens: array of struct(start, length); the last is the first that reaches the end."""
    last = F.greatest(F.lit(0), F.ceil((n - size) / stride)).cast("int")
    starts = F.transform(F.sequence(F.lit(0), last), lambda i: i * stride)
    return F.when(n > 0, F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(F.lit(size), n - s).alias("length")))).otherwise(F.expr("cast(array() as array<struct<start:int,length:int>>)"))


def max_context(windows: Column, token: Column) -> Column:
    """The ordinal of the window that gives a token most context: the smaller side plus a hundredth of the length; the first of equal ones."""
    holds = F.filter(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: (x.w.start <= token) & (token < x.w.start + x.w.length))
    scored = F.transform(holds, lambda x: F.struct((F.least(token - x.w.start, x.w.start + x.w.length - 1 - token) + 0.01 * x.w.length).alias("s"), (-x.i).alias("i")))
    return -F.array_max(scored).i


def best_window(token: Column, n: Column, size: int, stride: int) -> Column:
    """max_context over token_windows(n, size, stride) without the windows: only the few that can hold the token are worked out."""
    count = F.greatest(F.lit(0), F.ceil((n - size) / stride)) + 1
    first = F.greatest(F.lit(0), F.floor((token - size) / stride) + 1)
    last = F.least(count - 1, F.floor(token / stride))

    def scored(k: Column) -> Column:
        length = F.least(F.lit(size), n - k * stride)
        return F.struct((F.least(token - k * stride, k * stride + length - 1 - token) + 0.01 * length).alias("s"), (-k).alias("k"))

    return -F.array_max(F.transform(F.sequence(first, last), scored)).k


def merge_paragraphs(pars: DataFrame, low: int, high: int, doc: str = "doc_id") -> DataFrame:
    """Paragraphs of a document appended with a space until they have `low` characters; those of `high` or more are skipped, a short remainder is dropped.

    (doc, out_idx, merged)"""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("par_idx", "par_text"))), lambda x: x.par_text)

    def step(acc: Column, p: Column) -> Column:
        grown = F.concat(acc.cur, F.lit(" "), p)
        skip, full = F.length(p) >= high, F.length(grown) >= low
        return F.when(skip, acc).otherwise(
            F.struct(F.when(full, F.concat(acc.out, F.array(grown))).otherwise(acc.out).alias("out"), F.when(full, F.lit("")).otherwise(grown).alias("cur"))
        )

    zero = F.struct(F.expr("cast(array() as array<string>)").alias("out"), F.lit("").alias("cur"))
    per = pars.groupBy(doc).agg(texts.alias("ps"))
    return per.select(doc, F.posexplode(F.aggregate("ps", zero, step, lambda a: a.out)).alias("out_idx", "merged"))


def length_between(c: Column, low: int, high: int) -> Column:
    return (F.length(c) >= low) & (F.length(c) < high)


def hash_share(key: Column, seed: str = "29") -> Column:
    """A number in [0, 1) fixed by the key: a sample by it is the same everywhere."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), key.cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def sample(rows: DataFrame, key: str, share: float, seed: str = "29") -> DataFrame:
    return rows.where(hash_share(F.col(key), seed) < share)


def allow_or_sample(rows: DataFrame, allowed: DataFrame, key: str, share: float, seed: str = "29") -> DataFrame:
    """Rows whose key is allowed, and a sample of the others."""
    allowed = allowed.select(key).distinct()
    return rows.join(allowed, key, "left_semi").unionByName(sample(rows.join(allowed, key, "left_anti"), key, share, seed))


def two_stage_sample(words: DataFrame, docs_share: float, words_share: float, group: Column, seed: str = "29") -> DataFrame:
    """floor(share) documents of each group in hash order, then of each document floor(share) words drawn with replacement."""
    docs = words.select("doc_idx", group.alias("_g")).distinct().withColumn("_h", hash_share(F.col("doc_idx"), seed))
    w = Window.partitionBy("_g")
    docs = docs.withColumns({"_n": F.count("*").over(w), "_r": F.row_number().over(w.orderBy("_h", "doc_idx"))}).where(F.col("_r") <= F.floor(F.col("_n") * docs_share))
    sized = words.groupBy("doc_idx").agg(F.count("*").alias("_m")).join(docs.select("doc_idx"), "doc_idx")
    draws = sized.withColumn("draw", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(0), F.floor(F.col("_m") * words_share)).cast("int"))) if words_share > 0 else F.lit(None)).where(F.floor(F.col("_m") * words_share) >= F.col("draw"))
    draws = draws.withColumn("_at", F.floor(hash_share(F.concat_ws(":", "doc_idx", "draw"), seed) * F.col("_m")).cast("int"))
    numbered = words.withColumn("_at", F.row_number().over(Window.partitionBy("doc_idx").orderBy("word_idx")) - 1)
    return numbered.join(draws.select("doc_idx", "draw", "_at"), ["doc_idx", "_at"]).drop("_at")


def draws(rows: DataFrame, n: int, key: str, seed: str = "29") -> DataFrame:
    """n draws with replacement, numbered from 1: each names a place in the rows' hash order."""
    numbered = shards(rows, 1, key, seed).withColumnRenamed("shard", "_at")
    total = rows.count()
    asked = rows.sparkSession.range(1, n + 1).withColumnRenamed("id", "draw")
    asked = asked.withColumn("_at", F.floor(hash_share(F.col("draw"), seed) * total).cast("long"))
    return numbered.join(F.broadcast(asked), "_at").drop("_at")


def with_dummy(rows: DataFrame, key: str, text: str, dummy: Column, first: Column) -> DataFrame:
    """Two documents for each row, its own text and a made-up one, which comes first where `first` holds: rows with doc_idx and text."""
    pair = F.array(F.struct(F.when(first, 1).otherwise(0).alias("doc_idx"), F.col(text).alias("_t")), F.struct(F.when(first, 0).otherwise(1).alias("doc_idx"), dummy.alias("_t")))
    return rows.withColumn("_p", F.explode(pair)).withColumns({"doc_idx": F.col("_p.doc_idx"), text: F.col("_p._t")}).drop("_p")


def shards(rows: DataFrame, per_shard: int, key: str, seed: str = "29") -> DataFrame:
    """rows in a fixed shuffled order with shard numbers of per_shard rows each: places come from counts per range of the order."""
    rows = rows.withColumn("_h", hash_share(F.col(key), seed)).withColumn("_range", F.floor(F.col("_h") * 1024).cast("int"))
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    at = F.row_number().over(Window.partitionBy("_range").orderBy("_h", key)) - 1
    out = rows.withColumn("_at", at).join(before, "_range")
    return out.withColumn("shard", F.floor((F.col("_at") + F.col("_before")) / per_shard).cast("long")).drop("_h", "_range", "_at", "_before")


def gaps(ranges: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Of (start, end) ranges those that don't begin where the one before ends, with what was expected.

    With start, the first range must begin there; with end, a last row (end, end) tells where the ranges stop short of it or beyond.
    """
    first = F.lit(start).cast("long")
    if end is not None:
        ranges = ranges.select("start", "end").unionByName(ranges.sparkSession.createDataFrame([(end, end)], "start long, end long"))
    before = F.coalesce(F.lag("end").over(Window.orderBy("start", "end")), first)
    return ranges.withColumn("expected", before).where(F.col("expected").isNotNull() & (F.col("expected") != F.col("start")))


def shard_name(number: Column, width: int = 4) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def regroup(windows: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Paragraph texts of a document in order, joined by the marked separator."""
    ordered = F.array_sort(F.collect_list(F.struct("par_idx", "par_text")))
    return windows.groupBy(doc).agg(F.array_join(F.transform(ordered, lambda x: x.par_text), " [PAR] ").alias("context"))


def regroup_windows(pars: DataFrame, size: int, stride: int, doc: str = "doc_id") -> DataFrame:
    """(doc, word_pos, par_idx, window_idx, char_start, char_end): the words of all windows of a document's paragraphs(doc, par_idx, par_text) one after another.

    Words in several windows come once for each. Places count from the start of the document's paragraphs joined by the marked separator.
    """
    before = Window.partitionBy(doc).orderBy("par_idx").rowsBetween(Window.unboundedPreceding, -1)
    pars = pars.withColumn("_base", F.coalesce(F.sum(F.length("par_text") + len(X.SEPARATOR)).over(before), F.lit(0)))
    rows = pars.select(doc, "par_idx", "_base", X.word_places(F.col("par_text")).alias("_p"))
    rows = rows.select(doc, "par_idx", "_base", F.size("_p").alias("_n"), F.posexplode("_p").alias("_i", "_w"))
    so_far = F.sum(F.col("_w.gap") + F.length("_w.word")).over(Window.partitionBy(doc, "par_idx").orderBy("_i"))
    rows = rows.select(doc, "par_idx", "_n", "_i", (F.col("_base") + so_far).alias("char_end"), F.length("_w.word").alias("_len"))
    last = F.least(F.greatest(F.lit(0), F.ceil((F.col("_n") - size) / stride)), F.floor(F.col("_i") / stride))
    rows = rows.withColumn("window_idx", F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col("_i") - size) / stride) + 1), last)))
    place = F.row_number().over(Window.partitionBy(doc).orderBy("par_idx", "window_idx", "_i")) - 1
    return rows.select(doc, place.cast("long").alias("word_pos"), "par_idx", "window_idx", (F.col("char_end") - F.col("_len")).alias("char_start"), "char_end")


def margins(s: Column, start: Column, end: Column, most: int, key: Column, seed: str = "29") -> Column:
    """A crop around a span with margins of up to `most` characters, fixed by the key."""
    left = F.floor(hash_share(F.concat(key.cast("string"), F.lit("l")), seed) * most).cast("int")
    right = F.floor(hash_share(F.concat(key.cast("string"), F.lit("r")), seed) * most).cast("int")
    first = F.greatest(F.lit(0), start - left)
    return F.substring(s, first + 1, F.least(F.length(s), end + right) - first)
