"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Among all document rates 0 <= w_i <= 3 that meet the token constraint of each source, sum(w_i * size_i) = target, entropy balancing
takes those nearest to 1 in Kullback-Leibler divergence, each document alike. Its dual is convex and its solution tilts
every document's rate exponentially by its size: w_i = min(3, exp(lambda_source * size_i / mean size of the source)). Newton's
steps run for all sources side by side: each sums the dual's gradient and Hessian over all documents (a histogram of sizes per source
says as much and is summed instead) and moves each source's lambda, held between bounds that close in on the root. A few
steps at a time are written to the shared folder, until the gradients vanish.

Rounding: each document gets floor(rate) copies. What is left of its rate is its chance of one more: a pseudo-random number in
[0, 1) (md5 of doc_id) less that chance puts the documents of a source in order, and the first ones get it as far as the source's token
budget goes; the document at the boundary is taken in part. So taken words meet the target to a word and no document exceeds
its bound. The order's running sums are made over 4096 ranges of each source; only the one range in which a source's
budget ends is ordered row by row, so that a source with most of the rows is never in one task.

Documents of one length in a source have one rate. Equal places in the order go by size, then doc_id. Very long texts have large sizes and nothing else.
Null sources are a group of their own, ranked last. Null or empty texts have size 0 and are taken 0 times. Repeated rows count
each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phrasewell.llm._shared import SPACE_WORD, materialize, table

WEIGHTS = (5, 2, 1)
CAP = 3
#: Newton's steps at most, so many of them in a job, and the gradient, as a share of the target, at which they end.
NEWTON_STEPS, STEPS_IN_JOB, ENOUGH = 60, 4, 1e-11
#: At most so many sources (one row each) are broadcast to the documents.
BROADCAST_SOURCES = 100_000
#: Rates have so many steps to a copy.
RATE_STEPS = 1_000_000
#: The order has 60 bits of the hash, and one more as chances are taken off; the top 12 bits name a range.
RANGE_BITS, ORDER_BITS = 12, 60


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and the document's place in the fixed order."""
    return docs.select(
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(SPACE_WORD)), F.lit(0)).cast("long").alias("size"),
        F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long").alias("_at"),
    )


def targets(source_sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """source, source_size -> the same with target: shares by weight, none above cap times its source's size.

    Filling up by weight with ceilings has a closed form: sort by ceiling / weight; the sources whose ceiling is
    below the level that the rest would get stop there. One row per source, so one task orders them.
    """
    ranked = source_sizes.withColumn("_n", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")))
    ranked = ranked.withColumn("_w", F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.col("_n") - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("_ceil", cap * F.col("source_size").cast("double"))
    by_ratio, whole = Window.orderBy(F.col("_ceil") / F.col("_w"), "_n"), Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest_w = F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    rest_t = F.sum("source_size").over(whole) - F.coalesce(F.sum("_ceil").over(before), F.lit(0.0))
    ranked = ranked.withColumn("_level", rest_t / rest_w)
    ranked = ranked.withColumn("_free", F.col("_ceil") > F.col("_w") * F.col("_level"))
    first = F.min(F.when(F.col("_free"), F.struct((F.col("_ceil") / F.col("_w")).alias("r"), "_n", "_level"))).over(whole)
    ranked = ranked.withColumn("_level", first["_level"])
    return ranked.select("source", "source_size", F.when(F.col("_level").isNull(), F.col("_ceil")).otherwise(F.least("_ceil", F.col("_w") * F.col("_level"))).alias("target"))


def _met(rows: DataFrame, per_source: DataFrame, few: bool) -> DataFrame:
    """rows with the columns of their source's row."""
    per_source = per_source.withColumnRenamed("source", "_s")
    return rows.join(F.broadcast(per_source) if few else per_source, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")


def _tilted(lam: Column, scaled: Column) -> Column:
    return F.least(F.lit(float(CAP)), F.exp(lam * scaled))


def _step(state: DataFrame, sizes: DataFrame, few: bool) -> DataFrame:
    """One Newton step of every source, on the logarithm of the constraint; where it leaves the bounds, the middle between them."""
    x = F.col("size") * F.col("_scale")
    free = F.col("lambda") * x < math.log(CAP)
    rows = _met(sizes, state, few).withColumns({"_w": F.col("_n") * F.col("size") * _tilted(F.col("lambda"), x), "_free": free, "_x": x})
    keep = ("source_size", "target", "_scale", "_lo", "_hi", "lambda")
    out = rows.groupBy("source").agg(*[F.first(c).alias(c) for c in keep], F.sum("_w").alias("_sum"), F.sum(F.when(F.col("_free"), F.col("_w") * F.col("_x")).otherwise(0.0)).alias("_slope"))
    gap = F.col("_sum") / F.col("target") - 1
    out = out.withColumns({"gradient": gap, "_lo": F.when(gap < 0, F.col("lambda")).otherwise(F.col("_lo")), "_hi": F.when(gap > 0, F.col("lambda")).otherwise(F.col("_hi"))})
    to = F.col("lambda") - F.log(F.col("_sum") / F.col("target")) * F.col("_sum") / F.nullif(F.col("_slope"), F.lit(0.0))
    to = F.when((to > F.col("_lo")) & (to < F.col("_hi")), to).otherwise((F.col("_lo") + F.col("_hi")) / 2)
    return out.withColumn("lambda", F.when(F.abs("gradient") <= ENOUGH, F.col("lambda")).otherwise(to)).drop("_sum", "_slope")


def rates(sizes: DataFrame, with_targets: DataFrame) -> DataFrame:
    """with_targets with lambda, the dual's solution, by Newton's method over sizes(source, size, _n), the _scale of a size in it, and the gradient left.

    lambda is null where all rates are 0 (no words, or a target of 0) or all are CAP.
    """
    spark = sizes.sparkSession
    some = sizes.where("size > 0")
    of = some.groupBy("source").agg(F.sum("_n").alias("_docs"), F.min("size").alias("_least")).withColumnRenamed("source", "_o")
    state = with_targets.join(of, F.col("source").eqNullSafe(F.col("_o"))).drop("_o")
    state = state.where((F.col("target") > 0) & (F.col("target") < CAP * F.col("source_size") * (1 - 1e-12)))
    state = state.withColumn("_scale", F.col("_docs") / F.col("source_size")).withColumn("_x", F.col("_least") * F.col("_scale"))
    # The shortest document's rate bounds all others': that gives bounds of the root.
    share = F.log(F.col("target") / F.col("source_size"))
    state = state.withColumns({"_lo": F.least(F.lit(0.0), share / F.col("_x")), "_hi": F.when(share > 0, F.log(F.lit(float(CAP))) / F.col("_x")).otherwise(F.lit(0.0))})
    state = state.select("source", "source_size", "target", "_scale", "_lo", "_hi", F.when(share > 0, F.least(share, F.col("_hi"))).otherwise(F.greatest(share, F.col("_lo"))).alias("lambda"), F.lit(1.0).alias("gradient"))
    few = state.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    for _ in range(0, NEWTON_STEPS, STEPS_IN_JOB):
        for _ in range(STEPS_IN_JOB):
            state = _step(state, some, few)
        state = materialize(state)
        if not state.where(F.abs("gradient") > ENOUGH).limit(1).count():
            break
    solved = state.select(F.col("source").alias("_s"), "lambda", "_scale", "gradient")
    return with_targets.join(F.broadcast(solved) if few else solved, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")


def mix(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, rate, copies and taken."""
    sized = materialize(sizes(docs))
    counts = materialize(sized.groupBy("source", "size").agg(F.count("*").alias("_n")))
    per_source = targets(counts.groupBy("source").agg(F.sum(F.col("_n") * F.col("size")).alias("source_size")))
    per_source = materialize(rates(counts, per_source))
    few = per_source.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    whole = F.when(F.col("target") > 0, F.lit(float(CAP))).otherwise(F.lit(0.0))
    steps = F.round(F.coalesce(_tilted(F.col("lambda"), F.col("size") * F.col("_scale")), whole) * RATE_STEPS).cast("long")
    out = _met(sized, per_source, few).withColumn("_steps", F.when(F.col("size") > 0, steps).otherwise(F.lit(0).cast("long")))
    out = out.withColumns({"_base": F.floor(F.col("_steps") / RATE_STEPS), "_chance": F.col("_steps") % RATE_STEPS})
    out = out.withColumns({"_room": F.when(F.col("_base") < CAP, F.col("size")).otherwise(F.lit(0).cast("long")), "_at": F.col("_at") + F.lit(1 << ORDER_BITS) - F.col("_chance") * F.lit((1 << ORDER_BITS) // RATE_STEPS)})
    out = out.withColumn("_range", F.shiftright("_at", ORDER_BITS + 1 - RANGE_BITS))
    ranges = materialize(out.groupBy("source", "_range").agg(F.sum("_room").alias("_in"), F.sum(F.col("_base") * F.col("size")).alias("_sure")))
    need = per_source.join(ranges.groupBy(F.col("source").alias("_s")).agg(F.sum("_sure").alias("_sure")), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    need = need.select("source", F.greatest(F.lit(0), F.floor(F.col("target") + 0.500001) - F.col("_sure")).alias("_extra"))
    so_far = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    edges = _met(ranges.withColumn("_before", F.coalesce(F.sum("_in").over(so_far), F.lit(0))), need, few)
    # The range in which the source's budget runs out, and what is left of it there.
    edges = edges.where(F.col("_before") + F.col("_in") > F.col("_extra")).groupBy("source").agg(F.min_by(F.struct(F.col("_range").alias("r"), (F.col("_extra") - F.col("_before")).alias("left")), "_range").alias("_edge"))
    edges = materialize(edges).withColumnRenamed("source", "_e")
    out = out.join(F.broadcast(edges) if few else edges, F.col("source").eqNullSafe(F.col("_e")), "left").drop("_e")
    before = F.coalesce(F.col("_range") < F.col("_edge.r"), F.lit(True))
    sure = out.where(~F.col("_range").eqNullSafe(F.col("_edge.r"))).withColumn("_more", F.when(before, F.col("_room")).otherwise(F.lit(0).cast("long")))
    inside = Window.partitionBy("source").orderBy("_at", "size", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    at_edge = out.where(F.col("_range").eqNullSafe(F.col("_edge.r")))
    at_edge = at_edge.withColumn("_more", F.least(F.col("_room"), F.greatest(F.lit(0), F.col("_edge.left") - F.coalesce(F.sum("_room").over(inside), F.lit(0)))))
    out = sure.unionByName(at_edge)
    return out.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("_steps") / RATE_STEPS).alias("rate"),
        (F.col("_base") + F.when(F.col("_more") > 0, 1).otherwise(0)).cast("long").alias("copies"),
        (F.col("_base") * F.col("size") + F.col("_more")).cast("long").alias("taken"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), "taken")


SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS pos
  FROM documents),
ranked AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS n
  FROM sized GROUP BY source),
weighed AS (SELECT *, (CASE (n - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END)::DOUBLE AS w, (3 * source_size)::DOUBLE AS cap FROM ranked),
leveled AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS lev
  FROM weighed WINDOW o AS (ORDER BY cap / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
found AS (SELECT arg_min(lev, struct_pack(r := cap / w, k := n)) FILTER (cap > w * lev) AS mu FROM leveled),
targeted AS (SELECT source, source_size, CASE WHEN mu IS NULL THEN cap ELSE least(cap, w * mu) END AS target FROM weighed, found),
hist AS (SELECT source, list(struct_pack(s := size::DOUBLE, n := n::DOUBLE)) AS hs, sum(n)::DOUBLE AS docs, min(size)::DOUBLE AS least FROM (SELECT source, size, count(*) AS n FROM sized WHERE size > 0 GROUP BY source, size) GROUP BY source),
asked AS (
  SELECT t.source, hs, target, docs / source_size AS scale, ln(target / source_size) AS share, least * docs / source_size AS x
  FROM targeted t JOIN hist h ON t.source IS NOT DISTINCT FROM h.source WHERE target > 0 AND target < 3 * source_size * (1 - 1e-12)),
halved AS (
  SELECT source, hs, target, scale, least(0.0, share / x) AS lo, CASE WHEN share > 0 THEN ln(3.0) / x ELSE 0.0 END AS hi, 0 AS k FROM asked
  UNION ALL
  SELECT source, hs, target, scale, CASE WHEN low THEN (lo + hi) / 2 ELSE lo END, CASE WHEN low THEN hi ELSE (lo + hi) / 2 END, k + 1
  FROM (SELECT *, list_sum(list_transform(hs, lambda h: h.n * h.s * least(3.0, exp((lo + hi) / 2 * h.s * scale)))) < target AS low FROM halved WHERE k < 80)),
solved AS (SELECT source, scale, (lo + hi) / 2 AS lam FROM halved WHERE k = 80),
rated AS (
  SELECT s.doc_id, s.source, s.size, s.pos, t.source_size, t.target,
         CASE WHEN s.size = 0 THEN 0 WHEN lam IS NULL THEN CASE WHEN t.target > 0 THEN 3000000 ELSE 0 END ELSE round(least(3.0, exp(lam * s.size * scale)) * 1000000)::BIGINT END AS steps
  FROM sized s JOIN targeted t ON s.source IS NOT DISTINCT FROM t.source LEFT JOIN solved v ON s.source IS NOT DISTINCT FROM v.source),
based AS (
  SELECT *, steps // 1000000 AS base, CASE WHEN steps // 1000000 < 3 THEN size ELSE 0 END AS room, pos + 1152921504606846976 - (steps % 1000000) * 1152921504606 AS k FROM rated),
planned AS (SELECT source, greatest(0, floor(any_value(target) + 0.500001)::BIGINT - sum(base * size)::BIGINT) AS extra FROM based GROUP BY source),
placed AS (
  SELECT *, coalesce(sum(room) OVER (PARTITION BY source ORDER BY k, size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef
  FROM based)
SELECT p.doc_id, p.size, p.source_size, round(p.target, 4) AS target,
       (p.base * p.size + least(p.room, greatest(0, q.extra - p.bef)))::BIGINT AS taken
FROM placed p JOIN planned q ON p.source IS NOT DISTINCT FROM q.source
"""
