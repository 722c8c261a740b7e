"""Vector index: norms, ordinals, quantisers, cells, maintenance."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phrasewell.functions import vectors as V
from phrasewell.sources import io as IO

#: So many centroids are broadcast at once.
CELLS_AT_ONCE = 1 << 16


def max_norm(words: DataFrame, coefficient: float = 1.3, vec: str = "start") -> DataFrame:
    return words.agg((F.max(V.norm(F.col(vec))) * coefficient).alias("max_norm"))


def within_norm(words: DataFrame, threshold: float, vec: str = "start") -> DataFrame:
    return words.withColumn("norm", V.norm(F.col(vec))).where(F.col("norm") <= threshold)


def ordinals(words: DataFrame, offset: int, per_range: int = 1000) -> DataFrame:
    """ordinal: the place in (doc_idx, word_idx) order plus an offset, from counts per range of documents and places within it."""
    words = words.withColumn("_range", F.floor(F.col("doc_idx") / per_range))
    sizes = words.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_range", before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy("doc_idx", "word_idx")) - 1
    return words.withColumn("_at", inside).join(starts, "_range").withColumn("ordinal", (F.col("_at") + F.col("_before") + offset).cast("long")).drop("_range", "_at", "_before")


def lookup(asked: DataFrame, numbered: DataFrame) -> DataFrame:
    return asked.join(numbered, "ordinal")


def label_centroids(words: DataFrame, vec: str = "start") -> DataFrame:
    """One centroid per label: the vector of its least word_id. Deterministic, so other engines can replay it."""
    return words.groupBy("label").agg(F.min_by(vec, "word_id").alias("centroid")).withColumnRenamed("label", "cluster_id")


def _matrix(centroids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and vectors of centroids: at most CELLS_AT_ONCE rows."""
    rows = sorted((r[0], list(r[1])) for r in centroids.select("cluster_id", "centroid").collect())
    return np.asarray([r[0] for r in rows], np.int64), np.asarray([r[1] for r in rows], np.float64).reshape(len(rows), -1)


def _nearest(x: np.ndarray, ids: np.ndarray, c: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances and numbers of the n nearest centroids of each row, the first of equal ones first."""
    n = min(n, len(ids))
    d, i = np.empty((len(x), n)), np.empty((len(x), n), np.int64)
    step = max(1, 4_000_000 // max(1, c.size))
    for lo in range(0, len(x), step):
        gap = ((x[lo : lo + step, None, :] - c[None, :, :]) ** 2).sum(axis=2)
        order = np.argsort(gap, axis=1, kind="stable")[:, :n]
        d[lo : lo + step], i[lo : lo + step] = np.take_along_axis(gap, order, 1), ids[order]
    return d, i


def _near(shared: Broadcast, n: int) -> Callable:
    @F.pandas_udf("array<struct<d:double,id:long>>")
    def near(v: pd.Series) -> pd.Series:
        ids, c = shared.value
        there = v.notna().to_numpy()
        found: list = [None] * len(v)
        if there.any() and len(ids):
            d, i = _nearest(np.asarray([np.asarray(x, np.float64) for x in v[there]]), ids, c, n)
            for k, a, b in zip(np.flatnonzero(there), d.tolist(), i.tolist(), strict=True):
                found[k] = [{"d": x, "id": y} for x, y in zip(a, b, strict=True)]
        return pd.Series(found)

    return near


def nearest_cells(vectors: DataFrame, centroids: DataFrame, vec: str, n: int = 1) -> DataFrame:
    """vectors with cells: the n nearest cells by distance, the first of equal ones first.

    Centroids are broadcast as a matrix. More than CELLS_AT_ONCE of them (counted) are broadcast block by block, each of which adds its n nearest to a pass over the vectors.
    """
    count = centroids.count()
    spark = vectors.sparkSession
    if count <= CELLS_AT_ONCE:
        blocks = [centroids]
    else:
        parts = -(-count // CELLS_AT_ONCE) + 1
        blocks = [centroids.where(F.pmod(F.xxhash64("cluster_id"), F.lit(parts)) == p) for p in range(parts)]
    out = vectors
    for at, block in enumerate(blocks):
        out = out.withColumn(f"_near{at}", _near(spark.sparkContext.broadcast(_matrix(block)), n)(vec))
    best = F.array_sort(F.concat(*[F.coalesce(f"_near{i}", F.expr("cast(array() as array<struct<d:double,id:long>>)")) for i in range(len(blocks))]))
    return out.withColumn("cells", F.transform(F.slice(best, 1, n), lambda x: x.id)).drop(*[f"_near{i}" for i in range(len(blocks))])


def kmeans_centroids(words: DataFrame, k: int, steps: int = 10, seed: int = 29, vec: str = "start", key: str = "word_id") -> DataFrame:
    """Centroids of k cells by Lloyd's steps from k vectors of distinct keys with the least hash: the same wherever they run.

    Each step broadcasts the k centroids and sums vectors per cell in every partition before k rows a partition are combined. A cell without vectors keeps its place.
    """
    spark = words.sparkSession
    first = words.where(F.col(vec).isNotNull()).select(key, vec).withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))).orderBy("_h", key).limit(k)
    c = np.asarray([list(r[1]) for r in first.orderBy("_h", key).select("_h", vec).collect()], np.float64)
    rows = words.where(F.col(vec).isNotNull()).select(vec)
    for _ in range(steps if len(c) else 0):
        shared = spark.sparkContext.broadcast(c)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centroids = shared.value
            total, held = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
            for b in batches:
                if len(b):
                    x = np.asarray(b.column(0).flatten(), np.float64).reshape(len(b), -1)
                    cell = _nearest(x, np.arange(len(centroids)), centroids, 1)[1][:, 0]
                    np.add.at(total, cell, x)
                    held += np.bincount(cell, minlength=len(centroids))
            some = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some].tolist(), pa.list_(pa.float64())), pa.array(held[some], pa.int64())], ["cell", "total", "held"])

        size = c.shape[1]
        found = rows.mapInArrow(sums, "cell long, total array<double>, held long").groupBy("cell").agg(*[F.sum(F.col("total")[i]).alias(f"s{i}") for i in range(size)], F.sum("held").alias("held"))
        new = c.copy()
        for r in found.collect():  # k rows
            new[r["cell"]] = np.asarray([r[f"s{i}"] for i in range(size)]) / r["held"]
        if np.array_equal(new, c):
            break
        c = new
    return spark.createDataFrame([(i, v) for i, v in enumerate(c.tolist())], "cluster_id int, centroid array<double>")


def assign(words: DataFrame, centroids: DataFrame, vec: str = "start") -> DataFrame:
    return nearest_cells(words, centroids, vec).withColumn("cluster_id", F.col("cells")[0].cast(centroids.schema["cluster_id"].dataType)).drop("cells")


def probe(questions: DataFrame, centroids: DataFrame, nprobe: int, vec: str = "q_start") -> DataFrame:
    return nearest_cells(questions, centroids, vec, nprobe).withColumn("cluster_id", F.explode(F.col("cells").cast(f"array<{centroids.schema['cluster_id'].dataType.simpleString()}>"))).drop("cells")


def scalar_ranges(words: DataFrame, dims: int, vec: str = "start") -> DataFrame:
    """Per dimension its least and greatest value."""
    return words.agg(*[f(F.col(vec)[i]).alias(f"{n}{i}") for i in range(dims) for n, f in (("lo", F.min), ("hi", F.max))])


def scalar_codes(words: DataFrame, dims: int, vec: str = "start", ranges: DataFrame | None = None) -> DataFrame:
    """One byte per dimension, by its range over all words (or by given ranges, which the codes of one index share)."""
    r = scalar_ranges(words, dims, vec) if ranges is None else ranges
    part = lambda i: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(vec)[i] - F.col(f"lo{i}")) / (F.col(f"hi{i}") - F.col(f"lo{i}"))))
    code = [F.floor(F.when(F.col(f"hi{i}") > F.col(f"lo{i}"), part(i) * 255).otherwise(0.0) + 0.5).cast("int") for i in range(dims)]
    return words.crossJoin(F.broadcast(r)).withColumn("codes", F.array(*code)).drop(*r.columns)


def from_codes(words: DataFrame, dims: int, ranges: DataFrame, codes: str = "codes") -> DataFrame:
    """words with `decoded`: the vectors that their codes stand for."""
    value = [F.col(f"lo{i}") + F.col(codes)[i] / 255.0 * (F.col(f"hi{i}") - F.col(f"lo{i}")) for i in range(dims)]
    return words.crossJoin(F.broadcast(ranges)).withColumn("decoded", F.array(*value)).drop(*ranges.columns)


def product_codes(words: DataFrame, parts: int, k: int, seed: int = 29, vec: str = "start", dims: int = 24) -> DataFrame:
    """A code of `parts` cell numbers: k-means of its own for each part of the vector."""
    size = dims // parts
    for p in range(parts):
        piece = words.withColumn("_piece", F.slice(vec, p * size + 1, size))
        words = assign(piece, kmeans_centroids(piece, k, seed=seed, vec="_piece"), "_piece").withColumnRenamed("cluster_id", f"_c{p}").drop("_piece")
    return words.withColumn("codes", F.array(*[f"_c{p}" for p in range(parts)])).drop(*[f"_c{p}" for p in range(parts)])


def quantizer(name: str) -> str:
    """Checks the name of a fine quantiser; four-bit scalar codes were never supported."""
    if name == "SQ8" or (name.startswith("PQ") and name[2:].isdigit()):
        return name
    raise ValueError(f"unsupported fine quantizer {name}")


def over_represented(hits: DataFrame, ratio: float) -> DataFrame:
    """Documents with more than ratio of all hits."""
    total = hits.agg(F.sum("count").alias("_total"))
    return hits.crossJoin(F.broadcast(total)).where(F.col("count") > ratio * F.col("_total")).drop("_total")


def without(words: DataFrame, ids: DataFrame) -> DataFrame:
    return words.join(ids.select("doc_idx").distinct(), "doc_idx", "left_anti")


STAGES = ("coarse", "fine", "add", "merge", "move")


def build(words: DataFrame, path: str, centroids: DataFrame | None = None, stage: str = "all", vec: str = "start", dims: int | None = None, shard: str = "0", target: str | None = None, cells: int = 64, keys: tuple[str, ...] = ("doc_idx", "word_idx")) -> None:
    """An index under path, in stages, each of which leaves what is there as it is:

    coarse: centroids, given or by k-means. fine: the ranges of the 8-bit codes. add: the words with their cell and codes as shard `shard`,
    partitioned by cell. merge: all shards as one index, partitioned by cell. move: the index to `target`. all: each of them (move only with a
    target). Words keep their keys; par_idx among them is the paragraph mode. A build in batches adds a shard for each.
    """
    spark = words.sparkSession
    if stage != "all" and stage not in STAGES:
        raise ValueError(f"unknown stage {stage}")
    steps = STAGES if stage == "all" else (stage,)

    def missing(name: str) -> bool:
        return not IO.exists(spark, f"{path}/{name}/_SUCCESS")

    if "coarse" in steps and missing("centroids"):
        (kmeans_centroids(words, cells, vec=vec) if centroids is None else centroids).write.mode("overwrite").parquet(f"{path}/centroids")
    if "fine" in steps and missing("ranges"):
        size = dims or words.select(F.max(F.size(vec))).collect()[0][0] or 0
        scalar_ranges(words, size, vec).write.mode("overwrite").parquet(f"{path}/ranges")
    if "add" in steps and missing(f"shards/{shard}"):
        ranges = spark.read.parquet(f"{path}/ranges")
        coded = scalar_codes(assign(words, spark.read.parquet(f"{path}/centroids"), vec), len(ranges.columns) // 2, vec, ranges)
        coded.select(*keys, "cluster_id", F.col("codes").cast("array<smallint>").alias("codes")).write.mode("overwrite").partitionBy("cluster_id").parquet(f"{path}/shards/{shard}")
    if "merge" in steps and missing("index"):
        shards = spark.read.option("recursiveFileLookup", True).parquet(f"{path}/shards").withColumn("cluster_id", F.regexp_extract("_metadata.file_path", r"cluster_id=(-?\d+)/", 1).cast("int"))
        shards.write.mode("overwrite").partitionBy("cluster_id").parquet(f"{path}/index")
    if "move" in steps and target is not None and not IO.exists(spark, target):
        IO.rename(spark, f"{path}/index", target)


def stored(spark: SparkSession, path: str, at: str | None = None) -> DataFrame:
    """The words of an index with their cell and decoded vectors; conditions on cluster_id choose the folders that are read."""
    ranges = spark.read.parquet(f"{path}/ranges")
    return from_codes(spark.read.parquet(at or f"{path}/index"), len(ranges.columns) // 2, ranges)
