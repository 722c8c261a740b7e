"""Embedding near-dedup with a pivot-permutation index.

Pivots are vectors of a bounded sample, no two of them nearer to each other than twice the angle of a link: however many rows a group of near
copies holds, few pivots lie in it, so its members have them and the pivots around in common. Each vector is described by its `nearest` pivots in order of similarity; an inverted list
holds, for a label and a pivot, all vectors described by it. Vectors of one list that share at least `shared` pivots are candidates,
and candidates are verified by cosine in double precision. A pair is counted in the list of the least pivot it shares, so once.

Equal vectors of a label are one class first, so any number of copies costs one entry. Lists are cut into tiles of TILE entries and every
pair of tiles is a piece of work of its own, so a list of any length is spread. A piece returns one row per entry, its number of links and the
least entry linked with it within the piece, never the pairs.

Vectors that are null, zero, or hold null or non-finite components, and vectors without label, link with nothing and are a
component each. Vectors of different lengths are never compared. Rows with one vec_id count each. A cosine of just the threshold links; of pivots
equally near the first counts. An empty table gives an empty result. Extra columns are ignored.

The index is approximate: a linked pair that shares fewer than `shared` of its nearest pivots is missed. The tests measure recall
against brute force.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phrasewell.llm._components import components
from phrasewell.llm._shared import materialize, table

COSINE, NEAREST, SHARED = 0.93, 10, 2
#: Pivots: at most PER_ROOT times the root of the number of vectors, within these bounds; they are broadcast.
PER_ROOT, LEAST_PIVOTS, MOST_PIVOTS = 2, 16, 4096
#: Pivots are chosen among so many times their number of sampled vectors.
SAMPLED = 4
TILE = 512


def _parsed(vectors: DataFrame) -> tuple[DataFrame, type]:
    """vec_id, label and vec, the bytes of the vector, null where it can't be compared; the type of its components."""
    kind = np.float32 if isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else np.float64

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for v in b.column(2):
                x = v.as_py() if v.is_valid else None
                a = None if x is None or None in x else np.asarray(x, kind)
                out.append(a.tobytes() if a is not None and len(a) and np.isfinite(a).all() and a.any() else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["vec_id", "label", "vec"])

    types = {c: vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    return vectors.select("vec_id", "label", "embedding").mapInArrow(work, f"vec_id {types['vec_id']}, label {types['label']}, vec binary"), kind


def _unit(blobs: list[bytes], kind) -> np.ndarray:
    x = np.stack([np.frombuffer(b, kind) for b in blobs]).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _spread(sample: np.ndarray, most: int, cosine: float) -> np.ndarray:
    """At most `most` unit vectors of the sample, in its order, no two of them within twice the angle that `cosine` is of."""
    near = 2 * cosine * cosine - 1
    held = sample[:0]
    for at in range(0, len(sample), 256):
        block = sample[at : at + 256]
        block = block[(block @ held.T < near).all(axis=1)]
        close, taken = block @ block.T >= near, []
        for i in range(len(block)):
            if not close[i, taken].any():
                taken.append(i)
        held = np.concatenate([held, block[taken]])
        if len(held) >= most:
            break
    return held[:most]


def _described(classes: DataFrame, pivots: dict[int, np.ndarray], kind, nearest: int) -> DataFrame:
    """Adds perm: the places of the nearest pivots of the vector's length, the nearest first."""
    shared = classes.sparkSession.sparkContext.broadcast(pivots)  # at most MOST_PIVOTS vectors

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blobs = b.column("vec").to_pylist()
            perm: list = [[-1]] * len(blobs)
            for size in {len(x) for x in blobs}:
                at = [i for i, x in enumerate(blobs) if len(x) == size]
                if size not in shared.value:
                    continue  # no pivot of this length: one list for all of them
                sim = _unit([blobs[i] for i in at], kind) @ shared.value[size].T
                for i, row in zip(at, np.argsort(-sim, axis=1, kind="stable")[:, :nearest].tolist(), strict=True):
                    perm[i] = row
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(perm, pa.list_(pa.int32()))], [*b.schema.names, "perm"])

    return classes.mapInArrow(work, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema.fields) + ", perm array<int>")


def _pieces(entries: DataFrame, kind, cosine: float, shared: int, pieces: int) -> DataFrame:
    """(rid, links, least): per piece and entry its links (weighted by class size) and the least entry connected to it there."""
    lists = entries.withColumn("pivot", F.explode("perm")).withColumn("len", F.octet_length("vec"))
    sizes = lists.groupBy("label", "len", "pivot").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles")).withColumnsRenamed({"label": "_l", "len": "_n", "pivot": "_p"})
    lists = lists.join(sizes, (F.col("label") == F.col("_l")) & (F.col("len") == F.col("_n")) & (F.col("pivot") == F.col("_p")))
    lists = lists.withColumn("tile", F.pmod(F.xxhash64("rid"), "tiles").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    lists = lists.withColumns({"t1": F.least("tile", "other"), "t2": F.greatest("tile", "other")})
    lists = lists.withColumn("list", F.xxhash64("label", "len", "pivot")).withColumn("bucket", F.pmod(F.xxhash64("list", "t1", "t2"), F.lit(pieces)).cast("int"))

    def work(t: pa.Table) -> pa.Table:
        cols = {c: np.asarray(t[c].to_pylist(), np.int64) for c in ("list", "pivot", "t1", "t2", "tile", "rid", "size", "len")}
        blobs, perms = t["vec"].to_pylist(), t["perm"].to_pylist()
        order = np.lexsort((cols["rid"], cols["t2"], cols["t1"], cols["pivot"], cols["len"], cols["list"]))
        edge = np.zeros(max(0, len(order) - 1), bool)
        for c in ("list", "len", "pivot", "t1", "t2"):
            edge |= np.diff(cols[c][order]) != 0
        out: list[tuple] = []
        for g in np.split(order, np.flatnonzero(edge) + 1):
            one, two = g[cols["tile"][g] == cols["t1"][g]], g[cols["tile"][g] == cols["t2"][g]]
            same = cols["t1"][g[0]] == cols["t2"][g[0]]
            if not len(one) or not len(two) or (same and len(one) < 2):
                continue
            every = one if same else np.concatenate([one, two])
            ids, back = np.unique(np.concatenate([perms[i] for i in every]), return_inverse=True)
            hot = np.zeros((len(every), len(ids)), np.float32)
            hot[np.repeat(np.arange(len(every)), [len(perms[i]) for i in every]), back] = 1
            h1, h2 = hot[: len(one)], hot if same else hot[len(one) :]
            # Retrieval: enough shared pivots, and this list's pivot is the least of them.
            low = ids < cols["pivot"][g[0]]
            need = min(shared, *(len(perms[i]) for i in (every[0], every[-1])))
            ok = (h1 @ h2.T >= need) & (h1[:, low] @ h2[:, low].T == 0)
            if same:
                np.fill_diagonal(ok, False)
            if not ok.any():
                continue
            # Verification.
            x1 = _unit([blobs[i] for i in one], kind)
            ok &= x1 @ (x1 if same else _unit([blobs[i] for i in two], kind)).T >= cosine
            if not ok.any():
                continue
            r1, r2, s1, s2 = cols["rid"][one], cols["rid"][two], cols["size"][one], cols["size"][two]
            most = np.iinfo(np.int64).max
            l1, l2 = r1.copy(), r2.copy()
            while True:  # least label within the piece
                n1 = np.minimum(l1, np.where(ok, l2[None, :], most).min(axis=1))
                n2 = n1 if same else np.minimum(l2, np.where(ok, n1[:, None], most).min(axis=0))
                if (n1 == l1).all() and (n2 == l2).all():
                    break
                l1, l2 = n1, n2
            hit = ok.any(axis=1)
            out += zip(r1[hit].tolist(), (ok @ s2)[hit].tolist(), l1[hit].tolist(), strict=True)
            if not same:
                hit = ok.any(axis=0)
                out += zip(r2[hit].tolist(), (s1 @ ok)[hit].tolist(), l2[hit].tolist(), strict=True)
        return pa.table({k: pa.array([x[i] for x in out], pa.int64()) for i, k in enumerate(("rid", "links", "least"))})

    return lists.select("bucket", "list", "len", "pivot", "t1", "t2", "tile", "rid", "size", "perm", "vec").groupBy("bucket").applyInArrow(work, "rid long, links long, least long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, nearest: int = NEAREST, shared: int = SHARED) -> DataFrame:
    """One row per row of vectors(vec_id, embedding, label): vec_id, n_links, component_id and kept."""
    rows, kind = _parsed(vectors)
    rows = materialize(rows)
    usable = F.col("label").isNotNull() & F.col("vec").isNotNull()
    classes = rows.where(usable).groupBy("label", "vec").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("size"))
    classes = materialize(classes.withColumn("rid", F.monotonically_increasing_id()))
    count = classes.count()
    wanted = int(min(MOST_PIVOTS, max(LEAST_PIVOTS, PER_ROOT * count**0.5)))
    sample = [r[0] for r in classes.select("vec", F.xxhash64("vec").alias("h")).distinct().orderBy("h", "vec").limit(wanted * SAMPLED).select("vec").collect()]
    pivots = {}
    for n in {len(x) for x in sample}:
        own = [x for x in sample if len(x) == n]
        pivots[n] = _spread(_unit(own, kind), -(-wanted * len(own) // len(sample)), cosine)
    entries = materialize(_described(classes.select("rid", "label", "size", "vec"), pivots, kind, nearest))
    found = materialize(_pieces(entries, kind, cosine, shared, max(64, count * nearest // 4000)))
    links = found.groupBy("rid").agg(F.sum("links").alias("links"))
    comps = components(found.select(F.col("rid").alias("u"), F.col("least").alias("v")))
    named = classes.select("label", "vec", "rid", "size", "least_id").join(links, "rid", "left").join(comps.withColumnRenamed("node", "rid"), "rid", "left")
    named = named.withColumn("comp", F.coalesce("comp", "rid"))
    named = named.join(named.groupBy("comp").agg(F.min("least_id").alias("component_id")), "comp")
    named = named.select("label", "vec", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), "component_id")
    out = rows.where(usable).join(named, ["label", "vec"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = r"""
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e,
         label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
           AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
           AND list_bool_or(list_transform(embedding, lambda x: x <> 0)) AS ok
  FROM embeddings),
l AS (
  SELECT a.r AS a, b.r AS b, b.vec_id AS bid FROM v a JOIN v b ON a.ok AND b.ok AND a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT r AS a, r AS b FROM v UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
comp AS (SELECT reach.a AS r, min(v.vec_id) AS component_id FROM reach JOIN v ON reach.b = v.r GROUP BY reach.a),
deg AS (SELECT a AS r, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v JOIN comp USING (r) LEFT JOIN deg USING (r)
"""
