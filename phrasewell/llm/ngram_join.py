"""N-gram Jaccard join by vertical partitioning of the global n-gram order.

A document's set holds the hashes of its distinct 5-word shingles. Documents with one set are one class (any number of exact
copies costs one row per document). Classes link when 7 * overlap >= 3 * (size + size), that is at a Jaccard similarity of 3/4.

The global order of n-grams is by the number of sets that hold them (copies in different chunks of texts count again), then by hash.
It is cut into fragments by hash, and each fragment counts its n-grams exactly; chunks send it their distinct n-grams once and
get back those that more than one set holds. Any order gives right results; this one keeps common passages out of the prefixes.

1. Two linked classes share one of the first n - ceil(3n/4) + 1 n-grams of their sets. Of these each class sends those that others hold to their fragments. A
   fragment joins the classes that meet in it and may link by their sizes, and sends on a forest of such edges, never pairs.
2. What these edges connect is a family; two linked classes are in one. A family's whole sets come to one place. It counts the
   overlaps of pairs fragment by fragment, sums them per pair and sends on a tree of each component of links, so that rows grow
   with a family's classes and not with its pairs.
3. A family of more than TILE classes or GRAMS n-grams is cut into tiles by size and hash: each tile is counted for itself, then against
   the tiles' best linked members, then what is outside the family's largest component against the tiles with which it shares n-grams of prefixes.
   A link inside a component changes nothing, so no link that matters is left out. Work grows with the square of a family only as
   far as its classes don't link.

Null or empty texts have an empty set and link with nothing. One to four words are one shingle. A null doc_id never names a component
but where all its members are null. Rows with one doc_id and different texts are documents of their own. Very long texts are handled whole, within a chunk, as sets of 8 bytes an
n-gram; a similarity of just 3/4 links. An empty table gives an empty result. Extra columns are ignored; `representatives` keeps all but _chunk and _row.
Hashes have 64 bits; sets are taken as equal where their 64-bit sums and sizes are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phrasewell.llm._chunks import blob, bucket_count, chunked, cut, release, texts_of
from phrasewell.llm._components import components
from phrasewell.llm._shared import materialize, table
from phrasewell.llm._vec import gram_hashes, mix64, word_hashes

GRAM = 5
#: A place counts at most so many classes and n-grams (8 bytes each) against as many; larger families are cut into tiles.
TILE, GRAMS = 1024, 1_500_000
#: Hubs of a tiled family.
HUBS = 256
#: An n-gram of so few pairs of holders is counted pair by pair; so many such pairs, and numbers of a fragment's matrices, are held at once.
FEW, PAIRS, CELLS = 256, 2_000_000, 4_000_000


def shingle_sets(texts: list[bytes | None], gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-gram hashes of each text, ascending, and the offsets of texts in them."""
    words, ends = word_hashes(texts, lower=True)
    n = np.diff(ends)
    doc = np.repeat(np.arange(len(texts)), n)
    at = np.arange(len(words)) - ends[:-1][doc] if len(words) else np.empty(0, np.int64)
    place = np.flatnonzero((at + gram <= n[doc])[: max(0, len(words) - gram + 1)])
    h, d = gram_hashes(words, gram, 4)[place], doc[place]
    if len(short := np.flatnonzero((n > 0) & (n < gram))):
        own = np.concatenate([gram_hashes(words[ends[i] : ends[i + 1]], int(n[i]), 10 + int(n[i])) for i in short])
        h, d = np.concatenate([h, own]), np.concatenate([d, short])
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[new], d[new]
    return h, np.searchsorted(d, np.arange(len(texts) + 1))


def _signatures(h: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate(([np.uint64(0)], np.cumsum(mix64(h ^ np.uint64(0x9E3779B97F4A7C15)))))
    return mix64(total[ends[1:]] - total[ends[:-1]] + np.diff(ends).astype(np.uint64)).view(np.int64)


DESCRIBED = "kind string, _row long, chunk long, doc_id long, n long, sig long, bucket int, keys binary, counts binary"


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.table({name: pa.array([r[i] for r in rows], kinds[kind]) for i, (name, kind) in enumerate(f.split() for f in schema.split(", "))})


def _short(h: np.ndarray, bits: int) -> np.ndarray:
    """The fragment (of 2 ** bits) of each hash and 32 further bits of it, in the hashes' order."""
    return h >> np.uint64(32 - bits)


def _describe(chunks: DataFrame, bits: int, gram: int) -> DataFrame:
    """Rows of kind doc (its set's size and signature; buckets below 0) and kind seen: the n-grams of the chunk's distinct sets by fragment, in how many of them each is.

    Within a fragment 32 bits name an n-gram. Where two have one name, both seem to be in more sets than they are, which changes their order and no result.
    """

    def work(t: pa.Table) -> pa.Table:
        h, ends = shingle_sets(texts_of(t["text"]), gram)
        sig, n, chunk = _signatures(h, ends), np.diff(ends), t["_chunk"][0].as_py()
        docs = pa.table({
            "kind": pa.array(["doc"] * t.num_rows), "_row": t["_row"].combine_chunks(), "chunk": t["_chunk"].combine_chunks(), "doc_id": t["doc_id"].combine_chunks().cast(pa.int64()), "n": pa.array(n, pa.int64()),
            "sig": pa.array(sig), "bucket": pa.array([-1 - (chunk + (chunk >> 32)) % (1 << bits)] * t.num_rows, pa.int32()), "keys": pa.nulls(t.num_rows, pa.binary()), "counts": pa.nulls(t.num_rows, pa.binary()),
        })
        _, first = np.unique(sig, return_index=True)
        once = np.zeros(t.num_rows, bool)
        once[first] = True
        key, count = np.unique(_short(h[np.repeat(once, n)], bits), return_counts=True)
        # Most n-grams are in one set: of the others only are places and counts told.
        seen = []
        for b, s in cut(key << np.uint64(32 - bits), 1 << bits):
            more = np.flatnonzero(count[s] > 1)
            seen.append(("seen", None, chunk, None, None, None, b, blob(key[s].astype(np.uint32)), blob(np.concatenate((more, count[s][more])).astype(np.uint32))))
        return pa.concat_tables([docs.cast(_table([], DESCRIBED).schema), _table(seen, DESCRIBED)])

    return chunks.groupBy("_chunk").applyInArrow(work, DESCRIBED)


def _counted(described: DataFrame) -> DataFrame:
    """The rows of kind doc as they are, and of kind common: those of a chunk's n-grams that several sets hold, over all chunks, with their number (copies
    in other chunks count again)."""

    def work(t: pa.Table) -> pa.Table:
        if t["bucket"][0].as_py() < 0:
            return t
        parts = [np.frombuffer(x, np.uint32) for x in t["keys"].to_pylist()]
        counts = [np.ones(len(x), np.int64) for x in parts]
        for c, x in zip(counts, t["counts"].to_pylist(), strict=True):
            at, more = np.split(np.frombuffer(x, np.uint32), 2)
            c[at] = more
        every = np.concatenate(parts)
        order = np.argsort(every, kind="stable")
        group = np.zeros(len(every), np.int64)
        group[order] = np.cumsum(np.concatenate(([True], every[order][1:] != every[order][:-1]))) - 1
        total = np.bincount(group, np.concatenate(counts)).astype(np.int64)[group]
        ends = np.cumsum([len(x) for x in parts])
        out, bucket = [], t["bucket"][0].as_py()
        for chunk, key, n in zip(t["chunk"].to_pylist(), parts, np.split(total, ends[:-1]), strict=True):
            if (some := n > 1).any():
                out.append(("common", None, chunk, None, None, None, bucket, blob(key[some]), blob(np.minimum(n[some], 2**32 - 1).astype(np.uint32))))
        return _table(out, DESCRIBED)

    return described.groupBy("bucket").applyInArrow(work, DESCRIBED)


PREFIXES = "bucket int, part long, keys binary, low binary, n binary"


def _prefixes(chunks: DataFrame, reps: DataFrame, common: DataFrame, buckets: int, bits: int, gram: int) -> DataFrame:
    """(bucket, part, keys, low, n): of the prefixes of the chunk's classes the n-grams that others hold, by fragment; _row is part << 32 | low."""
    told = reps.select("_chunk", "_row", F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("binary").alias("keys"), F.lit(None).cast("binary").alias("counts"))
    told = told.unionByName(common.select(F.col("chunk").alias("_chunk"), F.lit(None).cast("long").alias("_row"), "bucket", "keys", "counts"))

    def work(t: pa.Table, r: pa.Table) -> pa.Table:
        wanted, order = r.filter(pc.is_valid(r["_row"])), r.filter(pc.is_valid(r["keys"]))
        out: list[tuple] = []
        if t.num_rows and wanted.num_rows and order.num_rows:
            t = t.filter(pc.is_in(t["_row"], wanted["_row"].combine_chunks()))
            h, ends = shingle_sets(texts_of(t["text"]), gram)
            n = np.diff(ends)
            d = np.repeat(np.arange(t.num_rows), n)
            keys = np.concatenate([np.uint64(b << 32) | np.frombuffer(x, np.uint32).astype(np.uint64) for b, x in zip(order["bucket"].to_pylist(), order["keys"].to_pylist(), strict=True)])
            total = np.concatenate([np.frombuffer(x, np.uint32) for x in order["counts"].to_pylist()]).astype(np.int64)
            by = np.argsort(keys)
            keys, total = keys[by], total[by]
            short = _short(h, bits)
            i = np.minimum(np.searchsorted(keys, short), len(keys) - 1)
            rank = np.where(keys[i] == short, total[i], 1)
            # Alone: at their hash's place before all others, and nothing to meet. So only the others need an order.
            alone = np.bincount(d[rank == 1], minlength=t.num_rows)
            some = np.flatnonzero(rank > 1)
            some = some[np.lexsort((h[some], rank[some], d[some]))]
            h, d = h[some], d[some]
            at = np.arange(len(h)) - np.searchsorted(d, d) + alone[d]
            first = at < (n - (3 * n + 3) // 4 + 1)[d]
            h, d = h[first], d[first]
            by = np.argsort(h, kind="stable")
            h, d = h[by], d[by]
            row = np.asarray(t["_row"].to_pylist(), np.int64)
            low, size = (row & 0xFFFFFFFF).astype(np.uint32)[d], n.astype(np.uint32)[d]
            part = int(row[0] >> 32) if len(row) else 0
            out = [(b, part, blob(h[s]), blob(low[s]), blob(size[s])) for b, s in cut(h, buckets)]
        return _table(out, PREFIXES)

    return chunks.groupBy("_chunk").cogroup(told.groupBy("_chunk")).applyInArrow(work, PREFIXES)


def _entries(prefixes: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n-gram, row and size of every entry."""
    if not prefixes.num_rows:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    key = np.concatenate([np.frombuffer(x, np.uint64) for x in prefixes["keys"].to_pylist()])
    row = np.concatenate([(p << 32) | np.frombuffer(x, np.uint32).astype(np.int64) for p, x in zip(prefixes["part"].to_pylist(), prefixes["low"].to_pylist(), strict=True)])
    n = np.concatenate([np.frombuffer(x, np.uint32) for x in prefixes["n"].to_pylist()]).astype(np.int64)
    return key, row, n


def _forest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest node that links (u, v) lead to."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        old = label.copy()
        np.minimum.at(label, u, low)
        np.minimum.at(label, v, low)
        label = label[label]
        if (label == old).all():
            return label


def _stars(row: np.ndarray, label: np.ndarray) -> pa.Table:
    """(u, v): each row that isn't the root of its component, with that root."""
    away = np.flatnonzero(label != np.arange(len(row)))
    return pa.table({"u": pa.array(row[label[away]], pa.int64()), "v": pa.array(row[away], pa.int64())})


def _meet(prefixes: DataFrame) -> DataFrame:
    """(u, v): edges that join all classes of a fragment that meet in a prefix n-gram and may link by their sizes, a forest per fragment.

    Of the classes that hold an n-gram, in order of size, neighbours of possible sizes are joined; all pairs of possible sizes lie in one such run.
    """

    def work(t: pa.Table) -> pa.Table:
        key, row, n = _entries(t)
        order = np.lexsort((n, key))
        key, row, n = key[order], row[order], n[order]
        at = np.flatnonzero((key[1:] == key[:-1]) & (4 * n[:-1] >= 3 * n[1:]))
        node, ends = np.unique(np.concatenate((row[at], row[at + 1])), return_inverse=True)
        return _stars(node, _forest(ends[: len(at)], ends[len(at) :], len(node)))

    return prefixes.groupBy("bucket").applyInArrow(work, "u long, v long")


def _sets(chunks: DataFrame, members: DataFrame, gram: int) -> DataFrame:
    """(place, fam, row, n, grams): the sets of members(_chunk, _row, place, fam)."""

    def work(t: pa.Table, m: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if t.num_rows and m.num_rows:
            where = {r: (p, f) for r, p, f in zip(m["_row"].to_pylist(), m["place"].to_pylist(), m["fam"].to_pylist(), strict=True)}
            t = t.filter(pc.is_in(t["_row"], m["_row"].combine_chunks()))
            h, ends = shingle_sets(texts_of(t["text"]), gram)
            out = [(*where[row], row, int(hi - lo), blob(h[lo:hi])) for row, lo, hi in zip(t["_row"].to_pylist(), ends[:-1], ends[1:], strict=True)]
        return _table(out, SETS)

    return chunks.groupBy("_chunk").cogroup(members.groupBy("_chunk")).applyInArrow(work, SETS)


SETS = "place long, fam long, row long, n long, grams binary"


def _holders(sets: list[bytes], members: np.ndarray) -> tuple[np.ndarray, ...]:
    """The n-grams of some members, ascending; where each begins, how many hold it, and all holders, by n-gram."""
    parts = [np.frombuffer(sets[i], np.uint64) for i in members]
    h, who = np.concatenate(parts), np.repeat(np.arange(len(members)), [len(x) for x in parts])
    order = np.argsort(h, kind="stable")
    h, who = h[order], who[order]
    head = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    return h[head], head, np.diff(np.append(head, len(h))), who


def _overlaps(sets: list[bytes], left: np.ndarray, right: np.ndarray | None = None) -> np.ndarray:
    """How many n-grams each of the left members shares with each of the right ones (or of the left): partial counts, fragment by
    fragment of the order of the n-grams that may count, summed per pair. Of n-grams of few holders pairs are counted one by one, of others by products.
    """
    ga, sa, wa, ia = _holders(sets, left)
    if right is None:
        gb, sb, wb, ib = ga, sa, wa, ia
        ca = cb = np.flatnonzero(wa > 1)
    else:
        gb, sb, wb, ib = _holders(sets, right)
        _, ca, cb = np.intersect1d(ga, gb, assume_unique=True, return_indices=True)
    rows, cols = len(left), len(left) if right is None else len(right)
    total = np.zeros((rows, cols), np.int32)
    sa, wa, sb, wb = sa[ca], wa[ca], sb[cb], wb[cb]
    few = wa * wb <= FEW if rows * cols > FEW else np.zeros(len(wa), bool)
    thin = np.flatnonzero(few)
    for part in np.split(thin, np.searchsorted(np.cumsum((wa * wb)[thin]), np.arange(PAIRS, int((wa * wb)[thin].sum()), PAIRS))) if len(thin) else ():
        size = (wa * wb)[part]
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        across = np.repeat(wb[part], size)
        i, j = ia[np.repeat(sa[part], size) + at // across], ib[np.repeat(sb[part], size) + at % across]
        total += np.bincount(i * cols + j, minlength=rows * cols).reshape(rows, cols).astype(np.int32)
    wide = np.flatnonzero(~few)
    step = max(256, CELLS // (rows + cols))
    for lo in range(0, len(wide), step):
        part = wide[lo : lo + step]

        def held(starts: np.ndarray, widths: np.ndarray, who: np.ndarray, n: int) -> np.ndarray:
            m = np.zeros((n, len(part)), np.float32)
            at = np.arange(widths.sum()) - np.repeat(np.cumsum(widths) - widths, widths)
            m[who[np.repeat(starts, widths) + at], np.repeat(np.arange(len(part)), widths)] = 1
            return m

        one = held(sa[part], wa[part], ia, rows)
        two = one if right is None else held(sb[part], wb[part], ib, cols)
        total += (one @ two.T).astype(np.int32)
    return total


def _links(sets: list[bytes], n: np.ndarray, left: np.ndarray, right: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of left and right members that reach the threshold."""
    m, o = n[left], n[left if right is None else right]
    i, j = np.nonzero(7 * _overlaps(sets, left, right).astype(np.int64) >= 3 * (m[:, None] + o[None, :]))
    if right is None:
        i, j = i[i < j], j[i < j]
    return left[i], (left if right is None else right)[j]


def _whole_families(sets: DataFrame) -> DataFrame:
    """(u, v) of each family that lies in one place."""

    def work(t: pa.Table) -> pa.Table:
        fam, row, n = (t[c].to_numpy() for c in ("fam", "row", "n"))
        order = np.lexsort((row, fam))
        sets = t["grams"].to_pylist()
        found = [_links(sets, n, g) for g in np.split(order, np.flatnonzero(np.diff(fam[order])) + 1)]
        u, v = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        back = np.argsort(order)
        return _stars(row[order], _forest(back[u], back[v], len(row)))

    return sets.groupBy("place").applyInArrow(work, "u long, v long")


def _tiled_families(sets: DataFrame, tiles: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(u, v) of families of many tiles, sets(fam, band, tile, row, n, grams) with their tiles(fam, band, tiles).

    Each tile is counted for itself and names the member that links with most others. All tiles are counted with
    those hubs. What then is outside the family's largest component is counted with those tiles that hold members of which it shares
    a prefix n-gram and whose sizes may link with its own. A component inside a family stays one, so pairs inside it need no count.
    """
    key = ["fam", "band", "tile"]

    def alone(t: pa.Table) -> pa.Table:
        row, n = t["row"].to_numpy(), t["n"].to_numpy()
        order = np.argsort(row, kind="stable")
        u, v = _links(t["grams"].to_pylist(), n, order)
        back = np.argsort(order)
        tree = _stars(row[order], _forest(back[u], back[v], len(row)))
        degree = np.bincount(np.concatenate((u, v)), minlength=len(row))
        best = int(np.argmax(degree))
        hub = pa.table({"u": pa.array([int(row[best])], pa.int64()), "v": pa.array([int(row[best])], pa.int64())})
        degrees = pa.array([None] * tree.num_rows + [int(degree[best])], pa.int64())
        return pa.concat_tables([tree, hub]).append_column("degree", degrees)

    def both(t: pa.Table, m: pa.Table) -> pa.Table:
        """t: a tile's sets; m: (row, comp) of its members, and others with their sets, to be counted against them."""
        told = m.filter(pc.is_null(m["grams"]))
        named = dict(zip(told["row"].to_pylist(), told["comp"].to_pylist(), strict=True))
        other = m.filter(pc.is_valid(m["grams"]))
        if not t.num_rows or not other.num_rows:
            return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
        row = np.concatenate((t["row"].to_numpy(), other["row"].to_numpy()))
        n = np.concatenate((t["n"].to_numpy(), other["n"].to_numpy()))
        comp = np.concatenate((np.asarray([named[r] for r in t["row"].to_pylist()], np.int64), other["comp"].to_numpy()))
        at = np.arange(len(row))
        i, j = _links(t["grams"].to_pylist() + other["grams"].to_pylist(), n, at[: t.num_rows], at[t.num_rows :])
        _, first, label = np.unique(comp, return_index=True, return_inverse=True)
        tree = _forest(label[i], label[j], len(first))
        away = np.flatnonzero(tree != np.arange(len(tree)))
        return pa.table({"u": pa.array(row[first[tree[away]]], pa.int64()), "v": pa.array(row[first[away]], pa.int64())})

    ids = sets.select(*key, "row", "n")
    none = F.lit(None).cast("binary").alias("grams")

    def labelled(links: DataFrame) -> DataFrame:
        comps = components(links).withColumnRenamed("node", "row")
        return materialize(ids.join(comps, "row", "left").withColumn("comp", F.coalesce("comp", "row")))

    found = materialize(sets.groupBy(*key).applyInArrow(alone, "u long, v long, degree long"))
    links = found.where("degree is null").select("u", "v")
    known = labelled(links)
    # Hubs are those of the tiles' best linked members that fit a place; which they are decides nothing but the work that is left.
    order = Window.partitionBy("fam").orderBy(F.desc("degree"), "row")
    hubs = known.join(found.where("degree is not null").select(F.col("u").alias("row"), "degree"), "row").withColumns({"_k": F.row_number().over(order), "_g": F.sum("n").over(order)})
    hubs = materialize(hubs.where((F.col("_k") <= HUBS) & ((F.col("_k") == 1) | (F.col("_g") <= GRAMS))).select("row", "comp").join(sets, "row").select("fam", "row", "n", "comp", "grams"))
    spread = tiles.select("fam", "band", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
    met = known.select(*key, "row", "n", "comp", none).unionByName(hubs.join(spread, "fam").select(*key, "row", "n", "comp", "grams"))
    links = links.unionByName(materialize(sets.groupBy(*key).cogroup(met.groupBy(*key)).applyInArrow(both, "u long, v long")))
    known = labelled(links)
    main = known.groupBy("fam", "comp").count().groupBy("fam").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"))
    rest = known.join(main, "fam").where("comp <> main").select("row", "comp")
    rest = materialize(sets.join(rest, "row"))
    if not rest.limit(1).count():
        return links

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gram, row, _ = _entries(b)
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(row, pa.int64())], ["gram", "row"])

    held = materialize(prefixes.mapInArrow(listed, "gram long, row long").join(ids, "row").select("gram", "row", *key))
    holding = held.select("gram", *key).distinct()
    near = F.abs(F.col("band") - F.col("from_band")) <= 1
    asked = held.join(rest.select("row"), "row").select("gram", "row", "fam", F.col("band").alias("from_band")).join(holding, ["gram", "fam"]).where(near).select("row", *key).distinct()
    asked = rest.select("row", "n", "comp", "grams").join(asked, "row")
    parts = asked.groupBy(*key).agg(F.count("*").alias("members"), F.sum("n").alias("grams")).select(*key, _tiles_of(F.col("members"), F.col("grams")).alias("parts"))
    parts = materialize(parts)
    keys = [*key, "part"]

    def told(rows: DataFrame) -> DataFrame:
        return rows.join(parts, key).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    asked = asked.join(parts, key).withColumn("part", F.pmod(F.xxhash64("row", F.lit(1)), "parts").cast("int"))
    met = told(known).select(*keys, "row", "n", "comp", none).unionByName(asked.select(*keys, "row", "n", "comp", "grams"))
    return links.unionByName(materialize(told(sets).groupBy(*keys).cogroup(met.groupBy(*keys)).applyInArrow(both, "u long, v long")))


def _tiles_of(members, grams):
    """How many tiles hold so many members and n-grams: some less than TILE and GRAMS each, as they are dealt by hash."""
    return F.greatest(F.ceil(members / (0.8 * TILE)), F.ceil(grams / (0.8 * GRAMS))).cast("int")


def _connected(chunks: DataFrame, classes: DataFrame, prefixes: DataFrame, gram: int) -> DataFrame:
    """(node, comp) of the classes that link: every family, which the edges of prefixes join, is counted whole."""
    families = components(_meet(prefixes)).select(F.col("node").alias("rep"), F.col("comp").alias("fam"))
    members = materialize(families.join(classes.select("rep", "chunk", "n"), "rep"))
    sizes = members.groupBy("fam").agg(F.count("*").alias("members"), F.sum("n").alias("grams"))
    sizes = materialize(sizes.withColumn("whole", (F.col("members") <= TILE) & (F.col("grams") <= GRAMS)))
    total = sizes.where("whole").agg(F.sum("grams")).collect()[0][0] or 0
    places = max(64, -(-total // GRAMS))
    picked = members.join(sizes, "fam").withColumnsRenamed({"rep": "_row", "chunk": "_chunk"})
    small = picked.where("whole").select("_chunk", "_row", F.pmod(F.xxhash64("fam"), F.lit(places)).alias("place"), "fam")
    links = materialize(_whole_families(_sets(chunks, small, gram)))
    comps = links.select(F.col("v").alias("node"), F.col("u").alias("comp")).unionByName(links.select(F.col("u").alias("node"), F.col("u").alias("comp")).distinct())
    if not sizes.where("not whole").limit(1).count():
        return comps
    # Sizes that may link are at most one band apart.
    large = picked.where("not whole").withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.35))).cast("int"))
    tiles = materialize(large.groupBy("fam", "band").agg(F.count("*").alias("members"), F.sum("n").alias("grams")).select("fam", "band", _tiles_of(F.col("members"), F.col("grams")).alias("tiles")))
    large = large.join(tiles, ["fam", "band"]).withColumn("tile", F.pmod(F.xxhash64("_row"), "tiles").cast("int"))
    place = F.shiftleft(F.col("band").cast("long"), 32) + F.col("tile")
    sets = materialize(_sets(chunks, large.select("_chunk", "_row", place.alias("place"), "fam"), gram))
    sets = sets.withColumns({"band": F.shiftright("place", 32).cast("int"), "tile": F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")}).drop("place")
    return comps.unionByName(components(_tiled_families(sets, tiles, prefixes)))


def _classified(docs: DataFrame, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """The chunks of docs, and for each of their rows _row, _chunk, doc_id, n_shingles, component_id and kept (one row of each component)."""
    chunks = chunked(docs.drop("_chunk", "_row"))
    size = (chunks.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0) // 7
    bits = (bucket_count(size) - 1).bit_length()
    described = materialize(_counted(_describe(chunks, bits, gram)))
    release(docs)
    rows = described.where("kind = 'doc'").select("_row", "chunk", "doc_id", "n", "sig")
    first = F.min_by(F.struct(F.col("_row").alias("rep"), "chunk"), F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))
    classes = materialize(rows.where("n > 0").groupBy("sig", "n").agg(first.alias("f"), F.min("doc_id").alias("least")).select("sig", "n", "f.rep", "f.chunk", "least"))
    reps = classes.select(F.col("rep").alias("_row"), F.col("chunk").alias("_chunk"))
    common = described.where("kind = 'common'").select("chunk", "bucket", "keys", "counts")
    prefixes = materialize(_prefixes(chunks, reps, common, bucket_count(size // 16), bits, gram))
    release(docs)
    comps = _connected(chunks, classes, prefixes, gram)
    named = classes.join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    first = F.min_by("rep", F.struct(F.col("least").isNull(), "least", "rep"))
    named = named.join(named.groupBy("comp").agg(F.min("least").alias("component_id"), first.alias("stays")), "comp").select("sig", "n", "component_id", "stays")
    out = rows.join(named, ["sig", "n"], "left")
    some = F.col("n") > 0
    return chunks, out.select(
        "_row",
        F.col("chunk").alias("_chunk"),
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(some, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(some, F.col("_row") == F.col("stays")).otherwise(F.lit(True)).alias("kept"),
    )


def join(docs: DataFrame, gram: int = GRAM) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_shingles, component_id and kept, true for one row of each component."""
    return _classified(docs.select("doc_id", "text"), gram)[1].drop("_row", "_chunk")


def representatives(docs: DataFrame, gram: int = GRAM) -> DataFrame:
    """The rows of docs(doc_id, text, ...) of which one per component stays; documents without words all stay."""
    chunks, rows = _classified(docs, gram)
    names = [c for c in docs.columns if c not in ("_chunk", "_row")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in names)

    def work(t: pa.Table, r: pa.Table) -> pa.Table:
        return t.filter(pc.is_in(t["_row"], r["_row"].combine_chunks())).select(names)

    kept = rows.where("kept").select("_row", "_chunk")
    return chunks.groupBy("_chunk").cogroup(kept.groupBy("_chunk")).applyInArrow(work, fields)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents")).drop("kept")
