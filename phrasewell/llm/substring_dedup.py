"""Substring dedup with a log-structured fingerprint index.

A window is `window` consecutive words. A word is removed if a window that covers it also starts earlier: in a row with smaller
doc_id or before it in the same document. Texts go to the index batch after batch, in doc_id order; for each batch:

1. Anchors. Of every run of 11 10-grams of words the least hash is an anchor (winnowing), so windows of 20 equal words hold
   equal anchors. The batch's anchors are merge-joined, bucket by bucket, with the index's runs: sorted immutable runs of the anchors of
   all earlier texts and the rows of text they are in. Rows whose anchors occur once end there. The batch's anchors become a run
   of their own, and runs are compacted once there are too many.
2. The windows of shared anchors, in the rows of the batch and in the earlier rows that hold them, meet by their 64-bit hash and are verified by
   a second, independent 32-bit hash.
3. Each chunk of the batch learns which of its windows were there before and cuts the words they cover.

The index lasts: a later session opens it under its path and adds the next batch (`FingerprintIndex`, or `dedup` with a path).

Chunks combine equal windows before anything is shuffled, so a passage in a third of all documents gives one entry per chunk.

Null texts have no words. A null doc_id comes after all others. Rows with one doc_id are one document: windows at one start
in both are not earlier than each other. Texts of fewer words than a window lose nothing; very long ones are handled whole, within a chunk.
An empty table gives an empty result. Extra columns pass through `dedup`, but for its own four and _chunk and _row.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phrasewell.llm._chunks import blob, bucket_count, cut, read_chunks, release, texts_of, write_chunks
from phrasewell.llm._shared import drop, listed, materialize, shared_dir, table
from phrasewell.llm._vec import gram_hashes, word_hashes

WINDOW = 20
#: A batch is a range of doc_id; the index compacts when it has more runs than this: here after the third batch.
BATCHES, MOST_RUNS = 4, 2
LAST = np.iinfo(np.int64).max
TOP = np.uint64(2**64 - 1)


def _slide_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    have, m = 1, a
    while have < w:
        step = min(have, w - have)
        m = np.minimum(m[: len(m) - step], m[step:])
        have += step
    return m


class Windows:
    """The windows of some texts: hashes, place and anchor of each."""

    def __init__(self, texts: list[bytes | None], ids: np.ndarray, window: int) -> None:
        words, self.ends = word_hashes(texts)
        gram = window // 2
        span = window - gram + 1
        n = np.diff(self.ends)
        doc = np.repeat(np.arange(len(texts)), n)
        at = np.arange(len(words)) - self.ends[:-1][doc]
        whole = at + window <= n[doc]
        self.place = np.flatnonzero(whole[: max(0, len(words) - window + 1)])
        self.doc, self.start = doc[self.place], at[self.place]
        self.key = ids[self.doc] if len(texts) else np.empty(0, np.int64)
        if len(self.place):
            self.h1 = gram_hashes(words, window, 1)[self.place]
            self.h2 = (gram_hashes(words, window, 2)[self.place] >> np.uint64(32)).astype(np.uint32)
            self.anchor = _slide_min(gram_hashes(words, gram, 3), span)[self.place]
        else:
            self.h1 = self.anchor = np.empty(0, np.uint64)
            self.h2 = np.empty(0, np.uint32)

    def firsts(self, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Of the windows (or those in `of`): indices of each hash's first place here, sorted by hash; and which windows repeat an earlier place."""
        some = np.arange(len(self.h1)) if of is None else of
        # Places are in order within a document; documents by key. A stable sort by key, then by hash.
        some = some[np.argsort(self.key[some], kind="stable")] if len(some) and np.any(np.diff(self.key[some]) < 0) else some
        order = some[np.argsort(self.h1[some], kind="stable")]
        h1, h2 = self.h1[order], self.h2[order]
        if np.any((h1[1:] == h1[:-1]) & (h2[1:] != h2[:-1])):
            order = some[np.lexsort((self.h2[some], self.h1[some]))]
            h1, h2 = self.h1[order], self.h2[order]
        new = np.ones(len(order), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        # Rows of one doc_id may mix starts: the least (key, start) of each hash is its first place.
        group = np.cumsum(new) - 1
        head = order[new]
        key, start = self.key[order], self.start[order]
        lead = np.minimum.reduceat(np.where(key == self.key[head][group], start, LAST), np.flatnonzero(new)) if len(order) else start
        late = np.zeros(len(self.h1), bool)
        late[order] = (key > self.key[head][group]) | (start > lead[group]) if len(order) else False
        firsts = np.copy(head)
        self.first_start = lead
        return firsts, late


def _ids(col: pa.ChunkedArray) -> np.ndarray:
    return np.asarray([LAST if v is None else v for v in col.to_pylist()], np.int64)


REQUESTS = "bucket int, chunk long, keys binary, rows binary"


def _rows(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.table({name: pa.array([r[i] for r in rows], kinds[kind]) for i, (name, kind) in enumerate(f.split() for f in schema.split(", "))})


def anchors(texts: list[bytes | None], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of every place that is the least n-gram of some window; windows hold one at least."""
    words, ends = word_hashes(texts)
    gram = window // 2
    span = window - gram + 1
    n = np.diff(ends)
    doc = np.repeat(np.arange(len(texts)), n)
    at = np.arange(len(words)) - ends[:-1][doc] if len(words) else np.empty(0, np.int64)
    if len(words) < window:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = gram_hashes(words, gram, 3)
    least = _slide_min(h, span)
    # A place is one if the greatest of the minima of the windows around it is its own hash; windows across texts don't count.
    least = np.where((at + window <= n[doc])[: len(least)], ~least, TOP)
    none = np.full(span - 1, TOP)
    place = np.flatnonzero(~_slide_min(np.concatenate((none, least, none)), span) == h)
    return h[place], doc[place]


def _low(row: pa.ChunkedArray) -> np.ndarray:
    """What tells a row apart within its chunk."""
    return (np.asarray(row.to_pylist(), np.int64) & 0xFFFFFFFF).astype(np.uint32)


def _anchors(chunks: DataFrame, window: int, buckets: int) -> DataFrame:
    """(bucket, chunk, the chunk's anchors, ascending, their rows)."""

    def work(t: pa.Table) -> pa.Table:
        key, doc = anchors(texts_of(t["text"]), window)
        order = np.argsort(key, kind="stable")
        key, row = key[order], _low(t["_row"])[doc[order]]
        return _rows([(b, t["_chunk"][0].as_py(), blob(key[s]), blob(row[s])) for b, s in cut(key, buckets)], REQUESTS)

    return chunks.groupBy("_chunk").applyInArrow(work, REQUESTS)


def _some(t: pa.Table, s: pa.Table) -> pa.Table:
    """The rows of a chunk that s names."""
    return t.filter(pa.array(np.isin(_low(t["_row"]), _joined(s["rows"], np.uint32)), pa.bool_())) if t.num_rows and s.num_rows else t.slice(0, 0)


def _joined(blobs: pa.ChunkedArray, kind: type = np.uint64) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in blobs.to_pylist()] or [np.empty(0, kind)])


KINDS = {"h1": np.uint64, "h2": np.uint32, "doc": np.int64, "start": np.int64}
ENTRY = "bucket int, chunk long, h1 binary, h2 binary, doc binary, start binary"
#: Chunk, document and start of what was there before a batch.
BEFORE = -1, np.iinfo(np.int64).min, -1


def _candidates(chunks: DataFrame, shared: DataFrame, window: int, buckets: int, before: bool = False) -> DataFrame:
    """ENTRY rows: the chunk's first place of each window with one of the anchors that shared(_chunk, keys, rows) names; only its rows are looked at. With before, no places but that they are earlier."""

    def work(t: pa.Table, s: pa.Table) -> pa.Table:
        out, chunk = [], t["_chunk"][0].as_py() if t.num_rows else None
        t = _some(t, s)
        if t.num_rows:
            w = Windows(texts_of(t["text"]), _ids(t["doc_id"]), window)
            head, _ = w.firsts(np.flatnonzero(np.isin(w.anchor, _joined(s["keys"]))))
            first = w.first_start.astype(np.int64)
            for b, part in cut(w.h1[head], buckets):
                i = head[part]
                if before:
                    out.append((b, BEFORE[0], blob(w.h1[i]), blob(w.h2[i]), None, None))
                else:
                    out.append((b, chunk, blob(w.h1[i]), blob(w.h2[i]), blob(w.key[i]), blob(first[part])))
        return _rows(out, ENTRY)

    return chunks.groupBy("_chunk").cogroup(shared.groupBy("_chunk")).applyInArrow(work, ENTRY)


class _Entries:
    """Entries of one bucket as columns, in order of (h1, h2, doc, start)."""

    def __init__(self, t: pa.Table) -> None:
        self.h1, self.h2 = _joined(t["h1"]), _joined(t["h2"], KINDS["h2"])
        n = [len(x) // 8 for x in t["h1"].to_pylist()]
        self.chunk = np.repeat(np.asarray(t["chunk"].to_pylist(), np.int64), n)
        none = [np.full(k, BEFORE[1 + i], np.int64) for i in range(2) for k in n]
        self.doc, self.start = (np.concatenate([none[len(n) * i + j] if x is None else np.frombuffer(x, np.int64) for j, x in enumerate(t[c].to_pylist())]) for i, c in enumerate(("doc", "start")))
        order = np.lexsort((self.start, self.doc, self.h2, self.h1))
        for k in ("chunk", *KINDS):
            setattr(self, k, getattr(self, k)[order])


def _late(entries: DataFrame) -> DataFrame:
    """(chunk, h1, h2) of the entries of a batch that have an earlier place, in it or before it. Equal first hashes are verified by the second."""

    def work(t: pa.Table) -> pa.Table:
        e = _Entries(t)
        new = np.ones(len(e.h1), bool)
        new[1:] = (e.h1[1:] != e.h1[:-1]) | (e.h2[1:] != e.h2[:-1])
        group = np.cumsum(new) - 1
        late = (e.chunk != BEFORE[0]) & ((e.doc > e.doc[new][group]) | (e.start > e.start[new][group]))
        order = np.flatnonzero(late)
        order = order[np.argsort(e.chunk[order], kind="stable")]
        if not len(order):
            return _rows([], LATE)
        c, h1, h2 = e.chunk[order], e.h1[order], e.h2[order]
        edges = np.flatnonzero(np.diff(c)) + 1
        return _rows([(int(x[0]), blob(y), blob(z)) for x, y, z in zip(np.split(c, edges), np.split(h1, edges), np.split(h2, edges), strict=True)], LATE)

    return entries.groupBy("bucket").applyInArrow(work, LATE)


LATE = "chunk long, h1 binary, h2 binary"
#: A row of a run: a bucket's anchors, ascending, each with its row and with the place of its chunk in owners, which are pairs (batch, chunk).
RUN = "bucket int, keys binary, at binary, rows binary, owners binary"
MATCHED = "kind string, bucket int, batch long, chunk long, keys binary, at binary, rows binary, owners binary"


class FingerprintIndex:
    """A log-structured index of the passages of all texts that were added, under one folder, to be opened again by later sessions.

    Runs are immutable and hold the anchors of a batch's chunks, sorted, with the chunks they occur in; each batch is merge-joined with all runs,
    bucket by bucket. The texts of earlier batches lie beside them, so what shares an anchor is looked up and verified there. More than
    most_runs runs are compacted into one. `texts/` and `runs/` hold data, `manifest/` numbered states of which the last whole one counts,
    so a batch that fails leaves the state before it. One writer at a time. The number of buckets is chosen once, for the size that is expected.
    """

    def __init__(self, spark: SparkSession, path: str, window: int = WINDOW, buckets: int = 64, most_runs: int = MOST_RUNS) -> None:
        self.spark, self.path, self.most_runs = spark, path.rstrip("/"), most_runs
        self.state = {"window": window, "buckets": buckets, "runs": [], "texts": [], "compactions": 0}
        self.serial = 0
        self.open_texts: list[DataFrame] = []
        for name in reversed(listed(spark, f"{self.path}/manifest")):
            if "_SUCCESS" in listed(spark, f"{self.path}/manifest/{name}"):
                self.state = json.loads("".join(r[0] for r in spark.read.text(f"{self.path}/manifest/{name}", wholetext=True).collect()))
                self.serial = int(name)
                break
        if self.state["window"] != window:
            raise ValueError(f"the index has windows of {self.state['window']} words")
        for t in self.state["texts"]:
            self.open_texts.append(read_chunks(spark, f"{self.path}/{t['folder']}", t["fields"], t["buckets"]))

    def _save(self) -> None:
        self.serial += 1
        self.spark.createDataFrame([(json.dumps(self.state),)], "value string").coalesce(1).write.text(f"{self.path}/manifest/{self.serial:08d}")

    def _runs(self) -> DataFrame:
        rows = [self.spark.read.schema(RUN).parquet(f"{self.path}/{r}") for r in self.state["runs"]]
        return reduce(DataFrame.unionByName, rows) if rows else self.spark.createDataFrame([], RUN)

    def _matched(self, anchors: DataFrame, number: int) -> DataFrame:
        """By kind: run (the batch's own run), own (a chunk's anchors that other chunks have, and its rows with any that repeat), old (what of them is in earlier chunks)."""

        def merge(now: pa.Table, runs: pa.Table) -> pa.Table:
            if not now.num_rows:
                return _rows([], MATCHED)
            bucket, chunks = now["bucket"][0].as_py(), now["chunk"].to_numpy()
            size = [len(x) // 8 for x in now["keys"].to_pylist()]
            key, row, at = _joined(now["keys"]), _joined(now["rows"], np.uint32), np.repeat(np.arange(len(chunks)), size)
            order = np.argsort(key, kind="stable")  # chunks stay in order within a key
            key, row, at = key[order], row[order], at[order]
            head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            last = np.append(head[1:], len(key)) - 1
            distinct = key[head]
            twice, across = last > head, at[head] != at[last]
            out = [("run", bucket, None, None, blob(key), blob(at.astype(np.uint32)), blob(row), blob(np.column_stack((np.full(len(chunks), number), chunks)).astype(np.int64)))]
            for k, a, r, o in zip(*(runs[c].to_pylist() for c in ("keys", "at", "rows", "owners")), strict=True):
                k, a, r, o = np.frombuffer(k, np.uint64), np.frombuffer(a, np.uint32), np.frombuffer(r, np.uint32), np.frombuffer(o, np.int64).reshape(-1, 2)
                i = np.minimum(np.searchsorted(distinct, k), len(distinct) - 1)
                hit = np.flatnonzero(distinct[i] == k)
                twice[i[hit]] = across[i[hit]] = True
                hit = hit[np.argsort(a[hit], kind="stable")]
                for part in np.split(hit, np.flatnonzero(np.diff(a[hit])) + 1) if len(hit) else ():
                    batch, chunk = o[a[part[0]]]
                    out.append(("old", bucket, int(batch), int(chunk), blob(np.unique(k[part])), None, blob(np.unique(r[part])), None))
            group = np.repeat(np.arange(len(head)), last - head + 1)
            some = np.flatnonzero(twice[group])
            some = some[np.argsort(at[some], kind="stable")]
            for part in np.split(some, np.flatnonzero(np.diff(at[some])) + 1) if len(some) else ():
                shared = part[across[group[part]]]
                out.append(("own", bucket, number, int(chunks[at[part[0]]]), blob(np.unique(key[shared])), None, blob(np.unique(row[part])), None))
            return _rows(out, MATCHED)

        return anchors.groupBy("bucket").cogroup(self._runs().groupBy("bucket")).applyInArrow(merge, MATCHED)

    def add(self, docs: DataFrame) -> DataFrame:
        """Adds docs(doc_id, text, ...), all of them later than what is there, and returns them with n_words, n_removed, kept_sha256 and kept_text."""
        window, buckets, number = self.state["window"], self.state["buckets"], len(self.state["texts"])
        name = uuid.uuid4().hex
        folder, run, step = f"texts/{number:06d}-{name}", f"runs/{number:06d}-{name}", shared_dir(self.spark)
        fields, parts = write_chunks(docs, f"{self.path}/{folder}")
        chunks = read_chunks(self.spark, f"{self.path}/{folder}", fields, parts)
        self._matched(_anchors(chunks, window, buckets), number).write.option("compression", "zstd").partitionBy("kind").parquet(step)
        matched = self.spark.read.schema(MATCHED).parquet(step)
        matched.where("kind = 'run'").select("bucket", "keys", "at", "rows", "owners").write.option("compression", "zstd").parquet(f"{self.path}/{run}")
        release(docs)
        asked = matched.withColumnRenamed("chunk", "_chunk").select("kind", "batch", "_chunk", "keys", "rows")
        found = [_candidates(chunks, asked.where("kind = 'own'").drop("kind", "batch"), window, buckets)]
        wanted = {r[0] for r in asked.where("kind = 'old'").select("batch").distinct().collect()}  # at most one for each batch
        for at, old in enumerate(self.open_texts):
            if at in wanted:
                some = asked.where((F.col("kind") == "old") & (F.col("batch") == at)).drop("kind", "batch")
                found.append(_candidates(old.select("_chunk", "_row", "doc_id", "text"), some, window, buckets, before=True))
        late = _late(reduce(DataFrame.unionByName, found)).withColumnRenamed("chunk", "_chunk").withColumn("rows", F.lit(None).cast("binary"))
        none = F.lit(None).cast("binary")
        late = materialize(late.unionByName(asked.where("kind = 'own'").select("_chunk", none.alias("h1"), none.alias("h2"), "rows")))
        drop(self.spark, step)
        release(docs)
        self.state["texts"].append({"folder": folder, "fields": fields, "buckets": parts})
        self.state["runs"].append(run)
        self.open_texts.append(chunks)
        if len(self.state["runs"]) > self.most_runs:
            self.compact()
        else:
            self._save()
        return _finished(chunks, late, docs, window)

    def compact(self) -> None:
        """All runs become one; the old ones are deleted once the new state stands."""

        def join(t: pa.Table) -> pa.Table:
            owners = [np.frombuffer(x, np.int64) for x in t["owners"].to_pylist()]
            shift = np.cumsum([0, *(len(x) // 2 for x in owners)])
            key, row = _joined(t["keys"]), _joined(t["rows"], np.uint32)
            at = np.concatenate([np.frombuffer(a, np.uint32) + np.uint32(n) for a, n in zip(t["at"].to_pylist(), shift[:-1], strict=True)])
            order = np.argsort(key, kind="stable")
            return _rows([(t["bucket"][0].as_py(), blob(key[order]), blob(at[order]), blob(row[order]), blob(np.concatenate(owners)))], RUN)

        run = f"runs/merged-{uuid.uuid4().hex}"
        self._runs().groupBy("bucket").applyInArrow(join, RUN).write.option("compression", "zstd").parquet(f"{self.path}/{run}")
        old, self.state["runs"] = self.state["runs"], [run]
        self.state["compactions"] += 1
        self._save()
        for x in old:
            drop(self.spark, f"{self.path}/{x}")


def _marked(w: Windows, lost: pa.Table, window: int) -> np.ndarray:
    """For each word whether it goes."""
    _, late = w.firsts()
    if lost.num_rows:
        h1, h2 = _joined(lost["h1"]), _joined(lost["h2"], KINDS["h2"])
        order = np.argsort(h1, kind="stable")
        h1, h2 = h1[order], h2[order]
        lo, hi = np.searchsorted(h1, w.h1), np.searchsorted(h1, w.h1, "right")
        for step in range(int((hi - lo).max(initial=0))):
            ok = lo + step < hi
            late[ok] |= h2[lo[ok] + step] == w.h2[ok]
    total = int(w.ends[-1])
    turns = np.zeros(total + window + 1, np.int32)
    np.add.at(turns, w.place[late], 1)
    np.add.at(turns, w.place[late] + window, -1)
    return np.cumsum(turns[:total]) > 0


def _finished(chunks: DataFrame, gone_by_chunk: DataFrame, docs: DataFrame, window: int) -> DataFrame:
    kept = docs.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def finish(t: pa.Table, gone: pa.Table) -> pa.Table:
        """gone: hashes of windows that were there before, and the rows with anchors that repeat; only in those anything can go."""
        named = gone.filter(pc.is_valid(gone["rows"]))
        some = _some(t, named)
        away: dict[int, np.ndarray] = {}
        if some.num_rows:
            w = Windows(texts_of(some["text"]), _ids(some["doc_id"]), window)
            out = _marked(w, gone.filter(pc.is_valid(gone["h1"])), window)
            away = {row: out[a:b] for row, a, b in zip(some["_row"].to_pylist(), w.ends[:-1], w.ends[1:], strict=True) if out[a:b].any()}
        n, removed, digests, rest = [], [], [], []
        for row, x in zip(t["_row"].to_pylist(), texts_of(t["text"]), strict=True):
            words = x.split() if x else []  # of bytes: at U+0020 and U+0009 to U+000D
            n.append(len(words))
            if (lost := away.get(row)) is not None:
                words = [y for y, z in zip(words, lost.tolist(), strict=True) if not z]
            left = b" ".join(words)
            removed.append(n[-1] - len(words))
            digests.append(hashlib.sha256(left).hexdigest())
            rest.append(None if lost is None else left.decode())
        return pa.table([*(t[c] for c in kept), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(rest, pa.string())], names=[*kept, *ADDED])

    return chunks.groupBy("_chunk").cogroup(gone_by_chunk.groupBy("_chunk")).applyInArrow(finish, f"{fields}, n_words long, n_removed long, kept_sha256 string, kept_text string")


ADDED = ("n_words", "n_removed", "kept_sha256", "kept_text")


def dedup(docs: DataFrame, window: int = WINDOW, batches: int = BATCHES, path: str | None = None) -> DataFrame:
    """docs(doc_id, text, ...) with n_words, n_removed, kept_sha256 and kept_text (null where nothing goes).

    docs go to an index in batches of doc_id ranges, in order. A path keeps the index there, or goes on with the one that is there: its
    texts then come before all of docs. Columns of docs named like the added ones, _chunk or _row are replaced by none.
    """
    docs = docs.drop(*ADDED, "_chunk", "_row")
    spark = docs.sparkSession
    stats = docs.agg(F.sum(F.octet_length("text")), F.min("doc_id"), F.max("doc_id")).collect()[0]
    index = FingerprintIndex(spark, path or shared_dir(spark), window, bucket_count((stats[0] or 0) // 40))
    found = []
    for lo, hi in _ranges(stats[1], stats[2], batches):
        part = docs.where(((F.col("doc_id") >= lo) & (F.col("doc_id") < hi)) if hi < LAST else (F.col("doc_id").isNull() | (F.col("doc_id") >= lo)))
        found.append(index.add(part))
    return reduce(DataFrame.unionByName, found)


def _ranges(lo: int | None, hi: int | None, batches: int) -> Iterator[tuple[int, int]]:
    """Half-open doc_id ranges from below all to above all; the last holds null ids too."""
    if lo is None:
        lo = hi = 0
    cuts = sorted({lo + (hi - lo + 1) * k // batches for k in range(1, batches)})
    edges = [int(np.iinfo(np.int64).min), *(c for c in cuts if lo < c <= hi), int(LAST)]
    yield from zip(edges[:-1], edges[1:], strict=True)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
w AS (
  SELECT r, doc_id, i, md5(array_to_string(ws[i:i + 19], ' ')) AS h
  FROM (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d WHERE len(ws) >= 20)),
late AS (
  SELECT r, i FROM (SELECT r, i, struct_pack(d := coalesce(doc_id, 9223372036854775807), s := i) AS p, min(struct_pack(d := coalesce(doc_id, 9223372036854775807), s := i)) OVER (PARTITION BY h) AS f FROM w)
  WHERE p > f),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 20)) AS k FROM late),
per AS (SELECT r, count(*) AS n, list(k) AS ks FROM gone GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
       sha256(array_to_string(list_filter(ws, lambda x, j: ks IS NULL OR NOT list_contains(ks, j)), ' ')) AS kept_sha256
FROM d LEFT JOIN per USING (r)
"""
