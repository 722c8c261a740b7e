"""Chunks of whole texts, written once and read again without a shuffle.

Several operators ask questions about every word window of the corpus: how often does it occur, does it occur earlier. Each
chunk of some megabytes of text combines its own windows first, sends each distinct key once to the bucket of its hash, and
gets its answer back by chunk. For that the texts lie in a table bucketed by chunk, in the shared folder: the answers are shuffled to
the chunks and the texts stay where they are. A key that occurs everywhere costs a bucket one entry per chunk.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phrasewell.llm._shared import shared_dir

CHUNK_BYTES = 6 << 20
LEAST_CHUNKS = 16


def write_chunks(docs: DataFrame, path: str, text: str = "text") -> tuple[str, int]:
    """Writes docs with _chunk and _row (unique) under path, bucketed by _chunk; each row of docs is in one chunk of about CHUNK_BYTES of text. Returns what `read_chunks` needs."""
    total = docs.agg(F.sum(F.octet_length(text))).collect()[0][0] or 0
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    names = [*docs.columns, "_chunk", "_row"]
    at, most = names.index(text), CHUNK_BYTES

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        held, row = 0, 0
        for b in batches:
            n = len(b)
            size = np.asarray(pc.fill_null(pc.binary_length(b.column(at)), 0), np.int64) + 8
            chunk = part + (held + np.cumsum(size)) // most
            held += int(size.sum())
            rows = part + np.arange(row, row + n)
            row += n
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(chunk, pa.int64()), pa.array(rows, pa.int64())], names)

    fields = f"{fields}, _chunk long, _row long"
    buckets = int(max(LEAST_CHUNKS, -(-total // most)))
    name = f"phrasewell_{uuid.uuid4().hex}"
    docs.mapInArrow(assign, fields).write.bucketBy(buckets, "_chunk").sortBy("_chunk").option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
    docs.sparkSession.sql(f"DROP TABLE {name}")  # its files stay
    return fields, buckets


def read_chunks(spark: SparkSession, path: str, fields: str, buckets: int) -> DataFrame:
    """Chunks as a bucketed table. The catalog forgets it when the driver ends."""
    name = f"phrasewell_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({fields}) USING parquet OPTIONS (path '{path}') CLUSTERED BY (_chunk) SORTED BY (_chunk) INTO {buckets} BUCKETS")
    atexit.register(_forget, spark, name)
    return spark.table(name)


def _forget(spark: SparkSession, name: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
    except Exception:  # noqa: BLE001  the session is gone, and with it the catalog or its use
        pass


def chunked(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with _chunk and _row (unique), written to the shared folder and read again by chunk."""
    path = shared_dir(docs.sparkSession)
    return read_chunks(docs.sparkSession, path, *write_chunks(docs, path, text))


def texts_of(col: pa.ChunkedArray) -> list[bytes | None]:
    return pc.cast(col, pa.binary()).to_pylist()


def cut(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """For sorted 64-bit keys: (bucket, its slice); bucket b holds the b-th of equal ranges of the key space."""
    edges = np.searchsorted(keys, bucket_starts(buckets))
    ends = np.append(edges[1:], len(keys))
    for b in np.flatnonzero(ends > edges):
        yield int(b), slice(int(edges[b]), int(ends[b]))


def bucket_starts(buckets: int) -> np.ndarray:
    return np.asarray([-(-(b << 64) // buckets) for b in range(buckets)], np.uint64)


def bucket_count(rows: int, per_bucket: int = 400_000, least: int = 64) -> int:
    """A number of buckets that holds each bucket to about per_bucket rows."""
    return int(max(least, -(-rows // per_bucket)))


def blob(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def release(df: DataFrame) -> None:
    """Lets Spark remove the shuffle files of finished jobs now and not when the driver next happens to collect garbage."""
    import gc

    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
