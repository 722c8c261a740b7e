"""Helpers the operators of this subpackage share: shared-folder tables and word rules."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: What separates words of letters and digits: every ASCII character that is neither a-z nor 0-9.
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What separates words of any visible characters.
SPACE_GAP = r"[\x20\x09-\x0D]+"
SPACE_WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under the cluster's shared folder (spark.checkpoint.dir), removed when the driver ends; a temporary one only in local mode where that is unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), "phrasewell-shared")
    path = f"{base.rstrip('/')}/phrasewell-{uuid.uuid4().hex}"
    atexit.register(_drop_quietly, spark, path)
    return path


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a folder made by `materialize`, through Hadoop, wherever it is."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none where there is no such folder."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def _drop_quietly(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            drop(spark, path)
    except Exception:  # noqa: BLE001  the session is gone: nothing to tidy through it
        pass


def materialize(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends there, and any executor can be lost later."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, also where body uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id written as text, modulo n; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n
