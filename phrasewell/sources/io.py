"""Readers and writers: corpus JSON, vocabulary, phrase dump, term weights, questions, predictions."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ANSWER = "struct<text:string,answer_start:int>"
QUESTION = f"struct<id:string,question:string,answers:array<{ANSWER}>>"
PARAGRAPH = f"struct<context:string,qas:array<{QUESTION}>>"
ARTICLE = f"struct<title:string,paragraphs:array<{PARAGRAPH}>>"
CORPUS = f"version string, data array<{ARTICLE}>"


def scratch(spark: SparkSession) -> str:
    """A new folder under the cluster's shared folder, removed when the driver ends; a temporary one only in local mode without such a folder."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), "phrasewell-shared")
    path = f"{base.rstrip('/')}/phrasewell-io-{uuid.uuid4().hex}"
    atexit.register(_remove_quietly, spark, path)
    return path


def materialized(rows: DataFrame) -> DataFrame:
    """rows written to a new folder under the shared one and read again, where they would be made several times."""
    path = scratch(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _file_system(spark: SparkSession, path: str) -> tuple:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file_system(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _file_system(spark, path)
    fs.delete(p, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    fs, p = _file_system(spark, old)
    if not fs.rename(p, _file_system(spark, new)[1]):
        raise OSError(f"{old} could not be moved to {new}")


def _remove_quietly(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            remove(spark, path)
    except Exception:  # noqa: BLE001  the session is gone: nothing to tidy through it
        pass


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CORPUS).json(path, multiLine=True)


def flatten_examples(corpus: DataFrame, context_only: bool = False, first: int = 0, draft: int | None = None, own: str | None = None) -> DataFrame:
    """One row per paragraph (context_only) or per question: doc_idx, title, par_idx, context and the question's fields.

    Documents are numbered from `first` within each file's data array, or by the column `own`; `draft` keeps so many rows.
    """
    number = F.col("_at") + first if own is None else F.col(own)
    docs = corpus.select("*", F.posexplode("data").alias("_at", "a")).select(number.cast("long").alias("doc_idx"), "a.title", F.posexplode("a.paragraphs").alias("par_idx", "p"))
    out = docs.select("doc_idx", "title", "par_idx", "p.context", *([] if context_only else [F.explode("p.qas").alias("q")]))
    if not context_only:
        out = out.select("doc_idx", "title", "par_idx", "context", F.col("q.id").alias("qas_id"), F.col("q.question").alias("question"), F.col("q.answers").alias("answers"))
    return out if draft is None else out.limit(draft)


_NUMBER = r"/(?:file=)?(\d{4,})(?:/part-[^/]*)?$"


def read_file_range(spark: SparkSession, folder: str, first: int, end: int, per_file: int = 1000, context_only: bool = True) -> DataFrame:
    """Corpus files first to end - 1, named by four digits or in folders file=NNNN; a document's number is its file's times per_file plus its place.

    One scan reads all of them, however many there are; other files are left out by their names.
    """
    rows = spark.read.schema(CORPUS).json(folder, multiLine=True, recursiveFileLookup=True)
    rows = rows.withColumn("file", F.regexp_extract("_metadata.file_path", _NUMBER, 1).cast("long")).where((F.col("file") >= first) & (F.col("file") < end))
    docs = rows.select("file", F.posexplode("data").alias("at", "a")).select((F.col("file") * per_file + F.col("at")).alias("doc_idx"), F.array("a").alias("data"))
    out = flatten_examples(docs.select("doc_idx", "data"), context_only, own="doc_idx")
    return out


def write_corpus_files(articles: DataFrame, folder: str, per_file: int = 1000) -> None:
    """articles(doc_idx, article) as corpus files of per_file articles each, in folders file=NNNN."""
    rows = articles.withColumn("file", F.lpad(F.floor(F.col("doc_idx") / per_file).cast("string"), 4, "0"))
    data = F.transform(F.array_sort(F.collect_list(F.struct("doc_idx", "article"))), lambda x: x.article)
    rows.groupBy("file").agg(F.lit("phrasewell").alias("version"), data.alias("data")).write.mode("overwrite").partitionBy("file").json(folder)


def resume_after(files: DataFrame, done: DataFrame, per_file: int = 1000) -> DataFrame:
    """Files whose documents aren't in a dump yet."""
    return files.join(done.select(F.floor(F.col("doc_idx") / per_file).cast("long").alias("file")).distinct(), "file", "left_anti")


def write_vocabulary(tokens: DataFrame, path: str) -> None:
    """Distinct tokens in order, a line each, as one file: sorted by one task that writes them as they come and holds no list of them."""
    tokens.select("token").distinct().repartition(1).sortWithinPartitions("token").write.text(path)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(token, id): a token a line, numbered from 0. A vocabulary is one small file, read in one piece so that lines keep their order."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\n$", ""), r"\r?\n")).alias("id", "token"))
    return lines.select(F.trim("token").alias("token"), F.col("id").cast("long").alias("id"))


def write_phrase_dump(words: DataFrame, path: str, mode: str = "overwrite", per_bucket: int = 1000, unit: tuple[str, ...] = ("doc_idx",)) -> None:
    """Words partitioned by doc_bucket. overwrite replaces the units (documents, or paragraphs by ("doc_idx", "par_idx")) that it has rows for and
    leaves all others; skip leaves the units that are there and appends the others.
    """
    spark, keys = words.sparkSession, list(unit)
    words = words.withColumn("doc_bucket", F.floor(F.col("doc_idx") / per_bucket).cast("long"))
    if not exists(spark, path):
        words.write.partitionBy("doc_bucket").parquet(path)
        return
    old = spark.read.parquet(path)
    if mode == "skip":
        words.join(old.select(*keys).distinct(), keys, "left_anti").write.partitionBy("doc_bucket").mode("append").parquet(path)
        return
    # Only buckets with rows of the new units are written again; what they keep is put aside first, as a bucket can't be read while it is replaced.
    touched = old.join(words.select("doc_bucket").distinct(), "doc_bucket", "left_semi")
    kept, new = scratch(spark), scratch(spark)
    words.write.parquet(new)
    touched.join(spark.read.parquet(new).select(*keys).distinct(), keys, "left_anti").write.parquet(kept)
    both = spark.read.schema(old.schema).parquet(kept).unionByName(spark.read.parquet(new), allowMissingColumns=True)
    both.write.option("partitionOverwriteMode", "dynamic").partitionBy("doc_bucket").mode("overwrite").parquet(path)
    for folder in (kept, new):
        remove(spark, folder)


def unreadable_files(spark: SparkSession, path: str) -> DataFrame:
    """(file) of a dump's Parquet files that can't be read to their end; every column of every file is read."""
    fields = spark.read.parquet(path).schema
    # The schema is given, so that files are opened by the scan and not before it; what breaks is skipped there.
    rows = spark.read.schema(fields).option("ignoreCorruptFiles", True).option("basePath", path).parquet(path)
    whole = rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.max(F.xxhash64(*[F.col(f.name) for f in fields.fields])).alias("_h")).select("file")
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("file"))
    plain = F.regexp_replace("file", "^file:/*", "/")
    return found.withColumn("file", plain).join(whole.withColumn("file", plain), "file", "left_anti")


def read_phrase_dump(spark: SparkSession, path: str, buckets: list[int] | None = None) -> DataFrame:
    out = spark.read.parquet(path)
    return out if buckets is None else out.where(F.col("doc_bucket").isin(buckets))


def lookup(dump: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of the asked documents, asked documents that aren't there)."""
    return dump.join(asked, "doc_idx"), asked.join(dump.select("doc_idx").distinct(), "doc_idx", "left_anti")


def question_dump(questions: DataFrame) -> DataFrame:
    """qid and its start, end and span parts as one array."""
    return questions.select("qid", F.concat("q_start", "q_end", F.array("q_span")).alias("data"))


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def answer(spark: SparkSession, questions: DataFrame, words: DataFrame, k: int = 5) -> DataFrame:
    """What a service would return for questions: the k best spans each."""
    from phrasewell.plans.search import search

    return search(questions, words, k)
