"""A stream of new words into the index: files of words are assigned to cells as they come and appended to the cells' partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from phrasewell.operators import index as I


def word_stream(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    return spark.readStream.schema(like.schema).parquet(folder)


def append_to_index(stream: DataFrame, centroids: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Runs over all files there are and stops; called again it takes the new ones, each once."""
    assigned = I.assign(stream, centroids)
    return assigned.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("cluster_id").trigger(availableNow=True).start()
