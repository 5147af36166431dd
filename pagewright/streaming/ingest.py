"""New documents as a stream. Documents don't depend on each other, so the job keeps no state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as X


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, language, n_blocks, masked): what a new document brings, by expressions that stream and batch share."""
    return docs.select("doc_id", X.language(F.col("text")).alias("language"), F.size(F.split("text", "\n")).alias("n_blocks"), X.mask(F.col("text")).alias("masked"))


def follow(spark: SparkSession, path: str, schema: str, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Each batch of new Parquet files of a folder, described, to ``sink`` (which should be idempotent by batch number)."""
    stream = described(spark.readStream.schema(schema).parquet(path))
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
