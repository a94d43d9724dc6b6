"""Incremental ingestion of message files as they arrive: an addition to the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def ingest(spark: SparkSession, folder: str, schema: StructType, merge: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Reads the parquet files of a folder that weren't read before and hands each batch to merge, then stops."""
    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
