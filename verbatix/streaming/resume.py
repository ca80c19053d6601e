"""Resumable results: a stream of result files, each request counted once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

RESULT = "request_key string, segment_id string, status string, reply string"


def results(spark: SparkSession, path: str, schema: str = RESULT, files_at_once: int = 20) -> DataFrame:
    """Result lines as they arrive; the first of each request stays."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).json(path).dropDuplicates(["request_key"])


def collect_results(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends new results to a Parquet table; a restart goes on where the checkpoint ends."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
