"""Signatures of records that arrive as a stream: the batch expressions, as they need no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.plans.records import signatures


def signed_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files of records that appear in a folder, with their signatures."""
    return signatures(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path))
