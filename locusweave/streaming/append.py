"""Streaming ingest of new gene files into a GeneStore."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from locusweave.operators.store import GeneStore


def follow(spark: SparkSession, folder: str, schema, store_path: str, checkpoint: str, files_per_batch: int = 100) -> StreamingQuery:
    """Start a query that adds the genes of each new Parquet file of folder to the store, a part for each batch.

    A batch that is replayed after a failure adds nothing twice: its part has its number, and the store drops known ids."""
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)

    def add(batch: DataFrame, number: int) -> None:
        GeneStore.load(batch.sparkSession, store_path).add(batch, f"batch{number}")

    return source.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
