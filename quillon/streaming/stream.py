"""Streams of documents: the batch plan on a stream, stateless per document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quillon.operators.detect import Options
from quillon.plans.anonymize import anonymize


def read(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """New Parquet files of a folder as a stream of documents."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def start(docs: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, o: Options = Options()) -> StreamingQuery:
    """Masks arriving documents and hands each batch to the sink; the checkpoint makes a restart go on where it stopped, so a sink that overwrites by batch number is exactly-once."""
    return anonymize(docs, o).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
