"""Review pages taken in as they land, and row-local operators on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from textyard.functions import text as tx
from textyard.sources.reviews import PAGE, flatten_reviews


def page_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1_000) -> DataFrame:
    """New page files of ``folder``; each is read once, tracked by the query's checkpoint."""
    reader = spark.readStream.schema(PAGE).option("multiLine", True).option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(folder)


def review_stream(pages: DataFrame, *keep: str) -> DataFrame:
    """The batch flatten, unchanged, plus the clean text."""
    return flatten_reviews(pages, *keep).withColumn("clean", tx.clean("text"))


def ingest_reviews(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Process all files landed since the last call and append them to ``out`` as Parquet.

    ``checkpoint`` must be shared storage: it makes a restart go on where the last run ended.
    """
    rows = review_stream(page_stream(spark, folder))
    writer = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(availableNow=True).start()
