"""Frames that arrive as files, deconvolved in batches of so many files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

#: Frames in pixels.
SCHEMA = "t int, y int, x int, v double"


def frames(spark: SparkSession, folder: str, size: int) -> DataFrame:
    """A stream of frame tables (parquet files, one for each time point), ``size`` of them in a batch at most."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", size).parquet(folder)


def process(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Run ``work`` on each batch and write its result by time point; a batch that is run again replaces its own files."""

    def one(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").partitionBy("t").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
