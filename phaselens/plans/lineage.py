"""Cutting the plans of iterative operators."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``, or a temporary one where it is unset in local mode (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + os.path.join(tempfile.gettempdir(), f"phaselens-{os.getpid()}")
    return where.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` from a reliable checkpoint in the context's folder for them, else in the shared one."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def numbered(ordered: DataFrame, name: str, first: int = 0) -> DataFrame:
    """``ordered`` (sorted rows) with their places in a column ``name`` (long) from ``first`` on.

    Rows keep the partitions that the sort made; numbers of earlier partitions' rows, one for each partition, are added to
    places within them.  No task gets all rows.
    """
    marked = cut(ordered.withColumn(name, F.monotonically_increasing_id()))
    part, within = F.shiftright(name, 33), F.col(name).bitwiseAND((1 << 33) - 1)
    sizes = marked.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    placed = marked.join(F.broadcast(starts), part == F.col("_part"))  # one row for each partition
    return placed.withColumn(name, F.col("_start") + within + first).select(*marked.columns)
