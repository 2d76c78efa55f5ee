"""Shared plumbing: tables that cut lineage, and helpers for Arrow batches."""

from __future__ import annotations

import atexit
import itertools
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []
_settled = itertools.count(1)
#: Rows handed to one vectorised step; bounds a Python worker's memory when documents are long.
SLICE_CHARS = 1_000_000


#: The setting by which a query's shuffle files go when it ends.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tables written from one collection of the driver's garbage to the next.
COLLECT_EVERY = 6
#: The setting that bounds the text of a plan, which the driver makes at each step of a query and keeps for each of the last thousand.
PLAN_TEXT = "spark.sql.maxPlanStringLength"
#: The setting that bounds Arrow batches by bytes; Spark's own bound is 64 MB for each task.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary one where it is unset in local mode (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + os.path.join(tempfile.gettempdir(), f"phaselens-{os.getpid()}")
    return where.rstrip("/")


def settle(df: DataFrame, compression: str = "snappy", batch: int = 0, also: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps neither recompute it nor lose it with an executor.

    The shuffle files of the query that wrote it go with its end.  Arrow batches sent to workers have ``batch`` bytes or one row, if that is given.
    ``also`` has further settings for that query.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/phaselens/{uuid.uuid4().hex}"
    settings = {TIDY: "true", PLAN_TEXT: "20000"} | ({BATCH_BYTES: f"{batch}b"} if batch else {}) | (also or {})
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    _written.append((spark, path))
    if next(_settled) % COLLECT_EVERY == 0:
        collect_garbage(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def collect_garbage(spark: SparkSession) -> None:
    """Spark lets go of the tasks and tables that it sent out for finished queries only when the driver's garbage is collected.

    A long row of queries would else fill the driver's heap up to its bound; ``spark.cleaner.periodicGC.interval`` does the same by the clock.
    """
    spark.sparkContext._jvm.System.gc()


def release(df: DataFrame) -> None:
    """Delete a settled table that nothing needs any more."""
    path = df._settled_at
    _written.remove((df.sparkSession, path))
    _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def concluded(make: Callable[[], DataFrame], batch: int = 0) -> DataFrame:
    """The settled result of ``make``, without the tables that it settled on the way."""
    since = len(_written)
    out = settle(make(), batch=batch)
    own = _written.pop()
    for spark, path in _written[since:]:
        _delete(spark, path)
    _written[since:] = [own]
    return out


def sweep() -> None:
    """Delete the tables that ``settle`` wrote; runs at exit."""
    while _written:
        spark, path = _written.pop()
        try:
            _delete(spark, path)
        except Exception:  # the session has ended
            return


atexit.register(sweep)


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` holds about SLICE_CHARS bytes at most (or one row)."""
    for batch in batches:
        at, rows = 0, batch.num_rows
        if not rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        while at < rows:
            size, end = 0, at
            while end < rows and (end == at or size + sizes[end] <= SLICE_CHARS):
                size += sizes[end]
                end += 1
            yield batch.slice(at, end - at)
            at = end


#: Words of 64 bits of the table that ``sieve`` builds: 16.8 million bits in 2 MB at any size of input.
SIEVE_WORDS = 1 << 18


def sieve(ids: DataFrame, key: Column) -> Column:
    """A condition on ``key`` (a column of longs of another table) that holds for all values in ``ids`` (one column) and for few others.

    It thins a large table before a join on the same key, which stays to be done; the table of bits has a fixed size.
    """
    value = F.col(ids.columns[0])
    h, k = F.xxhash64(value), F.xxhash64(key)
    word = lambda x: F.pmod(x, F.lit(SIEVE_WORDS))
    bit = lambda x: F.pmod(F.shiftright(x, 20), F.lit(64)).cast("int")
    spark = ids.sparkSession
    held = ids.where(value.isNotNull()).select(word(h).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), bit(h)).alias("bits"))
    # with a row of no bits for each word, so that none is missing in the one shuffle by word
    full = spark.range(SIEVE_WORDS).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("bits")).unionAll(held).groupBy("w").agg(F.bit_or("bits").alias("bits")).select(F.struct("w", "bits").alias("s"))
    table = settle(full.agg(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["bits"]).alias("bits")))
    return F.call_function("getbit", F.element_at(table.scalar(), (word(k) + 1).cast("int")), bit(k)) == 1
