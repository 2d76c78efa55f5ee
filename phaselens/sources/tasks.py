"""What runs cost, from Spark's own event logs, as worker traces that ``operators.trace`` reads; and traces by the file they lie in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phaselens.operators.trace import span
from phaselens.sources.files import TRACE

#: The parts of a task's event that are read; other parts of the lines aren't parsed.
EVENT = (
    "`Event` string, `Stage ID` int, `Task Type` string, `Task Info` struct<`Task ID`: bigint, `Partition ID`: bigint, `Launch Time`: bigint, `Finish Time`: bigint, `Getting Result Time`: bigint, `Executor ID`: string, `Host`: string, `Failed`: boolean>, "
    "`Task Metrics` struct<`Executor Deserialize Time`: bigint, `Executor Run Time`: bigint, `Executor CPU Time`: bigint, `Result Serialization Time`: bigint, `Peak Execution Memory`: bigint, `JVM GC Time`: bigint, `Memory Bytes Spilled`: bigint, `Disk Bytes Spilled`: bigint, "
    "`Shuffle Read Metrics`: struct<`Fetch Wait Time`: bigint, `Remote Bytes Read`: bigint, `Local Bytes Read`: bigint, `Total Records Read`: bigint>, "
    "`Shuffle Write Metrics`: struct<`Shuffle Bytes Written`: bigint, `Shuffle Write Time`: bigint>, `Input Metrics`: struct<`Bytes Read`: bigint, `Records Read`: bigint>>"
)


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """A row for each finished task in the event logs at ``path`` (files or folders, plain or compressed as Spark reads text).

    The columns of a worker trace - item (task), thread (a number for each executor's host and name, as ``thread_numbers`` gives them), worktype (stage),
    t_start, t_end in seconds, m0 (waiting for shuffled data), m1 (writing it, and waiting for garbage collection), memory, dest (partition), src1 and src2 (records and
    bytes read) - and cpu, spilled, written, host, executor and failed.  Lines are parsed where they lie; only tasks' events are.
    """
    event = F.from_json("value", EVENT)
    lines = spark.read.text(path).where(F.col("value").startswith('{"Event":"SparkListenerTaskEnd"')).select(event.alias("e"))
    info, done = F.col("e.Task Info"), F.col("e.Task Metrics")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    read, write = done["Shuffle Read Metrics"], done["Shuffle Write Metrics"]
    return lines.where(info["Task ID"].isNotNull()).select(
        info["Task ID"].alias("item"), F.concat_ws("/", info["Host"], info["Executor ID"]).alias("executor"), F.col("e.Stage ID").alias("worktype"),
        (info["Launch Time"] / 1000).alias("t_start"), (info["Finish Time"] / 1000).alias("t_end"), (number(read["Fetch Wait Time"]) / 1000).alias("m0"),
        (number(write["Shuffle Write Time"]) / 1e9 + number(done["JVM GC Time"]) / 1000).alias("m1"), number(done["Peak Execution Memory"]).alias("memory"), number(info["Partition ID"]).alias("dest"),
        (number(done["Input Metrics"]["Records Read"]) + number(read["Total Records Read"])).alias("src1"), (number(done["Input Metrics"]["Bytes Read"]) + number(read["Remote Bytes Read"]) + number(read["Local Bytes Read"])).alias("src2"),
        (number(done["Executor CPU Time"]) / 1e9).alias("cpu"), (number(done["Memory Bytes Spilled"]) + number(done["Disk Bytes Spilled"])).alias("spilled"), number(write["Shuffle Bytes Written"]).alias("written"), F.coalesce(info["Failed"], F.lit(False)).alias("failed"),
    )


def thread_numbers(tasks: DataFrame) -> DataFrame:
    """Tasks with ``thread``: executors numbered from 0 by host and name. There is a row for each executor to number."""
    names = tasks.select("executor").distinct()
    rank = F.array_position(names.agg(F.array_sort(F.collect_set("executor"))).scalar(), F.col("executor")) - 1
    return tasks.withColumn("thread", rank.cast("int"))


def resources(tasks: DataFrame) -> DataFrame:
    """By stage: tasks, failed ones, seconds of work, of CPU and of waiting (the locks' report), the most memory of a task, bytes read, written and spilled."""
    return tasks.groupBy("worktype").agg(
        F.count("*").alias("tasks"), F.count(F.when(F.col("failed"), 1)).alias("failed"), F.sum(F.col("t_end") - F.col("t_start")).alias("busy"), F.sum("cpu").alias("cpu"), F.sum("m0").alias("fetching"), F.sum("m1").alias("writing"),
        F.max("memory").alias("memory"), F.sum("src2").alias("read"), F.sum("written").alias("written"), F.sum("spilled").alias("spilled"),
    )


def write_resources(tasks: DataFrame, path: str) -> None:
    """The report of ``resources`` as tab-separated text with names, in the order of the stages."""
    resources(tasks).orderBy("worktype").coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)  # a row for each stage


def file_rows(rows: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Rows of files with the name and size of the file each lies in; with ``names`` the other files aren't opened."""
    kept = rows if names is None else rows.where(F.col("_metadata.file_name").isin(names))
    return kept.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("file_bytes"))


def scaling_of_files(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """(file, threads, wall) of each trace file of a folder: its largest thread plus one, and the time from its first start to its last end."""
    return span(file_rows(spark.read.schema(TRACE).option("sep", "\t").csv(path), names), "file")
