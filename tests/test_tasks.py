"""Spark's own event logs as worker traces, and traces by file."""

import subprocess
import sys

from pyspark.sql import functions as F

from phaselens.operators import trace
from phaselens.sources import tasks
from phaselens.sources.files import TRACE, write_trace

RUN = """
import sys
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", "file://" + sys.argv[1])
    .config("spark.eventLog.compress", "false").config("spark.eventLog.rolling.enabled", "false").config("spark.sql.shuffle.partitions", "3").config("spark.sql.adaptive.enabled", "false").getOrCreate())
spark.range(0, 1000, 1, 4).selectExpr("id % 7 AS k", "id").groupBy("k").sum("id").collect()
spark.stop()
"""


def test_a_run_is_read_as_a_trace(spark, tmp_path):
    subprocess.run([sys.executable, "-c", RUN, str(tmp_path)], check=True, capture_output=True, timeout=180)
    done = tasks.thread_numbers(tasks.read_tasks(spark, str(tmp_path)))
    rows = done.collect()
    assert len(rows) == 7 and {r["thread"] for r in rows} == {0} and not any(r["failed"] for r in rows)
    assert all(r["t_end"] >= r["t_start"] > 1e9 and r["cpu"] > 0 for r in rows)
    whole = {r["worktype"]: r for r in trace.summary(done).collect()}
    assert {k: r["items"] for k, r in whole.items() if k >= 0} == dict.fromkeys({r["worktype"] for r in rows}, None) | {min(r["worktype"] for r in rows): 4, max(r["worktype"] for r in rows): 3}
    assert whole[-1]["items"] == 7 and whole[-1]["busy"] > 0
    assert trace.high_water(done).count() == 7 and trace.thread_lanes(done).agg(F.sum("items")).first()[0] == 7
    report = {r["worktype"]: r for r in tasks.resources(done).collect()}
    first, last = min(report), max(report)
    assert report[first]["written"] > 0 and report[last]["read"] == report[first]["written"] and report[last]["tasks"] == 3
    tasks.write_resources(done, str(tmp_path / "report"))
    back = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "report"))
    assert [r["worktype"] for r in back.collect()] == [str(k) for k in sorted(report)]


def test_lines_that_are_no_tasks_are_passed_over(spark, tmp_path):
    (tmp_path / "log").write_text('{"Event":"SparkListenerLogStart"}\n{"Event":"SparkListenerTaskEnd"}\n{"Event":"SparkListenerTaskEnd","Task Info":{"Task ID":3}}\nno json\n\n')
    (row,) = tasks.read_tasks(spark, str(tmp_path / "log")).collect()
    assert (row["item"], row["t_start"], row["src1"], row["cpu"], row["failed"]) == (3, None, 0, 0.0, False)


def test_scaling_by_file_opens_only_the_files_it_needs(spark, tmp_path):
    names = [c.split() for c in TRACE.split(", ")]
    for k, threads in enumerate((1, 3, 4)):
        rows = spark.range(20).select(*(
            (F.col("id") % threads if c == "thread" else F.col("id") * 2.0 + 5 if c == "t_start" else F.col("id") * 2.0 + 6 if c == "t_end" else F.col("id")).cast(kind).alias(c) for c, kind in names
        ))
        write_trace(rows.coalesce(1), str(tmp_path / f"run{k}"))
    found = tasks.scaling_of_files(spark, str(tmp_path / "run*")).collect()
    assert sorted(r["threads"] for r in found) == [1, 3, 4] and {r["wall"] for r in found} == {39.0}
    one = [r["file"] for r in found if r["threads"] == 3]
    some = tasks.scaling_of_files(spark, str(tmp_path / "run*"), one)
    assert [r["threads"] for r in some.collect()] == [3] and len(some.inputFiles()) == 3
    assert "file_name" in some._jdf.queryExecution().executedPlan().toString()
