"""Images, point-spread functions, traces and trials derived from the star-schema tables, with whole-number values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Height, width, lenslet size and time points of the derived frames.
HEIGHT, WIDTH, LENSLET, TIMES = 30, 45, 3, 2

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def axis(spark: SparkSession, name: str, low: int, high: int) -> DataFrame:
    """One int column with the whole numbers from low to high."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(low), F.lit(high))).alias(name))


def grid(spark: SparkSession, height: int = HEIGHT, width: int = WIDTH, times: int = TIMES) -> DataFrame:
    """(t, y, x): a bounded table of coordinates."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("t")).select("t", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y")).select(
        "t", "y", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x")
    )


def frame(spark: SparkSession, sf_dir: str, height: int = HEIGHT, width: int = WIDTH) -> DataFrame:
    """frame_px (t, y, x, v): quantities of lineitem by order, part and line, with empty pixels as 0."""
    summed = table(spark, sf_dir, "lineitem").groupBy(
        (F.col("l_linenumber") % TIMES).cast("int").alias("t"), (F.col("l_orderkey") % height).cast("int").alias("y"), (F.col("l_partkey") % width).cast("int").alias("x")
    ).agg(F.sum(F.col("l_quantity").cast("double")).alias("v"))
    return grid(spark, height, width).join(summed, ["t", "y", "x"], "left").select("t", "y", "x", F.coalesce("v", F.lit(0.0)).alias("v"))


def psf(spark: SparkSession, n: int = LENSLET, reach: int = 3, planes: int = 3) -> DataFrame:
    """psf (z, b, a, dv, du, h): pyramids centred on the phase, lower with each plane, without zeros."""
    c = (n - 1) // 2
    out = axis(spark, "z", 0, planes - 1)
    for name, low, high in (("b", 0, n - 1), ("a", 0, n - 1), ("dv", -reach, reach), ("du", -reach, reach)):
        out = out.select("*", F.explode(F.sequence(F.lit(low), F.lit(high))).alias(name))
    h = 8 - F.abs(F.col("dv") - (F.col("b") - c)) - F.abs(F.col("du") - (F.col("a") - c)) - F.col("z")
    return out.withColumn("h", h.cast("double")).where("h > 0")


def mask(spark: SparkSession) -> DataFrame:
    """(y, x, m): 0 at lenslet corners, else 1."""
    dark = (F.col("y") % LENSLET == 0) & (F.col("x") % LENSLET == 0)
    return grid(spark, times=1).select("y", "x", F.when(dark, 0).otherwise(1).alias("m"))


def thread_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A worker trace from events: one item of work per event; times in seconds rounded to 6 places."""
    return thread_log_of(table(spark, sf_dir, "events"))


def thread_log_of(e: DataFrame) -> DataFrame:
    """The trace that rows of events make; ``file`` is kept where they have it."""
    start = F.round(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)") / 1e6 - 1.7e9, 6)
    wait = F.floor("value") / 1e5
    return e.select(
        F.col("event_id").cast("long").alias("item"), (F.col("user_id") % 4).cast("int").alias("thread"), (F.col("event_id") % 4).cast("int").alias("worktype"),
        start.alias("t_start"), F.round(start + F.col("value") / 1000, 6).alias("t_end"), wait.alias("m0"), (wait * 2).alias("m1"),
        F.round(F.col("value") * 10).cast("long").alias("memory"), (F.col("event_id") % 50).cast("long").alias("dest"),
        (F.col("user_id") % 40).cast("long").alias("src1"), (F.col("event_id") % 7).cast("long").alias("src2"), *(c for c in ("file",) if c in e.columns),
    )


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trial (iter, shift, score): an optimiser's history from events."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("long").alias("iter"), F.array(F.floor(F.col("value") / 20).cast("double"), F.floor(F.col("user_id") / 3).cast("double")).alias("shift"), F.round("value", 6).alias("score")
    )


def part_psf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pyramids of ``psf`` with each ring around the phase weighted by the sizes of a tenth of all parts; mirrored phases stay alike."""
    rings = table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 10).cast("int").alias("ring")).agg(F.sum("p_size").cast("double").alias("w"))
    ring = F.abs(F.col("dv") - (F.col("b") - 1)) + F.abs(F.col("du") - (F.col("a") - 1))
    return psf(spark).withColumn("ring", ring).join(rings, "ring").select("z", "b", "a", "dv", "du", (F.col("h") * F.col("w")).alias("h"))


def scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(host, threads, wall, user_s, sys_s) of orders, with a priority as host."""
    threads = (1 + F.col("o_custkey") % 8).cast("int").alias("threads")
    sums = [F.sum(F.floor("o_totalprice")).cast("double").alias("wall"), F.sum("o_custkey").cast("double").alias("user_s"), F.count("*").cast("double").alias("sys_s")]
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("host"), threads).agg(*sums)


def batch_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, batch, seconds) of orders, with a status as kind."""
    batch = F.call_function("shiftleft", F.lit(1), (F.col("o_custkey") % 6).cast("int")).alias("batch")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("kind"), batch).agg(F.sum("o_custkey").cast("double").alias("seconds"))


def psf_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path: a file name of a point-spread function for each part."""
    k, size = F.col("p_partkey"), F.col("p_size")
    prefix = F.when(k % 3 == 0, "fdnormPSFmatrix_").when(k % 3 == 1, "reducedPSFmatrix_").otherwise("reducedBuggyPSFmatrix_")
    said = ["M", size, "NA0.", 1 + k % 9, "MLPitch", 100 + k % 50, "fml", 3000 + k % 7, "from-", 1 + size % 30, "to", k % 60, "zspacing", 1 + k % 4, "Nnum", F.lit(15), "lambda", 500 + size, "n1.", 1 + k % 5, ".mat"]
    return table(spark, sf_dir, "part").select(F.concat(F.lit("PSFmatrix/"), prefix, *(F.lit(x) if isinstance(x, str) else x.cast("string") for x in said)).alias("path"))


def spots(ids: DataFrame, height: int, width: int, reach: int = 6, sigma: float = 2.0) -> DataFrame:
    """A synthetic object (z, t, y, x, v): a unit spot for each ``id`` at that place of an even sequence, blurred; edges cut what leaves."""
    part = lambda step: F.col("id") * step - F.floor(F.col("id") * step)
    at = ids.select(F.floor(part(0.7548776662466927) * height).cast("int").alias("y"), F.floor(part(0.5698402909980532) * width).cast("int").alias("x"))
    steps = F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
    near = at.select("y", "x", steps.alias("i")).select("y", "x", "i", steps.alias("j"))
    weight = F.exp(-(F.col("i") * F.col("i") + F.col("j") * F.col("j")) / (2 * sigma**2)) / (2 * 3.141592653589793 * sigma**2)
    moved = near.select((F.col("y") + F.col("i")).alias("y"), (F.col("x") + F.col("j")).alias("x"), weight.alias("w")).where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))
    return moved.groupBy("y", "x").agg(F.sum("w").alias("v")).select(F.lit(0).alias("z"), F.lit(0).alias("t"), "y", "x", "v")
