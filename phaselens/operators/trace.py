"""Analysis of worker traces, thread scaling, batch timings and optimiser histories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phaselens.plans.lineage import numbered


def summary(log: DataFrame) -> DataFrame:
    """By kind of work: items, time, waits; a row with worktype -1 is for all, with wall time and parallelism."""
    items = [F.count("*").alias("items"), F.sum(F.col("t_end") - F.col("t_start")).alias("busy"), F.sum(F.col("m0") + F.col("m1")).alias("waited")]
    wall = F.max("t_end") - F.min("t_start")
    each = log.groupBy("worktype").agg(*items, wall.alias("wall"))
    whole = log.agg(*items, wall.alias("wall")).select(F.lit(-1).alias("worktype"), "items", "busy", "waited", "wall")
    return each.unionByName(whole).withColumn("parallelism", F.col("busy") / F.nullif("wall", F.lit(0.0)))


def reuse_distance(sequence: DataFrame, order: str, mutex: str) -> DataFrame:
    """How many places ago the same mutex was taken; 0 if never."""
    last = previous(sequence.select(order, mutex), [mutex], order, order)
    return last.select(order, mutex, F.coalesce(F.col(order) - F.col("before"), F.lit(0)).alias("distance"))


def efficiency(scaling: DataFrame) -> DataFrame:
    """By host: wall time times threads of the fewest threads, over the same of each row; share of the last row's time."""
    w = Window.partitionBy("host").orderBy("threads").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.first(F.col("wall") * F.col("threads")).over(w)
    return scaling.select("host", "threads", "wall", (first / (F.col("wall") * F.col("threads"))).alias("efficiency"), (F.last("wall").over(w) / F.first("wall").over(w)).alias("fraction"))


def excess(scaling: DataFrame) -> DataFrame:
    """Run time over an ideal share of the first row's."""
    w = Window.partitionBy("host").orderBy("threads")
    return scaling.select("host", "threads", (F.col("wall") / (F.first("wall").over(w) * F.first("threads").over(w) / F.col("threads"))).alias("excess"))


def changed(trials: DataFrame) -> DataFrame:
    """Elements of the shift that differ from the previous trial's: (iter, k, value)."""
    each = previous(trials.select("iter", F.posexplode("shift").alias("k", "value")), ["k"], "iter", "value")
    return each.where(F.col("before").isNotNull() & (F.col("value") != F.col("before"))).select("iter", "k", "value")


def runs(trials: DataFrame, least: int = 2) -> DataFrame:
    """Stretches of more than ``least`` trials in which an element keeps its value: (k, value, first, last, number)."""
    each = previous(trials.select("iter", F.posexplode("shift").alias("k", "value")), ["k"], "iter", "value")
    marked = running_sum(each.withColumn("_fresh", F.when(F.col("value") == F.col("before"), 0).otherwise(1)), ["k"], "iter", "_fresh", "run")
    return marked.groupBy("k", "run").agg(F.first("value").alias("value"), F.min("iter").alias("first"), F.max("iter").alias("last"), F.count("*").alias("number")).where(F.col("number") > least).drop("run")


def previous(rows: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """``rows`` with before: the value of the row before, by ``order``, among those of equal keys; null for the first.

    Windows hold a range of ``order`` of one key.  A range's first row gets the last value of the key's range before, of which there is a
    row for each range, so a key with most of the rows is no task of its own.
    """
    dealt = _ranges(rows, order)
    w = Window.partitionBy(*key, "part").orderBy(order)
    ends = dealt.groupBy(*key, "part").agg(F.max_by(F.struct(value), order).alias("_end"))
    ends = ends.select(*key, "part", F.lag("_end").over(Window.partitionBy(*key).orderBy("part")).alias("_carried"))
    own = dealt.withColumn("_own", F.lag(F.struct(value)).over(w)).join(ends, [*key, "part"])
    return own.select(*rows.columns, F.coalesce("_own", "_carried")[value].alias("before"))


def running_sum(rows: DataFrame, key: list[str], order: str, value: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` up to each row, by ``order``, among those of equal keys; sums of whole earlier ranges are carried over."""
    dealt = _ranges(rows, order)
    own = F.sum(value).over(Window.partitionBy(*key, "part").orderBy(order))
    ends = dealt.groupBy(*key, "part").agg(F.sum(value).alias("_sum"))
    earlier = F.sum("_sum").over(Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select(*key, "part", F.coalesce(earlier, F.lit(0)).alias("_carried"))
    return dealt.withColumn("_own", own).join(ends, [*key, "part"]).select(*rows.columns, (F.col("_own") + F.col("_carried")).alias(name))


def _ranges(rows: DataFrame, order: str, least: int = 64, each: int = 100_000) -> DataFrame:
    """``rows`` with part: ranges of ``order`` of equal width, as many as the number of rows asks for."""
    ends = rows.agg(F.min(order).alias("a"), F.max(order).alias("b"), F.count("*").alias("n")).first()
    parts = max(least, -(-ends["n"] // each))
    width = ((ends["b"] - ends["a"]) / parts or 1) if ends["a"] is not None else 1
    low = ends["a"] if ends["a"] is not None else 0
    return rows.withColumn("part", F.least(F.floor((F.col(order) - low) / width), F.lit(parts)))


def best_so_far(trials: DataFrame) -> DataFrame:
    """Running minimum of the score and how far it is below the first.

    Trials are cut into ranges of iterations; minima of whole earlier ranges are carried over, so no window spans the table.
    """
    cut = _ranges(trials.select("iter", "score"), "iter")
    ends = cut.groupBy("part").agg(F.min("score").alias("least"), F.min_by("score", "iter").alias("head"))
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    before = ends.select("part", F.min("least").over(w).alias("before"), F.first("head").over(Window.orderBy("part")).alias("start"))
    own = F.min("score").over(Window.partitionBy("part").orderBy("iter"))
    out = cut.join(before, "part").select("iter", "score", F.least(own, F.col("before")).alias("best"), "start")
    return out.select("iter", "score", "best", (F.col("start") - F.col("best")).alias("improvement"))


def best_trial(trials: DataFrame) -> DataFrame:
    """The least score and the shift of the first trial that has it."""
    return trials.agg(F.min("score").alias("score"), F.min_by("shift", F.struct("score", "iter")).alias("shift"))


def high_water(log: DataFrame) -> DataFrame:
    """Largest memory so far, by start, within each thread; whole earlier ranges of time are carried over as one row each."""
    cut = _ranges(log.select("thread", "item", "t_start", "memory"), "t_start")
    ends = cut.groupBy("thread", "part").agg(F.max("memory").alias("most"))
    earlier = F.max("most").over(Window.partitionBy("thread").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    own = F.max("memory").over(Window.partitionBy("thread", "part").orderBy("t_start", "item").rowsBetween(Window.unboundedPreceding, 0))
    both = cut.join(ends.select("thread", "part", earlier.alias("before")), ["thread", "part"])
    return both.select("thread", "item", "t_start", F.greatest(own, F.col("before")).alias("high"))


def buffer_ids(log: DataFrame) -> DataFrame:
    """Dense numbers for the buffers that items touch, from 1 by address, without the null buffer 0; 0 stays 0."""
    used = log.select(F.explode(F.array("dest", "src1", "src2")).alias("address")).distinct().where("address <> 0")
    ids = numbered(used.orderBy("address"), "id", 1).withColumn("id", F.col("id").cast("int"))
    out = log.select("item", "dest", "src1", "src2")
    for c in ("dest", "src1", "src2"):
        out = out.join(ids.select(F.col("address").alias(c), F.col("id").alias(f"{c}_id")), c, "left").withColumn(f"{c}_id", F.coalesce(f"{c}_id", F.lit(0)))
    return out.select("item", "dest_id", "src1_id", "src2_id")


def first_seen(log: DataFrame, column: str, order: str) -> DataFrame:
    """Distinct values in the order of their first occurrence."""
    return log.groupBy(column).agg(F.min(order).alias("first"))


def histogram(values: DataFrame, value: str, bins: int, low: Column | None = None, high: Column | None = None) -> DataFrame:
    """(bin, number): equal bins from low to high, or from the least to the largest value; the last one holds its upper end."""
    ends = values.agg(F.min(value).alias("a"), F.max(value).alias("b"))
    a, b = low if low is not None else ends.select("a").scalar(), high if high is not None else ends.select("b").scalar()
    ranged = values.select(F.col(value).alias("v"), a.alias("a"), b.alias("b")).where("v between a and b")
    width = (F.col("b") - F.col("a")) / bins
    at = F.when(F.col("b") == F.col("a"), 0).otherwise(F.least(F.floor((F.col("v") - F.col("a")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1)))
    return ranged.groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("number"))


def fit_line(points: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """Least-squares gradient and baseline."""
    return points.groupBy(by).agg(F.regr_slope(y, x).alias("gradient"), F.regr_intercept(y, x).alias("baseline"))


def per_image(points: DataFrame) -> DataFrame:
    return points.withColumn("each", F.col("seconds") / F.col("batch"))


def work_order(items: DataFrame, threads: int, times: int) -> DataFrame:
    """The order in which work is taken: by root's order, root plane in groups, chain length, plane in groups, and sequence."""
    k = 1 + threads // times
    return items.orderBy("root_order", F.floor(F.col("root_plane") / k), "depth", F.floor(F.col("plane") / k), "seq")


def work_places(items: DataFrame, threads: int, times: int) -> DataFrame:
    """``items`` with their place (from 1) in ``work_order``."""
    return numbered(work_order(items, threads, times), "place", 1)


def compare_runs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two runs of equal length item by item: both times and the ratio of their means by kind of work."""
    both = left.select("item", "worktype", (F.col("t_end") - F.col("t_start")).alias("l")).join(right.select("item", (F.col("t_end") - F.col("t_start")).alias("r")), "item")
    return both.groupBy("worktype").agg(F.avg("l").alias("left"), F.avg("r").alias("right")).withColumn("ratio", F.col("right") / F.nullif("left", F.lit(0.0)))


def span(log: DataFrame, by: str) -> DataFrame:
    """Threads (largest number plus one) and wall time of each run."""
    return log.groupBy(by).agg((F.max("thread") + 1).alias("threads"), (F.max("t_end") - F.min("t_start")).alias("wall"))


def in_window(log: DataFrame, low: float, high: float, wait: float = 5e-6) -> DataFrame:
    """Items that overlap a stretch of time, with whether they waited longer than ``wait``."""
    return log.where((F.col("t_end") >= low) & (F.col("t_start") <= high)).withColumn("waited", F.col("m0") + F.col("m1") > wait)


def thread_lanes(log: DataFrame, wait: float = 5e-6) -> DataFrame:
    """By kind of work and thread: items, busy time, waits above the threshold and buffers written."""
    waits = F.col("m0") + F.col("m1")
    return log.groupBy("worktype", "thread").agg(
        F.count("*").alias("items"), F.sum(F.col("t_end") - F.col("t_start")).alias("busy"), F.sum(F.when(waits > wait, waits).otherwise(0.0)).alias("waited"), F.count_distinct("dest").alias("buffers")
    )


def compare_in_order(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two runs item by item as they started: place, both times and their ratio.  Runs of different length are an error."""
    sides = [numbered(x.select("t_start", "item", (F.col("t_end") - F.col("t_start")).alias(n)).orderBy("t_start", "item"), "place").select("place", n) for x, n in ((left, "left"), (right, "right"))]
    if sides[0].count() != sides[1].count():
        raise ValueError("the runs have different numbers of items")
    return sides[0].join(sides[1], "place").withColumn("ratio", F.col("right") / F.nullif("left", F.lit(0.0)))


def work_ratio(stats: DataFrame) -> DataFrame:
    """By host: work time over that of the fewest threads, and the shares of all threads' time that was idle, at all and before the start."""
    w = Window.partitionBy("host").orderBy("threads")
    room = F.col("threads") * F.col("wall")
    dead = F.col("idle_start") + F.col("idle_between") + F.col("idle_end")
    return stats.select("host", "threads", (F.col("work") / F.first("work").over(w)).alias("work_ratio"), (dead / room).alias("dead_time"), (F.col("idle_start") / room).alias("dead_start"))


def cpu_time(stats: DataFrame) -> DataFrame:
    """User and system time together."""
    return stats.withColumn("cpu", F.col("user_s") + F.col("sys_s"))


def throughput(runs_: DataFrame, by: str, amount: str, seconds: str) -> DataFrame:
    """Mean amount a second of each kind, and the gradient of the averages."""
    return runs_.groupBy(by).agg(F.avg(F.col(amount) / F.col(seconds)).alias("rate"), (F.avg(amount) / F.avg(seconds)).alias("gradient"))


def best_setting(tries: DataFrame, setting: str, order: str, seconds: str, slack: float = 1.5) -> DataFrame:
    """The setting with the least mean time.  A setting counts by its first try alone where that takes more than ``slack`` times the best mean.

    tries holds several timings of each setting; ``order`` says which came first.
    """
    each = tries.groupBy(setting).agg(F.avg(seconds).alias("mean"), F.min_by(seconds, order).alias("once"))
    best = each.agg(F.min("mean").alias("m")).scalar()
    judged = each.select(setting, F.when(F.col("once") > slack * best, F.col("once")).otherwise(F.col("mean")).alias("seconds"))
    return judged.agg(F.min_by(setting, F.struct("seconds", setting)).alias(setting), F.min("seconds").alias("seconds"))


def tally(checks: DataFrame, by: str) -> DataFrame:
    """How many checks of each group passed, and of all (group -1)."""
    each = [F.sum(F.col("passed").cast("long")).alias("passed"), F.count("*").alias("total")]
    return checks.groupBy(by).agg(*each).unionByName(checks.agg(*each).select(F.lit(-1).cast(checks.schema[by].dataType).alias(by), "passed", "total"))


def earliest(log: DataFrame, number: int) -> DataFrame:
    """The first accesses of buffers, in the order of their start."""
    return log.orderBy("t_start", "item").limit(number)


def costliest(log: DataFrame, by: str, number: int = 40) -> DataFrame:
    """Kinds of work with the most time in all, most first."""
    each = log.groupBy(by).agg(F.count("*").alias("calls"), F.sum(F.col("t_end") - F.col("t_start")).alias("cumulative"))
    return each.orderBy(F.desc("cumulative"), by).limit(number)


def argsort(values: DataFrame, value: str, key: str) -> DataFrame:
    """Each row's place from 0 among all by value, equal ones by key."""
    return numbered(values.select(key, value).orderBy(value, key), "place")


def first_below(points: DataFrame, place: str, value: str, limit: float) -> int:
    """The first place at which the value is below the limit; an error if there is none."""
    found = points.agg(F.min(F.when(F.col(value) < limit, F.col(place))).alias("p")).first()["p"]
    if found is None:
        raise ValueError("no value is below the limit")
    return found


def above(points: DataFrame, value: str, tolerance: float) -> DataFrame:
    """Points whose value counts."""
    return points.where(F.col(value) > tolerance)


def appended(parts: list[DataFrame]) -> DataFrame:
    """Results of batches, one after the other."""
    return reduce(DataFrame.unionByName, parts)


def cache_key(*parts: Column) -> Column:
    """What names a kept transform: its numbers with commas between."""
    return F.concat_ws(",", *(p.cast("string") for p in parts))
