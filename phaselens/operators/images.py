"""Operators on frames (t, y, x, v) and volumes (z, t, y, x, v)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def maximum_projection(volume: DataFrame, along: str) -> DataFrame:
    """Largest value along an axis."""
    return volume.groupBy(*[c for c in ("z", "t", "y", "x") if c != along and c in volume.columns]).agg(F.max("v").alias("v"))


def negative_energy(frame: DataFrame, floor: float) -> DataFrame:
    """By t: what values below ``floor`` take off, as a share of the rest; smallest and largest value."""
    low = F.coalesce(-F.sum(F.when(F.col("v") < floor, F.col("v"))), F.lit(0.0))
    total = F.sum("v") + low
    return frame.groupBy("t").agg(F.when(total == 0, F.lit(0.0)).otherwise(low / F.nullif(total, F.lit(0.0))).alias("share"), F.min("v").alias("least"), F.max("v").alias("most"))


def totals(volume: DataFrame) -> DataFrame:
    return volume.groupBy("t").agg(F.max("v").alias("most"), F.sum("v").alias("total"))


def floor_to(frame: DataFrame, least: float) -> DataFrame:
    return frame.withColumn("v", F.greatest("v", F.lit(least)))


def floor_relative(frame: DataFrame, share: float = 1e-5) -> DataFrame:
    """No value below a share of the largest one of all."""
    return frame.withColumn("v", F.greatest(F.col("v"), share * frame.agg(F.max("v")).scalar()))


def without_nan(frame: DataFrame) -> DataFrame:
    return frame.withColumn("v", F.nanvl("v", F.lit(0.0)))


def largest_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """most (largest absolute difference), and the first place where it is; values missing on a side are 0; NaN is largest."""
    joined = left.select(*keys, F.col("v").alias("l")).join(right.select(*keys, F.col("v").alias("r")), keys, "full")
    off = joined.select(*keys, F.abs(F.coalesce("l", F.lit(0.0)) - F.coalesce("r", F.lit(0.0))).alias("d"))
    place = F.min_by(F.struct(*keys), F.struct(-F.col("d"), *keys)).alias("at")
    return off.agg(F.max("d").alias("most"), place).select("most", *[F.col(f"at.{k}").alias(k) for k in keys])


def agrees(left: DataFrame, right: DataFrame, keys: list[str], tolerance: float) -> bool:
    """Whether no difference is more than the tolerance; NaN on either side fails."""
    most = largest_difference(left, right, keys).first()["most"]
    return most is None or most <= tolerance


def crop(frame: DataFrame, y0: int, y1: int, x0: int, x1: int) -> DataFrame:
    """Pixels from (y0, x0) to before (y1, x1), moved to the origin."""
    return frame.where(F.col("y").between(y0, y1 - 1) & F.col("x").between(x0, x1 - 1)).withColumn("y", F.col("y") - y0).withColumn("x", F.col("x") - x0)


def crop_lenslets(frame: DataFrame, n: int, height: int, width: int, left: int, right: int, top: int, bottom: int) -> DataFrame:
    """Whole lenslets off each side."""
    if left + right >= width // n or top + bottom >= height // n:
        raise ValueError("the cut is larger than the image")
    return crop(frame, top * n, height // n * n - bottom * n, left * n, width // n * n - right * n)


def centred(frame: DataFrame, now: tuple[int, int], new: tuple[int, int]) -> DataFrame:
    """The middle part of a new size."""
    y, x = (now[0] - new[0]) // 2, (now[1] - new[1]) // 2
    return crop(frame, y, y + new[0], x, x + new[1])


def shift(frame: DataFrame, dy: int, dx: int, height: int, width: int) -> DataFrame:
    """Moved by whole pixels; what leaves is gone, what comes in is 0 (missing)."""
    if int(dy) != dy or int(dx) != dx:
        raise ValueError("shifts must be whole numbers")
    moved = frame.withColumn("y", F.col("y") + int(dy)).withColumn("x", F.col("x") + int(dx))
    return moved.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))


def roll(frame: DataFrame, amount: float, size: int, axis: str = "x") -> DataFrame:
    """Moved around by a fraction: the two whole shifts beside it, weighted."""
    whole = math.floor(amount)
    part = amount - whole
    turns = F.explode(F.array(F.struct(F.lit(whole).alias("k"), F.lit(1 - part).alias("w")), F.struct(F.lit(whole + 1).alias("k"), F.lit(part).alias("w")))).alias("s")
    keys = [c for c in frame.columns if c != "v"]
    moved = frame.select("*", turns).withColumn(axis, F.pmod(F.col(axis) + F.col("s.k"), F.lit(size))).withColumn("v", F.col("v") * F.col("s.w"))
    return moved.groupBy(*keys).agg(F.sum("v").alias("v"))


def transpose(frame: DataFrame) -> DataFrame:
    return frame.withColumn("_y", F.col("y")).withColumn("y", F.col("x")).withColumn("x", F.col("_y")).drop("_y")


def flip(frame: DataFrame, axis: str, size: int) -> DataFrame:
    return frame.withColumn(axis, size - 1 - F.col(axis))


def rotate(frame: DataFrame, turns: int, size: int) -> DataFrame:
    """A square frame turned by 90 degrees counter-clockwise, ``turns`` times."""
    for _ in range(turns % 4):
        frame = flip(transpose(frame), "y", size)
    return frame


def tile(frame: DataFrame, down: int, across: int, height: int, width: int) -> DataFrame:
    """Copies side by side."""
    out = frame.select("*", F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("_i"))
    out = out.select("*", F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("_j"))
    return out.withColumn("y", F.col("y") + F.col("_i") * height).withColumn("x", F.col("x") + F.col("_j") * width).drop("_i", "_j")


def fill_from_turns(pattern: DataFrame, size: int) -> DataFrame:
    """A square pattern whose zeros are taken from it turned by 90, 180 and 270 degrees clockwise, the first that has a value."""
    out = pattern.withColumnRenamed("v", "v0")
    for k in (1, 2, 3):
        out = out.join(rotate(pattern, -k, size).withColumnRenamed("v", f"v{k}"), [c for c in pattern.columns if c != "v"], "left")
    value = F.coalesce(*(F.nullif(f"v{k}", F.lit(0.0)) for k in range(4)), F.lit(0.0))
    return out.select(*[c for c in pattern.columns if c != "v"], value.alias("v"))


def bin_pixels(frame: DataFrame, k: int, height: int, width: int) -> DataFrame:
    """Sums of k by k pixels (k odd): one cell has the middle pixel in its centre, and as many whole cells stand on either side of it as fit."""
    if k % 2 == 0:
        raise ValueError("the factor must be odd")
    beside = lambda size: ((size - 1) // 2 - k // 2) // k  # noqa: E731  cells on either side
    start = lambda size: (size - 1) // 2 - k // 2 - beside(size) * k
    y0, x0 = start(height), start(width)
    inner = crop(frame, y0, y0 + (2 * beside(height) + 1) * k, x0, x0 + (2 * beside(width) + 1) * k)
    return inner.groupBy("t", F.floor(F.col("y") / k).cast("int").alias("y"), F.floor(F.col("x") / k).cast("int").alias("x")).agg(F.sum("v").alias("v"))


def zero_border(frame: DataFrame, border: int, height: int, width: int) -> DataFrame:
    inside = F.col("y").between(border, height - 1 - border) & F.col("x").between(border, width - 1 - border)
    return frame.withColumn("v", F.when(inside, F.col("v")).otherwise(0.0))


def zero_planes(volume: DataFrame, first: int, last: int) -> DataFrame:
    return volume.withColumn("v", F.when(F.col("z").between(first, last), 0.0).otherwise(F.col("v")))


def similarity(left: DataFrame, right: DataFrame, height: int, width: int, size: int = 7, span: float = 65535.0) -> DataFrame:
    """Mean structural similarity by t over all whole windows of size by size pixels, with sample variances.

    The window sums are a join-free explode and grouped sum of five moments.
    """
    c1, c2, count = (0.01 * span) ** 2, (0.03 * span) ** 2, size * size
    both = left.select("t", "y", "x", F.col("v").alias("l")).join(right.select("t", "y", "x", F.col("v").alias("r")), ["t", "y", "x"])
    reach = F.sequence(F.lit(0), F.lit(size - 1))
    spread = both.select("t", "l", "r", "x", F.explode(F.transform(reach, lambda k: F.col("y") - k)).alias("y")).where(F.col("y").between(0, height - size))
    spread = spread.groupBy("t", "y", "x").agg(*(F.sum(e).alias(n) for n, e in (("l", F.col("l")), ("r", F.col("r")), ("ll", F.col("l") * F.col("l")), ("rr", F.col("r") * F.col("r")), ("lr", F.col("l") * F.col("r")))))
    wide = spread.select("t", "y", "l", "r", "ll", "rr", "lr", F.explode(F.transform(reach, lambda k: F.col("x") - k)).alias("x")).where(F.col("x").between(0, width - size))
    sums = wide.groupBy("t", "y", "x").agg(*(F.sum(n).alias(n) for n in ("l", "r", "ll", "rr", "lr")))
    ml, mr = F.col("l") / count, F.col("r") / count
    cov = lambda p, a, b: (F.col(p) - count * a * b) / (count - 1)
    value = (2 * ml * mr + c1) * (2 * cov("lr", ml, mr) + c2) / ((ml * ml + mr * mr + c1) * (cov("ll", ml, ml) + cov("rr", mr, mr) + c2))
    return sums.groupBy("t").agg(F.avg(value).alias("ssim"))


def half_even(value: Column) -> Column:
    """Rounded to whole numbers, halves to the even one."""
    return F.bround(value, 0)


def phases(frame: DataFrame, n: int) -> DataFrame:
    """Lenslet phase and number of each pixel."""
    return frame.select("t", (F.col("y") % n).alias("b"), (F.col("x") % n).alias("a"), F.floor(F.col("y") / n).cast("int").alias("ly"), F.floor(F.col("x") / n).cast("int").alias("lx"), "v")


def plane_share(volume: DataFrame) -> DataFrame:
    """Each value as a share of its plane's largest."""
    return volume.withColumn("share", F.col("v") / F.nullif(F.max("v").over(Window.partitionBy("z")), F.lit(0.0)))
