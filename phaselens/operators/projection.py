"""Projection of frames into volumes and back: an equi-join on plane and lenslet phase, a shift, a grouped sum.

Frames are (t, y, x, v) and volumes (z, t, y, x, v); pixels that aren't there are 0.  A map-side partial sum
comes before the only shuffle when the point-spread function is small enough for Spark to broadcast by its own
size estimate; beyond that Spark joins by sorting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check_lenslet(n: int) -> int:
    """Lenslets have an odd number of pixels."""
    if n < 1 or n % 2 == 0:
        raise ValueError("the number of pixels of a lenslet must be odd")
    return n


def _spread(pixels: DataFrame, psf: DataFrame, on: list[str], n: int, height: int, width: int) -> DataFrame:
    check_lenslet(n)
    phased = pixels.where("v <> 0").withColumn("b", F.col("y") % n).withColumn("a", F.col("x") % n)
    joined = phased.join(psf.where("h <> 0"), [*on, "b", "a"])
    moved = joined.select("z", "t", (F.col("y") + F.col("dv")).alias("y"), (F.col("x") + F.col("du")).alias("x"), (F.col("v") * F.col("h")).alias("p"))
    return moved.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))


def backward(frame: DataFrame, transposed: DataFrame, n: int, height: int, width: int) -> DataFrame:
    """Volume (z, t, y, x, v) of a frame by the transposed point-spread function; only places that are reached."""
    return _spread(frame, transposed, [], n, height, width).groupBy("z", "t", "y", "x").agg(F.sum("p").alias("v"))


def forward(volume: DataFrame, psf: DataFrame, n: int, height: int, width: int) -> DataFrame:
    """Frame (t, y, x, v) of a volume: all planes add up."""
    return _spread(volume, psf, ["z"], n, height, width).groupBy("t", "y", "x").agg(F.sum("p").alias("v"))


def planes(volume: DataFrame, chosen: list[int]) -> DataFrame:
    """Only these planes; they keep their numbers."""
    return volume.where(F.col("z").isin(chosen))


def window(volume: DataFrame, first: int, number: int) -> DataFrame:
    """``number`` planes from ``first`` on, numbered from 0."""
    return volume.where(F.col("z").between(first, first + number - 1)).withColumn("z", F.col("z") - first)
