"""Rectification: lenslet images resampled to a whole, odd number of pixels per lenslet."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phaselens.operators.images import crop_lenslets
from phaselens.operators.projection import check_lenslet

#: Sample positions up to and including an end are reached within this.
SLACK = 1e-10


def positions(centre: int, period: float, n: int, size: int) -> list[float]:
    """Sample positions of one axis, 0-based, that are kept after trimming to whole lenslets.

    Samples stand period / n apart through the pixel after the 1-based centre: ``before`` of them in front of it, ``after``
    behind.  ``lead`` samples up to a whole lenslet are cut in front, one more than that behind, and then what isn't a whole lenslet.
    """
    check_lenslet(n)
    step = period / n
    before = math.ceil((centre + SLACK) / step) - 1
    after = max(0, math.ceil((size - centre - 1 + SLACK) / step) - 1)
    lead = n - 1 + (before + 1 - n // 2) % n
    whole = max(0, (before + after - 2 * lead) // n * n)
    return [centre + (lead - before + k) * step for k in range(whole)]


def rectify(
    frame: DataFrame, x_centre: int, y_centre: int, period: float, n: int, height: int, width: int, cut: tuple[int, int, int, int] | None = None
) -> DataFrame:
    """(t, y, x, v): bilinear samples at the rectified positions; ``cut`` takes lenslets off (left, right, top, bottom).

    Each source pixel goes to the samples it is a corner of: a broadcast-free equi-join on pixel coordinates, then a sum.
    """
    xs, ys = positions(x_centre, period, n, width), positions(y_centre, period, n, height)
    spark = frame.sparkSession

    def corners(points: list[float], size: int, name: str) -> DataFrame:
        """(pixel, sample, weight) of one axis: as many rows as twice its samples."""
        index = F.posexplode(F.array(*map(F.lit, points)) if points else F.array().cast("array<double>")).alias("s", "p")
        at = spark.range(1).select(index).withColumn("p", F.greatest(F.lit(0.0), F.least(F.lit(float(size - 1)), F.col("p"))))
        low = F.least(F.floor("p"), F.lit(size - 2))
        part = F.col("p") - low
        pairs = F.array(F.struct(low.cast("int").alias("c"), (1 - part).alias("w")), F.struct((low + 1).cast("int").alias("c"), part.alias("w")))
        return at.select(F.col("s").alias(f"s{name}"), F.explode(pairs).alias("k")).select(f"s{name}", F.col("k.c").alias(name), F.col("k.w").alias(f"w{name}"))

    weighted = frame.join(corners(ys, height, "y"), "y").join(corners(xs, width, "x"), "x")
    out = weighted.groupBy("t", F.col("sy").alias("y"), F.col("sx").alias("x")).agg(F.sum(F.col("v") * F.col("wy") * F.col("wx")).alias("v"))
    return crop_lenslets(out, n, len(ys), len(xs), *cut) if cut else out


def quantise(frame: DataFrame, kind: str = "uint8") -> DataFrame:
    """Values as a camera's whole numbers: halves to the even one, kept within the type's range."""
    top = {"uint8": 255, "uint16": 65535}[kind]
    return frame.withColumn("v", F.greatest(F.lit(0), F.least(F.lit(top), F.bround("v", 0).cast("int"))))
