"""Tables of point-spread functions: psf (z, b, a, dv, du, h) holds the non-zero taps of each plane and lenslet phase."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def transpose(psf: DataFrame, n: int) -> DataFrame:
    """The adjoint: a tap from phase (b, a) by (dv, du) becomes one from where it lands, back again."""
    return psf.select("z", F.pmod(F.col("b") + F.col("dv"), F.lit(n)).alias("b"), F.pmod(F.col("a") + F.col("du"), F.lit(n)).alias("a"), (-F.col("dv")).alias("dv"), (-F.col("du")).alias("du"), "h")


def quadrant(psf: DataFrame, n: int) -> DataFrame:
    """The phases up to the middle one of both axes, which are all that is stored."""
    c = (n - 1) // 2
    return psf.where(F.col("b").between(0, c) & F.col("a").between(0, c))


def expand(quarter: DataFrame, n: int) -> DataFrame:
    """All phases from a stored quadrant by its mirror images and their transposes; each tap once."""
    b, a, v, u = (F.col(c) for c in ("b", "a", "dv", "du"))
    forms = []
    for flip_b in (False, True):
        for flip_a in (False, True):
            first = (F.lit(n - 1) - b if flip_b else b, -v if flip_b else v)
            second = (F.lit(n - 1) - a if flip_a else a, -u if flip_a else u)
            for p, q in ((first, second), (second, first)):
                forms.append(F.struct(p[0].alias("b"), q[0].alias("a"), p[1].alias("dv"), q[1].alias("du")))
    return quarter.select("z", F.explode(F.array_distinct(F.array(*forms))).alias("f"), "h").select("z", "f.b", "f.a", "f.dv", "f.du", "h").dropDuplicates(["z", "b", "a", "dv", "du"])


def crop(psf: DataFrame, meta: DataFrame, size: Column | None = None) -> DataFrame:
    """Taps inside each plane's window: meta (z, s, ca_lo, ca_hi), the window 1-based and inclusive in an array of s by s."""
    middle = (F.col("s") - 1) / 2
    inside = lambda c: (F.col(c) + middle + 1).between(F.col("ca_lo"), F.col("ca_hi"))
    return psf.join(meta.select("z", "s", "ca_lo", "ca_hi"), "z").where(inside("dv") & inside("du")).select(psf.columns)


def clip_planes(psf: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Without the taps below ``tolerance`` of their plane's maximum."""
    top = F.max("h").over(Window.partitionBy("z"))
    return psf.withColumn("_top", top).where(F.col("h") >= tolerance * F.col("_top")).drop("_top")


def normalise_flux(psf: DataFrame) -> DataFrame:
    """Each phase of each plane sums to 1; phases that sum to 0 have no taps left."""
    total = psf.groupBy("z", "b", "a").agg(F.sum("h").alias("_sum"))
    return psf.join(total, ["z", "b", "a"]).where("_sum <> 0").withColumn("h", F.col("h") / F.col("_sum")).drop("_sum")


def normalise_max(psf: DataFrame) -> DataFrame:
    """Divided by the largest tap of all planes; hmax keeps it."""
    top = psf.agg(F.max("h").alias("hmax"))
    return psf.withColumn("hmax", top.scalar()).where("hmax <> 0").withColumn("h", F.col("h") / F.col("hmax"))


def valid_window(planes: DataFrame, n: int, size: int, reference: int, far: Column) -> DataFrame:
    """planes (z, depth) with each plane's window ca_lo, ca_hi (1-based, inclusive) in an array of ``size``.

    Half the width is a share of the reference size, in lenslets, by depth; two lenslets at least.
    """
    centre = F.ceil(F.lit(size) / 2)
    half = F.greatest(n * F.ceil(reference * F.abs("depth") / far), F.lit(2 * n))
    return planes.select("z", F.greatest(centre - half, F.lit(1)).cast("int").alias("ca_lo"), F.least(centre + half, F.lit(size)).cast("int").alias("ca_hi"))
