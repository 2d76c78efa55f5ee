"""Richardson-Lucy deconvolution of batches of frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phaselens.operators import block as blocks
from phaselens.operators.projection import backward, forward
from phaselens.operators.psf import transpose
from phaselens.plans.lineage import cut


def ratio(n: Column, d: Column) -> Column:
    """n / d in IEEE terms: 0 / 0 counts as 0, other divisions by 0 as infinity."""
    return F.when(d != 0, n / F.nullif(d, F.lit(0.0))).when(n == 0, 0.0).when(n > 0, float("inf")).otherwise(float("-inf"))


def updated(x: Column, factor: Column) -> Column:
    """x times factor, where not-a-number (0 times infinity) counts as 0."""
    return F.nanvl(x * factor, F.lit(0.0))


def require_dark(frame: DataFrame, mask: DataFrame) -> None:
    """A masked frame must be 0 where the mask is."""
    if not frame.join(mask.where("m = 0"), ["y", "x"]).where("v <> 0").isEmpty():
        raise ValueError("the frame has light where the mask is 0")


def spectra_pair(psf: DataFrame, n: int, height: int, width: int, backend: str = "fft") -> tuple[blocks.Spectra, blocks.Spectra]:
    """Kept spectra of a point-spread function and of the transposed one, to be dropped when they aren't needed any more."""
    return blocks.spectra(psf, n, height, width, backend), blocks.spectra(transpose(psf, n), n, height, width, backend)


def deconvolve(
    frame: DataFrame, psf: DataFrame, n: int, height: int, width: int, iterations: int, standard: bool = False, mask: DataFrame | None = None, guess: DataFrame | None = None, each: Callable[[int, DataFrame], None] | None = None,
    block: bool | None = None, kept: tuple[blocks.Spectra, blocks.Spectra] | None = None, backend: str = "fft",
) -> DataFrame:
    """Volume (z, t, y, x, v) after ``iterations`` updates, from the back projection or ``guess``.

    The update of the default form is v * Htf / Ht(H v), where Htf is the frame's back projection; that of the standard
    form v * Ht(frame / H v), divided by the mask's back projection if there is one (a mask needs the standard form).  Each
    iteration is checkpointed, so plans don't grow.  ``each`` is told each iteration's volume.  Only touched pixels hold
    infinities: the sums are exact and don't spread them.  ``block`` takes Fourier transforms of whole frames (by ``backend``)
    instead of the join; by default it is taken where the join would make too many rows.  Both give the same rows for light and taps
    that aren't negative.  ``kept`` are spectra of ``spectra_pair``, for many calls with one point-spread function; else they are made here.
    """
    if mask is not None and not standard:
        raise ValueError("a mask needs the standard form")
    if mask is not None:
        require_dark(frame, mask)
    if block or kept or (block is None and blocks.prefer_block(psf, n, height, width)):
        own = kept or spectra_pair(psf, n, height, width, backend)
        try:
            return blocks.deconvolve(frame, own, height, width, iterations, standard, mask, guess, each)
        finally:
            for x in own if kept is None else ():
                x.drop()
    back = transpose(psf, n)
    place = ["z", "t", "y", "x"]
    start = cut(backward(frame, back, n, height, width))
    now = guess if guess is not None else start
    trust = None
    if mask is not None:
        lit = mask.where("m <> 0").select(F.lit(0).alias("t"), "y", "x", F.lit(1.0).alias("v"))
        trust = cut(backward(lit, back, n, height, width).select("z", "y", "x", F.col("v").alias("trust")))
    for k in range(iterations):
        seen = forward(now, psf, n, height, width)
        if standard:
            error = frame.join(seen.withColumnRenamed("v", "s"), ["t", "y", "x"], "left").select("t", "y", "x", ratio(F.col("v"), F.coalesce("s", F.lit(0.0))).alias("v"))
            factor = backward(error, back, n, height, width).select(*place, F.col("v").alias("f"))
            step = now.join(factor, place, "left").withColumn("f", F.coalesce("f", F.lit(0.0)))
            if trust is not None:
                step = step.join(trust, ["z", "y", "x"], "left").withColumn("f", ratio(F.col("f"), F.coalesce("trust", F.lit(0.0))))
        else:
            again = backward(seen, back, n, height, width).select(*place, F.col("v").alias("d"))
            step = now.join(start.select(*place, F.col("v").alias("s")), place, "left").join(again, place, "left")
            step = step.withColumn("f", ratio(F.coalesce("s", F.lit(0.0)), F.coalesce("d", F.lit(0.0))))
        now = cut(step.select(*place, updated(F.col("v"), F.col("f")).alias("v")))
        if each:
            each(k, now)
    return now


def residual(volume: DataFrame, frame: DataFrame, psf: DataFrame, n: int, height: int, width: int, first: int, last: int, box: tuple[int, int, int, int], floor: float = 0.0) -> DataFrame:
    """What a frame shows beside the planes from first to last: these are projected and taken off, cropped to box (y0, y1, x0, x1) and floored."""
    others = forward(volume.where(~F.col("z").between(first, last)), psf, n, height, width).withColumnRenamed("v", "s")
    y0, y1, x0, x1 = box
    rest = frame.where(F.col("y").between(y0, y1 - 1) & F.col("x").between(x0, x1 - 1)).join(others, ["t", "y", "x"], "left")
    return rest.select("t", "y", "x", F.greatest(F.col("v") - F.coalesce("s", F.lit(0.0)), F.lit(floor)).alias("v"))


def batches(frames: DataFrame, size: int) -> DataFrame:
    """Frames with the number of their batch of ``size`` time points; the last may be short."""
    return frames.withColumn("batch", F.floor(F.col("t") / size).cast("int"))
