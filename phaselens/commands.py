"""Files in, files out: deconvolution of time series and rectification, as functions and as commands.

``python -m phaselens.commands deconvolve -p PSF -d OUT IMAGES...`` and ``python -m phaselens.commands rectify -x X -y Y -d PERIOD -n N IMAGES...``.
Images of a time series are rectified ones of one size; results are named after them.
"""

from __future__ import annotations

import argparse
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phaselens.functions.names import base_name, deconvolved_name, rectified_name
from phaselens.operators.block import prefer_block
from phaselens.operators.deconvolution import batches, deconvolve, spectra_pair
from phaselens.operators.rectify import quantise, rectify
from phaselens.plans.shipping import ship
from phaselens.sources.files import load_psf, read_images, time_points, write_images


def deconvolve_files(spark: SparkSession, folder: str, psf: str, out: str, pattern: str = "*.tif", batch: int = 32, iterations: int = 8, block: bool | None = None) -> DataFrame:
    """(path, bytes) of the volumes written for the images of a folder, in the order of their names, ``batch`` of them at once.

    ``psf`` names a point-spread function, which is made if it isn't there.  Results are <name>_deconvolved.tif, planes one below the other.
    """
    if batch < 1 or iterations < 1:
        raise ValueError("the batch and the number of iterations must be 1 or more")
    ship(spark)
    taps, _, optics = load_psf(spark, psf)
    n = optics.first()["nnum"]
    images = read_images(spark, folder, pattern)
    size = images.select("h", "w").first()
    if size is None:
        return spark.createDataFrame([], "path string, bytes long")
    height, width = size
    frames = time_points(images)
    paths = [r["path"] for r in images.select("path").distinct().orderBy("path").collect()]
    numbered = batches(frames, batch)
    done = []
    # kernels are transformed once for all batches
    kept = spectra_pair(taps, n, height, width) if block or (block is None and prefer_block(taps, n, height, width)) else None
    for k in range(-(-len(paths) // batch)):
        volume = deconvolve(numbered.where(F.col("batch") == k).select("t", "y", "x", "v"), taps, n, height, width, iterations, block=bool(kept), kept=kept)
        own = spark.createDataFrame([(t, p) for t, p in enumerate(paths) if t // batch == k], "t int, path string")
        named = volume.join(own.select("t", deconvolved_name(base_name(F.col("path"))).alias("name")), "t")
        done += [tuple(r) for r in write_images(named.select("name", "z", "y", "x", "v"), out, height, width).collect()]
    for x in kept or ():
        x.drop()
    return spark.createDataFrame(done, "path string, bytes long")


def rectify_files(
    spark: SparkSession, folder: str, out: str, x_centre: int, y_centre: int, period: float, n: int, pattern: str = "*.tif", cut: tuple[int, int, int, int] | None = None
) -> DataFrame:
    """(path, bytes) of the rectified images <name>_N<n>.<extension>, in the sources' types with halves to the even number.

    Images of each size are rectified together; those that aren't two-dimensional are left out.
    """
    ship(spark)
    images = read_images(spark, folder, pattern)
    done = []
    for h, w, kind in [tuple(r) for r in images.select("h", "w", "dtype").distinct().collect()]:
        alike = images.where((F.col("h") == h) & (F.col("w") == w) & (F.col("dtype") == kind))
        frame = time_points(alike)
        names = alike.select("path").distinct().orderBy("path").collect()
        own = spark.createDataFrame([(t, r["path"]) for t, r in enumerate(names)], "t int, path string")
        flat = rectify(frame, x_centre, y_centre, period, n, h, w, cut)
        whole = quantise(flat, kind) if kind in ("uint8", "uint16") else flat
        size = flat.agg(F.max("y").alias("y"), F.max("x").alias("x")).first()
        if size["y"] is None:
            continue
        named = whole.join(own.select("t", rectified_name(base_name(F.col("path")), n).alias("name")), "t").select("name", "y", "x", "v")
        done += [tuple(r) for r in write_images(named, out, size["y"] + 1, size["x"] + 1, kind).collect()]
    return spark.createDataFrame(done, "path string, bytes long")


def main(words: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="phaselens", description=__doc__.splitlines()[0])
    kinds = parser.add_subparsers(dest="command", required=True)
    one = kinds.add_parser("deconvolve", help="a time series of rectified images")
    one.add_argument("-b", "--batch-size", type=int, default=32)
    one.add_argument("-i", "--iters", type=int, default=8)
    one.add_argument("-d", "--dest", default=".")
    one.add_argument("-p", "--psf", required=True)
    one.add_argument("--form", choices=["auto", "join", "block"], default="auto")
    one.add_argument("folder")
    one.add_argument("--pattern", default="*.tif")
    two = kinds.add_parser("rectify", help="raw images")
    two.add_argument("-x", "--x-center", type=float, required=True)
    two.add_argument("-y", "--y-center", type=float, required=True)
    two.add_argument("-d", "--dx", type=float, required=True)
    two.add_argument("-n", "--Nnum", type=int, required=True)
    two.add_argument("-c", "--crop", action="store_true")
    for letter, side in (("l", "left"), ("r", "right"), ("t", "top"), ("b", "bottom")):
        two.add_argument(f"-{letter}", f"--crop-{side}", type=int, default=0)
    two.add_argument("-o", "--output-dir", default="Data/02_Rectified")
    two.add_argument("folder")
    two.add_argument("--pattern", default="*.tif")
    args = parser.parse_args(words)
    spark = SparkSession.builder.appName(f"phaselens {args.command}").getOrCreate()
    if args.command == "deconvolve":
        block = {"auto": None, "join": False, "block": True}[args.form]
        made = deconvolve_files(spark, args.folder, args.psf, _place(args.dest), args.pattern, args.batch_size, args.iters, block)
    else:
        cut = (args.crop_left, args.crop_right, args.crop_top, args.crop_bottom) if args.crop else None
        made = rectify_files(spark, args.folder, _place(args.output_dir), args.x_center, args.y_center, args.dx, args.Nnum, args.pattern, cut)
    for row in made.orderBy("path").collect():
        print(row["path"], row["bytes"])


def _place(folder: str) -> str:
    return folder if "://" in folder else os.path.abspath(folder)


if __name__ == "__main__":
    main()
