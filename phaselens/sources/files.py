"""Files: image frames, point-spread function tables, traces, tab-separated logs, and flat arrays of other tools."""

from __future__ import annotations

import struct
import uuid
import warnings
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phaselens.functions.names import base_name, parse_psf_names, plane_name, require_generated, without_comment
from phaselens.operators.projection import backward, forward
from phaselens.operators.psf import expand, transpose
from phaselens.operators.synthesis import Optics, synthesise
from phaselens.plans.lineage import cut, numbered
from phaselens.sources.hdf5 import read_psf_file

FRAME = "path string, h int, w int, dtype string, px array<float>"
#: Columns of a worker trace, in order (fixed values).
TRACE = "thread int, worktype int, t_start double, t_end double, m0s double, m0e double, m1s double, m1e double, memory bigint, dest bigint, src1 bigint, src2 bigint"


def decode_tiff(raw: bytes) -> tuple[int, int, str, np.ndarray] | None:
    """Height, width, type and pixels of a grey image in strips or tiles, plain or deflated; None for anything else."""
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if not order or len(raw) < 8 or struct.unpack(order + "H", raw[2:4])[0] != 42:
        return None
    at = struct.unpack(order + "I", raw[4:8])[0]
    tags: dict[int, list[int]] = {}
    for k in range(struct.unpack(order + "H", raw[at : at + 2])[0]):
        tag, kind, count = struct.unpack(order + "HHI", raw[at + 2 + 12 * k : at + 10 + 12 * k])
        letter = {1: "B", 3: "H", 4: "I"}.get(kind)
        if letter:
            size = struct.calcsize(order + letter) * count
            place = at + 10 + 12 * k
            place = struct.unpack(order + "I", raw[place : place + 4])[0] if size > 4 else place
            tags[tag] = list(struct.unpack(f"{order}{count}{letter}", raw[place : place + size]))
    width, height, bits = (tags.get(t, [0])[0] for t in (256, 257, 258))
    packed = {1: bytes, 8: zlib.decompress, 32946: zlib.decompress}.get(tags.get(259, [1])[0])
    kind = {(8, 1): "u1", (16, 1): "u2", (32, 1): "u4", (8, 2): "i1", (16, 2): "i2", (32, 2): "i4", (16, 3): "f2", (32, 3): "f4", (64, 3): "f8"}.get((bits, tags.get(339, [1])[0]))
    if not packed or not kind or tags.get(277, [1])[0] != 1 or tags.get(317, [1])[0] != 1 or not width or not height:
        return None
    if 324 in tags:
        px = _untiled([packed(raw[o : o + n]) for o, n in zip(tags[324], tags[325], strict=True)], order + kind, height, width, tags[323][0], tags[322][0])
    elif 273 in tags:
        lengths = tags.get(279, [height * width * bits // 8])
        px = np.frombuffer(b"".join(packed(raw[o : o + n]) for o, n in zip(tags[273], lengths, strict=True)), order + kind)
    else:
        return None
    return (height, width, np.dtype(kind).name, px.astype(np.float32)) if len(px) == height * width else None


def _untiled(tiles: list[bytes], kind: str, height: int, width: int, rows: int, cols: int) -> np.ndarray:
    across = -(-width // cols)
    whole = np.zeros((-(-height // rows) * rows, across * cols), kind)
    for k, tile in enumerate(tiles):
        y, x = k // across * rows, k % across * cols
        whole[y : y + rows, x : x + cols] = np.frombuffer(tile, kind).reshape(rows, cols)
    return whole[:height, :width].ravel()


def encode_tiff(pixels: np.ndarray) -> bytes:
    """An uncompressed grey image of one strip."""
    pixels = np.ascontiguousarray(pixels)
    kind = {"uint8": (8, 1), "uint16": (16, 1), "uint32": (32, 1), "int16": (16, 2), "float32": (32, 3), "float64": (64, 3)}[pixels.dtype.name]
    tags = [(256, 4, pixels.shape[1]), (257, 4, pixels.shape[0]), (258, 3, kind[0]), (259, 3, 1), (262, 3, 1), (273, 4, 8), (277, 3, 1), (278, 4, pixels.shape[0]), (279, 4, pixels.nbytes), (339, 3, kind[1])]
    data = pixels.astype(pixels.dtype.newbyteorder("<")).tobytes()
    pad = b"\0" * (len(data) % 2)
    entries = b"".join(struct.pack("<HHI", t, k, 1) + struct.pack("<I" if k == 4 else "<Hxx", v) for t, k, v in tags)
    return struct.pack("<2sHI", b"II", 42, 8 + len(data) + len(pad)) + data + pad + struct.pack("<H", len(tags)) + entries + b"\0\0\0\0"


def read_images(spark: SparkSession, folder: str, pattern: str = "*.tif") -> DataFrame:
    """frame blocks (path, h, w, dtype, px) of the images of a folder; files that aren't two-dimensional images are left out, with a warning if none is there."""

    def decode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(p, *got[:3], got[3].tolist()) for p, raw in zip(part["path"], part["content"], strict=True) if (got := decode_tiff(raw))]
            yield pd.DataFrame(rows, columns=["path", "h", "w", "dtype", "px"])

    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    if raw.select("path").isEmpty():
        warnings.warn(f"no file found matching {pattern}", stacklevel=2)
    return raw.select("path", "content").mapInPandas(decode, FRAME)


def time_points(frames: DataFrame) -> DataFrame:
    """frame_px (t, y, x, v) of blocks: t numbers the paths in their order. All must have one size."""
    sizes = frames.select("h", "w").distinct().limit(2).collect()
    if len(sizes) > 1:
        raise ValueError("images have different sizes")
    names = numbered(frames.select("path").distinct().orderBy("path"), "t")
    flat = frames.join(names, "path").select(F.col("t").cast("int").alias("t"), "w", F.posexplode("px").alias("i", "v"))
    return flat.select("t", F.floor(F.col("i") / F.col("w")).cast("int").alias("y"), (F.col("i") % F.col("w")).cast("int").alias("x"), F.col("v").cast("double").alias("v"))


def write_images(frame: DataFrame, folder: str, height: int, width: int, kind: str = "float32") -> DataFrame:
    """(path, bytes) of the files that frames (name, y, x, v), or volumes with z, are written to: grey images, planes one below the other.

    A file is written under a name of its own and then renamed, so a task that runs again leaves nothing half done.
    """
    keys = ["name", "z"] if "z" in frame.columns else ["name"]

    def write(group: pa.Table) -> pa.Table:
        planes = np.unique(group.column("z").to_numpy()) if "z" in keys else np.zeros(1, int)
        px = np.zeros((len(planes) * height, width))
        at = np.searchsorted(planes, group.column("z").to_numpy()) if "z" in keys else 0
        px[at * height + group.column("y").to_numpy(), group.column("x").to_numpy()] = group.column("v").to_numpy()
        system, place = FileSystem.from_uri(folder)
        system.create_dir(place, recursive=True)
        target = f"{place}/{group.column('name')[0].as_py()}"
        draft = f"{target}.{uuid.uuid4().hex}"
        raw = encode_tiff(px.astype(kind))
        with system.open_output_stream(draft) as out:
            out.write(raw)
        system.move(draft, target)
        return pa.table({"path": [target], "bytes": pa.array([len(raw)], pa.int64())})

    return frame.select("name", *(F.col(c).cast("int").alias(c) for c in (*keys[1:], "y", "x")), F.col("v").cast("double").alias("v")).groupBy("name").applyInArrow(write, "path string, bytes long")


def write_psf(psf: DataFrame, meta: DataFrame, folder: str, optics: DataFrame | None = None) -> None:
    """Planes as partitions, beside a catalogue of their sizes and windows and, if given, the optics' parameters (one row)."""
    psf.write.mode("overwrite").partitionBy("z").parquet(f"{folder}/taps")
    meta.write.mode("overwrite").parquet(f"{folder}/meta")
    if optics is not None:
        optics.write.mode("overwrite").parquet(f"{folder}/optics")


def read_optics(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/optics")


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def is_file(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.exists(place) and system.getFileStatus(place).isFile()


def load_psf(spark: SparkSession, path: str, first: int = 0, number: int | None = None, again: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Taps, catalogue and optics of the point-spread function that a path names; it is synthesised and kept there if it isn't there yet, or ``again``.

    Of names with the prefix of plain functions those aren't normalised by flux.  A path that is a file is a container, read by ``hdf5.read_psf_file``;
    its optics are what its name says, the lenslet's size is that in the file.
    """
    if is_file(spark, path):
        quarter, meta, n = read_psf_file(spark, path, first, number)
        named = parse_psf_names(spark.sql("SELECT :p AS path", args={"p": path}))
        return expand(quarter, n), meta, named.withColumn("nnum", F.lit(n))
    if again or not exists(spark, f"{path}/optics"):
        named = spark.sql("SELECT :p AS path", args={"p": path})
        told = require_generated(parse_psf_names(named)).first().asDict()
        optics = Optics(m=told["m"], na=told["na"], pitch=told["ml_pitch"], n=told["nnum"], osr=3, index=told["n"], fml=told["fml"], lam=told["lam"], zmin=told["zmin"], zmax=told["zmax"], spacing=told["zspacing"])
        taps = cut(synthesise(spark, optics, told["normalised"]))
        size = 2 * F.max(F.greatest(F.abs("dv"), F.abs("du"))) + 1
        meta = taps.groupBy("z").agg(size.cast("int").alias("s")).select("z", "s", F.lit(1).alias("ca_lo"), F.col("s").alias("ca_hi"))
        write_psf(taps, meta, path, parse_psf_names(named).withColumn("osr", F.lit(3)))
    taps, meta = read_psf(spark, path, first, number)
    return taps, meta, read_optics(spark, path)


def read_psf(spark: SparkSession, folder: str, first: int = 0, number: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Taps and catalogue of a range of planes, renumbered from 0; only their partitions are read."""
    keep = F.col("z") >= first if number is None else F.col("z").between(first, first + number - 1)
    return tuple(spark.read.parquet(f"{folder}/{part}").where(keep).withColumn("z", F.col("z") - first) for part in ("taps", "meta"))


def plane_files(planes: DataFrame) -> DataFrame:
    return planes.select("z", plane_name(F.col("z")).alias("h"), plane_name(F.col("z"), True).alias("ht"))


def write_volumes(volume: DataFrame, folder: str) -> None:
    """One partition for each time point."""
    volume.write.mode("overwrite").partitionBy("t").parquet(folder)


def read_commented(spark: SparkSession, path: str) -> DataFrame:
    """(fields array<string>) of a tab-separated text without # comments and blank lines."""
    line = without_comment(F.col("value"))
    return spark.read.text(path).select(line.alias("line")).where("line <> ''").select(F.split("line", "\t").alias("fields"))


def read_scaling(spark: SparkSession, path: str) -> DataFrame:
    """(threads, wall, user_s, sys_s) of each line with four numbers."""
    f = F.col("fields")
    return read_commented(spark, path).where(F.size(f) >= 4).select(*(f[k].cast("double").alias(n) for k, n in enumerate(("threads", "wall", "user_s", "sys_s"))))


def append_log(rows: DataFrame, path: str, mode: str = "append") -> None:
    rows.write.mode(mode).option("sep", "\t").csv(path)


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """A worker trace with its run (file name), time taken and time waited of each item."""
    log = spark.read.schema(TRACE).option("sep", "\t").csv(path).withColumn("run", base_name(F.input_file_name()))
    return log.withColumn("dt", F.col("t_end") - F.col("t_start")).withColumn("waited", F.col("m0e") - F.col("m0s") + F.col("m1e") - F.col("m1s"))


def from_flat(spark: SparkSession, values: list[float] | np.ndarray, reversed_shape: tuple[int, ...]) -> DataFrame:
    """Pixels of a column-major array given flat with its shape, as other tools pass them: the axes in reverse are (..., y, x)."""
    names = ["z", "t", "y", "x"][4 - len(reversed_shape) :]
    values = np.asarray(values, float)
    places = np.unravel_index(np.arange(len(values)), reversed_shape[::-1])
    return spark.createDataFrame(pa.table({**{n: pa.array(p, pa.int32()) for n, p in zip(names, places, strict=True)}, "v": values}))


def to_flat(pixels: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """The same back again: a flat array over (..., y, x) of ``shape``, missing pixels 0; for results that the caller's memory holds."""
    names = ["z", "t", "y", "x"][4 - len(shape) :]
    table = pixels.select(*names, "v").toArrow()
    out = np.zeros(shape)
    out[tuple(table.column(n).to_numpy() for n in names)] = table.column("v").to_numpy()
    return out.ravel()


def project_flat(spark: SparkSession, folder: str, planes: list[int], values: list[float] | np.ndarray, reversed_shape: tuple[int, ...], back: bool) -> np.ndarray:
    """Back projection of a flat frame (t, y, x) into ``planes``, counted from 1, as a flat volume (z, t, y, x); or a flat volume's forward projection."""
    chosen = zero_based(planes)
    height, width = reversed_shape[1], reversed_shape[0]
    n = lenslet_size(spark, folder)
    taps, _ = read_psf(spark, folder)
    taps = taps.where(F.col("z").isin(chosen))
    numbers = F.create_map(*(F.lit(v) for k, z in enumerate(chosen) for v in (z, k)))
    taps = taps.withColumn("z", numbers[F.col("z")])
    times = reversed_shape[2] if len(reversed_shape) > 2 else 1
    pixels = from_flat(spark, values, reversed_shape)
    if "t" not in pixels.columns:
        pixels = pixels.withColumn("t", F.lit(0))
    if back:
        return to_flat(backward(pixels, transpose(taps, n), n, height, width), (len(chosen), times, height, width))
    return to_flat(forward(pixels, taps, n, height, width), (times, height, width))


def plane_count(spark: SparkSession, folder: str) -> int:
    return spark.read.parquet(f"{folder}/meta").count()


def lenslet_size(spark: SparkSession, folder: str) -> int:
    return read_optics(spark, folder).first()["nnum"]


def write_trace(log: DataFrame, path: str, begin: bool = True) -> None:
    """A worker trace as tab-separated text, in the order of its columns; later parts of a run go behind the first."""
    append_log(log.select(*(c.split()[0] for c in TRACE.split(", "))), path, "overwrite" if begin else "append")


def zero_based(planes: list[int]) -> list[int]:
    """Planes counted from 1 as planes counted from 0."""
    if any(p < 1 for p in planes):
        raise IndexError("planes are counted from 1")
    return [p - 1 for p in planes]
