"""Projection of whole frames by Fourier transforms: for point-spread functions too large to join tap by tap.

Frames are rows of (z,) t, px (an array of height * width), kernels rows of z, b, a, k (an array of rows * columns).  Where a
pixel of one lenslet phase lands in another phase, its lenslet moves by a whole number.  So each pair of phases is a
small convolution of lenslet images, and a plane's projection is a sum of products of their spectra: no transform is
larger than the number of lenslets and the reach of the kernels.

Spectra of kernels are made once and kept in a table that is bucketed by cell: a few planes, or a share of one plane's phases, of
bounded size.  Each projection sends frames to the cells' tasks, so kernels are never shuffled or transformed again.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phaselens.functions.numbers import next_smooth
from phaselens.operators.projection import check_lenslet
from phaselens.plans.lineage import cut, shared_dir

#: Joined rows above which the block form is taken.
RELATIONAL_ROWS = 100_000_000
#: Bytes of kernels' spectra in a cell, bytes of frames' spectra that a task holds at once, and partial sums that one task adds up.
CELL_BYTES, SHARE_BYTES, ADD = 64_000_000, 64_000_000, 8
#: Parts of a frame's brightest pixel under which a pixel is looked at again: does any light reach it?
DOUBTFUL = 1e-9


def prefer_block(psf: DataFrame, n: int, height: int, width: int) -> bool:
    """Whether the join would make too many rows of a frame: each pixel meets the taps of its phase.

    Taps are counted only for frames that could have as many.  Both forms give the same rows.
    """
    pixels = height * width
    return pixels * 4 * pixels > RELATIONAL_ROWS and pixels * psf.count() // n**2 > RELATIONAL_ROWS


class Products:
    """Fourier transforms as products with matrices of roots of unity, which suit small sizes; the same interface as ``numpy.fft``."""

    def rfft2(self, x: np.ndarray, s: tuple[int, int]) -> np.ndarray:
        rows, cols = (np.exp(-2j * np.pi * np.outer(np.arange(m), np.arange(d)) / size) for m, d, size in ((s[0], x.shape[-2], s[0]), (s[1] // 2 + 1, x.shape[-1], s[1])))
        return rows @ (x @ cols.T)

    def irfft2(self, x: np.ndarray, s: tuple[int, int]) -> np.ndarray:
        rows = np.exp(2j * np.pi * np.outer(np.arange(s[0]), np.arange(s[0])) / s[0]) / s[0]
        twice = np.where((np.arange(x.shape[-1]) == 0) | (2 * np.arange(x.shape[-1]) == s[1]), 1, 2)
        cols = twice[:, None] * np.exp(2j * np.pi * np.outer(np.arange(x.shape[-1]), np.arange(s[1])) / s[1]) / s[1]
        return ((rows @ x) @ cols).real


#: Ways to transform by name; each has rfft2 and irfft2 as ``numpy.fft`` has them, and goes to the workers with the tasks.
BACKENDS: dict[str, Any] = {"fft": np.fft, "products": Products()}


def _lists(rows: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([r.ravel() for r in rows]) if rows else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(r.size for r in rows)]), pa.int32()), pa.array(flat, pa.float64()))


def _stack(column: pa.ChunkedArray, height: int, width: int) -> np.ndarray:
    return np.stack([np.asarray(c.values, float).reshape(height, width) for c in column]) if len(column) else np.zeros((0, height, width))


def to_blocks(frame: DataFrame, height: int, width: int, missing: float = 0.0) -> DataFrame:
    """Frames or volumes of pixels as arrays in row order; pixels that aren't there are ``missing``. A frame is one group of height * width rows."""
    keys = [c for c in ("z", "t") if c in frame.columns]

    def fill(group: pa.Table) -> pa.Table:
        px = np.full(height * width, missing)
        px[group.column("y").to_numpy() * width + group.column("x").to_numpy()] = group.column("v").to_numpy()
        return pa.table({**{c: group.column(c)[:1] for c in keys}, "px": _lists([px])})

    pixels = frame.select(*(F.col(c).cast("int").alias(c) for c in keys), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("v").cast("double").alias("v"))
    return pixels.groupBy(*keys).applyInArrow(fill, ", ".join(f"{c} int" for c in keys) + ", px array<double>")


def to_pixels(blocks: DataFrame, width: int) -> DataFrame:
    """Pixels of frames or volumes; what is not a number isn't there."""
    keys = [c for c in ("z", "t") if c in blocks.columns]
    return blocks.select(*keys, F.posexplode("px").alias("i", "v")).select(*keys, F.floor(F.col("i") / width).cast("int").alias("y"), (F.col("i") % width).cast("int").alias("x"), "v").where(~F.isnan("v"))


def kernels(psf: DataFrame) -> DataFrame:
    """(z, b, a, rv, ru, k): each phase's taps as an array that reaches rv rows and ru columns to either side. A phase is one group."""

    def fill(group: pa.Table) -> pa.Table:
        dv, du = group.column("dv").to_numpy(), group.column("du").to_numpy()
        rv, ru = int(np.abs(dv).max()), int(np.abs(du).max())
        k = np.zeros((2 * rv + 1, 2 * ru + 1))
        k[dv + rv, du + ru] = group.column("h").to_numpy()
        return pa.table({**{c: group.column(c)[:1] for c in ("z", "b", "a")}, "rv": pa.array([rv], pa.int32()), "ru": pa.array([ru], pa.int32()), "k": _lists([k])})

    taps = psf.select(*(F.col(c).cast("int").alias(c) for c in ("z", "b", "a", "dv", "du")), F.col("h").cast("double").alias("h"))
    return taps.groupBy("z", "b", "a").applyInArrow(fill, "z int, b int, a int, rv int, ru int, k array<double>")


class Transforms:
    """Spectra of lenslet images and kernels of one plane, by the transforms of ``fft``; ``reach`` is how many lenslets light can move."""

    def __init__(self, n: int, height: int, width: int, reach_v: int, reach_u: int, fft: Any = np.fft):
        self.fft = fft
        self.n, self.size = n, (height, width)
        self.cells = -(-height // n), -(-width // n)
        self.reach = -(-reach_v // n), -(-reach_u // n)
        self.span = tuple(2 * r + 1 for r in self.reach)
        self.shape = tuple(next_smooth(c + r) for c, r in zip(self.cells, self.reach, strict=True))

    def images(self, frames: np.ndarray) -> np.ndarray:
        """Spectra by phase of frames (t, y, x): (n, n, t, rows, columns)."""
        n, (rows, cols) = self.n, self.cells
        padded = np.zeros((len(frames), rows * n, cols * n))
        padded[:, : self.size[0], : self.size[1]] = frames
        return self.fft.rfft2(padded.reshape(-1, rows, n, cols, n).transpose(2, 4, 0, 1, 3), self.shape)

    def kernel(self, b: int, a: int, k: np.ndarray) -> np.ndarray:
        """Spectra by target phase of the kernel of phase (b, a): (n, n, rows, columns)."""
        n, (dv, du) = self.n, self.span
        whole = np.zeros((dv * n, du * n))
        top, left = b + n * self.reach[0] - k.shape[0] // 2, a + n * self.reach[1] - k.shape[1] // 2
        whole[top : top + k.shape[0], left : left + k.shape[1]] = k
        return self.fft.rfft2(whole.reshape(dv, n, du, n).transpose(1, 3, 0, 2), self.shape)

    def upside_down(self, spectra: np.ndarray) -> np.ndarray:
        """Of the kernel of phase (n - 1 - b, a) that mirrors that of (b, a): frequencies run backwards and turn by the span."""
        ramp = np.exp(-2j * np.pi * np.arange(self.shape[0]) * (self.span[0] - 1) / self.shape[0])
        return np.roll(spectra[::-1, :, ::-1], 1, 2) * ramp[:, None]

    def left_right(self, spectra: np.ndarray) -> np.ndarray:
        """Of the kernel of phase (b, n - 1 - a) that mirrors that of (b, a)."""
        ramp = np.exp(-2j * np.pi * np.arange(spectra.shape[-1]) * (self.span[1] - 1) / self.shape[1])
        return np.roll(spectra[:, ::-1, ::-1], 1, 2).conj() * ramp

    def frames(self, spectra: np.ndarray) -> np.ndarray:
        """Frames (t, y, x) of spectra by target phase."""
        (rows, cols), (rv, ru) = self.cells, self.reach
        lenslets = self.fft.irfft2(spectra, self.shape)[..., rv : rv + rows, ru : ru + cols]
        return lenslets.transpose(2, 3, 0, 4, 1).reshape(-1, rows * self.n, cols * self.n)[:, : self.size[0], : self.size[1]]


@dataclass(eq=False)
class Spectra:
    """Kernels' spectra for frames of one size: a table (cell, z, forms, spectrum, reach) bucketed by cell.

    A row is a kernel and those that mirror it: ``forms`` has b, a, and whether it is upside down and left to right.  ``reach`` is the spectrum
    of where its taps aren't 0, with half the digits.  ``made`` counts the kernels that were transformed.
    """

    table: str
    cells: dict[int, list[int]]
    n: int
    height: int
    width: int
    reach: tuple[int, int]
    backend: Any
    made: Any = field(repr=False, default=None)
    spark: Any = field(repr=False, default=None)

    def transforms(self) -> Transforms:
        return Transforms(self.n, self.height, self.width, *self.reach, self.backend)

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def drop(self) -> None:
        """The table goes, with its files."""
        if self in _kept:
            _kept.remove(self)
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(self.spark)}/{self.table}")
            self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_kept: list[Spectra] = []


@atexit.register
def _sweep() -> None:
    while _kept:
        try:
            _kept[-1].drop()
        except Exception:  # the session has ended
            return


def spectra(psf: DataFrame, n: int, height: int, width: int, backend: str = "fft") -> Spectra:
    """The spectra of all kernels of a point-spread function, each transformed once; kernels of a plane that mirror one another share one."""
    check_lenslet(n)
    spark, taps = psf.sparkSession, cut(kernels(psf))
    rv, ru, planes = taps.agg(F.coalesce(F.max("rv"), F.lit(0)), F.coalesce(F.max("ru"), F.lit(0)), F.sort_array(F.collect_set("z"))).first()
    by = Transforms(n, height, width, rv, ru, BACKENDS[backend])
    each = n**4 * by.shape[0] * (by.shape[1] // 2 + 1) * 24
    share = -(-each // CELL_BYTES)  # cells of a plane
    together = max(1, min(CELL_BYTES // each, len(planes) // spark.sparkContext.defaultParallelism))  # planes of a cell
    first = {z: k // together * share for k, z in enumerate(planes)}
    made = spark.sparkContext.accumulator(0)

    def transform(group: pa.Table) -> pa.Table:
        todo = {(b, a): np.asarray(k.values, float).reshape(2 * p + 1, 2 * q + 1) for b, a, p, q, k in zip(*(group.column(c).to_pylist() for c in ("b", "a", "rv", "ru")), group.column("k"), strict=True)}
        rows = []
        for (b, a), k in sorted(todo.items()):
            if (b, a) not in todo:
                continue
            forms = []
            for p, q, up, left in ((b, a, 0, 0), (n - 1 - b, a, 1, 0), (b, n - 1 - a, 0, 1), (n - 1 - b, n - 1 - a, 1, 1)):
                mirrored = k[:: -1 if up else 1, :: -1 if left else 1]
                if (p, q) in todo and np.array_equal(todo[p, q], mirrored):
                    forms += [p, q, up, left]
                    del todo[p, q]
            made.add(1)
            rows.append(((b * n + a) * share // n**2, forms, by.kernel(b, a, k).astype(np.complex128).tobytes(), by.kernel(b, a, (k != 0).astype(np.float32)).astype(np.complex64).tobytes()))
        cell, forms, spectrum, reach = zip(*rows, strict=True)
        return pa.table({"cell": pa.array(cell, pa.int32()), "z": pa.array([group.column("z")[0].as_py()] * len(rows), pa.int32()), "forms": pa.array(forms, pa.list_(pa.int32())), "spectrum": pa.array(spectrum, pa.binary()), "reach": pa.array(reach, pa.binary())})

    low = lambda c: F.least(F.col(c), n - 1 - F.col(c))
    done = taps.groupBy("z", low("b").alias("_b"), low("a").alias("_a")).applyInArrow(transform, "cell int, z int, forms array<int>, spectrum binary, reach binary")
    start = F.element_at(F.create_map(*(F.lit(x) for pair in first.items() for x in pair)), F.col("z")) if first else F.lit(0)
    cells = {z: list(range(k, k + share)) for z, k in first.items()}
    out = Spectra(f"spectra_{uuid.uuid4().hex}", cells, n, height, width, (rv, ru), BACKENDS[backend], made, spark)
    number = max(1, len({c for own in cells.values() for c in own}))
    dealt = done.withColumn("cell", F.col("cell") + start).repartition(number, "cell")
    dealt.write.bucketBy(number, "cell").sortBy("cell").option("path", f"{shared_dir(spark)}/{out.table}").option("compression", "lz4").saveAsTable(out.table)
    _kept.append(out)
    return out


def _sum_of(rows: list[tuple[list[int], np.ndarray, np.ndarray]], seen: dict[int, np.ndarray], by: Transforms, which: int) -> np.ndarray:
    """Frames of the products of kernels' spectra (forms, z, spectrum, reach) with those of frames by plane."""
    out = None
    for z, forms, *both in rows:
        image = seen[z]
        base = both[which]
        for p, q, up, left in np.reshape(forms, (-1, 4)).tolist():
            turned = by.upside_down(base) if up else base
            turned = by.left_right(turned) if left else turned
            part = turned[:, :, None] * image[p, q]
            out = part if out is None else out + part
    return by.frames(out)


def shown(frames: dict[int, np.ndarray], rows: list[tuple], by: Transforms) -> np.ndarray:
    """The sum over planes of frames (t, y, x) spread by rows of kernels' spectra, cropped.

    A pixel that no light reaches is just 0: where a pixel is far below the brightest of its own frame, the number of lit pixels and taps
    that meet there is found in the same way, and is a whole number.  Light that is reached but lost in rounding is one digit of the brightest.
    """
    out = _sum_of(rows, {z: by.images(x) for z, x in frames.items()}, by, 0)
    top = out.max((1, 2), initial=0.0)[:, None, None]
    dim = np.abs(out) <= DOUBTFUL * top
    if dim.any():
        some = np.flatnonzero(dim.any((1, 2)))
        met = _sum_of(rows, {z: by.images((x[some] != 0).astype(np.float32)) for z, x in frames.items()}, by, 1) > 0.5
        light = all((x >= 0).all() for x in frames.values())
        kept = np.maximum(out[some], np.finfo(float).eps * top[some]) if light else out[some]
        out[some] = np.where(met, kept, 0.0)
    return out


def _rows(table: pa.Table, by: Transforms) -> list[tuple]:
    shape = (by.n, by.n, by.shape[0], by.shape[1] // 2 + 1)
    return [(z, forms, np.frombuffer(s.as_buffer(), np.complex128).reshape(shape), np.frombuffer(r.as_buffer(), np.complex64).reshape(shape)) for z, forms, s, r in zip(table.column("z").to_pylist(), table.column("forms").to_pylist(), table.column("spectrum"), table.column("reach"), strict=True)]


def _frames(column: pa.ChunkedArray, kept: Spectra) -> np.ndarray:
    return np.nan_to_num(_stack(column, kept.height, kept.width), nan=0.0, posinf=np.inf, neginf=-np.inf)


def _share(kept: Spectra) -> int:
    """Time points that a task can hold at once."""
    by = kept.transforms()
    return max(1, SHARE_BYTES // (16 * kept.n**2 * by.shape[0] * (by.shape[1] // 2 + 1)))


def fit_together(blocks: DataFrame, kept: Spectra) -> bool:
    """Whether a task can hold all time points of frames or volumes at once."""
    return len(blocks.select(F.floor(F.col("t") / _share(kept)).alias("part")).distinct().limit(2).collect()) < 2


def _run(images: DataFrame, kept: Spectra, each: Callable[[pa.Table, pa.Table], pa.Table], schema: str, together: bool) -> DataFrame:
    """``each`` of the frames (t, cell, ...) and the kernels of a cell, for as many time points at once as a task can hold.

    Where all time points fit ``together``, the kernels' table stays where it is and only frames move; else it is repeated for each share of them.
    """
    if together:
        return kept.rows().groupBy("cell").cogroup(images.groupBy("cell")).applyInArrow(each, schema)
    images = images.withColumn("part", F.floor(F.col("t") / _share(kept)))
    taps = kept.rows().join(images.select("cell", "part").distinct(), "cell")
    # names anew, as both sides come from the same images
    return taps.toDF(*taps.columns).groupBy("cell", "part").cogroup(images.groupBy("cell", "part")).applyInArrow(each, schema)


def _added(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Frames (part, keys, px) added up by keys, a few in a task and then those sums."""

    def add(group: pa.Table) -> pa.Table:
        total = np.asarray(group.column("px")[0].values, float).copy()
        for px in group.column("px")[1:]:
            total += np.asarray(px.values, float)
        return pa.table({"part": group.column("part")[:1], **{c: group.column(c)[:1] for c in keys}, "px": _lists([total])})

    schema = "part int, " + "".join(f"{c} int, " for c in keys) + "px array<double>"
    some = parts.withColumn("part", F.floor(F.col("part") / ADD).cast("int")).groupBy("part", *keys).applyInArrow(add, schema)
    return some.withColumn("part", F.lit(0)).groupBy(*keys).applyInArrow(add, schema).select(*keys, "px")


def backward(blocks: DataFrame, kept: Spectra, together: bool | None = None) -> DataFrame:
    """(z, t, px) of frames (t, px) by the spectra of the transposed function.  A frame is sent once to each cell, which may hold many planes.

    ``together`` is what ``fit_together`` says, where that is known; else it is asked.
    """
    together = fit_together(blocks, kept) if together is None else together
    cells = sorted({c for own in kept.cells.values() for c in own})

    def each(taps: pa.Table, images: pa.Table) -> pa.Table:
        by, out, z_of, t_of = kept_.transforms(), [], [], []
        if images.num_rows and taps.num_rows:
            frames, times = _frames(images.column("px"), kept_), images.column("t").to_pylist()
            rows = _rows(taps, by)
            for z in sorted({r[0] for r in rows}):
                out += list(shown({z: frames}, [r for r in rows if r[0] == z], by))
                z_of += [z] * len(times)
                t_of += times
        part = taps.column("cell")[0].as_py() if taps.num_rows else 0
        return pa.table({"part": pa.array([part] * len(out), pa.int32()), "z": pa.array(z_of, pa.int32()), "t": pa.array(t_of, pa.int32()), "px": _lists(out)})

    kept_ = _plain(kept)
    images = blocks.select(F.col("t").cast("int").alias("t"), "px", F.explode(F.array(*map(F.lit, cells)).cast("array<int>")).alias("cell"))
    found = _run(images, kept, each, "part int, z int, t int, px array<double>", together)
    return _added(found, ["z", "t"]) if any(len(c) > 1 for c in kept.cells.values()) else found.select("z", "t", "px")


def forward(blocks: DataFrame, kept: Spectra, together: bool | None = None) -> DataFrame:
    """(t, px) of volumes (z, t, px): a cell's planes are added up before they are transformed back, and then the cells' sums."""
    together = fit_together(blocks, kept) if together is None else together

    def each(taps: pa.Table, images: pa.Table) -> pa.Table:
        by, out, t_of = kept_.transforms(), [], []
        if images.num_rows and taps.num_rows:
            rows, z_of = _rows(taps, by), images.column("z").to_numpy()
            own, at = np.unique(images.column("t").to_numpy(), return_inverse=True)
            frames = {}
            for z in sorted({r[0] for r in rows}):
                frames[z] = np.zeros((len(own), kept_.height, kept_.width))
                if (z_of == z).any():
                    frames[z][at[z_of == z]] = _frames(images.column("px").filter(pa.array(z_of == z)), kept_)
            out, t_of = list(shown(frames, rows, by)), own.tolist()
        part = taps.column("cell")[0].as_py() if taps.num_rows else 0
        return pa.table({"part": pa.array([part] * len(out), pa.int32()), "t": pa.array(t_of, pa.int32()), "px": _lists(out)})

    kept_ = _plain(kept)
    if not kept.cells:
        return blocks.select("t", "px").where(F.lit(False))
    cells = F.element_at(F.create_map(*(x for z, own in kept.cells.items() for x in (F.lit(z), F.array(*map(F.lit, own)).cast("array<int>")))), F.col("z").cast("int"))
    images = blocks.where(F.col("z").isin(list(kept.cells))).select(F.col("z").cast("int").alias("z"), F.col("t").cast("int").alias("t"), "px", F.explode(cells).alias("cell"))
    return _added(_run(images, kept, each, "part int, t int, px array<double>", together), ["t"])


def _plain(kept: Spectra) -> Spectra:
    """What workers need of it."""
    return Spectra("", {}, kept.n, kept.height, kept.width, kept.reach, kept.backend)


def merged(first: DataFrame, others: list[tuple[DataFrame, list[str]]], by: Callable[..., np.ndarray]) -> DataFrame:
    """``by`` of arrays of pixels: those of ``first`` and, joined by their keys, of the others; frames that aren't there are 0."""
    keys, names = [c for c in ("z", "t") if c in first.columns], [f"px{k}" for k in range(len(others))]
    for name, (other, on) in zip(names, others, strict=True):
        first = first.join(other.select(*on, F.col("px").alias(name)), on, "left")

    def each(batches):
        for batch in batches:
            done = []
            for row in range(batch.num_rows):
                px, *rest = (batch.column(c)[row] for c in ("px", *names))
                own = np.asarray(px.values, float)
                done.append(by(own, *(np.asarray(r.values, float) if r.is_valid else np.zeros(len(own)) for r in rest)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), _lists(done)], names=[*keys, "px"])

    return first.select(*keys, "px", *names).mapInArrow(each, ", ".join(f"{c} int" for c in keys) + ", px array<double>")


def quotient(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """p / q, where a ratio to nothing counts as 0."""
    q = np.nan_to_num(q)
    return np.divide(np.nan_to_num(p), q, out=np.zeros_like(q), where=q != 0)


def deconvolve(
    frame: DataFrame, kept: tuple[Spectra, Spectra], height: int, width: int, iterations: int, standard: bool = False, mask: DataFrame | None = None, guess: DataFrame | None = None, each: Callable[[int, DataFrame], None] | None = None,
) -> DataFrame:
    """The block form of ``deconvolution.deconvolve``, by the spectra of the point-spread function and of the transposed one.

    Volumes stay arrays, in which what is not a number isn't there.  A ratio to nothing is 0; the join has infinities there, but of light
    and taps that aren't negative they meet only voxels that are 0, so both forms give the same rows.
    """
    forth, back = kept
    if {(x.height, x.width) for x in kept} != {(height, width)}:
        raise ValueError("these spectra are for frames of another size")
    seen = cut(to_blocks(frame, height, width))
    # asked once, of frames that are there: what is still to be computed would be computed for it
    together = fit_together(seen, forth) and fit_together(seen, back)
    kept_there = (lambda df: df) if together else cut  # shares of time points are told of frames, too
    start = cut(backward(seen, back, together))
    now = to_blocks(guess, height, width, np.nan) if guess is not None else merged(start, [], lambda p: np.where(p == 0, np.nan, p))
    trust = []
    if mask is not None:
        lit = mask.where("m <> 0").select(F.lit(0).alias("t"), "y", "x", F.lit(1.0).alias("v"))
        trust = [(cut(backward(to_blocks(lit, height, width), back, True).drop("t")), ["z"])]
    for k in range(iterations):
        made = kept_there(forward(now, forth, together))
        if standard:
            factor = backward(kept_there(merged(seen, [(made, ["t"])], quotient)), back, together)
            now = merged(now, [(factor, ["z", "t"]), *trust], lambda p, q, *r: p * (quotient(q, r[0]) if r else q))
        else:
            now = merged(now, [(start, ["z", "t"]), (backward(made, back, together), ["z", "t"])], lambda p, q, r: p * quotient(q, r))
        now = cut(now)
        if each:
            each(k, to_pixels(now, width))
    return to_pixels(now, width)
