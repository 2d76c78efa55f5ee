"""The Fourier form against plain sums and against the join, and kernels that are transformed once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from phaselens.operators import block, deconvolution, projection, psf
from phaselens.sources import fixtures as fx

PLACE = ["z", "t", "y", "x"]


def slow(image, kernels, n):
    out = np.zeros_like(image)
    for t, y, x in np.argwhere(image):
        k = kernels.get((y % n, x % n))
        if k is None:
            continue
        rv, ru = k.shape[0] // 2, k.shape[1] // 2
        for dv in range(-rv, rv + 1):
            for du in range(-ru, ru + 1):
                if 0 <= y + dv < image.shape[1] and 0 <= x + du < image.shape[2]:
                    out[t, y + dv, x + du] += image[t, y, x] * k[dv + rv, du + ru]
    return out


def spread(image, kernels, n, fft=np.fft):
    """The Fourier form of ``slow``, each kernel for itself."""
    reach = (max(k.shape[i] // 2 for k in kernels.values()) for i in (0, 1))
    by = block.Transforms(n, *image.shape[1:], *reach, fft)
    rows = [(0, [b, a, 0, 0], by.kernel(b, a, k), by.kernel(b, a, (k != 0).astype(np.float32))) for (b, a), k in kernels.items()]
    return block.shown({0: image}, rows, by)


def kernels_of(r, n, reach):
    return {(b, a): r.random((2 * r.integers(0, reach[0] + 1) + 1, 2 * reach[1] + 1)) for b in range(n) for a in range(n) if (b, a) != (0, n - 1) or n == 1}


@pytest.mark.parametrize(("n", "shape", "reach"), [(1, (1, 7, 9), (2, 1)), (3, (2, 10, 14), (4, 7)), (5, (1, 23, 11), (6, 2)), (3, (1, 4, 5), (9, 9))])
@pytest.mark.parametrize("backend", sorted(block.BACKENDS))
def test_projection_is_the_plain_sum(n, shape, reach, backend):
    r = np.random.default_rng(n)
    image, kernels = r.random(shape), kernels_of(r, n, reach)
    assert np.abs(spread(image, kernels, n, block.BACKENDS[backend]) - slow(image, kernels, n)).max() < 1e-10


@pytest.mark.parametrize("size", [(6, 8), (9, 5), (1, 1), (15, 12)])
def test_backends_transform_alike(size):
    r, products = np.random.default_rng(1), block.BACKENDS["products"]
    x = r.random((2, 3, max(1, size[0] - 2), size[1]))
    there = np.fft.rfft2(x, size)
    assert np.abs(products.rfft2(x, size) - there).max() < 1e-10
    assert np.abs(products.irfft2(there, size) - np.fft.irfft2(there, size)).max() < 1e-10


def test_mirrored_spectra_are_those_of_mirrored_kernels():
    r = np.random.default_rng(3)
    by, k = block.Transforms(5, 21, 33, 7, 9), r.random((15, 19))
    base = by.kernel(1, 3, k)
    assert np.abs(by.upside_down(base) - by.kernel(3, 3, k[::-1])).max() < 1e-9
    assert np.abs(by.left_right(base) - by.kernel(1, 1, k[:, ::-1])).max() < 1e-9
    assert np.abs(by.left_right(by.upside_down(base)) - by.kernel(3, 1, k[::-1, ::-1])).max() < 1e-9


def test_what_no_light_reaches_is_nothing_beside_bright_frames():
    r = np.random.default_rng(5)
    kernels = kernels_of(r, 3, (2, 2))
    image = np.zeros((3, 21, 24))
    image[0] = r.random(image[0].shape) * 1e12  # bright
    image[1, 4, 5], image[2, 4, 5], image[2, 18, 20] = 1e-9, 1e9, 1e-5  # dim; and both in one frame
    got, expected = spread(image, kernels, 3), slow(image, kernels, 3)
    assert ((got != 0) == (expected != 0)).all()
    assert all(np.abs(g - e).max() < 1e-12 * e.max() for g, e in zip(got, expected, strict=True))


def random_case(spark, seed, n=3, height=14, width=17):
    """Sparse taps of two planes, some phases without any, and a dim frame beside a bright one, with much darkness."""
    r = np.random.default_rng(seed)
    taps = {(int(z), int(b), int(a), int(v), int(u)): float(r.integers(1, 9)) for z, b, a, v, u in zip(*(r.integers(0, m, 60) for m in (2, n, n)), *(r.integers(-4, 5, 60) for _ in range(2)), strict=True) if (b, a) != (1, 2)}
    lit = {(t, int(r.integers(0, height)), int(r.integers(0, width))): float(r.random() * s) for t, s in ((0, 1e9), (1, 1e-6), (3, 1.0)) for _ in range(r.integers(1, 25))}
    return (
        spark.createDataFrame([(*k, v) for k, v in lit.items()], "t int, y int, x int, v double"),
        spark.createDataFrame([(*k, v) for k, v in taps.items()], "z int, b int, a int, dv int, du int, h double"), n, height, width,
    )


def rows(volume):
    return volume.toPandas().set_index(PLACE)["v"].sort_index()


@pytest.mark.parametrize("seed", range(4))
def test_both_forms_give_the_same_rows(spark, seed, monkeypatch):
    frame, taps, n, height, width = random_case(spark, seed)
    monkeypatch.setattr(block, "CELL_BYTES", [64_000_000, 20_000, 200_000, 64_000_000][seed])
    monkeypatch.setattr(block, "SHARE_BYTES", [64_000_000, 64_000_000, 1, 1][seed])
    for standard in (False, True):
        slow_, fast = (rows(deconvolution.deconvolve(frame, taps, n, height, width, 2, standard, block=b)) for b in (False, True))
        assert list(fast.index) == list(slow_.index) and np.isfinite(slow_).all()
        top = slow_.groupby("t").transform("max")
        assert ((fast - slow_).abs() <= 1e-7 * slow_ + 1e-11 * top).all()


def test_a_guess_keeps_its_voxels_in_both_forms(spark):
    frame, taps, n, height, width = random_case(spark, 9)
    guess = projection.backward(frame, psf.transpose(taps, n), n, height, width).where("(y + x) % 3 <> 0").withColumn("v", F.lit(1.0))
    slow_, fast = (rows(deconvolution.deconvolve(frame, taps, n, height, width, 1, guess=guess, block=b)) for b in (False, True))
    assert list(fast.index) == list(slow_.index) and ((fast - slow_).abs() <= 1e-7 * slow_ + 1e-11 * slow_.groupby("t").transform("max")).all()


def test_a_mask_in_both_forms(spark):
    frame, taps, n, height, width = random_case(spark, 11)
    mask = spark.range(height * width).select((F.col("id") / width).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x"), F.when(F.col("id") % 5 == 0, 0).otherwise(1).alias("m"))
    seen = frame.join(mask.where("m = 1").drop("m"), ["y", "x"]).select("t", "y", "x", "v")
    slow_, fast = (rows(deconvolution.deconvolve(seen, taps, n, height, width, 2, True, mask, block=b)) for b in (False, True))
    assert list(fast.index) == list(slow_.index) and ((fast - slow_).abs() <= 1e-7 * slow_ + 1e-11 * slow_.groupby("t").transform("max")).all()
    with pytest.raises(ValueError):
        deconvolution.deconvolve(frame, taps, n, height, width, 1, True, mask, block=True)


def test_kernels_are_transformed_once_in_all_iterations(spark):
    frame, taps = fx.frame(spark, "/root/testdata/sf0.001"), fx.psf(spark)
    kept = deconvolution.spectra_pair(taps, 3, 30, 45)
    # nine phases of a plane are mirror images of four, of all three planes
    assert [x.made.value for x in kept] == [12, 12] and kept[0].rows().count() == 12
    each = []
    done = deconvolution.deconvolve(frame, taps, 3, 30, 45, 3, kept=kept, each=lambda k, v: each.append(k))
    assert each == [0, 1, 2] and done.count() > 0 and [x.made.value for x in kept] == [12, 12]
    plan = block.backward(block.to_blocks(frame, 30, 45), kept[1])._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan
    again = deconvolution.deconvolve(frame.withColumn("v", F.col("v") * 2), taps, 3, 30, 45, 1, kept=kept)
    assert again.count() > 0 and [x.made.value for x in kept] == [12, 12]
    for x in kept:
        x.drop()
    assert not spark.catalog.tableExists(kept[0].table)


def test_backends_deconvolve_alike(spark):
    frame, taps, n, height, width = random_case(spark, 2)
    one, other = (rows(deconvolution.deconvolve(frame, taps, n, height, width, 1, block=True, backend=b)) for b in ("fft", "products"))
    assert list(one.index) == list(other.index) and ((one - other).abs() <= 1e-10 * one.groupby("t").transform("max")).all()


def test_spectra_are_for_frames_of_one_size(spark):
    kept = deconvolution.spectra_pair(fx.psf(spark), 3, 30, 45)
    with pytest.raises(ValueError):
        deconvolution.deconvolve(fx.frame(spark, "/root/testdata/sf0.001"), fx.psf(spark), 3, 31, 45, 1, kept=kept)
    for x in kept:
        x.drop()


def test_random_projections_of_many_lenslets(spark):
    n, height, width = 15, 60, 75
    pixels = [(0, int(y), int(x), float(v)) for (y, x), v in np.ndenumerate(np.random.default_rng(0).random((height, width)).round(3))]
    frame = spark.createDataFrame(pixels, "t int, y int, x int, v double")
    taps = fx.psf(spark, n, 9, 2)
    back = psf.transpose(taps, n)
    slow_ = projection.backward(frame, back, n, height, width).toPandas().set_index(["z", "y", "x"])["v"]
    fast = block.to_pixels(block.backward(block.to_blocks(frame, height, width), block.spectra(back, n, height, width)), width).toPandas().set_index(["z", "y", "x"])["v"]
    assert len(fast) == 2 * height * width and (fast - slow_.reindex(fast.index, fill_value=0.0)).abs().max() < 1e-4


def test_the_form_is_chosen_by_the_rows_of_the_join(spark, monkeypatch):
    taps = fx.psf(spark)
    assert not block.prefer_block(taps, 3, 30, 45)
    monkeypatch.setattr(block, "RELATIONAL_ROWS", 1000)
    assert block.prefer_block(taps, 3, 30, 45)
