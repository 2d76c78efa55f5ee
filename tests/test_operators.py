"""Properties of the light-field operators: exactness against NumPy, linearity, adjointness, edges and errors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from phaselens.functions import names, numbers, scanning
from phaselens.operators import block, deconvolution, flow, images, projection, psf, rectify, synthesis, trace
from phaselens.plans import catalog
from phaselens.sources import files, fixtures as fx

N, H, W = 3, 9, 12


def pixels(spark, array, names=("t", "y", "x")):
    rows = [(*at, float(v)) for at, v in np.ndenumerate(array)]
    return spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names) + ", v double")


def dense(df, shape, names=("t", "y", "x")):
    out = np.zeros(shape)
    for r in df.collect():
        out[tuple(r[n] for n in names)] = r["v"]
    return out


def taps(spark):
    return fx.psf(spark, N, 2, 2)


def slow_forward(volume, spark):
    out = np.zeros(volume.shape[1:])
    for r in taps(spark).collect():
        for y in range(r["b"], H, N):
            for x in range(r["a"], W, N):
                if 0 <= y + r["dv"] < H and 0 <= x + r["du"] < W:
                    out[:, y + r["dv"], x + r["du"]] += volume[r["z"], :, y, x] * r["h"]
    return out


@pytest.fixture(scope="module")
def volume():
    return np.random.default_rng(0).integers(0, 9, (2, 2, H, W)).astype(float)


@pytest.fixture(scope="module")
def frame():
    return np.random.default_rng(1).integers(0, 9, (2, H, W)).astype(float)


def test_forward_is_the_slow_sum(spark, volume):
    got = projection.forward(pixels(spark, volume, ("z", "t", "y", "x")), taps(spark), N, H, W)
    assert np.abs(dense(got, (2, H, W)) - slow_forward(volume, spark)).max() < 1e-9


def test_adjoint(spark, volume, frame):
    p = taps(spark)
    hx = dense(projection.forward(pixels(spark, volume, ("z", "t", "y", "x")), p, N, H, W), (2, H, W))
    hty = dense(projection.backward(pixels(spark, frame), psf.transpose(p, N), N, H, W), volume.shape, ("z", "t", "y", "x"))
    assert abs((hx * frame).sum() - (volume * hty).sum()) < 1e-6


def test_batches_are_independent_and_linear(spark, frame):
    back = psf.transpose(taps(spark), N)
    pair = np.stack([frame[0], 1.4 * frame[0]])
    both = dense(projection.backward(pixels(spark, pair), back, N, H, W), (2, 2, H, W), ("z", "t", "y", "x"))
    assert np.allclose(1.4 * both[:, 0], both[:, 1])


def test_block_form_agrees(spark, frame):
    back = psf.transpose(taps(spark), N)
    slow = dense(projection.backward(pixels(spark, frame), back, N, H, W), (2, 2, H, W), ("z", "t", "y", "x"))
    fast = block.to_pixels(block.backward(block.to_blocks(pixels(spark, frame), H, W), block.spectra(back, N, H, W)), W)
    assert np.abs(dense(fast, (2, 2, H, W), ("z", "t", "y", "x")) - slow).max() < 1e-9
    again = dense(projection.forward(pixels(spark, slow, ("z", "t", "y", "x")), taps(spark), N, H, W), (2, H, W))
    quick = block.to_pixels(block.forward(block.to_blocks(pixels(spark, slow, ("z", "t", "y", "x")), H, W), block.spectra(taps(spark), N, H, W)), W)
    assert np.abs(dense(quick, (2, H, W)) - again).max() < 1e-6


def test_empty_frame_and_fixed_point(spark, volume):
    zero = pixels(spark, np.zeros((1, H, W)))
    assert deconvolution.deconvolve(zero, taps(spark), N, H, W, 1).count() == 0
    truth = pixels(spark, volume[:, :1] + 1, ("z", "t", "y", "x"))
    seen = projection.forward(truth, taps(spark), N, H, W)
    for standard in (False,):
        got = deconvolution.deconvolve(seen, taps(spark), N, H, W, 1, standard, guess=truth)
        assert np.allclose(dense(got, (2, 1, H, W), ("z", "t", "y", "x")), volume[:, :1] + 1)


def test_mask_must_be_dark(spark, frame):
    mask = pixels(spark, np.zeros((H, W)), ("y", "x")).select("y", "x", F.col("v").cast("int").alias("m"))
    with pytest.raises(ValueError):
        deconvolution.deconvolve(pixels(spark, frame), taps(spark), N, H, W, 1, True, mask)
    with pytest.raises(ValueError):
        deconvolution.deconvolve(pixels(spark, frame), taps(spark), N, H, W, 1, False, mask)


def test_even_lenslets_and_large_cuts_fail(spark, frame):
    with pytest.raises(ValueError):
        projection.check_lenslet(4)
    with pytest.raises(ValueError):
        images.crop_lenslets(pixels(spark, frame), N, H, W, 2, 2, 0, 0)
    with pytest.raises(IndexError):
        files.zero_based([0])


def test_expansion_covers_each_phase_once(spark):
    for n in (3, 5):
        whole = fx.psf(spark, n, n, 1)
        assert sorted(map(tuple, psf.expand(psf.quadrant(whole, n), n).collect())) == sorted(map(tuple, whole.collect()))


def test_rectified_positions():
    kept = rectify.positions(10, 3.3, 3, 25)
    assert len(kept) == 15 and np.allclose(np.diff(kept), 1.1)


def test_rolls_and_comparison(spark, frame):
    df = pixels(spark, frame)
    moved = dense(images.roll(df, -1.5, W), frame.shape)
    assert np.allclose(moved, 0.5 * np.roll(frame, -2, 2) + 0.5 * np.roll(frame, -1, 2))
    assert images.agrees(df, df, ["t", "y", "x"], 0.0)
    assert not images.agrees(df, df.withColumn("v", F.lit(float("nan"))), ["t", "y", "x"], 1e9)


def test_warps(spark, frame):
    one = pixels(spark, frame[:1])
    assert np.allclose(dense(flow.warp_uniform(one, 0, 2, H, W), (1, H, W))[0, :, 2:], frame[0, :, :-2])
    points = flow.control_points(spark, H, W, 3)
    still = points.select("k", "cx", "cy", F.lit(2.0).alias("dx"), F.lit(0.0).alias("dy"))
    assert np.allclose(dense(flow.warp_piecewise(one, still, 3, H, W), (1, H, W))[0, :, 2:], frame[0, :, :-2])


def test_shift_is_recovered(spark):
    y, x = np.mgrid[0:H, 0:W]
    spot = np.exp(-((y - 4) ** 2 + (x - 5) ** 2) / 4.0) * 100
    pair = np.stack([spot, np.roll(spot, 2, 1)])
    history = flow.recover_shift(pixels(spark, pair), H, W, [(0, 0), (0, 2), (1, 0)], rounds=0)
    assert min(history, key=lambda h: h[2])[1] == (0, 2)


def test_repeated_column(spark):
    f = flow.parabolic_flow(flow.control_points(spark, 6, 6, 3), 6)
    assert flow.repeat_last(f, 3, 1.0).count() == 12


@pytest.mark.parametrize("text, form, values", [("12 0x1F 17", "%d %x %o", (12, 31, 15)), ("a=1.5e3;b", "a=%f;%c", (1500.0, "b")), ("x  y", "%s%s", ("x", "y")), ("010 0x10 7", "%i%i%i", (8, 16, 7)), ("1234", "%2d%*1d%d", (12, 4)), ("123456", "%3f%3f", (123.0, 456.0)), ("-1234", "%3d%d", (-12, 34)), ("-1.25e-3,7", "%4f%s", (-1.2, "5e-3,7")), ("0x1Fz", "%3i%x%c", (1, 15, "z")), ("1e5", "%2f%s", (1.0, "e5"))])
def test_scanning(spark, text, form, values):
    assert scanning.sscanf(text, form) == values
    got = spark.createDataFrame([(text,)], "t string").select(*scanning.scan_columns(F.col("t"), form)).first()
    assert tuple(got) == values


def test_scanning_errors():
    with pytest.raises(scanning.IncompleteCapture):
        scanning.sscanf("x", "%d")
    with pytest.raises(scanning.IncompleteCapture):
        scanning.sscanf("123", "%d%d")
    with pytest.raises(scanning.FormatError):
        scanning.compile_format("%q")


def test_names(spark):
    known = [
        "PSFmatrix/fdnormPSFmatrix_M40NA0.95MLPitch150fml3000from-6to-5zspacing0.5Nnum15lambda520n1.mat", "PSFmatrix/reducedPSFmatrix_M40NA0.95MLPitch150fml3000from-24to0zspacing3Nnum15lambda520n1.33.mat",
        "fdnormPSFMatrix_M22.222NA0.5MLPitch125fml3125from-60to60zspacing5Nnum19lambda520n1.33.mat", "reducedBuggyPSFmatrix_M22.222NA0.5MLPitch125fml3125from-56to56zspacing4Nnum19lambda520n1.33.mat",
    ]
    parsed = names.parse_psf_names(spark.createDataFrame([(k,) for k in known], "path string"))
    names.require_generated(parsed).collect()
    back = parsed.select("path", names.psf_name(parsed).alias("name")).collect()
    assert all(r["name"].split("_", 1)[1] == r["path"].split("_", 1)[1] for r in back)
    bad = names.parse_psf_names(spark.createDataFrame([("PSFmatrix_M1.mat",)], "path string"))
    with pytest.raises(Exception, match="not the name"):
        names.require_generated(bad).collect()
    row = spark.range(1).select(names.rectified_name(F.lit("a/b.c.tif"), 15).alias("r"), names.deconvolved_name(F.lit("a/b.tif")).alias("d")).first()
    assert tuple(row) == ("a/b.c_N15.tif", "a/b_deconvolved.tif")


def test_bessel():
    assert abs(numbers.bessel_j0(np.array([10.0]))[0] + 0.2459357644513483) < 1e-12


def test_images_as_files(spark, tmp_path, frame):
    for k in range(2):
        (tmp_path / f"f{k}.tif").write_bytes(files.encode_tiff(frame[k].astype(np.float32)))
    (tmp_path / "g.tif").write_bytes(b"no image")
    got = files.time_points(files.read_images(spark, str(tmp_path)))
    assert np.array_equal(dense(got, frame.shape), frame)


def test_psf_store_prunes_planes(spark, tmp_path):
    meta = fx.axis(spark, "z", 0, 1).withColumn("s", F.lit(5))
    files.write_psf(taps(spark), meta, str(tmp_path))
    one, m = files.read_psf(spark, str(tmp_path), 1, 1)
    assert {r["z"] for r in one.select("z").distinct().collect()} == {0} and m.count() == 1
    assert "PartitionFilters: [isnotnull(z" in one._jdf.queryExecution().toString()


def test_commented_text_and_flat_arrays(spark, tmp_path):
    (tmp_path / "s.txt").write_text("# head\n1\t2.5\t3\t4  # tail\n\n")
    assert [tuple(r) for r in files.read_scaling(spark, str(tmp_path / "s.txt")).collect()] == [(1.0, 2.5, 3.0, 4.0)]
    a = np.arange(6.0).reshape(2, 3)
    assert np.array_equal(dense(files.from_flat(spark, a.ravel().tolist(), (3, 2)), (2, 3), ("y", "x")), a)


def test_streamed_batches(spark, tmp_path, frame):
    from phaselens.streaming import batches

    for t in range(2):
        pixels(spark, frame).where(F.col("t") == t).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = batches.frames(spark, str(tmp_path / "in"), 1)
    query = batches.process(stream, lambda b: projection.backward(b, psf.transpose(taps(spark), N), N, H, W), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    want = projection.backward(pixels(spark, frame), psf.transpose(taps(spark), N), N, H, W)
    assert got.select("z", "t", "y", "x", "v").exceptAll(want.select("z", "t", "y", "x", "v")).isEmpty() and got.count() == want.count()


def test_synthesis_conserves_flux(spark):
    optics = synthesis.Optics(m=40, na=0.95, pitch=150e-6, n=3, osr=1, index=1.0, fml=3000e-6, lam=520e-9, zmin=-1e-6, zmax=1e-6, spacing=1e-6)
    total = synthesis.synthesise(spark, optics).groupBy("z", "b", "a").agg(F.sum("h").alias("s")).collect()
    assert len(total) == 27 and all(abs(r["s"] - 1) < 1e-9 for r in total)


def test_empty_trace(spark):
    empty = fx.thread_log(spark, "/root/testdata/sf0.001").limit(0)
    assert trace.high_water(empty).count() == 0 and trace.buffer_ids(empty).count() == 0
    assert trace.best_so_far(fx.trials(spark, "/root/testdata/sf0.001").limit(0)).count() == 0


def test_work_is_numbered_whole_and_not_in_one_task(spark):
    n = 3000
    items = spark.range(0, n, 1, 6).select(F.col("id").alias("seq"), (F.col("id") * 7 % 3).alias("root_order"), (F.col("id") % 9).alias("root_plane"), (F.col("id") % 4).alias("depth"), (F.col("id") % 11).alias("plane"))
    placed = trace.work_places(items, 4, 2)
    want = sorted(range(n), key=lambda i: (i * 7 % 3, i % 9 // 3, i % 4, i % 11 // 3, i))
    assert [r["seq"] for r in sorted(placed.collect(), key=lambda r: r["place"])] == want
    assert sorted(r["place"] for r in placed.select("place").collect()) == list(range(1, n + 1))
    assert "collect_list" not in placed._jdf.queryExecution().toString()


def test_the_whole_table_has_its_places(spark):
    whole = catalog.queries()["work_order"](spark, "/root/testdata/sf0.001")
    assert whole.count() == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count() > 500
