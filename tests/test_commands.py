"""Files in, files out; searches for a shift; numbers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from phaselens import commands
from phaselens.functions import numbers
from phaselens.operators import deconvolution, flow, rectify
from phaselens.plans.lineage import numbered
from phaselens.sources import files, fixtures as fx

NAME = "reducedPSFmatrix_M40NA0.95MLPitch150fml3000from-2to2zspacing2Nnum3lambda520n1.mat"


@pytest.fixture(scope="module")
def psf_path(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('psf')}/{NAME}"
    taps, meta = fx.psf(spark, 3, 2, 2), fx.axis(spark, "z", 0, 1).withColumn("s", F.lit(5))
    files.write_psf(taps, meta, path, spark.sql("SELECT 3 AS nnum"))
    return path


def test_a_time_series_is_deconvolved_in_batches(spark, tmp_path, psf_path):
    frames = np.random.default_rng(0).integers(1, 9, (3, 9, 12)).astype(np.uint16)
    for t, px in enumerate(frames):
        (tmp_path / f"im{t}.tif").write_bytes(files.encode_tiff(px))
    done = commands.deconvolve_files(spark, str(tmp_path), psf_path, f"{tmp_path}/out", batch=2, iterations=1).collect()
    assert sorted(r["path"].rsplit("/", 1)[1] for r in done) == [f"im{t}_deconvolved.tif" for t in range(3)]
    rows = [(t, y, x, float(v)) for (t, y, x), v in np.ndenumerate(frames)]
    want = np.zeros((3, 2, 9, 12))
    for r in deconvolution.deconvolve(spark.createDataFrame(rows, "t int, y int, x int, v double"), fx.psf(spark, 3, 2, 2), 3, 9, 12, 1).collect():
        want[r["t"], r["z"], r["y"], r["x"]] = r["v"]
    for t in range(3):
        h, w, kind, px = files.decode_tiff((tmp_path / "out" / f"im{t}_deconvolved.tif").read_bytes())
        assert (h, w, kind) == (18, 12, "float32") and np.allclose(px.reshape(2, 9, 12), want[t], rtol=1e-6)
    with pytest.raises(ValueError):
        commands.deconvolve_files(spark, str(tmp_path), psf_path, f"{tmp_path}/out", batch=0)


def test_images_are_rectified_in_their_own_type(spark, tmp_path):
    px = np.random.default_rng(0).integers(0, 255, (25, 31)).astype(np.uint8)
    (tmp_path / "a.tif").write_bytes(files.encode_tiff(px))
    (tmp_path / "b.tif").write_bytes(b"no image")
    commands.rectify_files(spark, str(tmp_path), f"{tmp_path}/out", 14, 11, 3.3, 3)
    h, w, kind, got = files.decode_tiff((tmp_path / "out" / "a_N3.tif").read_bytes())
    ys, xs = rectify.positions(11, 3.3, 3, 25), rectify.positions(14, 3.3, 3, 31)
    assert (h, w, kind) == (len(ys), len(xs), "uint8")
    y, x = np.array(ys)[:, None], np.array(xs)
    i, j = np.minimum(np.floor(y), 23).astype(int), np.minimum(np.floor(x), 29).astype(int)
    want = px[i, j] * (1 - y + i) * (1 - x + j) + px[i + 1, j] * (y - i) * (1 - x + j) + px[i, j + 1] * (1 - y + i) * (x - j) + px[i + 1, j + 1] * (y - i) * (x - j)
    assert np.abs(got.reshape(h, w) - np.round(want)).max() <= 1 and (got.reshape(h, w) == np.round(want)).mean() > 0.99


def test_a_missing_point_spread_function_is_made(spark, tmp_path):
    path = f"{tmp_path}/{NAME}"
    taps, meta, optics = files.load_psf(spark, path)
    assert meta.count() == 3 and optics.first()["nnum"] == 3 and files.plane_count(spark, path) == 3
    before = (tmp_path / NAME / "taps").stat().st_mtime_ns
    assert files.load_psf(spark, path, 1, 1)[0].select("z").distinct().collect()[0]["z"] == 0
    assert (tmp_path / NAME / "taps").stat().st_mtime_ns == before
    assert not taps.isEmpty()
    with pytest.raises(Exception, match="not the name"):
        files.load_psf(spark, f"{tmp_path}/other.mat")


def test_tiles_and_deflated_strips():
    import struct
    import zlib

    px = np.random.default_rng(0).random((20, 37))
    padded = np.zeros((32, 48))
    padded[:20, :37] = px
    tiles = [zlib.compress(padded[y : y + 16, x : x + 16].astype("<f8").tobytes()) for y in (0, 16) for x in (0, 16, 32)]
    offsets, at = [], 8
    for t in tiles:
        offsets.append(at)
        at += len(t)
    lists = struct.pack(f"<{2 * len(tiles)}I", *offsets, *map(len, tiles))
    tags = [(256, 37, 1), (257, 20, 1), (258, 64, 1), (259, 8, 1), (277, 1, 1), (322, 16, 1), (323, 16, 1), (324, at, 6), (325, at + 24, 6), (339, 3, 1)]
    raw = struct.pack("<2sHI", b"II", 42, at + len(lists)) + b"".join(tiles) + lists + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, 4, n, v) for t, v, n in tags) + b"\0" * 4
    h, w, kind, got = files.decode_tiff(raw)
    assert (h, w, kind) == (20, 37, "float64") and np.allclose(got.reshape(h, w), px)


def test_flat_arrays_of_other_tools(spark, psf_path):
    frame = np.random.default_rng(1).integers(0, 9, (9, 12)).astype(float)
    back = files.project_flat(spark, psf_path, [2, 1], frame.ravel(), (12, 9), True)
    again = files.project_flat(spark, psf_path, [2, 1], back, (12, 9, 1, 2), False)
    assert back.shape == (2 * 9 * 12,) and again.shape == (9 * 12,) and again.sum() > back.sum() > 0
    with pytest.raises(IndexError):
        files.project_flat(spark, psf_path, [0], frame.ravel(), (12, 9), True)


def test_a_search_finds_the_shift_and_has_converged(spark):
    h, w = 12, 14
    y, x = np.mgrid[0:h, 0:w]
    spot = lambda cy, cx: np.exp(-((y - cy) ** 2 + (x - cx) ** 2) / 8.0) * 100
    pair = np.stack([spot(5, 6), spot(5, 8)])
    df = spark.createDataFrame([(t, a, b, float(v)) for (t, a, b), v in np.ndenumerate(pair)], "t int, y int, x int, v double")
    judge = flow.scorer(df, h, w)
    one = float(flow.score(flow.naive_candidate(df, 0.5, 1.25, h, w), df, h, w).first()["ssd"])
    assert abs(judge([(0.5, 1.25)])[0] - one) < 1e-6
    history = flow.minimise(judge, (1.0, 0.0), ((-2.0, 2.0), (-3.0, 3.0)), tolerance=0.1)
    found = flow.best_shift(history)
    assert max(abs(found[0]), abs(found[1] - 2)) <= 0.1
    assert flow.better_nearby(judge, found) == [] and flow.better_nearby(judge, (0.0, 0.0))


def test_trivial_projectors_give_the_object_back(spark):
    h, w = 6, 7
    v = np.random.default_rng(0).integers(1, 9, (2, h, w)).astype(float)
    v[1] = v[0]
    df = spark.createDataFrame([(t, a, b, float(x)) for (t, a, b), x in np.ndenumerate(v)], "t int, y int, x int, v double")
    shown = flow.joint_candidate(df, flow.point_psf(spark), 1, h, w, 3, 0.0, 0.0)
    got = np.zeros((2, h, w))
    for r in shown.collect():
        got[r["t"], r["y"], r["x"]] = r["v"]
    assert np.allclose(got / got.sum() * v.sum(), v)


def test_trials_are_appended(spark, tmp_path):
    history = [(0, (0.0, 1.0), 3.0), (1, (1.0, 1.0), 2.0)]
    flow.write_trials(spark, history[:1], f"{tmp_path}/t")
    flow.write_trials(spark, history[1:], f"{tmp_path}/t")
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/t").orderBy("iter").collect()] == [(0, [0.0, 1.0], 3.0), (1, [1.0, 1.0], 2.0)]


def test_numbers_run_on_over_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    got = numbered(df.repartition(7).orderBy("v"), "n", 1)
    assert sorted(map(tuple, got.collect())) == [(v, v + 1) for v in range(1000)]
    assert numbered(df.limit(0).orderBy("v"), "n").count() == 0


def test_bessel_functions_fit_together():
    x = np.array([0.05, 0.3, 1.0, 4.0, 11.0, 40.0])
    j, y, i, k = numbers.bessel_j, numbers.bessel_y, numbers.bessel_i, numbers.bessel_k
    for n in (0, 1, 3):
        assert np.allclose(j(n + 1, x) * y(n, x) - j(n, x) * y(n + 1, x), 2 / np.pi / x, rtol=1e-8)
        assert np.allclose(i(n, x) * k(n + 1, x) + i(n + 1, x) * k(n, x), 1 / x, rtol=1e-8)
    assert abs(y(0, np.array([1.0]))[0] - 0.088256964215677) < 1e-12 and abs(k(0, np.array([1.0]))[0] - 0.421024438240708) < 1e-12


def test_factors():
    assert numbers.prime_factors(360) == [2, 2, 2, 3, 3, 5] and numbers.prime_factors(97) == [97] and numbers.prime_factors(1) == []


def test_progress_is_said_at_its_cadence(spark):
    from phaselens.plans.progress import Progress

    said, shown = [], []
    tell = Progress(5, every=2, say=said.append, show=lambda k, _: shown.append(k), show_every=3)
    for k in range(5):
        tell(k, spark.range(1))
    assert [s.split(",")[0] for s in said] == ["2 of 5", "4 of 5"] and shown == [2]
