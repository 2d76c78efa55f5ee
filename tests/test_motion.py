"""Warps by any mesh, scores of many candidates, and searches that find what was planted."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from phaselens.operators import flow, motion
from phaselens.sources import fixtures as fx


def frame_of(spark, image, t=0):
    return spark.createDataFrame([(t, int(y), int(x), float(v)) for (y, x), v in np.ndenumerate(image)], "t int, y int, x int, v double")


def image_of(df, height, width):
    out = np.zeros((height, width))
    for r in df.collect():
        out[r["y"], r["x"]] = r["v"]
    return out


def shares(p, corners):
    (ax, ay), (bx, by), (cx, cy) = corners
    whole = (bx - ax) * (cy - ay) - (cx - ax) * (by - ay)
    x, y = p
    return [((bx - x) * (cy - y) - (cx - x) * (by - y)) / whole, ((cx - x) * (ay - y) - (ax - x) * (cy - y)) / whole, ((ax - x) * (by - y) - (bx - x) * (ay - y)) / whole]


def plain_warp(image, points, moves, triangles, beyond="first"):
    """Pixel by pixel; moves (dy, dx)."""
    height, width = image.shape
    out = np.zeros_like(image)
    for y in range(height):
        for x in range(width):
            my = mx = None
            for t in triangles:
                w = shares((x, y), [points[i] for i in t])
                if min(w) >= -1e-12:
                    my, mx = (sum(a * moves[i][d] for a, i in zip(w, t, strict=True)) for d in (0, 1))
                    break
            py, px = (y - my, x - mx) if my is not None else (-1, -1) if beyond == "first" else (y, x)
            py, px = min(max(py, 0), height - 1), min(max(px, 0), width - 1)
            ly, lx = min(math.floor(py), height - 2), min(math.floor(px), width - 2)
            fy, fx_ = py - ly, px - lx
            out[y, x] = (1 - fy) * ((1 - fx_) * image[ly, lx] + fx_ * image[ly, lx + 1]) + fy * ((1 - fx_) * image[ly + 1, lx] + fx_ * image[ly + 1, lx + 1])
    return out


def table(spark, points, moves):
    return spark.createDataFrame([(k, float(x), float(y), float(dy), float(dx)) for k, ((x, y), (dy, dx)) in enumerate(zip(points, moves, strict=True))], "k int, cx double, cy double, dy double, dx double")


def test_triangles_hold_no_other_point_in_their_circle():
    r = np.random.default_rng(4)
    points = [tuple(p) for p in r.random((25, 2)) * [60, 40]]
    found = motion.triangulate(points)
    area = sum(abs(np.linalg.det([[*points[i], 1.0] for i in t])) / 2 for t in found)
    for t in found:
        a, b, c = (np.array(points[i]) for i in t)
        m = np.linalg.solve(2 * np.array([b - a, c - a]), [b @ b - a @ a, c @ c - a @ a])
        assert all(np.hypot(*(np.array(p) - m)) >= np.hypot(*(a - m)) - 1e-9 for p in points)
    def turn(o, p, q):
        return (p[0] - o[0]) * (q[1] - o[1]) - (p[1] - o[1]) * (q[0] - o[0])
    def half(ps):
        out = []
        for p in ps:
            while len(out) > 1 and turn(out[-2], out[-1], p) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]
    hull = half(sorted(points)) + half(sorted(points, reverse=True))
    whole = abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(hull, hull[1:] + hull[:1], strict=True))) / 2
    assert abs(area - whole) < 1e-6 * whole
    assert motion.triangulate([(0, 0), (1, 1)]) == [] and len(motion.triangulate([(0, 0), (4, 0), (0, 4), (4, 4)])) == 2


@pytest.mark.parametrize("beyond", ["first", "still"])
@pytest.mark.parametrize("cell", [16, 5])
def test_warp_of_irregular_points(spark, monkeypatch, beyond, cell):
    monkeypatch.setattr(motion, "CELL", cell)
    r = np.random.default_rng(7)
    height, width = 23, 37
    image = r.random((height, width)) * 100
    points = [(2.0, 1.0), (33.5, 3.0), (4.0, 20.0), (30.0, 19.5), (17.3, 9.1), (11.0, 15.0)]  # some pixels are in no triangle
    moves = r.normal(size=(6, 2)) * 2
    triangles = motion.triangulate(points)
    got = motion.warp_mesh(frame_of(spark, image), table(spark, points, moves), motion.triangle_table(spark, triangles), height, width, beyond)
    assert np.abs(image_of(got, height, width) - plain_warp(image, points, moves, triangles, beyond)).max() < 1e-9
    with pytest.raises(ValueError):
        motion.warp_mesh(frame_of(spark, image), table(spark, points, moves), motion.triangle_table(spark, triangles), height, width, "round")


def test_a_regular_mesh_warps_as_before(spark):
    frame = fx.frame(spark, "/root/testdata/sf0.001")
    moving = flow.parabolic_flow(flow.control_points(spark, 30, 45, 15), 45).withColumn("dx", F.col("cx") * F.col("cy") / 450.0)
    k = {(r["cx"], r["cy"]): r["k"] for r in moving.collect()}
    triangles = [t for x in (0, 15, 30) for y in (0, 15) for t in ((k[x, y], k[x + 15, y], k[x, y + 15]), (k[x + 15, y + 15], k[x, y + 15], k[x + 15, y]))]
    one = flow.warp_piecewise(frame, moving, 15, 30, 45).toPandas().set_index(["t", "y", "x"])["v"].sort_index()
    other = motion.warp_mesh(frame, moving, motion.triangle_table(spark, triangles), 30, 45).toPandas().set_index(["t", "y", "x"])["v"].sort_index()
    assert list(one.index) == list(other.index) and (one - other).abs().max() < 1e-6


def blobs(height, width):
    """A smooth image that any shift changes."""
    y, x = np.mgrid[:height, :width]
    return 10 + sum(100 * np.exp(-((y - height * a) ** 2 + (x - width * b) ** 2) / (2 * s**2)) for a, b, s in ((0.2, 0.2, 3), (0.75, 0.3, 4), (0.5, 0.6, 3), (0.25, 0.8, 4), (0.8, 0.8, 3)))


@pytest.fixture(scope="module")
def planted(spark):
    """Two frames, the second warped by a motion of four control points, which are eight unknowns."""
    height, width = 30, 36
    points = [(-2.0, -2.0), (38.0, -2.0), (-2.0, 32.0), (38.0, 32.0)]
    moves = [(1.2, -0.7), (-0.8, 0.9), (0.4, 1.3), (-1.1, -0.5)]
    triangles = motion.triangulate(points)
    first = blobs(height, width)
    frame = frame_of(spark, first).unionByName(frame_of(spark, plain_warp(first, points, moves, triangles), 1)).persist()
    return frame, table(spark, points, moves).drop("dy", "dx"), motion.triangle_table(spark, triangles), height, width, [c for m in moves for c in m]


def test_all_candidates_are_scored_in_one_query(spark, planted):
    frame, points, triangles, height, width, truth = planted
    judge = motion.flow_judge(frame, points, triangles, height, width)
    todo = [truth, [0.0] * 8, [v + 0.5 for v in truth]]
    got = judge(todo)
    first, second = (image_of(frame.where(F.col("t") == t), height, width) for t in (0, 1))
    at = [(r["cx"], r["cy"]) for r in points.orderBy("k").collect()]
    for score, x in zip(got, todo, strict=True):
        moved = plain_warp(first, at, [(x[2 * i], x[2 * i + 1]) for i in range(4)], [tuple(r)[1:] for r in triangles.collect()])
        assert abs(score - ((moved - second)[1 : height - 1, 1 : width - 1] ** 2).sum()) < 1e-6 * (1 + score)


def test_a_planted_motion_of_eight_unknowns_is_found(spark, planted):
    frame, points, triangles, height, width, truth = planted
    history = motion.recover_flow(frame, points, triangles, height, width, [0.0] * 8, 4.0, tolerance=0.02)
    place, score = motion.best_place(history)
    assert np.abs(np.array(place) - truth).max() < 0.1 and score < 0.01 * history[0][1]
    judge = motion.flow_judge(frame, points, triangles, height, width)
    assert motion.better_beside(judge, place) == []
    away = list(truth)
    away[2] -= 7.0  # a step of 7 leads back
    assert any((k, d) == (2, 7.0) and gain > 0 for k, d, gain in motion.better_beside(judge, away))


def test_motion_along_the_channel_only(spark, planted):
    frame, points, triangles, height, width, _ = planted
    first = image_of(frame.where("t = 0"), height, width)
    at, faces = [(r["cx"], r["cy"]) for r in points.orderBy("k").collect()], [tuple(r)[1:] for r in triangles.collect()]
    second = plain_warp(first, at, [(1.5, 0), (0.5, 0), (1.5, 0), (0.5, 0)], faces)
    both = frame.where("t = 0").unionByName(frame_of(spark, second, 1))
    place, _ = motion.best_place(motion.recover_flow(both, points, triangles, height, width, [0.0] * 4, 3.0, sideways=False, tolerance=0.02))
    assert np.abs(np.array(place) - [1.5, 0.5, 1.5, 0.5]).max() < 0.1


@pytest.mark.parametrize("pairs", [12, 2])
def test_the_search_follows_a_bent_valley_inside_bounds(monkeypatch, pairs):
    monkeypatch.setattr(motion, "PAIRS", pairs)
    valley = lambda todo: [sum(100 * (b - a * a) ** 2 + (1 - a) ** 2 for a, b in zip(x, x[1:])) for x in todo]
    history = motion.minimise_many(valley, [-0.5, 0.5, 0.0], [(-2, 2)] * 3, 1e-4, 0.5, 400)
    place, score = motion.best_place(history)
    assert score < 1e-6 and np.abs(np.array(place) - 1).max() < 1e-3 and all(-2 <= v <= 2 for p, _ in history for v in p)
    history = motion.minimise_many(lambda todo: [(x[0] - 5) ** 2 + (x[1] + 1) ** 2 for x in todo], [0.0, 0.0], [(-2, 2), (-3, 3)])
    place, _ = motion.best_place(history)
    assert abs(place[0] - 2) < 0.02 and abs(place[1] + 1) < 0.02 and all(abs(p[0]) <= 2 for p, _ in history)


def test_joint_scores_of_all_candidates_at_once(spark):
    frame = fx.frame(spark, "/root/testdata/sf0.001")
    tried = spark.createDataFrame([(0, 1.0, 2.0), (1, 0.5, -1.25)], "iter int, dy double, dx double")
    found = {r["iter"]: r["ssd"] for r in motion.joint_scores(frame, fx.psf(spark), 3, 30, 45, 1, tried).collect()}
    for k, dy, dx in ((0, 1.0, 2.0), (1, 0.5, -1.25)):
        alone = flow.score(flow.joint_candidate(frame, fx.psf(spark), 3, 30, 45, 1, dy, dx), frame, 30, 45).first()["ssd"]
        assert abs(found[k] - alone) < 1e-6 * alone


def test_shifters_move_alike_where_they_can(spark):
    height, width = 18, 24
    image = blobs(height, width)
    pixels = frame_of(spark, image).drop("t")
    moved = {n: image_of(kind(height, width).shifted(pixels, [(2.0, -3.0)] * (6 if n == "mesh" else 1)), height, width) for n, kind in motion.SHIFTERS.items() if n != "mesh"}
    mesh = motion.MeshShifter(height, width, spacing=12)
    number = mesh.points(spark).count()
    moved["mesh"] = image_of(mesh.shifted(pixels, [(2.0, -3.0)] * number), height, width)
    assert np.abs(moved["rolled"] - np.roll(image, (2, -3), (0, 1))).max() < 1e-9
    edge = np.pad(image, 4, "edge")[2 : 2 + height, 7 : 7 + width]
    assert np.abs(moved["uniform"] - edge).max() < 1e-9
    inside = {(r["cx"], r["cy"]) for r in mesh.points(spark).collect()}
    right, bottom = max(x for x, _ in inside), max(y for _, y in inside)
    assert np.abs(moved["mesh"][: bottom + 1, : right + 1] - edge[: bottom + 1, : right + 1]).max() < 1e-9
    still = motion.MeshShifter(height, width, spacing=6, inner=True)
    kept = image_of(still.shifted(pixels, [(1.0, 1.0)] * still.points(spark).count()), height, width)
    assert np.abs(kept[0] - image[0]).max() < 1e-9 and np.abs(kept - image).max() > 1


def test_judges_of_plug_ins(spark):
    height, width = 18, 24
    image = blobs(height, width)
    frame = frame_of(spark, image).unionByName(frame_of(spark, np.roll(image, (1, 2), (0, 1)), 1))
    good, bad = motion.shift_judge(frame, motion.RolledShifter(height, width))([[1.0, 2.0], [0.0, 0.0]])
    assert good < 1e-12 < bad
    taps = fx.psf(spark)
    frame = fx.frame(spark, "/root/testdata/sf0.001")
    alone = motion.joint_scores(frame, taps, 3, 30, 45, 1, spark.createDataFrame([(0, 1.0, 2.0)], "iter int, dy double, dx double")).first()["ssd"]
    assert abs(motion.joint_judge(frame, taps, 3, 30, 45, 1)([[0.0, 0.0], [1.0, 2.0]])[1] - alone) < 1e-9 * alone
