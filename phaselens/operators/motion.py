"""Flows of many control points: warps by any mesh of triangles, all candidates scored in one query, a search in many dimensions.

A mesh is points (k, cx, cy) and triangles (tri, a, b, c) of their numbers.  A pixel's place in its triangle is found once: it is
the same for every candidate, as a candidate only moves what the corners say.  Candidates are keyed by ``iter`` and are made by
the search, so there are a few for each unknown; pixels meet them as a list, and each candidate's pixels are rows of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phaselens.operators.deconvolution import ratio, updated
from phaselens.operators.flow import control_points, pad_edges, score, warp_uniform
from phaselens.operators.images import roll
from phaselens.operators.projection import backward, forward
from phaselens.operators.psf import transpose
from phaselens.plans.lineage import cut

#: Pixels of a side of the cells by which pixels and triangles meet.
CELL = 16
#: How far outside its triangle rounding may put a pixel on an edge, in parts of the triangle.
EDGE = 1e-12
#: Unknowns up to which every round of a search looks along each two of them.
PAIRS = 12
Judge = Callable[[list[list[float]]], list[float]]


def triangulate(points: Sequence[tuple[float, float]]) -> list[tuple[int, int, int]]:
    """Delaunay triangles of a few control points (x, y), by adding one after the other: those whose circle holds it are replaced."""
    at = np.asarray(points, float)
    if len(at) < 3:
        return []
    centre, size = at.mean(0), 1e4 * max(1.0, float(np.ptp(at, 0).max()))
    at = np.vstack([at, centre + size * np.array([[-2, -1], [2, -1], [0, 2]])])
    last = len(at) - 3
    held = {(last, last + 1, last + 2)}

    def circle(t: tuple[int, int, int], p: np.ndarray) -> float:
        rows = [[*(at[i] - p), ((at[i] - p) ** 2).sum()] for i in t]
        turn = np.linalg.det([[*at[i], 1.0] for i in t])
        return float(np.linalg.det(rows) * np.sign(turn))

    for k in range(last):
        bad = [t for t in held if circle(t, at[k]) > 0]
        edges: dict[tuple[int, int], int] = {}
        for t in bad:
            for e in ((t[0], t[1]), (t[1], t[2]), (t[0], t[2])):
                edges[min(e), max(e)] = edges.get((min(e), max(e)), 0) + 1
        held -= set(bad)
        held |= {tuple(sorted((*e, k))) for e, n in edges.items() if n == 1}
    flat = lambda t: abs(np.linalg.det([[*at[i], 1.0] for i in t])) < 1e-9
    return sorted(t for t in held if max(t) < last and not flat(t))


def triangle_table(spark: SparkSession, triangles: Sequence[tuple[int, int, int]]) -> DataFrame:
    """(tri, a, b, c) of a list of triangles."""
    return spark.createDataFrame([(k, *map(int, t)) for k, t in enumerate(triangles)], "tri int, a int, b int, c int")


def places(points: DataFrame, triangles: DataFrame, height: int, width: int) -> DataFrame:
    """(y, x, tri, k, w): each pixel's triangle, the first of those that touch it, its corners' numbers and their shares.

    Triangles go to the cells of their bounding boxes and pixels to theirs, so a pixel meets only triangles nearby.
    """
    spark = points.sparkSession
    mesh = triangles
    for c in "abc":
        mesh = mesh.join(points.select(F.col("k").alias(c), F.col("cx").cast("double").alias(f"{c}x"), F.col("cy").cast("double").alias(f"{c}y")), c)
    whole = (F.col("bx") - F.col("ax")) * (F.col("cy") - F.col("ay")) - (F.col("cx") - F.col("ax")) * (F.col("by") - F.col("ay"))
    cells = lambda d, size: F.explode(F.sequence(
        F.greatest(F.lit(0), F.floor(F.least(*(F.col(c + d) for c in "abc")) / CELL)), F.least(F.lit((size - 1) // CELL), F.floor(F.greatest(*(F.col(c + d) for c in "abc")) / CELL))
    ).cast("array<int>"))
    touching = lambda d, size: (F.greatest(*(F.col(c + d) for c in "abc")) >= 0) & (F.least(*(F.col(c + d) for c in "abc")) <= size - 1)
    mesh = mesh.withColumn("whole", whole).where(F.col("whole") != 0).where(touching("y", height) & touching("x", width))
    mesh = mesh.withColumn("_cy", cells("y", height)).withColumn("_cx", cells("x", width))
    grid = spark.range(height * width).select(F.floor(F.col("id") / width).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x"))
    grid = grid.withColumn("_cy", F.floor(F.col("y") / CELL).cast("int")).withColumn("_cx", F.floor(F.col("x") / CELL).cast("int"))
    share = lambda p, q: ((F.col(f"{p}x") - F.col("x")) * (F.col(f"{q}y") - F.col("y")) - (F.col(f"{q}x") - F.col("x")) * (F.col(f"{p}y") - F.col("y"))) / F.col("whole")
    met = grid.join(mesh, ["_cy", "_cx"]).select("y", "x", "tri", F.array("a", "b", "c").alias("k"), F.array(share("b", "c"), share("c", "a"), share("a", "b")).alias("w"))
    inside = met.where(F.forall("w", lambda w: w >= -EDGE))
    return inside.groupBy("y", "x").agg(F.min(F.struct("tri", "k", "w")).alias("m")).select("y", "x", "m.*")


def candidate_list(motion: DataFrame) -> Column:
    """motion (iter, k, dy, dx) as one list of (iter, flow by k), for queries that score all candidates at once."""
    each = motion.groupBy("iter").agg(F.map_from_entries(F.collect_list(F.struct("k", F.struct(F.col("dy").cast("double").alias("dy"), F.col("dx").cast("double").alias("dx"))))).alias("flow"))
    return each.agg(F.collect_list(F.struct("iter", "flow"))).scalar()


def aims(found: DataFrame, motion: DataFrame, height: int, width: int, beyond: str = "first") -> DataFrame:
    """(iter, ty, tx, py, px): where each target pixel of each candidate looks, inside the frame.

    A pixel in no triangle looks at the first pixel (as a place of -1 whose edge is continued), or with ``beyond`` "still" at itself.
    """
    if beyond not in ("first", "still"):
        raise ValueError("beyond must be first or still")
    grid = found.sparkSession.range(height * width).select(F.floor(F.col("id") / width).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x"))
    rows = grid.join(found, ["y", "x"], "left").withColumn("c", F.explode(candidate_list(motion)))
    move = lambda d: sum((F.element_at("w", i) * F.element_at(F.col("c.flow"), F.element_at("k", i))[d] for i in (2, 3)), F.element_at("w", 1) * F.element_at(F.col("c.flow"), F.element_at("k", 1))[d])
    place = lambda t, d, size: F.greatest(F.lit(0.0), F.least(F.lit(float(size - 1)), F.coalesce(F.col(t) - move(d), F.lit(-1.0) if beyond == "first" else F.col(t).cast("double"))))
    return rows.select(F.col("c.iter").alias("iter"), F.col("y").alias("ty"), F.col("x").alias("tx"), place("y", "dy", height).alias("py"), place("x", "dx", width).alias("px"))


def sampled(pixels: DataFrame, aimed: DataFrame, height: int, width: int) -> DataFrame:
    """(iter, other columns of pixels, y, x, v): bilinear samples of pixels (..., y, x, v) at the places of ``aims``."""
    keys = [c for c in pixels.columns if c not in ("y", "x", "v")]
    low = lambda p, size: F.least(F.floor(p), F.lit(max(0, size - 2))).cast("int")
    at = aimed.withColumn("ly", low("py", height)).withColumn("lx", low("px", width)).withColumn("fy", F.col("py") - F.col("ly")).withColumn("fx", F.col("px") - F.col("lx"))
    corners = F.explode(F.array(*(F.struct((F.col("ly") + i).alias("y"), (F.col("lx") + j).alias("x"), ((F.col("fy") if i else 1 - F.col("fy")) * (F.col("fx") if j else 1 - F.col("fx"))).alias("w")) for i in (0, 1) for j in (0, 1))))
    taps = at.select("iter", "ty", "tx", corners.alias("s")).select("iter", "ty", "tx", "s.*").where("w <> 0")
    return pixels.join(taps, ["y", "x"]).groupBy("iter", *keys, F.col("ty").alias("y"), F.col("tx").alias("x")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def warp_mesh(pixels: DataFrame, flow: DataFrame, triangles: DataFrame, height: int, width: int, beyond: str = "first") -> DataFrame:
    """Pixels (..., y, x, v) warped by the flow (k, cx, cy, dx, dy) of any triangles: affine in each, bilinear samples, edges continued outwards.

    Values are scaled by the largest size while they are warped, so that of equal frames of other brightness equal digits come out.
    """
    found = places(flow, triangles, height, width)
    moved = sampled(pixels.withColumn("v", F.col("v") / F.nullif(pixels.agg(F.max(F.abs("v"))).scalar(), F.lit(0.0))), aims(found, flow.withColumn("iter", F.lit(0)), height, width, beyond), height, width)
    return moved.drop("iter").withColumn("v", F.coalesce(F.col("v") * pixels.agg(F.max(F.abs("v"))).scalar(), F.lit(0.0)))


def flow_scores(frame: DataFrame, found: DataFrame, motion: DataFrame, height: int, width: int, extend: int = 0, beyond: str = "first") -> DataFrame:
    """(iter, ssd) of each candidate motion (iter, k, dy, dx): the first frame is warped, and its squared differences to the second inside the border are added up.

    ``found`` is what ``places`` gives, once for all candidates.
    """
    first, second = (frame.where(F.col("t") == t).select("y", "x", "v") for t in (0, 1))
    inside = F.col("ty").between(1, height - 2 - extend) & F.col("tx").between(1, width - 2 - extend)
    moved = sampled(first, aims(found, motion, height, width, beyond).where(inside), height, width)
    both = moved.join(second.withColumnRenamed("v", "seen"), ["y", "x"])
    return both.groupBy("iter").agg(F.sum((F.col("v") - F.col("seen")) * (F.col("v") - F.col("seen"))).alias("ssd"))


def shifted_each(pixels: DataFrame, candidates: DataFrame, height: int, width: int, back: bool = False) -> DataFrame:
    """Pixels (iter, ..., y, x, v), each candidate's (iter, dy, dx) shifted by its own shift, or ``back`` by it; bilinear, edges continued outwards."""
    keys = [c for c in pixels.columns if c not in ("y", "x", "v")]

    def taps(size: int, shift: str, name: str) -> DataFrame:
        def pair(target: Column) -> Column:
            move = -F.col(shift) if back else F.col(shift)
            at = F.greatest(F.lit(0.0), F.least(F.lit(size - 1.0), target - move))
            low = F.least(F.floor(at), F.lit(max(0, size - 2))).cast("int")
            return F.array(F.struct(target.alias(f"o{name}"), low.alias(name), (1 - (at - low)).alias(f"w{name}")), F.struct(target.alias(f"o{name}"), (low + 1).alias(name), (at - low).alias(f"w{name}")))

        return candidates.select("iter", F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), pair))).alias("s")).select("iter", "s.*").where(F.col(f"w{name}") != 0)

    moved = pixels.join(taps(height, "dy", "y"), ["iter", "y"]).join(taps(width, "dx", "x"), ["iter", "x"])
    return moved.groupBy(*keys, F.col("oy").alias("y"), F.col("ox").alias("x")).agg(F.sum(F.col("v") * F.col("wy") * F.col("wx")).alias("v"))


def joint_scores(frame: DataFrame, psf: DataFrame, n: int, height: int, width: int, iterations: int, candidates: DataFrame, extend: int = 0) -> DataFrame:
    """(iter, dy, dx, ssd) of all candidate shifts (iter, dy, dx) at once: each has the object that fits both frames best, and what they would show of it.

    A candidate's two frames are time points 2 * iter and 2 * iter + 1 of one projection, so a round of all candidates is one query; the
    frames' own back projection is the same for all and made once.
    """
    keys = ["iter", "z", "y", "x"]
    back = transpose(psf, n)
    one = cut(backward(frame, back, n, height, width))

    def mean(first: DataFrame, second: DataFrame) -> DataFrame:
        both = first.select(*keys, "v").unionByName(shifted_each(second.select(*keys, "v"), candidates, height, width, True))
        return both.groupBy(*keys).agg((F.sum("v") / 2).alias("v"))

    def seen(volume: DataFrame) -> DataFrame:
        half = volume.select(*keys, (F.col("v") / 2).alias("v"))
        pair = half.withColumn("t", F.col("iter") * 2).unionByName(shifted_each(half, candidates, height, width).withColumn("t", F.col("iter") * 2 + 1))
        return forward(pair.drop("iter"), psf, n, height, width)

    dealt = one.withColumn("iter", F.explode(candidates.agg(F.collect_list("iter")).scalar()))  # a few candidates
    start = cut(mean(dealt.where("t = 0"), dealt.where("t = 1")))
    now = start
    for _ in range(iterations):
        again = backward(seen(now), back, n, height, width).withColumn("iter", F.floor(F.col("t") / 2).cast("int"))
        fit = mean(again.where("t % 2 = 0"), again.where("t % 2 = 1")).withColumnRenamed("v", "d")
        step = now.join(start.withColumnRenamed("v", "s"), keys, "left").join(fit, keys, "left")
        now = cut(step.select(*keys, updated(F.col("v"), ratio(F.coalesce("s", F.lit(0.0)), F.coalesce("d", F.lit(0.0)))).alias("v")))
    told = cut(seen(now).select(F.floor(F.col("t") / 2).cast("int").alias("iter"), (F.col("t") % 2).alias("t"), "y", "x", "v"))
    mean_of = lambda df: F.avg(F.when(F.col("t") == 0, F.col("v")))
    scale = told.groupBy("iter").agg(mean_of(told).alias("m")).withColumn("scale", F.col("m") / frame.agg(mean_of(frame).alias("m")).scalar()).select("iter", "scale")
    inside = F.col("y").between(1, height - 2 - extend) & F.col("x").between(1, width - 2 - extend)
    both = told.where(inside).join(frame.select("t", "y", "x", F.col("v").alias("r")), ["t", "y", "x"]).join(scale, "iter")
    return candidates.join(both.groupBy("iter").agg(F.sum(F.pow(F.col("v") / F.col("scale") - F.col("r"), 2)).alias("ssd")), "iter").select("iter", "dy", "dx", "ssd")


def flow_judge(frame: DataFrame, points: DataFrame, triangles: DataFrame, height: int, width: int, sideways: bool = True, beyond: str = "first") -> Judge:
    """Scores of many flows by one query.  A flow is dy, dx of each control point in the order of k, or dy alone if nothing moves ``sideways``."""
    found = cut(places(points, triangles, height, width))
    names = [r[0] for r in points.select("k").orderBy("k").collect()]  # control points, tens of them
    each = 2 if sideways else 1

    def judge(todo: list[list[float]]) -> list[float]:
        rows = [(i, k, float(x[each * j]), float(x[each * j + 1]) if sideways else 0.0) for i, x in enumerate(todo) for j, k in enumerate(names)]
        motion = frame.sparkSession.createDataFrame(rows, "iter int, k int, dy double, dx double")
        scores = {r["iter"]: float(r["ssd"]) for r in flow_scores(frame, found, motion, height, width, 0, beyond).collect()}
        return [scores.get(i, float("inf")) for i in range(len(todo))]

    return judge


def joint_judge(frame: DataFrame, psf: DataFrame, n: int, height: int, width: int, iterations: int, extend: int = 0) -> Judge:
    """Scores of many shifts (dy, dx) by the objects that fit both frames best, all of them in one query."""

    def judge(todo: list[list[float]]) -> list[float]:
        tried = frame.sparkSession.createDataFrame([(k, float(y), float(x)) for k, (y, x) in enumerate(todo)], "iter int, dy double, dx double")
        found = {r["iter"]: float(r["ssd"]) for r in joint_scores(frame, psf, n, height, width, iterations, tried, extend).collect()}
        return [found[k] for k in range(len(todo))]

    return judge


def minimise_many(judge: Judge, start: Sequence[float], bounds: Sequence[tuple[float, float]], tolerance: float = 0.01, step: float = 0.5, rounds: int = 40) -> list[tuple[list[float], float]]:
    """History (place, score) of a quasi-Newton search inside bounds; the best of it is the result.

    A round is two queries.  The first scores steps to either side along every unknown, which give the slope and how it bends, and of up to
    PAIRS unknowns (of more, in the first round and where the search is stuck) steps along each two of them; between such rounds the bend is
    learnt from slopes.  The second scores places that the model leads to, more and less boldly.  Steps shorten as the search
    closes in, until they and its moves are under ``tolerance``.
    """
    low, high = (np.array([b[i] for b in bounds], float) for i in (0, 1))
    clip = lambda p: np.minimum(high, np.maximum(low, p))
    history: list[tuple[list[float], float]] = []

    def score(todo: list[np.ndarray]) -> np.ndarray:
        found = judge([p.tolist() for p in todo])
        history.extend((p.tolist(), s) for p, s in zip(todo, found, strict=True))
        return np.array(found)

    now, size = clip(np.asarray(start, float)), len(start)
    unit, both = np.eye(size), [(i, j) for i in range(size) for j in range(i)]
    best, reach, bend, before = None, step, None, None
    for _ in range(rounds):
        whole = bend is None or size <= PAIRS
        todo = [clip(now + s * reach * e) for e in unit for s in (1, -1)] + ([clip(now + reach * (unit[i] + unit[j])) for i, j in both] if whole else [])
        found = score(todo if best is not None else [now, *todo])
        if best is None:
            best, found = float(found[0]), found[1:]
        up, down = found[: 2 * size : 2], found[1 : 2 * size : 2]
        above, below = np.minimum(reach, high - now), np.minimum(reach, now - low)  # steps end at bounds
        with np.errstate(divide="ignore", invalid="ignore"):
            rise, fall = np.where(above > 0, (up - best) / above, np.nan), np.where(below > 0, (best - down) / below, np.nan)
            slope = np.where(np.isnan(rise), fall, np.where(np.isnan(fall), rise, (rise * below + fall * above) / (above + below)))
            own = np.nan_to_num(2 * (rise - fall) / (above + below))
            slope = np.nan_to_num(slope)
        if whole:
            bend = np.diag(own)
            for (i, j), f in zip(both, found[2 * size :], strict=True):
                if above[i] > 0 and above[j] > 0:
                    bend[i, j] = bend[j, i] = (f - up[i] - up[j] + best) / (above[i] * above[j])
        else:
            gone, turned = now - before[0], slope - before[1]
            if gone @ turned > 0:
                there = bend @ gone
                bend = bend + np.outer(turned, turned) / (gone @ turned) - np.outer(there, there) / (gone @ there)
        before = (now, slope)
        # where the slope leads out of bounds nothing moves
        free = ~(((now <= low) & (slope > 0)) | ((now >= high) & (slope < 0)))
        values, ways = np.linalg.eigh(bend[np.ix_(free, free)])
        firm = np.maximum(np.abs(values), 1e-12)
        along = ways.T @ slope[free]
        tried = [now + s * reach * e for e in unit for s in (0.25, -0.25)]
        for damp in (0.0, 1e-3, 1e-2, 0.1, 1.0, 10.0):
            for share in (1.0, 0.5):
                move = np.zeros(size)
                move[free] = -share * ways @ (along / (firm + damp * firm.max(initial=0.0)))
                tried.append(now + np.clip(move, -8 * step, 8 * step))
        tried = [clip(p) for p in tried]
        scores = np.concatenate([score(tried), up, down])
        places_ = [*tried, *todo[: 2 * size : 2], *todo[1 : 2 * size : 2]]
        at = int(np.argmin(scores))
        moved = 0.0
        if scores[at] < best:
            moved = float(np.abs(places_[at] - now).max())
            now, best = places_[at], float(scores[at])
        if moved <= tolerance and reach <= tolerance:
            break
        if moved < reach:
            reach = max(reach / 4, moved, tolerance / 2)
            bend = bend if moved else None
    return history


def best_place(history: list[tuple[list[float], float]]) -> tuple[list[float], float]:
    return min(history, key=lambda h: h[1])


def recover_flow(frame: DataFrame, points: DataFrame, triangles: DataFrame, height: int, width: int, start: Sequence[float], reach: float = 10.0, sideways: bool = True, tolerance: float = 0.01, beyond: str = "first") -> list[tuple[list[float], float]]:
    """The history of the search for the control points' motion between two frames, up to ``reach`` pixels from ``start``."""
    judge = flow_judge(frame, points, triangles, height, width, sideways, beyond)
    return minimise_many(judge, start, [(s - reach, s + reach) for s in start], tolerance)


def better_beside(judge: Judge, place: Sequence[float], chosen: Sequence[int] | None = None, by: Sequence[float] = (7.0, 8.0, 12.0, 13.0)) -> list[tuple[int, float, float]]:
    """(unknown, step, gain as a share of the better score) of perturbed places that score better than ``place``: none if a search has converged.

    All perturbations are one query.  ``chosen`` unknowns are perturbed, by default those numbered 7, 8, 12 and 13 or, of few, the first four.
    """
    if chosen is None:
        chosen = (7, 8, 12, 13) if len(place) > 13 else range(min(4, len(place)))
    steps = [(k, d) for d in by for k in chosen]
    todo = [[float(v) + (d if i == k else 0.0) for i, v in enumerate(place)] for k, d in steps]
    own, *scores = judge([list(map(float, place)), *todo])
    return [(k, d, (own - s) / s if s else float("inf")) for (k, d), s in zip(steps, scores, strict=True) if s < own]


@dataclass(frozen=True)
class Shifter:
    """How an object is moved, given the motion (dy, dx) of some control points: a plug-in for scores and searches.

    Other ways to move are further classes with ``points`` and ``shifted``; ``SHIFTERS`` has those that are named.
    """

    height: int
    width: int

    def points(self, spark: SparkSession) -> DataFrame:
        """(k, cx, cy) of the control points, where flow vectors are drawn."""
        return spark.createDataFrame([(0, float(self.width // 2), float(self.height // 2))], "k int, cx double, cy double")

    def shifted(self, pixels: DataFrame, moves: Sequence[tuple[float, float]]) -> DataFrame:
        raise NotImplementedError


class RolledShifter(Shifter):
    """One motion for all pixels; what leaves at an edge comes in at the other one, parts of pixels are shared between neighbours."""

    def shifted(self, pixels: DataFrame, moves: Sequence[tuple[float, float]]) -> DataFrame:
        return roll(roll(pixels, moves[0][0], self.height, "y"), moves[0][1], self.width, "x")


class UniformShifter(Shifter):
    """One motion for all pixels, edges continued outwards."""

    def shifted(self, pixels: DataFrame, moves: Sequence[tuple[float, float]]) -> DataFrame:
        return warp_uniform(pixels, moves[0][0], moves[0][1], self.height, self.width)


@dataclass(frozen=True)
class MeshShifter(Shifter):
    """A motion for each point of a grid ``spacing`` apart, affine between them; ``inner`` points only, the border is still then."""

    spacing: int = 15
    extend: int = 0
    inner: bool = False

    def points(self, spark: SparkSession) -> DataFrame:
        return control_points(spark, self.height, self.width, self.spacing, self.inner, self.extend)

    def shifted(self, pixels: DataFrame, moves: Sequence[tuple[float, float]]) -> DataFrame:
        spark = pixels.sparkSession
        told = spark.createDataFrame([(k, float(y), float(x)) for k, (y, x) in enumerate(moves)], "k int, dy double, dx double")
        flow = self.points(spark).join(told, "k").select("k", "cx", "cy", "dx", "dy")
        if self.inner:
            flow = pad_edges(control_points(spark, self.height, self.width, self.spacing, False, self.extend), flow)
        at = [(r["cx"], r["cy"]) for r in flow.orderBy("k").select("cx", "cy").collect()]  # control points
        return warp_mesh(pixels, flow, triangle_table(spark, triangulate(at)), self.height, self.width)


#: Ways to move by name.
SHIFTERS: dict[str, type[Shifter]] = {"rolled": RolledShifter, "uniform": UniformShifter, "mesh": MeshShifter}


def shift_judge(frame: DataFrame, shifter: Shifter, extend: int = 0) -> Judge:
    """Scores of motions by any shifter, each its own query: the first frame moved, against the second."""

    def judge(todo: list[list[float]]) -> list[float]:
        first = frame.where("t = 0").select("t", "y", "x", "v")
        out = []
        for x in todo:
            moved = shifter.shifted(first, list(zip(x[::2], x[1::2], strict=True))).withColumn("t", F.lit(1)).select("t", "y", "x", "v")
            out.append(float(score(first.unionByName(moved), frame, shifter.height, shifter.width, extend).first()["ssd"]))
        return out

    return judge
