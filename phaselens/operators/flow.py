"""Flow between two frames (t 0 and 1): control points, shifts and warps, window matching, scores, paired deconvolution."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phaselens.operators.deconvolution import ratio, updated
from phaselens.operators.projection import backward, forward
from phaselens.operators.psf import transpose
from phaselens.plans.lineage import cut


def control_points(spark: SparkSession, height: int, width: int, spacing: int, inner: bool = False, extend: int = 0) -> DataFrame:
    """(k, cx, cy): a grid ``spacing`` apart, by columns; ``inner`` leaves out the border."""
    xs = list(range(spacing, width, spacing) if inner else range(0, width + 1, spacing))
    ys = list(range(spacing, height - extend, spacing) if inner else range(0, height + 1 - extend, spacing))
    rows = spark.range(1).select(F.posexplode(F.array(*map(F.lit, xs))).alias("i", "cx")).select("*", F.posexplode(F.array(*map(F.lit, ys))).alias("j", "cy"))
    return rows.select((F.col("i") * len(ys) + F.col("j")).alias("k"), "cx", "cy")


def parabolic_flow(points: DataFrame, width: int, peak: float = 7.0) -> DataFrame:
    """flow (k, cx, cy, dx, dy): a channel's profile, fastest in the middle."""
    half = width / 2.0
    return points.select("k", "cx", "cy", F.lit(0.0).alias("dx"), ((half**2 - (F.col("cx") - half) * (F.col("cx") - half)) / half**2 * peak).alias("dy"))


def pad_edges(points: DataFrame, flow: DataFrame) -> DataFrame:
    """The flow at all points: 0 where it isn't given.  A given point that isn't among them is an error."""
    if not flow.join(points, ["cx", "cy"], "left_anti").isEmpty():
        raise ValueError("a flow vector stands at no control point")
    given = flow.select("cx", "cy", "dx", "dy")
    return points.join(given, ["cx", "cy"], "left").select("k", "cx", "cy", F.coalesce("dx", F.lit(0.0)).alias("dx"), F.coalesce("dy", F.lit(0.0)).alias("dy"))


def repeat_last(flow: DataFrame, side: int, add: float = 0.0) -> DataFrame:
    """A square of side by side vectors (numbered row by row) with its last column once more, ``add`` added to it."""
    row, col = F.floor(F.col("k") / side), F.col("k") % side
    old = flow.withColumn("k", (row * (side + 1) + col).cast("int"))
    new = flow.where(col == side - 1).select((row * (side + 1) + side).cast("int").alias("k"), "cx", "cy", (F.col("dx") + add).alias("dx"), (F.col("dy") + add).alias("dy"))
    return old.unionByName(new)


def speed(flow: DataFrame) -> DataFrame:
    return flow.withColumn("speed", F.hypot("dx", "dy"))


def lit_vectors(frame: DataFrame, flow: DataFrame, spacing: int, least: float) -> DataFrame:
    """Vectors whose window in the first frame has more light than ``least``.

    Each pixel goes to the windows it is in - of points within half the spacing, by an equi-join on cells of that size.
    """
    half = spacing // 2
    cell = lambda c: F.floor(c / spacing)
    around = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    points = flow.select("*", around.alias("_i")).select("*", around.alias("_j")).withColumn("_cy", cell(F.col("cy")) + F.col("_i")).withColumn("_cx", cell(F.col("cx")) + F.col("_j"))
    light = frame.where("t = 0").withColumn("_cy", cell(F.col("y"))).withColumn("_cx", cell(F.col("x")))
    inside = (F.col("y") >= F.col("cy") - half) & (F.col("y") < F.col("cy") + half) & (F.col("x") >= F.col("cx") - half) & (F.col("x") < F.col("cx") + half)
    return light.join(points, ["_cy", "_cx"]).where(inside).groupBy(*flow.columns).agg(F.sum("v").alias("light")).where(F.col("light") > least)


def match_windows(frame: DataFrame, points: DataFrame, spacing: int) -> DataFrame:
    """flow (k, cx, cy, dx, dy) by the least sum of absolute differences of a window to those in a window twice as wide.

    Of equal sums the first offset, by rows, counts.  Points need the wide window inside the frame.
    """
    small, wide = spacing // 2, spacing
    at = lambda t, r, y, x: frame.where(F.col("t") == t).select(F.col("y").alias(y), F.col("x").alias(x), F.col("v").alias(f"v{t}"))
    reach = lambda r: F.explode(F.sequence(F.lit(-r), F.lit(r - 1)))
    own = points.select("k", "cx", "cy", reach(small).alias("i")).select("*", reach(small).alias("j"))
    own = own.withColumn("y", F.col("cy") + F.col("i")).withColumn("x", F.col("cx") + F.col("j")).join(at(0, small, "y", "x"), ["y", "x"])
    span = 2 * (wide - small)
    offsets = F.explode(F.sequence(F.lit(0), F.lit(span)))
    moved = own.select("k", "cx", "cy", "y", "x", "v0", offsets.alias("oy")).select("*", offsets.alias("ox"))
    moved = moved.withColumn("y", F.col("y") + F.col("oy") - span // 2).withColumn("x", F.col("x") + F.col("ox") - span // 2)
    sums = moved.join(at(1, wide, "y", "x"), ["y", "x"]).groupBy("k", "cx", "cy", "oy", "ox").agg(F.sum(F.abs(F.col("v0") - F.col("v1"))).alias("sad"))
    best = sums.groupBy("k", "cx", "cy").agg(F.min(F.struct("sad", "oy", "ox")).alias("m"))
    return best.select("k", "cx", "cy", (span // 2 - F.col("m.ox")).cast("double").alias("dx"), (span // 2 - F.col("m.oy")).cast("double").alias("dy"), F.col("m.sad").alias("sad"))


def warp_uniform(pixels: DataFrame, dy: float, dx: float, height: int, width: int) -> DataFrame:
    """out(y, x) = in(y - dy, x - dx), bilinear, edges continued outwards; other columns are kept as keys."""
    keys = [c for c in pixels.columns if c not in ("y", "x", "v")]

    def taps(size: int, d: float, name: str) -> Column:
        rows = []
        for target in range(size):
            p = min(max(target - d, 0.0), size - 1.0)
            low = min(math.floor(p), size - 2) if size > 1 else 0
            rows += [(low, target, 1 - (p - low)), (low + 1, target, p - low)] if p > low else [(low, target, 1.0)]
        return F.explode(F.array(*(F.struct(F.lit(a).alias(name), F.lit(b).alias(f"o{name}"), F.lit(float(w)).alias(f"w{name}")) for a, b, w in rows))).alias("s")

    one = pixels.sparkSession.range(1)
    ys, xs = (one.select(taps(size, d, n)).select("s.*") for size, d, n in ((height, dy, "y"), (width, dx, "x")))
    return pixels.join(ys, "y").join(xs, "x").groupBy(*keys, F.col("oy").alias("y"), F.col("ox").alias("x")).agg(F.sum(F.col("v") * F.col("wy") * F.col("wx")).alias("v"))


def warp_piecewise(pixels: DataFrame, flow: DataFrame, spacing: int, height: int, width: int) -> DataFrame:
    """Warp by a regular mesh of triangles, affine in each: a cell of four control points is cut by the diagonal from its right upper
    to its left lower corner.  Each target pixel takes its triangle's flow - cells are found by an equi-join - and a bilinear sample there;
    edges are continued outwards.
    """
    keys = [c for c in pixels.columns if c not in ("y", "x", "v")]
    spark = pixels.sparkSession
    target = spark.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("ty")).select("ty", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("tx"))
    part = lambda c: F.col(c) / spacing - F.floor(F.col(c) / spacing)
    corner = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)))).alias("c")
    p, q = part("ty"), part("tx")
    before = F.when((F.col("c.i") == 0) & (F.col("c.j") == 0), 1 - p - q).when((F.col("c.i") == 1) & (F.col("c.j") == 1), 0.0).when(F.col("c.i") == 1, p).otherwise(q)
    behind = F.when((F.col("c.i") == 1) & (F.col("c.j") == 1), p + q - 1).when((F.col("c.i") == 0) & (F.col("c.j") == 0), 0.0).when(F.col("c.i") == 1, 1 - q).otherwise(1 - p)
    weight = F.when(p + q <= 1, before).otherwise(behind)
    near = target.select("ty", "tx", corner).withColumn("w", weight)
    near = near.withColumn("cy", (F.floor(F.col("ty") / spacing) + F.col("c.i")) * spacing).withColumn("cx", (F.floor(F.col("tx") / spacing) + F.col("c.j")) * spacing)
    moved = near.join(flow.select("cy", "cx", "dx", "dy"), ["cy", "cx"]).groupBy("ty", "tx").agg((F.sum(F.col("w") * F.col("dy")) / F.sum("w")).alias("my"), (F.sum(F.col("w") * F.col("dx")) / F.sum("w")).alias("mx"))
    py, px = (F.greatest(F.lit(0.0), F.least(F.lit(float(s - 1)), F.col(a) - F.col(b))) for s, a, b in ((height, "ty", "my"), (width, "tx", "mx")))
    placed = moved.select("ty", "tx", py.alias("py"), px.alias("px")).withColumn("ly", F.least(F.floor("py"), F.lit(height - 2))).withColumn("lx", F.least(F.floor("px"), F.lit(width - 2)))
    placed = placed.select("ty", "tx", "py", "px", "ly", "lx", corner)
    fy, fx = F.col("py") - F.col("ly"), F.col("px") - F.col("lx")
    placed = placed.withColumn("w", F.when(F.col("c.i") == 1, fy).otherwise(1 - fy) * F.when(F.col("c.j") == 1, fx).otherwise(1 - fx))
    placed = placed.select("ty", "tx", "w", (F.col("ly") + F.col("c.i")).cast("int").alias("y"), (F.col("lx") + F.col("c.j")).cast("int").alias("x")).where("w <> 0")
    return pixels.join(placed, ["y", "x"]).groupBy(*keys, F.col("ty").alias("y"), F.col("tx").alias("x")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def score(candidate: DataFrame, frame: DataFrame, height: int, width: int, extend: int = 0) -> DataFrame:
    """One row: ssd, the squared differences inside the border after the candidate's first frame is scaled to the seen one's mean."""
    mean = lambda df: F.avg(F.when(F.col("t") == 0, F.col("v"))).alias("m")
    scale = candidate.agg(mean(candidate)).scalar() / frame.agg(mean(frame)).scalar()
    inside = F.col("y").between(1, height - 2 - extend) & F.col("x").between(1, width - 2 - extend)
    both = candidate.where(inside).join(frame.select("t", "y", "x", F.col("v").alias("r")), ["t", "y", "x"])
    return both.agg(F.sum(F.pow(F.col("v") / scale - F.col("r"), 2)).alias("ssd"))


def pair(volume: DataFrame, dy: float, dx: float, height: int, width: int) -> DataFrame:
    """The two frames' objects (t 0 and 1) of one object (z, y, x, v): half the light each, the second one shifted."""
    half = volume.select("z", "y", "x", (F.col("v") / 2).alias("v"))
    return half.withColumn("t", F.lit(0)).unionByName(warp_uniform(half, dy, dx, height, width).withColumn("t", F.lit(1)))


def pair_forward(volume: DataFrame, psf: DataFrame, n: int, height: int, width: int, dy: float, dx: float) -> DataFrame:
    return forward(pair(volume, dy, dx, height, width), psf, n, height, width)


def pair_backward(frame: DataFrame, psf: DataFrame, n: int, height: int, width: int, dy: float, dx: float) -> DataFrame:
    """One object from both frames: the second one's back projection is shifted back, then the mean is taken.  Shifting back isn't the exact adjoint."""
    both = backward(frame, transpose(psf, n), n, height, width)
    first = both.where("t = 0").select("z", "y", "x", "v")
    second = warp_uniform(both.where("t = 1").select("z", "y", "x", "v"), -dy, -dx, height, width)
    return first.unionByName(second).groupBy("z", "y", "x").agg((F.sum("v") / 2).alias("v"))


def deconvolve_pair(frame: DataFrame, psf: DataFrame, n: int, height: int, width: int, iterations: int, dy: float, dx: float, standard: bool = False, guess: DataFrame | None = None) -> DataFrame:
    """Richardson-Lucy of a pair of frames into one object, given the shift between them, from their back projection or ``guess``.

    The ``standard`` form multiplies by the back projection of what the frames show over what the object would.
    """
    keys = ["z", "y", "x"]
    start = cut(pair_backward(frame, psf, n, height, width, dy, dx))
    now = start if guess is None else guess.select(*keys, "v")
    for _ in range(iterations):
        seen = pair_forward(now, psf, n, height, width, dy, dx)
        if standard:
            blur = frame.join(seen.withColumnRenamed("v", "s"), ["t", "y", "x"], "left").select("t", "y", "x", ratio(F.col("v"), F.coalesce("s", F.lit(0.0))).alias("v"))
            factor = pair_backward(blur, psf, n, height, width, dy, dx).withColumnRenamed("v", "f")
            now = cut(now.join(factor, keys, "left").select(*keys, updated(F.col("v"), F.coalesce("f", F.lit(0.0))).alias("v")))
            continue
        again = pair_backward(seen, psf, n, height, width, dy, dx).withColumnRenamed("v", "d")
        step = now.join(start.withColumnRenamed("v", "s"), keys, "left").join(again, keys, "left")
        now = cut(step.select(*keys, updated(F.col("v"), ratio(F.coalesce("s", F.lit(0.0)), F.coalesce("d", F.lit(0.0)))).alias("v")))
    return now


def naive_candidate(frame: DataFrame, dy: float, dx: float, height: int, width: int) -> DataFrame:
    """The first frame, and it again shifted as the second."""
    first = frame.where("t = 0")
    return first.unionByName(warp_uniform(first, dy, dx, height, width).withColumn("t", F.lit(1)).select("t", "y", "x", "v"))


def joint_candidate(frame: DataFrame, psf: DataFrame, n: int, height: int, width: int, iterations: int, dy: float, dx: float) -> DataFrame:
    """What both frames would show of the one object that fits them best, given the shift between them."""
    return pair_forward(deconvolve_pair(frame, psf, n, height, width, iterations, dy, dx), psf, n, height, width, dy, dx)


def point_psf(spark: SparkSession) -> DataFrame:
    """A point-spread function that changes nothing (one plane, lenslets of one pixel): trivial projectors to test with."""
    return spark.sql("SELECT 0 AS z, 0 AS b, 0 AS a, 0 AS dv, 0 AS du, 1.0D AS h")


def trivial_object(frame: DataFrame, dy: float, dx: float, height: int, width: int) -> DataFrame:
    """The object (z, y, x, v) of a pair of frames that are seen as they are: the mean of the first and the second shifted back."""
    first, second = (frame.where(F.col("t") == t).select("y", "x", "v") for t in (0, 1))
    both = first.unionByName(warp_uniform(second, -dy, -dx, height, width))
    return both.groupBy("y", "x").agg((F.sum("v") / 2).alias("v")).select(F.lit(0).alias("z"), "y", "x", "v")


def trivial_candidate(frame: DataFrame, dy: float, dx: float, height: int, width: int) -> DataFrame:
    """What both frames would show of ``trivial_object``."""
    return pair(trivial_object(frame, dy, dx, height, width), dy, dx, height, width).select("t", "y", "x", "v")


def naive_scores(frame: DataFrame, candidates: DataFrame, height: int, width: int, extend: int = 0) -> DataFrame:
    """candidates (iter, dy, dx) with ssd: all of them in one query, each the first frame shifted against the second.

    Of the two frames' differences only the second's counts, as the first is compared with itself.
    """

    def taps(size: int, shift: str, name: str) -> Column:
        def corner(target: Column) -> Column:
            at = F.greatest(F.lit(0.0), F.least(F.lit(size - 1.0), target - F.col(shift)))
            low = F.least(F.floor(at), F.lit(size - 2)).cast("int")
            return F.array(F.struct(target.alias("o"), low.alias("c"), (1 - (at - low)).alias("w")), F.struct(target.alias("o"), (low + 1).alias("c"), (at - low).alias("w")))

        return F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(size - 2 - extend)), corner))).alias(name)

    first, second = (frame.where(F.col("t") == t).select("y", "x", "v") for t in (0, 1))
    rows = candidates.select("iter", "dy", "dx", taps(height, "dy", "p")).select("*", taps(width, "dx", "q")).where("p.w <> 0 and q.w <> 0")
    sources = rows.select("iter", F.col("p.o").alias("oy"), F.col("q.o").alias("ox"), F.col("p.c").alias("y"), F.col("q.c").alias("x"), (F.col("p.w") * F.col("q.w")).alias("w"))
    moved = sources.join(first, ["y", "x"]).groupBy("iter", "oy", "ox").agg(F.sum(F.col("v") * F.col("w")).alias("m"))
    both = moved.join(second.select(F.col("y").alias("oy"), F.col("x").alias("ox"), "v"), ["oy", "ox"])
    return candidates.join(both.groupBy("iter").agg(F.sum((F.col("m") - F.col("v")) * (F.col("m") - F.col("v"))).alias("ssd")), "iter").select("iter", "dy", "dx", "ssd")


History = list[tuple[int, tuple[float, float], float]]


def scorer(frame: DataFrame, height: int, width: int, make: Callable[[float, float], DataFrame] | None = None) -> Callable[[list[tuple[float, float]]], list[float]]:
    """Scores of candidate shifts: by one query for all of them, or by one for each candidate that ``make`` makes (such as ``joint_candidate``)."""

    def plain(candidates: list[tuple[float, float]]) -> list[float]:
        rows = F.array(*(F.struct(F.lit(k).alias("iter"), F.lit(float(y)).alias("dy"), F.lit(float(x)).alias("dx")) for k, (y, x) in enumerate(candidates)))
        table = frame.sparkSession.range(1).select(F.explode(rows).alias("r")).select("r.*")
        found = {r["iter"]: r["ssd"] for r in naive_scores(frame, table, height, width).collect()}
        return [float(found[k]) for k in range(len(candidates))]

    def made(candidates: list[tuple[float, float]]) -> list[float]:
        return [float(score(make(y, x), frame, height, width).first()["ssd"]) for y, x in candidates]

    return made if make else plain


def recover_shift(frame: DataFrame, height: int, width: int, candidates: Iterable[tuple[float, float]], rounds: int = 2, make: Callable[[float, float], DataFrame] | None = None) -> History:
    """History (iter, (dy, dx), ssd) of a search: all candidates, then a finer grid around the best, ``rounds`` times."""
    judge = scorer(frame, height, width, make)
    history: History = []
    todo, step = list(candidates), 0.5
    for _ in range(rounds + 1):
        history += [(len(history) + k, c, s) for k, (c, s) in enumerate(zip(todo, judge(todo), strict=True))]
        y, x = min(history, key=lambda h: (h[2], h[0]))[1]
        todo = [(y + i * step, x + j * step) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]
        step /= 2
    return history


def minimise(
    judge: Callable[[list[tuple[float, float]]], list[float]], start: tuple[float, float], bounds: tuple[tuple[float, float], tuple[float, float]], tolerance: float = 0.01, each: int = 9, rounds: int = 50, history: History | None = None
) -> History:
    """Searches along one axis after the other, inside ``bounds`` ((low, high) of dy and of dx), until neither moves by more than ``tolerance``.

    A line search scores ``each`` places of an interval at once, and then of the interval around the best of them.  The
    history that is given goes on, from its best trial.
    """
    history = history if history is not None else []
    inside = lambda v, k: min(max(v, bounds[k][0]), bounds[k][1])
    best = best_shift(history) if history else (inside(start[0], 0), inside(start[1], 1))
    for _ in range(rounds):
        before = best
        for axis in (0, 1):
            low, high = bounds[axis]
            while True:
                places = [low + (high - low) * k / (each - 1) for k in range(each)] + [best[axis]]
                todo = [(p, best[1]) if axis == 0 else (best[0], p) for p in places]
                scores = judge(todo)
                history += [(len(history) + k, c, s) for k, (c, s) in enumerate(zip(todo, scores, strict=True))]
                best = todo[min(range(len(todo)), key=lambda k: (scores[k], k))]
                step = (high - low) / (each - 1)
                if step <= tolerance:
                    break
                low, high = max(bounds[axis][0], best[axis] - step), min(bounds[axis][1], best[axis] + step)
        if max(abs(a - b) for a, b in zip(best, before, strict=True)) <= tolerance:
            break
    return history


def best_shift(history: History) -> tuple[float, float]:
    return min(history, key=lambda h: (h[2], h[0]))[1]


def better_nearby(judge: Callable[[list[tuple[float, float]]], list[float]], found: tuple[float, float], by: Iterable[float] = (-1.0, 1.0)) -> list[tuple[tuple[float, float], float]]:
    """Shifts beside the one that was found that score better than it: none if the search has converged."""
    todo = [found, *((found[0] + d, found[1]) for d in by), *((found[0], found[1] + d) for d in by)]
    scores = judge(todo)
    return [(c, s) for c, s in zip(todo[1:], scores[1:], strict=True) if s < scores[0]]


def write_trials(spark: SparkSession, history: History, path: str) -> None:
    """Append a history to a table trial (iter, shift, score)."""
    rows = [(k, [float(y), float(x)], float(s)) for k, (y, x), s in history]
    spark.createDataFrame(rows, "iter long, shift array<double>, score double").write.mode("append").parquet(path)
