"""The engine's queries over the star-schema tables, each with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phaselens.functions import names, numbers, scanning
from phaselens.operators import block, deconvolution, flow, images, motion, projection, psf, rectify, synthesis, trace
from phaselens.sources import fixtures as fx
from phaselens.sources import tasks

H, W, N = fx.HEIGHT, fx.WIDTH, fx.LENSLET
Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}

#: Parts that queries' SQL is put together from.
PARTS = {
    "f": """f AS (SELECT t::INTEGER AS t, y::INTEGER AS y, x::INTEGER AS x, coalesce(s.v, 0.0)::DOUBLE AS v
 FROM range(2) a(t), range(30) b(y), range(45) c(x) LEFT JOIN (SELECT l_linenumber % 2 AS lt, l_orderkey % 30 AS ly, l_partkey % 45 AS lx, sum(l_quantity::DOUBLE) AS v FROM lineitem GROUP BY ALL) s
 ON s.lt = t AND s.ly = y AND s.lx = x)""",
    "p": """p AS (SELECT z::INTEGER AS z, b::INTEGER AS b, a::INTEGER AS a, dv::INTEGER AS dv, du::INTEGER AS du, (8 - abs(dv - (b - 1)) - abs(du - (a - 1)) - z)::DOUBLE AS h
 FROM range(3) q(z), range(3) r(b), range(3) s(a), range(-3, 4) u(dv), range(-3, 4) w(du) WHERE 8 - abs(dv - (b - 1)) - abs(du - (a - 1)) - z > 0)""",
    "q": "q AS (SELECT z, ((b + dv + 9) % 3)::INTEGER AS b, ((a + du + 9) % 3)::INTEGER AS a, -dv AS dv, -du AS du, h FROM p)",
    "bp": """bp AS (SELECT q.z, f.t, f.y + q.dv AS y, f.x + q.du AS x, sum(f.v * q.h) AS v FROM f JOIN q ON q.b = f.y % 3 AND q.a = f.x % 3
 WHERE f.v <> 0 AND f.y + q.dv BETWEEN 0 AND 29 AND f.x + q.du BETWEEN 0 AND 44 GROUP BY ALL)""",
    "m": "m AS (SELECT y::INTEGER AS y, x::INTEGER AS x, CASE WHEN y % 3 = 0 AND x % 3 = 0 THEN 0 ELSE 1 END AS m FROM range(30) b(y), range(45) c(x))",
    "log": """log AS (SELECT event_id::BIGINT AS item, (user_id % 4)::INTEGER AS thread, (event_id % 4)::INTEGER AS worktype, round(epoch_us(ts) / 1e6 - 1.7e9, 6) AS t_start,
 round(round(epoch_us(ts) / 1e6 - 1.7e9, 6) + value / 1000, 6) AS t_end, floor(value) / 1e5 AS m0, floor(value) / 1e5 * 2 AS m1, round(value * 10)::BIGINT AS memory,
 (event_id % 50)::BIGINT AS dest, (user_id % 40)::BIGINT AS src1, (event_id % 7)::BIGINT AS src2 FROM events)""",
    "tr": "tr AS (SELECT event_id::BIGINT AS iter, [floor(value / 20)::DOUBLE, floor(user_id / 3)::DOUBLE] AS shift, round(value, 6) AS score FROM events)",
    "sc": "sc AS (SELECT o_orderpriority AS host, (1 + o_custkey % 8)::INTEGER AS threads, sum(floor(o_totalprice))::DOUBLE AS wall, sum(o_custkey)::DOUBLE AS user_s, count(*)::DOUBLE AS sys_s FROM orders GROUP BY 1, 2)",
    "bt": "bt AS (SELECT o_orderstatus AS kind, (1 << (o_custkey % 6)::INTEGER)::INTEGER AS batch, sum(o_custkey)::DOUBLE AS seconds FROM orders GROUP BY 1, 2)",
    "na": """na AS (SELECT p_partkey, concat('PSFmatrix/', CASE p_partkey % 3 WHEN 0 THEN 'fdnormPSFmatrix_' WHEN 1 THEN 'reducedPSFmatrix_' ELSE 'reducedBuggyPSFmatrix_' END, 'M', p_size, 'NA0.', 1 + p_partkey % 9,
 'MLPitch', 100 + p_partkey % 50, 'fml', 3000 + p_partkey % 7, 'from-', 1 + p_size % 30, 'to', p_partkey % 60, 'zspacing', 1 + p_partkey % 4, 'Nnum', 15, 'lambda', 500 + p_size, 'n1.', 1 + p_partkey % 5, '.mat') AS path FROM part)""",
}

PARTS["wp"] = PARTS["p"].replace("p AS", "p0 AS") + """, p AS (SELECT p0.z, p0.b, p0.a, p0.dv, p0.du, p0.h * r.w AS h FROM p0 JOIN (SELECT p_partkey % 10 AS ring, sum(p_size)::DOUBLE AS w FROM part GROUP BY 1) r
 ON r.ring = abs(p0.dv - (p0.b - 1)) + abs(p0.du - (p0.a - 1)))"""


def forward_sql(source: str, name: str, shape: str = "p") -> str:
    return f"""{name} AS (SELECT s.t, s.y + p.dv AS y, s.x + p.du AS x, sum(s.v * p.h) AS v FROM {source} s JOIN {shape} p ON p.z = s.z AND p.b = s.y % 3 AND p.a = s.x % 3
 WHERE s.v <> 0 AND s.y + p.dv BETWEEN 0 AND 29 AND s.x + p.du BETWEEN 0 AND 44 GROUP BY ALL)"""


def backward_sql(source: str, name: str) -> str:
    return PARTS["bp"].replace("FROM f ", f"FROM {source} f ").replace("bp AS", f"{name} AS")


def ratio_sql(n: str, d: str) -> str:
    return f"CASE WHEN {d} <> 0 THEN {n} / {d} WHEN {n} = 0 THEN 0 WHEN {n} > 0 THEN 'inf'::DOUBLE ELSE '-inf'::DOUBLE END"


def step_sql(now: str, k: int) -> list[str]:
    f = ratio_sql("s.v", "coalesce(d.v, 0)")
    return [
        forward_sql(now, f"hx{k}"), backward_sql(f"hx{k}", f"hb{k}"),
        f"x{k} AS (SELECT n.z, n.t, n.y, n.x, CASE WHEN isnan(n.v * ({f})) THEN 0 ELSE n.v * ({f}) END AS v FROM {now} n JOIN bp s USING (z, t, y, x) LEFT JOIN hb{k} d USING (z, t, y, x))",
    ]


def sql(*parts: str) -> str:
    """A statement from named or given parts; the last is the select."""
    return "WITH " + ",\n".join(PARTS.get(x, x) for x in parts[:-1]) + "\n" + parts[-1]


def query(name: str, statement: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _queries[name] = f
        if statement:
            _sql[name] = statement
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def back(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.backward(fx.frame(spark, sf_dir), psf.transpose(fx.psf(spark), N), N, H, W)


# Point-spread functions


@query("psf_transpose", sql("wp", "q", "SELECT z, b, a, dv, du, h FROM q"))
def _(spark, sf_dir):
    return psf.transpose(fx.part_psf(spark, sf_dir), N)


@query("psf_quadrant_expand", sql("wp", "SELECT z, b, a, dv, du, h FROM p"))
def _(spark, sf_dir):
    return psf.expand(psf.quadrant(fx.part_psf(spark, sf_dir), N), N)


@query("psf_flux_normalise", sql("wp", "SELECT z, b, a, dv, du, round(h / sum(h) OVER (PARTITION BY z, b, a), 12) AS h FROM p"))
def _(spark, sf_dir):
    return psf.normalise_flux(fx.part_psf(spark, sf_dir)).withColumn("h", F.round("h", 12)).select("z", "b", "a", "dv", "du", "h")


@query("psf_max_normalise", sql("wp", "SELECT z, b, a, dv, du, h / (SELECT max(h) FROM p) AS h, (SELECT max(h) FROM p) AS hmax FROM p"))
def _(spark, sf_dir):
    return psf.normalise_max(fx.part_psf(spark, sf_dir))


@query("psf_plane_clip", sql("wp", "SELECT z, b, a, dv, du, h FROM (SELECT *, max(h) OVER (PARTITION BY z) AS top FROM p) WHERE h >= 0.4 * top"))
def _(spark, sf_dir):
    return psf.clip_planes(fx.part_psf(spark, sf_dir), 0.4)


WINDOW = (
    "WITH d AS (SELECT (s_suppkey % 5)::INTEGER AS z, (sum(s_nationkey) % 41 - 20) / 10.0::DOUBLE AS depth FROM supplier GROUP BY 1), e AS (SELECT z, greatest(3 * ceil(4 * abs(depth) / (SELECT max(abs(depth)) FROM d)), 6) AS half FROM d)"
    " SELECT z, greatest(31 - half, 1)::INTEGER AS ca_lo, least(31 + half, 61)::INTEGER AS ca_hi FROM e"
)


@query("ca_index", WINDOW)
def _(spark, sf_dir):
    planes = fx.table(spark, sf_dir, "supplier").groupBy((F.col("s_suppkey") % 5).cast("int").alias("z")).agg(((F.sum("s_nationkey") % 41 - 20) / 10.0).alias("depth"))
    return psf.valid_window(planes, N, 61, 4, planes.agg(F.max(F.abs("depth"))).scalar())


@query("psf_window_crop", sql("wp", "SELECT z, b, a, dv, du, h FROM p WHERE abs(dv) <= 2 - z % 2 AND abs(du) <= 2 - z % 2"))
def _(spark, sf_dir):
    meta = fx.axis(spark, "z", 0, 2).select("z", F.lit(7).alias("s"), (2 + F.col("z") % 2).alias("ca_lo"), (6 - F.col("z") % 2).alias("ca_hi"))
    return psf.crop(fx.part_psf(spark, sf_dir), meta)


# Projection and deconvolution


@query("lenslet_phase", sql("f", "SELECT t, (y % 3)::INTEGER AS b, (x % 3)::INTEGER AS a, (y // 3)::INTEGER AS ly, (x // 3)::INTEGER AS lx, v FROM f"))
def _(spark, sf_dir):
    return images.phases(fx.frame(spark, sf_dir), N)


@query("backproject", sql("f", "p", "q", "bp", "SELECT z, t, y, x, v FROM bp"))
def _(spark, sf_dir):
    return back(spark, sf_dir)


@query("forward_project", sql("f", "p", "q", "bp", forward_sql("bp", "fp"), "SELECT t, y, x, v FROM fp"))
def _(spark, sf_dir):
    return projection.forward(back(spark, sf_dir), fx.psf(spark), N, H, W)


@query("plane_window", sql("f", "p", "q", "bp", "SELECT (z - 1)::INTEGER AS z, t, y, x, v FROM bp WHERE z BETWEEN 1 AND 2"))
def _(spark, sf_dir):
    return projection.window(back(spark, sf_dir), 1, 2)


@query("rl_iter1", sql("f", "p", "q", "bp", *step_sql("bp", 1), "SELECT z, t, y, x, round(v, 6) AS v FROM x1"))
def _(spark, sf_dir):
    return deconvolution.deconvolve(fx.frame(spark, sf_dir), fx.psf(spark), N, H, W, 1).withColumn("v", F.round("v", 6))


@query("rl_iter2", sql("f", "p", "q", "bp", *step_sql("bp", 1), *step_sql("x1", 2), "SELECT z, t, y, x, round(v, 5) AS v FROM x2"))
def _(spark, sf_dir):
    return deconvolution.deconvolve(fx.frame(spark, sf_dir), fx.psf(spark), N, H, W, 2).withColumn("v", F.round("v", 5))


ERROR = f"er AS (SELECT f.t, f.y, f.x, {ratio_sql('f.v', 'coalesce(h.v, 0)')} AS v FROM f LEFT JOIN hx h USING (t, y, x))"


@query("rl_standard", sql("f", "p", "q", "bp", forward_sql("bp", "hx"), ERROR, backward_sql("er", "eb"), "SELECT b.z, b.t, b.y, b.x, round(b.v * coalesce(e.v, 0), 6) AS v FROM bp b LEFT JOIN eb e USING (z, t, y, x)"))
def _(spark, sf_dir):
    return deconvolution.deconvolve(fx.frame(spark, sf_dir), fx.psf(spark), N, H, W, 1, standard=True).withColumn("v", F.round("v", 6))


@query(
    "rl_trust_mask",
    sql(
        PARTS["f"].replace("f AS", "f0 AS"), "m", "f AS (SELECT t, y, x, v * m AS v FROM f0 JOIN m USING (y, x))", "p", "q", "bp", forward_sql("bp", "hx"), ERROR, backward_sql("er", "eb"),
        "lit AS (SELECT 0 AS t, y, x, 1.0::DOUBLE AS v FROM m WHERE m <> 0)", backward_sql("lit", "tb"),
        "SELECT b.z, b.t, b.y, b.x, round(b.v * (coalesce(e.v, 0) / k.v), 6) AS v FROM bp b LEFT JOIN eb e USING (z, t, y, x) JOIN (SELECT z, y, x, v FROM tb) k USING (z, y, x)",
    ),
)
def _(spark, sf_dir):
    mask = fx.mask(spark)
    frame = fx.frame(spark, sf_dir).join(mask, ["y", "x"]).select("t", "y", "x", (F.col("v") * F.col("m")).alias("v"))
    return deconvolution.deconvolve(frame, fx.psf(spark), N, H, W, 1, standard=True, mask=mask).withColumn("v", F.round("v", 6))


@query(
    "partial_reconstruct",
    sql("f", "p", "q", "bp", "rest AS (SELECT * FROM bp WHERE z NOT BETWEEN 1 AND 1)", forward_sql("rest", "hr"),
        "SELECT f.t, f.y, f.x, greatest(f.v * 5000 - coalesce(h.v, 0), 1.0) AS v FROM f LEFT JOIN hr h USING (t, y, x) WHERE f.y BETWEEN 3 AND 26 AND f.x BETWEEN 3 AND 41"),
)
def _(spark, sf_dir):
    frame = fx.frame(spark, sf_dir).withColumn("v", F.col("v") * 5000)
    return deconvolution.residual(back(spark, sf_dir), frame, fx.psf(spark), N, H, W, 1, 1, (3, 27, 3, 42), 1.0)


@query("count_batches", "SELECT (doc_id // 32)::INTEGER AS batch, count(*) AS number, min(doc_id) AS first, max(doc_id) AS last FROM documents GROUP BY 1")
def _(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("t"))
    return deconvolution.batches(docs, 32).groupBy("batch").agg(F.count("*").alias("number"), F.min("t").alias("first"), F.max("t").alias("last"))


# Frames and volumes


@query("mip_z", sql("f", "p", "q", "bp", "SELECT t, y, x, max(v) AS v FROM bp GROUP BY ALL"))
def _(spark, sf_dir):
    return images.maximum_projection(back(spark, sf_dir), "z")


@query("mip_y", sql("f", "p", "q", "bp", "SELECT z, t, x, max(v) AS v FROM bp GROUP BY ALL"))
def _(spark, sf_dir):
    return images.maximum_projection(back(spark, sf_dir), "y")


@query("neg_energy", sql("f", "SELECT t, CASE WHEN sum(v - 500) - sum(CASE WHEN v - 500 < 1 THEN v - 500 ELSE 0 END) = 0 THEN 0 ELSE round(-sum(CASE WHEN v - 500 < 1 THEN v - 500 ELSE 0 END) / (sum(v - 500) - sum(CASE WHEN v - 500 < 1 THEN v - 500 ELSE 0 END)), 9) END AS share, min(v - 500) AS least, max(v - 500) AS most FROM f GROUP BY t"))
def _(spark, sf_dir):
    return images.negative_energy(fx.frame(spark, sf_dir).withColumn("v", F.col("v") - 500), 1.0).withColumn("share", F.round("share", 9))


@query("stability_totals", sql("f", "p", "q", "bp", "SELECT t, max(v) AS most, sum(v) AS total FROM bp GROUP BY t"))
def _(spark, sf_dir):
    return images.totals(back(spark, sf_dir))


@query("relative_floor", sql("f", "SELECT t, y, x, greatest(v, 0.25 * (SELECT max(v) FROM f)) AS v FROM f"))
def _(spark, sf_dir):
    return images.floor_relative(fx.frame(spark, sf_dir), 0.25)


@query("plane_share", sql("f", "p", "q", "bp", "SELECT z, t, y, x, v, round(v / max(v) OVER (PARTITION BY z), 12) AS share FROM bp"))
def _(spark, sf_dir):
    return images.plane_share(back(spark, sf_dir)).withColumn("share", F.round("share", 12))


@query(
    "max_abs_diff",
    sql("f", "d AS (SELECT a.y, a.x, abs(a.v - b.v) AS d FROM f a JOIN f b ON a.y = b.y AND a.x = b.x AND a.t = 0 AND b.t = 1)", "SELECT d AS most, y, x FROM d ORDER BY d DESC, y, x LIMIT 1"),
)
def _(spark, sf_dir):
    f = fx.frame(spark, sf_dir)
    return images.largest_difference(f.where("t = 0"), f.where("t = 1"), ["y", "x"])


@query("lenslet_crop", sql("f", "SELECT t, (y - 3)::INTEGER AS y, (x - 6)::INTEGER AS x, v FROM f WHERE y BETWEEN 3 AND 23 AND x BETWEEN 6 AND 41"))
def _(spark, sf_dir):
    return images.crop_lenslets(fx.frame(spark, sf_dir), N, H, W, 2, 1, 1, 2)


@query("centre_crop", sql("f", "SELECT t, (y - 7)::INTEGER AS y, (x - 12)::INTEGER AS x, v FROM f WHERE y BETWEEN 7 AND 21 AND x BETWEEN 12 AND 31"))
def _(spark, sf_dir):
    return images.centred(fx.frame(spark, sf_dir), (H, W), (15, 20))


@query("tile_frames", sql("f", "SELECT t, (y + 30 * i)::INTEGER AS y, (x + 45 * j)::INTEGER AS x, v FROM f, range(2) a(i), range(3) b(j)"))
def _(spark, sf_dir):
    return images.tile(fx.frame(spark, sf_dir), 2, 3, H, W)


@query("zero_shift", sql("f", "SELECT t, (y + 4)::INTEGER AS y, (x - 7)::INTEGER AS x, v FROM f WHERE y + 4 BETWEEN 0 AND 29 AND x - 7 BETWEEN 0 AND 44"))
def _(spark, sf_dir):
    return images.shift(fx.frame(spark, sf_dir), 4, -7, H, W)


@query("circular_shift", sql("f", "s AS (SELECT t, y, (x + 47) % 45 AS x, v * 0.75 AS v FROM f UNION ALL SELECT t, y, (x + 48) % 45, v * 0.25 FROM f)", "SELECT t, y, x::INTEGER AS x, sum(v) AS v FROM s GROUP BY ALL"))
def _(spark, sf_dir):
    return images.roll(fx.frame(spark, sf_dir), 2.25, W).withColumn("x", F.col("x").cast("int")).select("t", "y", "x", "v")


@query("rotate_quarter", sql("f", "SELECT t, (29 - x)::INTEGER AS y, y AS x, v FROM f WHERE x < 30"))
def _(spark, sf_dir):
    return images.rotate(fx.frame(spark, sf_dir).where("x < 30"), 1, 30).select("t", "y", "x", "v")


@query(
    "fill_from_turns",
    sql("f", "s AS (SELECT t, y, x, CASE WHEN y < 15 AND x < 15 THEN v ELSE 0 END AS v FROM f WHERE x < 30)", "SELECT t, y, x, coalesce(nullif(s.v, 0), nullif(a.v, 0), nullif(b.v, 0), nullif(c.v, 0), 0) AS v FROM s JOIN (SELECT t, x AS y, (29 - y)::INTEGER AS x, v FROM s) a USING (t, y, x) JOIN (SELECT t, (29 - y)::INTEGER AS y, (29 - x)::INTEGER AS x, v FROM s) b USING (t, y, x) JOIN (SELECT t, (29 - x)::INTEGER AS y, y AS x, v FROM s) c USING (t, y, x)"),
)
def _(spark, sf_dir):
    part = fx.frame(spark, sf_dir).where("x < 30").withColumn("v", F.when((F.col("y") < 15) & (F.col("x") < 15), F.col("v")).otherwise(0.0))
    return images.fill_from_turns(part, 30)


@query("pixel_bin", sql("f", "SELECT t, (y // 3)::INTEGER AS y, (x // 3)::INTEGER AS x, sum(v) AS v FROM (SELECT t, y - 1 AS y, x AS x, v FROM f WHERE y BETWEEN 1 AND 27 AND x BETWEEN 0 AND 44) GROUP BY ALL"))
def _(spark, sf_dir):
    return images.bin_pixels(fx.frame(spark, sf_dir), 3, H, W)


@query("zero_border", sql("f", "SELECT t, y, x, CASE WHEN y BETWEEN 3 AND 26 AND x BETWEEN 3 AND 41 THEN v ELSE 0 END AS v FROM f"))
def _(spark, sf_dir):
    return images.zero_border(fx.frame(spark, sf_dir), 3, H, W)


@query("half_even", "SELECT orderkey, half, round_even(half, 0) AS v FROM (SELECT l_orderkey AS orderkey, l_linenumber, l_quantity::DOUBLE / 2 AS half FROM lineitem)")
def _(spark, sf_dir):
    half = fx.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("orderkey"), (F.col("l_quantity").cast("double") / 2).alias("half"))
    return half.withColumn("v", images.half_even(F.col("half")))


@query(
    "ssim",
    sql("f", "b AS (SELECT a.y, a.x, a.v AS l, c.v AS r FROM f a JOIN f c ON a.t = 0 AND c.t = 1 AND a.y = c.y AND a.x = c.x)",
        "w AS (SELECT p.y, p.x, avg(q.l) AS ml, avg(q.r) AS mr, sum(q.l * q.l) AS ll, sum(q.r * q.r) AS rr, sum(q.l * q.r) AS lr FROM b p JOIN b q ON q.y BETWEEN p.y AND p.y + 6 AND q.x BETWEEN p.x AND p.x + 6 WHERE p.y <= 23 AND p.x <= 38 GROUP BY ALL)",
        "SELECT 0 AS t, round(avg((2 * ml * mr + 42.9483) * (2 * (lr - 49 * ml * mr) / 48 + 386.5347) / ((ml * ml + mr * mr + 42.9483) * ((ll - 49 * ml * ml) / 48 + (rr - 49 * mr * mr) / 48 + 386.5347))), 6) AS ssim FROM w".replace("42.9483", repr((0.01 * 1000) ** 2)).replace("386.5347", repr((0.03 * 1000) ** 2))),
)
def _(spark, sf_dir):
    f = fx.frame(spark, sf_dir)
    return images.similarity(f.where("t = 0"), f.where("t = 1").withColumn("t", F.lit(0)), H, W, 7, 1000.0).withColumn("ssim", F.round("ssim", 6))


YS, XS = rectify.positions(14, 3.3, N, H), rectify.positions(20, 3.3, N, W)


def corner_sql(points: list[float], size: int, name: str) -> str:
    rows = []
    for k, p in enumerate(points):
        low = min(int(p), size - 2)
        rows += [f"({low}, {k}, {1 - (p - low)!r}::DOUBLE)", f"({low + 1}, {k}, {p - low!r}::DOUBLE)"]
    return f"{name}(c, s, w) AS (VALUES {', '.join(rows)})"


@query("bilinear_rectify", sql("f", corner_sql(YS, H, "cy"), corner_sql(XS, W, "cx"), "SELECT f.t, cy.s AS y, cx.s AS x, round(sum(f.v * cy.w * cx.w), 6) AS v FROM f JOIN cy ON cy.c = f.y JOIN cx ON cx.c = f.x GROUP BY ALL"))
def _(spark, sf_dir):
    return rectify.rectify(fx.frame(spark, sf_dir), 20, 14, 3.3, N, H, W).withColumn("v", F.round("v", 6))


# Flow


CUSTOMERS = "g AS (SELECT c_custkey::INTEGER AS k, (c_custkey * 7 % 46)::INTEGER AS cx, c_nationkey::INTEGER AS cy FROM customer)"
GIVEN = "fl AS (SELECT g.k, cx, cy, s.dx, s.dy FROM g JOIN (SELECT (c_custkey % 16)::INTEGER AS k, sum(c_nationkey)::DOUBLE AS dx, count(*)::DOUBLE AS dy FROM customer GROUP BY 1) s ON s.k = g.k)"
GRID = "g AS (SELECT (row_number() OVER (ORDER BY i, j) - 1)::INTEGER AS k, (i * 9)::INTEGER AS cx, (j * 9)::INTEGER AS cy FROM range(1, 5) a(i), range(1, 4) b(j) WHERE i * 9 < 45 AND j * 9 < 30)"
FLOW = "fl AS (SELECT k, cx, cy, 0.0::DOUBLE AS dx, ((22.5 * 22.5 - (cx - 22.5) * (cx - 22.5)) / (22.5 * 22.5) * 7.0)::DOUBLE AS dy FROM g)"


def points(spark: SparkSession) -> DataFrame:
    return flow.control_points(spark, H, W, 9, inner=True)


@query("flow_profile", sql(CUSTOMERS, FLOW, "SELECT k, cx, cy, dx, round(dy, 9) AS dy, round(sqrt(dx * dx + dy * dy), 9) AS speed FROM fl"))
def _(spark, sf_dir):
    at = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("int").alias("k"), (F.col("c_custkey") * 7 % 46).cast("int").alias("cx"), F.col("c_nationkey").alias("cy"))
    return flow.speed(flow.parabolic_flow(at, W)).withColumns({c: F.round(c, 9) for c in ("dy", "speed")})


def given_flow(spark: SparkSession, sf_dir: str, at: DataFrame) -> DataFrame:
    """Control points with the motion that customers say."""
    moves = fx.table(spark, sf_dir, "customer").groupBy((F.col("c_custkey") % 16).cast("int").alias("k")).agg(F.sum("c_nationkey").cast("double").alias("dx"), F.count("*").cast("double").alias("dy"))
    return at.join(moves, "k").select("k", "cx", "cy", "dx", "dy")


@query(
    "flow_zero_edges",
    sql(GRID, GIVEN, "al AS (SELECT (row_number() OVER (ORDER BY i, j) - 1)::INTEGER AS k, (i * 9)::INTEGER AS cx, (j * 9)::INTEGER AS cy FROM range(6) a(i), range(4) b(j))", "SELECT al.k, al.cx, al.cy, coalesce(fl.dx, 0.0::DOUBLE) AS dx, coalesce(fl.dy, 0.0::DOUBLE) AS dy FROM al LEFT JOIN fl USING (cx, cy)"),
)
def _(spark, sf_dir):
    return flow.pad_edges(flow.control_points(spark, H, W, 9), given_flow(spark, sf_dir, points(spark)))


@query("lit_vectors", sql("f", GRID, FLOW, "SELECT k, cx, cy, dx, round(dy, 9) AS dy, sum(v) AS light FROM fl JOIN f ON f.t = 0 AND f.y >= cy - 4 AND f.y < cy + 4 AND f.x >= cx - 4 AND f.x < cx + 4 GROUP BY ALL HAVING sum(v) > 100"))
def _(spark, sf_dir):
    return flow.lit_vectors(fx.frame(spark, sf_dir), flow.parabolic_flow(points(spark), W), 9, 100.0).withColumn("dy", F.round("dy", 9))


@query(
    "sad_match",
    sql("f", GRID,
        "s AS (SELECT k, cx, cy, oy, ox, sum(abs(a.v - b.v)) AS sad FROM (SELECT * FROM g WHERE cy BETWEEN 9 AND 18 AND cx BETWEEN 9 AND 36) g, range(11) p(oy), range(11) q(ox), f a, f b WHERE a.t = 0 AND b.t = 1 AND a.y BETWEEN cy - 4 AND cy + 3 AND a.x BETWEEN cx - 4 AND cx + 3 AND b.y = a.y + oy - 5 AND b.x = a.x + ox - 5 GROUP BY ALL)",
        "SELECT k, cx, cy, (5 - ox)::DOUBLE AS dx, (5 - oy)::DOUBLE AS dy, sad FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY sad, oy, ox) AS r FROM s) WHERE r = 1"),
)
def _(spark, sf_dir):
    inside = points(spark).where(F.col("cy").between(9, 18) & F.col("cx").between(9, 36))
    return flow.match_windows(fx.frame(spark, sf_dir), inside, 9)


@query("uniform_warp", sql("f", "SELECT t, y, x, v FROM (SELECT o.t, o.y, o.x, 0.5 * a.v + 0.5 * b.v AS v FROM f o JOIN f a ON a.t = o.t AND a.y = greatest(o.y - 2, 0) AND a.x = greatest(least(floor(o.x - 1.5), 44), 0) JOIN f b ON b.t = o.t AND b.y = greatest(o.y - 2, 0) AND b.x = greatest(least(floor(o.x - 1.5) + 1, 44), 0))"))
def _(spark, sf_dir):
    return flow.warp_uniform(fx.frame(spark, sf_dir), 2.0, 1.5, H, W).select("t", "y", "x", "v")


@query(
    "ssd_score",
    sql("f", "c AS (SELECT t, y, x, CASE WHEN t = 0 THEN v * 2 ELSE v END AS v FROM f)", "SELECT round(sum(pow(c.v / 2 - f.v, 2)), 3) AS ssd FROM c JOIN f USING (t, y, x) WHERE y BETWEEN 1 AND 28 AND x BETWEEN 1 AND 43"),
)
def _(spark, sf_dir):
    f = fx.frame(spark, sf_dir)
    return flow.score(f.withColumn("v", F.when(F.col("t") == 0, F.col("v") * 2).otherwise(F.col("v"))), f, H, W).withColumn("ssd", F.round("ssd", 3))


@query("pair_energy", sql("f", "SELECT t::INTEGER AS t, sum(v) / 2 AS total FROM (SELECT y, x, v FROM f WHERE t = 0), range(2) r(t) GROUP BY t"))
def _(spark, sf_dir):
    one = fx.frame(spark, sf_dir).where("t = 0").select(F.lit(0).alias("z"), "y", "x", "v")
    return flow.pair(one, 0.0, 0.0, H, W).groupBy("t").agg(F.sum("v").alias("total"))


@query(
    "pair_backproject",
    sql("f", "p", "q", "bp", "SELECT z, y, x, sum(v) / 2 AS v FROM bp GROUP BY ALL"),
)
def _(spark, sf_dir):
    return flow.pair_backward(fx.frame(spark, sf_dir), fx.psf(spark), N, H, W, 0.0, 0.0)


def pair_sql(source: str, name: str) -> str:
    """The two objects of one (z, y, x, v), the second moved by one row and two columns."""
    moved = f"SELECT o.z, 1 AS t, o.y, o.x, a.v / 2 AS v FROM {source} o JOIN {source} a ON a.z = o.z AND a.y = greatest(o.y - 1, 0) AND a.x = greatest(o.x - 2, 0)"
    return f"{name} AS (SELECT z, 0 AS t, y, x, v / 2 AS v FROM {source} UNION ALL {moved})"


def pair_back_sql(source: str, name: str) -> list[str]:
    """One object of a pair of frames: the second's projection is moved back, then the mean."""
    moved = f"SELECT o.z, o.y, o.x, a.v FROM {name}_b o JOIN {name}_b a ON o.t = 1 AND a.t = 1 AND a.z = o.z AND a.y = least(o.y + 1, 29) AND a.x = least(o.x + 2, 44)"
    return [backward_sql(source, f"{name}_b"), f"{name} AS (SELECT z, y, x, sum(v) / 2 AS v FROM (SELECT z, y, x, v FROM {name}_b WHERE t = 0 UNION ALL {moved}) GROUP BY ALL)"]


@query(
    "pair_deconvolve",
    sql("f", "p", "q", *pair_back_sql("f", "ps"), pair_sql("ps", "pp"), forward_sql("pp", "pf"), *pair_back_sql("pf", "pd"), f"SELECT s.z, s.y, s.x, round(s.v * ({ratio_sql('s.v', 'd.v')}), 5) AS v FROM ps s JOIN pd d USING (z, y, x)"),
)
def _(spark, sf_dir):
    return flow.deconvolve_pair(fx.frame(spark, sf_dir), fx.psf(spark), N, H, W, 1, 1.0, 2.0).withColumn("v", F.round("v", 5))


# Traces, scaling, histories


@query(
    "thread_summary",
    sql("log", "s AS (SELECT worktype, count(*) AS items, sum(t_end - t_start) AS busy, sum(m0 + m1) AS waited, max(t_end) - min(t_start) AS wall FROM log GROUP BY GROUPING SETS ((worktype), ()))",
        "SELECT coalesce(worktype, -1)::INTEGER AS worktype, items, round(busy, 6) AS busy, round(waited, 6) AS waited, round(wall, 6) AS wall, round(busy / wall, 8) AS parallelism FROM s"),
)
def _(spark, sf_dir):
    out = trace.summary(fx.thread_log(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c in ("busy", "waited", "wall")} | {"parallelism": F.round("parallelism", 8)})


@query("mutex_distance", "SELECT event_id, (user_id % 12)::BIGINT AS mutex, coalesce(event_id - lag(event_id) OVER (PARTITION BY user_id % 12 ORDER BY event_id), 0)::BIGINT AS distance FROM events")
def _(spark, sf_dir):
    taken = fx.table(spark, sf_dir, "events").select(F.col("event_id").cast("long").alias("event_id"), (F.col("user_id") % 12).cast("long").alias("mutex"))
    return trace.reuse_distance(taken, "event_id", "mutex")


@query("efficiency", sql("sc", "SELECT host, threads, wall, round(first_value(wall * threads) OVER w / (wall * threads), 9) AS efficiency, round(last_value(wall) OVER w / first_value(wall) OVER w, 9) AS fraction FROM sc WINDOW w AS (PARTITION BY host ORDER BY threads ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"))
def _(spark, sf_dir):
    return trace.efficiency(fx.scaling(spark, sf_dir)).withColumns({c: F.round(c, 9) for c in ("efficiency", "fraction")})


@query("run_time_excess", sql("sc", "SELECT host, threads, round(wall / (first_value(wall) OVER w * first_value(threads) OVER w / threads), 9) AS excess FROM sc WINDOW w AS (PARTITION BY host ORDER BY threads)"))
def _(spark, sf_dir):
    return trace.excess(fx.scaling(spark, sf_dir)).withColumn("excess", F.round("excess", 9))


EACH = "ea AS (SELECT iter, k::INTEGER AS k, shift[k + 1] AS value FROM tr, range(2) r(k))"


@query("changed_elements", sql("tr", EACH, "SELECT iter, k, value FROM (SELECT *, lag(value) OVER (PARTITION BY k ORDER BY iter) AS b FROM ea) WHERE b IS NOT NULL AND value <> b"))
def _(spark, sf_dir):
    return trace.changed(fx.trials(spark, sf_dir))


@query(
    "run_segments",
    sql("tr", EACH, "fr AS (SELECT *, CASE WHEN value = lag(value) OVER (PARTITION BY k ORDER BY iter) THEN 0 ELSE 1 END AS fresh FROM ea)", "ru AS (SELECT *, sum(fresh) OVER (PARTITION BY k ORDER BY iter) AS run FROM fr)",
        "SELECT k, any_value(value) AS value, min(iter) AS first, max(iter) AS last, count(*) AS number FROM ru GROUP BY k, run HAVING count(*) > 2"),
)
def _(spark, sf_dir):
    return trace.runs(fx.trials(spark, sf_dir))


@query("best_so_far", sql("tr", "SELECT iter, score, min(score) OVER w AS best, first_value(score) OVER w - min(score) OVER w AS improvement FROM tr WINDOW w AS (ORDER BY iter ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"))
def _(spark, sf_dir):
    return trace.best_so_far(fx.trials(spark, sf_dir))


@query("best_trial", sql("tr", "SELECT score, shift[1] AS dy, shift[2] AS dx FROM tr ORDER BY score, iter LIMIT 1"))
def _(spark, sf_dir):
    return trace.best_trial(fx.trials(spark, sf_dir)).select("score", F.col("shift")[0].alias("dy"), F.col("shift")[1].alias("dx"))


@query("high_water", sql("log", "SELECT thread, item, t_start, max(memory) OVER (PARTITION BY thread ORDER BY t_start, item ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS high FROM log"))
def _(spark, sf_dir):
    return trace.high_water(fx.thread_log(spark, sf_dir))


@query(
    "buffer_ids",
    sql("log", "a AS (SELECT DISTINCT unnest([dest, src1, src2]) AS address FROM log)", "n AS (SELECT address, row_number() OVER (ORDER BY address)::INTEGER AS id FROM a WHERE address <> 0)",
        "SELECT item, coalesce(d.id, 0) AS dest_id, coalesce(s.id, 0) AS src1_id, coalesce(t.id, 0) AS src2_id FROM log LEFT JOIN n d ON d.address = dest LEFT JOIN n s ON s.address = src1 LEFT JOIN n t ON t.address = src2"),
)
def _(spark, sf_dir):
    return trace.buffer_ids(fx.thread_log(spark, sf_dir))


@query("first_seen", sql("log", "SELECT dest, min(item) AS first FROM log GROUP BY dest"))
def _(spark, sf_dir):
    return trace.first_seen(fx.thread_log(spark, sf_dir), "dest", "item")


@query("duration_hist", "SELECT least(floor((value - a) / ((b - a) / 50)), 49)::INTEGER AS bin, count(*) AS number FROM events, (SELECT min(value) AS a, max(value) AS b FROM events) GROUP BY 1")
def _(spark, sf_dir):
    return trace.histogram(fx.table(spark, sf_dir, "events"), "value", 50)


@query("polyfit", sql("bt", "SELECT kind, round(regr_slope(seconds, batch), 6) AS gradient, round(regr_intercept(seconds, batch), 6) AS baseline FROM bt GROUP BY kind"))
def _(spark, sf_dir):
    return trace.fit_line(fx.batch_times(spark, sf_dir), "kind", "batch", "seconds").withColumns({c: F.round(c, 6) for c in ("gradient", "baseline")})


@query("time_per_image", sql("bt", "SELECT kind, batch, seconds, round(seconds / batch, 9) AS each FROM bt"))
def _(spark, sf_dir):
    return trace.per_image(fx.batch_times(spark, sf_dir)).withColumn("each", F.round("each", 9))


@query("work_order", "SELECT seq, row_number() OVER (ORDER BY root_order, root_plane // 3, depth, plane // 3, seq) AS place FROM (SELECT event_id::BIGINT AS seq, user_id % 3 AS root_order, event_id % 9 AS root_plane, event_id % 4 AS depth, event_id % 11 AS plane FROM events)")
def _(spark, sf_dir):
    return _places(fx.table(spark, sf_dir, "events"))


def _places(events):
    items = events.select(
        F.col("event_id").cast("long").alias("seq"), (F.col("user_id") % 3).alias("root_order"), (F.col("event_id") % 9).alias("root_plane"), (F.col("event_id") % 4).alias("depth"), (F.col("event_id") % 11).alias("plane")
    )
    return trace.work_places(items, 4, 2).select("seq", "place")


@query("compare_runs", sql("log", "SELECT worktype, round(avg(t_end - t_start), 6) AS left, round(avg((t_end - t_start) * 1.5), 6) AS right, round(avg((t_end - t_start) * 1.5) / avg(t_end - t_start), 6) AS ratio FROM log GROUP BY worktype"))
def _(spark, sf_dir):
    log = fx.thread_log(spark, sf_dir)
    slow = log.withColumn("t_end", F.col("t_start") + (F.col("t_end") - F.col("t_start")) * 1.5)
    return trace.compare_runs(log, slow).withColumns({c: F.round(c, 6) for c in ("left", "right", "ratio")})


@query("run_span", sql("log", "SELECT worktype, (max(thread) + 1)::INTEGER AS threads, round(max(t_end) - min(t_start), 6) AS wall FROM log GROUP BY worktype"))
def _(spark, sf_dir):
    return trace.span(fx.thread_log(spark, sf_dir), "worktype").withColumn("wall", F.round("wall", 6))


@query("thread_lanes", sql("log", "SELECT worktype, thread, count(*) AS items, round(sum(t_end - t_start), 6) AS busy, round(sum(CASE WHEN m0 + m1 > 5e-6 THEN m0 + m1 ELSE 0 END), 6) AS waited, count(DISTINCT dest) AS buffers FROM log GROUP BY ALL"))
def _(spark, sf_dir):
    return trace.thread_lanes(fx.thread_log(spark, sf_dir)).withColumns({"busy": F.round("busy", 6), "waited": F.round("waited", 6)})


# Names and numbers


def _pattern(k: int) -> str:
    number = "[-+]?[0-9]*\\.?[0-9]+(?:[eE][-+]?[0-9]+)?"
    return "(?i:fdnormPSFmatrix_|reducedPSFmatrix_|reducedBuggyPSFmatrix_)" + "".join(label + (f"({number})" if i == k else number) for i, (label, _, _) in enumerate(names.PARTS)) + "\\.mat$"


@query(
    "parse_psf_name",
    "WITH " + PARTS["na"] + " SELECT path, regexp_matches(path, '(?i)(^|/)fdnormPSFmatrix_') AS normalised, regexp_matches(path, '(?i)(^|/)reducedBuggyPSFmatrix_') AS buggy, "
    + ", ".join(f"round(regexp_extract(path, '{_pattern(k)}', 1)::DOUBLE * {unit!r}, 15) AS {column}" if column != "nnum" else f"regexp_extract(path, '{_pattern(k)}', 1)::INTEGER AS nnum" for k, (_, column, unit) in enumerate(names.PARTS))
    + " FROM na",
)
def _(spark, sf_dir):
    out = names.parse_psf_names(fx.psf_names(spark, sf_dir))
    return out.withColumns({c: F.round(c, 15) for _, c, _ in names.PARTS if c != "nnum"})


@query("best_factor", "SELECT p_partkey AS n, CASE WHEN p_partkey = 0 THEN 1 ELSE list_max(list_filter(range(1, 65), lambda k: p_partkey % k = 0)) END::BIGINT AS factor FROM part")
def _(spark, sf_dir):
    return fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("n"), numbers.largest_divisor(F.col("p_partkey").cast("long"), F.lit(64).cast("long")).alias("factor"))


@query("smooth_sizes", "WITH s AS (SELECT DISTINCT (pow(2, a) * pow(3, b) * pow(5, c) * pow(7, d))::BIGINT AS s FROM range(12) q(a), range(8) r(b), range(6) t(c), range(5) u(d) WHERE pow(2, a) * pow(3, b) * pow(5, c) * pow(7, d) <= 2000) SELECT p_partkey, p_partkey % 1000 + 1 AS n, (SELECT min(s) FROM s WHERE s >= p_partkey % 1000 + 1) AS size FROM part")
def _(spark, sf_dir):
    own = fx.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 1000 + 1).alias("n"))
    return own.join(numbers.smooth_table(spark, 1000), "n").select("p_partkey", "n", "size")


@query(
    "format_psf_name",
    "WITH " + PARTS["na"] + " SELECT path, regexp_replace(split_part(path, '/', -1), '^(?i)(fdnormPSFmatrix_|reducedPSFmatrix_|reducedBuggyPSFmatrix_)', 'fdnormPSFmatrix_') AS name FROM na",
)
def _(spark, sf_dir):
    parsed = names.require_generated(names.parse_psf_names(fx.psf_names(spark, sf_dir)))
    return parsed.select("path", names.psf_name(parsed).alias("name"))


@query("output_names", "WITH " + PARTS["na"] + " SELECT path, regexp_replace(path, '\\.[^./]*$', '') || '_deconvolved.tif' AS deconvolved, regexp_replace(path, '\\.[^./]*$', '') || '_N15' || regexp_extract(path, '(\\.[^.]*)$', 1) AS rectified FROM na")
def _(spark, sf_dir):
    path = F.col("path")
    return fx.psf_names(spark, sf_dir).select("path", names.deconvolved_name(path).alias("deconvolved"), names.rectified_name(path, 15).alias("rectified"))


@query("scanned_names", "SELECT c_custkey, try_cast(regexp_extract(c_name, '^Customer#([0-9]+)', 1) AS BIGINT) AS number FROM customer")
def _(spark, sf_dir):
    number = scanning.scan_columns(F.col("c_name"), "Customer#%d")[0]
    return fx.table(spark, sf_dir, "customer").select("c_custkey", number.alias("number"))


@query("traces_in_window", sql("log", "e AS (SELECT min(t_start) AS a FROM log)", "SELECT item, m0 + m1 > 1e-4 AS waited FROM log, e WHERE t_end >= a + 1000 AND t_start <= a + 500000"))
def _(spark, sf_dir):
    log = fx.thread_log(spark, sf_dir)
    begin = log.agg(F.min("t_start")).first()[0]
    return trace.in_window(log, begin + 1000, begin + 500000, 1e-4).select("item", "waited")


@query("flow_repeat_last", sql("g AS (SELECT (i * 4 + j)::INTEGER AS k, (i * 9)::INTEGER AS cx, (j * 9)::INTEGER AS cy FROM range(4) a(i), range(4) b(j))", GIVEN, "n AS (SELECT ((k // 4) * 5 + k % 4)::INTEGER AS k, cx, cy, dx, dy FROM fl UNION ALL SELECT ((k // 4) * 5 + 4)::INTEGER, cx, cy, dx + 1, dy + 1 FROM fl WHERE k % 4 = 3)", "SELECT k, cx, cy, dx, dy FROM n"))
def _(spark, sf_dir):
    square = given_flow(spark, sf_dir, flow.control_points(spark, 27, 27, 9))
    return flow.repeat_last(square, 4, 1.0)


@query("zero_planes", sql("f", "p", "q", "bp", "SELECT z, t, y, x, CASE WHEN z BETWEEN 1 AND 1 THEN 0 ELSE v END AS v FROM bp"))
def _(spark, sf_dir):
    return images.zero_planes(back(spark, sf_dir), 1, 1)


@query("camera_values", sql("f", "SELECT t, y, x, greatest(0, least(255, round_even(v / 4, 0)::INTEGER)) AS v FROM f"))
def _(spark, sf_dir):
    return rectify.quantise(fx.frame(spark, sf_dir).withColumn("v", F.col("v") / 4))


@query("naive_ssd", sql("f", "c AS (SELECT f.y, f.x, coalesce(s.v, e.v) AS v FROM f LEFT JOIN f s ON f.t = 0 AND s.t = 0 AND s.y = f.y AND s.x = f.x - 1 LEFT JOIN f e ON f.t = 0 AND e.t = 0 AND e.y = f.y AND e.x = 0 WHERE f.t = 0)", "SELECT round(sum(pow(c.v - f.v, 2)), 3) AS ssd FROM c JOIN f ON f.t = 1 AND f.y = c.y AND f.x = c.x WHERE f.y BETWEEN 1 AND 28 AND f.x BETWEEN 1 AND 43"))
def _(spark, sf_dir):
    f = fx.frame(spark, sf_dir)
    return flow.score(flow.naive_candidate(f, 0.0, 1.0, H, W), f, H, W).withColumn("ssd", F.round("ssd", 3))


@query(
    "spot_object",
    "WITH spot AS (SELECT floor((k * 0.7548776662466927 - floor(k * 0.7548776662466927)) * 30)::INTEGER AS y, floor((k * 0.5698402909980532 - floor(k * 0.5698402909980532)) * 45)::INTEGER AS x FROM (SELECT c_custkey::DOUBLE AS k FROM customer))"
    " SELECT 0 AS z, 0 AS t, (y + i)::INTEGER AS y, (x + j)::INTEGER AS x, round(sum(exp(-(i * i + j * j) / 8.0) / (2 * 3.141592653589793 * 4)), 9) AS v FROM spot, range(-6, 7) p(i), range(-6, 7) q(j)"
    " WHERE y + i BETWEEN 0 AND 29 AND x + j BETWEEN 0 AND 44 GROUP BY ALL",
)
def _(spark, sf_dir):
    return fx.spots(fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), H, W).withColumn("v", F.round("v", 9))


def mesh_sql(c: str) -> str:
    """A flow's component at a pixel: affine in the triangle of its cell of 15 by 15."""
    corner = lambda i, j: {"dy": f"((22.5 * 22.5 - ((cx + {j}) * 15 - 22.5) * ((cx + {j}) * 15 - 22.5)) / (22.5 * 22.5) * 7.0::DOUBLE)", "dx": f"((cy + {i}) * 15 * (cx + {j}) * 15 / 450.0::DOUBLE)"}[c]
    return (
        f"CASE WHEN p + q <= 1 THEN (1 - p - q) * {corner(0, 0)} + p * {corner(1, 0)} + q * {corner(0, 1)} ELSE (p + q - 1) * {corner(1, 1)} + (1 - q) * {corner(1, 0)} + (1 - p) * {corner(0, 1)} END"
    )


@query(
    "piecewise_warp",
    sql("f", "ce AS (SELECT y, x, y // 15 AS cy, x // 15 AS cx, y / 15.0::DOUBLE - y // 15 AS p, x / 15.0::DOUBLE - x // 15 AS q FROM f WHERE t = 0)",
        f"pl AS (SELECT y, x, greatest(0.0, least(29.0, y - ({mesh_sql('dy')})))::DOUBLE AS py, greatest(0.0, least(44.0, x - ({mesh_sql('dx')})))::DOUBLE AS px FROM ce)",
        "lo AS (SELECT *, least(floor(py), 28)::INTEGER AS ly, least(floor(px), 43)::INTEGER AS lx FROM pl)",
        "SELECT f.t, lo.y, lo.x, round(sum(f.v * (CASE WHEN f.y = ly THEN 1 - (py - ly) ELSE py - ly END) * (CASE WHEN f.x = lx THEN 1 - (px - lx) ELSE px - lx END)), 6) AS v FROM lo JOIN f ON f.y BETWEEN ly AND ly + 1 AND f.x BETWEEN lx AND lx + 1 GROUP BY ALL"),
)
def _(spark, sf_dir):
    moving = flow.parabolic_flow(flow.control_points(spark, H, W, 15), W).withColumn("dx", F.col("cx") * F.col("cy") / 450.0)
    return flow.warp_piecewise(fx.frame(spark, sf_dir), moving, 15, H, W).select("t", "y", "x", F.round("v", 6).alias("v"))


ONE = "f0 AS (SELECT 0 AS z, y, x, v FROM f WHERE t = 0)"


@query("pair_forward", sql("f", "p", ONE, pair_sql("f0", "pp"), forward_sql("pp", "pf"), "SELECT t, y, x, v FROM pf"))
def _(spark, sf_dir):
    one = fx.frame(spark, sf_dir).where("t = 0").select(F.lit(0).alias("z"), "y", "x", "v")
    return flow.pair_forward(one, fx.psf(spark), N, H, W, 1.0, 2.0)


VOLUME = "SELECT z::INTEGER AS z, f.t, f.y, f.x, coalesce(round(b.v, 6), 0.0) AS v FROM f CROSS JOIN range(3) r(z) LEFT JOIN {0} b USING (z, t, y, x)"


@query("block_projection", sql("f", "p", "q", "bp", VOLUME.format("bp")))
def _(spark, sf_dir):
    blocks = block.to_blocks(fx.frame(spark, sf_dir), H, W)
    out = block.to_pixels(block.backward(blocks, block.spectra(psf.transpose(fx.psf(spark), N), N, H, W)), W)
    return out.withColumn("v", F.round("v", 6))


@query("block_forward", sql("f", "p", "q", "bp", forward_sql("bp", "fp"), "SELECT f.t, f.y, f.x, coalesce(round(b.v, 4), 0.0) AS v FROM f LEFT JOIN fp b USING (t, y, x)"))
def _(spark, sf_dir):
    volume = block.to_blocks(back(spark, sf_dir), H, W)
    return block.to_pixels(block.forward(volume, block.spectra(fx.psf(spark), N, H, W)), W).withColumn("v", F.round("v", 4))


@query("block_rl", sql("f", "p", "q", "bp", *step_sql("bp", 1), VOLUME.format("x1")))
def _(spark, sf_dir):
    return deconvolution.deconvolve(fx.frame(spark, sf_dir), fx.psf(spark), N, H, W, 1, block=True).withColumn("v", F.round("v", 6))


@query(
    "block_trust_mask",
    sql(
        PARTS["f"].replace("f AS", "f0 AS"), "m", "f AS (SELECT t, y, x, v * m AS v FROM f0 JOIN m USING (y, x))", "p", "q", "bp", forward_sql("bp", "hx"), ERROR, backward_sql("er", "eb"),
        "lit AS (SELECT 0 AS t, y, x, 1.0::DOUBLE AS v FROM m WHERE m <> 0)", backward_sql("lit", "tb"),
        "SELECT b.z, b.t, b.y, b.x, round(b.v * (coalesce(e.v, 0) / k.v), 4) AS v FROM bp b LEFT JOIN eb e USING (z, t, y, x) JOIN (SELECT z, y, x, v FROM tb) k USING (z, y, x)",
    ),
)
def _(spark, sf_dir):
    mask = fx.mask(spark)
    frame = fx.frame(spark, sf_dir).join(mask, ["y", "x"]).select("t", "y", "x", (F.col("v") * F.col("m")).alias("v"))
    return deconvolution.deconvolve(frame, fx.psf(spark), N, H, W, 1, standard=True, mask=mask, block=True, backend="products").withColumn("v", F.round("v", 4))


@query("naive_scores", sql("f", "ca AS (SELECT (i * 5 + j)::INTEGER AS iter, (i - 2)::DOUBLE AS dy, (j - 2)::DOUBLE AS dx FROM range(5) a(i), range(5) b(j))",
    "SELECT iter, dy, dx, round(sum(pow(s.v - o.v, 2)), 3) AS ssd FROM ca JOIN f o ON o.t = 1 AND o.y BETWEEN 1 AND 28 AND o.x BETWEEN 1 AND 43 JOIN f s ON s.t = 0 AND s.y = greatest(0, least(29, o.y - dy)) AND s.x = greatest(0, least(44, o.x - dx)) GROUP BY ALL"))
def _(spark, sf_dir):
    candidates = fx.axis(spark, "iter", 0, 24).select("iter", (F.floor(F.col("iter") / 5) - 2).cast("double").alias("dy"), (F.col("iter") % 5 - 2).cast("double").alias("dx"))
    return flow.naive_scores(fx.frame(spark, sf_dir), candidates, H, W).withColumn("ssd", F.round("ssd", 3))


@query("joint_score", sql("f", "p", "q", *pair_back_sql("f", "ps"), pair_sql("ps", "pp"), forward_sql("pp", "pf"), *pair_back_sql("pf", "pd"),
    f"x1 AS (SELECT s.z, s.y, s.x, s.v * ({ratio_sql('s.v', 'd.v')}) AS v FROM ps s JOIN pd d USING (z, y, x))", pair_sql("x1", "xp"), forward_sql("xp", "xf"),
    "k AS (SELECT (SELECT avg(v) FROM xf WHERE t = 0) / (SELECT avg(v) FROM f WHERE t = 0) AS scale)",
    "SELECT round(sum(pow(c.v / scale - f.v, 2)), 2) AS ssd FROM xf c JOIN f USING (t, y, x), k WHERE y BETWEEN 1 AND 28 AND x BETWEEN 1 AND 43"))
def _(spark, sf_dir):
    f = fx.frame(spark, sf_dir)
    return flow.score(flow.joint_candidate(f, fx.psf(spark), N, H, W, 1, 1.0, 2.0), f, H, W).withColumn("ssd", F.round("ssd", 2))


# Flows of any mesh: four corners outside of the frame and one point inside, moved by what suppliers say

MESH = (
    "mv AS (SELECT (s_suppkey % 5)::INTEGER AS k, (sum(s_nationkey) % 9 - 4) / 4.0::DOUBLE AS dy, (count(*) % 9 - 4) / 4.0::DOUBLE AS dx FROM supplier GROUP BY 1)",
    "pt AS (SELECT k::INTEGER AS k, cx::DOUBLE AS cx, cy::DOUBLE AS cy FROM (VALUES (0, -5, -5), (1, 50, -5), (2, 50, 35), (3, -5, 35), (4, 17, 11)) v(k, cx, cy))",
    "me AS (SELECT tri, v.a, v.b, v.c, a.cx AS ax, a.cy AS ay, b.cx AS bx, b.cy AS by_, c.cx AS cx, c.cy AS cy, (b.cx - a.cx) * (c.cy - a.cy) - (c.cx - a.cx) * (b.cy - a.cy) AS whole"
    " FROM (VALUES (0, 0, 1, 4), (1, 1, 2, 4), (2, 2, 3, 4), (3, 3, 0, 4)) v(tri, a, b, c) JOIN pt a ON a.k = v.a JOIN pt b ON b.k = v.b JOIN pt c ON c.k = v.c)",
    "sh AS (SELECT y, x, tri, a, b, c, ((bx - x) * (cy - y) - (cx - x) * (by_ - y)) / whole AS wa, ((cx - x) * (ay - y) - (ax - x) * (cy - y)) / whole AS wb, ((ax - x) * (by_ - y) - (bx - x) * (ay - y)) / whole AS wc FROM f, me WHERE t = 0)",
    "wh AS (SELECT * FROM sh WHERE least(wa, wb, wc) >= -1e-12 QUALIFY row_number() OVER (PARTITION BY y, x ORDER BY tri) = 1)",
    "ai AS (SELECT m.iter, y, x, greatest(0.0, least(29.0, y - (wa * m.dy + wb * n.dy + wc * o.dy)))::DOUBLE AS py, greatest(0.0, least(44.0, x - (wa * m.dx + wb * n.dx + wc * o.dx)))::DOUBLE AS px"
    " FROM wh JOIN mo m ON m.k = wh.a JOIN mo n ON n.k = wh.b AND n.iter = m.iter JOIN mo o ON o.k = wh.c AND o.iter = m.iter)",
    "lo AS (SELECT *, least(floor(py), 28)::INTEGER AS ly, least(floor(px), 43)::INTEGER AS lx FROM ai)",
    "sa AS (SELECT lo.iter, f.t, lo.y, lo.x, sum(f.v * (CASE WHEN f.y = ly THEN 1 - (py - ly) ELSE py - ly END) * (CASE WHEN f.x = lx THEN 1 - (px - lx) ELSE px - lx END)) AS v"
    " FROM lo JOIN f ON f.y BETWEEN ly AND ly + 1 AND f.x BETWEEN lx AND lx + 1 GROUP BY ALL)",
)


def mesh_flow(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Control points with their motion, and triangles between them."""
    moves = fx.table(spark, sf_dir, "supplier").groupBy((F.col("s_suppkey") % 5).cast("int").alias("k")).agg(((F.sum("s_nationkey") % 9 - 4) / 4.0).alias("dy"), ((F.count("*") % 9 - 4) / 4.0).alias("dx"))
    points = spark.createDataFrame([(0, -5.0, -5.0), (1, 50.0, -5.0), (2, 50.0, 35.0), (3, -5.0, 35.0), (4, 17.0, 11.0)], "k int, cx double, cy double")
    return points.join(moves, "k"), motion.triangle_table(spark, [(0, 1, 4), (1, 2, 4), (2, 3, 4), (3, 0, 4)])


@query("mesh_warp", sql("f", MESH[0], "mo AS (SELECT 0 AS iter, * FROM mv)", *MESH[1:], "SELECT t, y, x, round(v, 6) AS v FROM sa"))
def _(spark, sf_dir):
    points, triangles = mesh_flow(spark, sf_dir)
    return motion.warp_mesh(fx.frame(spark, sf_dir), points, triangles, H, W).select("t", "y", "x", F.round("v", 6).alias("v"))


@query("flow_scores", sql("f", MESH[0], "mo AS (SELECT i::INTEGER AS iter, k, dy * i / 4 AS dy, dx * (i - 3) / 4 AS dx FROM mv, range(8) r(i))", *MESH[1:],
    "SELECT iter, round(sum((sa.v - f.v) * (sa.v - f.v)), 3) AS ssd FROM sa JOIN f ON sa.t = 0 AND f.t = 1 AND f.y = sa.y AND f.x = sa.x WHERE sa.y BETWEEN 1 AND 28 AND sa.x BETWEEN 1 AND 43 GROUP BY iter"))
def _(spark, sf_dir):
    points, triangles = mesh_flow(spark, sf_dir)
    tried = points.withColumn("iter", F.explode(F.sequence(F.lit(0), F.lit(7)))).select("iter", "k", (F.col("dy") * F.col("iter") / 4).alias("dy"), (F.col("dx") * (F.col("iter") - 3) / 4).alias("dx"))
    return motion.flow_scores(fx.frame(spark, sf_dir), motion.places(points, triangles, H, W), tried, H, W).withColumn("ssd", F.round("ssd", 3))


def moved_by(text: str, dy: int, dx: int) -> str:
    """The SQL of a pair that moves by one row and two columns, for another shift, with names of its own."""
    for old, new in (("o.y - 1, 0", f"o.y - {dy}, 0"), ("o.x - 2, 0", f"o.x - {dx}, 0"), ("o.y + 1, 29", f"o.y + {dy}, 29"), ("o.x + 2, 44", f"o.x + {dx}, 44")):
        text = text.replace(old, new)
    return text


def joint_parts(k: int, dy: int, dx: int) -> list[str]:
    parts = [
        *pair_back_sql("f", f"ps{k}"), pair_sql(f"ps{k}", f"pp{k}"), forward_sql(f"pp{k}", f"pf{k}"), *pair_back_sql(f"pf{k}", f"pd{k}"),
        f"x{k} AS (SELECT s.z, s.y, s.x, s.v * ({ratio_sql('s.v', 'd.v')}) AS v FROM ps{k} s JOIN pd{k} d USING (z, y, x))", pair_sql(f"x{k}", f"xp{k}"), forward_sql(f"xp{k}", f"xf{k}"),
        f"k{k} AS (SELECT (SELECT avg(v) FROM xf{k} WHERE t = 0) / (SELECT avg(v) FROM f WHERE t = 0) AS scale)",
        f"e{k} AS (SELECT {k} AS iter, {dy}::DOUBLE AS dy, {dx}::DOUBLE AS dx, round(sum(pow(c.v / scale - f.v, 2)), 2) AS ssd FROM xf{k} c JOIN f USING (t, y, x), k{k} WHERE y BETWEEN 1 AND 28 AND x BETWEEN 1 AND 43)",
    ]
    return [moved_by(p, dy, dx) for p in parts]


@query("joint_scores", sql("f", "p", "q", *joint_parts(0, 1, 2), *joint_parts(1, 0, 1), *joint_parts(2, 3, 0), "SELECT * FROM e0 UNION ALL SELECT * FROM e1 UNION ALL SELECT * FROM e2"))
def _(spark, sf_dir):
    tried = spark.createDataFrame([(0, 1.0, 2.0), (1, 0.0, 1.0), (2, 3.0, 0.0)], "iter int, dy double, dx double")
    return motion.joint_scores(fx.frame(spark, sf_dir), fx.psf(spark), N, H, W, 1, tried).withColumn("ssd", F.round("ssd", 2))


@query("pair_standard", sql("f", "p", "q", *pair_back_sql("f", "ps"), pair_sql("ps", "pp"), forward_sql("pp", "pf"), ERROR.replace("JOIN hx", "JOIN pf"), *pair_back_sql("er", "pd"), "SELECT s.z, s.y, s.x, round(s.v * d.v, 4) AS v FROM ps s JOIN pd d USING (z, y, x)"))
def _(spark, sf_dir):
    return flow.deconvolve_pair(fx.frame(spark, sf_dir), fx.psf(spark), N, H, W, 1, 1.0, 2.0, standard=True).withColumn("v", F.round("v", 4))


@query("trivial_score", sql("f",
    "o AS (SELECT 0 AS z, y, x, sum(v) / 2 AS v FROM (SELECT y, x, v FROM f WHERE t = 0 UNION ALL SELECT o.y, o.x, a.v FROM f o JOIN f a ON o.t = 0 AND a.t = 1 AND a.y = least(o.y + 1, 29) AND a.x = least(o.x + 2, 44)) GROUP BY ALL)", pair_sql("o", "c"),
    "k AS (SELECT (SELECT avg(v) FROM c WHERE t = 0) / (SELECT avg(v) FROM f WHERE t = 0) AS scale)",
    "SELECT round(sum(pow(c.v / scale - f.v, 2)), 2) AS ssd FROM c JOIN f USING (t, y, x), k WHERE y BETWEEN 1 AND 28 AND x BETWEEN 1 AND 43"))
def _(spark, sf_dir):
    f = fx.frame(spark, sf_dir)
    return flow.score(flow.trivial_candidate(f, 1.0, 2.0, H, W), f, H, W).withColumn("ssd", F.round("ssd", 2))


@query("perturbed_scores", sql("f", MESH[0], "mo AS (SELECT 0 AS iter, k, dy, dx FROM mv UNION ALL SELECT (1 + 4 * i + u)::INTEGER, k, dy + CASE WHEN u = 2 * k THEN d ELSE 0 END, dx + CASE WHEN u = 2 * k + 1 THEN d ELSE 0 END FROM mv, range(4) r(u), (VALUES (0, 7), (1, 8), (2, 12), (3, 13)) v(i, d))", *MESH[1:],
    "sc AS (SELECT iter, sum((sa.v - f.v) * (sa.v - f.v)) AS ssd FROM sa JOIN f ON sa.t = 0 AND f.t = 1 AND f.y = sa.y AND f.x = sa.x WHERE sa.y BETWEEN 1 AND 28 AND sa.x BETWEEN 1 AND 43 GROUP BY iter)",
    "SELECT ((iter - 1) % 4)::INTEGER AS unknown, [7.0::DOUBLE, 8.0, 12.0, 13.0][(iter - 1) // 4 + 1] AS step, round(((SELECT ssd FROM sc WHERE iter = 0) - ssd) / ssd, 9) AS gain FROM sc WHERE iter > 0 AND ssd < (SELECT ssd FROM sc WHERE iter = 0)"))
def _(spark, sf_dir):
    points, triangles = mesh_flow(spark, sf_dir)
    place = [float(v) for r in points.orderBy("k").select("dy", "dx").collect() for v in r]  # five control points
    found = motion.better_beside(motion.flow_judge(fx.frame(spark, sf_dir), points.select("k", "cx", "cy"), triangles, H, W), place)
    return spark.createDataFrame([(k, d, round(g, 9)) for k, d, g in found], "unknown int, step double, gain double")


@query("resource_report", sql("log",
    "ta AS (SELECT worktype, t_start, t_end, m0, m1, memory, src2, item % 97 AS written, floor(m0 * 100000)::BIGINT AS spilled, (item % 10 = 3) AS failed, floor(m1 * 100000) / 1000 AS cpu FROM log)",
    "SELECT worktype, count(*) AS tasks, count(*) FILTER (failed) AS failed, round(sum(t_end - t_start), 3) AS busy, round(sum(cpu), 3) AS cpu, round(sum(m0), 3) AS fetching, round(sum(m1), 3) AS writing, max(memory) AS memory, sum(src2)::BIGINT AS read, sum(written)::BIGINT AS written, sum(spilled)::BIGINT AS spilled FROM ta GROUP BY worktype"))
def _(spark, sf_dir):
    own = fx.thread_log(spark, sf_dir).withColumns({
        "written": F.col("item") % 97, "spilled": F.floor(F.col("m0") * 100000).cast("bigint"), "failed": F.col("item") % 10 == 3, "cpu": F.floor(F.col("m1") * 100000) / 1000,
    })
    return tasks.resources(own).withColumns({c: F.round(c, 3) for c in ("busy", "cpu", "fetching", "writing")})


# Traces: the rest


@query("scaling_by_file", sql("log", "SELECT 'events.parquet' AS file, (max(thread) + 1)::INTEGER AS threads, round(max(t_end) - min(t_start), 6) AS wall FROM log"))
def _(spark, sf_dir):
    own = tasks.file_rows(fx.table(spark, sf_dir, "events"), ["events.parquet"])
    return trace.span(fx.thread_log_of(own), "file").withColumn("wall", F.round("wall", 6))


@query("cpu_time", sql("sc", "SELECT host, threads, wall, user_s, sys_s, user_s + sys_s AS cpu FROM sc"))
def _(spark, sf_dir):
    return trace.cpu_time(fx.scaling(spark, sf_dir))


WORK = "wk AS (SELECT 'h' || (user_id % 5) AS host, event_id::BIGINT AS threads, 1 + value AS wall, 1 + floor(value * 7) AS work, value / 8 AS idle_start, value / 16 AS idle_between, value / 32 AS idle_end FROM events)"


@query("work_ratio", sql(WORK, "SELECT host, threads, round(work / first_value(work) OVER w, 9) AS work_ratio, round((idle_start + idle_between + idle_end) / (threads * wall), 12) AS dead_time, round(idle_start / (threads * wall), 12) AS dead_start FROM wk WHERE threads > 0 WINDOW w AS (PARTITION BY host ORDER BY threads)"))
def _(spark, sf_dir):
    v = F.col("value")
    stats = fx.table(spark, sf_dir, "events").where("event_id > 0").select(
        F.concat(F.lit("h"), F.col("user_id") % 5).alias("host"), F.col("event_id").cast("long").alias("threads"), (1 + v).alias("wall"), (1 + F.floor(v * 7)).cast("double").alias("work"),
        (v / 8).alias("idle_start"), (v / 16).alias("idle_between"), (v / 32).alias("idle_end"),
    )
    return trace.work_ratio(stats).withColumns({"work_ratio": F.round("work_ratio", 9), "dead_time": F.round("dead_time", 12), "dead_start": F.round("dead_start", 12)})


@query("throughput", "SELECT (user_id % 5)::INTEGER AS kind, round(avg(event_id / (1 + floor(value))), 6) AS rate, round(avg(event_id) / avg(1 + floor(value)), 6) AS gradient FROM events GROUP BY 1")
def _(spark, sf_dir):
    each = fx.table(spark, sf_dir, "events").select((F.col("user_id") % 5).cast("int").alias("kind"), F.col("event_id").cast("double").alias("n"), (1 + F.floor("value")).cast("double").alias("s"))
    return trace.throughput(each, "kind", "n", "s").withColumns({"rate": F.round("rate", 6), "gradient": F.round("gradient", 6)})


@query(
    "best_setting",
    "WITH e AS (SELECT (user_id % 16)::INTEGER AS setting, avg(floor(value)) AS mean, arg_min(floor(value), event_id) AS once FROM events GROUP BY 1), b AS (SELECT min(mean) AS m FROM e),"
    " j AS (SELECT setting, CASE WHEN once > 1.5 * m THEN once ELSE mean END AS seconds FROM e, b) SELECT setting, round(seconds, 9) AS seconds FROM j ORDER BY j.seconds, setting LIMIT 1",
)
def _(spark, sf_dir):
    tries = fx.table(spark, sf_dir, "events").select((F.col("user_id") % 16).cast("int").alias("setting"), "event_id", F.floor("value").cast("double").alias("seconds"))
    return trace.best_setting(tries, "setting", "event_id", "seconds").withColumn("seconds", F.round("seconds", 9))


@query("tally", "SELECT coalesce(worktype, -1)::INTEGER AS worktype, sum(CASE WHEN value < 500 THEN 1 ELSE 0 END)::BIGINT AS passed, count(*) AS total FROM (SELECT (event_id % 4)::INTEGER AS worktype, value FROM events) GROUP BY GROUPING SETS ((worktype), ())")
def _(spark, sf_dir):
    return trace.tally(fx.table(spark, sf_dir, "events").select((F.col("event_id") % 4).cast("int").alias("worktype"), (F.col("value") < 500).alias("passed")), "worktype")


@query("earliest_accesses", sql("log", "SELECT item, dest, t_start FROM log ORDER BY t_start, item LIMIT 100"))
def _(spark, sf_dir):
    return trace.earliest(fx.thread_log(spark, sf_dir), 100).select("item", "dest", "t_start")


@query("costliest", sql("log", "SELECT dest, count(*) AS calls, round(sum(t_end - t_start), 4) AS cumulative FROM log GROUP BY dest ORDER BY sum(t_end - t_start) DESC, dest LIMIT 40"))
def _(spark, sf_dir):
    return trace.costliest(fx.thread_log(spark, sf_dir), "dest").withColumn("cumulative", F.round("cumulative", 4))


@query("argsort", "SELECT event_id, row_number() OVER (ORDER BY value, event_id) - 1 AS place FROM events")
def _(spark, sf_dir):
    return trace.argsort(fx.table(spark, sf_dir, "events"), "value", "event_id").select("event_id", "place")


@query("compare_in_order", sql("log", "o AS (SELECT row_number() OVER (ORDER BY t_start, item) - 1 AS place, t_end - t_start AS d FROM log)", "SELECT place, round(d, 6) AS left, round(d * 1.5, 6) AS right, CASE WHEN d <> 0 THEN 1.5::DOUBLE END AS ratio FROM o"))
def _(spark, sf_dir):
    log = fx.thread_log(spark, sf_dir)
    slow = log.withColumn("t_end", F.col("t_start") + (F.col("t_end") - F.col("t_start")) * 1.5)
    return trace.compare_in_order(log, slow).withColumns({"left": F.round("left", 6), "right": F.round("right", 6), "ratio": F.round("ratio", 2)})


@query("bright_points", sql("f", "SELECT t, y, x, v FROM f WHERE v > 100"))
def _(spark, sf_dir):
    return trace.above(fx.frame(spark, sf_dir), "v", 100.0)


@query("cache_keys", sql("wp", "SELECT DISTINCT z || ',' || b || ',' || a AS key FROM p"))
def _(spark, sf_dir):
    return fx.part_psf(spark, sf_dir).select(trace.cache_key(F.col("z"), F.col("b"), F.col("a")).alias("key")).distinct()


@query("appended_batches", sql("f", "p", "q", "bp", "SELECT z, t, y, x, v FROM bp"))
def _(spark, sf_dir):
    frame, turned = fx.frame(spark, sf_dir), psf.transpose(fx.psf(spark), N)
    return trace.appended([projection.backward(frame.where(F.col("t") == t), turned, N, H, W) for t in range(fx.TIMES)])


DIVISOR = "list_max(list_filter(range(1, {0}), lambda k: n % k = 0))"


@query("block_factors", f"SELECT n, CASE WHEN {DIVISOR.format(9)} > 1 THEN {DIVISOR.format(9)} ELSE {DIVISOR.format(65)} END::BIGINT AS first, {DIVISOR.format(5)}::BIGINT AS second FROM (SELECT p_partkey::BIGINT + 1 AS n FROM part)")
def _(spark, sf_dir):
    parts = fx.table(spark, sf_dir, "part").select((F.col("p_partkey") + 1).cast("long").alias("n"))
    first, _ = numbers.best_divisors([F.col("n"), F.col("n")], [8, 1], [64, 64])
    _, second = numbers.best_divisors([F.col("n"), F.col("n")], [8, 4])
    return parts.select("n", first.alias("first"), second.alias("second"))


@query("padded_sizes", "WITH s AS (SELECT DISTINCT (pow(2, a) * pow(3, b) * pow(5, c) * pow(7, d))::BIGINT * 15 AS s FROM range(9) q(a), range(6) r(b), range(4) t(c), range(4) u(d) WHERE pow(2, a) * pow(3, b) * pow(5, c) * pow(7, d) <= 200) SELECT p_partkey, p_partkey % 1000 + 1 AS n, (SELECT min(s) FROM s WHERE s >= p_partkey % 1000 + 1) AS size FROM part")
def _(spark, sf_dir):
    own = fx.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 1000 + 1).alias("n"))
    return own.join(numbers.padded_sizes(spark, 1000, 15), "n").select("p_partkey", "n", "size")


@query("scanned_widths", "SELECT c_custkey, try_cast(substr(c_name, 10, 3) AS DOUBLE) AS first, try_cast(substr(c_name, 13, 4) AS BIGINT) AS second, try_cast(substr(c_name, 17) AS BIGINT) AS third FROM customer WHERE regexp_matches(c_name, '^Customer#[0-9]{9}$')")
def _(spark, sf_dir):
    names_ = fx.table(spark, sf_dir, "customer").where(F.col("c_name").rlike("^Customer#[0-9]{9}$"))
    return names_.select("c_custkey", *(c.alias(n) for c, n in zip(scanning.scan_columns(F.col("c_name"), "Customer#%3f%4d%d"), ("first", "second", "third"), strict=True)))


# A form that SQL can't express


@query("psf_synthesis")
def _(spark, sf_dir):
    green = fx.table(spark, sf_dir, "part").agg(F.max("p_size")).first()[0]  # nanometres above 480
    optics = synthesis.Optics(m=40, na=0.95, pitch=150e-6, n=3, osr=3, index=1.0, fml=3000e-6, lam=(480 + green) * 1e-9, zmin=-2e-6, zmax=2e-6, spacing=2e-6)
    return synthesis.synthesise(spark, optics).withColumn("h", F.round("h", 9))
