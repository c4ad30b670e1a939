"""More registered queries: plate solving, registration, mosaics, frequencies and scales of frames.

Roles: orders are catalogue stars and suppliers frames of the sky; parts are the stars of a reference frame and nations
frames to be registered; embeddings are 8 x 8 frames, chained to mosaics by their rank within a label.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from nightloom.operators import astrometry, frequency as fq, registration as reg, stacking as st
from nightloom.operators.settle import settled
from nightloom.plans import pipelines as pipes
from nightloom.plans.catalogue import LONG, PLACES, R, by_vec, pixels, query, rounded, table


def even(*of: Column | str) -> Column:
    """A number from 0 to 1 that looks random, of the hash of some columns."""
    return F.pmod(F.xxhash64(*of), F.lit(1_000_003)) / 1_000_003.0


# ==== plate solving ==================================================================================
SIZE, ARCSEC = 600, 36.0
POSE = "s_suppkey, 110 + s_suppkey * 7919 % 1000 / 100.0 AS ra, -5 + s_suppkey * 104729 % 1000 / 100.0 AS dec, s_suppkey * 31337 % 36000 / 100.0 - 180 AS turn, s_suppkey % 2 = 1 AS flipped"


def sky(spark: SparkSession, sf: str) -> DataFrame:
    """A catalogue over 30 by 30 degrees."""
    key = F.col("o_orderkey")
    return table(spark, sf, "orders").select(key.alias("star_id"), (100 + 30 * even(key, F.lit(1))).alias("ra"), (-15 + 30 * even(key, F.lit(2))).alias("dec"), (5 + 10 * even(key, F.lit(3))).alias("mag"))


def exposures(spark: SparkSession, sf: str, catalogue: DataFrame, most: int = 200, first: int = 8192) -> tuple[DataFrame, DataFrame]:
    """(frames, stars): what a detector would list of each frame, its `most` brightest stars at their places.

    Frames look at about the `first` brightest stars of the catalogue, or up to four times as many; those that see fewer than
    `most` of them look at four times as many again, and so on to the whole catalogue. So pairs don't grow with its density.
    """
    key = F.col("s_suppkey")
    pose = table(spark, sf, "supplier").select(key.cast("string").alias("frame_id"), (110 + key * 7919 % 1000 / 100.0).alias("ra"), (-5 + key * 104729 % 1000 / 100.0).alias("dec"), F.radians(key * 31337 % 36000 / 100.0 - 180).alias("turn"), (key % 2 == 1).alias("flip"))
    turned, mirrored = F.when(F.col("flip"), -F.col("turn")).otherwise(F.col("turn")), F.when(F.col("flip"), 1.0).otherwise(-1.0)
    a, d = F.radians("ra"), F.radians("dec")
    east, north = [-F.sin(a), F.cos(a), F.lit(0.0)], [-F.sin(d) * F.cos(a), -F.sin(d) * F.sin(a), F.cos(d)]
    step = math.degrees(3600 / ARCSEC)  # pixels to a radian
    along = {f"{n}_u_": (F.cos(turned) * mirrored * e + F.sin(turned) * up) * step for n, e, up in zip("xyz", east, north)}
    along |= {f"{n}_v_": (F.cos(turned) * up - F.sin(turned) * mirrored * e) * step for n, e, up in zip("xyz", east, north)}
    on = lambda side: sum((F.col(f"{n}_{side}_") * F.col(f"{n}_b_") for n in "xyz"), F.lit(0.0))  # noqa: E731  a star's vector along a frame's
    nth = F.row_number().over(W.partitionBy("frame_id").orderBy(F.desc("flux"), "star"))

    def listed(poses: DataFrame, bright: DataFrame) -> DataFrame:
        seen = astrometry.sky_neighbours(poses.withColumns(along), bright, 4.3)  # a corner is 4.24 degrees off
        stars = seen.select("frame_id", F.col("star_id").alias("star"), (on("u") / on("a") + (SIZE - 1) / 2).alias("x"), (on("v") / on("a") + (SIZE - 1) / 2).alias("y"), "flux").where(f"x between 0 and {SIZE - 1} and y between 0 and {SIZE - 1}")
        return stars.withColumn("nth", nth).where(F.col("nth") <= most)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # said outright: small tables would else be one task's work
    flux = catalogue.select("star_id", "ra", "dec", F.pow(F.lit(10.0), -0.4 * F.col("mag")).alias("flux"))
    n, left, stars = flux.count(), pose.repartition(parts, "frame_id"), None
    rounds = max(0, math.floor(math.log(max(1, n / first), 4)))
    faintest = flux.agg(F.percentile_approx("flux", [1 - 4.0**-k for k in range(rounds, 0, -1)], 100_000)).first()[0] if rounds else []
    for least in [*faintest, None]:
        bright = flux if least is None else flux.where(F.col("flux") >= least)
        found = listed(left, F.broadcast(bright) if not rounds or least == faintest[0] else bright)
        if least is not None:
            found = settled(found)
            full = settled(found.where(F.col("nth") == most).select("frame_id"))
            found, left = found.join(full, "frame_id", "left_semi"), left.join(full, "frame_id", "left_anti")
        stars = found if stars is None else stars.unionAll(found)
        if least is not None and left.isEmpty():
            break
    return pose.select("frame_id", F.lit(SIZE).alias("width"), F.lit(SIZE).alias("height")), stars.drop("nth")


@query(f"SELECT s_suppkey, round(ra, 4) AS ra, round(dec, 4) AS dec, {ARCSEC} AS scale, round(turn, 3) AS rotation, flipped FROM (SELECT {POSE} FROM supplier)".replace(f"{ARCSEC} AS", f"CAST({ARCSEC} AS DOUBLE) AS").replace("/ 100.0", "/ CAST(100 AS DOUBLE)"))
def plate_solve(spark, sf):
    catalogue = sky(spark, sf)
    frames, stars = exposures(spark, sf, catalogue)
    solved = astrometry.solve(stars, frames, catalogue, levels=((1.2, 2), (2.0, 2)))
    return solved.select(F.col("frame_id").cast("long").alias("s_suppkey"), F.round("ra", 4).alias("ra"), F.round("dec", 4).alias("dec"), F.round("scale", 4).alias("scale"), F.when(F.round("rotation", 3) == 180, -180.0).otherwise(F.round("rotation", 3)).alias("rotation"), "flipped")  # half a turn is -180, as in the SQL


# ==== registration ===================================================================================
BEND = "1 + n * 0.001 AS p, 0.002 * n AS q, 5.0 * n AS tx, -0.002 * n AS r, 1 - 0.001 * n AS s, -3.0 * n AS ty, 0.000001 * n AS g, -0.000002 * n AS h"


def field(spark: SparkSession, sf: str) -> DataFrame:
    """Star lists: parts as the reference's stars, and each nation's frame of them under its own homography."""
    key = F.col("p_partkey")
    ref = table(spark, sf, "part").select(key.alias("star"), (2000 * even(key, F.lit(4))).alias("x"), (2000 * even(key, F.lit(5))).alias("y"), (F.col("p_retailprice") + even(key, F.lit(6))).alias("flux"))
    bent = table(spark, sf, "nation").withColumn("n", F.col("n_nationkey").cast("double")).selectExpr("cast(n_nationkey as string) as frame_id", *BEND.split(", "))
    x, y = F.col("x"), F.col("y")
    w = F.col("g") * x + F.col("h") * y + 1
    moved = ref.crossJoin(F.broadcast(bent)).select("frame_id", F.lit(0).alias("channel"), ((F.col("r") * x + F.col("s") * y + F.col("ty")) / w).alias("y"), ((F.col("p") * x + F.col("q") * y + F.col("tx")) / w).alias("x"), "flux", F.lit(3.0).alias("fwhm"))  # 25 nations
    return ref.select(F.lit("ref").alias("frame_id"), F.lit(0).alias("channel"), "y", "x", "flux", F.lit(3.0).alias("fwhm")).unionByName(moved)


@query(f"""WITH m AS (SELECT n_nationkey, {BEND} FROM (SELECT n_nationkey, CAST(n_nationkey AS DOUBLE) AS n FROM nation)), k AS (SELECT *, p * s - q * r AS z FROM m)
    SELECT n_nationkey, round((s - ty * h) / z, 6) + 0.0 AS a, round((tx * h - q) / z, 6) + 0.0 AS b, round((q * ty - tx * s) / z, 4) + 0.0 AS dx, round((ty * g - r) / z, 6) + 0.0 AS c, round((p - tx * g) / z, 6) + 0.0 AS d, round((tx * r - p * ty) / z, 4) + 0.0 AS dy,
    round(1e6 * (r * h - s * g) / z, 4) + 0.0 AS g, round(1e6 * (q * g - p * h) / z, 4) + 0.0 AS h FROM k""")
def register_homography(spark, sf):
    t = reg.match_stars(field(spark, sf), "ref", kind="homography").where("frame_id <> 'ref'")
    fine = lambda c, n, k=1.0: (F.round(F.col(c) * k, n) + F.lit(0.0)).alias(c)
    return t.select(F.col("frame_id").cast("int").alias("n_nationkey"), fine("a", 6), fine("b", 6), fine("dx", 4), fine("c", 6), fine("d", 6), fine("dy", 4), fine("g", 4, 1e6), fine("h", 4, 1e6))


# ==== mosaics ========================================================================================
def chained(spark: SparkSession, sf: str, per_panel: int, panels: int) -> DataFrame:
    """(frame_id, seq, panel): embeddings of a label in the order of their ids, `per_panel` to a panel, so many panels to a mosaic.

    A label with more than 1000 mosaics goes on in the next label's numbers, as in the SQL: a panel then has frames of both.
    """
    rank = F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1
    e = table(spark, sf, "embeddings").select("vec_id", "label", rank.alias("rank"))
    return e.select(F.col("vec_id").cast("string").alias("frame_id"), (F.col("label") * 1000 + F.floor(F.col("rank") / (per_panel * panels))).alias("seq"), (F.floor(F.col("rank") / per_panel) % panels).cast("int").alias("panel"))


def _chain_sql(per_panel: int, panels: int) -> str:
    return f"ch AS (SELECT vec_id, label * 1000 + k // {per_panel * panels} AS seq, CAST(k // {per_panel} % {panels} AS INT) AS panel FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k FROM embeddings))"


#: Panels six pixels apart, every second one a pixel lower: levels are running sums of the mean steps between neighbours.
LEVELS = """dd AS (SELECT a.seq, b.panel, avg(a.v - b.v) AS d FROM s a JOIN s b ON a.seq = b.seq AND b.panel = a.panel + 1 AND a.x = b.x + 6 AND a.y + a.panel % 2 = b.y + b.panel % 2 GROUP BY ALL),
    lv AS (SELECT DISTINCT s.seq, s.panel, coalesce(d, 0) AS d FROM s LEFT JOIN dd USING (seq, panel)), o AS (SELECT seq, panel, sum(d) OVER (PARTITION BY seq ORDER BY panel) AS o FROM lv)"""
LAID = f"""SELECT seq, CAST(y + panel % 2 AS INT) AS y, CAST(x + panel * 6 AS INT) AS x, {R('sum(w * (v + o)) / sum(w)')} AS v FROM (SELECT s.*, o.o, least(least(x, 7 - x, y, 7 - y) + 1, 3) / 3.0 AS w FROM s JOIN o USING (seq, panel)) GROUP BY ALL"""


def first_panel(panels: DataFrame) -> DataFrame:
    return panels.select("seq", F.lit(0).alias("frame_id")).distinct()


def moves_of(panels: DataFrame, name: str) -> DataFrame:
    return panels.select(F.col(name).alias("frame_id"), (-6 * F.col("panel")).cast("int").alias("dx"), (-(F.col("panel") % 2)).cast("int").alias("dy")).distinct()


@query(f"WITH {LONG}, {_chain_sql(1, 8)}, s AS (SELECT p.*, ch.seq, ch.panel FROM p JOIN ch USING (vec_id)), {LEVELS} SELECT ch.vec_id, {R('o')} AS \"offset\" FROM o JOIN ch USING (seq, panel)")
def mosaic_levels(spark, sf):
    c = chained(spark, sf, 1, 8)
    laid = reg.apply_shifts(pixels(spark, sf).drop("seq").join(c.drop("panel"), "frame_id"), moves_of(c, "frame_id"), framing="max")
    offsets = st.panel_offsets(laid, c, first_panel(c))
    return rounded(c.join(offsets, ["seq", "frame_id"], "left").select(F.col("frame_id").cast("long").alias("vec_id"), F.coalesce("offset", F.lit(0.0)).alias("offset")))


@query(f"WITH {LONG}, {_chain_sql(1, 8)}, s AS (SELECT p.*, ch.seq, ch.panel FROM p JOIN ch USING (vec_id)), {LEVELS} {LAID}")
def pipeline_spiral_mosaic(spark, sf):
    c = chained(spark, sf, 1, 8)
    p = pixels(spark, sf).drop("seq").join(c.drop("panel"), "frame_id")
    return rounded(pipes.spiral_mosaic(p, moves_of(c, "frame_id"), first_panel(c), feather=2, panels=c).select("seq", "y", "x", "v"))


@query(f"""WITH {LONG}, {_chain_sql(3, 4)}, q AS (SELECT seq, panel, y, x, abs(v) AS v FROM p JOIN ch USING (vec_id)), m AS (SELECT seq, panel, y, x, median(v) AS m FROM q GROUP BY ALL),
    s AS (SELECT seq, panel, y, x, avg(v) AS v FROM q JOIN m USING (seq, panel, y, x) WHERE m - v <= 0.2 * m AND v - m <= 0.1 * m GROUP BY ALL), {LEVELS} {LAID}""")
def pipeline_grid_mosaic(spark, sf):
    c = chained(spark, sf, 3, 4).withColumn("name", F.col("panel").cast("string"))
    p = pixels(spark, sf).drop("seq").join(c.select("frame_id", "seq"), "frame_id").withColumn("v", F.abs("v"))
    return rounded(pipes.grid_mosaic(p, c.select("frame_id", F.col("name").alias("panel")), moves_of(c, "name"), first_panel(c).withColumn("frame_id", F.lit("0")), feather=2, rejection="percentile", chain=True).select("seq", "y", "x", "v"))


# ==== frequencies and scales =========================================================================
@query(f"""WITH {LONG}, k AS (SELECT range AS f FROM range(8)), r AS (SELECT vec_id, y, k.f AS fx, sum(v * cos(2 * pi() * k.f * x / 8)) AS re, -sum(v * sin(2 * pi() * k.f * x / 8)) AS im FROM p, k GROUP BY ALL),
    t AS (SELECT vec_id, k.f AS fy, fx, sum(re * cos(2 * pi() * k.f * y / 8) + im * sin(2 * pi() * k.f * y / 8)) AS re, sum(im * cos(2 * pi() * k.f * y / 8) - re * sin(2 * pi() * k.f * y / 8)) AS im FROM r, k GROUP BY ALL)
    SELECT vec_id, CAST((fy + 4) % 8 AS INT) AS y, CAST((fx + 4) % 8 AS INT) AS x, {R('sqrt(re * re + im * im)')} AS magnitude FROM t""")
def fft_magnitude(spark, sf):
    return rounded(fq.spectrum(pixels(spark, sf)).select(F.col("frame_id").cast("long").alias("vec_id"), "y", "x", "magnitude"))


@query(f"WITH {LONG} SELECT vec_id, y, x, {R('v')} AS v FROM p")
def fft_round_trip(spark, sf):
    return by_vec(fq.from_spectrum(fq.spectrum(pixels(spark, sf))))


@query(f"""WITH {LONG}, m AS (SELECT vec_id, median(v) AS m FROM p GROUP BY 1), s AS (SELECT vec_id, m, 1.4826 * median(abs(v - m)) AS s FROM p JOIN m USING (vec_id) GROUP BY ALL), l AS (SELECT p.* FROM p JOIN s USING (vec_id) WHERE v <= m + s),
    g AS (SELECT vec_id, avg(v) AS g FROM l GROUP BY 1), r AS (SELECT vec_id, y, avg(v) AS r FROM l GROUP BY ALL) SELECT p.vec_id, p.y, x, {R('v - 0.8 * coalesce(r - g, 0)')} AS v FROM p JOIN g USING (vec_id) LEFT JOIN r USING (vec_id, y)""")
def fix_banding(spark, sf):
    return by_vec(fq.remove_banding(pixels(spark, sf), 0.8, 1.0))


MIRROR = lambda c: f"CASE WHEN {c} < 0 THEN -1 - ({c}) WHEN {c} > 7 THEN 15 - ({c}) ELSE {c} END"
TAPS = "tap(i, k) AS (VALUES (-2, 0.0625::DOUBLE), (-1, 0.25), (0, 0.375), (1, 0.25), (2, 0.0625))"
SMOOTH = lambda f, step: f"SELECT c.vec_id, c.y, c.x, sum(a.k * b.k * q.v) AS v FROM {f} c, tap a, tap b, {f} q WHERE q.vec_id = c.vec_id AND q.y = {MIRROR(f'c.y + a.i * {step}')} AND q.x = {MIRROR(f'c.x + b.i * {step}')} GROUP BY ALL"
PLANES = f"""WITH {LONG}, {TAPS}, s1 AS ({SMOOTH('p', 1)}), s2 AS ({SMOOTH('s1', 2)}), pl AS (SELECT p.vec_id, 0 AS plane, p.y, p.x, p.v - s1.v AS v FROM p JOIN s1 USING (vec_id, y, x)
    UNION ALL SELECT s1.vec_id, 1, s1.y, s1.x, s1.v - s2.v FROM s1 JOIN s2 USING (vec_id, y, x) UNION ALL SELECT vec_id, 2, y, x, v FROM s2)"""


@query(PLANES + f" SELECT vec_id, plane, y, x, {R('v')} AS v FROM pl")
def wavelet_planes(spark, sf):
    return rounded(fq.wavelets(pixels(spark, sf), 2).select(F.col("frame_id").cast("long").alias("vec_id"), "plane", "y", "x", "v"))


@query(PLANES + f""", n AS (SELECT vec_id, 1.4826 / 0.889 * median(abs(v)) AS n FROM pl WHERE plane = 0 GROUP BY 1), t AS (SELECT pl.*, CASE plane WHEN 0 THEN n * 0.889 * 1.5 WHEN 1 THEN n * 0.2 * 1.5 ELSE 0 END AS l FROM pl JOIN n USING (vec_id))
    SELECT vec_id, y, x, {R('sum(sign(v) * greatest(abs(v) - l, 0))')} AS v FROM t GROUP BY ALL""")
def wavelet_denoise(spark, sf):
    return by_vec(fq.denoised(pixels(spark, sf), 1.5, 2))


@query()
def deconvolve_lucy(spark, sf):
    return by_vec(fq.richardson_lucy(pixels(spark, sf).withColumn("v", F.abs("v")), fq.gaussian_psf(1.5), rounds=3))


@query()
def deconvolve_wiener(spark, sf):
    return by_vec(fq.wiener(pixels(spark, sf), fq.gaussian_psf(1.5), 0.05))



@query(f"""WITH {LONG}, q AS (SELECT vec_id, y, x, CAST(least(greatest(floor((v + 1) / 2 * 16), 0), 15) AS INT) AS bin FROM p), h AS (SELECT vec_id, y // 4 AS ty, x // 4 AS tx, bin, count(*) AS n FROM q GROUP BY ALL),
    e AS (SELECT vec_id, ty, tx, sum(greatest(n - 2.0, 0)) AS e FROM h GROUP BY ALL), f AS (SELECT e.vec_id, e.ty, e.tx, b.range AS bin, least(coalesce(n, 0), 2.0) + e / 16 AS n FROM e CROSS JOIN range(16) b LEFT JOIN h ON h.vec_id = e.vec_id AND h.ty = e.ty AND h.tx = e.tx AND h.bin = b.range),
    m AS (SELECT vec_id, ty, tx, bin, sum(n) OVER (PARTITION BY vec_id, ty, tx ORDER BY bin) / 16 AS v FROM f),
    w AS (SELECT q.*, s.k AS sy, t.k AS sx, CASE s.k WHEN 0 THEN 1 - ((y - 1.5) / 4 - floor((y - 1.5) / 4)) ELSE (y - 1.5) / 4 - floor((y - 1.5) / 4) END * CASE t.k WHEN 0 THEN 1 - ((x - 1.5) / 4 - floor((x - 1.5) / 4)) ELSE (x - 1.5) / 4 - floor((x - 1.5) / 4) END AS w FROM q, (VALUES (0), (1)) s(k), (VALUES (0), (1)) t(k))
    SELECT w.vec_id, w.y, w.x, {R('sum(w * m.v)')} AS v FROM w JOIN m ON m.vec_id = w.vec_id AND m.bin = w.bin AND m.ty = least(greatest(floor((y - 1.5) / 4) + sy, 0), 1) AND m.tx = least(greatest(floor((x - 1.5) / 4) + sx, 0), 1) GROUP BY ALL""")
def local_contrast(spark, sf):
    p = pixels(spark, sf).withColumn("v", (F.col("v") + 1) / 2)
    return by_vec(fq.local_contrast(p, clip=2.0, side=4, bins=16))
