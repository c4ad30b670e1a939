"""Plate solving, registration, mosaics, frequencies, tiles and photometry against NumPy on small frames."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from nightloom.operators import astrometry as astro, frequency as fq, photometry as ph, registration as reg, stacking as st, tiles
from nightloom.plans import catalogue, imaging



def frames(spark, arrays, seq=0):
    rows = [(seq, k, 0, y, x, float(a[y, x])) for k, a in arrays.items() for y in range(a.shape[0]) for x in range(a.shape[1]) if not np.isnan(a[y, x])]
    return spark.createDataFrame(rows, "seq int, frame_id string, channel int, y int, x int, v double")


def image(df, frame, shape, value="v"):
    out = np.full(shape, np.nan)
    for r in df.where(F.col("frame_id") == frame).collect():
        out[r["y"], r["x"]] = r[value]
    return out


# ---- tiles and scales -------------------------------------------------------------------------------
@pytest.mark.parametrize("side", [3, 5, 64])
def test_tiles_see_what_the_frame_has(spark, side):
    """Any tiling gives the same, borders mirrored."""
    a = np.random.default_rng(0).normal(size=(11, 13))
    kernel = np.arange(9.0).reshape(3, 3)
    pad = np.pad(a, 1, mode="symmetric")
    want = sum(kernel[i, j] * pad[i : i + 11, j : j + 13] for i in range(3) for j in range(3))
    got = tiles.over_tiles(frames(spark, {"a": a}), lambda arrays, y0, x0: tiles.convolved(arrays[0], kernel), 1, side=side)
    assert got.columns == ["seq", "frame_id", "channel", "y", "x", "v"]
    assert np.allclose(image(got, "a", a.shape), want)


def test_tiles_of_small_frames_and_holes(spark):
    a = np.array([[1.0, np.nan], [3.0, 4.0]])
    seen = lambda arrays, y0, x0: np.nan_to_num(arrays[0], nan=-1.0)
    got = tiles.over_tiles(frames(spark, {"a": a, "b": np.array([[7.0]])}), seen, 6, side=4)
    assert {(r.frame_id, r.y, r.x): r.v for r in got.collect()} == {("a", 0, 0): 1, ("a", 1, 0): 3, ("a", 1, 1): 4, ("b", 0, 0): 7}
    assert tiles.over_tiles(frames(spark, {"a": a}).where("false"), seen, 2).count() == 0


def atrous(a, levels):
    taps, out, now = ((-2, 1 / 16), (-1, 1 / 4), (0, 3 / 8), (1, 1 / 4), (2, 1 / 16)), [], a
    for j in range(levels):
        r = 2 * 2**j
        pad = np.pad(now, r, mode="symmetric")
        soft = sum(p * q * pad[r + i * 2**j : r + i * 2**j + a.shape[0], r + k * 2**j : r + k * 2**j + a.shape[1]] for i, p in taps for k, q in taps)
        out.append(now - soft)
        now = soft
    return [*out, now]


def test_wavelets(spark):
    a = np.random.default_rng(1).normal(size=(20, 17))
    got = fq.wavelets(frames(spark, {"a": a}), 3, side=7).cache()
    for j, plane in enumerate(atrous(a, 3)):
        assert np.allclose(image(got.where(F.col("plane") == j), "a", a.shape), plane)
    assert np.allclose(image(fq.recomposed(got), "a", a.shape), a)
    assert np.allclose(image(fq.recomposed(got, [0.0, 0.0, 0.0]), "a", a.shape), atrous(a, 3)[-1])


def test_denoising_takes_noise_and_leaves_stars(spark):
    rng = np.random.default_rng(2)
    y, x = np.mgrid[0:40, 0:40]
    clean = 50 * np.exp(-((y - 20) ** 2 + (x - 18) ** 2) / 8)
    got = image(fq.denoised(frames(spark, {"a": clean + rng.normal(size=clean.shape)}), 3.0, 3), "a", clean.shape)
    assert np.abs(got - clean).std() < 0.6 and got.max() > 45


# ---- frequencies ------------------------------------------------------------------------------------
def test_fourier_is_numpys(spark):
    rng = np.random.default_rng(3)
    arrays = {"a": rng.normal(size=(6, 9)), "b": rng.normal(size=(1, 5)), "c": rng.normal(size=(7, 1))}
    s = fq.spectrum(frames(spark, arrays)).cache()
    for k, a in arrays.items():
        z = np.fft.fftshift(np.fft.fft2(a))
        assert np.allclose(image(s, k, a.shape, "magnitude"), np.abs(z))
        assert np.allclose(image(fq.from_spectrum(s), k, a.shape), a)
    holed = arrays["a"].copy()
    holed[2, 3] = np.nan
    z = fq.fourier(frames(spark, {"a": holed}))
    assert np.allclose(image(z, "a", (6, 9), "re") + 1j * image(z, "a", (6, 9), "im"), np.fft.fft2(np.nan_to_num(holed)))


def test_banding_goes(spark):
    rng = np.random.default_rng(4)
    bands = rng.normal(size=12) * 5
    a = 100 + rng.normal(size=(12, 60)) * 0.1 + bands[:, None]
    got = image(fq.remove_banding(frames(spark, {"a": a}), 1.0, 50.0), "a", a.shape)
    assert np.ptp(got.mean(axis=1)) < 1e-6
    got = image(fq.remove_banding(frames(spark, {"a": a.T}), 1.0, 50.0, vertical=True), "a", a.T.shape)
    assert np.ptp(got.mean(axis=0)) < 1e-6


def lucy(a, psf, rounds):
    r = psf.shape[0] // 2

    def conv(b, k):
        pad = np.pad(b, r, mode="symmetric")
        return sum(k[i, j] * pad[i : i + b.shape[0], j : j + b.shape[1]] for i in range(2 * r + 1) for j in range(2 * r + 1))

    now = a.copy()
    for _ in range(rounds):
        now = now * conv(a / np.maximum(conv(now, psf), 1e-12), psf[::-1, ::-1])
    return now


def test_richardson_lucy(spark):
    y, x = np.mgrid[0:15, 0:14]
    a = 1 + 20 * np.exp(-((y - 7) ** 2 + (x - 6) ** 2) / 6)
    psf = fq.gaussian_psf(1.6)
    got = image(fq.richardson_lucy(frames(spark, {"a": a}), psf, 3, side=6), "a", a.shape)
    assert np.allclose(got, lucy(a, psf, 3)) and got.max() > a.max()
    stopped = image(fq.richardson_lucy(frames(spark, {"a": a}), psf, 3, stop=10.0, side=6), "a", a.shape)
    assert np.allclose(stopped, a)
    smooth = image(fq.richardson_lucy(frames(spark, {"a": a}), psf, 3, variation=0.02, side=6), "a", a.shape)
    assert np.isfinite(smooth).all() and smooth.max() < got.max()


def test_wiener(spark):
    rng = np.random.default_rng(5)
    a, psf = rng.normal(size=(12, 10)), fq.moffat_psf(1.5, ratio=0.8, angle=30)
    r = psf.shape[0] // 2
    k = np.zeros(a.shape)
    for i in range(-r, r + 1):
        for j in range(-r, r + 1):
            k[i % 12, j % 10] += psf[i + r, j + r]
    h = np.fft.fft2(k)
    want = np.fft.ifft2(np.fft.fft2(a) * h.conj() / (np.abs(h) ** 2 + 0.1)).real
    assert np.allclose(image(fq.wiener(frames(spark, {"a": a}), psf, 0.1), "a", a.shape), want)


def test_local_contrast(spark):
    a = np.random.default_rng(6).random((10, 13)) ** 2
    bins, side, clip = 8, 4, 1.5
    level = np.clip(np.floor(a * bins), 0, bins - 1).astype(int)
    maps = {}
    for ty in range(3):
        for tx in range(4):
            h = np.bincount(level[ty * side : ty * side + side, tx * side : tx * side + side].ravel(), minlength=bins).astype(float)
            n, limit = h.sum(), clip * h.sum() / bins
            maps[ty, tx] = np.cumsum(np.minimum(h, limit) + np.maximum(h - limit, 0).sum() / bins) / n
    want = np.zeros(a.shape)
    for y in range(10):
        for x in range(13):
            fy, fx = (y - 1.5) / side, (x - 1.5) / side
            for i, wy in ((0, 1 - (fy - math.floor(fy))), (1, fy - math.floor(fy))):
                for j, wx in ((0, 1 - (fx - math.floor(fx))), (1, fx - math.floor(fx))):
                    want[y, x] += wy * wx * maps[min(max(math.floor(fy) + i, 0), 2), min(max(math.floor(fx) + j, 0), 3)][level[y, x]]
    assert np.allclose(image(fq.local_contrast(frames(spark, {"a": a}), clip, side, bins), "a", a.shape), want)


# ---- mosaics ----------------------------------------------------------------------------------------
def test_overlaps_are_levelled_over_the_whole_mosaic(spark):
    """A grid of panels with cycles, one group apart from the reference, noise in every panel: NumPy's least squares."""
    rng = np.random.default_rng(7)
    arrays, places = {}, {}
    for i in range(3):
        for j in range(3):
            a = np.full((40, 40), np.nan)
            a[i * 6 : i * 6 + 8, j * 6 : j * 6 + 8] = rng.normal(size=(8, 8)) + 10 * rng.normal()
            arrays[f"p{i}{j}"] = a
    for k in range(2):
        a = np.full((40, 40), np.nan)
        a[30:35, 30 + 3 * k : 35 + 3 * k] = rng.normal(size=(5, 5)) + 4 * k
        arrays[f"q{k}"] = a
    both = frames(spark, arrays).unionByName(frames(spark, {k: a for k, a in arrays.items() if k < "p1"}, seq=1))
    names = sorted(arrays)
    rows, want = [], []
    for a in names:
        for b in names:
            there = ~np.isnan(arrays[a]) & ~np.isnan(arrays[b])
            if a < b and there.any():
                n = there.sum()
                row = np.zeros(len(names))
                row[names.index(a)], row[names.index(b)] = math.sqrt(n), -math.sqrt(n)
                rows.append(row)
                want.append(-math.sqrt(n) * (arrays[a] - arrays[b])[there].mean())
    fixed = np.zeros(len(names))
    fixed[names.index("p11")] = 1e6
    best = np.linalg.lstsq(np.array([*rows, fixed]), np.array([*want, 0]), rcond=None)[0]
    got = {(r.seq, r.frame_id): r["offset"] for r in st.level_offsets(st.overlaps(both), "p11").collect()}
    for k in names:
        if k != "p11":
            assert got[0, k] == pytest.approx(best[names.index(k)], abs=1e-6)
    assert (0, "p11") not in got and got[0, "q0"] == pytest.approx(-got[0, "q1"])
    steps = {k: got[1, k] for k in ("p00", "p01", "p02")}  # a chain without the reference keeps its level
    assert 8 * 2 * steps["p00"] + 2 * 8 * 2 * steps["p01"] + 8 * 2 * steps["p02"] == pytest.approx(0, abs=1e-6)


def test_frames_of_one_panel_share_its_level(spark):
    """Two chains that share their numbers: each step is the mean step of all frames of two panels."""
    level = {"a0": 0.0, "b0": 2.0, "a1": 5.0, "b1": 9.0, "a2": -1.0}
    moves = [(k, 0, -2 * int(k[1])) for k in level]
    rows = frames(spark, {k: v + np.zeros((3, 4)) for k, v in level.items()})
    panels = spark.createDataFrame([(0, k, int(k[1])) for k in level], "seq int, frame_id string, panel int")
    laid = reg.apply_shifts(rows, spark.createDataFrame([(k, x, y) for k, y, x in moves], "frame_id string, dx int, dy int"), framing="max")
    got = {r.frame_id: r["offset"] for r in st.panel_offsets(laid, panels, panels.where("panel = 0").selectExpr("seq", "0 as frame_id").distinct()).collect()}
    assert got == {k: pytest.approx({1: 1 - 7.0, 2: 1 - 7.0 + 7.0 + 1}[int(k[1])]) for k in level if k[1] != "0"}


def test_no_overlaps(spark):
    p = frames(spark, {"a": np.ones((2, 2))})
    assert st.level_offsets(st.overlaps(p), "a").count() == 0
    assert sorted(map(tuple, st.overlap_normalised(p, "a").collect())) == sorted(map(tuple, p.collect()))


# ---- registration -----------------------------------------------------------------------------------
def starlist(spark, lists):
    rows = [(k, 0, float(y), float(x), float(f), 3.0) for k, pts in lists.items() for x, y, f in pts]
    return spark.createDataFrame(rows, reg.STARS)


@pytest.mark.parametrize("kind,matrix", [
    ("shift", [[1, 0, 12.5], [0, 1, -7.25], [0, 0, 1]]), ("similarity", [[0.8, -0.6, 300], [0.6, 0.8, -40], [0, 0, 1]]),
    ("affine", [[1.02, 0.03, 5], [-0.01, 0.97, 9], [0, 0, 1]]), ("homography", [[1.01, 0.02, 30], [-0.03, 0.99, 14], [2e-5, -1e-5, 1]]),
])
def test_transforms_are_found_among_strangers(spark, kind, matrix):
    """Half of the frame's stars are in the reference, with noise; the rest are strangers."""
    rng = np.random.default_rng(8)
    ref = np.c_[rng.uniform(0, 1000, (120, 2)), rng.uniform(1, 2, 120)]
    m = np.array(matrix)
    frame = reg.moved_points(np.linalg.inv(m), ref[:90, :2]) + rng.normal(0, 0.05, (90, 2))
    strangers = np.c_[rng.uniform(0, 1000, (30, 2)), rng.uniform(0.1, 1, 30)]
    lists = {"ref": ref, "f": np.r_[np.c_[frame, ref[:90, 2]], strangers], "few": ref[:2], "other": np.c_[rng.uniform(0, 1000, (60, 2)), np.ones(60)]}
    t = {r.frame_id: r for r in reg.match_stars(starlist(spark, lists), "ref", kind=kind, least_pairs=10).collect()}
    got = np.array([[t["f"].a, t["f"].b, t["f"].dx], [t["f"].c, t["f"].d, t["f"].dy], [t["f"].g, t["f"].h, 1]])
    corners = np.array([[0, 0], [1000, 0], [0, 1000], [1000, 1000], [500, 500]])
    assert t["f"].pairs >= 80 and np.abs(reg.moved_points(got, corners) - reg.moved_points(m, corners)).max() < 0.3
    assert t["few"].a is None and t["few"].pairs == 0 and t["other"].a is None
    assert t["ref"].pairs == 120 and abs(t["ref"].a - 1) < 1e-9


def test_warps_in_tiles_and_framings(spark):
    y, x = np.mgrid[0:20, 0:24]
    a = 3.0 * x + 2.0 * y
    t = spark.createDataFrame([("a", 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 9), ("b", 1.0, 0.0, 6.5, 0.0, 1.0, -3.0, 0.0, 0.0, 9), ("lost", *[None] * 8, 0)], reg.TRANSFORMS)
    p = frames(spark, {"a": a, "b": a + 3 * 6.5 - 2 * 3.0, "lost": a}).drop("seq")
    whole = reg.apply_transforms(p, t, framing="max", side=8).cache()
    assert whole.where("frame_id = 'lost'").count() == 0
    for r in whole.collect():  # the plane is one plane in every frame: y from -3, and half a pixel is interpolated
        assert r.v == pytest.approx(3.0 * r.x + 2.0 * (r.y - 3), abs=1.6 if r.frame_id == "b" and r.x in (6, 30) else 1e-9)
    assert np.nanmax([r.x for r in whole.where("frame_id = 'b'").collect()]) == 30 and whole.where("frame_id = 'a'").count() == 480
    common = reg.apply_transforms(p, t, framing="min", side=8)
    n = {r.frame_id: r["count"] for r in common.groupBy("frame_id").count().collect()}
    assert n == {"a": 17 * 17, "b": 17 * 17}
    cog = reg.framings(p, t, "cog").first()
    assert (cog.x0, cog.y0, cog.w, cog.h) == (3, -2, 24, 20)
    current = reg.apply_transforms(p, t, how="cubic", framing="current", reference="a", side=9)
    assert current.agg(F.max("x"), F.max("y"), F.min("y")).first()[:] == (23, 19, 0)


@pytest.mark.parametrize("how", ["nearest", "linear", "cubic", "lanczos4"])
def test_warp_by_a_homography(spark, how):
    y, x = np.mgrid[0:30, 0:30]
    f = lambda y, x: np.sin(x / 9) + np.cos(y / 11)
    m = np.array([[1.0, 0.05, 1.3], [-0.04, 1.02, 0.7], [1e-3, -5e-4, 1.0]])
    t = spark.createDataFrame([("a", *map(float, m[0]), *map(float, m[1]), float(m[2, 0]), float(m[2, 1]), 9)], reg.TRANSFORMS)
    got = image(reg.apply_transforms(frames(spark, {"a": f(y, x)}), t, how=how, side=11), "a", (30, 30))
    at = reg.moved_points(np.linalg.inv(m), np.c_[x.ravel(), y.ravel()])
    want = f(at[:, 1], at[:, 0]).reshape(30, 30)
    inside = ((at > 3.5) & (at < 25.5)).all(axis=1).reshape(30, 30)
    assert np.abs(got - want)[inside].max() < {"nearest": 0.13, "linear": 0.01, "cubic": 0.003, "lanczos4": 0.01}[how]


# ---- plate solving ----------------------------------------------------------------------------------
def plane(ra, dec, ra0, dec0):
    a, d, d0 = np.radians(ra - ra0), np.radians(dec), np.radians(dec0)
    den = np.sin(d) * np.sin(d0) + np.cos(d) * np.cos(d0) * np.cos(a)
    return np.degrees(np.cos(d) * np.sin(a) / den), np.degrees((np.sin(d) * np.cos(d0) - np.cos(d) * np.sin(d0) * np.cos(a)) / den)


def test_blind_solving_near_a_pole_with_noise(spark):
    """Poses over the pole and the turn of right ascension, mirrored and not; strangers and missing stars; one frame of no sky."""
    rng = np.random.default_rng(9)
    n = 1500
    dec = np.degrees(np.arcsin(rng.uniform(np.sin(np.radians(65)), 1, n)))
    ra, mag = rng.uniform(0, 360, n), rng.uniform(4, 12, n)
    catalogue = spark.createDataFrame([(i, float(a), float(d), float(m)) for i, (a, d, m) in enumerate(zip(ra, dec, mag))] + [(-1, None, 80.0, 1.0)], "star_id long, ra double, dec double, mag double")
    poses = {"pole": (40.0, 89.5, 31.0, False), "turn": (359.8, 75.0, -120.0, True)}
    rows, sized, scale = [], [("nothing", 700, 600)], 40 / 3600
    for k, (ra0, dec0, turn, flip) in poses.items():
        xi, eta = plane(ra, dec, ra0, dec0)
        c, s = np.cos(np.radians(turn)), np.sin(np.radians(turn))
        u, v = ((c * z + s * eta) / scale for z in (xi if flip else -xi,)).__next__(), ((-s * z + c * eta) / scale for z in (xi if flip else -xi,)).__next__()
        sized.append((k, 700, 600))
        near = (np.abs(u) < 350) & (np.abs(v) < 300) & (dec > 60) & (np.cos(np.radians(dec - dec0)) > 0.9)
        for i in np.flatnonzero(near):
            if rng.random() > 0.1:
                rows.append((k, int(i), float(u[i] + 349.5 + rng.normal(0, 0.1)), float(v[i] + 299.5 + rng.normal(0, 0.1)), float(10 ** (-0.4 * mag[i]))))
        rows += [(k, 9000 + j, float(rng.uniform(0, 700)), float(rng.uniform(0, 600)), float(10 ** (-0.4 * rng.uniform(8, 12)))) for j in range(6)]
    rows += [("nothing", j, float(rng.uniform(0, 700)), float(rng.uniform(0, 600)), 1.0) for j in range(30)] + [("pole", 9999, None, 3.0, 9.0)]
    stars = spark.createDataFrame(rows, "frame_id string, star long, x double, y double, flux double")
    sizes = spark.createDataFrame(sized, "frame_id string, width int, height int")
    got = {r.frame_id: r for r in astro.solve(stars, sizes, catalogue, levels=((1.6, 2),)).collect()}
    assert set(got) == set(poses)
    for k, (ra0, dec0, turn, flip) in poses.items():
        g = got[k]
        xi, eta = plane(np.array(g.ra), np.array(g.dec), ra0, dec0)
        assert math.hypot(xi, eta) < 0.002 and g.scale == pytest.approx(40, rel=1e-3) and g.flipped == flip and g.pairs >= 25
        away = (g.rotation - (-turn if flip else turn) + 180) % 360 - 180
        assert abs(away) < 0.2 if k == "turn" else True  # at the pole the angle goes with the centre's right ascension
    # a hint elsewhere, or another scale, leaves nothing
    hint = spark.createDataFrame([("pole", 180.0, 66.0, 3.0), ("turn", 0.0, 75.0, 3.0)], "frame_id string, ra double, dec double, radius double")
    assert {r.frame_id for r in astro.solve(stars, sizes, catalogue, levels=((1.6, 2),), hints=hint).collect()} == {"turn"}


def test_sky_pairs_are_all_pairs(spark):
    rng = np.random.default_rng(10)
    at = np.c_[np.r_[rng.uniform(0, 360, 60), rng.uniform(359, 361, 40) % 360], np.r_[np.degrees(np.arcsin(rng.uniform(-1, 1, 50))), rng.uniform(88, 90, 10), rng.uniform(-2, 2, 40)]]
    left = spark.createDataFrame([(i, float(a), float(d)) for i, (a, d) in enumerate(at)], "i int, ra double, dec double")
    got = {(r.i, r.j) for r in astro.sky_pairs(left, left.withColumnRenamed("i", "j"), 1.5).collect()}
    v = np.stack([np.cos(np.radians(at[:, 1])) * np.cos(np.radians(at[:, 0])), np.cos(np.radians(at[:, 1])) * np.sin(np.radians(at[:, 0])), np.sin(np.radians(at[:, 1]))], axis=1)
    apart = np.degrees(2 * np.arcsin(np.clip(np.linalg.norm(v[:, None] - v[None], axis=2) / 2, 0, 1)))
    assert got == set(zip(*np.nonzero(apart <= 1.5)))


def test_distortion_is_fitted(spark):
    """Third order polynomials take what a straight fit leaves."""
    rng = np.random.default_rng(11)
    u, v = rng.uniform(-400, 400, 150), rng.uniform(-300, 300, 150)
    xi = 0.005 * u + 2e-12 * u * (u * u + v * v)
    eta = 0.005 * v + 2e-12 * v * (u * u + v * v)
    d0 = math.radians(20)
    den = np.cos(d0) - np.radians(eta) * np.sin(d0)
    ra, dec = 50 + np.degrees(np.arctan2(np.radians(xi), den)), np.degrees(np.arctan2(np.sin(d0) + np.radians(eta) * np.cos(d0), np.hypot(np.radians(xi), den)))
    rows = [("a", str(i), float(a + 399.5), float(b + 299.5), i, float(r), float(d), 1, 800, 600) for i, (a, b, r, d) in enumerate(zip(u, v, ra, dec))]
    pairs = spark.createDataFrame(rows, "frame_id string, star string, x double, y double, star_id long, ra double, dec double, n int, width int, height int")
    straight, bent = (astro.fitted(pairs, o).first() for o in (1, 3))
    assert bent.rms < 0.01 < straight.rms and (bent.ra, bent.dec) == pytest.approx((50, 20), abs=1e-6) and len(bent.xi) == 10


# ---- photometry -------------------------------------------------------------------------------------
def test_profiles_are_recovered(spark):
    y, x = np.mgrid[0:60, 0:60]
    def star(a, cx, cy, sx, sy, t, beta=None):
        dx, dy = x - cx, y - cy
        u, v = (np.cos(t) * dx + np.sin(t) * dy) / sx, (np.cos(t) * dy - np.sin(t) * dx) / sy
        return a * (np.exp(-0.5 * (u * u + v * v)) if beta is None else (1 + u * u + v * v) ** -beta)

    true = {"p": (100.0, 15.3, 20.7, 2.0, 1.5, 0.4), "q": (40.0, 42.1, 39.6, 1.8, 1.8, 0.0)}
    rows = [("a", 0, k, round(t[1]) + 0.0, round(t[2]) + 0.0) for k, t in true.items()] + [("a", 0, "edge", 0.0, 0.0), ("a", 0, "none", None, 1.0), ("a", 0, "away", 300.0, 300.0)]
    stars = spark.createDataFrame(rows, "frame_id string, channel int, star string, x double, y double")
    got = {r.star: r for r in ph.profiles(stars, frames(spark, {"a": 7 + sum(star(*t) for t in true.values())}), 7).collect()}
    for k, (a, cx, cy, sx, sy, t) in true.items():
        g, w = got[k], 2 * math.sqrt(2 * math.log(2))
        assert (g.x, g.y, g.amplitude, g.background) == pytest.approx((cx, cy, a, 7), abs=1e-4)
        assert (g.fwhm_x, g.fwhm_y, g.flux) == pytest.approx((sx * w, sy * w, 2 * math.pi * a * sx * sy), rel=1e-4) and g.beta is None
    assert got["p"].angle == pytest.approx(math.degrees(0.4), abs=0.01) and "none" not in got and "away" not in got
    image = 3 + star(80.0, 30.2, 29.9, 2.5, 2.0, 0.2, 2.5)
    one = ph.profiles(spark.createDataFrame([("a", 0, "m", 30.0, 30.0)], stars.schema), frames(spark, {"a": image}), 12, moffat=True).first()
    assert (one.x, one.y, one.beta) == pytest.approx((30.2, 29.9, 2.5), abs=1e-3) and one.flux == pytest.approx(80 * math.pi * 5 / 1.5, rel=1e-3)


def test_profiles_never_broadcast_pixels(spark):
    """Pixels painted by exploding a few rows look small to the planner; sent to all they ended the query."""
    few = spark.range(3).select(F.col("id").cast("string").alias("frame_id"), F.lit(0).alias("channel"))
    painted = few.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(19)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(19)))).withColumn("v", 1 + 50 * F.exp(-0.1 * (F.pow(F.col("x") - 10, 2) + F.pow(F.col("y") - 9, 2))))
    stars = few.select("frame_id", "channel", F.col("frame_id").alias("star"), F.lit(10.0).alias("x"), F.lit(9.0).alias("y"))
    got = ph.profiles(stars, painted, 7)
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
    assert [(r.x, r.y) for r in got.collect()] == [pytest.approx((10, 9), abs=1e-4)] * 3


def test_apertures(spark):
    a = np.full((21, 21), 2.0)
    a[10, 10], a[10, 11] = 12.0, 7.0
    stars = spark.createDataFrame([("a", 0, "s", 10.0, 10.0), ("a", 0, "dark", 4.0, 4.0)], "frame_id string, channel int, star string, x double, y double")
    got = {r.star: r for r in ph.apertures(stars, frames(spark, {"a": a}), 2.0, 3.0, 5.0).collect()}
    assert (got["s"].n, got["s"].background, got["s"].flux) == (13, 2.0, 15.0) and got["s"].mag == pytest.approx(-2.5 * math.log10(15))
    assert got["dark"].flux == 0 and got["dark"].mag is None


def test_light_curves_and_identity(spark):
    catalogue = spark.createDataFrame([(1, 10.0, 5.0), (2, 10.01, 5.0), (3, 10.5, 5.5)], "star_id int, ra double, dec double")
    seen = spark.createDataFrame([("f", 7, 10.0001, 5.0, 1.0), ("f", 8, 10.0003, 5.0, 2.0), ("f", 9, 10.0099, 5.0, 3.0), ("g", 7, 200.0, 5.0, 4.0)], "frame_id string, star int, ra double, dec double, mag double")
    assert {(r.frame_id, r.star, r.star_id) for r in ph.identified(seen, catalogue, 0.002).collect()} == {("f", 7, 1), ("f", 9, 2)}
    rows = [(f"f{t}", t, s, m + 0.1 * t + (0.5 if s == 3 and t == 2 else 0)) for t in range(4) for s, m in ((1, 8.0), (2, 9.0), (3, 10.0))] + [("empty", 9, 3, 1.0), ("f0", 0, 4, None)]
    measures = spark.createDataFrame(rows, "frame_id string, time int, star_id int, mag double")
    known = spark.createDataFrame([(1, 12.0), (2, 13.0)], "star_id int, mag double")
    got = {r.star_id: r for r in ph.light_curves(measures, known).collect()}
    assert got[3].n == 4 and [round(c.mag, 9) for c in got[3].curve] == [14.0, 14.0, 14.5, 14.0] and got[1].spread == pytest.approx(0) and 4 not in got


def test_all_imaging_queries_are_registered():
    assert {"plate_solve", "pipeline_grid_mosaic", "register_homography"} <= set(catalogue.QUERIES) and imaging.SIZE == 600


def test_brightest_stars_do_not_need_the_whole_catalogue(spark):
    """frames look at the brightest stars first and further only if they see too few."""
    sf = "/root/testdata/sf0.001"
    catalogue = imaging.sky(spark, sf)
    listed = lambda first: {tuple(r) for r in imaging.exposures(spark, sf, catalogue, most=6, first=first)[1].select("frame_id", "star", "x", "y").collect()}
    assert listed(4) == listed(1 << 30) and listed(4)


def test_nearest_star_within_each_rows_reach(spark):
    """the search begins as close as the catalogue is dense, and goes on to a row's own reach."""
    rng = np.random.default_rng(5)
    sky = [(i, float(a), float(d)) for i, (a, d) in enumerate(zip(10 + rng.random(400), 20 + rng.random(400)))]
    placed = [(str(k % 3), k, float(a), float(d), r) for k, (a, d, r) in enumerate(zip(9.9 + 1.2 * rng.random(60), 19.9 + 1.2 * rng.random(60), [0.004, 0.03, 0.2] * 20))]
    got = astro.nearest_within_reach(spark.createDataFrame(placed, "frame_id string, star long, ra double, dec double, reach double"), spark.createDataFrame(sky, "star_id long, ra double, dec double"), ["frame_id", "star"])

    def apart(a, d, a2, d2):
        a, d, a2, d2 = map(np.radians, (a, d, a2, d2))
        return np.degrees(2 * np.arcsin(np.sqrt(np.sin((d2 - d) / 2) ** 2 + np.cos(d) * np.cos(d2) * np.sin((a2 - a) / 2) ** 2)))

    want = {}
    for _, k, a, d, reach in placed:
        least = min((apart(a, d, a2, d2), i) for i, a2, d2 in sky)
        if least[0] <= reach:
            want[k] = least[1]
    assert {r.star: r.star_id for r in got.collect()} == want and 20 < len(want) < 60


def test_only_frames_without_a_sure_pose_look_at_deeper_stars(spark, monkeypatch):
    """A frame that its brightest stars place goes no further; of stars strewn at random all depths are tried."""
    rng = np.random.default_rng(21)
    ra, dec, mag = rng.uniform(40, 50, 400), rng.uniform(-5, 5, 400), rng.uniform(4, 12, 400)
    catalogue = spark.createDataFrame([(i, float(a), float(d), float(m)) for i, (a, d, m) in enumerate(zip(ra, dec, mag))], "star_id long, ra double, dec double, mag double")
    a, d = np.radians(ra - 45), np.radians(dec)
    x, y = np.degrees(np.tan(a)) * 100 + 299.5, np.degrees(np.tan(d) / np.cos(a)) * 100 + 299.5  # 36 arcseconds a pixel
    rows = [("placed", int(i), float(x[i]), float(y[i]), float(10 ** (-0.4 * mag[i]))) for i in np.flatnonzero((np.abs(x - 299.5) < 300) & (np.abs(y - 299.5) < 300))]
    rows += [("strewn", j, float(rng.uniform(0, 600)), float(rng.uniform(0, 600)), float(rng.uniform(0, 1))) for j in range(70)]
    asked, made = [], astro.frame_quads

    def recorded(stars, depths):
        asked.append((tuple(depths), {r.frame_id for r in stars.select("frame_id").distinct().collect()}))
        return made(stars, depths)

    monkeypatch.setattr(astro, "frame_quads", recorded)
    sizes = spark.createDataFrame([("placed", 600, 600), ("strewn", 600, 600)], "frame_id string, width int, height int")
    got = astro.solve(spark.createDataFrame(rows, "frame_id string, star long, x double, y double, flux double"), sizes, catalogue, levels=((1.2, 2), (2.0, 2))).collect()
    assert [(r.frame_id, round(r.ra, 4), round(r.dec, 4), round(r.scale, 3)) for r in got] == [("placed", 45.0, 0.0, 36.0)]
    assert asked == [((16,), {"placed", "strewn"}), ((16, 32), {"strewn"}), ((16, 32, 64), {"strewn"})]
