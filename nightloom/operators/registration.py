"""Registration of frames to a reference, and applying it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .geometry import PIXELS, _kernel, image_of
from .ranks import with_sums

STARS = "frame_id string, channel int, y double, x double, flux double, fwhm double"
TRANSFORMS = "frame_id string, a double, b double, dx double, c double, d double, dy double, g double, h double, pairs int"


def find_stars(pixels: DataFrame, k: float = 4.0, most: int = 200) -> DataFrame:
    """Local maxima over median + k * 1.4826 MAD, with flux-weighted centres; the `most` brightest of each frame."""

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        image = image_of(pdf)
        med = np.nanmedian(image)
        limit = med + k * 1.4826 * np.nanmedian(np.abs(image - med))
        pad = np.pad(np.nan_to_num(image, nan=med), 1, mode="edge")
        around = np.stack([pad[1 + a : pad.shape[0] - 1 + a, 1 + b : pad.shape[1] - 1 + b] for a in (-1, 0, 1) for b in (-1, 0, 1)])
        peak = (image > limit) & (image >= around.max(axis=0))
        rows = []
        for y, x in zip(*np.nonzero(peak)):
            box = np.clip(np.nan_to_num(image[max(0, y - 3) : y + 4, max(0, x - 3) : x + 4], nan=med) - med, 0, None)
            yy, xx = np.mgrid[max(0, y - 3) : max(0, y - 3) + box.shape[0], max(0, x - 3) : max(0, x - 3) + box.shape[1]]
            flux = box.sum()
            cy, cx = (box * yy).sum() / flux, (box * xx).sum() / flux
            rows.append((cy, cx, flux, 2.355 * np.sqrt((box * ((yy - cy) ** 2 + (xx - cx) ** 2)).sum() / flux / 2)))
        rows = sorted(rows, key=lambda r: -r[2])[:most]
        out = pd.DataFrame(rows, columns=["y", "x", "flux", "fwhm"])
        out.insert(0, "channel", pdf.channel.iloc[0])
        out.insert(0, "frame_id", pdf.frame_id.iloc[0])
        return out.astype({"channel": "int32"})

    return pixels.groupBy("frame_id", "channel").applyInPandas(find, STARS)


def shifts(pixels: DataFrame, reference: str, most: int = 16) -> DataFrame:
    """(frame_id, dx, dy): the whole-pixel shift with the largest correlation, |shift| <= most, by aggregates only.

    Correlations are sums over pixel pairs of a frame and the reference at each of the shifts.
    """
    mean = pixels.groupBy("frame_id").agg(F.avg("v").alias("m"))
    p = pixels.where("channel = 0").join(mean, "frame_id").select("frame_id", "y", "x", (F.col("v") - F.col("m")).alias("v"))
    ref = p.where(F.col("frame_id") == reference).select("y", "x", F.col("v").alias("r"))
    moves = F.explode(F.expr(f"flatten(transform(sequence(-{most}, {most}), a -> transform(sequence(-{most}, {most}), b -> struct(a as dy, b as dx))))")).alias("s")
    moved = p.select("frame_id", "y", "x", "v", moves).select("frame_id", "s", (F.col("y") - F.col("s.dy")).alias("y"), (F.col("x") - F.col("s.dx")).alias("x"), "v")
    score = moved.join(ref, ["y", "x"]).groupBy("frame_id", "s").agg(F.avg(F.col("v") * F.col("r")).alias("c"), F.count(F.lit(1)).alias("n"))
    nearest = -(F.abs("s.dx") + F.abs("s.dy"))
    best = score.groupBy("frame_id").agg(F.max_by("s", F.struct("c", nearest, "s.dy", "s.dx")).alias("s"))
    return best.select("frame_id", F.col("s.dx").alias("dx"), F.col("s.dy").alias("dy"))


#: Brightness classes to an octave of 1 + |flux|.
CLASSES = 1024


def bright(stars: DataFrame, most: int) -> DataFrame:
    """stars without those that are certainly not among the `most` brightest of their frame: counts by brightness class, which combine before
    the shuffle, show the class that the last of them is in. What is left of a frame is `most` stars and that class, ties included."""
    f = F.col("flux").cast("double")
    level = F.when(F.isnan(f), F.lit(1 << 40)).otherwise(F.coalesce(F.floor(F.signum(f) * F.log2(1 + F.abs(f)) * CLASSES), F.lit(-(1 << 40))))
    counts = stars.groupBy("frame_id", level.alias("level_")).agg(F.count(F.lit(1)).alias("n_"))
    brighter = F.coalesce(F.sum("n_").over(W.partitionBy("frame_id").orderBy(F.desc("level_")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    last = counts.withColumn("before_", brighter).where(F.col("before_") < most).groupBy("frame_id").agg(F.min("level_").alias("last_"))
    return with_sums(stars.withColumn("level_", level), last, ["frame_id"]).where("level_ >= last_").drop("level_", "last_")


#: Parameters a transform has, pairs that give it.
KINDS = {"shift": 1, "similarity": 2, "affine": 3, "homography": 4}
#: Nearest neighbours with which a star makes triangles; largest difference of two triangles' ratios of sides.
NEAREST, RATIO_OFF = 6, 0.01


def match_stars(stars: DataFrame, reference: str, kind: str = "similarity", least_pairs: int = 4, tolerance: float = 1.5, max_stars: int = 500, draws: int = 500, seed: int = 1) -> DataFrame:
    """Transform of each frame's star list to the reference's: (x', y', w') = ((a x + b y + dx), (c x + d y + dy), (g x + h y + 1)), x' / w' and y' / w'.

    Triangles of neighbouring stars are alike in both lists whatever the turn and scale: alike triangles vote for
    pairs of stars. The transform (kind: shift, similarity, affine or homography) is then found by RANSAC on the voted
    pairs with a fixed seed, and fitted to all pairs it brings within `tolerance` pixels. A frame with fewer than `least_pairs` of them has
    no transform (nulls). A list is cut at its `max_stars` brightest stars; each frame's list is one row, the reference's is sent to all.
    """
    order = W.partitionBy("frame_id").orderBy(F.desc_nulls_last("flux"), "x", "y")
    top = bright(stars.where("x is not null and y is not null"), max_stars).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= max_stars)
    listed = top.groupBy("frame_id").agg(F.array_sort(F.collect_list(F.struct("nth", "x", "y"))).alias("s"))
    ref = listed.where(F.col("frame_id") == reference).select(F.col("s").alias("r"))

    def solve(batches):
        for pdf in batches:
            rows = []
            for frame, s, r in zip(pdf.frame_id, pdf.s, pdf.r):
                p, q = (np.array([(e["x"], e["y"]) for e in z]).reshape(-1, 2) for z in (s, r))
                rows.append((frame, *find_transform(p, q, kind, least_pairs, tolerance, draws, seed)))
            yield pd.DataFrame(rows, columns=["frame_id", "a", "b", "dx", "c", "d", "dy", "g", "h", "pairs"])

    return listed.crossJoin(F.broadcast(ref)).mapInPandas(solve, TRANSFORMS)  # one reference list


def _triangles(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(corners, ratios): triangles of each star with two of its neighbours; corners opposite the longest, middle and shortest side."""
    n = len(p)
    if n < 3:
        return np.zeros((0, 3), dtype=int), np.zeros((0, 2))
    apart = np.hypot(p[:, None, 0] - p[None, :, 0], p[:, None, 1] - p[None, :, 1])
    near = np.argsort(apart, axis=1, kind="stable")[:, 1 : NEAREST + 1]
    corners = np.concatenate([np.stack([np.arange(n), near[:, i], near[:, j]], axis=1) for i in range(near.shape[1]) for j in range(i + 1, near.shape[1])])
    corners = np.unique(np.sort(corners, axis=1), axis=0)
    sides = np.stack([apart[corners[:, 1], corners[:, 2]], apart[corners[:, 0], corners[:, 2]], apart[corners[:, 0], corners[:, 1]]], axis=1)
    by = np.argsort(-sides, axis=1, kind="stable")
    corners, sides = np.take_along_axis(corners, by, axis=1), np.take_along_axis(sides, by, axis=1)
    good = sides[:, 2] > 0
    return corners[good], sides[good][:, 1:] / sides[good][:, :1]


def voted_pairs(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices in p and q of stars that alike triangles pair with each other more often than with any other."""
    (tp, rp), (tq, rq) = _triangles(p), _triangles(q)
    votes = np.zeros((len(p), len(q)), dtype=int)
    order = np.argsort(rq[:, 0], kind="stable")
    low, high = (np.searchsorted(rq[order, 0], rp[:, 0] + d, side=s) for d, s in ((-RATIO_OFF, "left"), (RATIO_OFF, "right")))
    for t, r, a, b in zip(tp, rp, low, high):
        alike = order[a:b][np.abs(rq[order[a:b], 1] - r[1]) <= RATIO_OFF]
        for k in range(3):
            np.add.at(votes[t[k]], tq[alike, k], 1)
    if not votes.size:
        return np.zeros(0, dtype=int), np.zeros(0, dtype=int)
    best = votes.argmax(axis=1)
    of_p = np.arange(len(p))
    sure = (votes[of_p, best] > 0) & (votes[:, best].max(axis=0) == votes[of_p, best])
    return of_p[sure], best[sure]


def fitted_matrix(a: np.ndarray, b: np.ndarray, kind: str) -> np.ndarray | None:
    """The 3 x 3 matrix from points a to points b by least squares (homography: the direct linear transform on normalised points); None if they don't give one."""
    if kind == "shift":
        m = np.eye(3)
        m[:2, 2] = (b - a).mean(axis=0)
        return m
    if kind == "homography":
        def normal(z):
            mid = z.mean(axis=0)
            size = np.hypot(*(z - mid).T).mean() or 1.0
            return np.array([[1, 0, -mid[0]], [0, 1, -mid[1]], [0, 0, size / np.sqrt(2)]]) * (np.sqrt(2) / size)

        ta, tb = normal(a), normal(b)
        u, v = (np.c_[z, np.ones(len(z))] @ t.T for z, t in ((a, ta), (b, tb)))
        zero = np.zeros_like(u)
        rows = np.concatenate([np.c_[u, zero, -v[:, :1] * u], np.c_[zero, u, -v[:, 1:2] * u]])
        _, s, w = np.linalg.svd(rows)
        if len(s) > 7 and s[7] < 1e-9 * s[0]:
            return None
        m = np.linalg.inv(tb) @ w[-1].reshape(3, 3) @ ta
        return m / m[2, 2] if abs(m[2, 2]) > 1e-12 else None
    m = np.eye(3)
    if kind == "affine":
        rows = np.c_[a, np.ones(len(a))]
        if np.linalg.matrix_rank(rows) < 3:
            return None
        m[:2] = np.linalg.lstsq(rows, b, rcond=None)[0].T
        return m
    za, zb = a[:, 0] + 1j * a[:, 1], b[:, 0] + 1j * b[:, 1]
    spread = (np.abs(za - za.mean()) ** 2).sum()
    if spread < 1e-12:
        return None
    z = ((zb - zb.mean()) * (za - za.mean()).conj()).sum() / spread
    w = zb.mean() - z * za.mean()
    m[:2] = [[z.real, -z.imag, w.real], [z.imag, z.real, w.imag]]
    return m


def moved_points(m: np.ndarray, p: np.ndarray) -> np.ndarray:
    z = np.c_[p, np.ones(len(p))] @ m.T
    with np.errstate(divide="ignore", invalid="ignore"):
        return z[:, :2] / z[:, 2:]


def find_transform(p: np.ndarray, q: np.ndarray, kind: str, least: int, tolerance: float, draws: int, seed: int) -> tuple:
    """(a, b, dx, c, d, dy, g, h, pairs); nulls and 0 if fewer than `least` pairs agree."""
    i, j = voted_pairs(p, q)
    need, best, rng = KINDS[kind], None, np.random.default_rng(seed)
    if len(i) >= max(need, least):
        a, b = p[i], q[j]
        for _ in range(draws):
            some = rng.choice(len(a), need, replace=False)
            m = fitted_matrix(a[some], b[some], kind)
            if m is None:
                continue
            on = np.hypot(*(moved_points(m, a) - b).T) <= tolerance
            if best is None or on.sum() > best[1].sum():
                best = (m, on)
                if on.all():
                    break
    if best is None or best[1].sum() < max(need, least):
        return (None,) * 8 + (0,)
    m, on = best
    for _ in range(5):  # all stars that the transform brings together, until they stay the same
        apart = np.hypot(*(moved_points(m, p)[:, None] - q[None]).transpose(2, 0, 1))
        to = apart.argmin(axis=1)
        pairs = np.flatnonzero((apart[np.arange(len(p)), to] <= tolerance) & (apart.argmin(axis=0)[to] == np.arange(len(p))))
        new = fitted_matrix(p[pairs], q[to[pairs]], kind) if len(pairs) >= max(need, least) else None
        if new is None or np.allclose(new, m, rtol=0, atol=1e-12):
            break
        m = new
    return (*m[0], *m[1], m[2, 0], m[2, 1], int(len(pairs)))


def apply_shifts(pixels: DataFrame, moves: DataFrame, framing: str = "current") -> DataFrame:
    """Whole-pixel shifts (frame_id, dx, dy taken off). framing: current (the frame's own size), min (area common to all), max (area of all)."""
    size = pixels.agg(F.max("x").alias("mx_"), F.max("y").alias("my_"))
    moved = pixels.join(moves, "frame_id").withColumns({"x": (F.col("x") - F.col("dx")).cast("int"), "y": (F.col("y") - F.col("dy")).cast("int")}).drop("dx", "dy")
    if framing == "max":
        low = moved.agg(F.min("x").alias("x_"), F.min("y").alias("y_"))
        return moved.crossJoin(F.broadcast(low)).withColumns({"x": F.col("x") - F.col("x_"), "y": F.col("y") - F.col("y_")}).select(*pixels.columns)  # one row
    if framing == "min":
        bounds = moved.groupBy("frame_id").agg(F.min("x").alias("a"), F.min("y").alias("b"), F.max("x").alias("c"), F.max("y").alias("d")).agg(F.max("a").alias("a"), F.max("b").alias("b"), F.min("c").alias("c"), F.min("d").alias("d"))
        inside = moved.crossJoin(F.broadcast(bounds)).where("x between a and c and y between b and d")  # one row
        return inside.withColumns({"x": F.col("x") - F.col("a"), "y": F.col("y") - F.col("b")}).select(*pixels.columns)
    return moved.crossJoin(F.broadcast(size)).where("x between 0 and mx_ and y between 0 and my_").select(*pixels.columns)


def _placed(x: Column, y: Column) -> tuple[Column, Column]:
    """Where a frame's point comes to lie, by the transform's columns."""
    w = F.col("g") * x + F.col("h") * y + 1
    return (F.col("a") * x + F.col("b") * y + F.col("dx")) / w, (F.col("c") * x + F.col("d") * y + F.col("dy")) / w


def _full(transforms: DataFrame) -> DataFrame:
    """Transforms that there are, with projective terms (0 if the table has none)."""
    terms = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in transforms.columns else F.lit(0.0).alias(c) for c in "gh"]
    return transforms.where("a is not null").select("frame_id", "a", "b", "dx", "c", "d", "dy", *terms)


def framings(pixels: DataFrame, transforms: DataFrame, framing: str, reference: str | None = None) -> DataFrame:
    """(frame_id, x0, y0, w, h): the window of the reference's coordinates that each frame is resampled into, the same for all.

    current: the reference frame's size (the largest size, without one); max: all that any frame covers; min: what all
    cover for certain (the inner box of their corners); cog: of the size of `current`, about the mean of the frames' centres.
    """
    size = pixels.groupBy("frame_id").agg((F.max("x") + 1).alias("fw"), (F.max("y") + 1).alias("fh"))
    t = _full(transforms).join(size, "frame_id")
    corner = lambda cx, cy: F.struct(*[v.alias(n) for v, n in zip(_placed((F.col("fw") - 1) * cx, (F.col("fh") - 1) * cy), "xy")])
    t = t.withColumns({"tl": corner(0.0, 0.0), "tr": corner(1.0, 0.0), "bl": corner(0.0, 1.0), "br": corner(1.0, 1.0), "mid": corner(0.5, 0.5)})
    xs, ys = ([F.col(f"{c}.{n}") for c in ("tl", "tr", "bl", "br")] for n in "xy")
    whole = F.max(F.struct((F.col("frame_id") == reference).cast("int"), F.col("fw"), F.col("fh"))) if reference else F.max(F.struct(F.lit(0), "fw", "fh"))
    sort4 = lambda v, k: F.array_sort(F.array(*v))[k]
    ends = t.agg(
        whole.alias("s"), F.min(F.least(*xs)).alias("ax"), F.max(F.greatest(*xs)).alias("bx"), F.min(F.least(*ys)).alias("ay"), F.max(F.greatest(*ys)).alias("by"),
        F.max(sort4(xs, 1)).alias("ix"), F.min(sort4(xs, 2)).alias("jx"), F.max(sort4(ys, 1)).alias("iy"), F.min(sort4(ys, 2)).alias("jy"), F.avg("mid.x").alias("mx"), F.avg("mid.y").alias("my"),
    )
    near = lambda c: F.round(F.col(c), 6)  # noqa: E731  borders that are whole but for rounding
    box = {
        "current": (F.lit(0), F.lit(0), F.col("s.fw"), F.col("s.fh")),
        "max": (F.floor(near("ax")), F.floor(near("ay")), F.ceil(near("bx")) - F.floor(near("ax")) + 1, F.ceil(near("by")) - F.floor(near("ay")) + 1),
        "min": (F.ceil(near("ix")), F.ceil(near("iy")), F.greatest(F.floor(near("jx")) - F.ceil(near("ix")) + 1, F.lit(0)), F.greatest(F.floor(near("jy")) - F.ceil(near("iy")) + 1, F.lit(0))),
        "cog": (F.round(F.col("mx") - (F.col("s.fw") - 1) / 2), F.round(F.col("my") - (F.col("s.fh") - 1) / 2), F.col("s.fw"), F.col("s.fh")),
    }[framing]
    window = ends.select(*[c.cast("int").alias(n) for c, n in zip(box, ("x0", "y0", "w", "h"))])
    return t.select("frame_id").crossJoin(F.broadcast(window))  # one row


#: How far the kernels reach, in pixels of the frame.
REACH = {"nearest": 1, "linear": 1, "cubic": 2, "lanczos4": 4}


def apply_transforms(pixels: DataFrame, transforms: DataFrame, how: str = "linear", clamp: bool = True, framing: str = "current", reference: str | None = None, side: int = 512) -> DataFrame:
    """Frames resampled into the reference's coordinates (nearest, linear, cubic or lanczos4); frames without a transform are left out.

    The window (framings()) begins at 0, 0. Work goes by tiles of the window: a pixel goes to the tiles that it may have a part in, so no
    task holds a frame. Where a kernel meets no pixel the place stays empty. clamp: a value stays within those its kernel meets.
    """
    window = framings(pixels, transforms, framing, reference)
    joined = pixels.select("frame_id", "channel", "y", "x", "v").join(_full(transforms), "frame_id").join(window.withColumnRenamed("h", "height"), "frame_id")
    px, py = _placed(F.col("x"), F.col("y"))
    # how far a step of one pixel leads in the window, over the whole of the pixel's surroundings
    right, down, left, up = _placed(F.col("x") + 1, F.col("y")), _placed(F.col("x"), F.col("y") + 1), _placed(F.col("x") - 1, F.col("y")), _placed(F.col("x"), F.col("y") - 1)
    step = F.greatest(*[F.hypot(a - px, b - py) for a, b in (right, down, left, up)])
    placed = joined.withColumns({"px": px - F.col("x0"), "py": py - F.col("y0"), "r": step * (REACH[how] * 2) + 1})
    tiles = lambda c, n: F.filter(F.sequence(F.floor((F.col(c) - F.col("r")) / side), F.floor((F.col(c) + F.col("r")) / side)), lambda t: (t >= 0) & (t * side < F.col(n)))
    dealt = placed.withColumn("ty", F.explode(tiles("py", "height"))).withColumn("tx", F.explode(tiles("px", "w"))).drop("px", "py", "r")

    def warp(pdf: pd.DataFrame) -> pd.DataFrame:
        t = pdf.iloc[0]
        back = np.linalg.inv(np.array([[t.a, t.b, t.dx], [t.c, t.d, t.dy], [t.g, t.h, 1]]))
        ys, xs = np.arange(t.ty * side, min((t.ty + 1) * side, t.height)), np.arange(t.tx * side, min((t.tx + 1) * side, t.w))
        gx, gy = np.meshgrid(xs + t.x0, ys + t.y0)
        at = moved_points(back, np.c_[gx.ravel(), gy.ravel()])
        y0, x0 = int(pdf.y.min()), int(pdf.x.min())
        image = np.full((int(pdf.y.max()) - y0 + 1, int(pdf.x.max()) - x0 + 1), np.nan)
        image[pdf.y - y0, pdf.x - x0] = pdf.v
        out = interpolated(image, at[:, 1].reshape(gx.shape) - y0, at[:, 0].reshape(gx.shape) - x0, how, clamp)
        y, x = np.nonzero(~np.isnan(out))
        return pd.DataFrame({"frame_id": t.frame_id, "channel": t.channel, "y": (ys[y]).astype("int32"), "x": (xs[x]).astype("int32"), "v": out[y, x]})

    return dealt.groupBy("frame_id", "channel", "ty", "tx").applyInPandas(warp, PIXELS)


def interpolated(image: np.ndarray, y: np.ndarray, x: np.ndarray, how: str, clamp: bool = True) -> np.ndarray:
    """Values at fractional places from the pixels there are: kernels are normed by the weights they meet; NaN without the nearest pixel or half of the kernel's weight."""
    h, w = image.shape

    def at(yi, xi):
        inside = (yi >= 0) & (yi < h) & (xi >= 0) & (xi < w)
        return np.where(inside, image[np.clip(yi, 0, h - 1), np.clip(xi, 0, w - 1)], np.nan)

    y, x = np.nan_to_num(y, nan=-1e6, posinf=-1e6, neginf=-1e6), np.nan_to_num(x, nan=-1e6, posinf=-1e6, neginf=-1e6)
    nearest = at(np.rint(y - 1e-9).astype(int), np.rint(x - 1e-9).astype(int))
    if how == "nearest":
        return nearest
    k = {"linear": (lambda t: np.clip(1 - np.abs(t), 0, None), 0, 2), "cubic": (lambda t: _kernel(t, "cubic"), -1, 3), "lanczos4": (lambda t: np.where(np.abs(t) < 4, np.sinc(t) * np.sinc(t / 4), 0), -3, 5)}[how]
    yi, xi = np.floor(y).astype(int), np.floor(x).astype(int)
    total, weight, low, high = np.zeros(y.shape), np.zeros(y.shape), np.full(y.shape, np.inf), np.full(y.shape, -np.inf)
    for i in range(k[1], k[2]):
        for j in range(k[1], k[2]):
            v, kernel = at(yi + i, xi + j), k[0](y - yi - i) * k[0](x - xi - j)
            there = ~np.isnan(v)
            total += np.where(there, v * kernel, 0)
            weight += np.where(there, kernel, 0)
            used = there & (kernel != 0)
            low, high = np.where(used, np.fmin(low, v), low), np.where(used, np.fmax(high, v), high)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.where((weight > 0.499) & ~np.isnan(nearest), total / weight, np.nan)
    return np.clip(out, low, high) if clamp else out


def drizzle(pixels: DataFrame, transforms: DataFrame, scale: float = 2.0, pixfrac: float = 1.0) -> DataFrame:
    """Each pixel dropped on the finer grid as a shrunken square (its centre's cell and those it overlaps), weighted by overlap: (channel, y, x, v, w)."""
    t = transforms.where("a is not null")
    half = pixfrac / 2
    at = pixels.join(t, "frame_id").select("channel", "v", ((F.col("a") * F.col("x") + F.col("b") * F.col("y") + F.col("dx")) * scale).alias("u"), ((F.col("c") * F.col("x") + F.col("d") * F.col("y") + F.col("dy")) * scale).alias("t"))
    size = half * scale
    cells = lambda c: F.explode(F.sequence(F.floor(F.col(c) - size + 0.5).cast("int"), F.floor(F.col(c) + size + 0.499999).cast("int")))
    spread = at.withColumn("x", cells("u")).withColumn("y", cells("t"))
    over = lambda c, k: F.greatest(F.least(F.col(c) + size, F.col(k) + 0.5) - F.greatest(F.col(c) - size, F.col(k) - 0.5), F.lit(0.0))
    w = over("u", "x") * over("t", "y")
    return spread.withColumn("w", w).where("w > 0").groupBy("channel", "y", "x").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("v"), F.sum("w").alias("w"))
