"""Photometry of stars: apertures, profile fits, and light curves over frames.

A star's surroundings are a bounded box of pixels, found by an equi-join of the cells that the box touches with the pixels'. Profile fits
are Levenberg-Marquardt steps for all stars of an Arrow batch at once. Stars of different frames are one star where
their positions on the sky meet the same catalogue star.
Tables: stars (frame_id, channel, star, x, y), pixels (frame_id, channel, y, x, v).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .astrometry import sky_pairs

STAR = ("frame_id", "channel", "star")
#: Stars that are fitted at once: their boxes and derivatives take some ten MB.
CHUNK = 500
FIT = (
    "frame_id string, channel int, star string, x double, y double, background double, amplitude double, fwhm_x double, fwhm_y double, angle double, beta double, "
    "flux double, rmse double, rounds int"
)


def surroundings(stars: DataFrame, pixels: DataFrame, radius: int) -> DataFrame:
    """(frame_id, channel, star, cx, cy, y, x, v): the pixels of the square box of `radius` about each star."""
    side, at = 2 * radius + 1, lambda c: F.round(F.col(c)).cast("int")
    # a box touches four cells of its own size at most, so a star is four rows and not one for each pixel
    reach = lambda c: F.explode(F.sequence(F.floor((at(c) - radius) / side), F.floor((at(c) + radius) / side)))
    boxes = stars.where("x is not null and y is not null").select(*STAR, F.col("x").alias("cx"), F.col("y").alias("cy")).withColumn("ty_", reach("cy")).withColumn("tx_", reach("cx"))
    placed = pixels.select("frame_id", "channel", "y", "x", "v", F.floor(F.col("y") / side).alias("ty_"), F.floor(F.col("x") / side).alias("tx_"))
    inside = F.col("y").between(at("cy") - radius, at("cy") + radius) & F.col("x").between(at("cx") - radius, at("cx") + radius)
    # pixels may be exploded from few rows, which the planner would take for a small table: never sent to all
    return boxes.join(placed.hint("merge"), ["frame_id", "channel", "ty_", "tx_"]).where(inside).select(*STAR, "cx", "cy", "y", "x", "v")


def apertures(stars: DataFrame, pixels: DataFrame, radius: float = 5.0, inner: float = 8.0, outer: float = 12.0, gain: float = 1.0) -> DataFrame:
    """(frame_id, channel, star, n, background, flux, mag, snr): pixels whose centres lie within `radius`, less the median of the ring inner < r <= outer.

    mag: -2.5 log10(flux), null for a flux that isn't positive. snr: flux over the noise of its electrons and of
    the sky's spread. A star without ring has background null and no flux.
    """
    near = surroundings(stars, pixels, math.ceil(outer)).withColumn("r", F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")))
    own, ring = F.col("r") <= radius, (F.col("r") > inner) & (F.col("r") <= outer)
    sums = near.groupBy(*STAR).agg(F.count(F.when(own, F.col("v"))).alias("n"), F.sum(F.when(own, F.col("v"))).alias("sum_"), F.median(F.when(ring, F.col("v"))).alias("background"), F.stddev_samp(F.when(ring, F.col("v"))).alias("sd_"))
    flux = F.col("sum_") - F.col("n") * F.col("background")
    found = sums.withColumn("flux", flux)
    mag = F.when(F.col("flux") > 0, -2.5 * F.log10("flux"))
    noise = F.sqrt(F.greatest(F.col("flux"), F.lit(0.0)) / gain + F.col("n") * F.col("sd_") * F.col("sd_"))
    return found.select(*STAR, "n", "background", "flux", mag.alias("mag"), (F.col("flux") / F.nullif(noise, F.lit(0.0))).alias("snr"))


def _model(p: np.ndarray, x: np.ndarray, y: np.ndarray, moffat: bool) -> np.ndarray:
    """Values of profiles with parameters (n, 7 or 8): background, amplitude, x, y, log widths, angle, log beta."""
    b, a, cx, cy, sx, sy, t = (p[:, k : k + 1] for k in range(7))
    dx, dy = x - cx, y - cy
    u, v = (np.cos(t) * dx + np.sin(t) * dy) / np.exp(sx), (np.cos(t) * dy - np.sin(t) * dx) / np.exp(sy)
    r2 = u * u + v * v
    return b + a * ((1 + r2) ** -np.exp(p[:, 7:8]) if moffat else np.exp(-0.5 * r2))


def fit_profiles(x: np.ndarray, y: np.ndarray, v: np.ndarray, moffat: bool = False, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(parameters, rmse, rounds) of n stars with m pixels each, by Levenberg-Marquardt with a damping for each star. NaN values carry no weight."""
    there = ~np.isnan(v)
    val = np.where(there, v, 0)
    base = np.nanmedian(v, axis=1)
    top = np.nanmax(v, axis=1)
    weight = np.clip(np.where(there, v - base[:, None], 0), 0, None) + 1e-12
    cx, cy = ((weight * c).sum(axis=1) / weight.sum(axis=1) for c in (x, y))
    width = np.sqrt(np.clip((weight * ((x - cx[:, None]) ** 2 + (y - cy[:, None]) ** 2)).sum(axis=1) / weight.sum(axis=1) / 2, 0.25, None))
    p = np.stack([base, top - base, cx, cy, np.log(width), np.log(width * 0.95), np.zeros(len(v)), *([np.full(len(v), math.log(3.0))] if moffat else [])], axis=1)
    damping, used = np.full(len(v), 1e-3), np.zeros(len(v), dtype=int)
    rest = lambda q: np.where(there, val - _model(q, x, y, moffat), 0)
    error = (rest(p) ** 2).sum(axis=1)
    moving = np.ones(len(v), dtype=bool)
    for k in range(rounds):
        if not moving.any():
            break
        r = rest(p)
        jac = np.empty((*v.shape, p.shape[1]))
        for j in range(p.shape[1]):
            h = 1e-6 * np.maximum(1, np.abs(p[:, j]))
            q = p.copy()
            q[:, j] += h
            jac[:, :, j] = np.where(there, (_model(q, x, y, moffat) - _model(p, x, y, moffat)) / h[:, None], 0)
        normal = np.einsum("nmi,nmj->nij", jac, jac)
        slope = np.einsum("nmi,nm->ni", jac, r)
        scale = np.einsum("nii->ni", normal)
        damped = normal + (damping[:, None] * scale + 1e-12)[:, :, None] * np.eye(p.shape[1])
        step = np.linalg.solve(damped, slope[:, :, None])[:, :, 0]
        new = p + np.clip(step, -5, 5) if not np.isfinite(step).all() else p + step
        new[:, 4:6] = np.clip(new[:, 4:6], math.log(0.2), math.log(50))
        if moffat:
            new[:, 7] = np.clip(new[:, 7], math.log(1.05), math.log(20))
        now = (rest(new) ** 2).sum(axis=1)
        better = moving & (now < error)
        used[moving] = k + 1
        still = better & (error - now <= 1e-14 * error)
        p[better], error[better] = new[better], now[better]
        damping = np.where(better, damping / 5, damping * 5)
        moving &= ~still & (damping < 1e10)
    return p, np.sqrt(error / np.maximum(there.sum(axis=1), 1)), used


def profiles(stars: DataFrame, pixels: DataFrame, radius: int = 6, moffat: bool = False) -> DataFrame:
    """A Gaussian or Moffat profile for each star: centre, background, amplitude, widths at half height (the larger one first), angle of the larger from x in degrees, flux, rmse.

    beta is null for a Gaussian; a Moffat's flux is its integral (beta above 1). Stars with fewer pixels than twice the parameters are left out.
    """
    near = surroundings(stars, pixels, radius)
    boxes = near.groupBy(*STAR).agg(F.array_sort(F.collect_list(F.struct("y", "x", "v"))).alias("p")).where(F.size("p") >= 16)  # a box of bounded size

    def fit(batches):
        for b in (whole.slice(k, CHUNK) for whole in batches for k in range(0, len(whole), CHUNK)):
            p = b.column("p")
            flat, size = p.flatten(), np.diff(p.offsets.to_numpy())
            at = np.repeat(np.arange(len(b)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            x, y, v = (np.full((len(b), size.max()), 0.0 if c != "v" else np.nan) for c in "xyv")
            for name, to in (("x", x), ("y", y), ("v", v)):
                to[at] = flat.field(name).cast(pa.float64()).to_numpy(zero_copy_only=False)
            x0, y0 = x[:, :1].copy(), y[:, :1].copy()
            q, rmse, used = fit_profiles(x - x0, y - y0, v, moffat)
            beta = np.exp(q[:, 7]) if moffat else np.full(len(q), np.nan)
            half = 2 * np.sqrt(2 ** (1 / beta) - 1) if moffat else np.full(len(q), 2 * math.sqrt(2 * math.log(2)))
            sx, sy = np.exp(q[:, 4]), np.exp(q[:, 5])
            angle = np.degrees(q[:, 6]) + np.where(sx >= sy, 0, 90)
            area = np.pi * sx * sy / (beta - 1) if moffat else 2 * np.pi * sx * sy
            number = lambda a: pa.array(a, pa.float64(), from_pandas=True)  # noqa: E731  NaN: null
            made = {
                "x": q[:, 2] + x0[:, 0], "y": q[:, 3] + y0[:, 0], "background": q[:, 0], "amplitude": q[:, 1],
                "fwhm_x": half * np.maximum(sx, sy), "fwhm_y": half * np.minimum(sx, sy), "angle": (angle + 90) % 180 - 90, "beta": beta, "flux": q[:, 1] * area, "rmse": rmse,
            }
            keys = [b.column(c) for c in STAR]
            yield pa.RecordBatch.from_arrays([*keys, *map(number, made.values()), pa.array(used.astype("int32"))], names=[*STAR, *made, "rounds"])

    return boxes.select("frame_id", "channel", F.col("star").cast("string").alias("star"), "p").mapInArrow(fit, FIT)


def identified(measures: DataFrame, catalogue: DataFrame, radius: float) -> DataFrame:
    """measures (frame_id, star, ra, dec, ...) with star_id and apart: of the catalogue's stars within `radius` degrees the nearest. A catalogue star is taken once in a frame, by the nearest measure; others have none and are left out."""
    near = sky_pairs(measures, catalogue.select("star_id", "ra", "dec"), radius).drop("right_ra", "right_dec")
    mine = F.row_number().over(W.partitionBy("frame_id", "star").orderBy("apart", "star_id"))
    its = F.row_number().over(W.partitionBy("frame_id", "star_id").orderBy("apart", "star"))
    return near.withColumn("a_", mine).where("a_ = 1").withColumn("b_", its).where("b_ = 1").drop("a_", "b_")


def light_curves(measures: DataFrame, comparison: DataFrame, least: int = 1) -> DataFrame:
    """(star_id, n, mean, spread, curve): each star's magnitudes over the frames, curve an array of (time, mag).

    measures: (frame_id, time, star_id, mag); comparison: (star_id, mag) of stars whose brightness is known. A frame's zero point is the
    median of known less measured magnitudes; frames with fewer than `least` comparison stars are left out. Null magnitudes are no measures.
    """
    known = measures.where("mag is not null").join(comparison.select("star_id", F.col("mag").alias("known")), "star_id")
    zero = known.groupBy("frame_id").agg(F.median(F.col("known") - F.col("mag")).alias("zero"), F.count(F.lit(1)).alias("n_")).where(F.col("n_") >= least)
    put = measures.where("mag is not null").join(zero, "frame_id").select("star_id", "time", (F.col("mag") + F.col("zero")).alias("mag"))
    return put.groupBy("star_id").agg(F.count(F.lit(1)).alias("n"), F.avg("mag").alias("mean"), F.stddev_samp("mag").alias("spread"), F.array_sort(F.collect_list(F.struct("time", "mag"))).alias("curve"))
