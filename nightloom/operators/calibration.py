"""Calibration of light frames, cosmetic correction and background removal."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from .astrometry import sky_pairs
from .geometry import PIXELS

PLACE = ["channel", "y", "x"]


def calibrate(lights: DataFrame, bias: DataFrame | None = None, dark: DataFrame | None = None, flat: DataFrame | None = None, dark_factor: float = 1.0, equalize_cfa: bool = False) -> DataFrame:
    """(light - bias - k dark) / (flat / mean flat) by pixel; masters are images (channel, y, x, v).

    equalize_cfa: the flat is normalised for each site of the colour filter array instead of as a whole.
    A master is one image joined to many frames, so the join is on the pixel's place.
    """
    out, v = lights, F.col("v")
    if bias is not None:
        out, v = out.join(bias.select(*PLACE, F.col("v").alias("bias_")), PLACE), v - F.col("bias_")
    if dark is not None:
        out, v = out.join(dark.select(*PLACE, F.col("v").alias("dark_")), PLACE), v - dark_factor * F.col("dark_")
    if flat is not None:
        site = [(F.col("y") % 2).alias("sy_"), (F.col("x") % 2).alias("sx_")] if equalize_cfa else []
        f = flat.select(*PLACE, F.col("v").alias("flat_"), *site)
        mean = f.groupBy("channel", *(["sy_", "sx_"] if equalize_cfa else [])).agg(F.avg("flat_").alias("mean_"))
        f = f.join(mean, ["channel", *(["sy_", "sx_"] if equalize_cfa else [])]).select(*PLACE, (F.col("flat_") / F.nullif(F.col("mean_"), F.lit(0.0))).alias("flat_"))
        out, v = out.join(f, PLACE), F.coalesce(v / F.nullif(F.col("flat_"), F.lit(0.0)), v)
    return out.withColumn("v", v).select(*lights.columns)


def dark_factors(lights: DataFrame, dark: DataFrame, exposures: DataFrame | None = None, dark_exposure: float | None = None) -> DataFrame:
    """(frame_id, k): the dark's factor for each frame, by exposures, or the regression of light on dark (least noise)."""
    if exposures is not None:
        return exposures.select("frame_id", (F.col("exposure") / dark_exposure).alias("k"))
    return lights.join(dark.select(*PLACE, F.col("v").alias("d_")), PLACE).groupBy("frame_id").agg(F.coalesce(F.regr_slope("v", "d_"), F.lit(0.0)).alias("k"))


def bad_pixels(dark: DataFrame, low: float | None = 3.0, high: float | None = 3.0) -> DataFrame:
    """(channel, y, x) of a dark's pixels beyond so many sigma of its median (None: that side is left alone)."""
    stats = dark.groupBy("channel").agg(F.median("v").alias("m"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("s"))
    test = F.lit(False)
    if low is not None:
        test |= F.col("v") < F.col("m") - low * F.col("s")
    if high is not None:
        test |= F.col("v") > F.col("m") + high * F.col("s")
    return dark.join(stats, "channel").where(test).select(*PLACE)


def neighbourhood(radius: int, step: int = 1):
    """An array of the offsets around a pixel, itself left out."""
    n = [(a * step, b * step) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if a or b]
    return F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in n])


def cosmetic(pixels: DataFrame, bad: DataFrame, cfa: bool = False) -> DataFrame:
    """Bad pixels become the median of their good neighbours (of the same CFA site, if cfa)."""
    step = 2 if cfa else 1
    marked = pixels.join(bad.withColumn("bad_", F.lit(True)), PLACE, "left")
    wanted = marked.where("bad_").select("frame_id", *PLACE, F.explode(neighbourhood(1, step)).alias("d"))
    near = wanted.select("frame_id", "channel", F.col("y").alias("by"), F.col("x").alias("bx"), (F.col("y") + F.col("d.a")).alias("y"), (F.col("x") + F.col("d.b")).alias("x"))
    good = marked.where("bad_ is null").select("frame_id", *PLACE, "v")
    new = near.join(good, ["frame_id", *PLACE]).groupBy("frame_id", "channel", F.col("by").alias("y"), F.col("bx").alias("x")).agg(F.median("v").alias("new_"))
    return pixels.join(new, ["frame_id", *PLACE], "left").withColumn("v", F.coalesce("new_", "v")).select(*pixels.columns)


def median_filter(pixels: DataFrame, radius: int = 1) -> DataFrame:
    """Each pixel the median of its square neighbourhood, as far as it lies in the frame."""
    around = F.concat(neighbourhood(radius), F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"))))
    given = pixels.select("frame_id", "channel", "y", "x", "v", F.explode(around).alias("d")).select("frame_id", "channel", (F.col("y") + F.col("d.a")).alias("y"), (F.col("x") + F.col("d.b")).alias("x"), "v")
    return given.groupBy("frame_id", *PLACE).agg(F.median("v").alias("v")).join(pixels.select("frame_id", *PLACE), ["frame_id", *PLACE], "left_semi")


def hot_pixels(pixels: DataFrame, k: float = 5.0) -> DataFrame:
    """(frame_id, channel, y, x) further than k sigma from the frame's median."""
    stats = pixels.groupBy("frame_id", "channel").agg(F.median("v").alias("m"), F.stddev_samp("v").alias("s"))
    return pixels.join(stats, ["frame_id", "channel"]).where(F.abs(F.col("v") - F.col("m")) > k * F.col("s")).select("frame_id", *PLACE)


def debayer(pixels: DataFrame, pattern: str = "RGGB") -> DataFrame:
    """Three channels of a mono CFA frame: own sites as they are, others the mean of the sites of that colour next to them."""
    around = F.concat(neighbourhood(1), F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"))))
    color = F.element_at(F.array(*[F.lit("RGB".index(c)) for c in pattern]), (F.col("y") % 2 * 2 + F.col("x") % 2 + 1).cast("int"))
    given = pixels.select("frame_id", color.alias("channel"), "y", "x", "v", F.explode(around).alias("d")).select(
        "frame_id", "channel", (F.col("y") + F.col("d.a")).alias("y"), (F.col("x") + F.col("d.b")).alias("x"), "v", ((F.col("d.a") == 0) & (F.col("d.b") == 0)).alias("own")
    )
    made = given.groupBy("frame_id", "channel", "y", "x").agg(F.max(F.when(F.col("own"), F.col("v"))).alias("o"), F.avg("v").alias("m"))
    return made.join(pixels.select("frame_id", "y", "x"), ["frame_id", "y", "x"], "left_semi").select("frame_id", "channel", "y", "x", F.coalesce("o", "m").alias("v"))


def equalize_sites(pixels: DataFrame) -> DataFrame:
    """CFA sites scaled to a common median (grey flat)."""
    key = [(F.col("y") % 2).alias("sy"), (F.col("x") % 2).alias("sx")]
    p = pixels.select("*", *key)
    med = p.groupBy("frame_id", "channel", "sy", "sx").agg(F.median("v").alias("m"))
    whole = med.withColumn("all", F.avg("m").over(W.partitionBy("frame_id", "channel")))
    return p.join(whole, ["frame_id", "channel", "sy", "sx"]).withColumn("v", F.coalesce(F.col("v") * F.col("all") / F.nullif(F.col("m"), F.lit(0.0)), F.col("v"))).select(*pixels.columns)


def background_samples(pixels: DataFrame, samples: int = 20, tolerance: float = 1.0) -> DataFrame:
    """A grid of `samples` places along the longer side, without those above median + tolerance * MAD."""
    size = pixels.groupBy("frame_id", "channel").agg(F.greatest(F.max("x"), F.max("y")).alias("n"), F.median("v").alias("m"))
    step = F.greatest(F.floor((F.col("n") + 1) / samples), F.lit(1))
    grid = pixels.join(size, ["frame_id", "channel"]).where((F.col("x") % step == F.floor(step / 2)) & (F.col("y") % step == F.floor(step / 2)))
    mad = grid.groupBy("frame_id", "channel").agg(F.median(F.abs(F.col("v") - F.col("m"))).alias("mad"))
    return grid.join(mad, ["frame_id", "channel"]).where(F.col("v") <= F.col("m") + tolerance * F.col("mad")).select("frame_id", "channel", "y", "x", "v")


def _terms(y: np.ndarray, x: np.ndarray, degree: int) -> np.ndarray:
    return np.stack([x**i * y**j for i in range(degree + 1) for j in range(degree + 1 - i)], axis=1)


def subtract_background(pixels: DataFrame, degree: int | None = 1, samples: int = 20, tolerance: float = 1.0, smooth: float = 0.5) -> DataFrame:
    """A polynomial of `degree` (None: thin-plate splines with smoothing) through the samples, less its mean, taken off each frame.

    Samples are a bounded grid for each frame; they are fitted frame by frame, and polynomials are
    evaluated as columns.
    """
    grid = background_samples(pixels, samples, tolerance)
    scale = pixels.groupBy("frame_id", "channel").agg(F.greatest(F.max("x"), F.max("y"), F.lit(1)).cast("double").alias("n"))
    if degree is None:
        centres = grid.groupBy("frame_id", "channel").agg(F.collect_list(F.struct("y", "x", "v")).alias("s"))  # a bounded grid

        def spline(pdf: pd.DataFrame) -> pd.DataFrame:
            s = pdf.s.iloc[0]
            at = np.array([(p["y"], p["x"]) for p in s], dtype=float)
            val = np.array([p["v"] for p in s])
            n = len(at)
            kernel = lambda a, b: (lambda d: d**2 * np.log(d + 1e-12))(np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1)))
            ones = np.c_[np.ones(n), at]
            left = np.block([[kernel(at, at) + smooth * n * np.eye(n), ones], [ones.T, np.zeros((3, 3))]])
            w = np.linalg.lstsq(left, np.r_[val, 0, 0, 0], rcond=None)[0]
            to = np.c_[pdf.y, pdf.x].astype(float)
            level = kernel(to, at) @ w[:n] + np.c_[np.ones(len(to)), to] @ w[n:]
            return pdf.assign(v=pdf.v - level + level.mean())[["frame_id", "channel", "y", "x", "v"]]

        return pixels.select("frame_id", *PLACE, "v").join(centres, ["frame_id", "channel"]).groupBy("frame_id", "channel").applyInPandas(spline, PIXELS)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        n = pdf.n.iloc[0]
        terms = _terms(pdf.y.to_numpy() / n, pdf.x.to_numpy() / n, degree)
        return pd.DataFrame({"frame_id": pdf.frame_id.iloc[:1], "channel": pdf.channel.iloc[:1], "k": [np.linalg.lstsq(terms, pdf.v, rcond=None)[0].tolist()]})

    fits = grid.join(scale, ["frame_id", "channel"]).groupBy("frame_id", "channel").applyInPandas(fit, "frame_id string, channel int, k array<double>")
    powers = [(i, j) for i in range(degree + 1) for j in range(degree + 1 - i)]
    level = sum((F.col("k")[t] * F.pow(F.col("x") / F.col("n"), F.lit(i)) * F.pow(F.col("y") / F.col("n"), F.lit(j)) for t, (i, j) in enumerate(powers)), F.lit(0.0))
    leveled = pixels.join(fits, ["frame_id", "channel"]).join(scale, ["frame_id", "channel"]).withColumn("b_", level)
    mean = leveled.groupBy("frame_id", "channel").agg(F.avg("b_").alias("mean_"))
    return leveled.join(mean, ["frame_id", "channel"]).withColumn("v", F.col("v") - F.col("b_") + F.col("mean_")).select(*pixels.columns)


def color_balance(pixels: DataFrame, stars: DataFrame, catalogue: DataFrame, radius: float) -> DataFrame:
    """Photometric colour calibration: stars (frame_id, ra, dec, r, g, b) are matched with a catalogue (ra, dec, cr, cg, cb) of expected fluxes
    within radius degrees; each channel is scaled by the median ratio (green 1) about its background. Frames without matches stay."""
    near = sky_pairs(stars, catalogue.select("ra", "dec", "cr", "cg", "cb"), radius)
    k = near.groupBy("frame_id").agg(*[F.median(F.col(f"c{c}") / F.nullif(F.col(c), F.lit(0.0))).alias(f"k{c}") for c in "rgb"])
    factors = k.select("frame_id", F.posexplode(F.array(*[F.col(f"k{c}") / F.col("kg") for c in "rgb"])).alias("channel", "k"))
    bg = pixels.groupBy("frame_id", "channel").agg(F.median("v").alias("bg"))
    return pixels.join(factors, ["frame_id", "channel"], "left").join(bg, ["frame_id", "channel"]).withColumn("v", (F.col("v") - F.col("bg")) * F.coalesce("k", F.lit(1.0)) + F.col("bg")).select(*pixels.columns)
