"""Frequencies and scales of frames: distributed Fourier transforms, banding, wavelets, denoising, deconvolution, local contrast.

A two-dimensional transform is a transform of every row, a transposition by shuffle, and a transform of every column:
what one task holds is rows, never a frame. Neighbourhoods go by tiles with halos.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .settle import settled
from .tiles import SIDE, convolved, over_tiles, shifted

FRAME = ("frame_id", "channel")
#: Gains of the noise in the planes of the B3 spline wavelet, for noise of one in the image.
PLANE_NOISE = (0.889, 0.200, 0.086, 0.041, 0.020, 0.010)


# ---- Fourier transforms -----------------------------------------------------------------------------
def _line(at: pd.Series, re: pd.Series, im: pd.Series, n: pd.Series, sign: pd.Series) -> pd.DataFrame:
    """The transform of each row's values at places `at` of 0 .. n - 1 (missing ones count as 0); sign 1: forward, -1: back."""
    out = []
    for a, r, i, size, s in zip(at, re, im, n, sign):
        line = np.zeros(size, dtype=complex)
        line[np.asarray(a)] = np.asarray(r) + 1j * np.asarray(i)
        out.append(np.fft.fft(line) if s > 0 else np.fft.ifft(line))
    return pd.DataFrame({"re": [z.real for z in out], "im": [z.imag for z in out]})


def _along(rows: DataFrame, across: str, along: str, size: str, sign: int) -> DataFrame:
    """(frame, across, along, re, im, h, w): each line of equal `across` transformed over `along`."""
    lines = rows.groupBy(*FRAME, across, "h", "w").agg(F.collect_list(F.struct(along, "re", "im")).alias("l"))
    done = lines.withColumn("t", F.pandas_udf(_line, "struct<re: array<double>, im: array<double>>")(F.col("l")[along], F.col("l")["re"], F.col("l")["im"], F.col(size), F.lit(sign)))
    return done.select(*FRAME, across, "h", "w", F.posexplode(F.arrays_zip(F.col("t.re").alias("re"), F.col("t.im").alias("im"))).alias(along, "z")).select(*FRAME, across, along, "h", "w", "z.re", "z.im")


def fourier(pixels: DataFrame) -> DataFrame:
    """(frame_id, channel, y, x, re, im, h, w) of pixels: the two-dimensional transform, y and x being frequencies from 0. Missing pixels count as 0."""
    size = pixels.groupBy(*FRAME).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    rows = pixels.join(size, list(FRAME)).select(*FRAME, "y", "x", F.coalesce("v", F.lit(0.0)).alias("re"), F.lit(0.0).alias("im"), "h", "w")
    return _along(_along(rows, "y", "x", "w", 1), "x", "y", "h", 1).select(*FRAME, "y", "x", "re", "im", "h", "w")


def inverse(spectrum: DataFrame) -> DataFrame:
    """The image of a spectrum (frame_id, channel, y, x, re, im, h, w)."""
    rows = _along(_along(spectrum, "x", "y", "h", -1), "y", "x", "w", -1)
    return rows.select(*FRAME, "y", "x", F.col("re").alias("v"))


def spectrum(pixels: DataFrame, centred: bool = True) -> DataFrame:
    """(frame_id, channel, y, x, magnitude, phase); centred: frequency 0 in the middle (h // 2, w // 2)."""
    f = fourier(pixels)
    at = lambda c, n: F.pmod(F.col(c) + F.floor(F.col(n) / 2), F.col(n)).cast("int") if centred else F.col(c)
    return f.select(*FRAME, at("y", "h").alias("y"), at("x", "w").alias("x"), F.hypot("re", "im").alias("magnitude"), F.atan2("im", "re").alias("phase"))


def from_spectrum(spectra: DataFrame, centred: bool = True) -> DataFrame:
    """The image of magnitudes and phases."""
    size = spectra.groupBy(*FRAME).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    at = lambda c, n: F.pmod(F.col(c) - F.floor(F.col(n) / 2), F.col(n)).cast("int") if centred else F.col(c)
    s = spectra.join(size, list(FRAME))
    return inverse(s.select(*FRAME, at("y", "h").alias("y"), at("x", "w").alias("x"), (F.col("magnitude") * F.cos("phase")).alias("re"), (F.col("magnitude") * F.sin("phase")).alias("im"), "h", "w"))


def remove_banding(pixels: DataFrame, amount: float = 1.0, sigma: float = 1.0, vertical: bool = False) -> DataFrame:
    """Rows (columns, if vertical) shifted towards the frame's level: `amount` of the difference between a row's mean
    and the frame's, both over the background: pixels up to median + sigma * 1.4826 * MAD. Rows without background stay."""
    line = "x" if vertical else "y"
    med = pixels.groupBy(*FRAME).agg(F.median("v").alias("m_"))
    mad = pixels.join(med, list(FRAME)).groupBy(*FRAME, "m_").agg((1.4826 * F.median(F.abs(F.col("v") - F.col("m_")))).alias("s_"))
    low = pixels.join(mad, list(FRAME)).where(F.col("v") <= F.col("m_") + sigma * F.col("s_"))
    lines = low.groupBy(*FRAME, line).agg(F.sum("v").alias("t_"), F.count("v").alias("n_"))
    frame = W.partitionBy(*FRAME)
    off = lines.select(*FRAME, line, (F.col("t_") / F.col("n_") - F.sum("t_").over(frame) / F.sum("n_").over(frame)).alias("off_"))
    return pixels.join(off, [*FRAME, line], "left").withColumn("v", F.col("v") - amount * F.coalesce("off_", F.lit(0.0))).select(*pixels.columns)


# ---- wavelets ---------------------------------------------------------------------------------------
def _smooth(a: np.ndarray, step: int) -> np.ndarray:
    taps = ((-2, 1 / 16), (-1, 1 / 4), (0, 3 / 8), (1, 1 / 4), (2, 1 / 16))
    rows = sum(k * shifted(a, i * step, 0) for i, k in taps)
    return sum(k * shifted(rows, 0, i * step) for i, k in taps)


def wavelets(pixels: DataFrame, levels: int = 4, side: int = SIDE) -> DataFrame:
    """(frame_id, channel, plane, y, x, v): the à trous transform with the B3 spline. Planes 0 .. levels - 1 are details from fine to coarse, plane `levels` is the rest; their sum is the image."""

    def planes(arrays, y0, x0):
        out, now = [], arrays[0]
        for j in range(levels):
            soft = _smooth(now, 2**j)
            out.append(now - soft)
            now = soft
        return [*out, now]

    names = [f"p{j}" for j in range(levels + 1)]
    wide = over_tiles(pixels.select(*FRAME, "y", "x", "v"), planes, 2 * (2**levels - 1), outputs=names, side=side)
    return wide.select(*FRAME, "y", "x", F.posexplode(F.array(*names)).alias("plane", "v")).select(*FRAME, "plane", "y", "x", "v")


def recomposed(planes: DataFrame, weights: list[float] | None = None) -> DataFrame:
    """The sum of the planes, each times its weight (1 for planes without one)."""
    weight = F.lit(1.0) if weights is None else F.coalesce(F.get(F.array(*map(F.lit, weights)), F.col("plane")), F.lit(1.0))
    return planes.groupBy(*FRAME, "y", "x").agg(F.sum(F.col("v") * weight).alias("v"))


def denoised(pixels: DataFrame, k: float = 3.0, levels: int = 4, strength: float = 1.0, side: int = SIDE) -> DataFrame:
    """Details shrunk towards 0 by k times the plane's noise (soft threshold), `strength` of it. The noise of the image is 1.4826 * MAD of the finest plane over its gain."""
    planes = wavelets(pixels, levels, side)
    finest = planes.where("plane = 0").groupBy(*FRAME).agg((1.4826 / PLANE_NOISE[0] * F.median(F.abs("v"))).alias("noise"))
    gain = F.get(F.array(*map(F.lit, PLANE_NOISE)), F.least(F.col("plane"), F.lit(len(PLANE_NOISE) - 1)))
    limit = F.when(F.col("plane") < levels, F.col("noise") * gain * k).otherwise(0.0)
    soft = F.signum("v") * F.greatest(F.abs("v") - limit, F.lit(0.0))
    return recomposed(planes.join(finest, list(FRAME)).withColumn("v", F.col("v") * (1 - strength) + soft * strength))


# ---- deconvolution ----------------------------------------------------------------------------------
def gaussian_psf(fwhm: float, ratio: float = 1.0, angle: float = 0.0) -> np.ndarray:
    """An odd kernel of sum 1; ratio: of the minor to the major axis, angle: of the major axis from x, in degrees."""
    return _psf(fwhm, ratio, angle, lambda r2, s: np.exp(-r2 / (2 * s * s)), fwhm / (2 * math.sqrt(2 * math.log(2))))


def moffat_psf(fwhm: float, beta: float = 3.0, ratio: float = 1.0, angle: float = 0.0) -> np.ndarray:
    return _psf(fwhm, ratio, angle, lambda r2, s: (1 + r2 / (s * s)) ** -beta, fwhm / (2 * math.sqrt(2 ** (1 / beta) - 1)))


def _psf(fwhm: float, ratio: float, angle: float, profile, s: float) -> np.ndarray:
    r = max(1, math.ceil(1.5 * fwhm))
    y, x = np.mgrid[-r : r + 1, -r : r + 1]
    c, n = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    out = profile((c * x + n * y) ** 2 + ((c * y - n * x) / ratio) ** 2, s)
    return out / out.sum()


def richardson_lucy(pixels: DataFrame, psf: np.ndarray, rounds: int = 10, variation: float = 0.0, stop: float = 0.0, side: int = SIDE) -> DataFrame:
    """Multiplicative deconvolution, a pass over tiles with halos for each round. Negative values count as 0.

    variation: weight of the total-variation term that holds noise back. stop: a frame stays as it is from the round
    in which its mean change falls to that part of its mean (0: all rounds). Frames are independent of each other.
    """
    r = max(psf.shape) // 2
    back = psf[::-1, ::-1]

    def step(arrays, y0, x0):
        image, now = arrays
        ratio = image / np.maximum(convolved(now, psf), 1e-12)
        new = now * convolved(ratio, back)
        if variation:
            gy, gx = shifted(now, 1, 0) - now, shifted(now, 0, 1) - now
            size = np.sqrt(gy**2 + gx**2 + 1e-12)
            flow = gy / size - shifted(gy / size, -1, 0) + gx / size - shifted(gx / size, 0, -1)
            new = new / np.maximum(1 - variation * flow, 1e-3)
        return [image, np.where(np.isnan(new), now, new)]

    state = pixels.select(*FRAME, "y", "x", F.greatest("v", F.lit(0.0)).alias("image")).withColumn("now", F.col("image"))
    for _ in range(rounds):
        moved = over_tiles(state, step, 2 * r + 1, ("image", "now"), ("image", "new"), side)
        if stop:
            both = moved.join(state.select(*FRAME, "y", "x", "now"), [*FRAME, "y", "x"])
            change = both.groupBy(*FRAME).agg((F.avg(F.abs(F.col("new") - F.col("now"))) <= stop * F.avg("now")).alias("done_"))
            moved = both.join(change, list(FRAME)).withColumn("new", F.when(F.col("done_"), F.col("now")).otherwise(F.col("new"))).drop("now", "done_")
        state = settled(moved.withColumnRenamed("new", "now"))
    return state.select(*FRAME, "y", "x", F.col("now").alias("v"))


def wiener(pixels: DataFrame, psf: np.ndarray, noise: float = 0.01) -> DataFrame:
    """The spectrum times conj(H) / (|H|^2 + noise), H the transform of the point spread function; the frame is taken as periodic."""
    r, q = (n // 2 for n in psf.shape)
    dy, dx = np.mgrid[-r : r + 1, -q : q + 1]

    def filtered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            h = np.zeros(len(b), dtype=complex)
            for k, i, j in zip(psf.ravel(), dy.ravel(), dx.ravel()):
                h += k * np.exp(-2j * np.pi * (b.y * i / b.h + b.x * j / b.w).to_numpy(float))
            z = (b.re + 1j * b.im).to_numpy() * h.conj() / (np.abs(h) ** 2 + noise)
            yield b.assign(re=z.real, im=z.imag)

    f = fourier(pixels)
    return inverse(f.mapInPandas(filtered, f.schema))


# ---- local contrast ---------------------------------------------------------------------------------
def local_contrast(pixels: DataFrame, clip: float = 2.0, side: int = 8, bins: int = 256) -> DataFrame:
    """Contrast-limited adaptive histogram equalisation of values 0..1.

    Each tile's histogram is clipped at `clip` times its mean count (the excess spread over all bins) and summed up to a mapping;
    a pixel's value is the blend of the mappings of the four tiles whose centres surround it.
    """
    size = pixels.groupBy(*FRAME).agg(F.floor(F.max("y") / side).alias("last_y"), F.floor(F.max("x") / side).alias("last_x"))
    level = F.least(F.greatest(F.floor(F.col("v") * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    p = pixels.join(size, list(FRAME)).withColumn("bin", level)
    counts = p.groupBy(*FRAME, F.floor(F.col("y") / side).alias("ty"), F.floor(F.col("x") / side).alias("tx"), "bin").agg(F.count(F.lit(1)).alias("n"))
    tiles = counts.groupBy(*FRAME, "ty", "tx").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("h"))  # bins entries at most
    limit = clip * F.col("all") / bins
    full = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.coalesce(F.col("h")[b], F.lit(0)).cast("double"))
    excess = F.aggregate("f", F.lit(0.0), lambda s, n: s + F.greatest(n - F.col("limit"), F.lit(0.0)))
    clipped = tiles.select(*FRAME, "ty", "tx", "all", full.alias("f"), limit.alias("limit")).withColumn("excess", excess)
    rows = clipped.select(*FRAME, "ty", "tx", "all", "limit", "excess", F.posexplode("f").alias("bin", "n"))
    upto = F.sum(F.least("n", "limit") + F.col("excess") / bins).over(W.partitionBy(*FRAME, "ty", "tx").orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
    mapping = rows.select(*FRAME, "ty", "tx", "bin", (upto / F.col("all")).alias("to"))

    def between(c: str, last: str) -> Column:
        """(tile, weight) of the two tiles whose centres lie before and after; at the border both are the last one."""
        at = (F.col(c) - (side - 1) / 2) / side
        low = F.floor(at)
        inside = lambda t: F.least(F.greatest(t, F.lit(0)), F.col(last))
        return F.explode(F.array(F.struct(inside(low).alias("t"), (1 - (at - low)).alias("w")), F.struct(inside(low + 1).alias("t"), (at - low).alias("w"))))

    four = p.withColumn("a", between("y", "last_y")).withColumn("b", between("x", "last_x"))
    four = four.select(*FRAME, "y", "x", "bin", F.col("a.t").alias("ty"), F.col("b.t").alias("tx"), (F.col("a.w") * F.col("b.w")).alias("w"))
    return four.join(mapping, [*FRAME, "ty", "tx", "bin"]).groupBy(*FRAME, "y", "x").agg(F.sum(F.col("w") * F.col("to")).alias("v"))
