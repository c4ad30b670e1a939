"""Geometry: binning, cropping, flips and turns by index arithmetic; CFA sites; sub-pixel resampling by frame."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

PIXELS = "frame_id string, channel int, y int, x int, v double"
# The colours of the sites (0, 0), (0, 1), (1, 0), (1, 1).
PATTERNS = ("RGGB", "BGGR", "GRBG", "GBRG")


def size_of(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("frame_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))


def bin_pixels(pixels: DataFrame, n: int, total: bool = False) -> DataFrame:
    """n x n pixels to one: their mean, or sum."""
    return pixels.groupBy("frame_id", "channel", F.floor(F.col("y") / n).cast("int").alias("y"), F.floor(F.col("x") / n).cast("int").alias("x")).agg((F.sum if total else F.avg)("v").alias("v"))


def crop(pixels: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    inside = F.col("x").between(x, x + width - 1) & F.col("y").between(y, y + height - 1)
    return pixels.where(inside).withColumns({"x": F.col("x") - x, "y": F.col("y") - y})


def _moved(pixels: DataFrame, x: Column | None = None, y: Column | None = None) -> DataFrame:
    new = {k: c.cast("int") for k, c in (("x", x), ("y", y)) if c is not None}
    return pixels.join(size_of(pixels), "frame_id").withColumns(new).drop("w", "h")


def mirror_x(pixels: DataFrame) -> DataFrame:
    """About the horizontal axis."""
    return _moved(pixels, y=F.col("h") - 1 - F.col("y"))


def mirror_x_bottom_up(pixels: DataFrame, frames: DataFrame) -> DataFrame:
    """mirror_x for frames whose header ROWORDER isn't BOTTOM-UP."""
    order = F.coalesce(F.try_element_at("header", F.lit("ROWORDER")), F.lit("TOP-DOWN"))
    flip = frames.select("frame_id", (order != "BOTTOM-UP").alias("flip_"))
    sized = pixels.join(size_of(pixels), "frame_id").join(flip, "frame_id", "left")
    return sized.withColumn("y", F.when(F.coalesce("flip_", F.lit(True)), F.col("h") - 1 - F.col("y")).otherwise(F.col("y")).cast("int")).drop("w", "h", "flip_")


def mirror_y(pixels: DataFrame) -> DataFrame:
    """About the vertical axis."""
    return _moved(pixels, x=F.col("w") - 1 - F.col("x"))


def rotate_180(pixels: DataFrame) -> DataFrame:
    return _moved(pixels, F.col("w") - 1 - F.col("x"), F.col("h") - 1 - F.col("y"))


def rotate_90(pixels: DataFrame, turns: int) -> DataFrame:
    """Quarter turns, counter-clockwise."""
    turns %= 4
    if turns in (0, 2):
        return pixels if turns == 0 else rotate_180(pixels)
    sized = pixels.join(size_of(pixels), "frame_id")
    x, y = (F.col("y"), F.col("w") - 1 - F.col("x")) if turns == 1 else (F.col("h") - 1 - F.col("y"), F.col("x"))
    return sized.withColumns({"x": x.cast("int"), "y": y.cast("int")}).drop("w", "h")


def image_of(pdf: pd.DataFrame) -> np.ndarray:
    out = np.full((pdf.y.max() + 1, pdf.x.max() + 1), np.nan)
    out[pdf.y, pdf.x] = pdf.v
    return out


def rows_of(pdf: pd.DataFrame, image: np.ndarray) -> pd.DataFrame:
    y, x = np.nonzero(~np.isnan(image))
    return pd.DataFrame({"frame_id": pdf.frame_id.iloc[0], "channel": pdf.channel.iloc[0], "y": y.astype("int32"), "x": x.astype("int32"), "v": image[y, x]})


def sampled(image: np.ndarray, y: np.ndarray, x: np.ndarray, how: str = "linear") -> np.ndarray:
    """Values at fractional places: nearest, linear or cubic; NaN outside."""
    h, w = image.shape
    inside = (y > -0.5) & (y < h - 0.5) & (x > -0.5) & (x < w - 0.5)
    if how == "nearest":
        out = image[np.clip(np.rint(y), 0, h - 1).astype(int), np.clip(np.rint(x), 0, w - 1).astype(int)]
        return np.where(inside, out, np.nan)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    total = np.zeros(y.shape)
    for dy in range(0 if how == "linear" else -1, 2 if how == "linear" else 3):
        for dx in range(0 if how == "linear" else -1, 2 if how == "linear" else 3):
            weight = _kernel(y - y0 - dy, how) * _kernel(x - x0 - dx, how)
            total += weight * image[np.clip(y0 + dy, 0, h - 1), np.clip(x0 + dx, 0, w - 1)]
    return np.where(inside, total, np.nan)


def _kernel(t: np.ndarray, how: str) -> np.ndarray:
    t = np.abs(t)
    if how == "linear":
        return np.clip(1 - t, 0, None)
    return np.where(t <= 1, 1.5 * t**3 - 2.5 * t**2 + 1, np.where(t < 2, -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2, 0))


def rotate(pixels: DataFrame, degrees: float, crop_to_frame: bool = True, how: str = "linear", clamp: bool = True) -> DataFrame:
    """By any angle, counter-clockwise, frame by frame; quarter turns are exact index arithmetic."""
    if degrees % 90 == 0:
        return rotate_90(pixels, int(degrees // 90))
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))

    def turn(pdf: pd.DataFrame) -> pd.DataFrame:
        image = image_of(pdf)
        h, w = image.shape
        H, Wd = (h, w) if crop_to_frame else (math.ceil(abs(h * c) + abs(w * s)), math.ceil(abs(w * c) + abs(h * s)))
        y, x = np.mgrid[0:H, 0:Wd]
        dy, dx = y - (H - 1) / 2, x - (Wd - 1) / 2
        out = sampled(image, s * dx + c * dy + (h - 1) / 2, c * dx - s * dy + (w - 1) / 2, how)
        return rows_of(pdf, np.clip(out, np.nanmin(image), np.nanmax(image)) if clamp else out)

    return pixels.groupBy("frame_id", "channel").applyInPandas(turn, PIXELS)


def resample(pixels: DataFrame, factor: float, how: str = "linear") -> DataFrame:
    def scale(pdf: pd.DataFrame) -> pd.DataFrame:
        image = image_of(pdf)
        h, w = (max(1, round(n * factor)) for n in image.shape)
        y, x = np.mgrid[0:h, 0:w]
        return rows_of(pdf, sampled(image, (y + 0.5) / factor - 0.5, (x + 0.5) / factor - 0.5, how))

    return pixels.groupBy("frame_id", "channel").applyInPandas(scale, PIXELS)


# ---- colour filter arrays --------------------------------------------------------------------------
def sites(pattern: str, color: str) -> list[tuple[int, int]]:
    return [(i // 2, i % 2) for i, c in enumerate(pattern) if c == color]


def _at(places: list[tuple[int, int]]) -> Column:
    test = F.lit(False)
    for dy, dx in places:
        test |= (F.col("y") % 2 == dy) & (F.col("x") % 2 == dx)
    return test


def half(pixels: DataFrame) -> DataFrame:
    return bin_pixels(pixels, 2)


def extract_green(pixels: DataFrame, pattern: str = "RGGB") -> DataFrame:
    """The mean of the two green sites, at half size."""
    return half(pixels.where(_at(sites(pattern, "G"))))


def extract_ha(pixels: DataFrame, pattern: str = "RGGB", upscale: bool = False) -> DataFrame:
    """The red sites, at half size or each doubled to full size."""
    red = half(pixels.where(_at(sites(pattern, "R"))))
    return doubled(red) if upscale else red


def doubled(pixels: DataFrame) -> DataFrame:
    square = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])).alias("d")
    return pixels.select("frame_id", "channel", "y", "x", "v", square).select("frame_id", "channel", (F.col("y") * 2 + F.col("d.a")).alias("y"), (F.col("x") * 2 + F.col("d.b")).alias("x"), "v")


def extract_ha_oiii(pixels: DataFrame, pattern: str = "RGGB", equal_size: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(Ha: red sites at half size; OIII: the other sites at full size, red ones by the mean of their four neighbours).

    equal_size: "ha" doubles Ha, "oiii" halves OIII.
    """
    red = _at(sites(pattern, "R"))
    ha, rest = half(pixels.where(red)), pixels.where(~red)
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (0, -1), (1, 0), (-1, 0))])).alias("d")
    given = rest.select("frame_id", "channel", "y", "x", "v", around).select("frame_id", "channel", (F.col("y") + F.col("d.a")).alias("y"), (F.col("x") + F.col("d.b")).alias("x"), "v")
    filled = given.where(red).groupBy("frame_id", "channel", "y", "x").agg(F.avg("v").alias("v"))
    there = filled.join(pixels.select("frame_id", "channel", "y", "x"), ["frame_id", "channel", "y", "x"], "left_semi")
    oiii = rest.select("frame_id", "channel", "y", "x", "v").unionByName(there)
    return (doubled(ha) if equal_size == "ha" else ha), (half(oiii) if equal_size == "oiii" else oiii)


def split_cfa(pixels: DataFrame) -> DataFrame:
    """pixels with site 0..3: four half-size frames of each."""
    return pixels.select("frame_id", (F.col("y") % 2 * 2 + F.col("x") % 2).cast("int").alias("site"), "channel", F.floor(F.col("y") / 2).cast("int").alias("y"), F.floor(F.col("x") / 2).cast("int").alias("x"), "v")


def merge_cfa(parts: DataFrame, pattern: str = "RGGB") -> DataFrame:
    """The four frames back in place (site 0..3, row by row); pattern is the header's and must be known."""
    if pattern not in PATTERNS:
        raise ValueError(f"unknown pattern: {pattern}")
    return parts.select("frame_id", "channel", (F.col("y") * 2 + F.floor(F.col("site") / 2)).cast("int").alias("y"), (F.col("x") * 2 + F.col("site") % 2).cast("int").alias("x"), "v")


def compose_rgb(red: DataFrame, green: DataFrame, blue: DataFrame, frame_id: str, luminance: DataFrame | None = None) -> DataFrame:
    """One colour frame of mono images (y, x, v); with a luminance image, colours are scaled to it."""
    j = red.select("y", "x", F.col("v").alias("r")).join(green.select("y", "x", F.col("v").alias("g")), ["y", "x"]).join(blue.select("y", "x", F.col("v").alias("b")), ["y", "x"])
    k = F.lit(1.0)
    if luminance is not None:
        j = j.join(luminance.select("y", "x", F.col("v").alias("l")), ["y", "x"])
        k = F.coalesce(F.col("l") * 3 / F.nullif(F.col("r") + F.col("g") + F.col("b"), F.lit(0.0)), F.lit(0.0))
    each = F.posexplode(F.array(*[F.col(c) * k for c in "rgb"])).alias("channel", "v")
    return j.select("y", "x", each).select(F.lit(frame_id).alias("frame_id"), "channel", "y", "x", "v")


def total_exposure(headers: DataFrame, add: bool = True) -> DataFrame:
    """The exposure of a composed image: the sum of its parts', or their largest."""
    e = F.expr("try_cast(coalesce(try_element_at(header, 'EXPOSURE'), try_element_at(header, 'EXPTIME')) as double)")
    return headers.agg((F.sum if add else F.max)(e).alias("exposure"))


# ---- frame sets ------------------------------------------------------------------------------------
def common_area(bounds: DataFrame) -> DataFrame:
    """Per seq of bounds (seq, x0, y0, x1, y1): the area all frames share."""
    return bounds.groupBy("seq").agg(F.max("x0").alias("x0"), F.max("y0").alias("y0"), F.min("x1").alias("x1"), F.min("y1").alias("y1"))


def whole_area(bounds: DataFrame) -> DataFrame:
    return bounds.groupBy("seq").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
