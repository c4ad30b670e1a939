"""Statistics of frames and groups of values, in native aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: Of a normal distribution: standard deviation by median absolute deviation.
SIGMA_OF_MAD = 1.4826


def basic(pixels: DataFrame, by: Sequence[str] = ("frame_id", "channel")) -> DataFrame:
    """mean, median, sigma (sample), min, max; bgnoise = 1.4826 MAD."""
    plain = pixels.groupBy(*by).agg(F.avg("v").alias("mean"), F.median("v").alias("median"), F.stddev_samp("v").alias("sigma"), F.min("v").alias("min"), F.max("v").alias("max"))
    mad = pixels.join(plain.select(*by, "median"), list(by)).groupBy(*by).agg((F.median(F.abs(F.col("v") - F.col("median"))) * SIGMA_OF_MAD).alias("bgnoise"))
    return plain.join(mad, list(by))


def main(pixels: DataFrame, by: Sequence[str] = ("frame_id", "channel")) -> DataFrame:
    """basic with avg_dev (from the median), mad and sqrt_bwmv (biweight midvariance, 0 weight beyond 9 MAD)."""
    keys, first = list(by), basic(pixels, by)
    off = pixels.join(first.select(*keys, "median"), keys).withColumn("d", F.col("v") - F.col("median"))
    second = off.groupBy(*keys).agg(F.avg(F.abs("d")).alias("avg_dev"), F.median(F.abs("d")).alias("mad"), F.count(F.lit(1)).alias("n"))
    t = off.join(second.select(*keys, "mad"), keys).withColumn("t", F.col("d") / F.nullif(9 * F.col("mad"), F.lit(0.0)))
    inside = F.abs("t") < 1
    u = 1 - F.col("t") * F.col("t")
    sums = t.groupBy(*keys).agg(
        F.sum(F.when(inside, F.col("d") * F.col("d") * u * u * u * u)).alias("a"),
        F.sum(F.when(inside, u * (1 - 5 * F.col("t") * F.col("t")))).alias("b"),
    )
    bwmv = F.sqrt(F.col("n") * F.col("a")) / F.nullif(F.abs("b"), F.lit(0.0))
    return first.join(second, keys).join(sums, keys).withColumn("sqrt_bwmv", bwmv).drop("a", "b", "n")


def full(pixels: DataFrame, by: Sequence[str] = ("frame_id", "channel")) -> DataFrame:
    """main with location and scale: mean and standard deviation of what lies within 3 sqrt_bwmv of the median."""
    keys, stats = list(by), main(pixels, by)
    near = pixels.join(stats.select(*keys, "median", "sqrt_bwmv"), keys).where(F.abs(F.col("v") - F.col("median")) <= 3 * F.coalesce("sqrt_bwmv", F.lit(0.0)))
    return stats.join(near.groupBy(*keys).agg(F.avg("v").alias("location"), F.stddev_samp("v").alias("scale")), keys, "left")


def by_cfa_site(pixels: DataFrame) -> DataFrame:
    """pixels with site: which of the four places of a colour filter array."""
    return pixels.withColumn("site", (F.col("y") % 2 * 2 + F.col("x") % 2).cast("int"))


def background(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("frame_id", "channel").agg(F.median("v").alias("bg"))


def histogram(pixels: DataFrame, bins: int, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Counts in equal bins; what lies outside counts to the first or last."""
    b = F.least(F.greatest(F.floor((F.col("v") - low) / ((high - low) / bins)), F.lit(0)), F.lit(bins - 1)).cast("int")
    return pixels.groupBy("frame_id", "channel", b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def entropy(pixels: DataFrame, bins: int = 256, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Shannon entropy of the histogram, in bits."""
    h = histogram(pixels, bins, low, high)
    total = h.groupBy("frame_id", "channel").agg(F.sum("n").alias("all"))
    p = F.col("n") / F.col("all")
    return h.join(total, ["frame_id", "channel"]).groupBy("frame_id", "channel").agg((-F.sum(p * F.log2(p))).alias("entropy"))


def centroid(pixels: DataFrame) -> DataFrame:
    """Value-weighted centre of each frame and channel."""
    w = F.sum("v")
    return pixels.groupBy("frame_id", "channel").agg((F.sum(F.col("v") * F.col("x")) / F.nullif(w, F.lit(0.0))).alias("cx"), (F.sum(F.col("v") * F.col("y")) / F.nullif(w, F.lit(0.0))).alias("cy"))


def profile_line(pixels: DataFrame, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    """Pixels nearest to a line, by their place on it (0 to 1)."""
    length = float((x1 - x0) ** 2 + (y1 - y0) ** 2) or 1.0
    t = ((F.col("x") - x0) * (x1 - x0) + (F.col("y") - y0) * (y1 - y0)) / length
    off = F.abs((F.col("x") - x0) * (y1 - y0) - (F.col("y") - y0) * (x1 - x0)) / length**0.5
    return pixels.withColumn("t", t).where(F.col("t").between(0, 1) & (off <= 0.5))


def all_color(frames: DataFrame, group: str) -> DataFrame:
    """Per group: whether all frames are colour (a Bayer pattern, or more than two axes)."""
    color = (F.coalesce(F.try_element_at("header", F.lit("BAYERPAT")), F.lit("")) != "") | (F.col("naxis") > 2)
    return frames.groupBy(group).agg(F.coalesce(F.bool_and(color), F.lit(True)).alias("all_color"))


def tile_key(size: int) -> Column:
    """A key that keeps a pixel's samples of all frames together and frames spread over tasks."""
    return F.struct("channel", F.floor(F.col("y") / size).alias("ty"), F.floor(F.col("x") / size).alias("tx"))
