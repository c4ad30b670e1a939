"""Operators on single pixels: stretches, limits, colour. Pixels are (frame_id, channel, y, x, v), v in 0..1.

What needs a frame's statistics takes one aggregate by (frame, channel), joined back.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .statistics import SIGMA_OF_MAD

FRAME = ["frame_id", "channel"]
WEIGHTS = (0.2126, 0.7152, 0.0722)
V = F.col


def apply(pixels: DataFrame, f: Callable[[Column], Column], channels: Sequence[int] | None = None) -> DataFrame:
    """f on every value, or on those of some channels."""
    v = f(F.col("v"))
    return pixels.withColumn("v", v if channels is None else F.when(F.col("channel").isin(*channels), v).otherwise(F.col("v")))


def clip(v: Column, mode: str = "clip") -> Column:
    return F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) if mode == "clip" else v


# ---- closed forms ----------------------------------------------------------------------------------
def mtf_of(v: Column, low: Column | float, mid: Column | float, high: Column | float) -> Column:
    """Midtones transfer: clamps to [low, high], then ((m - 1) x) / ((2m - 1) x - m)."""
    low, mid, high = (c if isinstance(c, Column) else F.lit(float(c)) for c in (low, mid, high))
    x = F.least(F.greatest((v - low) / F.nullif(high - low, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return F.coalesce((mid - 1) * x / F.nullif((2 * mid - 1) * x - mid, F.lit(0.0)), F.lit(0.0))


def inverse_mtf_of(v: Column, low: float, mid: float, high: float) -> Column:
    return mtf_of(v, 0.0, 1 - mid, 1.0) * (high - low) + low


def mtf(pixels: DataFrame, low: float, mid: float, high: float, channels: Sequence[int] | None = None) -> DataFrame:
    return apply(pixels, lambda v: mtf_of(v, low, mid, high), channels)


def inverse_mtf(pixels: DataFrame, low: float, mid: float, high: float, channels: Sequence[int] | None = None) -> DataFrame:
    return apply(pixels, lambda v: inverse_mtf_of(v, low, mid, high), channels)


def asinh_of(v: Column, stretch: float, offset: float = 0.0) -> Column:
    x = F.greatest((v - offset) / (1 - offset), F.lit(0.0))
    return F.asinh(x * stretch) / F.asinh(F.lit(float(stretch)))


def asinh(pixels: DataFrame, stretch: float, offset: float = 0.0, human: bool = False, mode: str = "clip") -> DataFrame:
    """Arcsinh stretch by luminance: channels keep their ratio. Weights: equal, or those of human vision."""
    if stretch < 1:
        raise ValueError("the stretch is 1 at least")
    n = _channels(pixels)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.col("channel") + 1) if human else F.lit(1.0) / n["n"]
    lum = pixels.join(n["table"], "frame_id").withColumn("w_", F.when(F.col("n_") == 3, weight if human else F.lit(1.0) / 3).otherwise(F.lit(1.0) / F.col("n_")))
    by = lum.groupBy("frame_id", "y", "x").agg(F.sum(F.col("w_") * F.col("v")).alias("l_"))
    x = F.greatest((F.col("v") - offset) / (1 - offset), F.lit(0.0))
    base = F.greatest((F.col("l_") - offset) / (1 - offset), F.lit(0.0))
    ratio = F.when(base > 0, asinh_of(F.col("l_"), stretch, offset) / base).otherwise(F.lit(stretch / _asinh(stretch)))
    return pixels.join(by, ["frame_id", "y", "x"]).withColumn("v", clip(x * ratio, mode)).select(*pixels.columns)


def _asinh(x: float) -> float:
    from math import asinh as a

    return a(x)


def _channels(pixels: DataFrame) -> dict:
    return {"n": F.lit(3.0), "table": pixels.groupBy("frame_id").agg((F.max("channel") + 1).alias("n_"))}


def modified_asinh_of(v: Column, d: float, lp: float = 0.0, sp: float = 0.0, hp: float = 1.0) -> Column:
    """Arcsinh around a symmetry point, straight beyond the shadow and highlight points."""
    return _symmetric(v, d, lp, sp, hp, lambda z: F.asinh(z * d), lambda z: d / F.sqrt(1 + F.lit(d * d) * z * z))


def ght_of(v: Column, d: float, b: float = 0.0, lp: float = 0.0, sp: float | Column = 0.0, hp: float = 1.0) -> Column:
    """Generalised hyperbolic stretch: local intensity b, symmetry point sp, straight below lp and above hp."""
    if d == 0:
        return v
    if b == -1:
        base, slope = (lambda z: F.log1p(z * d)), (lambda z: d / (1 + z * d))
    elif b < 0:
        base = lambda z: (1 - F.pow(1 - z * (b * d), F.lit((b + 1) / b))) / (d * (b + 1)) * d
        slope = lambda z: d * F.pow(1 - z * (b * d), F.lit(1 / b))
    elif b == 0:
        base, slope = (lambda z: 1 - F.exp(-z * d)), (lambda z: F.exp(-z * d) * d)
    else:
        base = lambda z: 1 - F.pow(1 + z * (b * d), F.lit(-1 / b))
        slope = lambda z: d * F.pow(1 + z * (b * d), F.lit(-(1 + b) / b))
    return _symmetric(v, d, lp, sp, hp, base, slope)


def _symmetric(v: Column, d: float, lp, sp, hp, base, slope) -> Column:
    """base on both sides of sp, tangents below lp and above hp, rescaled to 0..1."""
    lp, sp, hp = (c if isinstance(c, Column) else F.lit(float(c)) for c in (lp, sp, hp))
    lp, hp = F.least(lp, sp), F.greatest(hp, sp)
    low, high = -base(sp - lp), base(hp - sp)
    at = lambda x: (
        F.when(x < lp, low + slope(sp - lp) * (x - lp)).when(x < sp, -base(F.greatest(sp - x, F.lit(0.0)))).when(x <= hp, base(F.greatest(x - sp, F.lit(0.0)))).otherwise(high + slope(hp - sp) * (x - hp))
    )
    zero, one = at(F.lit(0.0)), at(F.lit(1.0))
    return (at(v) - zero) / F.nullif(one - zero, F.lit(0.0))


def ght(pixels: DataFrame, d: float, b: float = 0.0, lp: float = 0.0, sp: float = 0.0, hp: float = 1.0, weight: str = "independent", channels: Sequence[int] | None = None, mode: str = "clip") -> DataFrame:
    """weight: each channel alone (independent), luminance (human or even; channels keep their ratio), or saturation (sat)."""
    if weight == "independent":
        return apply(pixels, lambda v: clip(ght_of(v, d, b, lp, sp, hp), mode), channels)
    rgb = wide(pixels)
    r, g, bl = (F.col(c) for c in "rgb")
    if weight == "sat":
        h, s, v = hsv(r, g, bl)
        out = from_hsv(h, clip(ght_of(s, d, b, lp, sp, hp)), v)
    else:
        w = WEIGHTS if weight == "human" else (1 / 3,) * 3
        lum = r * w[0] + g * w[1] + bl * w[2]
        k = F.coalesce(ght_of(lum, d, b, lp, sp, hp) / F.nullif(lum, F.lit(0.0)), F.lit(0.0))
        out = tuple(clip(c * k, mode) for c in (r, g, bl))
    return long(rgb, out)


def linear_stretch(pixels: DataFrame, black: float, channels: Sequence[int] | None = None, mode: str = "clip") -> DataFrame:
    return apply(pixels, lambda v: clip((v - black) / (1 - black), mode), channels)


def negative(pixels: DataFrame, bits: int = 32) -> DataFrame:
    return apply(pixels, lambda v: F.lit(65535.0 if bits == 16 else 1.0) - v)


def no_zero(pixels: DataFrame, level: float) -> DataFrame:
    return apply(pixels, lambda v: F.when((v == 0) | v.isNull(), F.lit(float(level))).otherwise(v))


def threshold(pixels: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    f = lambda v: v if low is None else F.greatest(v, F.lit(float(low)))
    return apply(pixels, lambda v: f(v) if high is None else F.least(f(v), F.lit(float(high))))


def scalar(pixels: DataFrame, how: str, value: float) -> DataFrame:
    """offset, fmul, fdiv, fill by one number."""
    return apply(pixels, {"offset": lambda v: v + value, "fmul": lambda v: v * value, "fdiv": lambda v: v / value, "fill": lambda v: F.lit(float(value))}[how])


def between_frames(pixels: DataFrame, other: DataFrame, how: str) -> DataFrame:
    """iadd, isub, imul, idiv with an image (channel, y, x, v); division by 0 gives 0."""
    o = other.select("channel", "y", "x", F.col("v").alias("o_"))
    f = {"iadd": F.col("v") + F.col("o_"), "isub": F.col("v") - F.col("o_"), "imul": F.col("v") * F.col("o_"), "idiv": F.coalesce(F.col("v") / F.nullif(F.col("o_"), F.lit(0.0)), F.lit(0.0))}[how]
    return pixels.join(o, ["channel", "y", "x"]).withColumn("v", f).select(*pixels.columns)


# ---- by the frame's statistics ---------------------------------------------------------------------
def limit(pixels: DataFrame, mode: str) -> DataFrame:
    """clip: to 0..1. posrescale: a maximum over 1 becomes 1, negatives 0. rescale: a minimum below 0 becomes 0, then a maximum over 1 becomes 1."""
    if mode == "clip":
        return apply(pixels, clip)
    ends = pixels.groupBy("frame_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    joined = pixels.join(ends, "frame_id")
    if mode == "posrescale":
        v = F.greatest(F.col("v") / F.greatest("hi", F.lit(1.0)), F.lit(0.0))
    else:
        down = F.least("lo", F.lit(0.0))
        v = (F.col("v") - down) / F.greatest(F.col("hi") - down, F.lit(1.0))
    return joined.withColumn("v", v).select(*pixels.columns)


def log(pixels: DataFrame, floor: float = 1e-10) -> DataFrame:
    """ln(1 - (v - min) / (max - min)) for each frame and channel; the argument is at least `floor` (at v = max)."""
    ends = pixels.groupBy(*FRAME).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    x = F.coalesce((F.col("v") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)), F.lit(0.0))
    return pixels.join(ends, FRAME).withColumn("v", F.log(F.greatest(1 - x, F.lit(floor)))).select(*pixels.columns)


def median_and_mad(pixels: DataFrame, linked: bool = False) -> DataFrame:
    """(frame_id, channel, med, mad); linked: the mean of a frame's channels for each of them."""
    med = pixels.groupBy(*FRAME).agg(F.median("v").alias("med"))
    both = med.join(pixels.join(med, FRAME).groupBy(*FRAME).agg(F.median(F.abs(F.col("v") - F.col("med"))).alias("mad")), FRAME)
    if not linked:
        return both
    return both.select(*FRAME).join(both.groupBy("frame_id").agg(F.avg("med").alias("med"), F.avg("mad").alias("mad")), "frame_id")


def autostretch(pixels: DataFrame, shadows: float = -2.8, target: float = 0.25, linked: bool = False) -> DataFrame:
    """Shadows clipped at `shadows` sigma from the median, midtones so that the median becomes `target`."""
    stats = median_and_mad(pixels, linked)
    low = F.greatest(F.col("med") + shadows * SIGMA_OF_MAD * F.col("mad"), F.lit(0.0))
    mid = mtf_of(F.col("med") - F.col("lo_"), 0.0, target, 1.0)
    return pixels.join(stats, FRAME).withColumn("lo_", low).withColumn("mid_", mid).withColumn("v", mtf_of(F.col("v"), F.col("lo_"), F.col("mid_"), 1.0)).select(*pixels.columns)


def autoghs(pixels: DataFrame, shadows: float, amount: float, b: float = 13.0, lp: float = 0.0, hp: float = 0.7, linked: bool = False, mode: str = "clip") -> DataFrame:
    """ght with its symmetry point at median + shadows * sigma of each channel (linked: their mean)."""
    stats = pixels.groupBy(*FRAME).agg((F.median("v") + shadows * F.coalesce(F.stddev_samp("v"), F.lit(0.0))).alias("sp_"))
    if linked:
        stats = stats.select(*FRAME).join(stats.groupBy("frame_id").agg(F.avg("sp_").alias("sp_")), "frame_id")
    sp = F.least(F.greatest(F.col("sp_"), F.lit(0.0)), F.lit(1.0))
    return pixels.join(stats, FRAME).withColumn("v", clip(ght_of(F.col("v"), amount, b, lp, sp, hp), mode)).select(*pixels.columns)


def linear_match(pixels: DataFrame, reference: DataFrame, low: float, high: float) -> DataFrame:
    """Each frame's values under the line that fits the reference image on them, by reference pixels in [low, high]."""
    ref = reference.select("channel", "y", "x", F.col("v").alias("r_")).where(F.col("r_").between(low, high))
    fit = pixels.join(ref, ["channel", "y", "x"]).groupBy(*FRAME).agg(F.regr_slope("r_", "v").alias("a"), F.regr_intercept("r_", "v").alias("b"))
    return pixels.join(fit, FRAME).withColumn("v", F.col("a") * F.col("v") + F.col("b")).select(*pixels.columns)


# ---- pixel math ------------------------------------------------------------------------------------
#: What an expression may hold besides its images.
_TOKEN = re.compile(r"\$(\w+)\$|[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?|[-+*/%(),<>=! ]+|[A-Za-z_][A-Za-z0-9_]*")
FUNCTIONS = {"abs", "sqrt", "exp", "ln", "log10", "log2", "sin", "cos", "tan", "asin", "acos", "atan", "asinh", "least", "greatest", "pow", "if", "and", "or", "not", "sign"}


def pixel_math(images: dict[str, DataFrame], expression: str, rescale: tuple[float, float] | None = None) -> DataFrame:
    """(channel, y, x, v) of an expression over at most ten named images, $name$ in it."""
    names, out, at = [], "", 0
    while at < len(expression):
        m = _TOKEN.match(expression, at)
        if not m or (m[0][0].isalpha() and m[0].lower() not in FUNCTIONS) or (m[1] and m[1] not in images):
            raise ValueError(f"not allowed in an expression: {expression[at:at + 20]!r}")
        if m[1]:
            names.append(m[1])
        out += f"`v_{m[1]}`" if m[1] else m[0]
        at = m.end()
    names = list(dict.fromkeys(names))
    if not 1 <= len(names) <= 10:
        raise ValueError("an expression takes one to ten images")
    joined = None
    for n in names:
        one = images[n].select("channel", "y", "x", F.col("v").alias(f"v_{n}"))
        joined = one if joined is None else joined.join(one, ["channel", "y", "x"])
    result = joined.select("channel", "y", "x", F.expr(out).cast("double").alias("v"))
    if rescale is None:
        return result
    ends = result.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    scaled = (F.col("v") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * (rescale[1] - rescale[0]) + rescale[0]
    return result.crossJoin(F.broadcast(ends)).select("channel", "y", "x", scaled.alias("v"))  # one row


# ---- colour ----------------------------------------------------------------------------------------
def wide(pixels: DataFrame) -> DataFrame:
    """(frame_id, y, x, r, g, b) of frames with three channels."""
    one = lambda k: F.max(F.when(F.col("channel") == k, F.col("v")))
    return pixels.groupBy("frame_id", "y", "x").agg(one(0).alias("r"), one(1).alias("g"), one(2).alias("b"))


def long(rgb: DataFrame, out: Sequence[Column]) -> DataFrame:
    """Back to pixels, with new r, g, b."""
    each = F.posexplode(F.array(*out)).alias("channel", "v")
    return rgb.select("frame_id", "y", "x", each).select("frame_id", "channel", "y", "x", "v")


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue in 0..1, saturation, value."""
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    d = F.nullif(hi - lo, F.lit(0.0))
    h = F.when(hi == r, F.pmod((g - b) / d, F.lit(6.0))).when(hi == g, (b - r) / d + 2).otherwise((r - g) / d + 4) / 6
    return F.coalesce(h, F.lit(0.0)), F.coalesce((hi - lo) / F.nullif(hi, F.lit(0.0)), F.lit(0.0)), hi


def from_hsv(h: Column, s: Column, v: Column) -> tuple[Column, Column, Column]:
    def part(n: int) -> Column:
        k = F.pmod(F.lit(float(n)) + h * 6, F.lit(6.0))
        return v - v * s * F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0)))

    return part(5), part(3), part(1)


def hsl(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    h, _, hi = hsv(r, g, b)
    lo = F.least(r, g, b)
    l = (hi + lo) / 2  # noqa: E741
    return h, F.coalesce((hi - l) / F.nullif(F.least(l, 1 - l), F.lit(0.0)), F.lit(0.0)), l


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """CIE L*a*b* (D65) of linear RGB: 0..100, about -128..127."""
    f = lambda t: F.when(t > 216 / 24389, F.cbrt(t)).otherwise((t * (24389 / 27) + 16) / 116)
    x = f((r * 0.4124564 + g * 0.3575761 + b * 0.1804375) / 0.95047)
    y = f(r * 0.2126729 + g * 0.7151522 + b * 0.0721750)
    z = f((r * 0.0193339 + g * 0.1191920 + b * 0.9503041) / 1.08883)
    return 116 * y - 16, 500 * (x - y), 200 * (y - z)


def split_channels(pixels: DataFrame, space: str = "rgb") -> DataFrame:
    """(part, frame_id, y, x, v): three mono images of each colour frame, in rgb, hsl, hsv or lab."""
    rgb = wide(pixels)
    parts = {"rgb": lambda r, g, b: (r, g, b), "hsl": hsl, "hsv": hsv, "lab": lab}[space](F.col("r"), F.col("g"), F.col("b"))
    return rgb.select("frame_id", "y", "x", F.posexplode(F.array(*parts)).alias("part", "v"))


def color_matrix(pixels: DataFrame, m: Sequence[float], gamma: float = 1.0) -> DataFrame:
    """A 3x3 matrix (row by row) on r, g, b, then the power -1 / gamma unless gamma is 1."""
    rgb = wide(pixels)
    rows = [sum((F.col(c) * m[3 * i + j] for j, c in enumerate("rgb")), F.lit(0.0)) for i in range(3)]
    return long(rgb, rows if gamma == 1 else [F.pow(c, F.lit(-1 / gamma)) for c in rows])


def remove_green(pixels: DataFrame, how: str = "average", amount: float = 1.0, preserve: bool = True) -> DataFrame:
    """Green noise removal: average or maximum neutral, maximum or additive mask; preserve: keeps the luminance."""
    rgb = wide(pixels)
    r, g, b = (F.col(c) for c in "rgb")
    if how == "average":
        green = F.least(g, (r + b) / 2)
    elif how == "maximum":
        green = F.least(g, F.greatest(r, b))
    else:
        mask = F.greatest(r, b) if how == "maximum_mask" else F.least(r + b, F.lit(1.0))
        green = g * (1 - amount) * (1 - mask) + mask * g
    out = (r, green, b)
    if preserve:
        lum = lambda c: c[0] * WEIGHTS[0] + c[1] * WEIGHTS[1] + c[2] * WEIGHTS[2]
        k = F.coalesce(lum((r, g, b)) / F.nullif(lum(out), F.lit(0.0)), F.lit(1.0))
        out = tuple(c * k for c in out)
    return long(rgb, out)


def saturate(pixels: DataFrame, amount: float, background: float = 1.0, hue: int = 6) -> DataFrame:
    """Saturation times 1 + amount for pixels brighter than background * (median + sigma); hue 0..5: a sixth of the circle, 6: all."""
    rgb = wide(pixels)
    lum = (F.col("r") + F.col("g") + F.col("b")) / 3
    stats = rgb.groupBy("frame_id").agg((background * (F.median(lum) + F.coalesce(F.stddev_samp(lum), F.lit(0.0)))).alias("t_"))
    h, s, v = hsv(F.col("r"), F.col("g"), F.col("b"))
    on = lum > F.col("t_")
    if hue != 6:
        on &= F.floor(F.pmod(h * 6 + 0.5, F.lit(6.0))) == hue
    out = from_hsv(h, F.when(on, F.least(s * (1 + amount), F.lit(1.0))).otherwise(s), v)
    return long(rgb.join(stats, "frame_id"), out)


def remove_purple(pixels: DataFrame, blue: float = 0.14, thresh: float = 0.0, star_mask: DataFrame | None = None) -> DataFrame:
    """Blue of purple pixels (red and blue over green) brighter than thresh toward their green, `1 - blue` of the excess; star_mask: (frame_id, y, x) to be treated."""
    rgb = wide(pixels)
    if star_mask is not None:
        rgb = rgb.join(star_mask.select("frame_id", "y", "x", F.lit(True).alias("star_")).distinct(), ["frame_id", "y", "x"], "left")
    r, g, b = (F.col(c) for c in "rgb")
    on = (r > g) & (b > g) & ((r + g + b) / 3 > thresh)
    if star_mask is not None:
        on &= F.coalesce("star_", F.lit(False))
    return long(rgb, (F.when(on, g + (r - g) * blue).otherwise(r), g, F.when(on, g + (b - g) * blue).otherwise(b)))
