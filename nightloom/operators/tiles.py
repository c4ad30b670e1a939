"""Neighbourhood operators on large frames: square tiles with a halo of the pixels around them.

A pixel goes to its own tile and to those whose halo it lies in, so a tile is one bounded group whatever the
frame's size, and what a function sees of a pixel's surroundings is the same in every tiling. Beyond the frame's
border the image is mirrored (the border pixel repeats).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

SIDE = 512


def with_tiles(pixels: DataFrame, halo: int, side: int = SIDE) -> DataFrame:
    """pixels with ty, tx: a row for each tile that holds the pixel or has it in its halo."""
    reach = lambda c: F.explode(F.sequence(F.floor((F.col(c) - halo) / side), F.floor((F.col(c) + halo) / side)))
    return pixels.withColumn("ty", reach("y")).withColumn("tx", reach("x"))


class Tile:
    """One tile's arrays, padded with `halo` on each side; y0, x0: the frame's place of the array's first element."""

    def __init__(self, rows: dict[str, np.ndarray], values: Sequence[str], halo: int, side: int):
        y, x, ty, tx = rows["y"], rows["x"], int(rows["ty"][0]), int(rows["tx"][0])
        low, high = (ty * side, tx * side), ((ty + 1) * side - 1, (tx + 1) * side - 1)
        self.inside = inside = (y >= low[0]) & (y <= high[0]) & (x >= low[1]) & (x <= high[1])
        if not inside.any():
            return
        first, last = (int(y.min()), int(x.min())), (int(y.max()), int(x.max()))
        begin, end = [max(a, b) for a, b in zip(low, first)], [min(a, b) for a, b in zip(high, last)]
        pads = [(max(0, f - (b - halo)), max(0, e + halo - la)) for f, b, e, la in zip(first, begin, end, last)]
        self.arrays = []
        for name in values:
            a = np.full((last[0] - first[0] + 1, last[1] - first[1] + 1), np.nan)
            a[y - first[0], x - first[1]] = rows[name]
            self.arrays.append(np.pad(a, pads, mode="symmetric"))
        self.y0, self.x0 = first[0] - pads[0][0], first[1] - pads[1][0]
        self.rows, self.columns = y[inside] - self.y0, x[inside] - self.x0


def over_tiles(pixels: DataFrame, function: Callable, halo: int, values: Sequence[str] = ("v",), outputs: Sequence[str] = ("v",), side: int = SIDE) -> DataFrame:
    """The pixels' keys and places with the columns `outputs` that function(arrays, y0, x0) gives for them.

    arrays: one for each of `values`, with `halo` more pixels on each side; missing pixels are NaN. The function returns
    an array of that shape for each of outputs (or one array); only places that have a pixel come back. Every column but
    values, y and x is a key and goes through.
    """
    keys = [c for c in pixels.columns if c not in (*values, "y", "x")]
    schema = StructType([pixels.schema[c] for c in (*keys, "y", "x")] + [StructField(c, DoubleType()) for c in outputs])

    def of_tiles(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        """The rows of whole tiles, which begin at starts."""
        columns = {c: pdf[c].to_numpy() for c in ("y", "x", "ty", "tx")} | {c: pdf[c].to_numpy(float) for c in values}
        kept, made = [np.zeros(0, dtype=int)], [[np.zeros(0)] for _ in outputs]
        for a, b in zip(starts, [*starts[1:], len(pdf)]):
            t = Tile({c: v[a:b] for c, v in columns.items()}, values, halo, side)
            if t.inside.any():
                kept.append(a + np.flatnonzero(t.inside))
                got = function(t.arrays, t.y0, t.x0)
                for to, array in zip(made, got if isinstance(got, (list, tuple)) else [got]):
                    to.append(array[t.rows, t.columns])
        return pdf.iloc[np.concatenate(kept)][[*keys, "y", "x"]].assign(**{n: np.concatenate(m) for n, m in zip(outputs, made)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Tiles lie together; the last one of a batch may go on in the next."""
        rest = None
        for pdf in batches:
            if not len(pdf):
                continue
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            new = np.zeros(len(pdf), dtype=bool)
            for c in (*keys, "ty", "tx"):
                new[1:] |= np.diff(pd.factorize(pdf[c], use_na_sentinel=False)[0]) != 0
            starts = np.concatenate([[0], np.flatnonzero(new)])
            if len(starts) > 1:
                yield of_tiles(pdf.iloc[: starts[-1]], starts[:-1])
            rest = pdf.iloc[starts[-1] :]
        if rest is not None:
            yield of_tiles(rest, np.zeros(1, dtype=int))

    return with_tiles(pixels, halo, side).repartition(*keys, "ty", "tx").sortWithinPartitions(*keys, "ty", "tx").mapInPandas(run, schema)


def shifted(a: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """a with its values moved, b[y, x] = a[y + dy, x + dx]; NaN where there are none."""
    out = np.full(a.shape, np.nan)
    h, w = a.shape
    ys, xs = slice(max(0, -dy), min(h, h - dy)), slice(max(0, -dx), min(w, w - dx))
    out[ys, xs] = a[max(0, dy) : min(h, h + dy), max(0, dx) : min(w, w + dx)]
    return out


def convolved(a: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Correlation of a with an odd kernel; NaN where the kernel meets what isn't there."""
    ry, rx = (n // 2 for n in kernel.shape)
    return sum(kernel[i + ry, j + rx] * shifted(a, i, j) for i in range(-ry, ry + 1) for j in range(-rx, rx + 1) if kernel[i + ry, j + rx])
