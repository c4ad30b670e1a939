"""Frames as display images: PNM, BMP, PNG and TIFF encoders for dense frames (frame_id, width, height, channels, data in 0..1)."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame


def raster(data, width: int, height: int, channels: int, levels: int) -> np.ndarray:
    """height x width x channels of whole numbers 0..levels."""
    a = np.nan_to_num(np.asarray(data, dtype=np.float64)).reshape(channels, height, width).transpose(1, 2, 0)
    return np.rint(np.clip(a, 0, 1) * levels)


def pnm(data, w: int, h: int, c: int) -> bytes:
    return b"P%d\n%d %d\n65535\n" % (6 if c == 3 else 5, w, h) + raster(data, w, h, c, 65535).astype(">u2").tobytes()


def bmp(data, w: int, h: int, c: int) -> bytes:
    a = raster(data, w, h, c, 255).astype(np.uint8)
    a = (np.repeat(a, 3, axis=2) if c == 1 else a)[::-1, :, ::-1]
    rows = np.pad(a.reshape(h, w * 3), ((0, 0), (0, -w * 3 % 4))).tobytes()
    return b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(rows), 2835, 2835, 0, 0) + rows


def png(data, w: int, h: int, c: int) -> bytes:
    a = raster(data, w, h, c, 65535).astype(">u2").reshape(h, w * c)
    lines = b"".join(b"\0" + row.tobytes() for row in a)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 16, 2 if c == 3 else 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def tiff(data, w: int, h: int, c: int, bits: int = 16, deflate: bool = False) -> bytes:
    a = np.asarray(data, dtype="<f4").reshape(c, h, w).transpose(1, 2, 0) if bits == 32 else raster(data, w, h, c, 255 if bits == 8 else 65535).astype("<u1" if bits == 8 else "<u2")
    body = zlib.compress(a.tobytes()) if deflate else a.tobytes()
    tags = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, 1, bits), (259, 3, 1, 8 if deflate else 1), (262, 3, 1, 2 if c == 3 else 1), (273, 4, 1, 8), (277, 3, 1, c), (278, 4, 1, h), (279, 4, 1, len(body)), (339, 3, 1, 3 if bits == 32 else 1)]
    extra = b""
    if c == 3:  # three bit depths and formats don't fit an entry
        at = 8 + len(body)
        tags[2], tags[9] = (258, 3, 3, at), (339, 3, 3, at + 6)
        extra = struct.pack("<6H", bits, bits, bits, *[3 if bits == 32 else 1] * 3)
    entries = b"".join(struct.pack("<HHI", t, k, n) + (struct.pack("<HH", v, 0) if k == 3 and n == 1 else struct.pack("<I", v)) for t, k, n, v in tags)
    return b"II*\0" + struct.pack("<I", 8 + len(body) + len(extra)) + body + extra + struct.pack("<H", len(tags)) + entries + struct.pack("<I", 0)


ENCODERS = {"pnm": pnm, "bmp": bmp, "png": png, "tif": tiff, "tif8": lambda *a: tiff(*a, bits=8), "tif32": lambda *a: tiff(*a, bits=32)}


def encoded(frames: DataFrame, kind: str) -> DataFrame:
    """(frame_id, content): each frame as the bytes of an image file."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame({"frame_id": pdf["frame_id"], "content": [ENCODERS[kind](r.data, r.width, r.height, r.channels) for r in pdf.itertuples()]})

    return frames.select("frame_id", "width", "height", "channels", "data").mapInPandas(run, "frame_id string, content binary")
