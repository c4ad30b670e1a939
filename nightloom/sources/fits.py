"""FITS images as a Spark data source: one row for each file, header and pixels of the primary unit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

CARD, UNIT = 80, 2880
DTYPES = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}
HEADER = "array<struct<key:string,value:string,comment:string,kind:string>>"


def card(raw: str) -> tuple[str, str, str, str] | None:
    """(key, value as text, comment, kind) of a card; kinds: integer, float, logical, string, undefined, invalid."""
    key = raw[:8].strip()
    if not key or key in ("COMMENT", "HISTORY", "END") or raw[8:10] != "= ":
        return (key, raw[8:].strip(), "", "string") if key in ("COMMENT", "HISTORY") else None
    body = raw[10:].strip()
    if body.startswith("'"):
        end = 1
        while end < len(body) and (body[end] != "'" or body[end : end + 2] == "''"):
            end += 2 if body[end : end + 2] == "''" else 1
        return key, body[1:end].replace("''", "'").rstrip(), body[end + 1 :].partition("/")[2].strip(), "string"
    value, _, comment = body.partition("/")
    value = value.strip()
    if value in ("T", "F"):
        return key, value, comment.strip(), "logical"
    if not value:
        return key, "undefined", comment.strip(), "undefined"
    for kind, read in (("integer", int), ("float", lambda v: float(v.replace("D", "E")))):
        try:
            read(value)
            return key, value, comment.strip(), kind
        except ValueError:
            pass
    return key, value, comment.strip(), "invalid"


def parse(raw: bytes) -> tuple[list[tuple], int]:
    """Cards of the primary header, and where its data begin."""
    cards, at = [], 0
    while at + CARD <= len(raw):
        line = raw[at : at + CARD].decode("ascii", "replace")
        at += CARD
        if line[:8].strip() == "END":
            return cards, -(-at // UNIT) * UNIT
        if (c := card(line)) is not None:
            cards.append(c)
    raise ValueError("the header has no end")


def decode(raw: bytes, pixels: bool = True) -> dict:
    cards, at = parse(raw)
    value = {c[0]: c[1] for c in cards}
    axes = [int(value[f"NAXIS{i + 1}"]) for i in range(int(value.get("NAXIS", "0")))]
    data = None
    if pixels and axes:
        n = int(np.prod(axes))
        data = np.frombuffer(raw, dtype=DTYPES[int(value["BITPIX"])], count=n, offset=at).astype(np.float64) * float(value.get("BSCALE", 1)) + float(value.get("BZERO", 0))
    return {"header": cards, "bitpix": int(value.get("BITPIX", 0)), "axes": axes, "data": data}


def sum32(raw: bytes) -> int:
    """The 32-bit ones' complement sum of big-endian words."""
    total = int(np.frombuffer(raw, dtype=">u4").sum(dtype=np.uint64))
    while total >> 32:
        total = (total & 0xFFFFFFFF) + (total >> 32)
    return total


def sum_text(value: int) -> str:
    """The 16 letters and digits whose sum is the value: each byte as four characters, no punctuation, turned by one place for the card's alignment."""
    out = [""] * 16
    for i in range(4):
        byte = value >> (24 - 8 * i) & 255
        four = [byte // 4 + 48 + (byte % 4 if j == 0 else 0) for j in range(4)]
        while any(58 <= c <= 64 or 91 <= c <= 96 for c in four):
            for j in (0, 2):
                if any(58 <= c <= 64 or 91 <= c <= 96 for c in four[j : j + 2]):
                    four[j], four[j + 1] = four[j] + 1, four[j + 1] - 1
        for j in range(4):
            out[4 * j + i] = chr(four[j])
    return out[15] + "".join(out[:15])


def encode(header: dict[str, str], data: np.ndarray | None, axes: list[int], checksum: bool = False) -> bytes:
    """A FITS file of 32-bit floats; checksum: with DATASUM and CHECKSUM, so that all words of the file sum up to ones."""
    lines = ["SIMPLE  =                    T", f"BITPIX  = {-32:>20}", f"NAXIS   = {len(axes):>20}", *[f"NAXIS{i + 1:<3}= {n:>20}" for i, n in enumerate(axes)]]
    for k, v in header.items():
        if k not in ("SIMPLE", "BITPIX", "END", "BSCALE", "BZERO", "DATASUM", "CHECKSUM") and not k.startswith("NAXIS"):
            try:
                float(v)
                text = f"{v:>20}"
            except ValueError:
                text = f"{v:>20}" if v in ("T", "F") else "'" + str(v).replace("'", "''").ljust(8) + "'"
            lines.append(f"{k[:8]:<8}= {text}"[:CARD])
    pad = lambda b, fill: b + fill * (-len(b) % UNIT)
    body = pad(b"" if data is None else np.asarray(data, dtype=">f4").tobytes(), b"\0")
    none = "0" * 16
    if checksum:
        lines += [f"DATASUM = '{str(sum32(body)).ljust(8)}'", f"CHECKSUM= '{none}'"]
    head = pad("".join(x.ljust(CARD) for x in [*lines, "END"]).encode("ascii"), b" ")
    if checksum:
        card_of = f"CHECKSUM= '{none}'".encode()
        head = head.replace(card_of, f"CHECKSUM= '{sum_text(0xFFFFFFFF - sum32(head + body))}'".encode())
    return head + body


def read(spark: SparkSession, path: str, pixels: bool = True, glob: str = "*.{fit,fits,FIT,FITS}") -> DataFrame:
    """(path, header map, cards, bitpix, width, height, channels, naxis, data) of all FITS files under path, in any case of their names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    schema = f"path string, cards {HEADER}, bitpix int, axes array<int>, data array<float>"

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for p, raw in zip(pdf["path"], pdf["content"]):
                d = decode(raw, pixels)
                out.append((p, [dict(zip(("key", "value", "comment", "kind"), c)) for c in d["header"]], d["bitpix"], d["axes"], None if d["data"] is None else d["data"].astype(np.float32)))
            yield pd.DataFrame(out, columns=["path", "cards", "bitpix", "axes", "data"])

    rows = files.select(F.regexp_replace("path", "^file:(//)?", "").alias("path"), "content").mapInPandas(run, schema)
    plain = F.filter("cards", lambda c: ~c["key"].isin("COMMENT", "HISTORY"))
    header = F.map_from_entries(F.array_distinct(F.transform(F.array_distinct(F.transform(plain, lambda c: c["key"])), lambda k: F.struct(k.alias("key"), F.element_at(F.filter(plain, lambda c: c["key"] == k), 1)["value"].alias("value")))))
    axis = lambda i: F.coalesce(F.try_element_at("axes", F.lit(i)), F.lit(1))
    return rows.select("path", header.alias("header"), "cards", "bitpix", axis(1).alias("width"), axis(2).alias("height"), axis(3).alias("channels"), F.size("axes").alias("naxis"), "data")


def write(frames: DataFrame, folder: str, checksum: bool = False) -> DataFrame:
    """Writes each frame (frame_id, header, width, height, channels, data) as {folder}/{frame_id}.fits, by Hadoop-independent pyarrow file systems; returns (frame_id, path)."""

    def run(batches):
        import pandas as pd
        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        where.create_dir(root, recursive=True)
        for pdf in batches:
            done = []
            for r in pdf.itertuples():
                axes = [r.width, r.height] + ([r.channels] if r.channels > 1 else [])
                with where.open_output_stream(f"{root}/{r.frame_id}.fits") as f:
                    f.write(encode(dict(r.header or {}), r.data, axes, checksum))
                done.append((r.frame_id, f"{root}/{r.frame_id}.fits"))
            yield pd.DataFrame(done, columns=["frame_id", "path"])

    return frames.select("frame_id", "header", "width", "height", "channels", "data").mapInPandas(run, "frame_id string, path string")


__all__ = ["card", "decode", "encode", "parse", "read", "write"]
