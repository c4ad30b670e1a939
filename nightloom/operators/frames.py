"""Frames dense (one row with an array) and long (one row for each pixel), and frame sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def to_pixels(frames: DataFrame) -> DataFrame:
    """frames (frame_id, width, height, channels, data; channel by channel, row by row) in long form."""
    each = frames.select("frame_id", "width", "height", F.posexplode("data").alias("i", "v"))
    area = F.col("width") * F.col("height")
    return each.select(
        "frame_id", F.floor(F.col("i") / area).cast("int").alias("channel"), F.floor((F.col("i") % area) / F.col("width")).cast("int").alias("y"),
        (F.col("i") % F.col("width")).cast("int").alias("x"), F.col("v").cast("double").alias("v"),
    )


def to_frames(pixels: DataFrame) -> DataFrame:
    """Long to dense: (frame_id, width, height, channels, data). A frame's pixels meet in one row."""
    return pixels.groupBy("frame_id").agg(
        (F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"), (F.max("channel") + 1).alias("channels"),
        F.transform(F.array_sort(F.collect_list(F.struct("channel", "y", "x", "v"))), lambda p: p["v"].cast("float")).alias("data"),
    )


# ---- sequences -------------------------------------------------------------------------------------
def numbered(files: DataFrame, order: str = "path", start: int = 1, partition: str | None = None) -> DataFrame:
    """Files as a numbered sequence: idx from start on, by path (or by date, for links)."""
    w = (W.partitionBy(partition) if partition else W.partitionBy()).orderBy(F.col(order).asc_nulls_last(), "path")
    return files.withColumn("idx", (F.row_number().over(w) + (start - 1)).cast("long"))


def numbered_folders(files: DataFrame, start: int = 1) -> DataFrame:
    """Several folders in one sequence: each goes on where the one before ended. Only folder counts are put in order at once."""
    counts = files.groupBy("folder").agg(F.count(F.lit(1)).alias("n"))
    offset = counts.select("folder", (F.coalesce(F.sum("n").over(W.orderBy("folder").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + start).alias("offset"))
    inner = files.withColumn("k", F.row_number().over(W.partitionBy("folder").orderBy("path")))
    return inner.join(offset, "folder").withColumn("idx", F.col("k") - 1 + F.col("offset")).drop("k", "offset")


def marked(frames: DataFrame, first: int, last: int, included: bool) -> DataFrame:
    """Frames first..last marked as included or not."""
    return frames.withColumn("included", F.when(F.col("idx").between(first, last), F.lit(included)).otherwise(F.col("included")))


def with_reference(frames: DataFrame, seq: str, number: int) -> DataFrame:
    """The number-th frame (from 1) of a sequence is its reference."""
    return frames.withColumn("is_ref", F.when(F.col("seq") == seq, F.col("idx") == number).otherwise(F.col("is_ref")))


def reference(frames: DataFrame, seq: str) -> DataFrame:
    return frames.where((F.col("seq") == seq) & F.col("is_ref"))


def merged(sequences: Sequence[DataFrame], name: str) -> DataFrame:
    """Sequences one after the other, numbered anew; two at least."""
    if len(sequences) < 2:
        raise ValueError("merging takes two sequences at least")
    both = None
    for k, s in enumerate(sequences):
        s = s.withColumn("part_", F.lit(k))
        both = s if both is None else both.unionByName(s)
    w = W.partitionBy("seq").orderBy("part_", "old_")
    return both.withColumn("seq", F.lit(name)).withColumn("old_", F.col("idx")).withColumn("idx", F.row_number().over(w).cast(both.schema["idx"].dataType)).drop("part_", "old_")


def cleaned(frames: DataFrame, registration: bool = False, statistics: bool = False, selection: bool = False) -> DataFrame:
    """Registration, statistics or selection of a sequence dropped; all of them if none is named."""
    every = not (registration or statistics or selection)
    out = frames
    if registration or every:
        out = out.drop("dx", "dy", "fwhm", "wfwhm", "roundness", "quality", "nbstars")
    if statistics or every:
        out = out.drop("bkg", "noise", "location", "scale")
    return out.withColumn("included", F.lit(True)) if (selection or every) and "included" in out.columns else out


# ---- frame filters ---------------------------------------------------------------------------------
def filter_by_value(quality: DataFrame, column: str, limit: float, lower_is_better: bool = True) -> DataFrame:
    return quality.where(F.col(column) <= limit if lower_is_better else F.col(column) >= limit)


def filter_by_percent(quality: DataFrame, column: str, percent: float, lower_is_better: bool = True, group: str = "seq", tie: str = "frame_id") -> DataFrame:
    """The best percent of each group's frames."""
    key = F.col(column).asc() if lower_is_better else F.col(column).desc()
    rank = F.percent_rank().over(W.partitionBy(group).orderBy(key, tie))
    return quality.withColumn("rank_", rank).where(F.col("rank_") <= percent / 100).drop("rank_")


def filter_by_sigma(quality: DataFrame, column: str, k: float, lower_is_better: bool = True, group: str = "seq") -> DataFrame:
    """Frames no worse than the group's mean by more than k standard deviations."""
    stats = quality.groupBy(group).agg(F.avg(column).alias("m_"), F.coalesce(F.stddev_samp(column), F.lit(0.0)).alias("s_"))
    test = F.col(column) <= F.col("m_") + k * F.col("s_") if lower_is_better else F.col(column) >= F.col("m_") - k * F.col("s_")
    return quality.join(stats, group).where(test).drop("m_", "s_")


# ---- header keys -----------------------------------------------------------------------------------
def header_values(frames: DataFrame, keys: Sequence[str], selected_only: bool = False) -> DataFrame:
    rows = frames.where("included") if selected_only else frames
    return rows.select("frame_id", "idx", *[F.try_element_at("header", F.lit(k)).alias(k) for k in keys])


def header_rows(frames: DataFrame) -> DataFrame:
    return frames.select("frame_id", F.explode("header").alias("key", "value"))


def header_set(header: Column, key: str, value: Column) -> Column:
    return F.map_concat(F.map_filter(header, lambda k, v: k != key), F.create_map(F.lit(key), value))


def header_delete(header: Column, key: str) -> Column:
    return F.map_filter(header, lambda k, v: k != key)


def header_rename(header: Column, old: str, new: str) -> Column:
    """A key under another name; a key that has the new name already gives way."""
    return F.transform_keys(F.map_filter(header, lambda k, v: (k != new) | ~F.map_contains_key(header, old)), lambda k, v: F.when(k == old, F.lit(new)).otherwise(k))


def metadata_json(frames: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """(frame_id, json): header and, if given, statistics by channel; nulls are written out."""
    rows = frames.select("frame_id", "header")
    if stats is None:
        return rows.select("frame_id", F.to_json(F.struct("header"), {"ignoreNullFields": "false"}).alias("json"))
    names = [c for c in stats.columns if c != "frame_id"]
    by = stats.groupBy("frame_id").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("statistics"))
    return rows.join(by, "frame_id", "left").select("frame_id", F.to_json(F.struct("header", "statistics"), {"ignoreNullFields": "false"}).alias("json"))
