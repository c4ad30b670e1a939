"""Folder trees as tables: listings by Spark's file source, leaves by path grammar, metadata by headers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from nightloom.functions import text as T


def listing(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, parent, ext, length) of all files under root; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    path = F.regexp_replace(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "^file:(//)?", "")
    return files.select(path.alias("path"), "length").select("path", T.parent(F.col("path")).alias("parent"), T.extension(F.col("path")).alias("ext"), "length")


def image_files(files: DataFrame) -> DataFrame:
    """Files named .fit or .fits in any case, in order of their paths."""
    return files.where(F.lower("ext").isin("fit", "fits")).orderBy("path")


def count_by_ext(files: DataFrame, ext: str) -> DataFrame:
    return files.where(F.lower("ext") == ext.lower()).groupBy("parent").agg(F.count(F.lit(1)).alias("n"))


def leaves(folders: DataFrame) -> DataFrame:
    """Observations of a table of folders (path): (raw, pp, filter, exposure, date, target).

    A leaf fits one of the grammars; its RAW folder must be among the folders, also if only PP is
    given; RAW and PP of an observation are one row.
    """
    parsed = folders.select("path", T.leaf(F.col("path")).alias("leaf")).where("leaf is not null")
    raw = F.when(F.col("leaf.kind") == "RAW", F.col("path")).otherwise(T.counterpart(F.col("path")))
    both = parsed.select(raw.alias("raw"), "leaf.filter", "leaf.exposure", "leaf.date", "leaf.target").dropDuplicates(["raw"])
    known = folders.select(F.col("path").alias("raw")).distinct()
    pps = folders.select(F.col("path").alias("pp"), T.counterpart(F.col("path")).alias("raw")).where(T.file_name(F.col("pp")).startswith("PP_"))
    return both.join(known, "raw", "left_semi").join(pps, "raw", "left").select("raw", "pp", "filter", "exposure", "date", "target")


def folders_of(files: DataFrame) -> DataFrame:
    return files.select(F.col("parent").alias("path")).distinct()


def observation_metadata(headers: DataFrame) -> DataFrame:
    """Per folder of headers (path, parent, header): the first file's metadata and the number of files."""
    n = T.header_number
    h = F.col("h")
    first = headers.groupBy("parent").agg(F.min_by("header", "path").alias("h"), F.min("path").alias("path"), F.count(F.lit(1)).alias("frame_count"))
    return first.select(
        "parent", "frame_count",
        F.coalesce(F.try_element_at(h, F.lit("OBJECT")), F.lit("")).alias("object"),
        *[n(h, k).alias(a) for k, a in (("RA", "ra"), ("DEC", "dec"), ("SITELAT", "site_lat"), ("SITELONG", "site_long"))],
        *calibration_columns(h),
        F.coalesce(T.path_time(F.col("path")), T.any_time(F.try_element_at(h, F.lit("DATE-OBS")))).alias("captured_at"),
    )


def calibration_columns(h) -> list:
    """Exposure, temperature, filter, gain, offset and binning of a header map."""
    n = T.header_number
    return [
        F.coalesce(n(h, "EXPOSURE"), n(h, "EXPTIME")).alias("exposure"), n(h, "SET-TEMP").alias("temperature"), F.try_element_at(h, F.lit("FILTER")).alias("filter"),
        n(h, "GAIN", True).alias("gain"), n(h, "OFFSET", True).alias("offset"), T.binning(n(h, "XBINNING", True), n(h, "YBINNING", True)).alias("binning"),
    ]


def stack_columns(h) -> list:
    n = T.header_number
    return [F.coalesce(n(h, "LIVETIME"), F.lit(0.0)).alias("live_time"), F.coalesce(n(h, "STACKCNT", True), F.lit(0).cast("bigint")).alias("stack_count")]


def manifest(lines: DataFrame) -> DataFrame:
    """(original, converted) of the lines (value) of a conversion log."""
    pattern = r"'(.*?)'.*?'(.*?)'"
    return lines.where(F.col("value").rlike(pattern)).select(F.regexp_extract("value", pattern, 1).alias("original"), F.regexp_extract("value", pattern, 2).alias("converted"))


def moves(pairs: DataFrame, folder: str) -> DataFrame:
    """Where each converted file goes: the original's name in a folder."""
    return pairs.select(F.col("converted").alias("from"), F.concat(F.lit(folder.rstrip("/") + "/"), T.file_name(F.col("original"))).alias("to"))


def projects(spark: SparkSession, root: str, depth: int = 6) -> DataFrame:
    """Project files (px_project.json) at most `depth` folders down, outside folders that begin with a dot."""
    rows = spark.read.option("multiLine", True).option("recursiveFileLookup", "true").option("pathGlobFilter", "*project.json").json(root).withColumn("path", F.regexp_replace("_metadata.file_path", "^file:(//)?", ""))
    inner = T.relative_to(F.col("path"), F.lit(root.rstrip("/")))
    return rows.where((F.size(F.split(inner, "/")) <= depth + 1) & ~inner.rlike(r"(^|/)\.[^/]")).orderBy("name")
