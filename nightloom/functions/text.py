"""Scalar functions on text, paths, dates and labels, all as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The two leaf grammars, tried in this order, and the dates in paths.
LEAF_EXPOSURE_FIRST = r"^(RAW|PP)_(\d+(?:\.\d+)?)_(.+)$"
LEAF_FILTER_FIRST = r"^(RAW|PP)_(.+)_(\d+(?:\.\d+)?)s$"
DATE = r"(\d{4}-\d{2}-\d{2})"
DATE_TIME = r"(\d{8}-\d{6})"


def _found(c: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def extension(path: Column) -> Column:
    return _found(file_name(path), r"^.+\.([^.]*)$", 1)


def with_extension(path: Column, ext: str) -> Column:
    """Another extension in place of the last one."""
    return F.concat(F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", ""), F.lit(f".{ext}"))


def with_added_extension(path: Column, ext: str) -> Column:
    return F.concat(path, F.lit(f".{ext}"))


def relative_to(path: Column, root: Column) -> Column:
    return F.when(F.startswith(path, F.concat(root, F.lit("/"))), F.substr(path, F.length(root) + 2)).otherwise(path)


def part(path: Column, from_end: int) -> Column:
    """A path's component counted from the end (1: the last)."""
    return F.try_element_at(F.split(path, "/"), F.lit(-from_end))


def leaf(path: Column) -> Column:
    """struct(kind, exposure, filter, date, target) of a leaf folder; null if it fits neither grammar."""
    name = file_name(path)
    first, second = name.rlike(LEAF_EXPOSURE_FIRST), name.rlike(LEAF_FILTER_FIRST)
    parsed = F.struct(
        F.regexp_extract(name, "^(RAW|PP)_", 1).alias("kind"),
        F.when(first, _found(name, LEAF_EXPOSURE_FIRST, 2)).otherwise(_found(name, LEAF_FILTER_FIRST, 3)).try_cast("double").alias("exposure"),
        F.when(first, _found(name, LEAF_EXPOSURE_FIRST, 3)).otherwise(_found(name, LEAF_FILTER_FIRST, 2)).alias("filter"),
        F.when(part(path, 2).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(part(path, 2), "yyyy-MM-dd")).alias("date"),
        part(path, 3).alias("target"),
    )
    return F.when(first | second, parsed)


def counterpart(path: Column) -> Column:
    """The RAW path of a PP leaf and the other way round."""
    name = file_name(path)
    other = F.when(F.startswith(name, F.lit("RAW_")), F.regexp_replace(name, "^RAW_", "PP_")).otherwise(F.regexp_replace(name, "^PP_", "RAW_"))
    return F.concat(parent(path), F.lit("/"), other)


def path_time(path: Column) -> Column:
    """The time a path tells: a date (midnight) before a date with time, wherever they stand."""
    return F.coalesce(F.try_to_timestamp(_found(path, DATE, 1), F.lit("yyyy-MM-dd")), F.try_to_timestamp(_found(path, DATE_TIME, 1), F.lit("yyyyMMdd-HHmmss")))


def any_time(text: Column) -> Column:
    """A header's time: RFC 3339, or without zone as UTC, with or without a fraction."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(p)) for p in ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]XXX", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]", "yyyy-MM-dd")])


def slug(text: Column) -> Column:
    return F.replace(text, F.lit(" "), F.lit("_"))


def number_text(c: Column) -> Column:
    """A number without a needless fraction."""
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


def observation_label(target: Column, date: Column, filter_name: Column, exposure: Column) -> Column:
    """target / date / filter exposure s."""
    return F.concat(target, F.lit(" / "), F.date_format(date, "yyyy-MM-dd"), F.lit(" / "), filter_name, F.lit(" "), number_text(exposure), F.lit("s"))


def hours_minutes(seconds: Column) -> Column:
    """Hh MMm, to the nearest minute."""
    minutes = F.round(seconds / 60).cast("long")
    return F.format_string("%dh %02dm", F.floor(minutes / 60), minutes % 60)


def bar(share: Column, width: int) -> Column:
    """A bar of blocks for a share of 0..1."""
    n = F.greatest(F.least(F.round(share * width).cast("int"), F.lit(width)), F.lit(0))
    return F.concat(F.repeat(F.lit("█"), n), F.repeat(F.lit("░"), width - n))


def master_name(date: Column, kind: str, temperature: Column, exposure: Column | None = None, filter_name: Column | None = None) -> Column:
    """date_KIND_master_[exposure s_]temperature C[_filter]."""
    parts = [F.date_format(date, "yyyy-MM-dd"), F.lit(f"_{kind.upper()}_master_")]
    if exposure is not None:
        parts += [number_text(exposure), F.lit("s_")]
    parts += [number_text(temperature), F.lit("C")]
    if filter_name is not None:
        parts += [F.lit("_"), filter_name]
    return F.concat(*parts)


def binning(x: Column, y: Column) -> Column:
    return F.concat(F.coalesce(x, F.lit(1)).cast("string"), F.lit("x"), F.coalesce(y, F.lit(1)).cast("string"))


def csv_list(text: Column) -> Column:
    """Comma-separated items, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def command_line(name: str, *arguments: Column) -> Column:
    """A command's text: empty and null arguments left out, those with blanks in single quotes."""
    quoted = F.transform(F.array(*arguments), lambda a: F.when(F.contains(a, F.lit(" ")) & ~F.startswith(a, F.lit('"')), F.concat(F.lit("'"), a, F.lit("'"))).otherwise(a))
    return F.concat_ws(" ", F.lit(name), F.array_join(F.filter(quoted, lambda a: a.isNotNull() & (a != "")), " "))


def version(text: Column) -> Column:
    """struct(major, minor, patch) of the first word that is a version, with or without v and -rc."""
    word = F.try_element_at(F.filter(F.split(text, r"\s+"), lambda w: w.rlike(r"^v?\d+\.\d+\.\d+(-.*)?$")), F.lit(1))
    n = lambda i: F.regexp_extract(word, r"^v?(\d+)\.(\d+)\.(\d+)", i).try_cast("int")
    return F.when(word.isNotNull(), F.struct(n(1).alias("major"), n(2).alias("minor"), n(3).alias("patch")))


def preview_factor(width: Column, height: Column, bayer: Column, cap: int = 2048) -> Column:
    """How many pixels become one in a preview: the longest side over cap, rounded up; even and 2 at least for CFA frames."""
    k = F.greatest(F.ceil(F.greatest(width, height) / cap), F.lit(1))
    return F.when(bayer, F.greatest(k + k % 2, F.lit(2))).otherwise(k).cast("int")


def header_number(header: Column, key: str, integer: bool = False) -> Column:
    """A typed header value: a float takes an integer, an integer doesn't take a float."""
    text = F.try_element_at(header, F.lit(key))
    return F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(text).try_cast("bigint")) if integer else F.trim(text).try_cast("double")
