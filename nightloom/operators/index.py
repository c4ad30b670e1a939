"""The index: observation, calibration and link tables as functions from tables to tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from nightloom.functions import text as T
from nightloom.schema import KINDS


# ---- reads -----------------------------------------------------------------------------------------
def with_masters(observations: DataFrame, links: DataFrame, masters: DataFrame) -> DataFrame:
    """Every observation with the paths of its linked bias, dark and flat (null where there is none)."""
    paths = links.join(masters.select(F.col("id").alias("master_id"), "master_path"), "master_id").groupBy("observation_id").pivot("kind", list(KINDS)).agg(F.first("master_path"))
    paths = paths.select(F.col("observation_id").alias("id"), *[F.col(k).alias(f"{k}_path") for k in KINDS])
    return observations.join(paths, "id", "left")


def linked_masters(observation_ids: DataFrame, links: DataFrame, masters: DataFrame) -> DataFrame:
    """The masters linked to the given observations, one row for each link."""
    return observation_ids.join(links.select("observation_id", "master_id"), "observation_id").join(masters.withColumnRenamed("id", "master_id"), "master_id")


def newest_first(table: DataFrame, key: str = "id") -> DataFrame:
    return table.orderBy(F.desc("date"), key)


def contains_text(column: str, text: str) -> Column:
    """Substring, without regard to case."""
    return F.lower(F.col(column)).contains(text.lower())


def filtered(table: DataFrame, target: str | None = None, filter_name: str | None = None, since: str | None = None, until: str | None = None, last_days: int | None = None,
             today: str | None = None, calibrated: bool | None = None, min_frames: int | None = None) -> DataFrame:
    """The observation list's filters; each None is no filter. A null frame count fails min_frames."""
    tests: list[Column] = []
    if target is not None:
        tests.append(contains_text("target_name", target))
    if filter_name is not None:
        tests.append(contains_text("filter", filter_name))
    if since is not None:
        tests.append(F.col("date") >= F.lit(since).cast("date"))
    if until is not None:
        tests.append(F.col("date") <= F.lit(until).cast("date"))
    if last_days is not None:
        day = F.current_date() if today is None else F.lit(today).cast("date")
        tests.append(F.col("date") >= F.date_sub(day, last_days))
    if calibrated is not None:
        tests.append(F.col("calibrated_path").isNotNull() if calibrated else F.col("calibrated_path").isNull())
    if min_frames is not None:
        tests.append(F.col("frame_count") >= min_frames)
    for test in tests:
        table = table.where(test)
    return table


def uncalibrated(observations: DataFrame, target: str | None = None) -> DataFrame:
    out = observations.where(F.col("calibrated_path").isNull())
    return out if target is None else out.where(F.col("target_name") == target)


def by_kinds(masters: DataFrame, kinds: Sequence[str]) -> DataFrame:
    return masters.where(F.col("kind").isin(*kinds)) if kinds else masters


def existing(keys: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """keys with found: whether the table has the key."""
    return keys.join(table.select(key).distinct().withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def masters_by_path(paths: DataFrame, masters: DataFrame) -> DataFrame:
    """paths (observation_id, kind, path) with the id of the master kept there, of the smallest id if several are; null where the index has none."""
    known = masters.groupBy(F.col("master_path").alias("path")).agg(F.min("id").alias("master_id"))
    return paths.join(known, "path", "left").select(*paths.columns, "master_id")


def batch_outcomes(observations: DataFrame, linked: DataFrame, folders: DataFrame, results: DataFrame) -> DataFrame:
    """(observation_id, outcome, masters): what a batch calibration makes of each uncalibrated observation.

    failed: its raw path isn't a RAW leaf, or its run has failed (results: observation_id, ok); skipped: the output
    folder (folders: path) is there already; calibrated otherwise. masters: kinds linked to it, in order.
    """
    kinds = linked.groupBy("observation_id").agg(F.array_join(F.array_sort(F.collect_set("kind")), "+").alias("masters"))
    rows = uncalibrated(observations).select(F.col("id").alias("observation_id"), T.leaf(F.col("raw_path"))["kind"].alias("leaf"), T.counterpart(F.col("raw_path")).alias("path"))
    joined = rows.join(kinds, "observation_id", "left").join(folders.select("path").distinct().withColumn("there", F.lit(True)), "path", "left").join(results.select("observation_id", "ok"), "observation_id", "left")
    outcome = F.when(~F.coalesce(F.col("leaf") == "RAW", F.lit(False)), "failed").when(F.col("there"), "skipped").when(F.coalesce("ok", F.lit(True)), "calibrated").otherwise("failed")
    return joined.select("observation_id", outcome.alias("outcome"), F.coalesce("masters", F.lit("")).alias("masters"))


def batch_counts(outcomes: DataFrame) -> DataFrame:
    """One row: (calibrated, skipped, failed)."""
    return outcomes.agg(*[F.count_if(F.col("outcome") == k).alias(k) for k in ("calibrated", "skipped", "failed")])


# ---- writes: new = f(old, delta) -------------------------------------------------------------------
def upsert(old: DataFrame, new: DataFrame, key: str, keep: Sequence[str] = ("id", "created_at")) -> DataFrame:
    """Rows of new replace rows of old with the same key, nulls too, but known rows keep `keep`. One row of new for each key."""
    columns = old.columns
    o = old.select(F.col(f"`{key}`"), *[F.col(f"`{c}`").alias(f"o_{c}") for c in columns if c != key], F.lit(True).alias("was"))
    n = new.select(F.col(f"`{key}`"), *[F.col(f"`{c}`").alias(f"n_{c}") for c in columns if c != key], F.lit(True).alias("now"))
    joined = o.join(n, key, "full")

    def value(c: str) -> Column:
        if c == key:
            return F.col(f"`{c}`")
        fresh = F.when(F.col("now"), F.col(f"`n_{c}`")).otherwise(F.col(f"`o_{c}`"))
        return (F.when(F.col("was"), F.col(f"`o_{c}`")).otherwise(F.col(f"`n_{c}`")) if c in keep else fresh).alias(c)

    return joined.select(*map(value, columns))


def _one_each(old: DataFrame, new: DataFrame, keys: Sequence[str], newest: bool) -> DataFrame:
    both = old.withColumn("turn_", F.lit(0)).unionByName(new.withColumn("turn_", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    pick = (F.max if newest else F.min)(F.struct("turn_", *rest)).alias("row_")
    return both.groupBy(*keys).agg(pick).select(*[F.col(c) if c in keys else F.col(f"row_.{c}").alias(c) for c in old.columns])


def link_or_ignore(old: DataFrame, new: DataFrame) -> DataFrame:
    """The first link of an observation and kind stays."""
    return _one_each(old, new, ("observation_id", "kind"), newest=False)


def link_or_replace(old: DataFrame, new: DataFrame) -> DataFrame:
    """The last link of an observation and kind counts."""
    return _one_each(old, new, ("observation_id", "kind"), newest=True)


def unlink(links: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the links (observation_id, kind) in gone."""
    return links.join(gone.select("observation_id", "kind"), ["observation_id", "kind"], "left_anti").select(*links.columns)


def clear_links(links: DataFrame, observation_ids: DataFrame) -> DataFrame:
    return links.join(observation_ids.select("observation_id"), "observation_id", "left_anti").select(*links.columns)


def delete_observations(observations: DataFrame, links: DataFrame, observation_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    gone = observation_ids.select(F.col("observation_id").alias("id"))
    return observations.join(gone, "id", "left_anti").select(*observations.columns), clear_links(links, observation_ids)


def set_calibrated_path(observations: DataFrame, paths: DataFrame) -> DataFrame:
    """paths: (id, path)."""
    new = paths.select("id", F.col("path").alias("new_"), F.lit(True).alias("hit_"))
    changed = F.when(F.col("hit_"), F.col("new_")).otherwise(F.col("calibrated_path")).alias("calibrated_path")
    return observations.join(new, "id", "left").select(*[changed if c == "calibrated_path" else F.col(f"`{c}`") for c in observations.columns])


def missing(observations: DataFrame, listing: DataFrame) -> DataFrame:
    """Observations whose raw path is not in the listing (path)."""
    return observations.join(listing.select(F.col("path").alias("raw_path")), "raw_path", "left_anti").select(*observations.columns)


def purge(observations: DataFrame, links: DataFrame, listing: DataFrame, confirm: bool = False) -> tuple[DataFrame, DataFrame]:
    """Deletes observations whose raw path is gone; does nothing unless confirmed."""
    if not confirm:
        return observations, links
    return delete_observations(observations, links, missing(observations, listing).select(F.col("id").alias("observation_id")))


def scan_insert(observations: DataFrame, scanned: DataFrame) -> DataFrame:
    """New rows only: raw paths already known are skipped."""
    fresh = scanned.join(observations.select("raw_path"), "raw_path", "left_anti")
    return observations.unionByName(fresh.select(*observations.columns))


def circular_neighbours(frames: DataFrame, group: str, order: str) -> DataFrame:
    """The next and previous row of a group's order, wrapping around."""
    w = W.partitionBy(group).orderBy(order)
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return frames.withColumns({"next": F.coalesce(F.lead(order).over(w), F.first(order).over(whole)), "previous": F.coalesce(F.lag(order).over(w), F.last(order).over(whole))})
