"""Projects: statistics, fingerprints and incremental restacking, synchronisation, colour mixes, framing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .settle import settled

#: Layers that may be sent to all tasks.
FEW_LAYERS = 200_000
# The names by which a filter is known, in any case, and the mixes in the order they are tried.
BANDS = {
    "L": ("L", "Luminance"),
    "R": ("R", "Red"),
    "G": ("G", "Green"),
    "B": ("B", "Blue"),
    "S": ("S", "S2", "S-2", "SII", "S-II", "S-Two"),
    "H": ("H", "Ha", "H-Alpha", "HAlpha"),
    "O": ("O", "O3", "O-3", "OIII", "O-III", "O-Three"),
}
MIXES = (("LRGB", "LRGB"), ("RGB", "RGB"), ("L-SHO", "LSHO"), ("SHO", "SHO"), ("L-HOO", "LHO"), ("HOO", "HO"))


# ---- statistics ------------------------------------------------------------------------------------
def layer_summary(subs: DataFrame) -> DataFrame:
    """Per (project, layer) of subs (project, layer, filter, date, subs, exposure): totals, nights, first and last light.

    exposure is that of one sub, null counts as 0; average 0 where there are no subs; nights are
    different dates that aren't null; the filter is the first one by date.
    """
    total = F.sum(F.coalesce("exposure", F.lit(0.0)) * F.col("subs"))
    return subs.groupBy("project", "layer").agg(
        F.sum("subs").cast("long").alias("sub_count"),
        total.alias("total_exposure"),
        F.when(F.sum("subs") > 0, total / F.sum("subs")).otherwise(F.lit(0.0)).alias("average_exposure"),
        F.countDistinct("date").alias("nights"),
        F.min("date").alias("first_light"),
        F.max("date").alias("last_light"),
        F.min(F.struct("date", "filter"))["filter"].alias("filter"),
    )


def project_summary(layers: DataFrame, subs: DataFrame) -> DataFrame:
    """Per project: totals over its layers (project, layer, sub_count, total_exposure, up_to_date); nights over all subs."""
    nights = subs.groupBy("project").agg(F.countDistinct("date").alias("nights"))
    sums = layers.groupBy("project").agg(
        F.count(F.lit(1)).alias("layers"), F.sum("sub_count").cast("long").alias("sub_count"), F.sum("total_exposure").alias("total_exposure"),
        F.count_if(~F.col("up_to_date")).alias("layers_needing_restack"),
    )
    return sums.join(nights, "project", "left").withColumn("nights", F.coalesce("nights", F.lit(0).cast("long")))


def filter_balance(layers: DataFrame) -> DataFrame:
    """Per (project, filter; null is unknown): subs, exposure and its percentage of the project's."""
    by = layers.groupBy("project", F.coalesce("filter", F.lit("unknown")).alias("filter")).agg(F.sum("sub_count").cast("long").alias("sub_count"), F.sum("total_exposure").alias("total_exposure"))
    whole = F.sum("total_exposure").over(W.partitionBy("project"))
    return by.withColumn("percent_of_total", F.when(whole > 0, F.col("total_exposure") / whole * 100).otherwise(F.lit(0.0)))


def layer_counts(projects: DataFrame) -> DataFrame:
    """projects (project, framing, layers): single and grid count their layers, spiral is one."""
    return projects.withColumn("layer_count", F.when(F.col("framing") == "spiral", F.lit(1)).otherwise(F.size("layers")))


def grouped_paths(observations: DataFrame) -> DataFrame:
    """Per filter: the paths, newest first (then by path)."""
    listed = F.array_sort(F.collect_list(F.struct((-F.unix_date("date")).alias("age"), F.col("raw_path").alias("path"))))
    return observations.groupBy("filter").agg(F.transform(listed, lambda s: s["path"]).alias("paths"))


# ---- fingerprints and restacking -------------------------------------------------------------------
def float_text(column: Column) -> Column:
    """A float without a needless fraction: 0, 1.5."""
    return F.regexp_replace(column.cast("string"), r"\.0$", "")


def debug_text(column: Column) -> Column:
    """Some("x") or None."""
    return F.when(column.isNull(), F.lit("None")).otherwise(F.concat(F.lit('Some("'), column, F.lit('")')))


def fingerprints(layers: DataFrame) -> DataFrame:
    """layers with input_hash: SHA-256 of name, filter, background extraction (spiral: feather) and the sorted paths."""
    third = F.when(F.col("framing") == "spiral", float_text(F.col("feather_pixels"))).otherwise(F.col("extract_background").cast("string"))
    parts = F.concat_ws("|", F.col("layer"), debug_text(F.col("filter")), third, F.array_join(F.array_sort("paths"), "|"))
    return layers.withColumn("input_hash", F.sha2(parts, 256))


def dirty_layers(layers: DataFrame, lock: DataFrame, listing: DataFrame) -> DataFrame:
    """Fingerprinted layers with dirty: no lock entry, another hash, or the stacked output is missing from the listing (path)."""
    there = listing.select(F.col("path").alias("master_light"), F.lit(True).alias("there")).distinct()
    known = lock.select("project", "layer", "panel", F.col("input_hash").alias("locked"), "master_light").join(there, "master_light", "left")
    on = F.col("l.project").eqNullSafe(F.col("k.project")) & F.col("l.layer").eqNullSafe(F.col("k.layer")) & F.col("l.panel").eqNullSafe(F.col("k.panel"))
    clean = (F.col("k.locked") == F.col("l.input_hash")) & F.coalesce("k.there", F.lit(False))
    return layers.alias("l").join(known.alias("k"), on, "left").select("l.*", (~F.coalesce(clean, F.lit(False))).alias("dirty"))


def dirty_registrations(layers: DataFrame, lock: DataFrame, listing: DataFrame) -> DataFrame:
    """(project, layer, dirty): whether a layer's registered image must be made: no lock entry, none named there, or missing from the listing (path)."""
    there = listing.select(F.col("path").alias("registered_master_light"), F.lit(True).alias("there")).distinct()
    known = lock.select("project", "layer", "registered_master_light").join(there, "registered_master_light", "left")
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"k.{k}")) for k in ("project", "layer")]
    return layers.select("project", "layer").distinct().alias("l").join(known.alias("k"), on, "left").select("l.*", (~F.coalesce("k.there", F.lit(False))).alias("dirty"))


def grid_layers(panels: DataFrame) -> DataFrame:
    """(project, layer, paths): a grid layer's observations are those of all its panels (project, layer, panel, paths), panel after panel."""
    listed = F.array_sort(F.collect_list(F.struct("panel", "paths")))
    return panels.groupBy("project", "layer").agg(F.flatten(F.transform(listed, lambda p: p["paths"])).alias("paths"))


def grid_up_to_date(panels: DataFrame, lock: DataFrame, grid_lock: DataFrame, listing: DataFrame) -> DataFrame:
    """(project, layer, up_to_date): the layer's image is locked and there, and no panel of it is dirty.

    panels: fingerprinted layers with panel; lock: their entries; grid_lock: (project, layer, master_light) of whole layers.
    """
    clean = dirty_layers(panels, lock, listing).groupBy("project", "layer").agg(F.bool_and(~F.col("dirty")).alias("clean"))
    there = grid_lock.join(listing.select(F.col("path").alias("master_light")).distinct(), "master_light", "left_semi").select("project", "layer", F.lit(True).alias("there")).distinct()
    on = [F.col(f"c.{k}").eqNullSafe(F.col(f"t.{k}")) for k in ("project", "layer")]
    return clean.alias("c").join(there.alias("t"), on, "left").select("c.project", "c.layer", (F.col("clean") & F.coalesce("there", F.lit(False))).alias("up_to_date"))


def updated_lock(lock: DataFrame, stacked: DataFrame) -> DataFrame:
    """The lock after some layers were stacked: their entries are replaced, all others keep their time."""
    keys = ["project", "layer", "panel"]
    fresh = stacked.select(*lock.columns)
    kept = lock.alias("o").join(fresh.select(*keys).alias("n"), [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "left_anti")
    return kept.unionByName(fresh)


# ---- synchronisation and editing -------------------------------------------------------------------
def sync_new(layers: DataFrame, observations: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """(project, layer, path): observations of a layer's filter that the layer lacks. A layer without a filter gets none.

    held: (project, layer, path), for layers whose paths come as rows and not as arrays. Each observation is told the layers
    that hold it, then meets the layers of its filter, which are sent to all tasks if they are few: what is wanted, many
    times the observations, is never dealt out.
    """
    if held is None:
        held = layers.select("project", "layer", F.explode("paths").alias("path"))
    holders = held.groupBy("path").agg(F.collect_set(F.struct("project", "layer")).alias("holders"))
    known = observations.select("filter", F.col("raw_path").alias("path")).where("filter is not null").join(holders, "path", "left")
    kinds = settled(layers.select("project", "layer", "filter").where("filter is not null"))
    if kinds.count() <= FEW_LAYERS:
        kinds = F.broadcast(kinds)
    holds = F.exists("holders", lambda h: (h["project"] == F.col("project")) & (h["layer"] == F.col("layer")))
    return known.join(kinds, "filter").where(~F.coalesce(holds, F.lit(False))).select("project", "layer", "path")


def apply_edits(layers: DataFrame, edits: DataFrame) -> DataFrame:
    """layers with the paths of edits (layer, paths); unknown layers are added if they have paths."""
    e = edits.select("layer", F.col("paths").alias("new_paths"), F.lit(True).alias("edited"))
    joined = layers.withColumn("known", F.lit(True)).join(e, "layer", "full").where("known or size(new_paths) > 0")
    return joined.withColumn("paths", F.when(F.col("edited"), F.col("new_paths")).otherwise(F.col("paths"))).select(*layers.columns)


def toggle(paths: Column, path: Column) -> Column:
    """Membership of one path turned over."""
    return F.when(F.array_contains(paths, path), F.array_remove(paths, path)).otherwise(F.array_append(paths, path))


def with_placeholders(layers: DataFrame, observations: DataFrame) -> DataFrame:
    """layers and an empty one for each filter of the observations that has none."""
    absent = observations.select("filter").distinct().join(layers.select("filter"), "filter", "left_anti")
    empty = absent.select(*[F.col("filter") if c == "filter" else F.col("filter").alias(c) if c == "layer" else (F.array().cast("array<string>").alias(c) if c == "paths" else F.lit(None).cast(layers.schema[c].dataType).alias(c)) for c in layers.columns])
    return layers.unionByName(empty)


def lock_lookup(layers: DataFrame, lock: DataFrame) -> DataFrame:
    """layers with the lock's stacked and registered images."""
    return layers.join(lock.select("project", "layer", "master_light", "registered_master_light"), ["project", "layer"], "left")


# ---- colour mixes ----------------------------------------------------------------------------------
def synonyms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(alias.lower(), band) for band, names in BANDS.items() for alias in names], "alias string, band string")


def color_mixes(stacks: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """(project, mix, images): what each project can compose of its stacks (project, filter, path, position).

    The first stack of a band counts. Mixes named in exclude (in any case) are left out. A project that can
    form none has each of its stacks by itself: mix Single, one image.
    """
    bands = stacks.join(F.broadcast(synonyms(stacks.sparkSession)), F.lower("filter") == F.col("alias"), "left")
    first = bands.groupBy("project").pivot("band", list(BANDS)).agg(F.min(F.struct("position", "path"))["path"])
    unwanted = {e.lower() for e in exclude}
    none = F.array().cast("array<struct<turn:int,mix:string,images:array<string>>>")
    options = [F.struct(F.lit(i).alias("turn"), F.lit(name).alias("mix"), F.array(*[F.col(b) for b in need]).alias("images")) for i, (name, need) in enumerate(MIXES) if name.lower() not in unwanted]
    mixes = first.select("project", F.filter(F.array(*options) if options else none, lambda m: F.forall(m["images"], lambda p: p.isNotNull())).alias("mixes"))
    bare = mixes.where(F.size("mixes") == 0).select("project")
    single = stacks.join(bare, stacks["project"].eqNullSafe(bare["project"]), "left_semi").select("project", F.lit("Single").alias("mix"), F.array("path").alias("images"))
    return mixes.select("project", F.explode("mixes").alias("m")).select("project", "m.mix", "m.images").unionByName(single)


# ---- framing ---------------------------------------------------------------------------------------
def single_layers(observations: DataFrame, stack: str | None = None) -> DataFrame:
    """A layer for each filter, named {stack}_{filter} or {filter}."""
    name = F.col("filter") if stack is None else F.concat_ws("_", F.lit(stack), F.col("filter"))
    return grouped_paths(observations).select(name.alias("layer"), "filter", "paths")


def spiral_filter(observations: DataFrame) -> DataFrame:
    """(filter, several): the one filter of the observations, or null and true."""
    n = F.countDistinct("filter")
    return observations.agg(F.when(n == 1, F.min("filter")).alias("filter"), (n > 1).alias("several"))


def grid_panels(grids: DataFrame) -> DataFrame:
    """(project, panel, filter, layer) of grids (project, rows, columns, filters): panels with id {row}-{column}, for each filter."""
    cells = grids.select("project", "filters", "columns", F.explode(F.sequence(F.lit(1), "rows")).alias("row")).select("project", "filters", "row", F.explode(F.sequence(F.lit(1), "columns")).alias("column"))
    named = cells.select("project", F.concat_ws("-", "row", "column").alias("panel"), "filters", F.explode("filters").alias("filter"))
    return named.select("project", "panel", "filter", F.when(F.size("filters") > 1, F.concat_ws("_", "panel", "filter")).otherwise(F.col("panel")).alias("layer"))
