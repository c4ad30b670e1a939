"""More registered queries: listings, headers, sequences, frame sets, locks and grids, rejections and normalisations, light curves, colour samples.

Roles: orders are files, observations and layers; events are frames with headers; lineitem rows are measures of
stars (parts) in frames (ship dates); embeddings are 8 x 8 frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from nightloom.functions import text as T
from nightloom.operators import calibration as cal, frames as fr, geometry as geo, index, photometry as ph, pointwise as pw, project, registration as reg, stacking as st, statistics as stats
from nightloom.plans import pipelines as pipes
from nightloom.plans.catalogue import COLOR, by_channel, FRAME, LONG, R, by_vec, color, frame_meta, pixels, query, rounded, stacked, table
from nightloom.sources import tree


# ==== listings and headers ===========================================================================
FILES = "f AS (SELECT o_orderkey AS id, '/p/' || o_orderstatus AS parent, CASE o_orderkey % 5 WHEN 0 THEN 'fit' WHEN 1 THEN 'FITS' WHEN 2 THEN 'Fit' WHEN 3 THEN 'xisf' END AS ext FROM orders)"


def files(spark: SparkSession, sf: str) -> DataFrame:
    """(id, path, parent, ext)."""
    key = F.col("o_orderkey")
    ext = F.when(key % 5 == 0, "fit").when(key % 5 == 1, "FITS").when(key % 5 == 2, "Fit").when(key % 5 == 3, "xisf")
    path = F.concat_ws(".", F.concat(F.lit("/p/"), "o_orderstatus", F.lit("/f"), key), ext)
    return table(spark, sf, "orders").select(key.alias("id"), path.alias("path")).select("id", "path", T.parent(F.col("path")).alias("parent"), T.extension(F.col("path")).alias("ext"))


@query(f"WITH {FILES} SELECT id, parent, ext FROM f WHERE lower(ext) IN ('fit', 'fits')")
def image_files(spark, sf):
    return tree.image_files(files(spark, sf)).select("id", "parent", "ext")


@query(f"WITH {FILES} SELECT parent, count(*) AS n FROM f WHERE lower(ext) = 'fit' GROUP BY 1")
def count_by_extension(spark, sf):
    return tree.count_by_ext(files(spark, sf), "FIT")


@query("""WITH l AS (SELECT DISTINCT o_orderstatus AS target, CAST(o_orderdate AS DATE) AS date, o_orderkey % 4 AS k FROM orders)
    SELECT '/p/LIGHT/' || target || '/' || strftime(date, '%Y-%m-%d') || CASE WHEN k < 2 THEN '/RAW_Ha_60s' ELSE '/RAW_300_OIII' END AS raw, max(CASE WHEN k % 2 = 1 THEN '/p/LIGHT/' || target || '/' || strftime(date, '%Y-%m-%d') || CASE WHEN k < 2 THEN '/PP_Ha_60s' ELSE '/PP_300_OIII' END END) AS pp,
    CASE WHEN k < 2 THEN 'Ha' ELSE 'OIII' END AS filter, CASE WHEN k < 2 THEN CAST(60 AS DOUBLE) ELSE 300 END AS exposure, date, target FROM l WHERE k <> 3 OR (target, date) IN (SELECT (target, date) FROM l WHERE k = 2) GROUP BY ALL HAVING min(k % 2) = 0""")
def scan_leaves(spark, sf):
    key = F.col("o_orderkey") % 4
    name = F.when(key == 0, "/RAW_Ha_60s").when(key == 1, "/PP_Ha_60s").when(key == 2, "/RAW_300_OIII").otherwise("/PP_300_OIII")
    folders = table(spark, sf, "orders").select(F.concat(F.lit("/p/LIGHT/"), "o_orderstatus", F.lit("/"), F.date_format("o_orderdate", "yyyy-MM-dd"), name).alias("path")).distinct()
    return tree.leaves(folders)


def headers(spark: SparkSession, sf: str) -> DataFrame:
    """(path, parent, header): files of an observation are the orders of a customer."""
    key = F.col("o_orderkey")
    pairs = [("OBJECT", F.col("o_orderpriority")), ("RA", (key % 360).cast("string")), ("DEC", F.concat(F.lit("-"), key % 90, F.lit(".5"))), ("EXPTIME", (key % 3 * 60).cast("string")), ("SET-TEMP", F.lit("-10")), ("FILTER", F.when(key % 2 == 0, "Ha")),
             ("GAIN", (key % 200).cast("string")), ("OFFSET", F.lit("1.5")), ("XBINNING", F.lit("2")), ("DATE-OBS", F.date_format("o_orderdate", "yyyy-MM-dd'T'00:00:00")), ("LIVETIME", (key % 50).cast("string")), ("STACKCNT", F.when(key % 2 == 1, (key % 7).cast("string")))]
    header = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs]), lambda e: e["value"].isNotNull()))
    folder = F.concat(F.lit("/o/"), F.col("o_custkey"))
    return table(spark, sf, "orders").select(F.concat(folder, F.lit("/"), F.lpad(key.cast("string"), 12, "0"), F.lit(".fit")).alias("path"), folder.alias("parent"), header.alias("header"))


@query("""WITH k AS (SELECT o_custkey, min(o_orderkey) AS k, count(*) AS frame_count FROM orders GROUP BY 1)
    SELECT '/o/' || o.o_custkey AS parent, frame_count, o_orderpriority AS object, CAST(k % 360 AS DOUBLE) AS ra, -(CAST(k % 90 AS DOUBLE) + 0.5) AS dec, NULL::DOUBLE AS site_lat, CAST(k % 3 * 60 AS DOUBLE) AS exposure, CAST(-10 AS DOUBLE) AS temperature, CASE WHEN k % 2 = 0 THEN 'Ha' END AS filter,
    CAST(k % 200 AS BIGINT) AS gain, NULL::BIGINT AS "offset", '2x1' AS binning, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS captured_at FROM k JOIN orders o ON o.o_orderkey = k""")
def observation_metadata(spark, sf):
    rows = tree.observation_metadata(headers(spark, sf))
    return rows.select("parent", "frame_count", "object", "ra", "dec", "site_lat", "exposure", "temperature", "filter", "gain", "offset", "binning", F.col("captured_at").cast("timestamp_ntz").alias("captured_at"))


@query("SELECT o_orderkey AS id, CAST(o_orderkey % 50 AS DOUBLE) AS live_time, CASE WHEN o_orderkey % 2 = 1 THEN CAST(o_orderkey % 7 AS BIGINT) ELSE 0 END AS stack_count, CAST(o_orderkey % 3 * 60 AS DOUBLE) AS exposure, CAST(o_orderkey % 200 AS BIGINT) AS gain FROM orders")
def stack_metadata(spark, sf):
    h = F.col("header")
    cal = tree.calibration_columns(h)
    return headers(spark, sf).select(F.regexp_extract("path", r"(\d+)\.fit$", 1).cast("long").alias("id"), *tree.stack_columns(h), cal[0], cal[3])


@query("SELECT event_id AS frame_id, unnest(['kind', 'value']) AS key, unnest([event_type, CAST(event_id % 9 AS VARCHAR)]) AS value FROM events")
def dump_header(spark, sf):
    return fr.header_rows(header_frames(spark, sf))


def header_frames(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(F.col("event_id").alias("frame_id"), F.create_map(F.lit("kind"), F.col("event_type"), F.lit("value"), (F.col("event_id") % 9).cast("string")).alias("header"), (F.col("event_id") % 4).cast("int").alias("naxis"), F.col("user_id").alias("seq"))


@query("""SELECT event_id AS frame_id, '{"header":{"kind":"' || event_type || '","value":"' || event_id % 9 || '"}}' AS json FROM events""")
def metadata_json(spark, sf):
    return fr.metadata_json(header_frames(spark, sf))


@query("SELECT user_id AS seq, bool_and(event_type = 'click' OR event_id % 4 > 2) AS all_color FROM events GROUP BY 1")
def all_color(spark, sf):
    bayer = F.when(F.col("header")["kind"] == "click", F.create_map(F.lit("BAYERPAT"), F.lit("RGGB"))).otherwise(F.create_map(F.lit("BAYERPAT"), F.lit("")))
    return stats.all_color(header_frames(spark, sf).withColumn("header", bayer), "seq")


# ==== sequences and frame sets =======================================================================
def sequence(spark: SparkSession, sf: str) -> DataFrame:
    """(seq, frame_id, path, date, idx, included, is_ref, fwhm, noise) of the orders: a sequence for each clerk."""
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("seq"), F.col("o_orderkey").alias("frame_id"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("path"), F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").alias("fwhm"), F.lit(1.0).alias("noise"))
    return fr.numbered(o, "path", 1, "seq").withColumns({"included": F.col("frame_id") % 3 != 0, "is_ref": F.lit(False)})


SEQ = "s AS (SELECT o_orderpriority AS seq, o_orderkey AS frame_id, CAST(o_orderdate AS DATE) AS date, o_totalprice AS fwhm, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS idx, o_orderkey % 3 <> 0 AS included FROM orders)"


@query(f"WITH {SEQ} SELECT seq, frame_id, idx FROM s WHERE seq = '1-URGENT' AND idx = 7")
def reference_frame(spark, sf):
    return fr.reference(fr.with_reference(sequence(spark, sf), "1-URGENT", 7), "1-URGENT").select("seq", "frame_id", "idx")


@query(f"WITH {SEQ} SELECT seq, frame_id, row_number() OVER (PARTITION BY seq ORDER BY date, frame_id) + 99 AS idx FROM s")
def link_by_date(spark, sf):
    return fr.numbered(sequence(spark, sf).drop("idx"), "date", 100, "seq").select("seq", "frame_id", "idx")


@query(f"WITH {SEQ} SELECT 'both' AS seq, frame_id, row_number() OVER (ORDER BY seq DESC, idx) AS idx FROM s WHERE seq IN ('1-URGENT', '5-LOW')")
def merge_sequences(spark, sf):
    s = sequence(spark, sf)
    return fr.merged([s.where("seq = '5-LOW'"), s.where("seq = '1-URGENT'")], "both").select("seq", "frame_id", "idx")


@query(f"WITH {SEQ} SELECT seq, frame_id, idx, true AS included FROM s")
def clean_sequence(spark, sf):
    return fr.cleaned(fr.cleaned(sequence(spark, sf), registration=True, statistics=True), selection=True).select("seq", "frame_id", "idx", "included")


@query(f"WITH {SEQ}, m AS (SELECT seq, avg(fwhm) AS m, stddev_samp(fwhm) AS s FROM s GROUP BY 1) SELECT seq, frame_id FROM s JOIN m USING (seq) WHERE fwhm <= m + 0.5 * s AND fwhm <= 200000")
def best_frames_sigma(spark, sf):
    return fr.filter_by_value(fr.filter_by_sigma(sequence(spark, sf), "fwhm", 0.5), "fwhm", 200000.0).select("seq", "frame_id")


BOUNDS = "b AS (SELECT l_orderkey AS seq, CAST(l_partkey % 7 AS INT) AS x0, CAST(l_suppkey % 5 AS INT) AS y0, CAST(l_partkey % 7 + 10 + l_linenumber AS INT) AS x1, CAST(l_suppkey % 5 + 8 AS INT) AS y1 FROM lineitem)"


def bounds(spark: SparkSession, sf: str) -> DataFrame:
    x, y = (F.col("l_partkey") % 7).cast("int"), (F.col("l_suppkey") % 5).cast("int")
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("seq"), x.alias("x0"), y.alias("y0"), (x + 10 + F.col("l_linenumber")).cast("int").alias("x1"), (y + 8).alias("y1"))


@query(f"WITH {BOUNDS} SELECT seq, max(x0) AS x0, max(y0) AS y0, min(x1) AS x1, min(y1) AS y1 FROM b GROUP BY 1")
def common_area(spark, sf):
    return geo.common_area(bounds(spark, sf))


@query(f"WITH {BOUNDS} SELECT seq, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM b GROUP BY 1")
def whole_area(spark, sf):
    return geo.whole_area(bounds(spark, sf))


# ==== projects, locks, grids =========================================================================
@query("SELECT o_orderkey AS project, CASE o_orderkey % 3 WHEN 0 THEN 'single' WHEN 1 THEN 'grid' ELSE 'spiral' END AS framing, CASE WHEN o_orderkey % 3 = 2 THEN 1 ELSE CAST(o_custkey % 4 AS INT) END AS layer_count FROM orders")
def layer_counts(spark, sf):
    key = F.col("o_orderkey")
    kinds = F.when(key % 3 == 0, "single").when(key % 3 == 1, "grid").otherwise("spiral")
    layers = F.slice(F.array(*[F.lit(str(i)) for i in range(4)]), F.lit(1), (F.col("o_custkey") % 4).cast("int"))
    return project.layer_counts(table(spark, sf, "orders").select(key.alias("project"), kinds.alias("framing"), layers.alias("layers"))).select("project", "framing", "layer_count")


@query("""WITH l AS (SELECT c_nationkey AS layer, list_sort(list(DISTINCT CAST(c_custkey AS VARCHAR))) AS paths, CAST(min(c_custkey) AS VARCHAR) AS path FROM customer GROUP BY 1)
    SELECT layer, array_to_string(list_filter(paths, lambda p: p <> path), ',') AS off, array_to_string(list_append(paths, 'new'), ',') AS on_ FROM l""")
def toggle_paths(spark, sf):
    layers = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("layer")).agg(F.array_sort(F.collect_set(F.col("c_custkey").cast("string"))).alias("paths"), F.min("c_custkey").cast("string").alias("path"))
    return layers.select("layer", F.array_join(project.toggle(F.col("paths"), F.col("path")), ",").alias("off"), F.array_join(project.toggle(F.col("paths"), F.lit("new")), ",").alias("on_"))


@query("""WITH l AS (SELECT DISTINCT c_mktsegment AS filter, c_nationkey FROM customer WHERE c_nationkey < 3), o AS (SELECT DISTINCT c_mktsegment AS filter FROM customer)
    SELECT 'n' || c_nationkey AS layer, filter, 1 AS n_paths FROM l WHERE c_nationkey = 0 UNION ALL SELECT filter, filter, 0 FROM o WHERE filter NOT IN (SELECT filter FROM l WHERE c_nationkey = 0)""")
def layer_placeholders(spark, sf):
    c = table(spark, sf, "customer")
    layers = c.where("c_nationkey = 0").select(F.concat(F.lit("n"), "c_nationkey").alias("layer"), F.col("c_mktsegment").alias("filter")).distinct().withColumn("paths", F.array(F.lit("x")))
    return project.with_placeholders(layers, c.select(F.col("c_mktsegment").alias("filter"))).select("layer", "filter", F.size("paths").alias("n_paths"))


def lock_of(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf, "orders").where(key % 7 != 0).select(
        F.col("o_orderpriority").alias("project"), key.cast("string").alias("layer"), F.lit(None).cast("string").alias("panel"), F.lit("h").alias("input_hash"), F.concat(F.lit("/m/"), key).alias("master_light"),
        F.when(key % 5 != 0, F.concat(F.lit("/r/"), key)).alias("registered_master_light"), F.lit("t0").alias("stacked_at"),
    )


def layers_of(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderpriority").alias("project"), F.col("o_orderkey").cast("string").alias("layer"))


@query("SELECT o_orderpriority AS project, CAST(o_orderkey AS VARCHAR) AS layer, o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 OR o_orderkey % 4 = 1 AS dirty FROM orders")
def dirty_registrations(spark, sf):
    there = table(spark, sf, "orders").where("o_orderkey % 4 <> 1").select(F.concat(F.lit("/r/"), "o_orderkey").alias("path"))
    return project.dirty_registrations(layers_of(spark, sf), lock_of(spark, sf), there)


@query("SELECT o_orderpriority AS project, CAST(o_orderkey AS VARCHAR) AS layer, CASE WHEN o_orderkey % 7 <> 0 THEN '/m/' || o_orderkey END AS master_light, CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 THEN '/r/' || o_orderkey END AS registered_master_light FROM orders")
def lock_lookup(spark, sf):
    return project.lock_lookup(layers_of(spark, sf), lock_of(spark, sf))


@query("SELECT o_orderpriority AS project, CAST(o_orderkey AS VARCHAR) AS layer, CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE 'h' END AS input_hash, CASE WHEN o_orderkey % 2 = 0 THEN 't1' ELSE 't0' END AS stacked_at FROM orders WHERE o_orderkey % 7 <> 0 OR o_orderkey % 2 = 0")
def updated_lock(spark, sf):
    lock = lock_of(spark, sf)
    key = F.col("o_orderkey")
    new = table(spark, sf, "orders").where(key % 2 == 0).select(F.col("o_orderpriority").alias("project"), key.cast("string").alias("layer"), F.lit(None).cast("string").alias("panel"), F.lit("new").alias("input_hash"), F.concat(F.lit("/m/"), key).alias("master_light"), F.lit(None).cast("string").alias("registered_master_light"), F.lit("t1").alias("stacked_at"))
    return project.updated_lock(lock, new).select("project", "layer", "input_hash", "stacked_at")


PANELS = "pn AS (SELECT l_orderkey AS layer, l_linenumber AS panel, l_partkey, l_suppkey FROM lineitem)"


def panels(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem")  # noqa: E741
    rows = l.groupBy(F.col("l_orderkey").cast("string").alias("layer"), F.col("l_linenumber").cast("string").alias("panel")).agg(F.array_sort(F.collect_list(F.concat(F.lit("/o/"), "l_partkey"))).alias("paths"))
    return rows.select(F.lit("p").alias("project"), F.lit("grid").alias("framing"), "layer", "panel", F.lit(None).cast("string").alias("filter"), F.lit(False).alias("extract_background"), F.lit(0.0).cast("float").alias("feather_pixels"), "paths")


@query(f"WITH {PANELS}, q AS (SELECT layer, panel, list_sort(list('/o/' || l_partkey)) AS ps FROM pn GROUP BY ALL) SELECT CAST(layer AS VARCHAR) AS layer, array_to_string(flatten(list(ps ORDER BY CAST(panel AS VARCHAR))), ',') AS paths FROM q GROUP BY layer")
def grid_layers(spark, sf):
    return project.grid_layers(panels(spark, sf)).select("layer", F.array_join("paths", ",").alias("paths"))


@query(f"WITH {PANELS} SELECT CAST(layer AS VARCHAR) AS layer, bool_and(panel % 5 <> 4 AND layer % 3 <> 1) AND layer % 4 <> 2 AS up_to_date FROM pn GROUP BY layer")
def grid_up_to_date(spark, sf):
    made = project.fingerprints(panels(spark, sf))
    key = F.col("layer").cast("long")
    lock = made.select("project", "layer", "panel", F.when(F.col("panel").cast("int") % 5 == 4, F.lit("old")).otherwise(F.col("input_hash")).alias("input_hash"), F.concat_ws("/", F.lit("/m"), "layer", "panel").alias("master_light"))
    orders = made.select("project", "layer").distinct()
    whole = orders.select("project", "layer", F.concat(F.lit("/g/"), "layer").alias("master_light"))
    there = lock.where(key % 3 != 1).select(F.col("master_light").alias("path")).unionByName(whole.where(key % 4 != 2).select(F.col("master_light").alias("path")))
    return project.grid_up_to_date(made, lock, whole, there).select("layer", "up_to_date")


@query("""SELECT o_orderkey AS observation_id, 'dark' AS kind, '/m/' || o_custkey AS path, CASE WHEN o_custkey % 3 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS master_id FROM orders""")
def masters_by_path(spark, sf):
    paths = table(spark, sf, "orders").select(F.col("o_orderkey").alias("observation_id"), F.lit("dark").alias("kind"), F.concat(F.lit("/m/"), "o_custkey").alias("path"))
    masters = table(spark, sf, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").cast("string").alias("id"), F.concat(F.lit("/m/"), "c_custkey").alias("master_path"))
    return index.masters_by_path(paths, masters.unionByName(masters.withColumn("id", F.concat(F.col("id"), F.lit("x")))))


BATCH = "b AS (SELECT o_orderkey AS observation_id, CASE WHEN o_orderkey % 5 = 0 THEN 'failed' WHEN o_orderkey % 3 = 0 THEN 'skipped' WHEN o_orderkey % 7 = 0 THEN 'failed' ELSE 'calibrated' END AS outcome, CASE o_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'dark' ELSE 'dark+flat' END AS masters FROM orders WHERE o_orderstatus <> 'F')"


def batch(spark: SparkSession, sf: str) -> DataFrame:
    o, key = table(spark, sf, "orders"), F.col("o_orderkey")
    leaf = lambda kind: F.concat(F.lit(f"/t/{kind}_Ha_"), key, F.lit("s"))
    observations = o.select(key.alias("id"), F.when(key % 5 == 0, F.concat(F.lit("/t/odd_"), key)).otherwise(leaf("RAW")).alias("raw_path"), F.when(F.col("o_orderstatus") == "F", "/done").alias("calibrated_path"), F.lit("t").alias("target_name"))
    kinds = F.slice(F.array(F.lit("dark"), F.lit("flat")), F.lit(1), (F.col("o_custkey") % 3).cast("int"))
    linked = o.select(key.alias("observation_id"), F.explode(kinds).alias("kind"))
    return index.batch_outcomes(observations, linked, o.where(key % 3 == 0).select(leaf("PP").alias("path")), o.where(key % 2 == 1).select(key.alias("observation_id"), (key % 7 != 0).alias("ok")).unionByName(o.where((key % 2 == 0) & (key % 7 == 0)).select(key.alias("observation_id"), F.lit(False).alias("ok"))))


@query(f"WITH {BATCH} SELECT * FROM b")
def batch_outcomes(spark, sf):
    return batch(spark, sf)


@query(f"WITH {BATCH} SELECT count(*) FILTER (outcome = 'calibrated') AS calibrated, count(*) FILTER (outcome = 'skipped') AS skipped, count(*) FILTER (outcome = 'failed') AS failed FROM b")
def batch_counts(spark, sf):
    return index.batch_counts(batch(spark, sf))


@query("SELECT CASE WHEN c_mktsegment <> 'BUILDING' THEN 'm31_' || c_mktsegment ELSE 'm31_' || c_mktsegment END AS layer, c_mktsegment AS filter, count(*) AS n FROM customer GROUP BY ALL")
def single_layers(spark, sf):
    obs = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("filter"), F.concat(F.lit("/raw/"), "c_custkey").alias("raw_path"), F.lit("2024-01-01").cast("date").alias("date"))
    return project.single_layers(obs, "m31").select("layer", "filter", F.size("paths").cast("long").alias("n"))


@query("SELECT CASE WHEN count(DISTINCT c_mktsegment) = 1 THEN min(c_mktsegment) END AS filter, count(DISTINCT c_mktsegment) > 1 AS several FROM customer")
def spiral_filter(spark, sf):
    return project.spiral_filter(table(spark, sf, "customer").select(F.col("c_mktsegment").alias("filter")))


# ==== rejections, normalisations, thresholds =========================================================
REPLACED = "{t} AS (SELECT vec_id, label, y, x, CASE WHEN v >= m - {k} * s AND v <= m + {k} * s THEN v ELSE m END AS v FROM (SELECT *, median(v) OVER w AS m, coalesce(stddev_samp(v) OVER w, 0) AS s FROM {f} WINDOW w AS (PARTITION BY label, y, x)))"


@query(f"WITH {LONG}, {REPLACED.format(t='q1', f='p', k=1.5)}, {REPLACED.format(t='q2', f='q1', k=1.5)} SELECT label, y, x, {R('avg(v)')} AS v FROM q2 GROUP BY ALL")
def stack_median_replaced(spark, sf):
    return stacked(st.stack(pixels(spark, sf), "mean", "median", 1.5, 1.5))


NORM = "s0 AS (SELECT vec_id, median(v) AS loc FROM p GROUP BY 1), s AS (SELECT vec_id, loc, median(abs(v - loc)) AS sc FROM p JOIN s0 USING (vec_id) GROUP BY ALL), r AS (SELECT loc AS rl, sc AS rs FROM s WHERE vec_id = 0)"


def _normalised(name: str, sql: str) -> None:
    def run(spark, sf):
        p = pixels(spark, sf).withColumn("v", F.col("v") + 2)
        return stacked(st.stack(p, "mean", "none", normalise=name, reference="0"))

    run.__name__ = f"stack_{name}"
    query(f"WITH {LONG.replace('CAST(v AS DOUBLE) AS v', 'CAST(v AS DOUBLE) + 2 AS v')}, {NORM} SELECT label, y, x, {R(f'avg({sql})')} AS v FROM p JOIN s USING (vec_id), r GROUP BY ALL")(run)


for _name, _sql in (("mul", "v * rl / loc"), ("addscale", "(v - loc) * coalesce(rs / nullif(sc, 0), 1) + rl"), ("mulscale", "v * coalesce(rs / nullif(sc, 0), 1) * coalesce(rl / nullif(loc * coalesce(rs / nullif(sc, 0), 1), 0), 1)")):
    _normalised(_name, _sql)


@query(f"WITH {LONG} SELECT vec_id, y, x, {R('greatest(v, -0.05)')} AS v FROM p")
def threshold_low(spark, sf):
    return by_vec(pw.threshold(pixels(spark, sf), low=-0.05))


@query(f"WITH {LONG} SELECT vec_id, y, x, {R('least(v, 0.05)')} AS v FROM p")
def threshold_high(spark, sf):
    return by_vec(pw.threshold(pixels(spark, sf), high=0.05))


@query(f"WITH {LONG} SELECT vec_id, {R('median(v)')} AS bg FROM p GROUP BY 1")
def background_level(spark, sf):
    return rounded(stats.background(pixels(spark, sf)).select(F.col("frame_id").cast("long").alias("vec_id"), "bg"))


@query(f"""WITH {LONG}, o AS (SELECT vec_id, y, x, v FROM p WHERE vec_id % 2 = 0 UNION ALL SELECT vec_id, 7 - y, x, v FROM p WHERE vec_id % 2 = 1) SELECT vec_id, CAST(y AS INT) AS y, x, {R('v')} AS v FROM o""")
def mirror_x_bottom_up(spark, sf):
    order = F.when(F.col("vec_id") % 2 == 0, F.create_map(F.lit("ROWORDER"), F.lit("BOTTOM-UP"))).otherwise(F.create_map(F.lit("ROWORDER"), F.lit("TOP-DOWN")))
    f = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("frame_id"), order.alias("header"))
    return by_vec(geo.mirror_x_bottom_up(pixels(spark, sf), f))


# ==== registration and colour ========================================================================
@query(f"""WITH {LONG}, k AS (SELECT p.*, CAST(vec_id % 3 AS INT) AS dx, CAST(vec_id // 3 % 2 AS INT) AS dy FROM p), m AS (SELECT vec_id, label, y - dy AS y, x - dx AS x, v FROM k)
    SELECT vec_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, {R('v')} AS v FROM m WHERE x BETWEEN 0 AND 5 AND y BETWEEN 0 AND 6""")
def register_layers(spark, sf):
    moves = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("frame_id"), (F.col("vec_id") % 3).cast("int").alias("dx"), (F.floor(F.col("vec_id") / 3) % 2).cast("int").alias("dy"))
    return by_vec(pipes.register_layers(pixels(spark, sf), "0", moves))


MIX = f"""{COLOR}, m0 AS (SELECT vec_id, 'r' AS n, y, x, abs(r) AS v FROM c UNION ALL SELECT vec_id, 'g', y, x, abs(g) FROM c UNION ALL SELECT vec_id, 'b', y, x, b FROM c)"""
STRETCH = "{t} AS (SELECT f.*, CASE WHEN (2 * mid - 1) * u - mid = 0 THEN 0 ELSE (mid - 1) * u / ((2 * mid - 1) * u - mid) END AS z FROM (SELECT f.*, least(greatest((v - lo) / (1 - lo), 0), 1) AS u, CASE WHEN (2 * {b} - 1) * least(greatest(med - lo, 0), 1) - {b} = 0 THEN 0 ELSE ({b} - 1) * least(greatest(med - lo, 0), 1) / ((2 * {b} - 1) * least(greatest(med - lo, 0), 1) - {b}) END AS mid FROM (SELECT f.*, med, greatest(med + {k} * 1.4826 * mad, 0) AS lo FROM {f} f JOIN (SELECT vec_id, n, any_value(med) AS med, median(abs(v - med)) AS mad FROM (SELECT *, median(v) OVER (PARTITION BY vec_id, n) AS med FROM {f}) GROUP BY ALL) s USING (vec_id, n)) f) f)"


def planes(spark: SparkSession, sf: str) -> DataFrame:
    """(path, y, x, v): three images r, g, b of each embedding."""
    c = color(spark, sf)
    name = F.element_at(F.array(F.lit("r"), F.lit("g"), F.lit("b")), F.col("channel") + 1)
    return c.select(F.concat(F.col("frame_id"), F.lit("/"), name).alias("path"), "y", "x", F.abs("v").alias("v"))


@query(f"""WITH {MIX}, {STRETCH.format(t='t1', f='m0', k=-2.3, b=0.15)}, w AS (SELECT vec_id, y, x, max(z) FILTER (n = 'r') AS r, max(z) FILTER (n = 'g') AS g, max(z) FILTER (n = 'b') AS b FROM t1 GROUP BY ALL),
    g1 AS (SELECT *, least(g, (r + b) / 2) AS ng FROM w), g2 AS (SELECT vec_id, y, x, coalesce((r * 0.2126 + g * 0.7152 + b * 0.0722) / nullif(r * 0.2126 + ng * 0.7152 + b * 0.0722, 0), 1) AS k, r, ng, b FROM g1), g3 AS (SELECT vec_id, y, x, r * k AS r, ng * k AS g, b * k AS b FROM g2),
    u AS (SELECT vec_id, y, x, CASE WHEN vec_id % 2 = 1 AND r > g AND b > g AND (r + g + b) / 3 > 0 THEN g + (r - g) * 0.14 ELSE r END AS r, g, CASE WHEN vec_id % 2 = 1 AND r > g AND b > g AND (r + g + b) / 3 > 0 THEN g + (b - g) * 0.14 ELSE b END AS b FROM g3),
    q AS (SELECT vec_id, 0.15 * (median((r + g + b) / 3) + stddev_samp((r + g + b) / 3)) AS t FROM u GROUP BY 1), h AS (SELECT u.*, greatest(r, g, b) AS hi, least(r, g, b) AS lo, (r + g + b) / 3 > t AS on_ FROM u JOIN q USING (vec_id)),
    s AS (SELECT *, CASE WHEN hi = 0 THEN 0 ELSE (hi - lo) / hi END AS s0 FROM h), k AS (SELECT *, CASE WHEN on_ AND s0 > 0 THEN least(s0 * 1.6, 1) / s0 ELSE 1 END AS f FROM s)
    SELECT vec_id AS project, CASE WHEN vec_id % 2 = 1 THEN 'SHO' ELSE 'RGB' END AS mix, c AS channel, y, x, {R('CASE c WHEN 0 THEN hi - (hi - r) * f WHEN 1 THEN hi - (hi - g) * f ELSE hi - (hi - b) * f END')} AS v FROM k, (VALUES (0), (1), (2)) t(c)""")
def pipeline_color_samples(spark, sf):
    key = F.col("vec_id")
    images = F.transform(F.array(F.lit("r"), F.lit("g"), F.lit("b")), lambda n: F.concat(key.cast("string"), F.lit("/"), n))
    mixes = table(spark, sf, "embeddings").select(key.alias("project"), F.when(key % 2 == 1, "SHO").otherwise("RGB").alias("mix"), images.alias("images"))
    return rounded(pipes.finished_samples(mixes, planes(spark, sf)).select("project", "mix", "channel", "y", "x", "v"))


# ==== photometry =====================================================================================
@query(f"""WITH {LONG}, a AS (SELECT vec_id, sqrt((x - 3) * (x - 3) + (y - 4) * (y - 4)) AS r, v FROM p), s AS (SELECT vec_id, count(*) FILTER (r <= 1.5) AS n, sum(v) FILTER (r <= 1.5) AS t, median(v) FILTER (r > 2 AND r <= 3.5) AS bg FROM a GROUP BY 1)
    SELECT vec_id, n, {R('bg')} AS background, {R('t - n * bg')} AS flux FROM s""")
def aperture_fluxes(spark, sf):
    stars = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("frame_id"), F.lit(0).alias("channel"), F.lit("s").alias("star"), F.lit(3.0).alias("x"), F.lit(4.0).alias("y"))
    got = ph.apertures(stars, pixels(spark, sf), 1.5, 2.0, 3.5)
    return rounded(got.select(F.col("frame_id").cast("long").alias("vec_id"), "n", "background", "flux"))


@query(f"""WITH m AS (SELECT CAST(l_shipdate AS DATE) AS frame, l_partkey AS star, log10(l_extendedprice) AS mag FROM lineitem), z AS (SELECT frame, median(star % 100 / 10.0 - mag) AS zero FROM m WHERE star % 4 = 0 GROUP BY 1)
    SELECT star AS star_id, count(*) AS n, {R('avg(mag + zero)')} AS mean, {R('stddev_samp(mag + zero)')} AS spread FROM m JOIN z USING (frame) GROUP BY 1""".replace("/ 10.0", "/ CAST(10 AS DOUBLE)"))
def light_curves(spark, sf):
    m = table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("frame_id"), F.to_date("l_shipdate").alias("time"), F.col("l_partkey").alias("star_id"), F.log10("l_extendedprice").alias("mag"))
    known = table(spark, sf, "part").where("p_partkey % 4 = 0").select(F.col("p_partkey").alias("star_id"), (F.col("p_partkey") % 100 / 10.0).alias("mag"))
    return rounded(ph.light_curves(m, known).select("star_id", "n", "mean", "spread"))


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS star, round(10 + s_suppkey % 7 / CAST(10 AS DOUBLE), 3) AS x, round(9 + s_suppkey % 5 / CAST(10 AS DOUBLE), 3) AS y, round(CAST(50 + s_suppkey % 40 AS DOUBLE), 2) AS amplitude, round(1.5 * 2 * sqrt(2 * ln(2)), 3) AS fwhm_y FROM supplier""")
def profile_fits(spark, sf):
    """Stars painted pixel by pixel, twice as long as wide at the most; what the fit must find is how they were painted."""
    key = F.col("s_suppkey")
    s = table(spark, sf, "supplier").select(key.cast("string").alias("frame_id"), (10 + key % 7 / 10.0).alias("cx"), (9 + key % 5 / 10.0).alias("cy"), (50 + key % 40).cast("double").alias("a"), (1.8 + key % 3 / 10.0).alias("sx"))
    s = s.repartition(4 * spark.sparkContext.defaultParallelism, "frame_id")  # a small file, but 420 pixels of each row
    dots = s.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(19)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(20))))
    v = 3 + F.col("a") * F.exp(-0.5 * (F.pow((F.col("x") - F.col("cx")) / F.col("sx"), 2) + F.pow((F.col("y") - F.col("cy")) / 1.5, 2)))
    image = dots.select("frame_id", F.lit(0).alias("channel"), "y", "x", v.alias("v"))
    stars = s.select("frame_id", F.lit(0).alias("channel"), F.col("frame_id").alias("star"), F.round("cx").alias("x"), F.round("cy").alias("y"))
    got = ph.profiles(stars, image, 7)
    return got.select("star", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round("amplitude", 2).alias("amplitude"), F.round("fwhm_y", 3).alias("fwhm_y"))


# ==== lights, to the end =============================================================================
@query(f"""WITH {LONG}, b AS (SELECT y, x, median(v) AS b FROM p WHERE label = 0 GROUP BY ALL), k AS (SELECT y, x, median(v) AS d FROM p WHERE label = 1 GROUP BY ALL), f0 AS (SELECT y, x, 2 + median(v) AS f FROM p WHERE label = 2 GROUP BY ALL),
    f AS (SELECT y, x, f / avg(f) OVER (PARTITION BY y % 2, x % 2) AS f FROM f0), c AS (SELECT vec_id, y, x, y % 2 + x % 2 AS ch, (v - b - d) / f AS v FROM p JOIN b USING (y, x) JOIN k USING (y, x) JOIN f USING (y, x))
    SELECT p.vec_id, CAST(q.ch AS INT) AS channel, p.y, p.x, {R('coalesce(max(q.v) FILTER (q.y = p.y AND q.x = p.x), avg(q.v))')} AS v FROM c p JOIN c q ON q.vec_id = p.vec_id AND abs(q.y - p.y) <= 1 AND abs(q.x - p.x) <= 1 GROUP BY ALL""")
def pipeline_calibrate_color(spark, sf):
    p = pixels(spark, sf)
    image = lambda k: pipes.master_bias(p.where(F.col("seq") == k))
    done = pipes.calibrate_lights(p, bias=image(0), dark=image(1), flat=image(2).withColumn("v", F.col("v") + 2), color=True)
    return rounded(done.select(F.col("frame_id").cast("long").alias("vec_id"), "channel", "y", "x", "v"))


@query(f"""WITH {LONG}, c AS (SELECT vec_id, y, x, v - avg(v) OVER (PARTITION BY vec_id) AS v FROM p), sh AS (SELECT a.range AS dy, b.range AS dx FROM range(-2, 3) a, range(-2, 3) b),
    kk AS (SELECT c.vec_id, dx, dy, avg(c.v * r.v) AS k FROM c, sh JOIN c r ON r.vec_id = 0 AND r.y = c.y - dy AND r.x = c.x - dx GROUP BY ALL), mo AS (SELECT vec_id, dx, dy FROM kk QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY k DESC, abs(dx) + abs(dy), dy DESC, dx DESC) = 1),
    mv AS (SELECT CAST(vec_id AS VARCHAR) AS id, y - dy AS y, x - dx AS x, v FROM p JOIN mo USING (vec_id)), i AS (SELECT * FROM mv WHERE x BETWEEN 0 AND 7 AND y BETWEEN 0 AND 7),
    l AS (SELECT id, median(v) AS loc FROM i GROUP BY 1), sc AS (SELECT id, loc, median(abs(v - loc)) AS scale FROM i JOIN l USING (id) GROUP BY ALL), rf AS (SELECT loc AS rloc, scale AS rscale FROM sc WHERE id = '0'),
    n AS (SELECT id, y, x, (v - loc) * coalesce(rscale / nullif(scale, 0), 1) + rloc AS v FROM i JOIN sc USING (id), rf),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY y, x ORDER BY v, id) AS DOUBLE) AS r FROM n), ft AS (SELECT y, x, regr_slope(v, r) AS a, regr_intercept(v, r) AS b, avg(v) AS mean FROM r GROUP BY ALL),
    e AS (SELECT r.*, v - coalesce(a * r + b, mean) AS e FROM r JOIN ft USING (y, x)), s AS (SELECT y, x, coalesce(stddev_samp(e), 0) AS se FROM e GROUP BY ALL),
    o AS (SELECT y, x, avg(v) AS v FROM e JOIN s USING (y, x) WHERE abs(e) <= 5 * se GROUP BY ALL)
    SELECT CAST(7 - y AS INT) AS y, CAST(x AS INT) AS x, {R('(v - (SELECT min(v) FROM o)) / (SELECT max(v) - min(v) FROM o)')} AS v FROM o""")
def pipeline_master_light_registered(spark, sf):
    p = pixels(spark, sf).withColumn("seq", F.lit(0))
    return rounded(pipes.master_light(p, reference="0", most=2).select("y", "x", "v"))


@query(f"""WITH {COLOR}, l AS (SELECT vec_id, 0 AS channel, y, x, r AS v FROM c UNION ALL SELECT vec_id, 1, y, x, g FROM c UNION ALL SELECT vec_id, 2, y, x, b FROM c), m AS (SELECT vec_id, channel, median(v) AS bg FROM l GROUP BY ALL),
    k AS (SELECT c_custkey % 50 AS vec_id, median(CAST(1 + c_custkey % 3 AS DOUBLE) / (1 + c_custkey % 2)) AS kr, median(CAST(2 AS DOUBLE)) AS kg, median(CAST(1 + c_custkey % 5 AS DOUBLE) / (2 + c_custkey % 7)) AS kb FROM customer WHERE c_custkey % 50 >= 10 GROUP BY 1)
    SELECT l.vec_id, l.channel, y, x, {R('(v - bg) * coalesce(CASE l.channel WHEN 0 THEN kr / kg WHEN 1 THEN 1 ELSE kb / kg END, 1) + bg')} AS v FROM l JOIN m USING (vec_id, channel) LEFT JOIN k USING (vec_id)""")
def photometric_colors(spark, sf):
    """Customers are stars; those of the frames 0 to 9 are seen where the catalogue has none."""
    key = F.col("c_custkey")
    c = table(spark, sf, "customer")
    at = [F.pmod(key * 0.01, F.lit(360.0)), (key % 50).cast("double")]
    catalogue = c.select(at[0].alias("ra"), at[1].alias("dec"), (1 + key % 3).cast("double").alias("cr"), F.lit(2.0).alias("cg"), (1 + key % 5).cast("double").alias("cb"))
    seen = c.select((key % 50).cast("string").alias("frame_id"), (at[0] + F.when(key % 50 < 10, 0.004).otherwise(0.0002)).alias("ra"), at[1].alias("dec"), (1 + key % 2).cast("double").alias("r"), F.lit(1.0).alias("g"), (2 + key % 7).cast("double").alias("b"))
    return by_channel(cal.color_balance(color(spark, sf), seen, catalogue, 0.001))
