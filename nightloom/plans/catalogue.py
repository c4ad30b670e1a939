"""Registered queries over the driver tables, each with DuckDB SQL for the same result.

Roles: events are observations (purchase) and masters (click dark, view flat, error bias); orders are an
observation list and an index before and after a change; lineitem rows are subs of layers; embeddings are
8 x 8 frames (with their reverse and absolute values as second and third channel where colour is needed).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from nightloom.functions import text as T
from nightloom.operators import calibration as cal, frames as fr, geometry as geo, index, match, pointwise as pw, project, registration as reg, stacking as st, statistics as stats
from nightloom.plans import pipelines as pipes
from nightloom.sources import messages, tree
from nightloom.streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
PLACES = 6


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to so many places, without negative zeros."""
    return df.select(*[(F.round(c, PLACES) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# ==== observations and masters of the events =========================================================
EVENTS = """
ev AS (SELECT event_id, user_id, event_type, value, CAST(ts AS DATE) AS d FROM events),
obs AS (SELECT CAST(event_id AS VARCHAR) AS id, d AS date, user_id AS gain, value AS temperature, CAST(event_id % 2 * 60 AS DOUBLE) AS exposure,
        CASE WHEN event_id % 2 = 0 THEN 'Ha' ELSE 'OIII' END AS filter FROM ev WHERE event_type = 'purchase'),
masters AS (SELECT CAST(event_id AS VARCHAR) AS id, CASE event_type WHEN 'click' THEN 'dark' WHEN 'view' THEN 'flat' ELSE 'bias' END AS kind,
        d AS date, user_id AS gain, value AS temperature, CASE WHEN event_type = 'click' THEN CAST(event_id % 2 * 60 AS DOUBLE) END AS exposure,
        CASE WHEN event_type = 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'Ha' ELSE 'OIII' END END AS filter,
        '/m/' || CAST(event_id AS VARCHAR) AS master_path FROM ev WHERE event_type IN ('click', 'view', 'error'))"""


def _match_sql(kind: str) -> str:
    extra = {"dark": "AND abs(m.exposure - o.exposure) <= 0.5", "flat": "AND m.filter = o.filter", "bias": ""}[kind]
    return f"""{kind}_match AS (SELECT observation_id, master_id, master_date FROM (
        SELECT o.id AS observation_id, m.id AS master_id, m.date AS master_date, row_number() OVER (PARTITION BY o.id ORDER BY m.date DESC, m.id) AS rn
        FROM obs o JOIN masters m ON m.kind = '{kind}' AND m.gain = o.gain AND abs(coalesce(m.temperature, 0) - o.temperature) <= 5.0
        AND m.date <= o.date AND m.date >= o.date - 7 {extra}) WHERE rn = 1)"""


LINKED = f"""WITH {EVENTS}, {_match_sql('dark')}, {_match_sql('flat')}, {_match_sql('bias')},
outcomes AS (SELECT o.id AS observation_id, d.master_id AS dark_id, f.master_id AS flat_id, b.master_id AS bias_id,
    CASE WHEN d.master_id IS NOT NULL AND f.master_id IS NOT NULL THEN 'dark+flat' WHEN d.master_id IS NOT NULL AND b.master_id IS NOT NULL THEN 'dark+bias'
         WHEN f.master_id IS NOT NULL THEN 'flat' WHEN d.master_id IS NOT NULL THEN 'dark' WHEN b.master_id IS NOT NULL THEN 'bias' ELSE 'none' END AS outcome
    FROM obs o LEFT JOIN dark_match d ON d.observation_id = o.id LEFT JOIN flat_match f ON f.observation_id = o.id LEFT JOIN bias_match b ON b.observation_id = o.id),
links AS (SELECT observation_id, dark_id AS master_id, 'dark' AS kind FROM outcomes WHERE outcome IN ('dark+flat', 'dark+bias', 'dark')
    UNION ALL SELECT observation_id, flat_id, 'flat' FROM outcomes WHERE outcome IN ('dark+flat', 'flat')
    UNION ALL SELECT observation_id, bias_id, 'bias' FROM outcomes WHERE outcome IN ('dark+bias', 'bias'))"""


def observations(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(observations, masters) of the events."""
    e = table(spark, sf, "events").withColumns({"id": F.col("event_id").cast("string"), "date": F.to_date("ts"), "none": F.lit(None)})
    half = F.when(F.col("event_id") % 2 == 0, "Ha").otherwise("OIII")
    exposure = (F.col("event_id") % 2 * 60).cast("double")
    common = [F.col("user_id").alias("gain"), F.col("none").cast("long").alias("offset"), F.col("none").cast("string").alias("binning"), F.col("value").alias("temperature")]
    kind = F.when(F.col("event_type") == "click", "dark").when(F.col("event_type") == "view", "flat").otherwise("bias")
    obs = e.where("event_type = 'purchase'").select("id", "date", *common, exposure.alias("exposure"), half.alias("filter"))
    masters = e.where("event_type in ('click', 'view', 'error')").select(
        "id", kind.alias("kind"), "date", *common, F.when(F.col("event_type") == "click", exposure).alias("exposure"), F.when(F.col("event_type") == "view", half).alias("filter"), F.concat(F.lit("/m/"), "id").alias("master_path")
    )
    return obs, masters


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return match.link_outcomes(*observations(spark, sf), tolerance=5.0, days=7)


@query(f"WITH {EVENTS}, {_match_sql('dark')} SELECT * FROM dark_match")
def match_dark(spark, sf):
    return match.nearest_master(*observations(spark, sf), "dark", days=7)


@query(f"WITH {EVENTS}, {_match_sql('flat')} SELECT * FROM flat_match")
def match_flat(spark, sf):
    return match.nearest_master(*observations(spark, sf), "flat", days=7)


@query(f"WITH {EVENTS}, {_match_sql('bias')} SELECT * FROM bias_match")
def match_bias(spark, sf):
    return match.nearest_master(*observations(spark, sf), "bias", days=7)


@query(LINKED + " SELECT * FROM outcomes")
def link_priority(spark, sf):
    return outcomes(spark, sf)


@query(LINKED + " SELECT outcome, count(*) AS n FROM outcomes GROUP BY outcome")
def link_tally(spark, sf):
    return match.tally(outcomes(spark, sf))


@query(LINKED + " SELECT observation_id, master_id, kind FROM links")
def relink(spark, sf):
    return match.links(outcomes(spark, sf))


@query(LINKED + """ SELECT o.id, o.date, o.filter, max(m.master_path) FILTER (l.kind = 'bias') AS bias_path, max(m.master_path) FILTER (l.kind = 'dark') AS dark_path,
    max(m.master_path) FILTER (l.kind = 'flat') AS flat_path FROM obs o LEFT JOIN links l ON l.observation_id = o.id LEFT JOIN masters m ON m.id = l.master_id GROUP BY ALL""")
def obs_with_masters(spark, sf):
    obs, masters = observations(spark, sf)
    return index.with_masters(obs, match.links(outcomes(spark, sf)), masters).select("id", "date", "filter", "bias_path", "dark_path", "flat_path")


@query(LINKED + " SELECT l.observation_id, m.id AS master_id, m.kind, m.master_path FROM links l JOIN masters m ON m.id = l.master_id")
def linked_masters(spark, sf):
    obs, masters = observations(spark, sf)
    return index.linked_masters(obs.select(F.col("id").alias("observation_id")), match.links(outcomes(spark, sf)), masters).select("observation_id", "master_id", "kind", "master_path")


@query(f"WITH {EVENTS} SELECT id, kind, date FROM masters WHERE kind IN ('dark', 'flat')")
def masters_by_kind(spark, sf):
    return index.by_kinds(observations(spark, sf)[1], ["dark", "flat"]).select("id", "kind", "date")


@query(f"WITH {EVENTS} SELECT id, date FROM obs ORDER BY date DESC, id")
def obs_newest_first(spark, sf):
    return index.newest_first(observations(spark, sf)[0]).select("id", "date")


@query("WITH " + EVENTS + " SELECT id, first_value(id) OVER g AS first_id, coalesce(lead(id) OVER w, first_value(id) OVER g) AS next, coalesce(lag(id) OVER w, last_value(id) OVER g) AS previous FROM obs WINDOW w AS (PARTITION BY gain ORDER BY id), g AS (PARTITION BY gain ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def circular_frames(spark, sf):
    from pyspark.sql import Window as W

    first = F.first("id").over(W.partitionBy("gain").orderBy("id").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return index.circular_neighbours(observations(spark, sf)[0], "gain", "id").select("id", first.alias("first_id"), "next", "previous")


# ==== the observation list ===========================================================================
LIST = """WITH obs AS (SELECT o_orderkey AS id, c_name AS target_name, o_orderpriority AS filter, CAST(o_orderdate AS DATE) AS date, o_custkey AS frame_count,
    CASE WHEN o_orderstatus <> 'O' THEN '/pp/' || o_orderkey END AS calibrated_path, '/raw/' || o_orderkey AS raw_path FROM orders JOIN customer ON c_custkey = o_custkey)"""


def listed(spark: SparkSession, sf: str) -> DataFrame:
    joined = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return joined.select(
        F.col("o_orderkey").alias("id"), F.col("c_name").alias("target_name"), F.col("o_orderpriority").alias("filter"), F.to_date("o_orderdate").alias("date"), F.col("o_custkey").alias("frame_count"),
        F.when(F.col("o_orderstatus") != "O", F.concat(F.lit("/pp/"), "o_orderkey")).alias("calibrated_path"), F.concat(F.lit("/raw/"), "o_orderkey").alias("raw_path"),
    )


@query(LIST + " SELECT id, target_name FROM obs WHERE contains(lower(target_name), '0007')")
def obs_filtered_target(spark, sf):
    return index.filtered(listed(spark, sf), target="0007").select("id", "target_name")


@query(LIST + " SELECT id, filter FROM obs WHERE contains(lower(filter), 'high')")
def obs_filtered_filter(spark, sf):
    return index.filtered(listed(spark, sf), filter_name="HIGH").select("id", "filter")


@query(LIST + " SELECT id, date FROM obs WHERE date >= DATE '1995-03-01' AND date <= DATE '1996-02-29'")
def obs_filtered_range(spark, sf):
    return index.filtered(listed(spark, sf), since="1995-03-01", until="1996-02-29").select("id", "date")


@query(LIST + " SELECT id, date FROM obs WHERE date >= DATE '1998-06-01' - 90")
def obs_filtered_days(spark, sf):
    return index.filtered(listed(spark, sf), last_days=90, today="1998-06-01").select("id", "date")


@query(LIST + " SELECT id, calibrated_path FROM obs WHERE calibrated_path IS NOT NULL")
def obs_filtered_calibrated(spark, sf):
    return index.filtered(listed(spark, sf), calibrated=True).select("id", "calibrated_path")


@query(LIST + " SELECT id, frame_count FROM obs WHERE frame_count >= 700")
def obs_filtered_minframes(spark, sf):
    return index.filtered(listed(spark, sf), min_frames=700).select("id", "frame_count")


@query(LIST + " SELECT id FROM obs WHERE calibrated_path IS NULL")
def uncalibrated(spark, sf):
    return index.uncalibrated(listed(spark, sf)).select("id")


@query("SELECT o_orderkey AS key, o_orderkey IN (SELECT l_orderkey FROM lineitem) AS found FROM orders")
def exists_by_key(spark, sf):
    return index.existing(table(spark, sf, "orders").select(F.col("o_orderkey").alias("key")), table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key")), "key")


@query(LIST + " SELECT filter, string_agg(raw_path, ',' ORDER BY date DESC, raw_path) AS paths FROM obs GROUP BY filter")
def obs_by_filter_list(spark, sf):
    return project.grouped_paths(listed(spark, sf)).select("filter", F.array_join("paths", ",").alias("paths"))


@query(LIST + " SELECT DISTINCT target_name FROM obs")
def distinct_targets(spark, sf):
    return listed(spark, sf).select("target_name").distinct().orderBy("target_name")


@query(LIST + " SELECT id, target_name || ' / ' || strftime(date, '%Y-%m-%d') || ' / ' || filter || ' ' || frame_count || 's' AS label FROM obs")
def obs_labels(spark, sf):
    return listed(spark, sf).select("id", T.observation_label(F.col("target_name"), F.col("date"), F.col("filter"), F.col("frame_count").cast("double")).alias("label"))


# ==== changes ========================================================================================
CHANGE = """WITH old AS (SELECT 'old-' || o_orderkey AS id, '/raw/' || o_orderkey AS raw_path, o_totalprice AS exposure, '/pp/' || o_orderkey AS calibrated_path FROM orders WHERE o_orderkey % 3 <> 0),
fresh AS (SELECT 'new-' || o_orderkey AS id, '/raw/' || o_orderkey AS raw_path, o_totalprice + 1 AS exposure, CASE WHEN o_orderkey % 2 = 0 THEN '/new/' || o_orderkey END AS calibrated_path FROM orders WHERE o_orderkey % 3 <> 1)"""


def change(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    text = lambda p: F.concat(F.lit(p), "o_orderkey")
    old = o.where(k % 3 != 0).select(text("old-").alias("id"), text("/raw/").alias("raw_path"), F.col("o_totalprice").alias("exposure"), text("/pp/").alias("calibrated_path"))
    new = o.where(k % 3 != 1).select(text("new-").alias("id"), text("/raw/").alias("raw_path"), (F.col("o_totalprice") + 1).alias("exposure"), F.when(k % 2 == 0, text("/new/")).alias("calibrated_path"))
    return old, new


@query(CHANGE + " SELECT coalesce(o.id, f.id) AS id, raw_path, coalesce(f.exposure, o.exposure) AS exposure, CASE WHEN f.id IS NULL THEN o.calibrated_path ELSE f.calibrated_path END AS calibrated_path FROM old o FULL JOIN fresh f USING (raw_path)")
def upsert_obs(spark, sf):
    return index.upsert(*change(spark, sf), "raw_path", keep=("id",))


@query(CHANGE + " SELECT id, raw_path, exposure, calibrated_path FROM old UNION ALL SELECT f.id, f.raw_path, f.exposure, f.calibrated_path FROM fresh f ANTI JOIN old USING (raw_path)")
def scan_insert(spark, sf):
    return index.scan_insert(*change(spark, sf))


LINKS = """WITH old AS (SELECT l_orderkey AS observation_id, min(l_partkey) AS master_id, l_returnflag AS kind FROM lineitem GROUP BY ALL),
fresh AS (SELECT l_orderkey AS observation_id, max(l_suppkey) AS master_id, l_returnflag AS kind FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL)"""


def link_change(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    li = table(spark, sf, "lineitem").withColumnsRenamed({"l_orderkey": "observation_id", "l_returnflag": "kind"})
    old = li.groupBy("observation_id", "kind").agg(F.min("l_partkey").alias("master_id"))
    return old, li.where("l_linestatus = 'O'").groupBy("observation_id", "kind").agg(F.max("l_suppkey").alias("master_id"))


@query(LINKS + " SELECT coalesce(o.observation_id, f.observation_id) AS observation_id, coalesce(o.kind, f.kind) AS kind, coalesce(o.master_id, f.master_id) AS master_id FROM old o FULL JOIN fresh f USING (observation_id, kind)")
def link_ignore(spark, sf):
    return index.link_or_ignore(*link_change(spark, sf))


@query(LINKS + " SELECT coalesce(o.observation_id, f.observation_id) AS observation_id, coalesce(o.kind, f.kind) AS kind, coalesce(f.master_id, o.master_id) AS master_id FROM old o FULL JOIN fresh f USING (observation_id, kind)")
def link_replace(spark, sf):
    return index.link_or_replace(*link_change(spark, sf))


@query(LINKS + " SELECT * FROM old ANTI JOIN fresh USING (observation_id, kind)")
def unlink(spark, sf):
    return index.unlink(*link_change(spark, sf))


@query(LINKS + " SELECT * FROM old ANTI JOIN fresh USING (observation_id)")
def clear_links(spark, sf):
    old, new = link_change(spark, sf)
    return index.clear_links(old, new.select("observation_id").distinct())


@query(LIST + " SELECT id FROM obs WHERE '/raw/' || id NOT IN (SELECT '/raw/' || l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def missing_paths(spark, sf):
    there = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.concat(F.lit("/raw/"), "l_orderkey").alias("path"))
    return index.missing(listed(spark, sf), there).select("id")


@query(LIST + " SELECT id, raw_path FROM obs WHERE '/raw/' || id IN (SELECT '/raw/' || l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def purge(spark, sf):
    there = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.concat(F.lit("/raw/"), "l_orderkey").alias("path")).distinct()
    old = link_change(spark, sf)[0]
    return index.purge(listed(spark, sf), old, there, confirm=True)[0].select("id", "raw_path")


@query(LIST + " SELECT o.id, CASE WHEN f.k IS NULL THEN o.calibrated_path ELSE '/done/' || f.k END AS calibrated_path FROM obs o LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'A') f ON f.k = o.id")
def set_calibrated(spark, sf):
    done = table(spark, sf, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("id")).distinct().withColumn("path", F.concat(F.lit("/done/"), "id"))
    return index.set_calibrated_path(listed(spark, sf), done).select("id", "calibrated_path")


# ==== projects =======================================================================================
SUBS = """WITH subs AS (SELECT l_suppkey % 7 AS project, l_suppkey AS layer, l_returnflag AS filter, CAST(l_shipdate AS DATE) AS date, CAST(l_quantity AS BIGINT) AS subs, l_discount * 100 AS exposure FROM lineitem),
layers AS (SELECT project, layer, CAST(sum(subs) AS BIGINT) AS sub_count, round(sum(round(exposure) * subs), 3) AS total_exposure, count(DISTINCT date) AS nights, min(date) AS first_light, max(date) AS last_light FROM subs GROUP BY ALL)"""


def subs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        (F.col("l_suppkey") % 7).alias("project"), F.col("l_suppkey").alias("layer"), F.col("l_returnflag").alias("filter"), F.to_date("l_shipdate").alias("date"),
        F.col("l_quantity").cast("long").alias("subs"), F.round(F.col("l_discount") * 100).alias("exposure"),
    )


@query(SUBS + " SELECT *, CASE WHEN sub_count > 0 THEN round(total_exposure / sub_count, 6) ELSE 0.0 END AS average_exposure FROM layers")
def layer_stats(spark, sf):
    out = project.layer_summary(subs(spark, sf)).drop("filter")
    return out.withColumns({"total_exposure": F.round("total_exposure", 3), "average_exposure": F.round("average_exposure", 6)})


@query(SUBS + """ SELECT l.project, count(*) AS layers, CAST(sum(sub_count) AS BIGINT) AS sub_count, round(sum(total_exposure), 3) AS total_exposure, any_value(n.nights) AS nights,
    count(*) FILTER (layer % 2 = 0) AS layers_needing_restack FROM layers l JOIN (SELECT project, count(DISTINCT date) AS nights FROM subs GROUP BY project) n USING (project) GROUP BY l.project""")
def project_stats(spark, sf):
    s = subs(spark, sf)
    layers = project.layer_summary(s).withColumn("up_to_date", F.col("layer") % 2 != 0)
    return project.project_summary(layers, s).withColumn("total_exposure", F.round("total_exposure", 3))


@query(SUBS + """, f AS (SELECT project, filter, CAST(sum(subs) AS BIGINT) AS sub_count, round(sum(round(exposure) * subs), 3) AS total_exposure FROM subs GROUP BY ALL)
    SELECT *, CASE WHEN sum(total_exposure) OVER w > 0 THEN round(total_exposure / sum(total_exposure) OVER w * 100, 6) ELSE 0.0 END AS percent_of_total FROM f WINDOW w AS (PARTITION BY project)""")
def filter_balance(spark, sf):
    by = subs(spark, sf).groupBy("project", "filter").agg(F.sum("subs").alias("sub_count"), F.sum(F.col("exposure") * F.col("subs")).alias("total_exposure"))
    return project.filter_balance(by).withColumns({"total_exposure": F.round("total_exposure", 3), "percent_of_total": F.round("percent_of_total", 6)})


FINGERPRINTS = """WITH layers AS (SELECT CAST(l_orderkey AS VARCHAR) AS layer, CASE WHEN min(l_linestatus) = 'O' THEN 'O' END AS filter, max(l_returnflag) = 'R' AS bg,
    string_agg(DISTINCT CAST(l_partkey AS VARCHAR), '|' ORDER BY CAST(l_partkey AS VARCHAR)) AS paths FROM lineitem GROUP BY l_orderkey),
prints AS (SELECT layer, filter, sha256(layer || '|' || CASE WHEN filter IS NULL THEN 'None' ELSE 'Some("' || filter || '")' END || '|' || CASE WHEN bg THEN 'true' ELSE 'false' END || '|' || paths) AS input_hash FROM layers)"""


def layers_of_orders(spark: SparkSession, sf: str) -> DataFrame:
    by = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.when(F.min("l_linestatus") == "O", "O").alias("filter"), (F.max("l_returnflag") == "R").alias("extract_background"), F.collect_set(F.col("l_partkey").cast("string")).alias("paths"),
        F.min("l_suppkey").alias("supp"),
    )
    return by.select(F.lit("p").alias("project"), F.lit("single").alias("framing"), F.col("l_orderkey").cast("string").alias("layer"), F.lit(None).cast("string").alias("panel"), "filter", "extract_background", F.lit(None).cast("float").alias("feather_pixels"), "paths", "supp")


@query(FINGERPRINTS + " SELECT * FROM prints")
def layer_fingerprint(spark, sf):
    return project.fingerprints(layers_of_orders(spark, sf)).select("layer", "filter", "input_hash")


@query(FINGERPRINTS + """, lock AS (SELECT CAST(o_orderkey AS VARCHAR) AS layer, '/out/' || o_orderkey AS master_light, o_orderkey % 2 = 0 AS same FROM orders WHERE o_orderkey % 5 <> 0)
    SELECT p.layer, NOT coalesce(l.same AND CAST(p.layer AS BIGINT) % 3 <> 0, false) AS dirty FROM prints p LEFT JOIN lock l USING (layer)""")
def dirty_layers(spark, sf):
    made = project.fingerprints(layers_of_orders(spark, sf))
    key = F.col("o_orderkey")
    orders = table(spark, sf, "orders").where(key % 5 != 0).select(key.cast("string").alias("layer"), F.concat(F.lit("/out/"), key).alias("master_light"), (key % 2 == 0).alias("same"))
    lock = made.select("project", "layer", "panel", "input_hash").join(orders, "layer").withColumn("input_hash", F.when(F.col("same"), F.col("input_hash")).otherwise(F.lit("old")))
    there = table(spark, sf, "orders").where(key % 3 != 0).select(F.concat(F.lit("/out/"), key).alias("path"))
    return project.dirty_layers(made, lock, there).select("layer", "dirty")


@query("""WITH layers AS (SELECT c_nationkey AS project, c_mktsegment AS layer, CASE WHEN c_mktsegment <> 'BUILDING' THEN min(o_orderpriority) END AS filter, list(DISTINCT o_orderkey) AS paths FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY c_nationkey, c_mktsegment)
    SELECT l.project, l.layer, o.o_orderkey AS path FROM layers l JOIN orders o ON o.o_orderpriority = l.filter WHERE NOT list_contains(l.paths, o.o_orderkey)""")
def sync_new(spark, sf):
    o = table(spark, sf, "orders")
    c = table(spark, sf, "customer").join(o.where("o_orderstatus = 'F'"), F.col("o_custkey") == F.col("c_custkey"))
    key = [F.col("c_nationkey").alias("project"), F.col("c_mktsegment").alias("layer")]
    layers = c.groupBy(*key).agg(F.min("o_orderpriority").alias("filter"))
    layers = layers.withColumn("filter", F.when(F.col("layer") != "BUILDING", F.col("filter")))
    return project.sync_new(layers, o.select(F.col("o_orderpriority").alias("filter"), F.col("o_orderkey").alias("raw_path")), c.select(*key, F.col("o_orderkey").alias("path")))


# the names of filters, written out by hand for the SQL
BAND_SQL = """('l', 'L'), ('luminance', 'L'), ('r', 'R'), ('red', 'R'), ('g', 'G'), ('green', 'G'), ('b', 'B'), ('blue', 'B'),
    ('s', 'S'), ('s2', 'S'), ('s-2', 'S'), ('sii', 'S'), ('s-ii', 'S'), ('s-two', 'S'), ('h', 'H'), ('ha', 'H'), ('h-alpha', 'H'), ('halpha', 'H'),
    ('o', 'O'), ('o3', 'O'), ('o-3', 'O'), ('oiii', 'O'), ('o-iii', 'O'), ('o-three', 'O')"""
NAMES = ("Luminance", "Red", "green", "B", "S-II", "H-Alpha", "o-iii", "X", "Lum", "Sulfur", "L", "S-Two", "O3")


@query(f"""WITH syn(alias, band) AS (VALUES {BAND_SQL}), stacks AS (SELECT p_size + p_partkey % 3 * 100 AS project, p_partkey AS position, '/s/' || p_partkey AS path, {list(NAMES)}[CASE WHEN p_partkey % 3 = 0 THEN 1 + p_partkey % 4 WHEN p_partkey % 3 = 1 THEN 9 + p_partkey % 2 ELSE p_partkey % 13 + 1 END] AS filter FROM part),
    f AS (SELECT project, band, arg_min(path, position) AS path FROM stacks JOIN syn ON alias = lower(filter) GROUP BY ALL),
    w AS (SELECT project, max(path) FILTER (band = 'L') AS l, max(path) FILTER (band = 'R') AS r, max(path) FILTER (band = 'G') AS g, max(path) FILTER (band = 'B') AS b, max(path) FILTER (band = 'S') AS s, max(path) FILTER (band = 'H') AS h, max(path) FILTER (band = 'O') AS o FROM f GROUP BY project),
    m AS (SELECT project, 'LRGB' AS mix, l || ',' || r || ',' || g || ',' || b AS images FROM w WHERE l || r || g || b IS NOT NULL UNION ALL SELECT project, 'RGB', r || ',' || g || ',' || b FROM w WHERE r || g || b IS NOT NULL
    UNION ALL SELECT project, 'L-SHO', l || ',' || s || ',' || h || ',' || o FROM w WHERE l || s || h || o IS NOT NULL UNION ALL SELECT project, 'L-HOO', l || ',' || h || ',' || o FROM w WHERE l || h || o IS NOT NULL
    UNION ALL SELECT project, 'HOO', h || ',' || o FROM w WHERE h || o IS NOT NULL)
    SELECT * FROM m UNION ALL SELECT project, 'Single', path FROM stacks WHERE project NOT IN (SELECT project FROM m)""")
def color_mixes(spark, sf):
    key = F.col("p_partkey")
    nth = F.when(key % 3 == 0, 1 + key % 4).when(key % 3 == 1, 9 + key % 2).otherwise(key % 13 + 1)
    name = F.element_at(F.array(*[F.lit(x) for x in NAMES]), nth.cast("int"))
    stacks = table(spark, sf, "part").select((F.col("p_size") + key % 3 * 100).alias("project"), key.alias("position"), F.concat(F.lit("/s/"), key).alias("path"), name.alias("filter"))
    return project.color_mixes(stacks, exclude=["sho"]).select("project", "mix", F.array_join("images", ",").alias("images"))


@query("""WITH g AS (SELECT n_nationkey AS project, n_regionkey + 1 AS rows_, n_nationkey % 4 + 1 AS columns_, CASE WHEN n_nationkey % 2 = 0 THEN ['Ha', 'OIII'] ELSE ['L'] END AS filters FROM nation)
    SELECT project, r || '-' || c AS panel, filter, CASE WHEN len(filters) > 1 THEN r || '-' || c || '_' || filter ELSE r || '-' || c END AS layer FROM (SELECT project, filters, r, c, unnest(filters) AS filter FROM (SELECT *, unnest(range(1, columns_ + 1)) AS c FROM (SELECT *, unnest(range(1, rows_ + 1)) AS r FROM g)))""")
def grid_panels(spark, sf):
    key = F.col("n_nationkey")
    filters = F.when(key % 2 == 0, F.array(F.lit("Ha"), F.lit("OIII"))).otherwise(F.array(F.lit("L")))
    grids = table(spark, sf, "nation").select(key.alias("project"), (F.col("n_regionkey") + 1).cast("int").alias("rows"), (key % 4 + 1).cast("int").alias("columns"), filters.alias("filters"))
    return project.grid_panels(grids)


@query("""WITH layers AS (SELECT o_orderpriority AS layer, string_agg(DISTINCT CAST(o_custkey AS VARCHAR), ',' ORDER BY CAST(o_custkey AS VARCHAR)) AS paths FROM orders GROUP BY 1),
    edits AS (SELECT c_mktsegment AS layer, string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY CAST(c_custkey AS VARCHAR)) AS paths FROM customer GROUP BY 1 UNION ALL SELECT '1-URGENT', 'x')
    SELECT coalesce(l.layer, e.layer) AS layer, coalesce(e.paths, l.paths) AS paths FROM layers l FULL JOIN edits e USING (layer)""")
def apply_edits(spark, sf):
    layers = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("layer")).agg(F.array_sort(F.collect_set(F.col("o_custkey").cast("string"))).alias("paths"))
    edits = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("layer")).agg(F.array_sort(F.collect_list(F.col("c_custkey").cast("string"))).alias("paths"))
    edits = edits.unionByName(spark.range(1).select(F.lit("1-URGENT").alias("layer"), F.array(F.lit("x")).alias("paths")))
    return project.apply_edits(layers, edits).select("layer", F.array_join("paths", ",").alias("paths"))


# ==== names, lines, headers ==========================================================================
LEAVES = "('/p/LIGHT/' || o_clerk_or_status || '/' || strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') || '/' || CASE o_orderkey % 4 WHEN 0 THEN 'RAW_' || o_custkey || '_Ha' WHEN 1 THEN 'RAW_OIII_' || o_custkey || '.50s' WHEN 2 THEN 'RAW_300_Ha_' || o_custkey || 's' ELSE 'Misc_' || o_custkey END)".replace("o_clerk_or_status", "o_orderstatus")


@query(f"""WITH l AS (SELECT o_orderkey AS id, {LEAVES} AS path, o_orderdate, o_orderstatus FROM orders), n AS (SELECT *, regexp_extract(path, '[^/]*$') AS name FROM l)
    SELECT id, CAST(CASE WHEN regexp_matches(name, '^(RAW|PP)_(\\d+(?:\\.\\d+)?)_(.+)$') THEN regexp_extract(name, '^(RAW|PP)_(\\d+(?:\\.\\d+)?)_(.+)$', 2) ELSE regexp_extract(name, '^(RAW|PP)_(.+)_(\\d+(?:\\.\\d+)?)s$', 3) END AS DOUBLE) AS exposure,
    CASE WHEN regexp_matches(name, '^(RAW|PP)_(\\d+(?:\\.\\d+)?)_(.+)$') THEN regexp_extract(name, '^(RAW|PP)_(\\d+(?:\\.\\d+)?)_(.+)$', 3) ELSE regexp_extract(name, '^(RAW|PP)_(.+)_(\\d+(?:\\.\\d+)?)s$', 2) END AS filter,
    CAST(o_orderdate AS DATE) AS date, o_orderstatus AS target FROM n WHERE name NOT LIKE 'Misc%'""")
def parse_leaf(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    name = F.when(k % 4 == 0, F.concat(F.lit("RAW_"), c, F.lit("_Ha"))).when(k % 4 == 1, F.concat(F.lit("RAW_OIII_"), c, F.lit(".50s"))).when(k % 4 == 2, F.concat(F.lit("RAW_300_Ha_"), c, F.lit("s"))).otherwise(F.concat(F.lit("Misc_"), c))
    path = F.concat(F.lit("/p/LIGHT/"), "o_orderstatus", F.lit("/"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("/"), name)
    rows = table(spark, sf, "orders").select(k.alias("id"), T.leaf(path).alias("l")).where("l is not null")
    return rows.select("id", "l.exposure", "l.filter", "l.date", "l.target")


@query("""SELECT event_id AS id, CASE WHEN event_id % 3 = 2 THEN CAST(date_trunc('second', ts) AS TIMESTAMP) WHEN event_id % 3 = 1 THEN CAST(CAST(ts AS DATE) AS TIMESTAMP) ELSE NULL END AS time FROM events""")
def parse_date(spark, sf):
    day, both = F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "yyyyMMdd-HHmmss")
    path = F.when(F.col("event_id") % 3 == 2, F.concat(F.lit("/x/a_"), both, F.lit(".fits"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("/x/"), day, F.lit("/a_"), both)).otherwise(F.lit("/x/none"))
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), T.path_time(path).cast("timestamp_ntz").alias("time"))


LINES = """WITH lines AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'status: starting ' || role WHEN 1 THEN 'log: ' || text WHEN 2 THEN 'progress: ' || turn * 7 || '%' ELSE CASE WHEN role = 'user' THEN 'status: success x' ELSE 'status: error x' END END AS line FROM conversations)"""


def lines(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("turn") % 4
    line = F.when(t == 0, F.concat(F.lit("status: starting "), "role")).when(t == 1, F.concat(F.lit("log: "), "text")).when(t == 2, F.concat(F.lit("progress: "), F.col("turn") * 7, F.lit("%"))).when(F.col("role") == "user", F.lit("status: success x")).otherwise(F.lit("status: error x"))
    return table(spark, sf, "conversations").select("conv_id", "turn", line.alias("line"))


@query(LINES + """ SELECT conv_id, turn, CASE WHEN line LIKE 'status: starting %' THEN 'starting' WHEN line LIKE 'log: %' THEN 'log' WHEN line LIKE 'progress: %' THEN 'progress' WHEN line LIKE 'status: success %' THEN 'success' ELSE 'error' END AS kind,
    CASE WHEN line LIKE 'log: %' THEN substr(line, 6) WHEN line LIKE 'status: %' THEN regexp_replace(line, '^status: (starting|success|error) ', '') END AS text, CASE WHEN line LIKE 'progress: %' THEN CAST(regexp_extract(line, '(\\d+)', 1) AS INT) END AS pct FROM lines""")
def parse_message(spark, sf):
    return messages.parsed(lines(spark, sf)).select("conv_id", "turn", "kind", "text", "pct")


@query(LINES + """, c AS (SELECT *, sum(CASE WHEN line LIKE 'status: starting %' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS command FROM lines)
    SELECT conv_id, CAST(command AS BIGINT) AS command, max(CASE WHEN line LIKE 'status: starting %' THEN substr(line, 18) END) AS name, count(*) FILTER (line LIKE 'log: %') AS n_logs,
    max(CASE WHEN line LIKE 'status: success %' THEN 'success' WHEN line LIKE 'status: error %' THEN 'error' END) AS outcome, max(CASE WHEN line LIKE 'progress: %' THEN CAST(regexp_extract(line, '(\\d+)', 1) AS INT) END) AS progress FROM c WHERE command > 0 GROUP BY ALL""")
def command_sessions(spark, sf):
    return messages.commands(messages.parsed(lines(spark, sf)), "turn", "conv_id").select("conv_id", "command", "name", F.size("logs").cast("long").alias("n_logs"), "outcome", "progress")


@query("SELECT page_id, regexp_extract(url, '[^/]*$') AS name, nullif(regexp_extract(url, '^[a-z]+://([^/]+)', 1), '') AS host FROM pages")
def parse_url_path(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.file_name(F.col("url")).alias("name"), F.nullif(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1), F.lit("")).alias("host"))


@query("SELECT o_orderkey AS id, '/a/' || o_custkey || '.fit' AS original, '/tmp/light_' || o_orderkey || '.fit' AS converted FROM orders WHERE o_orderkey % 2 = 1")
def parse_manifest(spark, sf):
    line = F.when(F.col("o_orderkey") % 2 == 1, F.concat(F.lit("'/a/"), "o_custkey", F.lit(".fit' -> '/tmp/light_"), "o_orderkey", F.lit(".fit'"))).otherwise(F.lit("no pair"))
    pairs = tree.manifest(table(spark, sf, "orders").select(line.alias("value")))
    return pairs.select(F.regexp_extract("converted", r"(\d+)", 1).cast("long").alias("id"), "original", "converted")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, NULL::BIGINT AS absent FROM events")
def header_keys(spark, sf):
    h = table(spark, sf, "events").select("event_id", F.from_json("props", "map<string,string>").alias("header"), F.col("event_id").alias("frame_id"), F.lit(1).alias("idx"))
    rows = fr.header_values(h.select("frame_id", "idx", "header"), ["k", "absent"])
    return rows.select(F.col("frame_id").alias("event_id"), F.col("k").cast("long").alias("k"), F.col("absent").cast("long").alias("absent"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS renamed, event_type AS kind, false AS has_old FROM events")
def header_update(spark, sf):
    h = F.from_json("props", "map<string,string>")
    new = fr.header_set(fr.header_rename(h, "k", "renamed"), "kind", F.col("event_type"))
    return table(spark, sf, "events").select("event_id", new.alias("h"), "event_type").select("event_id", F.try_element_at("h", F.lit("renamed")).alias("renamed"), F.try_element_at("h", F.lit("kind")).alias("kind"), F.map_contains_key("h", "k").alias("has_old"))


@query("SELECT o_orderkey AS id, CAST(floor(round(o_totalprice / 60) / 60) AS BIGINT) || 'h ' || lpad(CAST(CAST(round(o_totalprice / 60) AS BIGINT) % 60 AS VARCHAR), 2, '0') || 'm' AS duration FROM orders")
def durations(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), T.hours_minutes(F.col("o_totalprice")).alias("duration"))


@query("SELECT c_custkey AS id, 'stack ' || CASE WHEN contains(c_mktsegment, ' ') THEN '''' || c_mktsegment || '''' ELSE c_mktsegment END || ' ''two words''' AS line FROM customer")
def command_lines(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), T.command_line("stack", F.col("c_mktsegment"), F.lit(""), F.lit(None).cast("string"), F.lit("two words")).alias("line"))


# ==== frames =========================================================================================
LONG = "p AS (SELECT vec_id, label, CAST(pos AS INT) AS pos, CAST(v AS DOUBLE) AS v, CAST(pos // 8 AS INT) AS y, CAST(pos % 8 AS INT) AS x FROM (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding) AS v FROM embeddings))"
COLOR = "c AS (SELECT vec_id, CAST(pos % 64 // 8 AS INT) AS y, CAST(pos % 8 AS INT) AS x, max(CAST(v AS DOUBLE)) FILTER (pos < 64) AS r, max(CAST(v AS DOUBLE)) FILTER (pos >= 64 AND pos < 128) AS g, max(CAST(v AS DOUBLE)) FILTER (pos >= 128) AS b FROM (SELECT vec_id, generate_subscripts(d, 1) - 1 AS pos, unnest(d) AS v FROM (SELECT vec_id, list_concat(list_concat(embedding, list_reverse(embedding)), list_transform(embedding, lambda e: abs(e))) AS d FROM embeddings)) GROUP BY ALL)"


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    """(frame_id, seq, channel, y, x, v)."""
    e = table(spark, sf, "embeddings")
    dense = e.select(F.col("vec_id").cast("string").alias("frame_id"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.col("embedding").alias("data"))
    return fr.to_pixels(dense).join(e.select(F.col("vec_id").cast("string").alias("frame_id"), F.col("label").alias("seq")), "frame_id")


def color(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    data = F.concat("embedding", F.reverse("embedding"), F.transform("embedding", F.abs))
    return fr.to_pixels(e.select(F.col("vec_id").cast("string").alias("frame_id"), F.lit(8).alias("width"), F.lit(8).alias("height"), data.alias("data")))


def by_vec(p: DataFrame) -> DataFrame:
    return rounded(p.select(F.col("frame_id").cast("long").alias("vec_id"), "y", "x", "v"))


def stacked(p: DataFrame) -> DataFrame:
    return rounded(p.select(F.col("seq").alias("label"), "y", "x", "v"))


def _stack_sql(body: str) -> str:
    return f"WITH {LONG} {body}"


def _simple(name: str, sql: str) -> None:
    def run(spark, sf):
        return stacked(st.reduced(pixels(spark, sf), name))

    run.__name__ = f"stack_{name}"
    query(_stack_sql(f"SELECT label, y, x, round({sql}, {PLACES}) + 0.0 AS v FROM p GROUP BY ALL"))(run)


for _name, _sql in (("sum", "sum(v)"), ("min", "min(v)"), ("max", "max(v)"), ("median", "median(v)"), ("mean", "avg(v)")):
    _simple(_name, _sql)

CLIP = "{t} AS (SELECT vec_id, label, y, x, v FROM (SELECT *, median(v) OVER w AS m, coalesce(stddev_samp(v) OVER w, 0) AS s FROM {f} WINDOW w AS (PARTITION BY label, y, x)) WHERE v >= m - {k} * s AND v <= m + {k} * s)"


@query(f"WITH {LONG}, {CLIP.format(t='q1', f='p', k=2.0)}, {CLIP.format(t='q2', f='q1', k=2.0)} SELECT label, y, x, round(avg(v), {PLACES}) + 0.0 AS v FROM q2 GROUP BY ALL")
def stack_sigma(spark, sf):
    return stacked(st.stack(pixels(spark, sf), "mean", "sigma", 2.0, 2.0))


@query(f"""WITH {LONG}, m AS (SELECT label, y, x, median(v) AS m FROM p GROUP BY ALL), d AS (SELECT p.*, m.m FROM p JOIN m USING (label, y, x)), mad AS (SELECT label, y, x, median(abs(v - m)) AS mad FROM d GROUP BY ALL)
    SELECT label, y, x, round(avg(v), {PLACES}) + 0.0 AS v FROM d JOIN mad USING (label, y, x) WHERE abs(v - m) <= 3 * mad GROUP BY ALL""")
def stack_mad(spark, sf):
    return stacked(st.stack(pixels(spark, sf), "mean", "mad", 3.0))


@query(f"""WITH {LONG}, a AS (SELECT label, y, x, abs(v) AS v FROM p), m AS (SELECT label, y, x, median(v) AS m FROM a GROUP BY ALL)
    SELECT label, y, x, round(avg(v), {PLACES}) + 0.0 AS v FROM a JOIN m USING (label, y, x) WHERE m - v <= 0.5 * m AND v - m <= 0.5 * m GROUP BY ALL""")
def stack_percentile(spark, sf):
    return stacked(st.stack(pixels(spark, sf).withColumn("v", F.abs("v")), "mean", "percentile", 0.5, 0.5))


@query(f"""WITH {LONG}, m AS (SELECT label, y, x, median(v) AS m, coalesce(stddev_samp(v), 0) AS s FROM p GROUP BY ALL), d AS (SELECT p.*, m, s FROM p JOIN m USING (label, y, x)),
    ws AS (SELECT label, y, x, 1.134 * coalesce(stddev_samp(least(greatest(v, m - 1.5 * s), m + 1.5 * s)), 0) AS ws FROM d GROUP BY ALL)
    SELECT label, y, x, round(avg(v), {PLACES}) + 0.0 AS v FROM d JOIN ws USING (label, y, x) WHERE m - v <= 2 * ws AND v - m <= 2 * ws GROUP BY ALL""")
def stack_winsorized(spark, sf):
    return stacked(st.stack(pixels(spark, sf), "mean", "winsorized", 2.0, 2.0))


@query(f"""WITH {LONG}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY label, y, x ORDER BY v, CAST(vec_id AS VARCHAR)) AS DOUBLE) AS r FROM p), f AS (SELECT label, y, x, regr_slope(v, r) AS a, regr_intercept(v, r) AS b, avg(v) AS mean FROM r GROUP BY ALL),
    e AS (SELECT r.*, v - coalesce(a * r + b, mean) AS e FROM r JOIN f USING (label, y, x)), s AS (SELECT label, y, x, coalesce(stddev_samp(e), 0) AS se FROM e GROUP BY ALL)
    SELECT label, y, x, round(avg(v), {PLACES}) + 0.0 AS v FROM e JOIN s USING (label, y, x) WHERE abs(e) <= 3 * se GROUP BY ALL""")
def stack_linear(spark, sf):
    return stacked(st.stack(pixels(spark, sf), "mean", "linear", 3.0, 3.0))


@query()
def stack_esd(spark, sf):
    return stacked(st.stack(pixels(spark, sf), "mean", "generalized", 0.3, 0.05))


@query(f"""WITH {LONG}, s AS (SELECT vec_id, median(v) AS loc FROM p GROUP BY 1), n AS (SELECT p.label, p.y, p.x, p.v - s.loc + (SELECT loc FROM s WHERE vec_id = 0) AS v FROM p JOIN s USING (vec_id)) SELECT label, y, x, round(avg(v), {PLACES}) + 0.0 AS v FROM n GROUP BY ALL""")
def stack_normalised(spark, sf):
    return stacked(st.stack(pixels(spark, sf), "mean", "none", normalise="add", reference="0"))


@query(f"WITH {LONG}, s AS (SELECT label, vec_id, 1 / (stddev_samp(v) * stddev_samp(v)) AS w FROM p GROUP BY ALL) SELECT p.label, y, x, round(sum(w * v) / sum(w), {PLACES}) + 0.0 AS v FROM p JOIN s USING (vec_id) GROUP BY ALL")
def stack_weighted(spark, sf):
    p = pixels(spark, sf)
    noise = p.groupBy("frame_id", "seq").agg(F.stddev_samp("v").alias("noise"))
    return stacked(st.weighted_mean(p, st.frame_weights(noise, "noise")))


@query("SELECT n, CASE WHEN n <= 6 THEN 'percentile' WHEN n <= 30 THEN 'winsorized' ELSE 'linear' END AS name FROM (SELECT DISTINCT p_size AS n FROM part)")
def best_rejection(spark, sf):
    return table(spark, sf, "part").select(F.col("p_size").alias("n")).distinct().select("n", st.best_rejection(F.col("n"))["name"].alias("name"))


# ---- statistics -------------------------------------------------------------------------------------
R = lambda x: f"round({x}, {PLACES}) + 0.0"


@query(f"""WITH {LONG}, m AS (SELECT vec_id, median(v) AS m FROM p GROUP BY 1), b AS (SELECT vec_id, 1.4826 * median(abs(v - m)) AS bgnoise FROM p JOIN m USING (vec_id) GROUP BY 1)
    SELECT vec_id, {R('avg(v)')} AS mean, {R('median(v)')} AS median, {R('stddev_samp(v)')} AS sigma, {R('min(v)')} AS min, {R('max(v)')} AS max, {R('any_value(bgnoise)')} AS bgnoise FROM p JOIN b USING (vec_id) GROUP BY vec_id""")
def frame_stats(spark, sf):
    return rounded(stats.basic(pixels(spark, sf)).drop("channel").withColumn("vec_id", F.col("frame_id").cast("long")).drop("frame_id"))


@query(f"""WITH {LONG}, m AS (SELECT vec_id, median(v) AS md FROM p GROUP BY 1), a AS (SELECT vec_id, median(abs(v - md)) AS mad, avg(abs(v - md)) AS avg_dev, count(*) AS n FROM p JOIN m USING (vec_id) GROUP BY 1),
    t AS (SELECT p.*, md, n, mad, avg_dev, (v - md) / nullif(9 * mad, 0) AS t FROM p JOIN m USING (vec_id) JOIN a USING (vec_id))
    SELECT vec_id, {R('any_value(avg_dev)')} AS avg_dev, {R('any_value(mad)')} AS mad, {R('sqrt(any_value(n) * sum((v - md) * (v - md) * (1 - t * t) * (1 - t * t) * (1 - t * t) * (1 - t * t)) FILTER (abs(t) < 1)) / abs(sum((1 - t * t) * (1 - 5 * t * t)) FILTER (abs(t) < 1))')} AS sqrt_bwmv FROM t GROUP BY vec_id""")
def seqstat_main(spark, sf):
    return rounded(stats.main(pixels(spark, sf)).select(F.col("frame_id").cast("long").alias("vec_id"), "avg_dev", "mad", "sqrt_bwmv"))


@query(f"WITH {LONG} SELECT vec_id, CAST(y % 2 * 2 + x % 2 AS INT) AS site, {R('avg(v)')} AS mean FROM p GROUP BY ALL")
def cfa_stats(spark, sf):
    by = stats.by_cfa_site(pixels(spark, sf)).groupBy("frame_id", "site").agg(F.avg("v").alias("mean"))
    return rounded(by.select(F.col("frame_id").cast("long").alias("vec_id"), "site", "mean"))


@query(f"WITH {LONG} SELECT vec_id, CAST(least(greatest(floor((v + 1) / 0.125), 0), 15) AS INT) AS bin, count(*) AS n FROM p GROUP BY ALL")
def histogram(spark, sf):
    return stats.histogram(pixels(spark, sf), 16, -1.0, 1.0).select(F.col("frame_id").cast("long").alias("vec_id"), "bin", "n")


@query(f"WITH {LONG}, h AS (SELECT vec_id, CAST(least(greatest(floor((v + 1) / 0.125), 0), 15) AS INT) AS bin, count(*) AS n FROM p GROUP BY ALL) SELECT vec_id, {R('-sum(n / 64 * log2(n / 64))')} AS entropy FROM h GROUP BY vec_id")
def entropy(spark, sf):
    return rounded(stats.entropy(pixels(spark, sf), 16, -1.0, 1.0).select(F.col("frame_id").cast("long").alias("vec_id"), "entropy"))


@query(f"WITH {LONG} SELECT vec_id, {R('sum(abs(v) * x) / sum(abs(v))')} AS cx, {R('sum(abs(v) * y) / sum(abs(v))')} AS cy FROM p GROUP BY vec_id")
def centroid(spark, sf):
    return rounded(stats.centroid(pixels(spark, sf).withColumn("v", F.abs("v"))).select(F.col("frame_id").cast("long").alias("vec_id"), "cx", "cy"))


@query("WITH " + LONG + ", s AS (SELECT vec_id, label, stddev_samp(v) AS s FROM p GROUP BY ALL) SELECT vec_id, label FROM (SELECT *, percent_rank() OVER (PARTITION BY label ORDER BY round(s, 9), CAST(vec_id AS VARCHAR)) AS r FROM s) WHERE r <= 0.8")
def best_frames_percent(spark, sf):
    s = pixels(spark, sf).groupBy("frame_id", "seq").agg(F.round(F.stddev_samp("v"), 9).alias("s"))
    return fr.filter_by_percent(s, "s", 80).select(F.col("frame_id").cast("long").alias("vec_id"), F.col("seq").alias("label"))


# ---- calibration ------------------------------------------------------------------------------------
@query(f"""WITH {LONG}, dark AS (SELECT y, x, median(v) AS d FROM p WHERE label = 1 GROUP BY ALL), flat0 AS (SELECT y, x, 2 + median(v) AS f FROM p WHERE label = 2 GROUP BY ALL), flat AS (SELECT y, x, f / (SELECT avg(f) FROM flat0) AS f FROM flat0)
    SELECT vec_id, y, x, {R('(v - d) / f')} AS v FROM p JOIN dark USING (y, x) JOIN flat USING (y, x)""")
def calibrate_frames(spark, sf):
    p = pixels(spark, sf)
    master = lambda k: st.reduced(p.where(F.col("seq") == k), "median").select("channel", "y", "x", "v")
    return by_vec(cal.calibrate(p, dark=master(1), flat=master(2).withColumn("v", F.col("v") + 2)))


# ---- whole pipelines --------------------------------------------------------------------------------
FRAME = "fm AS (SELECT vec_id, label, DATE '2024-01-01' + CAST(vec_id % 28 AS INT) AS date, CAST(vec_id % 5 AS DOUBLE) - 10 AS temperature, CAST(60 + vec_id % 3 AS DOUBLE) AS exposure, CASE WHEN label % 2 = 0 THEN 'Ha' END AS filter FROM embeddings)"
FIRST = "h AS (SELECT label, arg_min(date, CAST(vec_id AS VARCHAR)) AS date, arg_min(temperature, CAST(vec_id AS VARCHAR)) AS temperature, arg_min(exposure, CAST(vec_id AS VARCHAR)) AS exposure, count(*) AS frame_count FROM fm GROUP BY 1)"


def frame_meta(spark: SparkSession, sf: str) -> DataFrame:
    """(seq, frame_id, date, temperature, exposure, gain, offset, binning, filter) of the frames."""
    k = F.col("vec_id")
    return table(spark, sf, "embeddings").select(
        F.col("label").alias("seq"), k.cast("string").alias("frame_id"), F.date_add(F.lit("2024-01-01").cast("date"), (k % 28).cast("int")).alias("date"), ((k % 5).cast("double") - 10).alias("temperature"), (60 + k % 3).cast("double").alias("exposure"),
        F.lit(None).cast("long").alias("gain"), F.lit(None).cast("long").alias("offset"), F.lit(None).cast("string").alias("binning"), F.when(F.col("label") % 2 == 0, "Ha").alias("filter"),
    )


def _named(image: DataFrame, rows: DataFrame) -> DataFrame:
    return rounded(image.join(F.broadcast(rows.select("seq", "name", "frame_count")), "seq").select("name", F.col("frame_count"), "y", "x", "v"))


@query(f"WITH {LONG}, {FRAME}, {FIRST} SELECT CAST(h.date AS VARCHAR) || '_BIAS_master_' || CAST(CAST(temperature AS INT) AS VARCHAR) || 'C' AS name, frame_count, y, x, {R('median(v)')} AS v FROM p JOIN h USING (label) GROUP BY ALL")
def pipeline_master_bias(spark, sf):
    return _named(pipes.master_bias(pixels(spark, sf)), pipes.master_rows(frame_meta(spark, sf), "bias"))


@query(f"WITH {LONG}, {FRAME}, {FIRST} SELECT CAST(h.date AS VARCHAR) || '_DARK_master_' || CAST(CAST(exposure AS INT) AS VARCHAR) || 's_' || CAST(CAST(temperature AS INT) AS VARCHAR) || 'C' AS name, frame_count, y, x, {R('median(v)')} AS v FROM p JOIN h USING (label) GROUP BY ALL")
def pipeline_master_dark(spark, sf):
    return _named(pipes.master_dark(pixels(spark, sf)), pipes.master_rows(frame_meta(spark, sf), "dark"))


@query(f"""WITH {LONG}, {FRAME}, {FIRST}, b AS (SELECT y, x, median(v) AS b FROM p WHERE label = 1 GROUP BY ALL), q AS (SELECT label, y, x, v - b AS v FROM p JOIN b USING (y, x)),
    m AS (SELECT label, y, x, median(v) AS m, coalesce(stddev_samp(v), 0) AS s FROM q GROUP BY ALL), d AS (SELECT q.*, m, s FROM q JOIN m USING (label, y, x)),
    ws AS (SELECT label, y, x, 1.134 * coalesce(stddev_samp(least(greatest(v, m - 1.5 * s), m + 1.5 * s)), 0) AS ws FROM d GROUP BY ALL)
    SELECT CAST(h.date AS VARCHAR) || '_FLAT_master_' || CAST(CAST(temperature AS INT) AS VARCHAR) || 'C_' || CASE WHEN label % 2 = 0 THEN 'Ha' ELSE 'OIII' END AS name, frame_count, y, x, {R('avg(v)')} AS v FROM d JOIN ws USING (label, y, x) JOIN h USING (label) WHERE m - v <= 3 * ws AND v - m <= 3 * ws GROUP BY ALL""")
def pipeline_master_flat(spark, sf):
    p = pixels(spark, sf)
    return _named(pipes.master_flat(p, pipes.master_bias(p.where("seq = 1"))), pipes.master_rows(frame_meta(spark, sf), "flat", "OIII"))


@query(f"""WITH {LONG}, b AS (SELECT y, x, median(v) AS b FROM p WHERE label = 0 GROUP BY ALL), k AS (SELECT y, x, median(v) AS d FROM p WHERE label = 1 GROUP BY ALL), f0 AS (SELECT y, x, 2 + median(v) AS f FROM p WHERE label = 2 GROUP BY ALL), f AS (SELECT y, x, f / (SELECT avg(f) FROM f0) AS f FROM f0)
    SELECT vec_id, y, x, {R('(v - b - d) / f')} AS v FROM p JOIN b USING (y, x) JOIN k USING (y, x) JOIN f USING (y, x)""")
def pipeline_calibrate_lights(spark, sf):
    p = pixels(spark, sf)
    image = lambda k: pipes.master_bias(p.where(F.col("seq") == k))
    return by_vec(pipes.calibrate_lights(p, bias=image(0), dark=image(1), flat=image(2).withColumn("v", F.col("v") + 2)))


@query(f"WITH {FRAME} SELECT label AS seq, coalesce(arg_min(filter, CAST(vec_id AS VARCHAR)), 'L') AS filter, count(*) AS frame_count, arg_min(exposure, CAST(vec_id AS VARCHAR)) AS exposure, CAST(0 AS BIGINT) AS gain FROM fm GROUP BY 1")
def pipeline_calibrated_rows(spark, sf):
    return pipes.calibrated_rows(frame_meta(spark, sf), flat_filter="L").select("seq", "filter", "frame_count", "exposure", "gain")


@query(f"""WITH {LONG}, mv AS (SELECT CAST(vec_id AS VARCHAR) AS id, y - CAST(vec_id // 3 % 2 AS INT) AS y, x - CAST(vec_id % 3 AS INT) + 1 AS x, v FROM p), i AS (SELECT * FROM mv WHERE x BETWEEN 0 AND 7 AND y BETWEEN 0 AND 7),
    l AS (SELECT id, median(v) AS loc FROM i GROUP BY 1), sc AS (SELECT id, loc, median(abs(v - loc)) AS scale FROM i JOIN l USING (id) GROUP BY ALL), rf AS (SELECT loc AS rloc, scale AS rscale FROM sc WHERE id = '0'),
    n AS (SELECT id, y, x, (v - loc) * coalesce(rscale / nullif(scale, 0), 1) + rloc AS v FROM i JOIN sc USING (id), rf),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY y, x ORDER BY v, id) AS DOUBLE) AS r FROM n), ft AS (SELECT y, x, regr_slope(v, r) AS a, regr_intercept(v, r) AS b, avg(v) AS mean FROM r GROUP BY ALL),
    e AS (SELECT r.*, v - coalesce(a * r + b, mean) AS e FROM r JOIN ft USING (y, x)), s AS (SELECT y, x, coalesce(stddev_samp(e), 0) AS se FROM e GROUP BY ALL),
    o AS (SELECT y, x, avg(v) AS v FROM e JOIN s USING (y, x) WHERE abs(e) <= 5 * se GROUP BY ALL)
    SELECT 7 - y AS y, x, {R('(v - (SELECT min(v) FROM o)) / (SELECT max(v) - min(v) FROM o)')} AS v FROM o""")
def pipeline_master_light(spark, sf):
    p = pixels(spark, sf).withColumn("seq", F.lit(0))
    moves = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("frame_id"), (F.col("vec_id") % 3 - 1).cast("int").alias("dx"), (F.floor(F.col("vec_id") / 3) % 2).cast("int").alias("dy"))
    return rounded(pipes.master_light(p, reference="0", moves=moves).select("y", "x", "v"))


@query(f"""WITH {LONG}, s AS (SELECT median(v) AS m, stddev_samp(v) AS s FROM (SELECT y, x, median(v) AS v FROM p WHERE label = 1 GROUP BY ALL)) SELECT y, x FROM (SELECT y, x, median(v) AS v FROM p WHERE label = 1 GROUP BY ALL), s WHERE v < m - 1.5 * s OR v > m + 1.5 * s""")
def bad_pixels(spark, sf):
    dark = st.reduced(pixels(spark, sf).where("seq = 1"), "median")
    return cal.bad_pixels(dark, 1.5, 1.5).select("y", "x")


@query(f"""WITH {LONG}, n AS (SELECT p.vec_id, p.y, p.x, median(q.v) AS m FROM p JOIN p q ON q.vec_id = p.vec_id AND abs(q.y - p.y) <= 1 AND abs(q.x - p.x) <= 1 GROUP BY ALL) SELECT vec_id, y, x, {R('m')} AS v FROM n""")
def median_filter(spark, sf):
    return by_vec(cal.median_filter(pixels(spark, sf)))


@query(f"""WITH {LONG}, bad AS (SELECT y, x FROM p WHERE vec_id = 0 AND v > 0.15), n AS (SELECT p.vec_id, p.y, p.x, median(q.v) AS m FROM p JOIN bad USING (y, x) JOIN p q ON q.vec_id = p.vec_id AND abs(q.y - p.y) <= 1 AND abs(q.x - p.x) <= 1 WHERE (q.y, q.x) NOT IN (SELECT (y, x) FROM bad) GROUP BY ALL)
    SELECT vec_id, y, x, {R('coalesce(m, v)')} AS v FROM p LEFT JOIN n USING (vec_id, y, x)""")
def cosmetic(spark, sf):
    p = pixels(spark, sf)
    return by_vec(cal.cosmetic(p, p.where("frame_id = '0' and v > 0.15").select("channel", "y", "x")))


@query(f"""WITH {LONG}, f AS (SELECT p.vec_id, regr_slope(r.v, p.v) AS a, regr_intercept(r.v, p.v) AS b FROM p JOIN p r ON r.vec_id = 0 AND r.y = p.y AND r.x = p.x AND r.v BETWEEN -0.2 AND 0.2 GROUP BY 1) SELECT vec_id, y, x, {R('a * v + b')} AS v FROM p JOIN f USING (vec_id)""")
def linear_match(spark, sf):
    p = pixels(spark, sf)
    return by_vec(pw.linear_match(p, p.where("frame_id = '0'"), -0.2, 0.2))


# ---- closed forms -----------------------------------------------------------------------------------
def _point(name: str, sql: str, f: Callable[[DataFrame], DataFrame]) -> None:
    def run(spark, sf):
        return by_vec(f(pixels(spark, sf)))

    run.__name__ = name
    query(f"WITH {LONG}, e AS (SELECT vec_id, min(v) AS lo, max(v) AS hi FROM p GROUP BY 1) SELECT vec_id, y, x, {R(sql)} AS v FROM p JOIN e USING (vec_id)")(run)


X = "least(greatest((v - 0.0) / 0.8, 0.0), 1.0)"
_point("stretch_mtf", f"coalesce((0.25 - 1) * {X} / nullif((2 * 0.25 - 1) * {X} - 0.25, 0), 0.0)", lambda p: pw.mtf(p, 0.0, 0.25, 0.8))
_point("stretch_asinh", "asinh(abs(v) * 20) / asinh(20.0)", lambda p: pw.apply(p.withColumn("v", F.abs("v")), lambda v: pw.asinh_of(v, 20.0)))
_point("stretch_linear", "least(greatest((v - 0.1) / 0.9, 0.0), 1.0)", lambda p: pw.linear_stretch(p, 0.1))
_point("stretch_ghs", "(1 - exp(-abs(v) * 3)) / (1 - exp(-3.0))", lambda p: pw.apply(p.withColumn("v", F.abs("v")), lambda v: pw.ght_of(v, 3.0)))
_point("stretch_log", "ln(greatest(1 - (v - lo) / (hi - lo), 1e-10))", pw.log)
_point("limit_clip", "least(greatest(v, 0.0), 1.0)", lambda p: pw.limit(p, "clip"))
_point("limit_posrescale", "greatest(v / greatest(hi, 1.0), 0.0)", lambda p: pw.limit(p, "posrescale"))
_point("limit_rescale", "(v - least(lo, 0.0)) / greatest(hi - least(lo, 0.0), 1.0)", lambda p: pw.limit(p, "rescale"))
_point("threshold_both", "least(greatest(v, -0.1), 0.1)", lambda p: pw.threshold(p, -0.1, 0.1))
_point("negative", "1.0 - v", pw.negative)
_point("no_zero", "CASE WHEN round(v, 1) = 0 THEN 0.5 ELSE round(v, 1) END", lambda p: pw.no_zero(p.withColumn("v", F.round("v", 1)), 0.5))
_point("scale_offset", "(v * 2.0 + 0.25) / 4.0", lambda p: pw.scalar(pw.scalar(pw.scalar(p, "fmul", 2.0), "offset", 0.25), "fdiv", 4.0))


@query(f"""WITH {LONG}, m AS (SELECT vec_id, median(v) AS med FROM p GROUP BY 1), d AS (SELECT vec_id, any_value(med) AS med, median(abs(v - med)) AS mad FROM p JOIN m USING (vec_id) GROUP BY 1),
    s AS (SELECT vec_id, greatest(med - 2.8 * 1.4826 * mad, 0.0) AS lo, least(greatest(med - greatest(med - 2.8 * 1.4826 * mad, 0.0), 0.0), 1.0) AS z FROM d), k AS (SELECT vec_id, lo, coalesce((0.25 - 1) * z / nullif((0.5 - 1) * z - 0.25, 0), 0.0) AS mid FROM s),
    x AS (SELECT p.*, mid, least(greatest((v - lo) / (1 - lo), 0.0), 1.0) AS t FROM p JOIN k USING (vec_id)) SELECT vec_id, y, x, {R('coalesce((mid - 1) * t / nullif((2 * mid - 1) * t - mid, 0), 0.0)')} AS v FROM x""")
def autostretch(spark, sf):
    return by_vec(pw.autostretch(pixels(spark, sf)))


@query(f"WITH {LONG} SELECT a.vec_id, a.y, a.x, {R('a.v - b.v')} AS v FROM p a JOIN p b ON b.vec_id = 0 AND b.y = a.y AND b.x = a.x")
def subtract_image(spark, sf):
    p = pixels(spark, sf)
    return by_vec(pw.between_frames(p, p.where("frame_id = '0'"), "isub"))


@query(f"WITH {LONG}, m AS (SELECT y, x, sqrt(abs(a.v)) + 2 * b.v AS v FROM (SELECT * FROM p WHERE vec_id = 0) a JOIN (SELECT * FROM p WHERE vec_id = 1) b USING (y, x)) SELECT y, x, {R('(v - (SELECT min(v) FROM m)) / (SELECT max(v) - min(v) FROM m)')} AS v FROM m")
def pixel_math(spark, sf):
    p = pixels(spark, sf)
    out = pw.pixel_math({"a": p.where("frame_id = '0'"), "b": p.where("frame_id = '1'")}, "sqrt(abs($a$)) + 2 * $b$", (0.0, 1.0))
    return rounded(out.select("y", "x", "v"))


# ---- geometry and colour filter arrays --------------------------------------------------------------
def _geo(name: str, sql: str, f: Callable[[DataFrame], DataFrame]) -> None:
    def run(spark, sf):
        return by_vec(f(pixels(spark, sf)))

    run.__name__ = name
    query(f"WITH {LONG} {sql}")(run)


I = lambda e: f"CAST({e} AS INT)"  # noqa: E731, E741
_geo("bin2", f"SELECT vec_id, {I('y // 2')} AS y, {I('x // 2')} AS x, {R('avg(v)')} AS v FROM p GROUP BY ALL", lambda p: geo.bin_pixels(p, 2))
_geo("bin2_sum", f"SELECT vec_id, {I('y // 2')} AS y, {I('x // 2')} AS x, {R('sum(v)')} AS v FROM p GROUP BY ALL", lambda p: geo.bin_pixels(p, 2, total=True))
_geo("crop", f"SELECT vec_id, {I('y - 1')} AS y, {I('x - 2')} AS x, {R('v')} AS v FROM p WHERE x BETWEEN 2 AND 5 AND y BETWEEN 1 AND 6", lambda p: geo.crop(p, 2, 1, 4, 6))
_geo("mirror_x", f"SELECT vec_id, {I('7 - y')} AS y, x, {R('v')} AS v FROM p", geo.mirror_x)
_geo("mirror_y", f"SELECT vec_id, y, {I('7 - x')} AS x, {R('v')} AS v FROM p", geo.mirror_y)
_geo("rotate180", f"SELECT vec_id, {I('7 - y')} AS y, {I('7 - x')} AS x, {R('v')} AS v FROM p", geo.rotate_180)
_geo("rotate90", f"SELECT vec_id, {I('7 - x')} AS y, y AS x, {R('v')} AS v FROM p", lambda p: geo.rotate_90(p, 1))
_geo("extract_green", f"SELECT vec_id, {I('y // 2')} AS y, {I('x // 2')} AS x, {R('avg(v)')} AS v FROM p WHERE (y + x) % 2 = 1 GROUP BY ALL", geo.extract_green)
_geo("extract_ha", f"SELECT vec_id, {I('y // 2')} AS y, {I('x // 2')} AS x, {R('v')} AS v FROM p WHERE y % 2 = 0 AND x % 2 = 0", geo.extract_ha)
_geo("extract_oiii", f"""SELECT vec_id, y, x, {R('v')} AS v FROM p WHERE NOT (y % 2 = 0 AND x % 2 = 0) UNION ALL SELECT p.vec_id, p.y, p.x, {R('avg(q.v)')} FROM p JOIN p q ON q.vec_id = p.vec_id AND abs(q.y - p.y) + abs(q.x - p.x) = 1 WHERE p.y % 2 = 0 AND p.x % 2 = 0 GROUP BY ALL""", lambda p: geo.extract_ha_oiii(p)[1])
_geo("merge_cfa", f"SELECT vec_id, y, x, {R('v')} AS v FROM p", lambda p: geo.merge_cfa(geo.split_cfa(p)))


@query(f"WITH {LONG} SELECT vec_id, CAST(y % 2 * 2 + x % 2 AS INT) AS site, {I('y // 2')} AS y, {I('x // 2')} AS x, {R('v')} AS v FROM p")
def split_cfa(spark, sf):
    return rounded(geo.split_cfa(pixels(spark, sf)).select(F.col("frame_id").cast("long").alias("vec_id"), "site", "y", "x", "v"))


# ---- colour -----------------------------------------------------------------------------------------
def _unpivot(r: str, g: str, b: str, source: str = "c") -> str:
    return f"WITH {COLOR} " + " UNION ALL ".join(f"SELECT vec_id, {k} AS channel, y, x, {R(e)} AS v FROM {source}" for k, e in enumerate((r, g, b)))


def by_channel(p: DataFrame) -> DataFrame:
    return rounded(p.select(F.col("frame_id").cast("long").alias("vec_id"), "channel", "y", "x", "v"))


@query(_unpivot("r * 0.5 + g * 0.3 + b * 0.2", "r * 0.1 + g * 0.8 + b * 0.1", "g * 0.25 + b * 0.75"))
def color_matrix(spark, sf):
    return by_channel(pw.color_matrix(color(spark, sf), (0.5, 0.3, 0.2, 0.1, 0.8, 0.1, 0.0, 0.25, 0.75)))


@query(_unpivot("r", "least(g, (r + b) / 2)", "b"))
def remove_green(spark, sf):
    return by_channel(pw.remove_green(color(spark, sf), preserve=False))


@query(_unpivot("r", "g", "b"))
def split_rgb(spark, sf):
    parts = pw.split_channels(color(spark, sf))
    return rounded(parts.select(F.col("frame_id").cast("long").alias("vec_id"), F.col("part").alias("channel"), "y", "x", "v"))


@query(_unpivot("CASE WHEN r > g AND b > g AND (r + g + b) / 3 > 0 THEN g + (r - g) * 0.14 ELSE r END", "g", "CASE WHEN r > g AND b > g AND (r + g + b) / 3 > 0 THEN g + (b - g) * 0.14 ELSE b END"))
def remove_purple(spark, sf):
    return by_channel(pw.remove_purple(color(spark, sf)))


@query(f"WITH {COLOR}, l AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM (SELECT vec_id, y, x, abs(r) AS r, abs(g) AS g, b FROM c)) SELECT vec_id, y, x, {R('CASE WHEN hi = lo THEN 0 WHEN hi = r THEN CASE WHEN (g - b) / (hi - lo) < 0 THEN (g - b) / (hi - lo) + 6 ELSE (g - b) / (hi - lo) END WHEN hi = g THEN (b - r) / (hi - lo) + 2 ELSE (r - g) / (hi - lo) + 4 END / 6')} AS h, {R('CASE WHEN hi = 0 THEN 0 ELSE (hi - lo) / hi END')} AS s, {R('hi')} AS v FROM l")
def split_hsv(spark, sf):
    w = pw.wide(color(spark, sf).withColumn("v", F.abs("v")))
    h, s, v = pw.hsv(F.col("r"), F.col("g"), F.col("b"))
    return rounded(w.select(F.col("frame_id").cast("long").alias("vec_id"), "y", "x", h.alias("h"), s.alias("s"), v.alias("v")))


@query(f"WITH {LONG}, m AS (SELECT y, x, max(v) FILTER (vec_id = 0) AS r, max(v) FILTER (vec_id = 1) AS g, max(v) FILTER (vec_id = 2) AS b FROM p GROUP BY ALL) " + " UNION ALL ".join(f"SELECT {k} AS channel, y, x, {R(c)} AS v FROM m" for k, c in enumerate("rgb")))
def rgbcomp(spark, sf):
    p = pixels(spark, sf)
    one = lambda k: p.where(F.col("frame_id") == k)
    return rounded(geo.compose_rgb(one("0"), one("1"), one("2"), "rgb").drop("frame_id"))


@query(f"""WITH {COLOR}, a AS (SELECT vec_id, y, x, abs(r) AS r, abs(g) AS g, b FROM c), q AS (SELECT vec_id, 0.15 * (median((r + g + b) / 3) + stddev_samp((r + g + b) / 3)) AS t FROM a GROUP BY 1),
    h AS (SELECT a.*, greatest(r, g, b) AS hi, least(r, g, b) AS lo, (r + g + b) / 3 > t AS on_ FROM a JOIN q USING (vec_id)), s AS (SELECT *, CASE WHEN hi = 0 THEN 0 ELSE (hi - lo) / hi END AS s0 FROM h), k AS (SELECT *, CASE WHEN on_ AND s0 > 0 THEN least(s0 * 1.6, 1) / s0 ELSE 1 END AS f FROM s)
    SELECT vec_id, c AS channel, y, x, {R('CASE c WHEN 0 THEN hi - (hi - r) * f WHEN 1 THEN hi - (hi - g) * f ELSE hi - (hi - b) * f END')} AS v FROM k, (VALUES (0), (1), (2)) t(c)""")
def saturate(spark, sf):
    return by_channel(pw.saturate(color(spark, sf).withColumn("v", F.abs("v")), 0.6, 0.15))


GHS = "CASE WHEN {x} < sp THEN -(1 - 1 / (1 + 2 * (sp - {x}))) WHEN {x} <= hp THEN 1 - 1 / (1 + 2 * ({x} - sp)) ELSE 1 - 1 / (1 + 2 * (hp - sp)) + 2 / ((1 + 2 * (hp - sp)) * (1 + 2 * (hp - sp))) * ({x} - hp) END"


@query(f"""WITH {LONG}, a AS (SELECT vec_id, y, x, abs(v) AS v FROM p), s AS (SELECT vec_id, least(greatest(median(v) - stddev_samp(v), 0), 1) AS sp FROM a GROUP BY 1), t AS (SELECT a.*, sp, greatest(0.7, sp) AS hp FROM a JOIN s USING (vec_id)),
    u AS (SELECT vec_id, y, x, {GHS.format(x='v')} AS z, {GHS.format(x='0.0')} AS z0, {GHS.format(x='1.0')} AS z1 FROM t) SELECT vec_id, y, x, {R('least(greatest((z - z0) / (z1 - z0), 0), 1)')} AS v FROM u""")
def autoghs(spark, sf):
    return by_vec(pw.autoghs(pixels(spark, sf).withColumn("v", F.abs("v")), -1.0, 2.0, b=1.0))


# ---- sequences --------------------------------------------------------------------------------------
@query("SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY CAST(vec_id AS VARCHAR)) + 9 AS idx FROM embeddings")
def convert_sequence(spark, sf):
    files = table(spark, sf, "embeddings").select("vec_id", "label", F.col("vec_id").cast("string").alias("path"))
    return fr.numbered(files, "path", 10, "label").select("vec_id", "label", "idx")


@query("WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), o AS (SELECT label, coalesce(sum(n) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM c) SELECT vec_id, CAST(row_number() OVER (PARTITION BY label ORDER BY CAST(vec_id AS VARCHAR)) + o AS BIGINT) AS idx FROM embeddings JOIN o USING (label)")
def running_index(spark, sf):
    files = table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("folder"), F.col("vec_id").cast("string").alias("path"))
    return fr.numbered_folders(files).select("vec_id", F.col("idx").cast("long").alias("idx"))


@query("SELECT vec_id, label, CASE WHEN vec_id BETWEEN 100 AND 200 THEN false ELSE true END AS included FROM embeddings")
def unselect_frames(spark, sf):
    f = table(spark, sf, "embeddings").select("vec_id", "label", F.col("vec_id").alias("idx"), F.lit(True).alias("included"))
    return fr.marked(f, 100, 200, False).select("vec_id", "label", "included")


# ---- by frame, and streams --------------------------------------------------------------------------
@query()
def rotate_angle(spark, sf):
    return by_vec(geo.rotate(pixels(spark, sf), 30.0))


@query()
def background_poly(spark, sf):
    return by_vec(cal.subtract_background(pixels(spark, sf), 1, samples=4, tolerance=3.0))


@query(f"""WITH {LONG}, c AS (SELECT vec_id, y, x, v - avg(v) OVER (PARTITION BY vec_id) AS v FROM p), s AS (SELECT a.range AS dy, b.range AS dx FROM range(-2, 3) a, range(-2, 3) b),
    k AS (SELECT c.vec_id, dx, dy, avg(c.v * r.v) AS k FROM c, s JOIN c r ON r.vec_id = 0 AND r.y = c.y - dy AND r.x = c.x - dx GROUP BY ALL)
    SELECT vec_id, CAST(dx AS INT) AS dx, CAST(dy AS INT) AS dy FROM k QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY k DESC, abs(dx) + abs(dy), dy DESC, dx DESC) = 1""")
def register_shift(spark, sf):
    return reg.shifts(pixels(spark, sf), "0", most=2).select(F.col("frame_id").cast("long").alias("vec_id"), "dx", "dy")


@query(f"WITH {LONG} SELECT y, x, {R('sum(v)')} AS total, count(*) AS n FROM p GROUP BY ALL")
def live_stack_sums(spark, sf):
    return rounded(live.running_stack(pixels(spark, sf)).drop("channel"))


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf):
    w = live.event_windows(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "1 day")
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 3).alias("total"))
