"""Nearest calibration master for each observation, and the choice among them.

A lookup is an as-of join with tolerances. Dates are cut into buckets as long as the window and tolerances into
cells, and an observation probes its own and the next, so the join is an equi-join on all that must match; the
newest match is a minimum over a struct, which Spark combines before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

TOLERANCE, DAYS, EXPOSURE = 5.0, 720, 0.5
OPTIONAL = ("offset", "binning")
ORDER = ("dark", "flat", "bias")


def optional_equal(wanted: Column, have: Column) -> Column:
    """A null wish accepts anything; a null value never meets a wish."""
    return wanted.isNull() | (wanted == have)


def within(wanted: Column, have: Column, tolerance: float) -> Column:
    """A null wish accepts anything; a null value counts as 0."""
    return wanted.isNull() | (F.abs(F.coalesce(have, F.lit(0.0)) - wanted) <= tolerance)


def _cell(value: Column, width: float) -> Column:
    return F.floor(value / width)


def _around(value: Column, reach: float, width: float) -> Column:
    """The cells within reach of a value (a hair more, for rounding): two, or three for a value in the middle of one."""
    slack = reach + 1e-9 * F.greatest(F.abs(value), F.lit(1.0))
    return F.sequence(_cell(value - slack, width), _cell(value + slack, width))


def candidates(observations: DataFrame, masters: DataFrame, kinds: Sequence[str], tolerance: float, days: int, exposure: float) -> DataFrame:
    """(id, m_kind, m_date, m_id): every master that an observation may take.

    The join's key holds all that a match asks for: kind, date bucket, gain, a cell of temperature as wide as twice the
    tolerance, and a cell of exposure (darks) or the filter (flats); an observation probes the cells in reach. Only observations without gain
    or temperature, which accept any, meet masters by kind, date and exposure or filter alone.
    """
    bucket = lambda date: F.floor(F.unix_date(date) / (days + 1)).cast("int")
    warm, long = 2 * tolerance or 1.0, 2 * exposure or 1.0
    m = masters.where(F.col("kind").isin(*kinds)).select(*[F.col(f"`{c}`").alias(f"m_{c}") for c in ("id", "kind", "date", "gain", "offset", "binning", "temperature", "exposure", "filter")])
    own = F.when(F.col("m_kind") == "dark", _cell(F.col("m_exposure"), long).cast("string")).when(F.col("m_kind") == "flat", F.col("m_filter")).otherwise("")
    m = m.select("*", F.col("m_kind").alias("kind"), bucket(F.col("m_date")).alias("bucket"), own.alias("own"), F.col("m_gain").alias("gain_key"), _cell(F.coalesce("m_temperature", F.lit(0.0)), warm).alias("warm")).where("own is not null")
    o = observations.select("id", "date", "gain", "`offset`", "binning", "temperature", "exposure", "filter").where("date is not null").withColumn("kind", F.explode(F.array(*map(F.lit, kinds))))
    o = o.where((F.col("kind") != "bias") | F.col("temperature").isNotNull())
    owns = F.when(F.col("kind") == "dark", _around(F.col("exposure"), exposure, long).cast("array<string>")).when(F.col("kind") == "flat", F.array("filter")).otherwise(F.array(F.lit("")))
    o = o.withColumn("own", F.explode(owns)).where("own is not null").withColumn("bucket", F.explode(F.array(bucket(F.col("date")), bucket(F.col("date")) - 1)))
    close = F.col("m_date").between(F.date_sub("date", days), F.col("date")) & within(F.col("temperature"), F.col("m_temperature"), tolerance)
    close &= (F.col("m_kind") != "dark") | (F.abs(F.col("m_exposure") - F.col("exposure")) <= exposure)
    for c in OPTIONAL:
        close &= optional_equal(F.col(f"`{c}`"), F.col(f"`m_{c}`"))
    sure = F.col("gain").isNotNull() & F.col("temperature").isNotNull()
    key = ["kind", "bucket", "own"]
    probes = o.where(sure).withColumn("warm", F.explode(_around(F.col("temperature"), tolerance, warm))).withColumn("gain_key", F.col("gain"))
    exact = probes.join(m, [*key, "gain_key", "warm"]).where(close)
    loose = o.where(~sure).join(m, key).where(close & optional_equal(F.col("gain"), F.col("m_gain")))
    return exact.select("id", "m_kind", "m_date", "m_id").unionByName(loose.select("id", "m_kind", "m_date", "m_id"))


def nearest_master(observations: DataFrame, masters: DataFrame, kind: str, tolerance: float = TOLERANCE, days: int = DAYS, exposure: float = EXPOSURE) -> DataFrame:
    """(observation_id, master_id, master_date): the newest master of the kind in [date - days, date]; ties go to the smallest id.

    Gain, offset and binning must be equal where the observation has them; temperatures within the
    tolerance. Darks: exposures within `exposure`. Flats: equal filters. Bias: the observation needs a
    temperature.
    """
    found = candidates(observations, masters, (kind,), tolerance, days, exposure)
    best = F.min(F.struct((-F.unix_date("m_date")).alias("age"), F.col("m_id").alias("id"), F.col("m_date").alias("date"))).alias("best")
    return found.groupBy(F.col("id").alias("observation_id")).agg(best).select("observation_id", F.col("best.id").alias("master_id"), F.col("best.date").alias("master_date"))


def nearest_masters(observations: DataFrame, masters: DataFrame, tolerance: float = TOLERANCE, days: int = DAYS, exposure: float = EXPOSURE) -> DataFrame:
    """(observation_id, dark_id, flat_id, bias_id) of observations that have any: the three lookups as one join and one aggregate."""
    found = candidates(observations, masters, ORDER, tolerance, days, exposure)
    best = lambda k: F.min(F.when(F.col("m_kind") == k, F.struct((-F.unix_date("m_date")).alias("age"), F.col("m_id").alias("id"))))["id"].alias(f"{k}_id")
    return found.groupBy(F.col("id").alias("observation_id")).agg(*map(best, ORDER))


def link_outcomes(observations: DataFrame, masters: DataFrame, **kw) -> DataFrame:
    """(observation_id, dark_id, flat_id, bias_id, outcome) for every observation.

    Outcome: dark+flat, else dark+bias, else flat, dark, bias, else none.
    """
    out = observations.select(F.col("id").alias("observation_id")).join(nearest_masters(observations, masters, **kw), "observation_id", "left")
    dark, flat, bias = (F.col(f"{k}_id").isNotNull() for k in ORDER)
    outcome = F.when(dark & flat, "dark+flat").when(dark & bias, "dark+bias").when(flat, "flat").when(dark, "dark").when(bias, "bias").otherwise("none")
    return out.withColumn("outcome", outcome)


def links(outcomes: DataFrame) -> DataFrame:
    """Link rows (observation_id, master_id, kind) of the chosen masters only."""
    each = F.explode(F.filter(F.split("outcome", r"\+"), lambda k: k != "none")).alias("kind")
    chosen = F.when(F.col("kind") == "dark", F.col("dark_id")).when(F.col("kind") == "flat", F.col("flat_id")).otherwise(F.col("bias_id"))
    return outcomes.select("observation_id", "dark_id", "flat_id", "bias_id", each).select("observation_id", chosen.alias("master_id"), "kind")


def tally(outcomes: DataFrame) -> DataFrame:
    """(outcome, n)."""
    return outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
