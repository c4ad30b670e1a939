"""Nulls, ties and window ends of the nearest-master lookup, and the priority of links."""

import datetime as dt

from nightloom.operators import match

OBS = "id string, date date, gain long, offset long, binning string, temperature double, exposure double, filter string"
MASTER = "id string, kind string, date date, gain long, offset long, binning string, temperature double, exposure double, filter string, master_path string"
D = dt.date


def masters(spark, *rows):
    return spark.createDataFrame([(i, k, d, g, None, None, t, e, f, i) for i, k, d, g, t, e, f in rows], MASTER)


def obs(spark, *rows):
    return spark.createDataFrame([(i, d, g, None, None, t, e, f) for i, d, g, t, e, f in rows], OBS)


def found(df):
    return {r["observation_id"]: r["master_id"] for r in df.collect()}


def test_window_ends_and_ties(spark):
    m = masters(spark, ("b", "dark", D(2024, 1, 8), 1, 0.0, 60.0, None), ("a", "dark", D(2024, 1, 8), 1, 0.0, 60.5, None), ("old", "dark", D(2024, 1, 1), 2, None, 60.0, None), ("late", "dark", D(2024, 1, 9), 2, 0.0, 60.0, None))
    o = obs(spark, ("tie", D(2024, 1, 8), 1, 3.0, 60.0, "L"), ("edge", D(2024, 1, 8), 2, 4.0, 60.0, "L"), ("over", D(2024, 1, 8), 2, 6.0, 60.0, "L"), ("far", D(2024, 1, 9), 1, 0.0, 61.1, "L"))
    assert found(match.nearest_master(o, m, "dark", days=7)) == {"tie": "a", "edge": "old"}


def test_null_wishes(spark):
    m = masters(spark, ("nogain", "flat", D(2024, 1, 1), None, 0.0, None, "L"), ("gain", "flat", D(2024, 1, 1), 5, 0.0, None, "L"))
    o = obs(spark, ("any", D(2024, 1, 2), None, None, 60.0, "L"), ("five", D(2024, 1, 2), 5, 0.0, 60.0, "L"), ("six", D(2024, 1, 2), 6, 0.0, 60.0, "L"), ("nofilter", D(2024, 1, 2), 5, 0.0, 60.0, None))
    assert found(match.nearest_master(o, m, "flat")) == {"any": "gain", "five": "gain"}


def test_bias_needs_a_temperature(spark):
    m = masters(spark, ("x", "bias", D(2024, 1, 1), 1, 0.0, None, None))
    o = obs(spark, ("cold", D(2024, 1, 2), 1, 1.0, 60.0, "L"), ("unknown", D(2024, 1, 2), 1, None, 60.0, "L"))
    assert found(match.nearest_master(o, m, "bias")) == {"cold": "x"}


def test_priority(spark):
    kinds = {"dark": (60.0, None), "flat": (None, "L"), "bias": (None, None)}
    want = {"dark,flat,bias": "dark+flat", "dark,bias": "dark+bias", "flat,bias": "flat", "dark": "dark", "bias": "bias", "flat": "flat", "dark,flat": "dark+flat", "": "none"}
    rows, os_ = [], []
    for g, combo in enumerate(want):
        os_.append((combo or "none", D(2024, 1, 2), g, 0.0, 60.0, "L"))
        rows += [(f"{k}{g}", k, D(2024, 1, 1), g, 0.0, *kinds[k]) for k in combo.split(",") if k]
    out = match.link_outcomes(obs(spark, *os_), masters(spark, *rows))
    assert {r["observation_id"]: r["outcome"] for r in out.collect()} == {k or "none": v for k, v in want.items()}
    links = match.links(out).collect()
    assert len(links) == sum(v.count("+") + 1 for v in want.values() if v != "none")


def test_one_gain_and_skewed_dates(spark):
    """Nearly all of one gain in one month: brute force over all pairs, and a join that meets few of them."""
    import random

    rng = random.Random(4)
    day = lambda: D(2024, 1, 1) + dt.timedelta(days=rng.choice([0, 1, 2, 30, 45, 60, 700, 721, 1450]))
    temps = [None, 0.0, -5.0, -10.0, -9.999999999, 4.999, 5.0, 0.1, 0.3]
    m = [(f"m{i:03d}", rng.choice(["dark", "flat", "bias"]), day(), rng.choice([7, 7, 7, None]), rng.choice([None, 1]), rng.choice([None, "1x1"]), rng.choice(temps), rng.choice([None, 60.0, 60.5, 61.0, 59.5]), rng.choice(["L", "R", None]), "") for i in range(150)]
    o = [(f"o{i:03d}", rng.choice([day(), None]) if i % 20 == 0 else day(), rng.choice([7, 7, 7, 8, None]), rng.choice([None, None, 1]), rng.choice([None, None, "1x1"]), rng.choice(temps), rng.choice([None, 60.0, 60.5]), rng.choice(["L", "R", None])) for i in range(150)]
    obs_, masters_ = spark.createDataFrame(o, OBS), spark.createDataFrame(m, MASTER)
    for kind in ("dark", "flat", "bias"):
        want = {}
        for i, date, gain, off, binning, temp, exp, flt in o:
            fits = []
            for mi, mk, md, mg, mo, mb, mt, me, mf, _ in m:
                if date is None or mk != kind or not date - dt.timedelta(days=720) <= md <= date or gain not in (None, mg) or off not in (None, mo) or binning not in (None, mb):
                    continue
                if temp is not None and abs((mt or 0.0) - temp) > 5.0 or kind == "bias" and temp is None or kind == "flat" and (flt is None or mf != flt) or kind == "dark" and (exp is None or me is None or abs(me - exp) > 0.5):
                    continue
                fits.append((-md.toordinal(), mi))
            if fits:
                want[i] = min(fits)[1]
        assert found(match.nearest_master(obs_, masters_, kind)) == want
        many = {r["observation_id"]: r[f"{kind}_id"] for r in match.nearest_masters(obs_, masters_).collect() if r[f"{kind}_id"]}
        assert many == want
