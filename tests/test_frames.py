"""Frame operators against NumPy on made-up images; files by round trips; streams against batches."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from nightloom.operators import calibration as cal, frames as fr, geometry as geo, index, pointwise as pw, project, registration as reg, stacking as st
from nightloom.sources import fits, images
from nightloom.streaming import live


def pixels(spark, arrays, seq="s"):
    rows = [(name, seq, c, y, x, float(v)) for name, a in arrays.items() for c, plane in enumerate(np.atleast_3d(a.T).T if a.ndim == 2 else a) for (y, x), v in np.ndenumerate(plane)]
    return spark.createDataFrame(rows, "frame_id string, seq string, channel int, y int, x int, v double")


def image(df, frame=None):
    rows = (df if frame is None else df.where(F.col("frame_id") == frame)).collect()
    out = np.full((max(r["y"] for r in rows) + 1, max(r["x"] for r in rows) + 1), np.nan)
    for r in rows:
        out[r["y"], r["x"]] = r["v"]
    return out


def test_dense_and_long(spark):
    a = np.arange(24, dtype=float).reshape(2, 3, 4)
    back = fr.to_frames(pixels(spark, {"f": a})).first()
    assert (back["width"], back["height"], back["channels"]) == (4, 3, 2) and np.allclose(back["data"], a.ravel())


def test_single_frame_passes_every_rejection(spark):
    a = np.random.default_rng(1).random((3, 3))
    for how in st.REJECTIONS:
        limits = (0.3, 0.05) if how == "generalized" else (3.0, 3.0)
        assert np.allclose(image(st.stack(pixels(spark, {"f": a}), "mean", how, *limits)), a), how


@pytest.mark.parametrize("how", ["sigma", "winsorized", "mad", "generalized", "percentile"])
def test_hot_outlier_goes(spark, how):
    rng = np.random.default_rng(2)
    arrays = {f"f{i}": 1 + rng.normal(0, 0.01, (2, 2)) for i in range(15)}
    arrays["f7"][0, 1] = 9.0
    out = image(st.stack(pixels(spark, arrays), "mean", how, *((0.2, 0.1) if how == "percentile" else (0.3, 0.05) if how == "generalized" else (3.0, 3.0))))
    assert abs(out[0, 1] - 1) < 0.05


def test_best_rejection(spark):
    got = {r["n"]: r["b"]["name"] for r in spark.createDataFrame([(n,) for n in (6, 7, 30, 31)], "n int").select("n", st.best_rejection(F.col("n")).alias("b")).collect()}
    assert got == {6: "percentile", 7: "winsorized", 30: "winsorized", 31: "linear"}


def test_turns_and_rotation(spark):
    a = np.arange(12, dtype=float).reshape(3, 4)
    p = pixels(spark, {"f": a}).drop("seq")
    for k in range(4):
        assert np.array_equal(image(geo.rotate_90(p, k)), np.rot90(a, k))
    assert np.array_equal(image(geo.rotate(p, 180.0)), np.rot90(a, 2))
    flat = image(geo.rotate(pixels(spark, {"f": np.full((9, 9), 3.0)}).drop("seq"), 30.0))
    assert np.nanmin(flat) == pytest.approx(3.0) and np.nanmax(flat) == pytest.approx(3.0)


def test_shift_registration(spark):
    rng = np.random.default_rng(3)
    ref = rng.random((12, 12))
    moved = np.roll(ref, (2, -1), axis=(0, 1))
    got = {r["frame_id"]: (r["dx"], r["dy"]) for r in reg.shifts(pixels(spark, {"a": ref, "b": moved}), "a", most=3).collect()}
    assert got == {"a": (0, 0), "b": (-1, 2)}


def test_star_match(spark):
    rng = np.random.default_rng(4)
    stars = rng.uniform(5, 60, (12, 2))
    angle = 0.1
    turned = stars @ np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]]).T + (3, -2)
    rows = [("ref", 0, float(y), float(x), 100.0 - i, 2.0) for i, (x, y) in enumerate(turned)] + [("f", 0, float(y), float(x), 100.0 - i, 2.0) for i, (x, y) in enumerate(stars)]
    t = {r["frame_id"]: r for r in reg.match_stars(spark.createDataFrame(rows, reg.STARS), "ref").collect()}["f"]
    assert t["a"] == pytest.approx(np.cos(angle), abs=1e-6) and t["dx"] == pytest.approx(3, abs=1e-4) and t["pairs"] == 12


def test_background(spark):
    y, x = np.mgrid[0:16, 0:16]
    out = image(cal.subtract_background(pixels(spark, {"f": 1 + 0.1 * x + 0.05 * y}), 1, samples=8, tolerance=10.0))
    assert out.std() < 1e-8
    out = image(cal.subtract_background(pixels(spark, {"f": 1 + 0.1 * x + 0.05 * y}), None, samples=4, tolerance=10.0, smooth=0.0))
    assert out.std() < 1e-6


def test_calibrate_and_debayer(spark):
    light, dark, flat = np.full((4, 4), 10.0), np.full((4, 4), 2.0), np.tile([[1.0, 3.0]], (4, 2))
    master = lambda a: pixels(spark, {"m": a}).select("channel", "y", "x", "v")
    assert np.allclose(image(cal.calibrate(pixels(spark, {"f": light}), dark=master(dark), flat=master(flat))), 8 / (flat / 2))
    cfa = np.zeros((4, 4))
    cfa[0::2, 0::2], cfa[1::2, 1::2], cfa[0::2, 1::2], cfa[1::2, 0::2] = 1.0, 3.0, 2.0, 2.0
    rgb = cal.debayer(pixels(spark, {"f": cfa}).drop("seq"))
    for c, v in enumerate((1.0, 2.0, 3.0)):
        assert np.allclose(image(rgb.where(F.col("channel") == c)), v)


def test_color_spaces_and_stretches(spark):
    rng = np.random.default_rng(5)
    p = pixels(spark, {"f": rng.random((3, 4, 4))}).drop("seq")
    w = pw.wide(p)
    back = pw.long(w, pw.from_hsv(*pw.hsv(*(F.col(c) for c in "rgb"))))
    d = p.alias("a").join(back.alias("b"), ["frame_id", "channel", "y", "x"]).agg(F.max(F.abs(F.col("a.v") - F.col("b.v")))).first()[0]
    assert d < 1e-12
    ends = spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "v double")
    for f in (lambda v: pw.ght_of(v, 3.0, 1.0, 0.1, 0.3, 0.9), lambda v: pw.ght_of(v, 2.0, -0.5, 0.0, 0.2, 1.0), lambda v: pw.modified_asinh_of(v, 5.0, 0.0, 0.2, 1.0), lambda v: pw.mtf_of(v, 0.0, 0.2, 1.0)):
        got = [r[0] for r in ends.select(f(F.col("v"))).collect()]
        assert got[0] == pytest.approx(0) and got[2] == pytest.approx(1) and 0 < got[1] < 1
    assert pw.autostretch(p, linked=True).count() == p.count() and pw.asinh(p, 10.0, human=True).count() == p.count()
    assert pw.split_channels(p, "lab").count() == p.count()


def test_pixel_math_refuses_other_code(spark):
    p = pixels(spark, {"f": np.ones((2, 2))})
    for bad in ("reflect('x','y')", "$a$; drop", "$b$", "1 + 1"):
        with pytest.raises(ValueError):
            pw.pixel_math({"a": p}, bad)


def test_fits_round_trip(spark, tmp_path):
    a = np.arange(6, dtype=np.float32)
    df = spark.createDataFrame([("f1", {"OBJECT": "M 31", "EXPTIME": "300", "GAIN": "100"}, 3, 2, 1, a.tolist())], "frame_id string, header map<string,string>, width int, height int, channels int, data array<float>")
    fits.write(df, str(tmp_path)).collect()
    r = fits.read(spark, str(tmp_path)).first()
    assert (r["width"], r["height"], r["bitpix"]) == (3, 2, -32) and r["data"] == a.tolist() and r["header"]["OBJECT"] == "M 31" and r["header"]["GAIN"] == "100"


def test_fits_cards():
    kinds = [fits.card(c.ljust(80))[1:4:2] for c in ("A       =                   12 / n", "B       =                1.5D0", "C       =                    T", "D       = 'it''s   '           / s", "E       =", "F       = ?x")]
    assert kinds == [("12", "integer"), ("1.5D0", "float"), ("T", "logical"), ("it's", "string"), ("undefined", "undefined"), ("?x", "invalid")]


def test_image_encoders(spark):
    data = [0.0, 0.25, 0.5, 1.0, 0.0, 1.0]
    df = spark.createDataFrame([("f", 3, 2, 1, data)], "frame_id string, width int, height int, channels int, data array<float>")
    get = lambda k: bytes(images.encoded(df, k).first()["content"])
    raw = get("png")
    body = zlib.decompress(raw[raw.index(b"IDAT") + 4 :])
    assert [struct.unpack(">H", body[1 + 2 * i : 3 + 2 * i])[0] for i in range(3)] == [0, 16384, 32768]
    assert get("pnm").startswith(b"P5\n3 2\n65535\n") and get("bmp").startswith(b"BM") and get("tif32").startswith(b"II*\0")


def test_live_stack_is_the_batch_stack(spark, tmp_path):
    arrays = {f"f{i}": np.random.default_rng(i).random((2, 2)) for i in range(4)}
    p = pixels(spark, arrays)
    for i in range(4):
        p.where(F.col("frame_id") == f"f{i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stack = live.LiveStack(spark, str(tmp_path / "versions"))
    stream = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stack.start(stream, str(tmp_path / "cp")).awaitTermination()
    assert np.allclose(image(stack.image()), np.mean(list(arrays.values()), axis=0))


def test_upsert_keeps_ids_and_writes_nulls(spark):
    s = "id string, raw_path string, calibrated_path string"
    old = spark.createDataFrame([("1", "a", "x"), ("2", "b", "y")], s)
    new = spark.createDataFrame([("9", "a", None), ("8", "c", "z")], s)
    assert sorted(map(tuple, index.upsert(old, new, "raw_path", keep=("id",)).collect())) == [("1", "a", None), ("2", "b", "y"), ("8", "c", "z")]
    links = spark.createDataFrame([("1", "m", "dark")], "observation_id string, master_id string, kind string")
    assert index.purge(old, links, spark.createDataFrame([("b",)], "path string")) == (old, links)
    kept, left = index.purge(old, links, spark.createDataFrame([("b",)], "path string"), confirm=True)
    assert [r["id"] for r in kept.collect()] == ["2"] and left.count() == 0


def test_fingerprints(spark):
    rows = [("p", "single", "l", None, f, True, None, paths) for f, paths in ((None, ["b", "a"]), (None, ["a", "b"]), ("None", ["a", "b"]))] + [("p", "spiral", "l", None, None, None, x, ["a"]) for x in (0.0, 1.5)]
    from nightloom.schema import LAYERS

    h = [r["input_hash"] for r in project.fingerprints(spark.createDataFrame(rows, LAYERS)).collect()]
    import hashlib

    assert h[0] == h[1] == hashlib.sha256(b"l|None|true|a|b").hexdigest() and h[2] != h[0]
    assert h[3] == hashlib.sha256(b"l|None|0|a").hexdigest() and h[4] == hashlib.sha256(b"l|None|1.5|a").hexdigest()


def test_layer_summary_edges(spark):
    s = "project string, layer string, filter string, date date, subs long, exposure double"
    import datetime as dt

    rows = [("p", "none", None, None, 0, 60.0), ("p", "two", "Ha", dt.date(2024, 1, 1), 3, 10.0), ("p", "two", "Ha", dt.date(2024, 1, 1), 2, None)]
    got = {r["layer"]: r for r in project.layer_summary(spark.createDataFrame(rows, s)).collect()}
    assert got["none"]["average_exposure"] == 0 and got["none"]["nights"] == 0 and got["two"]["nights"] == 1 and got["two"]["total_exposure"] == 30
    balance = project.filter_balance(project.layer_summary(spark.createDataFrame(rows, s))).collect()
    assert {r["filter"]: r["percent_of_total"] for r in balance} == {"unknown": 0.0, "Ha": 100.0}


def test_places_in_groups_that_fill_many_tasks(spark):
    from nightloom.operators.ranks import ranked

    rows = [(None if k % 3 == 0 else "a", float(k * 7919 % 1000 // 10), k) for k in range(1000)]
    got = {r.k: r.r for r in ranked(spark.createDataFrame(rows, "g string, v double, k int"), ["g"], ["v", "k"]).collect()}
    for g in (None, "a"):
        want = [k for _, k in sorted((v, k) for h, v, k in rows if h == g)]
        assert [got[k] for k in want] == list(range(1, len(want) + 1))


@pytest.mark.parametrize("how", ["generalized", "linear"])
def test_ordered_rejections_hold_no_pixel_in_one_task(spark, how):
    """A stack of many frames: as on a sorted array, and without a window or a list over a pixel's values."""
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.normal(size=2990), rng.normal(size=10) * 50])
    rows = [(None, f"f{i}", 0, 0, 0, float(a)) for i, a in enumerate(v)]
    p = spark.createDataFrame(rows, "seq int, frame_id string, channel int, y int, x int, v double")
    out = st.REJECTIONS[how](p, *st.DEFAULTS[how], st.PIXEL)
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    left = np.sort(v)
    if how == "generalized":
        z = 1.959963984540054
        for _ in range(900):
            n, below, above = len(left), left.mean() - left[0], left[-1] - left.mean()
            if not max(below, above) > z * (n - 1) / np.sqrt(n * (n - 2 + z * z)) * left.std(ddof=1):
                break
            left = left[1:] if below > above else left[:-1]
    else:
        r = np.arange(1, 3001)
        e = left - np.polyval(np.polyfit(r, left, 1), r)
        left = left[np.abs(e) <= 5 * e.std(ddof=1)]
    assert len(left) < 3000 and np.allclose(sorted(r.v for r in out.collect()), left)


def test_normalisation_does_not_deal_pixels_out_by_channel(spark):
    p = spark.createDataFrame([(0, f, 0, y, x, float(k + y * x)) for k, f in enumerate("abc") for y in range(3) for x in range(3)], "seq int, frame_id string, channel int, y int, x int, v double")
    with_ref = st.normalised(p.hint("merge"), "addscale", "a")
    plan = with_ref._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(channel" not in plan and "BroadcastHashJoin [channel" in plan
    assert {r.frame_id: r.v for r in with_ref.where("y = 0 and x = 0").collect()} == {"a": 0.0, "b": 0.0, "c": 0.0}


def test_only_bright_stars_are_put_in_order(spark):
    flux = [float(k * 7919 % 5003) - 2500 for k in range(5000)] + [None, float("nan"), float("inf"), 2502.0, 2502.0]
    stars = spark.createDataFrame([(f, float(i), 0.0, v) for f in "ab" for i, v in enumerate(flux)] + [("c", 1.0, 1.0, None)], "frame_id string, x double, y double, flux double")
    left = reg.bright(stars, 500)
    key = lambda v: (v is not None, v is not None and v != v, 0 if v is None or v != v else v)  # noqa: E731  Spark's descending order: NaN, numbers, nulls
    want = sorted(flux, key=key, reverse=True)[:500]
    for frame in "ab":
        got = sorted((r.flux for r in left.where(F.col("frame_id") == frame).collect()), key=key, reverse=True)
        assert 500 <= len(got) < 600 and list(map(str, got[:500])) == list(map(str, want))
    assert left.where("frame_id = 'c'").count() == 1


def test_wanted_observations_are_not_dealt_out(spark):
    """what layers lack, from paths as arrays or as rows; layers x observations go through no exchange."""
    layers = spark.createDataFrame([("p", "a", "R", ["1", "2"]), ("p", "b", "R", []), ("q", "a", None, ["3"]), (None, "a", "G", ["3"])], "project string, layer string, filter string, paths array<string>")
    seen = spark.createDataFrame([("R", "1"), ("R", "4"), ("R", "4"), ("G", "3"), (None, "5"), ("R", None)], "filter string, raw_path string")
    want = [("p", "a", None), ("p", "a", "4"), ("p", "a", "4"), ("p", "b", None), ("p", "b", "1"), ("p", "b", "4"), ("p", "b", "4"), (None, "a", "3")]
    held = layers.select("project", "layer", F.explode("paths").alias("path"))
    order = lambda rows: sorted(map(tuple, rows), key=str)
    new = project.sync_new(layers, seen)
    assert order(new.collect()) == order(want) == order(project.sync_new(layers.drop("paths"), seen, held).collect())
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" not in plan and plan.index("BroadcastHashJoin") < plan.index("Exchange hashpartitioning")
