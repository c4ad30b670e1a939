"""Path grammars, dates, labels, manifests and messages."""

import datetime as dt

from pyspark.sql import functions as F

from nightloom.functions import text as T
from nightloom.sources import messages, tree


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "c string").select(f(F.col("c")).alias("v")).first()["v"]


def test_leaf_grammars(spark):
    leaf = lambda p: one(spark, p, T.leaf)
    assert tuple(leaf("/p/LIGHT/M 31/2024-05-01/RAW_300_Ha")) == ("RAW", 300.0, "Ha", dt.date(2024, 5, 1), "M 31")
    assert tuple(leaf("/p/M31/2024-05-01/PP_120_OIII_Narrow"))[:3] == ("PP", 120.0, "OIII_Narrow")
    assert tuple(leaf("/p/M31/2024-05-01/RAW_L_300.00s"))[:3] == ("RAW", 300.0, "L")
    assert tuple(leaf("/p/M31/x/RAW_300_Ha_120s"))[:4] == ("RAW", 300.0, "Ha_120s", None)
    assert leaf("/p/M31/2024-05-01/Misc_300_Ha") is None


def test_raw_must_exist_and_pairs_are_one(spark):
    paths = ["/a/T/2024-01-01/RAW_60_L", "/a/T/2024-01-01/PP_60_L", "/a/T/2024-01-01/PP_60_R", "/a/T/2024-01-01/RAW_30_G"]
    rows = {r["raw"]: r["pp"] for r in tree.leaves(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert rows == {"/a/T/2024-01-01/RAW_60_L": "/a/T/2024-01-01/PP_60_L", "/a/T/2024-01-01/RAW_30_G": None}


def test_path_time(spark):
    at = lambda p: one(spark, p, T.path_time)
    assert at("/x/2024-05-01/a_20240502-010203") == dt.datetime(2024, 5, 1)
    assert at("/x/a_20240502-010203.fit") == dt.datetime(2024, 5, 2, 1, 2, 3)
    assert at("/x/none") is None


def test_text(spark):
    assert one(spark, "3725", lambda c: T.hours_minutes(c.cast("double"))) == "1h 02m"
    assert one(spark, "/a/b.c.fit", lambda c: T.with_extension(c, "png")) == "/a/b.c.png"
    assert one(spark, "engine v1.4.0-rc2 (x)", T.version).asDict() == {"major": 1, "minor": 4, "patch": 0}
    assert one(spark, "no version", T.version) is None
    assert one(spark, "two words", lambda c: T.command_line("load", c, F.lit(""))) == "load 'two words'"
    assert one(spark, " a, ,b", T.csv_list) == ["a", "b"]
    assert one(spark, "300.0", lambda c: T.number_text(c.cast("double"))) == "300"
    assert one(spark, "2024-01-02T03:04:05.5", T.any_time) == dt.datetime(2024, 1, 2, 3, 4, 5, 500000)


def test_messages(spark):
    rows = ["ready", "log: hello", "status: starting stack", "progress: 45%", "progress: x%", "status: error bad", "odd", "status: exit"]
    got = [(r["kind"], r["text"], r["pct"]) for r in messages.parsed(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "line_no long, line string")).orderBy("line_no").collect()]
    assert got == [("ready", None, None), ("log", "hello", None), ("starting", "stack", None), ("progress", None, 45), ("log", "progress: x%", None), ("error", "bad", None), ("log", "odd", None), ("exit", None, None)]


def test_manifest(spark):
    lines = spark.createDataFrame([("'/a b/1.fit' -> '/t/light_00001.fit'",), ("nothing",)], "value string")
    assert [tuple(r) for r in tree.manifest(lines).collect()] == [("/a b/1.fit", "/t/light_00001.fit")]
