"""FITS data source, committed versions of tables, and commands of a stream with a time limit."""

import json
import os
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from nightloom.sources import fits
from nightloom.sources.fits_reader import FitsSource
from nightloom.sources.versions import CommitConflict, VersionedTable, find_folder
from nightloom.sources import tree
from nightloom.streaming import commands, live


# ---- FITS -------------------------------------------------------------------------------------------
@pytest.fixture
def folder(tmp_path):
    for i, name in enumerate(("a.fits", "sub/b.FIT", "c.Fits", "notes.txt")):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        header = {"FILTER": "Ha" if i % 2 == 0 else "OIII", "EXPTIME": str(60 * (i + 1)), "OBJECT": "M 31", "TRACKED": "T"} | {f"K{k}": "x" for k in range(60)}
        path.write_bytes(fits.encode(header, np.arange(6) + i, [3, 2]))
    whole = (tmp_path / "c.Fits").read_bytes()
    (tmp_path / "cut.fits").write_bytes(whole[: -2880])  # its pixels are missing
    return str(tmp_path)


@pytest.fixture
def source(spark):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FitsSource)
    yield lambda schema: spark.read.format("fits").schema(schema)
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_fits_by_default(spark, source, folder):
    rows = spark.read.format("fits").load(folder + "/sub").collect()
    assert len(rows) == 1 and rows[0].header["OBJECT"] == "M 31" and (rows[0].width, rows[0].height, rows[0].channels) == (3, 2, 1) and rows[0].data == [1, 2, 3, 4, 5, 6]
    with pytest.raises(Exception, match="buffer|size"):
        spark.read.format("fits").load(folder).collect()  # the file that was cut


def test_fits_headers_alone(source, folder):
    """Without pixels in the schema a file whose pixels are missing reads like any other."""
    df = source("path string, FILTER string, EXPTIME double, NAXIS1 bigint, TRACKED boolean, NOSUCH string").load(folder)
    rows = {r.path.rsplit("/", 1)[1]: r for r in df.collect()}
    assert set(rows) == {"a.fits", "b.FIT", "c.Fits", "cut.fits"} and rows["c.Fits"][1:] == ("Ha", 180.0, 3, True, None)


def test_fits_filters_come_before_pixels(source, folder):
    """The filter on the header spares the pixels of the file that was cut."""
    df = source("path string, FILTER string, EXPTIME double, data array<float>").load(folder)
    assert [r.data for r in df.where("FILTER = 'OIII'").collect()] == [[1, 2, 3, 4, 5, 6]]
    assert df.where("EXPTIME < 100 and FILTER is not null").select("data").collect()[0].data == [0, 1, 2, 3, 4, 5]
    assert df.where("FILTER in ('OIII', 'L')").count() == 1
    heads = source("path string, FILTER string, EXPTIME double").load(folder)
    assert heads.where("NOT (FILTER = 'Ha')").where("EXPTIME >= 0").count() == 1  # a filter that stays with Spark


def test_fits_of_an_empty_folder(source, tmp_path):
    assert source("path string, data array<float>").load(str(tmp_path)).count() == 0


@pytest.mark.parametrize("n", range(6))
def test_fits_checksums(n):
    """All words of the file sum up to ones, whatever the data; another byte is noticed."""
    rng = np.random.default_rng(n)
    raw = fits.encode({"OBJECT": "x" * n, "CHECKSUM": "old"}, rng.normal(size=40 * n * n), [40, n * n], checksum=True)
    assert len(raw) % fits.UNIT == 0 and fits.sum32(raw) == 0xFFFFFFFF
    cards = {c[0]: c[1] for c in fits.parse(raw)[0]}
    assert len(cards["CHECKSUM"]) == 16 and cards["CHECKSUM"].isalnum() and int(cards["DATASUM"]) == fits.sum32(raw[fits.parse(raw)[1] :])
    assert fits.sum32(raw[:700] + b"Z" + raw[701:]) != 0xFFFFFFFF
    assert fits.decode(raw)["axes"] == [40, n * n]


# ---- versions ---------------------------------------------------------------------------------------
def rows_of(spark, *values):
    return spark.createDataFrame([(v, str(v)) for v in values], "id long, name string")


def test_versions_parts_and_history(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "lock"), "id long, name string")
    assert t.latest() == 0 and t.load().count() == 0
    assert t.commit({"Ha": rows_of(spark, 1, 2)}) == 1
    assert t.commit({"OIII": rows_of(spark, 3).withColumn("extra", F.lit(1))}) == 2  # one layer more, the other is kept
    assert t.commit({"Ha": rows_of(spark, 9)}) == 3
    ids = lambda v=None: sorted(r.id for r in t.load(v).collect())
    assert ids() == [3, 9] and ids(1) == [1, 2] and ids(2) == [1, 2, 3] and t.load().columns == ["id", "name"]
    t.commit({"OIII": None})
    assert ids() == [9]
    t.commit({"all": rows_of(spark)}, replace_all=True)
    assert ids() == [] and t.parts() .keys() == {"all"}
    assert t.vacuum() == 3 and t.versions() == [5] and ids() == []


def test_only_one_of_two_writers_commits(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "index"), "id long, name string")
    t.commit({"all": rows_of(spark, 1)})
    t.commit({"all": rows_of(spark, 1, 2)}, read=1)
    with pytest.raises(CommitConflict):
        t.commit({"all": rows_of(spark, 1, 3)}, read=1)
    assert t.latest() == 2 and t.load().count() == 2


def test_writers_at_once_lose_nothing(spark, tmp_path):
    folder = str(tmp_path / "index")
    VersionedTable(spark, folder, "id long, name string").commit({"all": rows_of(spark, 0)})

    def add(k):
        VersionedTable(spark, folder, "id long, name string").update(lambda rows: rows.unionByName(rows_of(spark, k)), tries=20)

    threads = [threading.Thread(target=add, args=(k,)) for k in range(1, 5)]
    [x.start() for x in threads]
    [x.join() for x in threads]
    t = VersionedTable(spark, folder, "id long, name string")
    assert sorted(r.id for r in t.load().collect()) == [0, 1, 2, 3, 4] and t.latest() == 5


def test_nearest_folder(spark, tmp_path):
    (tmp_path / "a/.index").mkdir(parents=True)
    (tmp_path / "a/b/c").mkdir(parents=True)
    assert find_folder(spark, str(tmp_path / "a/b/c"), ".index").endswith("/a/.index")
    assert find_folder(spark, str(tmp_path / "a/b"), ".no-such-name-anywhere") is None


# ---- commands with a time limit ---------------------------------------------------------------------
def test_commands_end_or_run_out_of_time(spark, tmp_path):
    """Batch after batch: an end, an error, a start before the end, a timer that fires without a message, a message too late."""
    at = lambda s: f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}"
    batches = [
        [("a", 0, "starting", "stack", None), ("a", 2, "log", "x", None), ("a", 1, "progress", None, 40), ("b", 0, "starting", "load", None), ("c", 5, "starting", "one", None)],
        [("a", 10, "success", "stack", None), ("c", 20, "starting", "two", None), ("d", 30, "log", "nobody", None)],
        [("d", 100, "starting", "late", None)],  # the watermark passes b's and c's limit
        [("d", 130, "error", "late", None), ("b", 1, "success", "load", None)],  # b's success comes behind the watermark
        [("d", 300, "log", "end", None)],
    ]
    source = tmp_path / "in"
    source.mkdir()
    for i, rows in enumerate(batches):
        spark.createDataFrame([(s, at(t), k, x, p) for s, t, k, x, p in rows], "session string, time string, kind string, text string, pct int").coalesce(1).write.mode("append").json(str(tmp_path / f"b{i}"))
        part = next((tmp_path / f"b{i}").glob("*.json"))
        part.rename(source / f"{i}.json")
        os.utime(source / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    messages = spark.readStream.schema("session string, time timestamp, kind string, text string, pct int").option("maxFilesPerTrigger", 1).json(str(source))
    q = commands.completions(messages, 60).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.session, r.name): (r.outcome, r.n_logs, r.progress, (r.ended - r.started).total_seconds()) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", "stack"): ("success", 1, 40, 10), ("b", "load"): ("timeout", 0, None, 60), ("c", "one"): ("unfinished", 0, None, 15), ("c", "two"): ("timeout", 0, None, 60), ("d", "late"): ("error", 0, None, 30)}


def fed(spark, tmp_path, schema, batches):
    """A stream that gets one file for each batch, in order."""
    source = tmp_path / "in"
    source.mkdir()
    for i, rows in enumerate(batches):
        (source / f"{i}.json").write_text("\n".join(json.dumps(r) for r in rows))
        os.utime(source / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))


def test_windows_of_a_stream_leave_out_what_is_late(spark, tmp_path):
    event = lambda t, v: {"ts": f"2024-01-01 {t}:00", "event_type": "click", "value": v}
    batches = [[event("00:05", 1), event("00:50", 2)], [event("02:30", 4)], [event("02:35", 8)], [event("00:10", 100), event("02:40", 16)], [event("06:00", 1)], [event("06:01", 1)], [event("06:02", 1)]]
    events = fed(spark, tmp_path, "ts timestamp, event_type string, value double", batches)
    q = live.event_windows(events).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.start.hour: (r.n, r.total) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {0: (2, 3.0), 2: (3, 28.0)}  # the 100 came behind the watermark; the last window is still open


def test_messages_of_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("ready\nstatus: starting stack x\nprogress: 40%\nlog: half way\nodd line\nstatus: success stack\n")
    q = live.message_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("messages_seen").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = [(r.kind, r.text, r.pct) for r in spark.table("messages_seen").collect()]
    assert len(got) == 6 and set(got) == {("ready", None, None), ("starting", "stack x", None), ("progress", None, 40), ("log", "half way", None), ("log", "odd line", None), ("success", "stack", None)}


def test_project_files_are_found_by_depth(spark, tmp_path):
    for where, name in (("a", "beta"), ("b/c", "alpha"), ("b/.hidden", "gone"), ("1/2/3/4/5/6/7", "deep")):
        (tmp_path / where).mkdir(parents=True)
        (tmp_path / where / "px_project.json").write_text(json.dumps({"name": name}))
    assert [r["name"] for r in tree.projects(spark, str(tmp_path)).collect()] == ["alpha", "beta"]
