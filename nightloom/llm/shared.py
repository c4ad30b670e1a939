"""Shared folder, tables in it, size-checked broadcasts and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows of a two-column id table that may be broadcast (about 32 bytes a row in a hash relation).
BROADCAST_ROWS = 1_000_000
#: Characters, and 32 for each row, of a table with texts that may be broadcast.
BROADCAST_TEXT = 16_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset a temporary folder becomes the checkpoint folder, but on a local master only:
    on a cluster a folder of the driver would lose what executors write, so that is an error.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if not path and current.isDefined():
        path = current.get()
    if not path:
        if sc.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="nightloom-checkpoints-")
    if not current.isDefined():
        sc.setCheckpointDir(path)
    return path


def _file_system(spark: SparkSession, path: str):
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    return to.getFileSystem(spark._jsc.hadoopConfiguration()), to


def own_dir(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing else uses; what is there goes when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    fs, to = _file_system(spark, path)
    fs.mkdirs(to)
    fs.deleteOnExit(to)
    return path


def cut(df: DataFrame) -> DataFrame:
    """The rows of df without its lineage: written to a compressed table in the shared folder and read again.

    Survives the loss of any executor. drop() removes it; else it goes when the driver ends.
    """
    path = own_dir(df.sparkSession, "cut")
    df.write.mode("append").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.cut_path = path
    return back


def drop(*tables: DataFrame) -> None:
    """Removes tables made by cut() that no result reads any more."""
    for t in tables:
        fs, to = _file_system(t.sparkSession, t.cut_path)
        fs.delete(to, True)


def large(df: DataFrame) -> DataFrame:
    """df to be joined by sort and merge, neither it nor what it is joined with broadcast.

    Spark's own sizes are far too low for cut and exploded tables: it takes the compressed files, an array for one element and
    an exploded table for the one before. A table taken for 8 MB can be 800 MB in the driver.
    """
    return df.hint("merge")


def small(df: DataFrame, limit: int = BROADCAST_ROWS, weight: Column | None = None) -> DataFrame:
    """df with a broadcast hint if it has at most limit rows (or that sum of weights), else large(df).

    df should be cheap to count (a cut table); it must be narrow.
    """
    n = df.limit(limit + 1).count() if weight is None else df.agg(F.sum(weight)).first()[0] or 0
    return F.broadcast(df) if n <= limit else large(df)


def small_text(df: DataFrame, *columns: str, row: int = 32) -> DataFrame:
    """small() for a table with texts: by their lengths and `row` for the rest of a row, so that long texts count as what they are."""
    return small(df, BROADCAST_TEXT, sum((F.coalesce(F.length(c), F.lit(0)) for c in columns), F.lit(row)))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(id, component): the smallest id reachable from each id that has an edge.

    edges: (a, b) of one orderable type; direction, repeats and loops don't matter.
    Alternates large-star and small-star steps (Kiveris et al., 2014). Each step is a partial
    aggregate for the smallest neighbour and a join with it: a broadcast below a checked number of
    edges, else a join of two written tables, of which Spark can split a hub's rows.
    """
    edges = cut(edges.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct())

    def digest(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("lo", "hi").cast("decimal(20,0)"))).first())

    state = digest(edges)
    if not state[0]:
        return edges.select(F.col("lo").alias("id"), F.col("lo").alias("component"))
    for _ in range(rounds):
        used = [edges]

        def sent(least: DataFrame, used: list = used, few: bool = 2 * state[0] <= BROADCAST_ROWS) -> DataFrame:
            if few:  # a row for each end of an edge at most
                return F.broadcast(least)
            used.append(cut(least))
            return large(used[-1])

        # large star: neighbours above u hang on the smallest neighbour of u (or u)
        both = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionAll(edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = sent(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo <> hi").distinct()
        # small star: u and its neighbours below hang on the smallest of them
        large = cut(large)
        used.append(large)
        least = sent(large.groupBy("hi").agg(F.min("lo").alias("m")))
        hung = large.join(least, "hi")
        edges = cut(
            hung.select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
            .unionAll(least.select(F.col("m").alias("lo"), "hi"))
            .where("lo <> hi")
            .distinct()
        )
        drop(*used)
        now = digest(edges)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("connected components did not settle")
    return edges.select(F.col("hi").alias("id"), F.col("lo").alias("component")).unionAll(
        edges.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct()
    )
