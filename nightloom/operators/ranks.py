"""Places within groups of any size: a group may fill many tasks, and none of them holds it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window as W, functions as F

from .settle import settled

#: Groups whose sums are sent to all tasks.
FEW = 100_000


def ranked(rows: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "r") -> DataFrame:
    """rows with `name` (long, from 1): the place within the group of `by` in the ascending order of `order`, nulls first.

    Rows are dealt out by ranges of group and order and sorted in each task; the counts of each group's earlier
    tasks are then added. `order` must leave no ties if reruns are to agree. The rows come back from the checkpoint.
    """
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    dealt = rows.repartitionByRange(parts, *by, *order).sortWithinPartitions(*by, *order)
    dealt = settled(dealt.withColumns({"part_": F.spark_partition_id(), "at_": F.monotonically_increasing_id()}))
    parts_of = dealt.groupBy(*by, "part_").agg(F.min("at_").alias("first_"), F.count(F.lit(1)).alias("n_"))
    before = F.coalesce(F.sum("n_").over(W.partitionBy(*by).orderBy("part_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    begins = parts_of.select(*by, "part_", (F.col("first_") - before - 1).alias("zero_"))
    return with_sums(dealt, begins, [*by, "part_"]).withColumn(name, F.col("at_") - F.col("zero_")).select(*rows.columns, name)


def with_sums(rows: DataFrame, sums: DataFrame, by: Sequence[str]) -> DataFrame:
    """rows with the columns of sums, one row for each group of `by`; null is a group like others. Up to FEW groups are sent to all, so that large groups stay spread over tasks."""
    sums = settled(sums)
    named = sums.withColumnsRenamed({c: f"{c}_key" for c in by})
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"{c}_key")) for c in by])
    return rows.join(F.broadcast(named) if sums.count() <= FEW else named, same).drop(*[f"{c}_key" for c in by])
