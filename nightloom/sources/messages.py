"""The line protocol of an image engine as typed messages, alike for batches and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def parsed(lines: DataFrame, column: str = "line") -> DataFrame:
    """lines with kind, text and pct. Lines that fit no form are logs."""
    c = F.col(column)
    starts = lambda p: F.startswith(c, F.lit(p))
    pct = F.regexp_extract(c, r"^progress: (\d+)%?$", 1).try_cast("int")
    kind = (
        F.when(F.trim(c) == "ready", "ready").when(starts("log: "), "log").when(starts("status: starting "), "starting").when(starts("status: success "), "success")
        .when(starts("status: error "), "error").when(F.trim(c) == "status: exit", "exit").when(starts("progress: ") & pct.isNotNull(), "progress").otherwise("log")
    )
    text = F.when(starts("log: "), F.substr(c, F.lit(6))).when(c.rlike("^status: (starting|success|error) "), F.trim(F.regexp_replace(c, "^status: (starting|success|error) ", "")))
    plain = (kind == "log") & ~starts("log: ")
    return lines.withColumns({"kind": kind, "text": F.when(plain, c).otherwise(text), "pct": F.when(kind == "progress", pct)})


def commands(messages: DataFrame, order: str = "line_no", group: str | None = None) -> DataFrame:
    """One row for each command: its logs in order, and how it ended. A command runs from its start to the next one's."""
    keys = [group] if group else []
    w = (W.partitionBy(group) if group else W.partitionBy()).orderBy(order)
    numbered = messages.withColumn("command", F.sum((F.col("kind") == "starting").cast("int")).over(w)).where("command > 0")
    logs = F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "log", F.struct(order, "text")))), lambda s: s["text"])
    return numbered.groupBy(*keys, "command").agg(
        F.max(F.when(F.col("kind") == "starting", F.col("text"))).alias("name"), logs.alias("logs"),
        F.max(F.when(F.col("kind").isin("success", "error"), F.col("kind"))).alias("outcome"), F.max("pct").alias("progress"),
    )
