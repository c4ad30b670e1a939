"""Cutting the lineage of iterations: reliable checkpoints in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """df computed and written to the folder of spark.checkpoint.dir; a lost executor costs nothing that came before.

    Where the folder is unset a temporary one is taken on a local master; on a cluster that is an error.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        path = sc.getConf().get("spark.checkpoint.dir", None) or df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not path:
            if sc.master.split("[")[0] != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            path = tempfile.mkdtemp(prefix="nightloom-settled-")
        sc.setCheckpointDir(path)
    return df.checkpoint()
