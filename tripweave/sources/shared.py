"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` under ``spark.checkpoint.dir`` and go on from there."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        where = sc.getConf().get("spark.checkpoint.dir")
        if not where and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="tripweave-"))
    return df.checkpoint(eager=True)


def merged(df: DataFrame) -> DataFrame:
    """``df`` for a join by sort and merge. A table that grows is often taken for small, by the size of its file, and would go through the driver as a broadcast."""
    return df.hint("merge")
