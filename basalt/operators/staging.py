"""Cutting lineage between rounds, in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def staged(df: DataFrame) -> DataFrame:
    """df written to spark.checkpoint.dir and read from there from now on; local sessions may do without the setting."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="basalt-rounds-")
        context.setCheckpointDir(named)
    return df.checkpoint()
