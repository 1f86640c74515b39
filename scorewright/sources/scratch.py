"""Tables that are computed once and read several times."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def written(df: DataFrame) -> DataFrame:
    """df, computed now and kept in the shared folder that spark.checkpoint.dir names, with its lineage cut.

    Where no folder is named, a temporary one serves a local master; on a cluster that is an error.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="scorewright-"))
    return df.checkpoint()
