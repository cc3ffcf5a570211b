"""Intermediate results that are read again: kept in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def keep(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of ``df`` in ``spark.checkpoint.dir``. Where that is unset a local master takes a temporary folder, as in tests; a cluster raises."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="windrose-")
        context.setCheckpointDir(folder)
    return df.checkpoint()
