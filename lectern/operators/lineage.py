"""Plans cut where they would grow: rows kept in the folder that all machines share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed now and kept in the folder of spark.checkpoint.dir, whatever executors are lost.

    Where that is unset and all runs on one machine, as in tests, the folder is a temporary one.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.match(r"local(\[|$)", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
            folder = f"file://{tempfile.mkdtemp(prefix='lectern-')}"
        context.setCheckpointDir(folder)
    return df.checkpoint()
