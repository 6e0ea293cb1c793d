"""Cutting a DataFrame's lineage in the folder that the session names, for loops and streams whose plans would grow."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame

CHECKPOINT_KEY = "spark.checkpoint.dir"


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed. A temporary folder stands in only on a local master that names none."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        root = df.sparkSession.conf.get(CHECKPOINT_KEY, None) or context.getConf().get(CHECKPOINT_KEY)
        if not root:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError(f"{CHECKPOINT_KEY} must name a folder that the driver and all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="glyphloom-")
        context.setCheckpointDir(root)
    return df.checkpoint()
