"""The folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset a temporary one, on ``local`` masters only."""
    context = spark.sparkContext
    set_dir = context.getConf().get("spark.checkpoint.dir")
    if set_dir or context.getCheckpointDir():
        if not context.getCheckpointDir():
            context.setCheckpointDir(set_dir)
        return set_dir or context.getCheckpointDir()
    if not re.match(r"local($|\[)", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()
