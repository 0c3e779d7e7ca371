"""Where lineage is cut."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints that all executors share: the one of ``spark.checkpoint.dir``.

    Only in local mode, where that may be unset (tests), a temporary folder of
    this machine is used; it is removed at the end. On a cluster an unset folder
    is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="phasefold-")
            atexit.register(shutil.rmtree, named, True)
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage through a checkpoint that survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
