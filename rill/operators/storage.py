"""Where frames are kept that must be the same each time they are read: the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame as SparkFrame
from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` or the folder given to ``setCheckpointDir``; /tmp/checkpoints only where all runs on one machine."""
    chosen = spark.conf.get("spark.checkpoint.dir", None)
    if not chosen:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        chosen = given.get() if given.isDefined() else None
    if not chosen:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        chosen = "file:///tmp/checkpoints"
    return chosen.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path for a new table in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def fixed(sdf: SparkFrame) -> SparkFrame:
    """The frame's rows as they are now, checkpointed: the same partitions and order whenever they are read."""
    context = sdf.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(sdf.sparkSession))
    return sdf.checkpoint()
