"""Cutting lineage in a folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set: on one machine a folder of our own; on a cluster that is an error, as
    executors don't see each other's disks."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="millrace-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint()


def settled(df: DataFrame) -> DataFrame:
    """What a round of a loop made, as a table in the shared folder. A checkpoint keeps the optimiser's estimate of its size, which
    is multiplied at every join and so grows without bound over many rounds; a table has the size that it has. It has as many
    files at most as a shuffle has partitions."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.coalesce(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
