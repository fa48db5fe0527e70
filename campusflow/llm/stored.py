"""Cutting lineage through the shared checkpoint folder."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from urllib.parse import urlparse

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a local session without one gets a temporary folder."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, kind: str) -> str:
    """The address of a new folder inside the shared one, for files that tasks write and map themselves."""
    folder = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    if not urlparse(folder).scheme:
        folder = f"file://{os.path.abspath(folder)}"
    elif folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder.removeprefix("file:")
    files, path = pyarrow.fs.FileSystem.from_uri(folder)
    files.create_dir(path)
    return folder


def stored(frame: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder; a lost executor costs a read, not the work before."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint()


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that stored frames have replaced.

    Spark deletes them once the driver's garbage is collected, which by itself may be long after many steps.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
