"""A folder for what is written to be read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster names for checkpoints; in a temporary one only if all runs in one process."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='keyline-')}"
    return f"{where}/keyline-{name}-{uuid.uuid4().hex}"


def as_file(text: DataFrame, name: str) -> str:
    """The path of a folder with one file that holds the one row of ``text`` (value)."""
    path = scratch(text.sparkSession, name)
    text.coalesce(1).write.text(path)
    return path
