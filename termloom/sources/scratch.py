"""Scratch folders that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """The address of a new folder below spark.checkpoint.dir, on whatever file system that is.

    Where that is unset, a local session gets a temporary folder and a cluster an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError(f"{name} needs spark.checkpoint.dir to name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="termloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    if "://" not in root:
        root = "file://" + root.removeprefix("file:")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
